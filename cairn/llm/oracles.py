"""DuckDB SQL for the operators that SQL can express, over whole tables."""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS o
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight FROM t),
ranked AS (SELECT *, 3 * source_size / weight AS r, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS k FROM w),
levels AS (
  SELECT a.k, a.r, ((SELECT sum(source_size) FROM w) - coalesce((SELECT sum(3 * b.source_size) FROM ranked b WHERE b.k < a.k), 0))::DOUBLE
         / ((SELECT sum(weight) FROM w) - coalesce((SELECT sum(b.weight) FROM ranked b WHERE b.k < a.k), 0)) AS level
  FROM ranked a),
fill AS (SELECT level FROM levels WHERE r >= level ORDER BY k LIMIT 1),
p AS (SELECT source, source_size, least(3.0 * source_size, (SELECT level FROM fill) * weight)::DOUBLE AS target FROM w),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(least(target / source_size, 3.0)) ELSE 0 END AS whole FROM p),
x AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, greatest(q.target - q.whole * q.source_size, 0) AS missing,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2 AS middle
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (size * least(whole + CASE WHEN missing > 0 AND middle <= missing THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM x
"""

QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text AS original, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
tokens AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM s),
windows AS (
  SELECT rid, i, word || chr(10) || lead(word, 1) OVER o || chr(10) || lead(word, 2) OVER o AS g
  FROM tokens WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM windows WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
repeated AS (SELECT rid, count(DISTINCT i + step)::BIGINT AS n FROM twice, (VALUES (0), (1), (2)) v(step) GROUP BY rid),
lines AS (
  SELECT rid, source, original, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words,
         trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT rid, source, original, unnest(lines) AS l FROM s)),
frequent AS (SELECT source, line FROM lines GROUP BY source, line HAVING count(DISTINCT original) > 30),
share AS (
  SELECT a.rid, sum(a.words) AS words, sum(CASE WHEN f.line IS NULL THEN a.words ELSE 0 END) AS stay
  FROM lines a LEFT JOIN frequent f ON a.source IS NOT DISTINCT FROM f.source AND a.line = f.line GROUP BY a.rid),
base AS (
  SELECT s.rid, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM s LEFT JOIN repeated r ON s.rid = r.rid),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(100 * stay >= 50 * words, true) AS kept
FROM judged LEFT JOIN share ON judged.rid = share.rid
"""



def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Vectors of 64 components; every distance is taken, which is the brute-force version of the trees."""
    nearest = """{name} AS MATERIALIZED (
  SELECT v.vec_id, v.p, min_by(c.e, (c.d, c.e)) AS e, min(c.d) AS d
  FROM parts v, LATERAL (SELECT b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM {books} b WHERE b.p = v.p) c
  GROUP BY v.vec_id, v.p)"""
    moved = """{name} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x
  FROM {books} b LEFT JOIN (
    SELECT p, e, list(c ORDER BY i) AS x
    FROM (SELECT a.p, a.e, i, (sum(v.x[i + 1]) - ((sum(v.x[i + 1]) % count(*)) + count(*)) % count(*)) // count(*) AS c
          FROM {found} a JOIN parts v USING (vec_id, p), range({step}) r(i) GROUP BY a.p, a.e, i)
    GROUP BY p, e) m USING (p, e))"""
    step = 64 // parts
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, p, x[{step} * p + 1 : {step} * p + {step}] AS x FROM kept, range({parts}) r(p))",
        f"b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))",
    ]
    for r in range(rounds):
        steps += [nearest.format(name=f"a{r}", books=f"b{r}"), moved.format(name=f"b{r + 1}", books=f"b{r}", found=f"a{r}", step=step)]
    steps += [nearest.format(name="found", books=f"b{rounds}"), "coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM found GROUP BY vec_id)"]
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT k.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,"
        f" (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM kept k JOIN coded USING (vec_id)"
    )


SQL = {"op12_vector_codes": vector_codes(), "op4_quality_rules": QUALITY, "op7_mixing": MIXING}
