"""Whole evaluation reports over orders taken as cases, with SQL that counts and writes for itself."""

from pyspark.sql import functions as F

from cairn.operators import eval_report, metrics
from cairn.plans.tables import table as _t


def k04_eval_report(spark, sf_dir):
    key = F.col("o_orderkey")
    x = _t(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("provider"), F.col("o_orderstatus").alias("model"), (key % 3 + 1).alias("repetition"), F.concat(F.lit("rule"), (F.col("o_custkey") % 12).cast("string")).alias("rule_id"), key.alias("id"),
        (F.col("o_totalprice") > 150000).alias("expected"), (F.col("o_custkey") % 2 == 0).alias("actual"), (key % 11 != 0).alias("valid"), F.when(key % 13 == 0, F.lit(True)).alias("expected_abstention"), (key % 7 == 0).alias("actual_abstention"),
    )
    return eval_report.report(x.withColumn("failed", ~F.col("valid") | (F.col("expected") != F.col("actual")))).withColumnRenamed("section", "part")


def a08_outcomes(spark, sf_dir):
    key = F.col("o_orderkey")
    x = _t(spark, sf_dir, "orders").select(
        "o_orderpriority", F.array("o_orderstatus").alias("expected_choices"), F.when(key % 3 == 0, F.array(F.lit("F"))).when(key % 3 == 1, F.array(F.lit("O"))).alias("actual_choices"),
        (F.col("o_totalprice") > 150000).alias("expected_finding"), F.when(key % 5 != 0, F.col("o_custkey") % 2 == 0).alias("actual_finding"), F.when(key % 4 == 0, True).when(key % 4 == 1, False).alias("expected_abstention"), (key % 6 == 0).alias("actual_abstention"), (key % 9 == 0).alias("accepted"),
    )
    return metrics.outcomes(x, "o_orderpriority")


def a18_cycle_comparison(spark, sf_dir):
    scenario = F.element_at(F.array(*[F.lit(s) for s in ("uncached", "cold", "warm", "incremental")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    x = _t(spark, sf_dir, "orders").groupBy(scenario.alias("scenario")).agg(F.avg(F.col("o_orderkey") % 100).alias("mean"), F.count(F.lit(1)).alias("requests"), F.sum("o_custkey").alias("input_tokens"), F.sum(F.length("o_orderpriority")).alias("output_tokens"), F.min("o_orderstatus").alias("fingerprint"))
    return metrics.cycle_comparison(x)


_CASES = """c AS (SELECT o_orderpriority AS p, o_orderstatus AS m, o_orderkey % 3 + 1 AS rep, 'rule' || o_custkey % 12 AS r, o_orderkey AS id, o_totalprice > 150000 AS e, o_custkey % 2 = 0 AS a, o_orderkey % 11 <> 0 AS v, o_orderkey % 13 = 0 AS ea, o_orderkey % 7 = 0 AS aa FROM orders),
 n AS (SELECT p, m, r, grouping(r) AS whole, count(DISTINCT rep) AS runs, count(*) AS n, count(*) FILTER (NOT v OR e <> a) AS f, count(*) FILTER (NOT v) AS i, count(*) FILTER (v AND e AND a) AS tp, count(*) FILTER (v AND NOT e AND a) AS fp, count(*) FILTER (v AND NOT e AND NOT a) AS tn,
 count(*) FILTER (v AND e AND NOT a) AS fn, count(*) FILTER (ea) AS x, count(*) FILTER (v AND aa) AS y, count(*) FILTER (v AND aa AND ea) AS good, count(*) FILTER (v AND aa AND NOT ea) AS odd FROM c GROUP BY GROUPING SETS ((p, m), (p, m, r))),
 w AS (SELECT p, m, max(length(r)) AS w FROM c GROUP BY 1, 2), g AS (SELECT * FROM n JOIN w USING (p, m) WHERE whole = 1)"""


def _share(part: str, whole: str) -> str:
    return f"lpad(CASE WHEN {whole} > 0 THEN ((2000 * {part} + {whole}) // (2 * ({whole})) // 10) || '.' || ((2000 * {part} + {whole}) // (2 * ({whole})) % 10) || '%' ELSE '—' END, 6, ' ')"


def _width(value: str, least: int) -> str:
    return f"lpad({value}::VARCHAR, greatest(length({value}::VARCHAR), {least})::INT, ' ')"


QUERIES = {
    k04_eval_report: f"""WITH {_CASES} SELECT p AS provider, m AS model, 1 AS part, '00' AS place, p || '/' || m || ' · ' || runs || CASE WHEN runs = 1 THEN ' run' ELSE ' runs' END AS line FROM g
 UNION ALL SELECT p, m, 1, '01', 'Cases: ' || n || ' · passed ' || (n - f) || ' · failed ' || f FROM g UNION ALL SELECT p, m, 1, '02', 'Detection: ' || (n - i) || ' scored · ' || i || ' invalid' FROM g
 UNION ALL SELECT p, m, 1, '03', 'Abstentions: ' || good || '/' || x || ' expected correct · ' || y || ' actual · ' || odd || ' unexpected' FROM g UNION ALL SELECT p, m, 1, '04', '' FROM g
 UNION ALL SELECT p, m, 1, '05', rpad('Rule', w::INT, ' ') || '  Cases  Err   TP   FP   TN   FN    Prec  Recall     FPR  Abstain  Unexp' FROM g
 UNION ALL SELECT p, m, 2, r, concat_ws('  ', rpad(r, w::INT, ' '), {_width('n', 5)}, {_width('i', 3)}, {_width('tp', 3)}, {_width('fp', 3)}, {_width('tn', 3)}, {_width('fn', 3)}, {_share('tp', '(tp + fp)')}, {_share('tp', '(tp + fn)')}, {_share('fp', '(fp + tn)')}, {_width("(good || '/' || x)", 7)}, {_width('odd', 5)}) FROM n JOIN w USING (p, m) WHERE whole = 0
 UNION ALL SELECT p, m, 3, '00', '' FROM g UNION ALL SELECT p, m, 3, '01', 'Rates describe this fixture corpus; Cases shows the sample support.' FROM g
 UNION ALL SELECT p, m, 4, '00', '' FROM g WHERE f > 0 UNION ALL SELECT p, m, 4, '01', 'Failures:' FROM g WHERE f > 0
 UNION ALL SELECT p, m, 5, lpad(rep::VARCHAR, 10, '0') || ':' || id, '  run ' || rep || ': ' || id || ' (' || r || ')' FROM c WHERE NOT v OR e <> a""",
    a08_outcomes: """WITH x AS (SELECT o_orderpriority AS p, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderstatus = 'F' OR o_orderkey % 3 = 1 AND o_orderstatus = 'O') AS l, count(*) FILTER (o_orderkey % 5 <> 0 AND (o_totalprice > 150000) = (o_custkey % 2 = 0)) AS d,
 count(*) FILTER ((o_orderkey % 4 = 0) = (o_orderkey % 6 = 0)) AS a, count(*) FILTER (o_orderkey % 9 = 0) AS s, count(*) FILTER (o_orderkey % 6 = 0) AS aa, count(*) FILTER (o_orderkey % 4 = 0) AS ea FROM orders GROUP BY 1)
 SELECT p AS o_orderpriority, n AS cases, l AS label_matches, l / n AS label_rate, d AS diagnostic_matches, d / n AS diagnostic_rate, a AS abstention_matches, a / n AS abstention_rate, s AS strict_matches, s / n AS strict_rate, aa AS abstained, ea AS abstentions_expected FROM x""",
    a18_cycle_comparison: """WITH s AS (SELECT o_custkey % 4 AS s, avg(o_orderkey % 100) AS mean, count(*) AS n, sum(o_custkey)::BIGINT AS i, sum(length(o_orderpriority))::BIGINT AS o, min(o_orderstatus) AS fp FROM orders GROUP BY 1)
 SELECT max(mean) FILTER (s = 1) / max(mean) FILTER (s = 0) AS cold_overhead, max(mean) FILTER (s = 0) / max(mean) FILTER (s = 2) AS warm_speedup, max(n) FILTER (s = 0) - max(n) FILTER (s = 2) AS calls_avoided,
 max(i) FILTER (s = 0) - max(i) FILTER (s = 2) AS input_tokens_avoided, max(o) FILTER (s = 0) - max(o) FILTER (s = 2) AS output_tokens_avoided, min(fp) = max(fp) AS diagnostics_match FROM s""",
}
