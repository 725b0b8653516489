"""Personal data: strict patterns, and spans that weakly supervised labelers and a classifier trained by them add.

1. Strict patterns of four kinds give the base spans.
2. One pass of wider patterns gives candidates, with the characters around them.
3. Labelers vote on each candidate: for (1), against (-1) or not at all (0). Some are patterns, some are gazetteers (lists
   of endings, prefixes and cue words), some look at what stands around.
4. Expectation-maximisation over the counted vote patterns of a kind estimates how reliable each labeler is, and with
   that how likely each vote pattern belongs to personal data.
5. A naive Bayes classifier on the spans' own features learns from these likelihoods and decides every candidate.

SQL functions only. Votes and features have few values, so what is learnt is small whatever the input.
"""

import json

from pyspark.sql import Column, DataFrame, functions as F

from cairn.llm import store

#: Kinds in their order, and the strict patterns. A run is only entered at its start or where the last match
#: ended, and never given back (possessive), which changes no match and keeps long runs linear.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
QUAD = rf"^{PART}(?:\.{PART}){{3}}$"

#: Wider patterns, the first that fits at a place wins.
WIDE = {
    "email": r"(?:(?<![\p{L}\p{N}._%+-])|\G)[\p{L}\p{N}._%+-]++(?:@|\x20?[\[({]\x20?(?i:at|@)\x20?[\])}]\x20?)[\p{L}\p{N}-]++(?:(?:\.|\x20?[\[({]\x20?(?i:dot|\.)\x20?[\])}]\x20?)[\p{L}\p{N}-]++)++",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3}(?![0-9]|\.[0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]|(?<![0-9])00[1-9][\x20().0-9-]{7,20}[0-9](?![0-9])|\([0-9]{2,5}\)[\x20-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])|(?<![0-9.-])[0-9]{3}(?<p>[.-])[0-9]{3}\k<p>[0-9]{4}(?![0-9]|[.-][0-9])",
    "card": r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?<c>[\x20.-])[0-9]{4}\k<c>[0-9]{4}\k<c>[0-9]{2,7}|[0-9]{4}(?<d>[\x20.-])[0-9]{6}\k<d>[0-9]{4,5})(?![0-9])",
}
#: Gazetteers.
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|uk|us|eu|ch|at|it|nl|be|pl|pt|mx|ar|ca|au|jp|in|br"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-8]|6)"
CALLING = r"^(?:\+|00)(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = {
    "email": "e-?mail|mail|mailto|contact|write to|courriel|correo|kontakt",
    "ip": "ip|host|server|address|adresse|dirección|login from|from",
    "card": "card|visa|mastercard|amex|karte|carte|tarjeta|iban|account",
    "phone": "tel|phone|call|fax|mobile|téléphone|telefon|teléfono|handy",
}
AGAINST = "version|ver|v|isbn|issn|id|sha|hash|token|key|order|invoice|page|art|doi|section|build|release"


def _bound(value: str, name: str, body: str) -> str:
    """SQL: body with a name for a value, which is worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _located(x: DataFrame, name: str, pattern: str, guard: Column, around: int = 24, block: int = 256) -> DataFrame:
    """x with `name`: an array of (start, end, value, before, behind) for each match of the pattern in _text.

    A match begins behind all pieces of text and matches before it. Their lengths are added up over blocks, so a text of
    n matches takes n times (block + n / block) steps. before and behind are up to `around` characters beside it.
    """
    m, p = "_matches", "_pieces"
    some = F.size(m) > 0
    x = x.withColumn(m, F.when(guard, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    x = x.withColumn(p, F.when(some, F.split("_text", pattern, -1)))
    # Arrays are bound to names: a column that one lambda uses would be worked out again for each element.
    total = "0L, (a, v) -> a + v"
    inside = f"zip_with(blocks, transform(sums, (s, k) -> aggregate(slice(sums, 1, k), {total})), (b, o) -> transform(b, (v, i) -> o + aggregate(slice(b, 1, i), {total})))"
    starts = _bound(f"transform(blocks, b -> aggregate(b, {total}))", "sums", f"flatten({inside})")
    starts = _bound(f"transform(sequence(0, (size(lengths) - 1) div {block}), k -> slice(lengths, cast(k * {block} + 1 as int), {block}))", "blocks", starts)
    starts = _bound(f"transform({m}, (m, i) -> cast(length(get({p}, i)) + length(m) as bigint))", "lengths", starts)
    x = x.withColumn("_starts", F.when(some, F.expr(starts)))
    start = f"get(_starts, i) + length(get({p}, i))"
    found = F.expr(f"transform({m}, (m, i) -> struct({start} as start, {start} + length(m) as end, m as value, right(get({p}, i), {around}) as before, left(get({p}, i + 1), {around}) as behind))")
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string,behind:string>>")
    return x.withColumn(name, F.when(some, found).otherwise(none)).drop(m, p, "_starts")


def _luhn(digits: str) -> str:
    """SQL: whether the sum of digits, every second from the right doubled and its digits added, is a multiple of ten."""
    at = f"cast(substr(reverse({digits}), i, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + if(i % 2 = 1, {at}, if({at} > 4, {at} * 2 - 9, {at} * 2))) % 10 = 0"


_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_HOLDS = {
    "email": "true",
    "ip": f"s.value rlike {_quoted(QUAD)}",
    "card": f"length({_DIGITS}) between 14 and 19 and ({_luhn(_DIGITS)})",
    "phone": f"length({_DIGITS}) between 10 and 15",
}


def base_spans(docs: DataFrame, keep: tuple = ()) -> DataFrame:
    """keep, _text, and for each kind an array of (start, end, value, before, behind) of its base spans, in code points, end exclusive.

    Leftmost matches of a kind that don't overlap; those that fail the kind's test are dropped. Null texts count as empty.
    """
    x = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    guards = {"email": F.col("_text").contains("@"), "ip": F.col("_text").contains("."), "card": F.lit(True), "phone": F.col("_text").contains("+")}
    for kind in KINDS:
        x = _located(x, kind, BASE[kind], guards[kind])
        x = x.withColumn(kind, F.expr(f"filter({kind}, s -> {_HOLDS[kind]})"))
    return x


def _written(keys: str) -> str:
    """SQL: kind:start:end of sorted keys, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({keys}, k -> concat_ws(':', get(array({names}), cast(substr(k, 13, 1) as int)), cast(cast(substr(k, 1, 12) as bigint) as string), cast(cast(substr(k, 14) as bigint) as string))), ',')"


def _kind_of(value: str) -> str:
    """SQL: the number of the kind whose wide pattern took the value."""
    return rf"case when {value} rlike '@|\\[ ?(?i:at) ?\\]|\\( ?(?i:at) ?\\)|\\{{ ?(?i:at) ?\\}}' then 0 when {value} rlike '^[0-9]+([.][0-9]+){{3}}$|:' then 1 when {value} rlike '^([+]|00[1-9][0-9 ().-]*[^0-9]|\\()|^[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}$' then 3 else 2 end"


def _votes() -> str:
    """SQL: six labelers' votes on a candidate c(kind, value, digits, before, behind)."""

    def by_kind(*cases: str) -> str:
        return "case c.kind " + " ".join(f"when {i} then {v}" for i, v in enumerate(cases)) + " end"

    strict = by_kind(
        rf"if(c.value rlike {_quoted('^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)++$')}, 1, 0)",
        rf"if(c.value rlike {_quoted('^[0-9]{1,3}([.][0-9]{1,3}){3}$')}, 1, 0)",
        rf"if(c.value rlike {_quoted('^[0-9]{15,16}$|^[0-9]{4}([ -])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}$')}, 1, 0)",
        rf"if(c.value rlike {_quoted('^[+][0-9]{1,3}[ -]?[(]?[0-9]')}, 1, 0)",
    )
    test = by_kind(
        rf"if(c.value rlike {_quoted('(^|[.])[.@]|@-|-[.]|-$|[.][0-9]+$')}, -1, 1)",
        rf"if(c.value rlike {_quoted(QUAD)} or c.value like '%:%', 1, -1)",
        f"if({_luhn('c.digits')}, 1, -1)",
        "if(length(c.digits) between 10 and 15, 1, if(length(c.digits) < 7, -1, 0))",
    )
    listed = by_kind(
        rf"if(c.value rlike {_quoted(f'(?i)[.\x20)](?:{ENDINGS})$')}, 1, 0)",
        rf"if(c.value rlike {_quoted('^(?:0|127|255|22[4-9]|23[0-9])[.]|[.]0[.]0[.]')}, -1, 0)",
        rf"if(c.digits rlike {_quoted(ISSUERS)}, 1, 0)",
        rf"if(c.value rlike {_quoted(CALLING)}, 1, 0)",
    )
    cue = "case when c.before rlike {against} then -1 when c.before rlike {cues} then 1 else 0 end"
    near = lambda words: _quoted(rf"(?iu)(?:^|[^\p{{L}}])(?:{words})[^\p{{L}}\p{{N}}]{{0,4}}$")
    cues = by_kind(*[cue.format(against=near(AGAINST), cues=near(CUES[k])) for k in KINDS])
    edges = rf"case when c.before rlike {_quoted(r'[\p{L}\p{N}_=/]$')} or c.behind rlike {_quoted(r'^[\p{L}\p{N}_=/]')} then -1 when (c.before = '' or c.before rlike {_quoted(r'[\s(\[<:;,|]$')}) and (c.behind = '' or c.behind rlike {_quoted(r'^[\s)\]>:;,.!?|]')}) then 1 else 0 end"
    table = rf"if(c.before rlike {_quoted(r'[0-9][\s,;|]{1,3}$')} and c.behind rlike {_quoted(r'^[\s,;|]{1,3}[0-9]')} and c.kind <> 2, -1, 0)"
    return f"array({', '.join([strict, test, listed, cues, edges, table])})"


#: What is assumed of the six labelers before counting: the shares of votes -1, 0 and 1 among personal data, the reverse
#: among the rest. The second labeler tests checksums, ranges and forms; what fails its test is no personal data.
TEST = 1
GUESS = ((0.2, 0.3, 0.5), (0.01, 0.09, 0.9), (0.2, 0.4, 0.4), (0.1, 0.5, 0.4), (0.2, 0.3, 0.5), (0.3, 0.4, 0.3))
#: A candidate's features and how many values each may have.
FEATURES = {"shape": 256, "digits": 24, "before": 5, "behind": 5, "test": 3, "strict": 3}


def _features() -> str:
    """SQL: a candidate's features as small numbers; votes 0 and 1 (strict form and test) are features, cues are not."""
    shape = r"pmod(xxhash64(left(regexp_replace(regexp_replace(c.value, '[0-9]+', '9'), '\\p{L}+', 'a'), 16)), 256)"
    side = lambda text, pattern: rf"case when {text} = '' then 0 when {text} rlike {_quoted(pattern.format(r'\s'))} then 1 when {text} rlike {_quoted(pattern.format(r'\p{L}'))} then 2 when {text} rlike {_quoted(pattern.format('[0-9]'))} then 3 else 4 end"
    return f"transform(array({shape}, least(length(c.digits), 23), {side('c.before', '{}$')}, {side('c.behind', '^{}')}, c.votes[1] + 1, c.votes[0] + 1), v -> cast(v as int))"


def candidates(x: DataFrame) -> DataFrame:
    """x(_text, ...) with `wide`: an array of (kind, start, end, votes, features) of the wider patterns' matches."""
    x = _located(x, "wide", "|".join(WIDE.values()), F.col("_text").rlike(r"@|[0-9]{2}|[\[({]\x20?(?i:at)\x20?[\])}]"), 24)
    x = x.withColumn("wide", F.expr(f"transform(wide, s -> struct({_kind_of('s.value')} as kind, s.start, s.end, s.value, {_DIGITS} as digits, s.before, s.behind))"))
    x = x.withColumn("wide", F.expr(f"transform(wide, c -> struct(c.kind, c.start, c.end, c.value, c.digits, c.before, c.behind, {_votes()} as votes))"))
    return x.withColumn("wide", F.expr(f"transform(wide, c -> struct(c.kind, c.start, c.end, c.votes, {_features()} as features))"))


def reliabilities(patterns: DataFrame, guesses: tuple = GUESS, rounds: int = 30, strength: float = 20.0) -> DataFrame:
    """(kind, votes, likely) of patterns(kind, votes, n): expectation-maximisation over counted vote patterns, by kind.

    Each labeler has a share of votes -1, 0, 1 among personal data and among the rest. They start, and are held by
    `strength` pseudo-candidates, at the guesses, which also say which of the two classes is which. A vote of -1 by the
    labeler TEST is taken as known. A kind has 3 ** labelers patterns at most, so its rounds run over one sorted array.
    """
    labelers = len(guesses)
    guess = ", ".join(f"{v}D" for g in guesses for v in g)
    other = ", ".join(f"{v}D" for g in guesses for v in reversed(g))
    side = lambda share, params: f"ln({share}) + aggregate(sequence(0, {labelers - 1}), 0D, (a, l) -> a + ln(element_at({params}, l * 3 + element_at(p.votes, l + 1) + 2)))"
    likely = f"if(element_at(p.votes, {TEST + 1}) = -1, 0D, 1D / (1D + exp(({side('1D - s.share', 's.no')}) - ({side('s.share', 's.yes')}))))"
    q = f"transform(pats, p -> struct(p.votes as votes, cast(p.n as double) as n, {likely} as q))"
    total = lambda weight: f"aggregate(e, 0D, (a, p) -> a + p.n * {weight})"
    share = lambda weight, start: f"transform(sequence(0, {3 * labelers - 1}), c -> (aggregate(e, 0D, (a, p) -> a + if(element_at(p.votes, cast(c div 3 as int) + 1) = c % 3 - 1, p.n * {weight}, 0D)) + {strength}D * element_at(array({start}), c + 1)) / ({total(weight)} + {strength}D))"
    step = f"transform(array({q}), e -> struct(({total('p.q')} + {strength / 2}D) / ({total('1D')} + {strength}D) as share, {share('p.q', guess)} as yes, {share('(1D - p.q)', other)} as no))[0]"
    start = f"struct(0.5D as share, array({guess}) as yes, array({other}) as no)"
    x = patterns.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("pats"))
    x = x.withColumn("s", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, r) -> {step})"))
    x = x.select("kind", F.explode(F.expr(f"transform(pats, p -> struct(p.votes as votes, p.n as n, {likely} as likely))")).alias("p"))
    return x.select("kind", "p.votes", "p.n", "p.likely")


def train(counted: DataFrame) -> dict:
    """Naive Bayes weights from counted(kind, votes, features, n): {"kind/feature": {value: weight}, "kind/": {"": prior}}.

    Candidates count with the likelihood of their vote pattern for personal data, with the rest against it. Each class
    also has one pseudo-candidate that spreads over a feature's values as all candidates of the kind do, so that values
    which tell nothing apart weigh nothing in a small class.
    """
    patterns = counted.groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    likely = reliabilities(patterns).select(F.col("kind").alias("_k"), F.col("votes").alias("_v"), "likely")
    x = counted.join(likely, (F.col("kind") == F.col("_k")) & (F.col("votes") == F.col("_v")))
    x = x.select("kind", F.posexplode("features").alias("feature", "value"), (F.col("n") * F.col("likely")).alias("yes"), (F.col("n") * (1 - F.col("likely"))).alias("no"))
    # At most 4 kinds with the values of FEATURES; sums are rounded so that their order doesn't show.
    sums = x.groupBy("kind", "feature", "value").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    whole = sums.groupBy(F.col("kind").alias("_k"), F.col("feature").alias("_f")).agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    both = sums.join(whole, (F.col("kind") == F.col("_k")) & (F.col("feature") == F.col("_f")))
    spread = (F.col("yes") + F.col("no")) / (F.col("all_yes") + F.col("all_no"))
    weight = F.log((F.col("yes") + spread) / (F.col("all_yes") + 1)) - F.log((F.col("no") + spread) / (F.col("all_no") + 1))
    model = {}
    for r in both.select("kind", "feature", "value", F.round(weight, 9).alias("weight"), F.round(F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1)), 9).alias("prior")).collect():
        model.setdefault(f"{r.kind}/{r.feature}", {})[str(r.value)] = r.weight
        if r.feature == 0:
            model[f"{r.kind}/"] = {"": r.prior}
    return model


def decided(x: DataFrame, model: dict) -> DataFrame:
    """x with `found`: those of its candidates that the classifier takes for personal data, with their score."""
    weights = F.from_json(F.lit(json.dumps(model)), "map<string,map<string,double>>")
    x = x.withColumn("_model", weights)
    score = "aggregate(c.features, struct(coalesce(_model[concat(c.kind, '/')][''], 0D) as s, 0 as i), (a, v) -> struct(a.s + coalesce(_model[concat(c.kind, '/', a.i)][cast(v as string)], 0D) as s, a.i + 1 as i), a -> a.s)"
    return x.withColumn("found", F.expr(f"filter(transform(wide, c -> struct(c.kind as kind, c.start as start, c.end as end, {score} as score)), c -> c.score > 0)")).drop("_model")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found) of every row of docs(doc_id, text): arrays of (kind, start, end), and for found also (score).

    Texts are read once; base spans and candidates are written, then labelers and classifier are trained on all of
    them and decide each. Null texts count as empty; equal rows get equal spans; null doc_ids stay; other columns are
    ignored; tables without candidates have no model and no spans.
    """
    x = candidates(base_spans(docs, ("doc_id",)))
    base = F.concat(*[F.expr(f"transform({k}, s -> struct({i} as kind, s.start as start, s.end as end))") for i, k in enumerate(KINDS)])
    x = store.written(x.select("doc_id", base.alias("base"), "wide"), "spans")
    counted = x.select(F.explode("wide").alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count(F.lit(1)).alias("n"))
    return decided(x, train(store.written(counted, "span-kinds"))).drop("wide")


def pii_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, and all spans written out."""
    x = personal_data(docs)
    keys = lambda spans: f"transform({spans}, s -> concat(lpad(cast(s.start as string), 12, '0'), cast(s.kind as string), lpad(cast(s.end as string), 12, '0')))"
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = {i})")).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    x = x.select("doc_id", *counts, F.expr(f"sort_array({keys('base')})").alias("b"), F.expr(f"sort_array(array_distinct(concat({keys('base')}, {keys('found')})))").alias("a"))
    return x.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.expr(_written("b")), 256).alias("base_sha256"), F.expr(_written("a")).alias("spans"))
