"""Named queries over the reference operators, with the SQL that must give the same rows."""

from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import evidence, joins, metrics
from cairn.plans import cache_queries, decision_queries, fact_queries, nesting_queries, option_queries, range_queries, report_queries, route_queries, rule_queries, run_queries, selection_queries, syntax_queries, whole_queries


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cases(spark, sf_dir):
    d, l = _t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels")
    return l.join(d, "doc_id").select("lang", (F.col("quality") == 1).alias("expected"), (F.col("toxic") == 0).alias("actual"), F.lit(True).alias("valid"))


def a03_detection(spark, sf_dir):
    return metrics.detection_metrics(_cases(spark, sf_dir))


def a04_detection_by_rule(spark, sf_dir):
    return metrics.detection_metrics(_cases(spark, sf_dir), "lang")


def a05_abstention(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    x = o.select("o_orderpriority", (F.col("o_totalprice") > 150000).alias("expected"), (F.col("o_orderstatus") == "O").alias("actual"), (F.col("o_custkey") % 7 != 0).alias("valid"))
    return metrics.abstention_metrics(x, "o_orderpriority")


def a10_summary(spark, sf_dir):
    x = _t(spark, sf_dir, "events").groupBy("event_type").agg(*metrics.summary("value"))
    return x.withColumn("mean", F.round("mean", 6))


def j25_found_in_any(spark, sf_dir):
    cases = _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("expected"))
    findings = _t(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return metrics.found_in_any(cases, findings, "c_custkey")


def j26_agreed_in_all(spark, sf_dir):
    cases = _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("expected"))
    o = _t(spark, sf_dir, "orders")
    runs = o.select(F.col("o_custkey").alias("c_custkey"), (F.col("o_totalprice") > 50000).alias("found"), (F.col("o_orderstatus") == "P").alias("failed"))
    return metrics.agreed_in_all(cases, runs, "c_custkey")


def a06_percentile(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(metrics.nearest_rank("value", 0.5).alias("p50"), metrics.nearest_rank("value", 0.95).alias("p95"))


def a08_agreement(spark, sf_dir):
    return _cases(spark, sf_dir).groupBy("lang").agg(*metrics.agreement(F.col("expected"), F.col("actual")))


def a01_group_by_state(spark, sf_dir):
    return evidence.batches(_t(spark, sf_dir, "documents").select(F.col("text").alias("state"), F.col("doc_id").alias("ord")))


def w01_question_index(spark, sf_dir):
    x = evidence.question_index(_t(spark, sf_dir, "documents").select(F.col("text").alias("state"), F.col("doc_id").alias("ord")))
    return x.select(F.col("ord").alias("doc_id"), "question")


def w02_bounded_prefix(spark, sf_dir):
    return evidence.bounded_prefix(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", 300).select("conv_id", "turn")


def j08_region_as_of(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    left = e.filter("event_type <> 'click'").select("user_id", "event_id", "ts")
    right = e.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("click_id"))
    return joins.as_of(left, right, "user_id", "ts", "click_id").select("event_id", "click_id")


def j13_unique_name(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_name", "p_partkey")
    return joins.unique_name_join(p.select("p_name").distinct(), p, "p_name")


def x01_bounded_evidence(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.bounded_evidence(F.col("text"), 61).alias("evidence"))


def x09_sanitize_id(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.sanitize_id(F.concat_ws("/", "p_brand", "p_type")).alias("id"))


def a24_bounded_unique(spark, sf_dir):
    x = F.split("text", " ")
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(evidence.bounded_unique(x, 5), "|").alias("words"))


def a02_run_counters(spark, sf_dir):
    x = _t(spark, sf_dir, "events")
    return x.agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("user_id").alias("files"), F.count_if(F.col("event_type") == "click").alias("cache_hits"))


_DETECTION = """SELECT {by} tp, fp, tn, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
 CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS fpr, CASE WHEN fp + tn > 0 THEN tn / (fp + tn) END AS specificity, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1
 FROM (SELECT {by} count(*) FILTER (e AND a) AS tp, count(*) FILTER (NOT e AND a) AS fp, count(*) FILTER (NOT e AND NOT a) AS tn, count(*) FILTER (e AND NOT a) AS fn
 FROM (SELECT lang, quality = 1 AS e, toxic = 0 AS a FROM labels JOIN documents USING (doc_id)) {group})"""

ORACLES = {
    "a03_detection": _DETECTION.format(by="", group=""),
    "a04_detection_by_rule": _DETECTION.format(by="lang,", group="GROUP BY lang"),
    "a06_percentile": "SELECT event_type, coalesce(quantile_disc(value, 0.5), 0) AS p50, coalesce(quantile_disc(value, 0.95), 0) AS p95 FROM events GROUP BY event_type",
    "a08_agreement": "SELECT lang, count(*) FILTER (e = a) AS correct, count(*) FILTER (e <> a) AS incorrect, count(*) FILTER (e = a) / count(*) AS rate FROM (SELECT lang, quality = 1 AS e, toxic = 0 AS a FROM labels JOIN documents USING (doc_id)) GROUP BY lang",
    "a01_group_by_state": "SELECT sha256(text) AS state_hash, count(*) AS candidates, min(doc_id) AS first_ord FROM documents GROUP BY text",
    "w01_question_index": "SELECT doc_id, CAST(row_number() OVER (PARTITION BY text ORDER BY doc_id) - 1 AS INT) AS question FROM documents",
    "w02_bounded_prefix": "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS s FROM conversations) WHERE s <= 300",
    "j08_region_as_of": "SELECT l.event_id, (SELECT max_by(r.event_id, (r.ts, r.event_id)) FROM events r WHERE r.event_type = 'click' AND r.user_id = l.user_id AND r.ts <= l.ts) AS click_id FROM events l WHERE l.event_type <> 'click'",
    "j13_unique_name": "SELECT p_name, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS p_partkey FROM part GROUP BY p_name",
    "x01_bounded_evidence": "SELECT doc_id, CASE WHEN length(text) <= 61 THEN text ELSE left(text, 28) || ' ... ' || right(text, 28) END AS evidence FROM documents",
    "x09_sanitize_id": "SELECT p_partkey, regexp_replace(p_brand || '/' || p_type, '[^A-Za-z0-9_-]', '_', 'g') AS id FROM part",
    "a05_abstention": """SELECT o_orderpriority, count(*) FILTER (o_totalprice > 150000) AS expected, count(*) FILTER (o_custkey % 7 <> 0 AND o_orderstatus = 'O') AS actual,
 count(*) FILTER (o_custkey % 7 <> 0 AND o_orderstatus = 'O' AND o_totalprice > 150000) AS correct,
 count(*) FILTER (o_custkey % 7 <> 0 AND o_orderstatus = 'O' AND NOT o_totalprice > 150000) AS unexpected FROM orders GROUP BY 1""",
    "a10_summary": "SELECT event_type, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1",
    "j25_found_in_any": """SELECT c_custkey, c_acctbal > 0 AS expected, count(o_orderkey) AS findings,
 CASE WHEN c_acctbal > 0 THEN CASE WHEN count(o_orderkey) > 0 THEN 'hit' ELSE 'miss' END WHEN count(o_orderkey) > 0 THEN 'false_positive' ELSE 'correct_rejection' END AS status
 FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey, c_acctbal""",
    "j26_agreed_in_all": """SELECT c_custkey, c_acctbal > 0 AS expected,
 CASE WHEN count(o_orderkey) = 0 OR bool_or(o_orderstatus = 'P') THEN 'error' WHEN bool_and((o_totalprice > 50000) = (c_acctbal > 0)) THEN 'matched' ELSE 'miss' END AS status
 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal""",
    "a02_run_counters": "SELECT count(*) AS requests, count(DISTINCT user_id) AS files, count(*) FILTER (event_type = 'click') AS cache_hits FROM events",
    "a24_bounded_unique": "SELECT doc_id, (SELECT string_agg(w, '|' ORDER BY p) FROM (SELECT w, min(p) AS p FROM (SELECT unnest(ws) AS w, unnest(range(len(ws))) AS p) GROUP BY w ORDER BY p LIMIT 5)) AS words FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)",
}


def flagship(spark, sf_dir):
    """Detection metrics by rule, sorted."""
    return a04_detection_by_rule(spark, sf_dir).orderBy("lang")


FAMILIES = [range_queries, decision_queries, whole_queries, fact_queries, selection_queries, nesting_queries, run_queries, rule_queries, route_queries, syntax_queries, cache_queries, report_queries, option_queries]


def queries() -> dict:
    return {name: globals()[name] for name in ORACLES} | {q.__name__: q for f in FAMILIES for q in f.QUERIES}


def oracle_sql() -> dict:
    return ORACLES | {q.__name__: sql for f in FAMILIES for q, sql in f.QUERIES.items()}
