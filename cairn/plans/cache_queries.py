"""The decision cache's data source written and read by whole tables, with SQL that says which answers are good."""

import uuid

from pyspark.sql import functions as F

from cairn.functions.recovery import kept, shared_dir
from cairn.operators import decisions
from cairn.plans.tables import table as _t
from cairn.sources import decision_cache


def _entries(spark, sf_dir):
    # One order in twelve is answered by more than certainty, another by fewer than no tokens.
    o = _t(spark, sf_dir, "orders")
    kind, order = F.col("o_orderkey") % 12, F.col("o_orderkey").cast("string")
    share = F.when(kind == 9, "1.5").otherwise(F.concat(F.lit("0."), (F.col("o_orderkey") % 10).cast("string")))
    tokens = F.when(kind == 6, "-1").otherwise(order)
    response = F.concat(F.lit('{"model": "m", "answers": {"q": {"type": "noul", "noul": '), share, F.lit('}}, "usage": {"inputTokens": '), tokens, F.lit(', "outputTokens": 1}}'))
    return o.select("o_orderkey", decisions.cache_key(F.lit("judge"), order, F.lit("[]")).alias("key"), response.alias("response"))


def _filled(spark, sf_dir):
    x = _entries(spark, sf_dir)
    path = f"{shared_dir(spark)}/decisions-{uuid.uuid4().hex}"
    counts = []
    for part in ("o_orderkey % 3 = 0", "o_orderkey % 2 = 0"):
        decision_cache.add(x.filter(part), path)
        counts.append(kept(decision_cache.cache(spark, path).agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("key").alias("keys"), F.count("problem").alias("problems"))))
    return x, decision_cache.cache(spark, path), counts


def s20_cache_scan(spark, sf_dir):
    x, cache, _ = _filled(spark, sf_dir)
    hits = decisions.cache_hits(x.drop("response"), cache, "key")
    return hits.select("o_orderkey", F.col("response").isNotNull().alias("hit"), F.get_json_object("response", "$.answers.q.noul").cast("double").alias("noul"))


def k05_cache_append(spark, sf_dir):
    first, second = _filled(spark, sf_dir)[2]
    return first.withColumn("write", F.lit(1)).unionByName(second.withColumn("write", F.lit(2)))


QUERIES = {
    s20_cache_scan: """SELECT o_orderkey, h AS hit, CASE WHEN h THEN o_orderkey % 10 / 10 END AS noul FROM (SELECT o_orderkey, (o_orderkey % 3 = 0 OR o_orderkey % 2 = 0) AND o_orderkey % 12 NOT IN (6, 9) AS h FROM orders)""",
    k05_cache_append: """WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders), n AS (SELECT count(*) FILTER (k % 3 = 0) AS a, count(*) FILTER (k % 2 = 0 AND (k % 3 <> 0 OR k % 12 = 6)) AS b, count(*) FILTER (k % 3 = 0 OR k % 2 = 0) AS keys, count(*) FILTER (k % 12 = 9) AS over, count(*) FILTER (k % 12 = 6) AS under FROM o)
 SELECT 1 AS write, a AS entries, a AS keys, over + under AS problems FROM n UNION ALL SELECT 2, a + b, keys, over + 2 * under FROM n""",
}
