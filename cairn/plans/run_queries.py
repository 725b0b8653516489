"""Recorded answers replayed, task manifests and exact percentiles over the tables, with their SQL."""

import json

from pyspark.sql import functions as F

from cairn.operators import decisions, merkle, metrics, ordinals, runs
from cairn.plans.tables import table as _t


def _replay(spark, sf_dir):
    # Orders are a customer's candidates, by date; the lines of a customer's orders that were returned are the recorded answers.
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    candidates = o.select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("string").alias("ord"), F.col("o_orderkey").alias("candidate"))
    l = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    answers = l.select(F.col("o_custkey").alias("id"), F.col("l_shipdate").cast("string").alias("ord"), F.concat_ws(":", "l_linestatus", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("answer"))
    return ordinals.replayed(candidates, answers, "id", "ord")


def d12_replayed(spark, sf_dir):
    return _replay(spark, sf_dir).withColumnRenamed("id", "c_custkey")


def d13_case_results(spark, sf_dir):
    cases = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("expected_finding"), (F.col("c_custkey") % 20).alias("expected_candidates"), F.lit("F").alias("finding_choice"))
    x = _replay(spark, sf_dir).withColumn("answer", F.substring("answer", 1, 1))
    return ordinals.case_results(cases, x, "id").drop("finding_choice", "expected_finding")


def d14_manifest_changes(spark, sf_dir):
    # Tasks are the lines' prices by order; in the pinned version some are gone, some new, some of another price.
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("string").alias("price"), "o_orderstatus")
    pinned = o.filter("o_orderkey % 997 <> 0").withColumn("price", F.when(F.col("o_orderkey") % 991 == 0, None).otherwise(F.col("price")))
    pinned = pinned.unionByName(o.filter("o_orderkey % 983 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    return merkle.changes(o, pinned, "o_orderkey", merkle.depth_for(o.count())).withColumnRenamed("key", "o_orderkey")


def a06_percentiles(spark, sf_dir):
    return ordinals.percentiles(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p100": 1.0})


_REPLAY = """c AS (SELECT o_custkey AS id, o_orderkey AS candidate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders),
 a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, answer) - 1 AS n FROM (SELECT o_custkey AS id, l_shipdate AS d, l_linestatus || ':' || l_orderkey || ':' || l_linenumber AS answer FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')),
 r AS (SELECT coalesce(c.id, a.id) AS id, coalesce(c.n, a.n) AS n, candidate, answer, CASE WHEN c.id IS NULL THEN 'surplus' WHEN a.id IS NULL THEN 'missing' ELSE 'answered' END AS state FROM c FULL JOIN a ON c.id = a.id AND c.n = a.n)"""

def _judge():
    """A provider that answers with the length of what it is asked, and fails for some."""

    def call(payload):
        if payload.endswith("77"):
            raise ValueError("not answered")
        return f"{len(payload)} characters"

    return call


def _requests(rows, id, state):
    x = rows.select(F.col(id).alias("id"), state.alias("payload"))
    return x.withColumn("key", decisions.cache_key(F.lit("judge"), F.col("payload"), F.lit("[]")))


def d15_cycle(spark, sf_dir):
    # Orders of one customer and priority are one request; every 500th order changes.
    o = _t(spark, sf_dir, "orders")
    state = F.concat_ws(" ", "o_orderpriority", F.col("o_custkey").cast("string"))
    changed = F.when(F.col("o_orderkey") % 500 == 0, F.concat(F.lit("now "), state)).otherwise(state)
    x = runs.cycle(_requests(o, "o_orderkey", state), _requests(o, "o_orderkey", changed), _judge)
    return x.select("scenario", "requests", "failed", "cache_hits", "entries", "bytes")


def d15_fingerprints(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    state = F.concat(F.lit("customer "), F.col("c_custkey").cast("string"), F.lit("."))
    least = c.agg(F.min("c_custkey")).first()[0]
    changed = F.when(F.col("c_custkey") == least, F.concat(state, F.lit(" changed"))).otherwise(state)
    x = runs.cycle(_requests(c, "c_custkey", state), _requests(c, "c_custkey", changed), _judge)
    n = x.filter("scenario = 'uncached'").first()["requests"]
    of = x.groupBy("fingerprint").agg(F.array_join(F.array_sort(F.collect_list("scenario")), ",").alias("scenarios"), F.sum("requests").alias("requests"))
    return of.select("scenarios", "requests").join(metrics.cache_behaves(x, n), F.lit(True))


def _sorter():
    """A provider that takes urgent orders for candidates and answers for them with their last letters; some calls fail."""

    def call(payload):
        asked = json.loads(payload)
        state = asked["state"]
        if state.endswith("3") and asked["stage"] == "collect" or state.endswith("5"):
            raise ValueError(asked["stage"])
        return ("todo" if "URGENT" in state or "HIGH" in state else "other") if asked["stage"] == "collect" else state[-4:]

    return call


def _collected(spark, sf_dir, cache=None):
    o = _t(spark, sf_dir, "orders")
    targets = o.select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", F.col("o_custkey").cast("string")).alias("state"), (F.col("o_orderstatus") == "P").alias("suppressed"))
    empty = spark.createDataFrame([], "key string, response string")
    return runs.collected(targets, empty if cache is None else cache, _sorter, "sorter", "todo")


def d07_collected(spark, sf_dir):
    x = _collected(spark, sf_dir)
    return x.judged.select("id", "response", "error").unionByName(x.problems.withColumn("response", F.lit(None).cast("string")))


def d07_calls(spark, sf_dir):
    first = _collected(spark, sf_dir)
    again = _collected(spark, sf_dir, first.cache)
    counts = ["stage", "requests", "cache_hits", "failed", "entries"]
    return first.sample.select(F.lit(1).alias("run"), *counts).unionByName(again.sample.select(F.lit(2).alias("run"), *counts))


QUERIES = {
    d12_replayed: f"WITH {_REPLAY} SELECT id AS c_custkey, n, candidate, answer, state FROM r",
    d13_case_results: f"""WITH {_REPLAY}, s AS (SELECT id, count(*) FILTER (state <> 'surplus') AS actual_candidates, coalesce(bool_or(state = 'answered' AND answer LIKE 'F:%'), false) AS actual_finding, count(*) FILTER (state <> 'answered') AS errors FROM r GROUP BY id)
 SELECT c_custkey AS id, c_custkey % 20 AS expected_candidates, coalesce(actual_candidates, 0) AS actual_candidates, coalesce(actual_finding, false) AS actual_finding, coalesce(errors, 0) AS errors,
 coalesce(errors, 0) = 0 AND coalesce(actual_candidates, 0) = c_custkey % 20 AND coalesce(actual_finding, false) = (c_acctbal > 0) AS agrees FROM customer LEFT JOIN s ON id = c_custkey""",
    d14_manifest_changes: """SELECT o_orderkey, CASE WHEN o_orderkey % 997 = 0 THEN 'added' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 997 = 0 OR o_orderkey % 991 = 0 AND o_totalprice IS NOT NULL
 UNION ALL SELECT -o_orderkey - 1, 'removed' FROM orders WHERE o_orderkey % 983 = 0""",
    a06_percentiles: "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, max(l_extendedprice) AS p100 FROM lineitem GROUP BY 1",
    d15_cycle: """WITH s AS (SELECT o_orderkey AS k, o_orderpriority || ' ' || o_custkey AS p FROM orders), a AS (SELECT DISTINCT p, p LIKE '%77' AS bad, length(length(p) || ' characters') AS n FROM s),
 b AS (SELECT DISTINCT p, p LIKE '%77' AS bad, length(length(p) || ' characters') AS n, p IN (SELECT p FROM a WHERE NOT bad) AS held FROM (SELECT CASE WHEN k % 500 = 0 THEN 'now ' || p ELSE p END AS p FROM s)),
 x AS (SELECT count(*) AS n, count(*) FILTER (bad) AS f, coalesce(sum(n) FILTER (NOT bad), 0)::BIGINT AS size FROM a)
 SELECT 'uncached' AS scenario, n AS requests, f AS failed, 0 AS cache_hits, 0 AS entries, 0 AS bytes FROM x UNION ALL SELECT 'cold', n, f, 0, n - f, size FROM x UNION ALL SELECT 'warm', f, f, n - f, n - f, size FROM x
 UNION ALL SELECT 'incremental', count(*) FILTER (NOT held), count(*) FILTER (bad), count(*) FILTER (held), any_value(x.n - f) + count(*) FILTER (NOT held AND NOT bad), (any_value(size) + coalesce(sum(b.n) FILTER (NOT held AND NOT bad), 0))::BIGINT FROM b, x""",
    d15_fingerprints: """SELECT 'incremental' AS scenarios, 1 AS requests, true AS valid UNION ALL SELECT 'cold,uncached,warm', 2 * count(DISTINCT c_custkey), true FROM customer""",
    d07_collected: """SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 <> 3 AND o_custkey % 10 <> 5 THEN right(o_orderpriority || ' ' || o_custkey, 4) END AS response, CASE WHEN o_custkey % 10 IN (3, 5) THEN 'collect' END AS error FROM orders
 WHERE o_orderstatus <> 'P' AND (o_custkey % 10 IN (3, 5) OR o_orderpriority IN ('1-URGENT', '2-HIGH'))""",
    d07_calls: """WITH s AS (SELECT DISTINCT o_custkey % 10 IN (3, 5) AS bad, o_orderpriority IN ('1-URGENT', '2-HIGH') AS todo, o_orderpriority, o_custkey FROM orders WHERE o_orderstatus <> 'P'),
 n AS (SELECT count(*) AS n, count(*) FILTER (bad) AS f, count(*) FILTER (todo AND NOT bad) AS j FROM s)
 SELECT 1 AS run, 'collect' AS stage, n AS requests, 0 AS cache_hits, f AS failed, n - f AS entries FROM n UNION ALL SELECT 1, 'judge', j, 0, 0, n - f + j FROM n
 UNION ALL SELECT 2, 'collect', f, n - f, f, n - f + j FROM n UNION ALL SELECT 2, 'judge', 0, j, 0, n - f + j FROM n""",
}
