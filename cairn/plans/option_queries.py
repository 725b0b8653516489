"""Pagination by options, kinds of calls with patterns of one's own, and failures kept to their file and rule, with SQL."""

from pyspark.sql import functions as F

from cairn.operators import runs, syntax
from cairn.plans import fact_rules
from cairn.plans.syntax_queries import _call, _json, _member, _named, _quoted
from cairn.plans.tables import table as _t


def f08_pagination_options(spark, sf_dir):
    # A fifth of the orders' calls each has an object that pages, one that does not, SQL, SQL for another call, and no argument.
    o = _t(spark, sf_dir, "orders")
    kind, status = F.col("o_custkey") % 5, F.col("o_orderstatus")
    key = lambda name: {"type": "Property", "key": _named(name), "value": {"type": "Literal", "value": 1}}
    option = F.when(status == "F", _quoted("orderBy")).when(status == "O", _quoted("ORDER_BY")).otherwise(_quoted("where"))
    sql = {"type": "Literal", "value": F.concat(F.lit('"SELECT 1 FROM t '), F.when(status == "F", "ORDER  BY a LIMIT 3").when(status == "O", "-- limit").otherwise("WHERE a = 'order by' OFFSET 2"), F.lit('"'))}
    shapes = [
        _call(_member(_named("db"), "find"), sql, {"type": "ObjectExpression", "properties": [key("a")]}, {"type": "ObjectExpression", "properties": [key("Take"), key(option)]}),
        _call(_member(_named("db"), "find"), {"type": "ObjectExpression", "properties": [key(option), key("limits")]}),
        _call(_member(_named("db"), "Query"), sql),
        _call(_member(_named("db"), "queryAll"), sql),
        _call(_named("query")),
    ]
    json = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        json = F.when(kind == i, _json(shape)).otherwise(json)
    x = o.select("o_orderkey", json.alias("json"), F.lit("").alias("source"), F.lit("").alias("parent"))
    x = syntax.calls(x, "json", "source", "parent")
    return x.select("o_orderkey", syntax.pagination(F.col("callee"), F.col("arguments")).alias("p")).select("o_orderkey", "p.paginated", "p.ordered")


CALLEES = ["console.log", "audit.note", "audit.alarm", "console.debug", "span.addEvent", "meter.tick", "sink.send", "sink.crash", "span.setAttribute", "other.call", "audit.error"]
CUSTOM = {"logging": [r"^audit\.note\z", r"^audit\.error\z"], "error_logging": [r"\.alarm\z"], "telemetry": [r"^sink\.send\z"], "exception_telemetry": [r"^sink\.crash\z"], "telemetry_name": [r"^meter\."]}


def f12_call_kinds(spark, sf_dir):
    callee = F.element_at(F.array(*[F.lit(c) for c in CALLEES]), (F.col("l_suppkey") % len(CALLEES) + 1).cast("int"))
    x = _t(spark, sf_dir, "lineitem").select(callee.alias("callee"), "l_returnflag")
    x = x.withColumns({"plain": fact_rules.call_kind(F.col("callee")), "kind": fact_rules.call_kind(F.col("callee"), **CUSTOM)})
    return x.groupBy("callee", "l_returnflag", "plain", "kind").agg(F.count(F.lit(1)).alias("n"))


def d09_isolated(spark, sf_dir):
    # Orders are files, return flags rules; lines of every 50th supplier fail.
    l = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("rule"), F.col("l_linenumber").alias("place"), "l_suppkey", "l_partkey")
    failed = l.filter("l_suppkey % 50 = 0").withColumn("error", F.concat(F.lit("supplier "), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")))
    x = runs.isolated(l, failed)
    none = F.lit(None)
    kept = x.candidates.select("file", "rule", "place", "l_suppkey", "l_partkey", none.cast("string").alias("error"), none.cast("long").alias("failures"))
    return kept.unionByName(x.errors.withColumns({"place": none.cast("int"), "l_suppkey": none.cast("long"), "l_partkey": none.cast("long")}))


QUERIES = {
    f08_pagination_options: """SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN true WHEN 2 THEN o_orderstatus <> 'O' END AS paginated, CASE o_custkey % 5 WHEN 0 THEN o_orderstatus IN ('F', 'O') WHEN 2 THEN o_orderstatus = 'F' END AS ordered FROM orders""",
    f12_call_kinds: """WITH k AS (SELECT * FROM (VALUES (0, 'console.log', 'log', 'log'), (1, 'audit.note', NULL, 'log'), (2, 'audit.alarm', NULL, 'error_log'), (3, 'console.debug', 'diagnostic_log', 'diagnostic_log'), (4, 'span.addEvent', 'telemetry_name', 'telemetry_name'),
 (5, 'meter.tick', NULL, 'telemetry_name'), (6, 'sink.send', NULL, 'telemetry'), (7, 'sink.crash', NULL, 'exception_telemetry'), (8, 'span.setAttribute', 'telemetry', 'telemetry'), (9, 'other.call', NULL, NULL), (10, 'audit.error', NULL, 'error_log')) AS v(i, callee, plain, kind))
 SELECT callee, l_returnflag, plain, kind, count(*) AS n FROM lineitem JOIN k ON i = l_suppkey % 11 GROUP BY ALL""",
    d09_isolated: """WITH e AS (SELECT l_orderkey AS file, l_returnflag AS rule, min((l_linenumber, 'supplier ' || lpad(l_suppkey::VARCHAR, 9, '0')))[2] AS error, count(*) AS failures FROM lineitem WHERE l_suppkey % 50 = 0 GROUP BY 1, 2)
 SELECT l_orderkey AS file, l_returnflag AS rule, l_linenumber AS place, l_suppkey, l_partkey, NULL AS error, NULL AS failures FROM lineitem WHERE (l_orderkey, l_returnflag) NOT IN (SELECT (file, rule) FROM e)
 UNION ALL SELECT file, rule, NULL, NULL, NULL, error, failures FROM e""",
}
