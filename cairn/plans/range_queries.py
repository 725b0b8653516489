"""Containment, directives, closures and set operations over the tables, with their SQL."""

from pyspark.sql import functions as F

from cairn.operators import evidence, facts, graphs, joins
from cairn.plans.tables import table as _t


def j04_same_range(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.floor("l_quantity").alias("start"), F.floor(F.col("l_quantity") + F.col("l_linenumber")).alias("end"), "l_orderkey", "l_linenumber")
    right = l.filter("l_linenumber = 1").select("k", "start", "end", F.col("l_orderkey").alias("ord"), F.col("l_orderkey").alias("first_order"))
    return joins.same_range(l.select("l_orderkey", "l_linenumber", "k", "start", "end"), right, "k", "first_order").select("l_orderkey", "l_linenumber", "first_order")


def j11_with_at_least(spark, sf_dir):
    return joins.with_at_least(_t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey"), "l_orderkey", 2)


def j14_not_represented(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return joins.not_represented(l, l.filter("l_orderkey % 3 = 0 OR l_linenumber > 2"), ["l_orderkey", "l_linenumber"])


def j16_resolved(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") * 5 % 613).alias("dst"))
    names = _t(spark, sf_dir, "customer").select("c_custkey")
    return graphs.resolved(names, graphs.functional(o), "c_custkey").select("c_custkey", "root")


def j27_prefix_found(spark, sf_dir):
    cases = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.array(F.lit("1-URGENT"), F.when(F.col("c_nationkey") < 5, "2-HIGH").otherwise("1-URGENT")).alias("rules"))
    o = _t(spark, sf_dir, "orders").select(F.concat(F.lit("p:"), F.col("o_custkey"), F.lit("/"), F.col("o_orderkey")).alias("component"), F.col("o_orderpriority").alias("rule"))
    return joins.prefix_found(cases, o, "p").select("id", "found")


def w04_bounded_rows(spark, sf_dir):
    return evidence.bounded_rows(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", 400, 3).select("conv_id", "turn")


def w05_after_first(spark, sf_dir):
    return evidence.after_first(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")


def w06_last_of(spark, sf_dir):
    return evidence.last_of(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")


def w07_sized(spark, sf_dir):
    return evidence.sized(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", 1000).select("place", "n_name")


def u01_concat(spark, sf_dir):
    return facts.concatenated([_t(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), _t(spark, sf_dir, "region").select(F.col("r_name").alias("name"))])


QUERIES = {
    j04_same_range: """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey AS k, floor(l_quantity) AS s, floor(l_quantity + l_linenumber) AS e FROM lineitem),
 f AS (SELECT k, s, e, min(l_orderkey) AS first_order FROM l WHERE l_linenumber = 1 GROUP BY ALL) SELECT l_orderkey, l_linenumber, first_order FROM l LEFT JOIN f USING (k, s, e)""",
    j11_with_at_least: "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 2",
    j14_not_represented: "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_linenumber <= 2",
    j16_resolved: """WITH RECURSIVE e AS (SELECT o_custkey AS src, o_custkey * 5 % 613 AS dst FROM orders WHERE o_custkey <> o_custkey * 5 % 613 GROUP BY ALL),
 w AS (SELECT c_custkey, c_custkey AS node FROM customer UNION SELECT c_custkey, dst FROM w JOIN e ON src = node)
 SELECT c_custkey, coalesce(max(node) FILTER (node NOT IN (SELECT src FROM e)), c_custkey) AS root FROM w GROUP BY 1""",
    j27_prefix_found: """SELECT CAST(c_custkey AS VARCHAR) AS id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_orderpriority = '1-URGENT' OR (c_nationkey < 5 AND o_orderpriority = '2-HIGH'))) AS found FROM customer""",
    w04_bounded_rows: """SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER w AS s, row_number() OVER w AS n FROM conversations
 WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE s <= 400 AND n <= 3""",
    w05_after_first: "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_linenumber > (SELECT min(l_linenumber) FROM lineitem f WHERE f.l_orderkey = l.l_orderkey AND f.l_returnflag = 'R')",
    w06_last_of: "SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_returnflag)) AS l_returnflag FROM lineitem GROUP BY 1",
    w07_sized: "SELECT range AS place, n_name FROM range(1000) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) ON i = range % (SELECT count(*) FROM nation)",
    u01_concat: "SELECT 0 AS part, n_name AS name FROM nation UNION ALL SELECT 1, r_name FROM region",
}
