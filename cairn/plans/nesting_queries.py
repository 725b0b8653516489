"""Regions, ownership and static paths over trees that the tables hold, with SQL that follows keys and not places.

Nations are files. A customer's range spans W places from its key times W, its orders lie 16 places each in it, their lines
one place each in these; a loop lies around every 100 customers.
"""

from pyspark.sql import functions as F

from cairn.operators import graphs, nesting
from cairn.plans.tables import table as _t

W = 1 << 36


def _places(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", "c_mktsegment", "c_acctbal", (F.col("c_custkey") * W).alias("cs"))
    o = _t(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("k", "c_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", (F.col("cs") + F.col("o_orderkey") * 16).alias("os"))
    l = _t(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("start", F.col("os") + F.col("l_linenumber"))
    return c, o, l


def _nodes(spark, sf_dir):
    c, o, _ = _places(spark, sf_dir)
    none, no = F.lit(None).cast("long"), F.lit(None).cast("string")
    block = F.floor(F.col("c_custkey") / 100) * 100
    blocks = c.select("k", F.lit("ForStatement").alias("type"), (block * W).alias("start"), ((block + 100) * W - 1).alias("end"), no.alias("parent_type"), F.lit(False).alias("is_argument"), none.alias("final_start"), none.alias("final_end"))
    function = F.when(F.col("c_mktsegment") == "BUILDING", "ArrowFunctionExpression").when(F.col("c_mktsegment") == "MACHINERY", "FunctionDeclaration").otherwise("BlockStatement")
    customers = c.select("k", function.alias("type"), F.col("cs").alias("start"), (F.col("cs") + W - 1).alias("end"), F.lit("CallExpression").alias("parent_type"), (F.col("c_mktsegment") == "BUILDING").alias("is_argument"), none.alias("final_start"), none.alias("final_end"))
    kinds = {"1-URGENT": "WhileStatement", "2-HIGH": "CatchClause", "3-MEDIUM": "TryStatement", "4-NOT SPECIFIED": "IfStatement", "5-LOW": "TryStatement"}
    kind = F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("o_orderpriority"))
    final = F.when(F.col("o_orderpriority") == "3-MEDIUM", F.col("os") + 4)
    orders = o.select("k", kind.alias("type"), F.col("os").alias("start"), (F.col("os") + 15).alias("end"), no.alias("parent_type"), F.lit(False).alias("is_argument"), final.alias("final_start"), (final + 11).alias("final_end"))
    return blocks.unionByName(customers).unionByName(orders)


def e20_control_regions(spark, sf_dir):
    l = _places(spark, sf_dir)[2].select("k", "l_orderkey", "l_linenumber", "start", F.col("start").alias("end"))
    x = nesting.control_regions(l, _nodes(spark, sf_dir), "k")
    written = F.transform("control", lambda r: F.concat_ws(":", r.kind, r.start.cast("string"), r.end.cast("string")))
    return x.select("l_orderkey", "l_linenumber", F.array_join(written, ">").alias("control"))


def e19_regions(spark, sf_dir):
    return nesting.regions(_nodes(spark, sf_dir), "k").groupBy("k", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("places"))


def e14_handler_flow(spark, sf_dir):
    c, o, l = _places(spark, sf_dir)
    name = F.when(F.col("c_acctbal") > 0, "req"), F.when(F.col("c_custkey") % 3 != 0, "res")
    functions = c.filter("c_mktsegment IN ('BUILDING', 'MACHINERY')").select("k", F.concat(F.lit("f"), "c_custkey").alias("id"), F.col("cs").alias("start"), (F.col("cs") + W - 1).alias("end"), name[0].alias("request"), name[1].alias("response"), (F.col("c_custkey") % 3).cast("int").alias("parameters"))
    none = F.lit(None).cast("string")
    catches = o.filter("o_orderpriority = '2-HIGH'").select("k", F.concat(F.lit("c"), "o_orderkey").alias("id"), F.col("os").alias("start"), (F.col("os") + 15).alias("end"), none.alias("request"), none.alias("response"), F.lit(0).alias("parameters"))
    barriers = functions.unionByName(catches)
    kind = F.when(F.col("l_returnflag") == "R", "call").when(F.col("l_returnflag") == "A", "throw").otherwise("read")
    target = F.when(F.col("l_linestatus") == "O", "req").otherwise("res")
    facts = l.select("k", "start", F.col("start").alias("end"), kind.alias("kind"), target.alias("object"), F.col("l_suppkey").cast("string").alias("name"))
    returns = o.filter("o_orderstatus = 'F'").select("k", F.col("os").alias("start"), F.col("os").alias("end"), F.lit("return").alias("kind"), none.alias("object"), F.lit("r").alias("name"))
    x = nesting.handler_flow(barriers.select("k", "id", "request", "response", "parameters"), facts.unionByName(returns), barriers.select("k", "id", "start", "end"), "k")
    joined = lambda a: F.array_join(F.transform(a, lambda e: e["name"]), ",")
    return x.select("id", *[joined(a).alias(a) for a in ("calls", "exits", "sources")], "requests_complete", "responses_complete")


def e23_reference_paths(spark, sf_dir):
    # Chains of up to 1000 links and of up to 7, one name in fifty dynamic, owners of 50 keys.
    p = _t(spark, sf_dir, "part").withColumn("n", F.when(F.col("p_partkey") % 3000 < 1500, 1000).otherwise(7))
    members = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % F.col("n") != 1, F.col("p_partkey") - 1).alias("object"), F.when(F.col("p_size") != 50, F.substring("p_brand", 7, 2)).alias("name"), F.col("p_partkey").alias("start"), F.floor(F.col("p_partkey") / 50).alias("owner"))
    members = members.withColumn("object", F.when(F.col("object") > 0, F.col("object")))
    x = graphs.reference_paths(members, "owner")
    return x.select("owner", F.md5(F.array_join("paths", " ")).alias("paths"), F.size("paths").cast("long").alias("n"), "partial")


def e24_static_paths(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    members = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 40 != 1, F.col("p_partkey") - 1).alias("object"), F.when(F.col("p_size") != 50, F.element_at(F.split("p_name", " "), 1)).alias("name"))
    members = members.withColumn("object", F.when(F.col("object") > 0, F.col("object")))
    x = graphs.static_paths(members)
    return x.select("id", "path", "links")


_TREE = f"""t AS (SELECT c_nationkey AS k, c_custkey AS c, c_mktsegment AS seg, c_acctbal AS bal, o_orderkey AS o, o_orderpriority AS pr, o_orderstatus AS st, c_custkey * {W} AS cs, c_custkey * {W} + o_orderkey * 16 AS os FROM customer JOIN orders ON o_custkey = c_custkey),
 l AS (SELECT t.*, lineitem.*, os + l_linenumber AS s FROM lineitem JOIN t ON o = l_orderkey)"""

QUERIES = {
    e20_control_regions: f"""WITH {_TREE} SELECT l_orderkey, l_linenumber, concat_ws('>', 'loop:' || (c // 100 * 100 * {W}) || ':' || ((c // 100 * 100 + 100) * {W} - 1), CASE WHEN seg = 'BUILDING' THEN 'callback:' || cs || ':' || (cs + {W} - 1) END,
 CASE pr WHEN '1-URGENT' THEN 'loop:' || os || ':' || (os + 15) WHEN '2-HIGH' THEN 'catch:' || os || ':' || (os + 15) WHEN '4-NOT SPECIFIED' THEN 'conditional:' || os || ':' || (os + 15) WHEN '3-MEDIUM' THEN CASE WHEN l_linenumber >= 4 THEN 'finally:' || (os + 4) || ':' || (os + 15) END END) AS control FROM l""",
    e19_regions: f"""WITH {_TREE}, r AS (SELECT DISTINCT c_nationkey AS k, 'loop' AS kind, c_custkey // 100 AS i, 100 * {W} - 1 AS n FROM customer
 UNION ALL SELECT c_nationkey, 'callback', c_custkey, {W} - 1 FROM customer WHERE c_mktsegment = 'BUILDING'
 UNION ALL SELECT k, CASE pr WHEN '1-URGENT' THEN 'loop' WHEN '2-HIGH' THEN 'catch' WHEN '3-MEDIUM' THEN 'finally' ELSE 'conditional' END, o, CASE WHEN pr = '3-MEDIUM' THEN 11 ELSE 15 END FROM t WHERE pr <> '5-LOW')
 SELECT k, kind, count(*) AS n, sum(n)::BIGINT AS places FROM r GROUP BY 1, 2""",
    e14_handler_flow: f"""WITH {_TREE}, h AS (SELECT 'f' || c_custkey AS id, CASE WHEN c_acctbal > 0 THEN 'req' END AS req, CASE WHEN c_custkey % 3 <> 0 THEN 'res' END AS res, c_custkey % 3 AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
 UNION ALL SELECT 'c' || o, NULL, NULL, 0 FROM t WHERE pr = '2-HIGH'),
 f AS (SELECT CASE WHEN pr = '2-HIGH' THEN 'c' || o WHEN seg IN ('BUILDING', 'MACHINERY') THEN 'f' || c END AS id, s, CASE l_returnflag WHEN 'R' THEN 'call' WHEN 'A' THEN 'throw' ELSE 'read' END AS kind, CASE WHEN l_linestatus = 'O' THEN 'req' ELSE 'res' END AS obj, l_suppkey::VARCHAR AS name FROM l
 UNION ALL SELECT CASE WHEN pr = '2-HIGH' THEN 'c' || o WHEN seg IN ('BUILDING', 'MACHINERY') THEN 'f' || c END, os, 'return', NULL, 'r' FROM t WHERE st = 'F')
 SELECT h.id, coalesce(string_agg(name, ',' ORDER BY s, name) FILTER (kind = 'call'), '') AS calls, coalesce(string_agg(name, ',' ORDER BY s, name) FILTER (kind IN ('throw', 'return') OR kind = 'call' AND obj = res), '') AS exits,
 coalesce(string_agg(name, ',' ORDER BY s, name) FILTER (kind = 'read' AND obj = req), '') AS sources, n < 1 OR req IS NOT NULL AS requests_complete, n < 2 OR res IS NOT NULL AS responses_complete
 FROM h LEFT JOIN f USING (id) GROUP BY h.id, req, res, n""",
    e23_reference_paths: """WITH RECURSIVE m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % CASE WHEN p_partkey % 3000 < 1500 THEN 1000 ELSE 7 END <> 1 AND p_partkey > 1 THEN p_partkey - 1 END AS up, CASE WHEN p_size <> 50 THEN substr(p_brand, 7, 2) END AS name FROM part),
 w AS (SELECT id, name AS path, up IS NOT NULL AND up NOT IN (SELECT id FROM m) AS lost FROM m WHERE up IS NULL OR up NOT IN (SELECT id FROM m) UNION ALL SELECT m.id, w.path || '.' || m.name, w.lost FROM m JOIN w ON m.up = w.id),
 x AS (SELECT id // 50 AS owner, CASE WHEN NOT lost THEN path END AS path, min(id) AS s FROM w WHERE id NOT IN (SELECT up FROM m WHERE up IS NOT NULL) GROUP BY 1, 2)
 SELECT owner, md5(coalesce(string_agg(path, ' ' ORDER BY s), '')) AS paths, count(path) AS n, bool_or(path IS NULL) AS partial FROM x GROUP BY owner""",
    e24_static_paths: """WITH RECURSIVE m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 40 <> 1 AND p_partkey > 1 THEN p_partkey - 1 END AS up, CASE WHEN p_size <> 50 THEN split_part(p_name, ' ', 1) END AS name FROM part),
 w AS (SELECT id, name AS path, 1 AS links, up IS NOT NULL AS lost FROM m WHERE up IS NULL OR up NOT IN (SELECT id FROM m) UNION ALL SELECT m.id, w.path || '.' || m.name, links + 1, w.lost FROM m JOIN w ON m.up = w.id)
 SELECT id, CASE WHEN NOT lost THEN path END AS path, CAST(links AS BIGINT) AS links FROM w""",
}
