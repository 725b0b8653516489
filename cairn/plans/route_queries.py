"""Routes over facts that the tables hold: customers are files, orders bind receivers and call them, lines are arguments."""

from pyspark.sql import functions as F

from cairn.operators import routes
from cairn.plans.tables import table as _t

_NAMES = ["method", "url", "path", "handler", "preHandler", "schema", "onRequest"]


def _receivers(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    module = F.when(F.col("c_custkey") % 5 < 3, "fastify").when(F.col("c_custkey") % 5 == 3, "express").otherwise("koa")
    imported = F.when(F.col("c_nationkey") % 4 == 0, "default").when(F.col("c_nationkey") % 4 == 1, "*").when(F.col("c_nationkey") % 4 == 2, "fastify").otherwise("Router")
    imports = c.select(F.col("c_custkey").alias("file"), F.lit("make").alias("local"), module.alias("module"), imported.alias("imported"))
    more = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("file"), F.lit("web").alias("local"), F.lit("express").alias("module"), F.lit("default").alias("imported"))
    callee = F.when(F.col("o_orderstatus") == "F", "make").when(F.col("o_orderstatus") == "O", "web").otherwise("web.Router")
    bound = o.select(F.col("o_custkey").alias("file"), F.concat(F.lit("app"), F.col("o_orderkey") % 2).alias("receiver"), F.col("o_orderkey").alias("start"), callee.alias("callee"))
    return routes.receivers(imports.unionByName(more), bound)


def e09_receivers(spark, sf_dir):
    return _receivers(spark, sf_dir)


def e10_routes(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    method = F.when(F.col("o_orderpriority") == "1-URGENT", "get").when(F.col("o_orderpriority") == "2-HIGH", "post").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "use").otherwise("route")
    calls = o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("id"), F.concat(F.lit("app"), F.floor(F.col("o_orderkey") / 2) % 2).alias("object"), method.alias("property"))
    # Dealt by order once: the reductions by line and by call and the join with orders follow without another shuffle.
    l = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when((F.col("k") % 5 == 0) | (F.col("l_linenumber") == 1) & (F.col("k") % 2 == 0), "string").when(F.col("k") % 5 == 1, "function").when(F.col("k") % 5 < 4, "object").otherwise("name")
    arguments = l.select(F.col("o_custkey").alias("file"), F.col("l_orderkey").alias("call"), F.col("l_linenumber").alias("position"), kind.alias("kind"), F.concat(F.lit("v"), F.col("k") % 50).alias("value"), F.concat(F.lit("t"), "k").alias("text"), "k")
    named = arguments.filter("kind = 'object'").select("file", "call", "position", "k", F.posexplode(F.array(*[F.lit(n) for n in _NAMES])).alias("ord", "name")).filter("(k + ord) % 3 > 0")
    text = F.when(F.col("name") == "method", F.when(F.col("k") % 2 == 0, "get").otherwise("put")).otherwise(F.concat_ws(":", "name", "k"))
    properties = named.select("file", "call", "position", "ord", "name", F.when((F.col("name") == "handler") | (F.col("k") % 11 == 0), "name").otherwise("string").alias("kind"), F.when(F.col("name") == "handler", F.concat(F.lit("v"), F.col("k") % 50)).otherwise(text).alias("value"), text.alias("text"))
    functions = o.select(F.col("o_custkey").alias("file"), F.concat(F.lit("f"), "o_orderkey").alias("id"), F.concat(F.lit("v"), F.col("o_orderkey") % 50).alias("name"))
    x = routes.with_handlers(routes.routes(calls, arguments.drop("k"), properties, _receivers(spark, sf_dir)), functions)
    return x.select("file", "id", "framework", "method", "path", "function", F.array_join(F.transform("attachments", lambda a: F.concat_ws("=", a["kind"], a["text"])), " ").alias("attachments"))


_BOUND = """made AS (SELECT c_custkey AS file, 'make' AS callee, CASE WHEN c_custkey % 5 < 3 THEN 'fastify' ELSE 'express' END AS framework FROM customer WHERE c_custkey % 5 < 3 AND c_nationkey % 4 < 3 OR c_custkey % 5 = 3 AND c_nationkey % 4 <> 2
 UNION ALL SELECT c_custkey, unnest(['web', 'web.Router']), 'express' FROM customer WHERE c_custkey % 2 = 0),
 r AS (SELECT file, 'app' || o_orderkey % 2 AS object, arg_max(framework, o_orderkey) AS framework FROM orders JOIN made ON file = o_custkey AND callee = CASE o_orderstatus WHEN 'F' THEN 'make' WHEN 'O' THEN 'web' ELSE 'web.Router' END GROUP BY 1, 2)"""

QUERIES = {
    e09_receivers: f"WITH {_BOUND} SELECT file, object, framework FROM r",
    e10_routes: f"""WITH {_BOUND}, a AS (SELECT l_orderkey AS id, l_linenumber AS p, min(l_partkey) AS k FROM lineitem GROUP BY 1, 2),
 b AS (SELECT *, CASE WHEN k % 5 = 0 OR p = 1 AND k % 2 = 0 THEN 's' WHEN k % 5 = 1 THEN 'f' WHEN k % 5 < 4 THEN 'o' ELSE 'n' END AS kind, row_number() OVER (PARTITION BY id ORDER BY p) AS i, count(*) OVER (PARTITION BY id) AS n FROM a),
 g AS (SELECT id, max(n) AS n, max(k) FILTER (i = 1) AS k1, max(kind) FILTER (i = 1) AS kind1, max(k) FILTER (i = 2) AS k2, max(kind) FILTER (i = 2) AS kind2, max(k) FILTER (i = n) AS kn, max(kind) FILTER (i = n) AS kindn,
 string_agg('middleware=t' || k, ' ' ORDER BY i) FILTER (i > 1 AND i < n) AS mid FROM b GROUP BY 1),
 c AS (SELECT o_custkey AS file, o_orderkey AS id, framework, CASE o_orderpriority WHEN '1-URGENT' THEN 'GET' WHEN '2-HIGH' THEN 'POST' ELSE 'route' END AS m, g.* EXCLUDE (id), CASE WHEN framework = 'fastify' THEN CASE WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN CASE WHEN kind1 = 'o' THEN k1 END WHEN n >= 3 AND kind2 = 'o' THEN k2 END END AS ok
 FROM orders JOIN r ON r.file = o_custkey AND object = 'app' || o_orderkey // 2 % 2 JOIN g ON g.id = o_orderkey WHERE o_orderpriority <> '4-NOT SPECIFIED'),
 d AS (SELECT file, id, framework, CASE WHEN m <> 'route' THEN m WHEN ok % 3 > 0 AND ok % 11 > 0 THEN CASE WHEN ok % 2 = 0 THEN 'GET' ELSE 'PUT' END END AS method,
 CASE WHEN m <> 'route' THEN CASE WHEN n >= 2 AND kind1 = 's' THEN 'v' || k1 % 50 END WHEN ok % 11 > 0 THEN CASE WHEN (ok + 1) % 3 > 0 THEN 'url:' || ok WHEN (ok + 2) % 3 > 0 THEN 'path:' || ok END END AS path,
 CASE WHEN m <> 'route' THEN kindn WHEN (ok + 3) % 3 > 0 THEN 'n' END AS hk, CASE WHEN m <> 'route' THEN kn ELSE ok END AS h,
 CASE WHEN framework = 'express' THEN coalesce(mid, '') ELSE concat_ws(' ', CASE WHEN (ok + 5) % 3 > 0 THEN 'schema=schema:' || ok END, CASE WHEN (ok + 6) % 3 > 0 THEN 'middleware=onRequest:' || ok END, CASE WHEN (ok + 4) % 3 > 0 THEN 'middleware=preHandler:' || ok END) END AS attachments
 FROM c WHERE m <> 'route' OR framework = 'fastify'),
 u AS (SELECT o_custkey AS file, 'v' || o_orderkey % 50 AS name, 'f' || min(o_orderkey) AS fn FROM orders GROUP BY 1, 2 HAVING count(*) = 1)
 SELECT d.file, id, framework, method, path, CASE hk WHEN 'f' THEN 'v' || h % 50 WHEN 'n' THEN fn END AS function, attachments FROM d LEFT JOIN u ON u.file = d.file AND name = 'v' || h % 50 WHERE method IS NOT NULL AND path IS NOT NULL AND hk IS NOT NULL""",
}
