"""Selections of rules over facts that the tables hold, with SQL that states patterns' outcomes and limits itself.

A file holds 100 orders. An order is a function of 64 places, ten orders lie in an outer function, a line is a call of
its order's function, by its part; some lines are constructors, members, uses or statements too.
"""

from pyspark.sql import functions as F

from cairn.plans import fact_rules
from cairn.plans.selection_queries import _pick, _span
from cairn.plans.tables import table as _t

#: What a line calls, by its part's key modulo 24; a leading dot stands behind its supplier's name.
CALLEES = [".findMany", ".map", ".forEach", ".save", "Promise.all", "Promise.race", "fetch", ".loadAsync", ".connect", ".retry", "console.log", ".logger.error"]
CALLEES += [".startSpan", ".recordException", ".toThrow", "Date.now", ".sleep", ".addEventListener", ".setAttribute", ".logger.debug", ".other", "db.query", ".delete", ".transaction"]


def _functions(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "P", "test").otherwise("function")
    role = F.when(F.col("o_orderpriority") == "1-URGENT", "constructor").otherwise("plain")
    source = F.when(F.col("o_custkey") % 5 == 0, "req.body").when(F.col("o_custkey") % 5 == 1, "Webhook()").otherwise("rawest")
    orders = o.select(*_span("o_orderkey"), F.col("o_orderkey").cast("string").alias("id"), kind.alias("kind"), (F.floor("o_totalprice") % 13000).cast("long").alias("size"), role.alias("role"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("async"), (F.col("o_custkey") % 2 == 0).alias("mentions_signal"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderpriority")).otherwise("").alias("name"), source.alias("source"))
    tens = o.select(_span("o_orderkey")[0], F.floor(F.col("o_orderkey") / 10).alias("ten")).distinct()
    outer = tens.select("file", (F.col("ten") * 640).alias("start"), (F.col("ten") * 640 + 640).alias("end"), F.concat(F.lit("g"), "ten").alias("id"), F.lit("function").alias("kind"), F.lit(100).cast("long").alias("size"),
        F.lit("plain").alias("role"), F.lit(False).alias("async"), F.lit(False).alias("mentions_signal"), F.lit("").alias("name"), F.lit("").alias("source"))
    return orders.unionByName(outer)


def _calls(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")
    listed = _pick(F.col("l_partkey"), *CALLEES)
    name = F.concat(F.lit("p"), F.col("l_suppkey") % 3)
    # All 72 callees and their roots stand in a fixed array each, as every rule reads them; other keys are put together.
    full = [f"p{n}{c}" if c.startswith(".") else c for c in CALLEES for n in range(3)]
    at = ((F.col("l_partkey") % len(CALLEES)) * 3 + F.col("l_suppkey") % 3).cast("int")
    plain = (F.col("l_partkey") >= 0) & (F.col("l_suppkey") >= 0)
    callee = F.when(plain, F.get(F.array(*[F.lit(c) for c in full]), at)).otherwise(F.when(listed.startswith("."), F.concat(name, listed)).otherwise(listed))
    root = F.when(plain, F.get(F.array(*[F.lit(c.split(".")[0]) for c in full]), at)).otherwise(F.split_part(callee, F.lit("."), F.lit(1)))
    region = lambda kind, of: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(of).alias("callee")))
    control = F.when(F.col("l_linenumber") > 4, region("loop", "")).when(F.col("l_linenumber") == 4, region("callback", "xs.map")).otherwise(region("conditional", ""))
    usage = F.when(F.col("l_linestatus") == "O", "expression").when(F.col("l_returnflag") == "R", "assignment").otherwise("argument")
    words = _pick(F.col("l_suppkey"), "x('failed')", "status = 3", "restarting")
    return l.select(
        *_span("l_orderkey", "l_linenumber"), F.col("l_orderkey").cast("string").alias("function"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), callee.alias("callee"), words.alias("source"),
        F.array(F.lit("import fs from 'fs'")).alias("imports"), root.alias("root"), root.alias("receiver"), control.alias("control"), F.array(name).alias("bindings"),
        (F.col("l_returnflag") == "A").alias("paginated"), (F.col("l_linestatus") == "F").alias("ordered"), usage.alias("usage"), (F.col("l_returnflag") == "A").alias("awaited"), F.when(F.col("l_linestatus") == "O", "abort").alias("event"),
        F.concat(F.lit("v"), F.col("l_suppkey") % 4).alias("name"), ((F.col("l_orderkey") + 1) * 64).alias("until"), F.when(F.col("l_returnflag") == "R", F.col("l_orderkey").cast("string")).alias("handler"),
        F.lit("e0").alias("binding"), F.array(F.concat(F.lit("e"), F.col("l_suppkey") % 2)).alias("references"), "l_linenumber", "l_partkey",
    )


def r_relational(spark, sf_dir):
    return fact_rules.relational(_functions(spark, sf_dir), _calls(spark, sf_dir))


def r_async(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders"), _calls(spark, sf_dir)
    declared = o.filter("o_custkey % 7 < 2").select(*_span("o_orderkey"), F.when(F.col("o_custkey") % 7 == 0, "fetch").otherwise("Promise").alias("name"))
    parameters = c.select("file", "function", F.col("l_linenumber").alias("position"), F.col("bindings")[0].alias("name"), F.when(F.col("usage") == "assignment", "AbortSignal").otherwise("Signal").alias("type"))
    uses = c.select("file", F.concat(F.lit("v"), F.col("l_partkey") % 4).alias("name"), F.col("end").alias("start"))
    return fact_rules.asynchronous(_functions(spark, sf_dir), c, declared, parameters, uses)


def r_resources(spark, sf_dir):
    f, c = _functions(spark, sf_dir), _calls(spark, sf_dir)
    made = c.select("file", "function", F.when(F.col("l_partkey") % 9 == 0, "ws.WebSocket").otherwise("Sockets").alias("callee"))
    declared = f.filter("role = 'constructor' AND size % 2 = 0").select(F.col("id").alias("function"))
    # Lines that are assigned to are loops over the four lines from theirs on, those that are arguments catches of their own place.
    loops = c.filter("usage = 'assignment'").select("function", "id", "start", (F.col("start") + 28).alias("end"), F.when(F.col("l_partkey") % 3 == 0, "for-in").when(F.col("l_partkey") % 3 == 1, "while").otherwise("for-of").alias("kind"), "references")
    loops = loops.withColumnRenamed("references", "bindings")
    catches = c.filter("usage = 'argument'").select("function", "id", "start", "end")
    return fact_rules.resources(f, c, made, declared, loops, catches)


def r_observability(spark, sf_dir):
    x = fact_rules.observability(_calls(spark, sf_dir))
    return x.groupBy("rule_id", "file").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def r_tests(spark, sf_dir):
    f = _functions(spark, sf_dir)
    # A test reaches the next order's function.
    helpers = f.filter("kind = 'test'").select("file", "id", (F.col("id").cast("long") + 1).cast("string").alias("function"))
    return fact_rules.tests(f, _calls(spark, sf_dir), helpers)


def r_errors(spark, sf_dir):
    binding = F.when(F.col("o_orderstatus") == "P", "{ message }").otherwise(F.concat(F.lit("e"), F.col("o_custkey") % 2))
    handlers = _t(spark, sf_dir, "orders").select(*_span("o_orderkey"), F.col("o_orderkey").cast("string").alias("id"), binding.alias("binding"))
    c = _calls(spark, sf_dir).withColumn("handler", F.col("function"))
    statements = c.select("file", "handler", F.when(F.col("usage") == "argument", "expression").otherwise("throw").alias("kind"), F.when(F.col("usage") == "expression", F.col("references")[0]).alias("thrown"))
    members = c.filter("awaited").select("file", "start", "end", F.concat(F.col("references")[0], F.lit(".message")).alias("path"))
    return fact_rules.errors(handlers, statements, c.filter("l_partkey % 3 = 0"), members)


def r_api_contracts(spark, sf_dir):
    f, c = _functions(spark, sf_dir), _calls(spark, sf_dir)
    exports = c.select("file", (F.col("start") - 8).alias("target"), F.lit("export").alias("words"))
    method = _pick(F.col("o_custkey"), "GET", "POST", "HEAD", "PUT")
    o = _t(spark, sf_dir, "orders").filter("o_orderpriority = '3-MEDIUM'")
    called = c.groupBy(F.col("function").alias("_f")).agg(F.collect_list(F.struct("callee")).alias("calls"))
    routes = o.join(called, F.col("o_orderkey").cast("string") == F.col("_f"), "left")
    sources = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("body"))).otherwise(F.array().cast("array<string>"))
    routes = routes.select(_span("o_orderkey")[0], F.concat(F.lit("r"), "o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("function"), (F.floor("o_totalprice") % 13000).alias("size"), method.alias("method"),
        "calls", F.array(F.when(F.col("o_orderstatus") == "F", F.lit(200))).alias("statuses"), sources.alias("sources"))
    return fact_rules.api_contracts(f, c, exports, routes)


_FACTS = """c AS (SELECT l_orderkey // 100 AS file, l_orderkey AS f, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_partkey % 24 AS i, l_returnflag AS rf, l_linestatus AS ls,
 CASE WHEN l_linestatus = 'O' THEN 'expression' WHEN l_returnflag = 'R' THEN 'assignment' ELSE 'argument' END AS usage, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id FROM lineitem),
 fn AS (SELECT o_orderkey // 100 AS file, o_orderkey AS f, o_orderkey::VARCHAR AS id, o_orderstatus = 'P' AS test, floor(o_totalprice)::BIGINT % 13000 BETWEEN 1 AND 12000 AS fits, floor(o_totalprice)::BIGINT % 13000 AS size, o_orderpriority AS pr, o_custkey AS ck, o_orderstatus AS st FROM orders),
 own AS (SELECT * FROM fn WHERE fits AND NOT test)"""


def _rule(rule, rows):
    return f"SELECT '{rule}' AS rule_id, file, id, n::BIGINT AS n FROM ({rows})"


def _own(condition, having="", functions="own"):
    return f"SELECT o.file, o.id, count(*) AS n FROM c JOIN {functions} o USING (f) WHERE {condition} GROUP BY 1, 2 {having}"


def _sql(*parts, more=""):
    return f"WITH {_FACTS}{more} " + " UNION ALL ".join(parts)


QUERIES = {
    r_relational: _sql(
        _rule("relational-databases/prefer-database-join", "SELECT o.file, o.id, count(*) FILTER (i IN (0, 21)) AS n FROM c JOIN own o USING (f) GROUP BY 1, 2 HAVING count(*) FILTER (i IN (0, 21)) >= 2 AND count(*) FILTER (i IN (1, 2)) > 0"),
        _rule("relational-databases/no-query-in-loop", """SELECT o.file, o.id, count(*) FILTER (i IN (0, 21) AND ln >= 4) AS n FROM c JOIN own o USING (f) GROUP BY 1, 2 HAVING n > 0 AND (max(ln) FILTER (i IN (0, 21)) > 4 OR count(*) FILTER (i IN (1, 2)) > 0)
 UNION ALL SELECT c.file, 'g' || c.f // 10, count(*) FROM c JOIN fn USING (f) WHERE i IN (0, 21) AND ln >= 4 GROUP BY 1, 2 HAVING max(ln) > 4"""),
        _rule("relational-databases/require-transaction-scoped-client", """SELECT o.file, o.id, count(*) AS n FROM c t JOIN own o USING (f) JOIN c d ON d.f = t.f AND d.ln = t.ln AND d.i IN (0, 21) AND (d.i = 21 OR d.sk % 3 <> t.sk % 3) WHERE t.i = 23 GROUP BY 1, 2"""),
        _rule("relational-databases/require-deterministic-pagination-order", _own("i IN (0, 21) AND rf = 'A' AND ls <> 'F'")),
    ),
    r_async: _sql(
        _rule("async/no-unobserved-async-work", "SELECT file, f::VARCHAR AS id, count(*) AS n FROM c WHERE i IN (6, 7) AND (usage = 'expression' OR usage = 'assignment' AND NOT EXISTS (SELECT 1 FROM c u WHERE u.f = c.f AND u.pk % 4 = c.sk % 4 AND u.ln >= c.ln)) GROUP BY 1, 2"),
        _rule("async/no-async-initialization", _own("i IN (6, 7) AND pr = '1-URGENT'")), _rule("async/no-unbounded-concurrency", _own("i = 4 AND ck % 7 <> 1")),
        _rule("async/no-serial-independent-work", _own("rf = 'A' AND pr IN ('1-URGENT', '2-HIGH')", "HAVING count(*) >= 2")), _rule("async/require-cancellation-propagation", _own("i = 6 AND ck % 7 <> 0 AND ck % 2 = 0")),
        _rule("async/require-race-loser-cleanup", _own("i = 5 AND ck % 7 <> 1")),
        _rule("async/require-abort-listener-cleanup", _own("i = 17 AND ls = 'O' AND EXISTS (SELECT 1 FROM c p WHERE p.f = c.f AND p.usage = 'assignment' AND p.sk % 3 = c.sk % 3)")),
    ),
    r_resources: _sql(
        *[_rule(f"resources/{r}", "SELECT file, id, 1 AS n FROM own WHERE pr = '1-URGENT' AND size % 2 = 0 OR f IN (SELECT f FROM c WHERE i = 8 OR pk % 9 = 0)") for r in ("no-leaked-resources", "require-cleanup-on-failure")],
        _rule("resources/require-complete-resource-cleanup", "SELECT o.file, o.id, count(*) FILTER (i = 8) + count(*) FILTER (pk % 9 = 0) AS n FROM c JOIN own o USING (f) GROUP BY 1, 2 HAVING n >= 2"),
        *[_rule(f"resources/{r}", "SELECT file, id, 1 AS n FROM own WHERE f IN (SELECT f FROM c WHERE i = 9 UNION ALL SELECT f FROM tried)") for r in ("require-bounded-retries", "require-retry-backoff-with-jitter", "require-retry-time-budget")],
        more=""", tried AS (SELECT l.f FROM c l JOIN c k ON k.f = l.f AND k.usage = 'argument' AND k.ln BETWEEN l.ln AND l.ln + 3 WHERE l.usage = 'assignment' AND (l.pk % 3 = 1 OR l.pk % 3 = 2 AND EXISTS (SELECT 1 FROM c x
 WHERE x.f = l.f AND x.ln BETWEEN l.ln AND l.ln + 3 AND x.sk % 2 <> l.sk % 2 AND NOT EXISTS (SELECT 1 FROM c y WHERE y.f = x.f AND y.usage = 'argument' AND y.ln = x.ln))))""",
    ),
    r_observability: f"""WITH {_FACTS}, e AS (SELECT *, i IN (11, 13) AS bad FROM c WHERE i IN (10, 11, 12, 13, 18, 19)),
 x AS (SELECT 'observability/no-sensitive-logs' AS rule_id, file, id, 1 AS n FROM e UNION ALL SELECT 'observability/no-unactionable-errors', file, id, 1 FROM e WHERE bad
 UNION ALL SELECT 'observability/require-operation-context', file, id, 1 FROM e WHERE bad OR i = 12 OR i = 10 AND sk % 3 < 2 UNION ALL SELECT 'observability/require-stable-telemetry-names', file, id, 1 FROM e WHERE i = 12
 UNION ALL SELECT 'observability/no-duplicate-error-reporting', file, f::VARCHAR, count(*) FROM c WHERE rf = 'R' AND i IN (11, 13) AND sk % 2 = 0 GROUP BY 2, 3 HAVING count(*) >= 2)
 SELECT rule_id, file, count(*) AS rows, sum(n)::BIGINT AS n, min(id) AS first, max(id) AS last FROM x GROUP BY 1, 2""",
    r_tests: _sql(
        _rule("tests/no-vacuous-tests", "SELECT file, id, 1 AS n FROM ts"), _rule("tests/require-specific-error-assertions", _own("i = 14", functions="ts")),
        _rule("tests/no-nondeterministic-tests", "SELECT ts.file, ts.id, count(*) AS n FROM ts JOIN c ON (c.f = ts.f OR c.f = ts.f + 1 AND c.file = ts.file) AND i = 15 GROUP BY 1, 2"),
        _rule("tests/no-fixed-delay-synchronization", "SELECT ts.file, ts.id, count(*) AS n FROM ts JOIN c ON (c.f = ts.f OR c.f = ts.f + 1 AND c.file = ts.file) AND i = 16 GROUP BY 1, 2"),
        more=", ts AS (SELECT * FROM fn WHERE fits AND test)",
    ),
    r_errors: _sql(
        _rule("errors/no-useless-catch-boundaries", "SELECT h.file, h.id, 1 AS n FROM h JOIN c USING (f) WHERE b IS NOT NULL GROUP BY 1, 2, b HAVING count(*) = 1 AND bool_and(usage = 'expression' AND sk % 2 = b AND pk % 3 <> 0)"),
        _rule("errors/no-swallowed-errors", "SELECT file, id, 1 AS n FROM h"),
        _rule("errors/no-lossy-error-wrapping", "SELECT h.file, h.id, 1 AS n FROM h JOIN c USING (f) WHERE usage <> 'argument' GROUP BY 1, 2, b HAVING b IS NULL OR bool_or(usage = 'assignment' OR sk % 2 <> b)"),
        _rule("errors/no-message-based-error-dispatch", "SELECT file, id, 1 AS n FROM h WHERE b IS NOT NULL AND EXISTS (SELECT 1 FROM c WHERE c.f = h.f AND rf = 'A' AND sk % 2 = b)"),
        more=", h AS (SELECT *, CASE WHEN NOT test THEN ck % 2 END AS b FROM fn)",
    ),
    r_api_contracts: _sql(
        _rule("api-contracts/no-ignored-significant-results", "SELECT file, f::VARCHAR AS id, count(*) AS n FROM c WHERE usage = 'expression' AND i IN (3, 22) GROUP BY 1, 2"),
        _rule("api-contracts/no-misleading-function-names", "SELECT file, id, 1 AS n FROM own WHERE ck % 3 > 0"), _rule("api-contracts/no-ambiguous-failure-contracts", "SELECT file, id, 1 AS n FROM ex UNION SELECT file, 'g' || f // 10, 1 FROM c WHERE ln = 1 AND f % 10 = 0 AND f // 10 IN (SELECT f // 10 FROM fn)"),
        _rule("api-contracts/require-input-validation", "SELECT file, id, 1 AS n FROM ex WHERE ck % 5 < 2 AND NOT (pr = '3-MEDIUM' AND st = 'O' AND size <= 12000) UNION ALL SELECT file, id, 1 FROM rt WHERE st = 'O' AND size <= 12000"),
        _rule("api-contracts/no-side-effects-in-safe-http-methods", "SELECT file, id, 1 AS n FROM rt WHERE ck % 4 IN (0, 2) AND f IN (SELECT f FROM c WHERE i IN (3, 17, 18, 22))"), _rule("api-contracts/no-misleading-http-status", "SELECT file, id, 1 AS n FROM rt WHERE st = 'F'"),
        more=", ex AS (SELECT * FROM own WHERE f IN (SELECT f FROM c WHERE ln = 1)), rt AS (SELECT file, f, 'r' || f AS id, ck, st, size FROM fn WHERE pr = '3-MEDIUM')",
    ),
}
