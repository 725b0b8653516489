"""Conditions of rules on spelt-out sources over whole tables, with their SQL, which says by itself which rows they fit."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cairn.functions.recovery import kept
from cairn.operators import decisions, metrics, names, runs, selections
from cairn.plans.tables import table as _t


def _pick(by, *values):
    """The value at `by` modulo their number; a look-up in one array, as a chain of conditions is worked out anew wherever it is read."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (by % len(values)).cast("int"))


def _part(spark, sf_dir):
    return _t(spark, sf_dir, "part")


def f06_database_call(spark, sf_dir):
    callee = _pick(F.col("p_partkey"), "db", "orm.findMany", "client.query", "UserRepository.find", "prisma.user.count", "render", "findManyMore", None)
    imports = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("import fs from 'fs'"), F.lit("import { Pool } from 'pg'"))).otherwise(F.array(F.lit("import x from 'pgx'")))
    return _part(spark, sf_dir).select("p_partkey", selections.database_call(callee, imports).alias("found"), selections.database_call(callee, imports, [r"\Arender\z"]).alias("own"))


def f07_in_iteration(spark, sf_dir):
    region = F.struct(_pick(F.col("p_partkey"), "loop", "callback", "callback", "branch").alias("kind"), _pick(F.col("p_size"), "xs.map", "emap", None).alias("callee"))
    control = F.when(F.col("p_size") > 3, F.array(region)).otherwise(F.filter(F.array(region), lambda r: F.lit(False)))
    return _part(spark, sf_dir).select("p_partkey", selections.in_iteration(control, r"(?:^|\.)(?:flatMap|forEach|map|reduce)\z").alias("within"))


def f14_state_change(spark, sf_dir):
    callee = lambda by: F.struct(_pick(by, "user.save", "console.write", "createOrder", "creation", "res.set", "list.get").alias("callee"))
    return _part(spark, sf_dir).select("p_partkey", selections.possible_state_change(F.array(callee(F.col("p_partkey")), callee(F.col("p_size")))).alias("may"))


def _span(order, line=None):
    """(file, start, end) of an order, 64 places in a file of 100, or of the four first places of one of its lines."""
    start = F.col(order) * 64 + (F.col(line) * 8 if line else 0)
    return F.floor(F.col(order) / 100).alias("file"), start.alias("start"), (start + (4 if line else 64)).alias("end")


def _lines(spark, sf_dir, *columns):
    return _t(spark, sf_dir, "lineitem").select(*_span("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", *columns)


def f16_direct_export(spark, sf_dir):
    functions = _t(spark, sf_dir, "orders").select(*_span("o_orderkey"), "o_orderkey")
    lines = _lines(spark, sf_dir, F.concat(F.lit("export "), F.lower("l_returnflag")).alias("words"))
    return names.exported(functions, lines.withColumn("target", F.col("start") - 8), "file").select("o_orderkey", "export")


def f19_dead_assignment(spark, sf_dir):
    name = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("p"), F.col("l_suppkey") % 4))
    calls = _lines(spark, sf_dir, name.alias("name"), ((F.col("l_orderkey") + 1) * 64).alias("until"), "l_partkey")
    uses = _t(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(_span("l_orderkey")[0], F.concat(F.lit("p"), F.col("l_partkey") % 4).alias("name"), (F.col("l_orderkey") * 64 + F.col("l_linenumber") * 8 + 4).alias("start"))
    return names.unused_results(calls, uses, "file").select("l_orderkey", "l_linenumber", "l_partkey", "name")


def f20_platform_calls(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderstatus") == "P", "fetch").when(F.col("o_orderpriority") == "1-URGENT", "Promise").otherwise("other")
    inside = o.select(*_span("o_orderkey"), name.alias("name"))
    file = F.floor(F.col("o_orderkey") / 100)
    imported = o.filter("o_custkey % 97 = 0").select(file.alias("file"), (file * 6400).alias("start"), (file * 6400 + 6400).alias("end"), F.lit("fetch").alias("name"))
    declarations = inside.unionByName(imported)
    calls = _lines(spark, sf_dir, "l_suppkey", _pick(F.col("l_partkey"), "fetch", "window.fetch", "fetcher", "Promise.all", "Promise.race", "fetch.now").alias("callee"))
    fetched = names.platform_calls(calls, declarations, "file", ["fetch", "globalThis.fetch", "window.fetch"], "fetch")
    raced = names.platform_calls(calls, declarations, "file", ["Promise.any", "Promise.race"], "Promise")
    return fetched.unionByName(raced).select("l_orderkey", "l_linenumber", "l_suppkey", "callee")


def _parameters(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "R", "AbortSignal").otherwise("AbortSignals")
    return _lines(spark, sf_dir, F.col("l_orderkey").alias("function"), F.col("l_linenumber").alias("position"), F.concat(F.lit("p"), F.col("l_suppkey") % 3).alias("name"), kind.alias("type"))


def f22_abort_signals(spark, sf_dir):
    x = names.typed_parameters(_parameters(spark, sf_dir), "file", "AbortSignal")
    return x.select(F.col("function").alias("l_orderkey"), F.array_join("names", ",").alias("names"))


def f22_abort_listeners(spark, sf_dir):
    event = F.when(F.col("l_linestatus") == "O", "abort").otherwise("aborted")
    calls = _lines(spark, sf_dir, F.col("l_orderkey").alias("function"), F.concat(F.lit("p"), F.col("l_partkey") % 3, F.lit(".addEventListener")).alias("callee"), event.alias("event"), "l_partkey")
    return names.listener_calls(calls, _parameters(spark, sf_dir), "file", "AbortSignal", "abort").select("l_orderkey", "l_linenumber", "l_partkey")


def j12_lifecycle(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")
    l = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("fs."), "l_returnflag", "l_linestatus").alias("callee"), "l_linenumber")
    return selections.lifecycle_functions(o.select("id"), o.filter("o_orderstatus = 'P'"), l, l.filter("l_linenumber > 5"), r"\.NF\z", r"\.AF\z")


def j17_transaction_escapes(spark, sf_dir):
    source = F.when(F.col("l_returnflag") == "R", "c.query(' begin ')").otherwise("c.query('BEGINNING')")
    l = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("start"), source.alias("source"), F.col("l_suppkey").cast("string").alias("root"), F.col("l_linestatus").alias("receiver"), (F.col("l_quantity") > 10).alias("database"))
    return selections.transaction_escapes(l, "l_orderkey")


def j18_message_dispatch(spark, sf_dir):
    binding = F.when(F.col("o_orderstatus") == "P", "{ message }").otherwise(F.concat(F.lit("e"), F.col("o_custkey") % 3))
    handlers = _t(spark, sf_dir, "orders").select(*_span("o_orderkey"), "o_orderkey", binding.alias("binding"))
    path = F.concat(F.lit("e"), F.col("l_suppkey") % 3, F.when(F.col("l_returnflag") == "N", ".messages").otherwise(".message"))
    return names.reading_member(handlers, _lines(spark, sf_dir, path.alias("path")), "file", "message").select("o_orderkey", "binding")


def j18_members_of_words(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*|\?\.|[^A-Za-z_ \n]"), F.lit(0))
    x = _t(spark, sf_dir, "documents").select("doc_id", words.alias("words"))
    x = x.select("doc_id", F.inline(names.members_within(F.col("words"))))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("paths"), F.min("path").alias("first"), F.max("end").alias("last"))


def k03_explained(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    stage = F.when(F.col("o_orderstatus") == "P", "collect").otherwise("rule")
    kind = _pick(F.col("o_custkey"), "choice", "score", "noul")
    value = F.when(kind == "choice", F.col("o_orderpriority")).otherwise("0.25")
    x = o.select("o_orderkey", stage.alias("stage"), F.concat(F.lit("f"), "o_custkey").alias("filename"), F.lit(3).alias("line"), F.lit(7).alias("column"), F.lit("a/b").alias("rule_id"), selections.decision_summary(kind, value, F.lit(0.5)).alias("answer"), (F.col("o_orderstatus") == "F").alias("diagnostic"), F.lit("m").alias("model"))
    return selections.explained(selections.final_decisions(x)).select("o_orderkey", "text")


def a18_scenario_comparison(spark, sf_dir):
    x = _t(spark, sf_dir, "orders").select(_pick(F.col("o_custkey"), "uncached", "cold", "warm").alias("scenario"), (F.col("o_orderkey") % 100).alias("ms"))
    return metrics.scenario_comparison(x.groupBy("scenario").agg(F.avg("ms").alias("mean"), F.count("*").alias("requests")))


def a19_cache_behaves(spark, sf_dir):
    # Suppliers are asked about in a cycle of runs, the first of them changed for the last.
    t = _t(spark, sf_dir, "supplier")
    least = t.agg(F.min("s_suppkey")).first()[0]
    asked = lambda name: t.select(F.col("s_suppkey").alias("id"), name.alias("payload"), F.sha2(name, 256).alias("key"))
    name = F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string"))
    x = kept(runs.cycle(asked(name), asked(F.when(F.col("s_suppkey") == least, "changed").otherwise(name)), lambda: str.upper).select("scenario", "requests", "cache_hits"))
    n = t.count()
    cases = {"right": (x, n), "fewer": (x, n - 1), "repeated": (x.unionByName(x), n), "missed": (x.withColumn("requests", F.when(F.col("scenario") == "warm", 1).otherwise(F.col("requests"))), n)}
    return reduce(DataFrame.unionByName, [metrics.cache_behaves(c, m).select(F.lit(k).alias("name"), "valid") for k, (c, m) in cases.items()])


def d10_answers(spark, sf_dir):
    key, kind = F.col("o_orderkey"), _pick(F.col("o_custkey"), "choice", "score", "noul")
    labels, share = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM")]), (key % 110) / 100
    expected = F.when(kind == "score", F.array(*[F.lit(x) for x in "012"])).otherwise(labels)
    named = F.when(F.col("o_orderstatus") == "P", F.slice(expected, 1, 2)).otherwise(expected)
    answer = F.struct(F.when(key % 13 == 0, "other").otherwise(kind).alias("type"), F.col("o_orderpriority").alias("choice"), (key % 7 / 2).alias("score"), share.alias("noul"),
        F.when(key % 19 > 0, F.lit(0.5)).alias("confidence"), F.map_from_arrays(named, F.transform(named, lambda _: share)).alias("probabilities"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", decisions.answer_problem(F.when(key % 17 > 0, answer), kind, labels).alias("problem"))


QUERIES = {
    f06_database_call: "SELECT p_partkey, p_partkey % 8 IN (0, 1, 3, 4) OR p_partkey % 8 = 2 AND p_size % 2 = 0 AS found, p_partkey % 8 = 5 AS own FROM part",
    f07_in_iteration: "SELECT p_partkey, p_size > 3 AND (p_partkey % 4 = 0 OR p_partkey % 4 IN (1, 2) AND p_size % 3 = 0) AS within FROM part",
    f14_state_change: "SELECT p_partkey, p_partkey % 6 IN (0, 2) OR p_size % 6 IN (0, 2) AS may FROM part",
    f16_direct_export: "SELECT l_orderkey AS o_orderkey, 'export ' || lower(min(l_returnflag)) AS export FROM lineitem WHERE l_linenumber = 1 AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1",
    f19_dead_assignment: """SELECT l_orderkey, l_linenumber, l_partkey, 'p' || l_suppkey % 4 AS name FROM lineitem c WHERE l_returnflag <> 'N'
 AND NOT EXISTS (SELECT 1 FROM lineitem u WHERE u.l_orderkey = c.l_orderkey AND u.l_linestatus = 'F' AND u.l_partkey % 4 = c.l_suppkey % 4 AND u.l_linenumber >= c.l_linenumber)""",
    f20_platform_calls: """WITH c AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_partkey % 6 WHEN 0 THEN 'fetch' WHEN 1 THEN 'window.fetch' WHEN 3 THEN 'Promise.all' WHEN 4 THEN 'Promise.race' END AS callee, o_orderstatus AS st, o_orderpriority AS pr FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey)
 SELECT l_orderkey, l_linenumber, l_suppkey, callee FROM c WHERE callee = 'window.fetch' OR callee = 'Promise.race' AND (st = 'P' OR pr <> '1-URGENT') OR callee = 'fetch' AND st <> 'P' AND l_orderkey // 100 NOT IN (SELECT o_orderkey // 100 FROM orders WHERE o_custkey % 97 = 0)""",
    f22_abort_signals: """SELECT l_orderkey, string_agg(name, ',' ORDER BY p, name) AS names FROM (SELECT l_orderkey, 'p' || l_suppkey % 3 AS name, min(l_linenumber) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) GROUP BY 1""",
    f22_abort_listeners: "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem c WHERE l_linestatus = 'O' AND EXISTS (SELECT 1 FROM lineitem p WHERE p.l_orderkey = c.l_orderkey AND p.l_returnflag = 'R' AND p.l_suppkey % 3 = c.l_partkey % 3)",
    j12_lifecycle: "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F' AND (l_returnflag = 'N' OR l_returnflag = 'A' AND l_linenumber > 5))",
    j17_transaction_escapes: """WITH b AS (SELECT * FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey::VARCHAR, l_linestatus) = 1)
 SELECT l.l_orderkey, min(b.l_suppkey::VARCHAR) AS binding, count(*) AS n_calls, count(*) FILTER (l.l_linestatus <> b.l_linestatus) AS n_escaped FROM lineitem l JOIN b ON b.l_orderkey = l.l_orderkey
 WHERE l.l_quantity > 10 GROUP BY 1 HAVING count(*) FILTER (l.l_linestatus <> b.l_linestatus) > 0""",
    j18_message_dispatch: """SELECT o_orderkey, 'e' || o_custkey % 3 AS binding FROM orders WHERE o_orderstatus <> 'P' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'N' AND l_suppkey % 3 = o_custkey % 3)""",
    j18_members_of_words: r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|\?\.|[^A-Za-z_ \n]') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS i FROM t),
 l AS (SELECT *, lead(a) OVER d AS b, lead(a, 2) OVER d AS c FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY i))
 SELECT doc_id, count(*) AS n, count(DISTINCT a || '.' || c) AS paths, min(a || '.' || c) AS first, CAST(max(i) + 3 AS INT) AS last FROM l WHERE b IN ('.', '?.') AND regexp_matches(a, '^[$A-Za-z_]') AND regexp_matches(c, '^[$A-Za-z_]') GROUP BY 1""",
    k03_explained: """SELECT o_orderkey, '  f' || o_custkey || ':3:7  a/b  ' || CASE o_custkey % 3 WHEN 0 THEN 'choice=' || o_orderpriority || ' confidence=0.50' WHEN 1 THEN 'score=0.25 confidence=0.50' ELSE 'noul=0.25' END
 || '  ' || CASE WHEN o_orderstatus = 'F' THEN 'diagnostic' ELSE 'accepted' END || '  m' AS text FROM orders WHERE o_orderstatus <> 'P'""",
    a18_scenario_comparison: """WITH m AS (SELECT o_custkey % 3 AS s, avg(o_orderkey % 100) AS mean, count(*) AS n FROM orders GROUP BY 1)
 SELECT max(mean) FILTER (s = 1) / nullif(max(mean) FILTER (s = 0), 0) AS cold_overhead, max(mean) FILTER (s = 0) / nullif(max(mean) FILTER (s = 2), 0) AS warm_speedup,
 max(n) FILTER (s = 0) - max(n) FILTER (s = 2) AS calls_avoided FROM m""",
    a19_cache_behaves: "SELECT unnest(['right', 'fewer', 'repeated', 'missed']) AS name, unnest([n > 1, n = 0, n = 0, n = 0]) AS valid FROM (SELECT count(*) AS n FROM supplier)",
    d10_answers: """SELECT o_orderkey, CASE WHEN k % 17 = 0 THEN 'missing answer' WHEN k % 13 = 0 THEN 'wrong type' WHEN t = 2 THEN CASE WHEN k % 110 > 100 THEN 'invalid noul' END WHEN t = 0 AND o_orderpriority > '4' THEN 'invalid choice' WHEN t = 1 AND k % 7 > 4 THEN 'invalid score'
 WHEN k % 19 = 0 THEN 'invalid confidence' WHEN o_orderstatus = 'P' THEN 'invalid labels' WHEN k % 110 > 100 THEN 'invalid probability' END AS problem FROM (SELECT *, o_orderkey AS k, o_custkey % 3 AS t FROM orders)""",
}
