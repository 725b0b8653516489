"""Selections over facts, manifests and run reductions, over whole tables, with their SQL. The SQL states patterns and limits itself."""

from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import evidence, facts, names
from cairn.plans.tables import table as _t
from cairn.sources import reports

NOW = 1_445_412_480_000


def _spans(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k"), F.col("o_orderkey").alias("id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("start"), F.floor("o_totalprice").alias("len"), "o_orderstatus", "o_orderpriority", "o_custkey")
    return o.withColumn("end", F.col("start") + F.when(F.col("o_orderstatus") == "F", F.col("len") * 60).otherwise(F.col("len")))


def j09_retry_loops(spark, sf_dir):
    o = _spans(spark, sf_dir)
    name = F.array(F.concat(F.lit("v"), F.col("id") % 3))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "for-of").when(F.col("o_orderpriority") == "2-HIGH", "for-in").otherwise("while")
    loops = o.filter("o_orderstatus = 'F'").select("k", "id", "start", "end", kind.alias("kind"), F.when(F.col("o_custkey") % 4 > 0, name).otherwise(F.array().cast("array<string>")).alias("bindings"))
    catches = o.filter("o_orderstatus = 'P'").select("k", "id", "start", "end")
    calls = o.filter("o_orderstatus = 'O'").select("k", "id", "start", "end", name.alias("references"))
    return facts.retry_loops(loops, catches, calls, "k")


def j19_duplicate_reports(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("log."), "l_returnflag").alias("callee"), F.array("l_linestatus", F.lit("x")).alias("references"), F.lit("F").alias("binding"))
    return facts.duplicate_reports(l, "l_orderkey", r"\Alog\.[RA]\z")


def f04_selected_functions(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "module").otherwise("function").alias("kind"), F.lit(0).alias("start"), F.col("o_orderpriority").alias("source"))
    calls = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("callee"), F.col("l_linenumber").cast("int").alias("start"))
    x = facts.selected_functions(o, calls, r"\A(?:R|N)\z", 7)
    return x.select("id", F.array_join(F.transform("evidence", lambda e: F.concat(e["start"], e["callee"])), ",").alias("evidence"))


def _handlers(spark, sf_dir):
    """Orders as handlers in files of 1000, a few without a plain binding; their lines as statements, calls and throws."""
    file = lambda c: F.floor(F.col(c) / 1000).alias("file")
    binding = F.when(F.col("o_orderstatus") == "P", "{ code }").when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("e"), F.col("o_custkey") % 3))
    handlers = _t(spark, sf_dir, "orders").select(file("o_orderkey"), F.col("o_orderkey").alias("id"), binding.alias("binding"))
    kind = F.when(F.col("l_returnflag") == "R", "throw").when(F.col("l_returnflag") == "A", "return").otherwise("expression")
    thrown = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), F.concat(F.lit("e"), F.col("l_suppkey") % 3))
    return handlers, _t(spark, sf_dir, "lineitem").select(file("l_orderkey"), F.col("l_orderkey").alias("handler"), kind.alias("kind"), thrown.alias("thrown"), "l_quantity")


def f17_rethrow_only(spark, sf_dir):
    handlers, lines = _handlers(spark, sf_dir)
    return names.rethrowing_only(handlers, lines, lines.filter("l_quantity > 30"), "file").select("id", "binding")


def f18_replacement_throw(spark, sf_dir):
    handlers, lines = _handlers(spark, sf_dir)
    return names.replacing(handlers, lines, "file").select("id", "binding")


def x13_without_comments(spark, sf_dir):
    source = F.concat(F.lit("\t// "), "p_name", F.lit(" /* open\nthrow e; "), "p_brand", F.lit(" /* "), "p_type", F.lit("\n// */ end // */\r\n"))
    return _t(spark, sf_dir, "part").select("p_partkey", text.without_comments(source).alias("code"))


def x21_retry_delay(spark, sf_dir):
    k = F.col("o_custkey") % 4
    header = F.when(k == 0, F.concat(F.lit(" "), F.col("o_custkey"), F.lit(".5"))).when(k == 1, F.lit("Wed, 21 Oct 2015 07:28:10 GMT")).when(k == 2, F.lit("soon"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", facts.retry_delay_ms(header, F.col("o_orderkey") % 5, F.lit(NOW), F.lit(0.5)).alias("ms"))


def o03_ordered_facts(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.floor("l_quantity").alias("start"), F.col("l_linenumber").alias("ord"), "l_returnflag")).alias("f"))
    return l.select("l_orderkey", F.array_join(F.transform(facts.ordered_facts(F.col("f")), lambda f: F.concat(f["ord"], f["l_returnflag"])), ",").alias("ordered"))


def x15_lengths_and_equality(spark, sf_dir):
    o = _spans(spark, sf_dir)
    return o.select("id", facts.range_length(F.col("start"), F.col("end")).alias("n"), facts.arrays_equal(F.array("o_orderstatus", F.lit("P")), F.array(F.lit("F"), F.substring("o_orderpriority", 1, 1))).alias("first"), facts.arrays_equal(F.array("o_orderstatus"), F.array(F.lit("F"))).alias("same"))


def k07_exit_codes(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    cases = [(F.col("o_orderstatus") == "X", "1-URGENT"), (F.col("o_orderstatus") == "P", "1-URGENT"), (F.col("o_orderstatus") == "X", "none")]
    made = [facts.exit_code(o, bad, F.when(F.col("o_orderpriority") == level, "error").otherwise("warning")) for bad, level in cases]
    return facts.concatenated(made)


def u02_id_differences(spark, sf_dir):
    d, l = _t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels").select("doc_id")
    return facts.id_differences(d, l, "doc_id")


def u04_distinct_sorted(spark, sf_dir):
    return facts.distinct_sorted(_t(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", F.array_join("values", ",").alias("types"))


def a25_cache_storage(spark, sf_dir):
    return facts.cache_storage(_t(spark, sf_dir, "documents"), "text")


def a11_benchmark_summary(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("repetition"), F.col("o_orderpriority").alias("model"), (F.col("o_orderstatus") == "F").alias("accepted"), F.col("o_orderkey").alias("began"), (F.col("o_orderkey") + 5).alias("ended"))
    x = facts.benchmark_summary(o, 10)
    return x.withColumn("throughput", F.round("throughput", 9))


def s06_corpus(spark, sf_dir):
    p = F.struct(F.concat(F.lit("c"), "p_partkey").alias("id"), F.lit("f.ts").alias("filename"), F.col("p_name").alias("source"), F.when(F.col("p_size") > 5, "why").alias("rationale"), F.lit("a/b").alias("rule_id"), (F.col("p_size") > 25).alias("expected_finding"), F.when(F.col("p_partkey") % 2 == 0, 2).alias("expected_candidates"), F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("own"))).alias("expected_choices"), F.array(F.lit("t")).alias("tags"))
    corpus = F.concat(F.lit('{"default_expected_candidates":1,"rule_choices":{"a/b":{"finding":"bad","safe":"good"}},"fixtures":['), F.to_json(p), F.lit("]}"))
    x = reports.fixtures(_t(spark, sf_dir, "part").select("p_partkey", corpus.alias("json")), "json")
    return x.select("p_partkey", "id", "expected_candidates", F.array_join("expected_choices", ",").alias("choices"), "problem")


def s08_case_mappings(spark, sf_dir):
    e = F.struct(F.col("p_brand").alias("id"), F.lit("h").alias("sourceSha256"), F.when(F.col("p_size") > 25, "benchmark_owned").when(F.col("p_size") > 10, "unsupported").otherwise("other").alias("coverage"), F.when(F.col("p_partkey") % 2 == 0, "r").alias("ruleId"), F.when(F.col("p_partkey") % 3 == 0, "why").alias("reason"))
    json = F.to_json(F.struct(F.when(F.col("p_partkey") % 7 == 0, 2).otherwise(1).alias("schemaVersion"), F.array(e).alias("fixtures")))
    return reports.case_mappings(_t(spark, sf_dir, "part").select("p_partkey", json.alias("json")), "json").select("p_partkey", "id", "coverage", "problem")


def s09_scope_manifest(spark, sf_dir):
    e = F.struct(F.lit("same").alias("id"), F.lit("h").alias("sourceSha256"), F.when(F.col("p_size") > 25, "native").otherwise("odd").alias("scope"), F.lit("why").alias("reason"))
    other = F.struct(F.when(F.col("p_partkey") % 2 == 0, "same").otherwise("two").alias("id"), F.lit("h").alias("sourceSha256"), F.lit("custom").alias("scope"), F.lit("why").alias("reason"))
    json = F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.when(F.col("p_partkey") % 7 > 0, "c").alias("corpus"), F.lit("p").alias("pinnedFixtureList"), F.lit("s").alias("officialSuite"), F.array(e, other).alias("cases")))
    return reports.scope_manifest(_t(spark, sf_dir, "part").select("p_partkey", json.alias("json")), "json").select("p_partkey", "id", "scope", "problem")


def a23_unique_by_range(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select("l_partkey", F.floor("l_quantity").alias("start"), F.floor(F.col("l_quantity") + F.col("l_linenumber")).alias("end"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"))
    return evidence.unique_by_range(l, "l_partkey", "ord")


_SPANS = """o AS (SELECT o_custkey % 50 AS k, o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) AS s, CAST(epoch(o_orderdate) AS BIGINT) + CAST(floor(o_totalprice) AS BIGINT) * CASE WHEN o_orderstatus = 'F' THEN 60 ELSE 1 END AS e,
 o_orderstatus AS st, o_orderpriority AS pr, o_custkey AS c FROM orders)"""
_HANDLERS = "(SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN '{ code }' WHEN o_orderpriority <> '5-LOW' THEN 'e' || o_custkey % 3 END AS binding FROM orders)"

QUERIES = {
    j09_retry_loops: f"""WITH {_SPANS}, held AS (SELECT DISTINCT l.* FROM o l JOIN o c ON c.k = l.k AND c.st = 'P' AND l.s <= c.s AND l.e >= c.e WHERE l.st = 'F' AND l.pr <> '2-HIGH'),
 free AS (SELECT * FROM o f WHERE st = 'O' AND NOT EXISTS (SELECT 1 FROM o c WHERE c.k = f.k AND c.st = 'P' AND c.s <= f.s AND c.e >= f.e))
 SELECT k, id FROM held h WHERE pr <> '1-URGENT' OR c % 4 = 0 OR EXISTS (SELECT 1 FROM free f WHERE f.k = h.k AND h.s <= f.s AND h.e >= f.e AND f.id % 3 <> h.id % 3)""",
    j19_duplicate_reports: "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linestatus = 'F' GROUP BY 1 HAVING count(*) >= 2",
    f04_selected_functions: """SELECT o_orderkey AS id, string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS evidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey
 WHERE o_orderstatus <> 'P' AND length(o_orderpriority) BETWEEN 1 AND 7 AND l_returnflag IN ('R', 'N') GROUP BY 1""",
    f17_rethrow_only: f"""SELECT id, binding FROM {_HANDLERS} JOIN lineitem ON l_orderkey = id WHERE binding LIKE 'e%' GROUP BY id, binding
 HAVING count(*) = 1 AND bool_and(l_returnflag = 'R' AND l_linestatus = 'O' AND 'e' || l_suppkey % 3 = binding) AND max(l_quantity) <= 30""",
    f18_replacement_throw: f"""SELECT id, binding FROM {_HANDLERS} JOIN lineitem ON l_orderkey = id WHERE l_returnflag = 'R' GROUP BY id, binding
 HAVING bool_or(l_linestatus <> 'O' OR binding IS NULL OR binding NOT LIKE 'e%' OR 'e' || l_suppkey % 3 <> binding)""",
    x13_without_comments: "SELECT p_partkey, 'throw e; ' || p_brand || '  end' AS code FROM part",
    x21_retry_delay: """SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN (o_custkey + 0.5) * 1000.0 WHEN 1 THEN 10000.0 ELSE 250.0 * 2.0 ** (o_orderkey % 5) + 50.0 END::DOUBLE AS ms FROM orders""",
    o03_ordered_facts: "SELECT l_orderkey, string_agg(l_linenumber || l_returnflag, ',' ORDER BY floor(l_quantity), l_linenumber, l_returnflag) AS ordered FROM lineitem GROUP BY 1",
    x15_lengths_and_equality: f"WITH {_SPANS} SELECT id, e - s AS n, st = 'F' AND substr(pr, 1, 1) = 'P' AS first, st = 'F' AS same FROM o",
    k07_exit_codes: """SELECT 0 AS part, 1 AS exit_code UNION ALL SELECT 1, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 2 ELSE 1 END FROM orders UNION ALL SELECT 2, 0""",
    u02_id_differences: """SELECT doc_id, 'missing' AS problem FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) WHERE doc_id IS NOT NULL
 UNION ALL SELECT doc_id, 'unexpected' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) WHERE doc_id IS NOT NULL""",
    u04_distinct_sorted: "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1",
    a25_cache_storage: "SELECT count(*) AS entries, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents",
    a11_benchmark_summary: """WITH s AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS ok, max(o_orderkey) + 5 - min(o_orderkey) AS ms FROM orders GROUP BY o_custkey % 3)
 SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(ok) AS BIGINT) AS passed, CAST(sum(n) - sum(ok) AS BIGINT) AS failed, round(10000 / avg(ms), 9) AS throughput, (SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders) AS models FROM s""",
    s06_corpus: """SELECT p_partkey, 'c' || p_partkey AS id, n AS expected_candidates, CASE WHEN own THEN 'own' WHEN n = 2 THEN l || ',' || l ELSE l END AS choices, CASE WHEN p_size <= 5 THEN 'incomplete' WHEN own AND n <> 1 THEN 'choices' END AS problem
 FROM (SELECT p_partkey, p_size, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n, p_partkey % 3 = 0 AS own, CASE WHEN p_size > 25 THEN 'bad' ELSE 'good' END AS l FROM part)""",
    s08_case_mappings: """SELECT p_partkey, CASE WHEN ok THEN p_brand END AS id, CASE WHEN ok THEN CASE WHEN p_size > 25 THEN 'benchmark_owned' WHEN p_size > 10 THEN 'unsupported' ELSE 'other' END END AS coverage,
 CASE WHEN NOT ok THEN 'manifest' WHEN p_size > 25 AND p_partkey % 2 = 0 OR p_size BETWEEN 11 AND 25 AND p_partkey % 3 = 0 THEN NULL ELSE 'entry' END AS problem FROM (SELECT *, p_partkey % 7 <> 0 AS ok FROM part)""",
    s09_scope_manifest: """SELECT p_partkey, NULL::VARCHAR AS id, NULL::VARCHAR AS scope, 'manifest' AS problem FROM part WHERE p_partkey % 7 = 0
 UNION ALL SELECT p_partkey, 'same', CASE WHEN p_size > 25 THEN 'native' ELSE 'odd' END, CASE WHEN p_size <= 25 THEN 'entry' WHEN p_partkey % 2 = 0 THEN 'repeated' END FROM part WHERE p_partkey % 7 <> 0
 UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'same' ELSE 'two' END, 'custom', CASE WHEN p_partkey % 2 = 0 THEN 'repeated' END FROM part WHERE p_partkey % 7 <> 0""",
    a23_unique_by_range: 'SELECT l_partkey, floor(l_quantity)::BIGINT AS start, floor(l_quantity + l_linenumber)::BIGINT AS "end", min(l_orderkey * 8 + l_linenumber) AS ord FROM lineitem GROUP BY ALL',
}
