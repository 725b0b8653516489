"""Rules, answers, the cache and metrics over the tables, with their SQL."""

from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import decisions, metrics, sinks
from cairn.plans import rules
from cairn.plans.tables import table as _t
from cairn.sources import reports


def d02_severity(spark, sf_dir):
    x = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_discount") * 10).alias("p"), (F.col("l_tax") * 12).alias("c"))
    p = F.when(F.col("l_orderkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("p"))
    s = decisions.severity(p, F.col("c"), F.lit(0.35), F.lit(0.65), F.lit(0.25))
    return x.select("l_orderkey", "l_linenumber", decisions.capped(s, F.when(F.col("l_returnflag") == "R", "warning").otherwise("error")).alias("severity")).groupBy("l_orderkey", "l_linenumber").agg(F.max("severity").alias("severity"))


def d03_choice_gate(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    m = F.map_from_arrays(F.array(F.lit("O"), F.lit("F")), F.array(F.round(F.col("o_totalprice") / 1000000, 6), F.lit(0.5)))
    return o.select("o_orderkey", decisions.choice_probability(F.lit("choice"), F.col("o_orderstatus"), m, F.when(F.col("o_custkey") % 2 == 0, "O").otherwise("P")).alias("p"))


def j21_resolved_rules(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    sev = F.element_at(F.array(F.lit("warn"), F.lit("error"), F.lit("off"), F.lit("loud")), (F.col("p_partkey") % 4 + 1).cast("int"))
    rule = F.when(F.col("p_partkey") % 9 == 0, F.col("p_brand")).otherwise(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")))
    config = p.select("p_partkey", rule.alias("rule_id"), sev.alias("severity"))
    plugins = p.filter("p_size <= 30").select(F.col("p_brand").alias("namespace"), F.col("p_size").cast("string").alias("name"))
    return decisions.resolved_rules(config, plugins).select("p_partkey", "cap", "problem")


def j22_every_rule(spark, sf_dir):
    x = decisions.with_every_rule(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), [("a/one", "error"), ("a/two", "warning"), ("b/one", "error")])
    return x.groupBy("rule_ord", "rule_id", "cap").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))


def j23_answered(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    answers = _t(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select("c_custkey", F.col("c_mktsegment").alias("answer"))
    return decisions.answered(o, answers, ["c_custkey"]).select("o_orderkey", "answer", "problem")


def _requests(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("state"), "o_orderpriority")
    return o.select("o_orderkey", decisions.cache_key(F.lit("p"), F.col("state"), F.col("o_orderpriority")).alias("key"), "o_orderpriority")


def _cache(spark, sf_dir):
    x = _requests(spark, sf_dir).filter("o_orderkey % 3 = 0")
    return x.select("key", F.concat(F.lit("r"), F.col("o_orderkey")).alias("response"), F.col("o_orderkey").alias("written"))


def x07_cache_key(spark, sf_dir):
    return _requests(spark, sf_dir).select("o_orderkey", "key")


def j28_cache_lookup(spark, sf_dir):
    return decisions.cache_hits(_requests(spark, sf_dir), _cache(spark, sf_dir), "key").select("o_orderkey", "response")


def d06_cache_misses(spark, sf_dir):
    return decisions.cache_misses(_requests(spark, sf_dir), _cache(spark, sf_dir), "key").select("key")


def d08_evaluated(spark, sf_dir):
    def provider():
        def call(x):
            if x.startswith("5"):
                raise ValueError("refused")
            return x[2:]

        return call

    n = _t(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    return decisions.evaluate(n, provider, "o_orderpriority", 4)


def a02_run_stats(spark, sf_dir):
    x = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 3 == 0).alias("cached"), F.when(F.col("o_orderstatus") == "P", "x").alias("error"), F.col("o_custkey").alias("input_tokens"), F.col("o_orderkey").alias("output_tokens"))
    return decisions.run_stats(x)


def w01_question_id(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", decisions.question_id(F.concat_ws("/", "l_returnflag", "l_linestatus"), F.col("l_linenumber")).alias("qid")).distinct()


def _samples(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_orderkey") % 3).alias("repetition"), F.col("o_custkey").alias("input_tokens"), (F.col("o_custkey") * 2).alias("output_tokens"), F.col("o_totalprice").alias("latency"), F.col("o_orderkey").alias("began"), (F.col("o_orderkey") + 5).alias("ended"))


def a07_usage(spark, sf_dir):
    return metrics.usage("o_orderpriority")(_samples(spark, sf_dir))


def a12_repetitions(spark, sf_dir):
    return metrics.repetitions(_samples(spark, sf_dir))


def _graded(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("o_custkey") % len(names) + 1).cast("int"))
    return o.select(
        F.col("o_orderpriority").alias("scope"), (F.col("o_totalprice") > 100000).alias("expected"), F.round("o_totalprice").alias("latency"), pick(["correct", "miss", "unsupported"]).alias("category"),
        pick(["hit", "miss", "false_positive", "correct_rejection", "unsupported"]).alias("status"), pick(["matched", "miss", "error", "matched"]).alias("outcome"), pick(["native", "custom", "unsupported"]).alias("coverage"),
    )


def a13_baseline(spark, sf_dir):
    x = metrics.baseline_report(_graded(spark, sf_dir), "scope")
    return x.withColumn("mean", F.round("mean", 3))


def a14_scanner(spark, sf_dir):
    return metrics.scanner_summary(_graded(spark, sf_dir), "scope")


def a15_scopes(spark, sf_dir):
    return metrics.scope_summary(_graded(spark, sf_dir).select("scope", F.col("outcome").alias("status")))


def a16_capabilities(spark, sf_dir):
    return metrics.capability_recall(_graded(spark, sf_dir).withColumn("found", F.col("expected")), "scope")


def a17_scenarios(spark, sf_dir):
    x = _t(spark, sf_dir, "events").select(F.col("event_type").alias("scenario"), "value", F.length("event_type").alias("requests"), (F.col("event_id") % 2).alias("cache_hits"))
    return metrics.scenario_summary(x, "value", "requests", "cache_hits").withColumn("mean", F.round("mean", 6))


def a20_corpus_problems(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("rule_id"), (F.col("c_acctbal") > 9000).alias("expected"))
    return metrics.corpus_problems(c, _t(spark, sf_dir, "nation").filter("n_nationkey <> 3").select(F.col("n_nationkey").cast("string").alias("rule_id")))


def a21_abstained(spark, sf_dir):
    x = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linestatus").alias("c"))
    return x.select("l_orderkey", metrics.abstained(F.col("c"), "O").alias("abstained"))


def a22_accepted(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    ok = metrics.accepted(F.col("o_custkey") % 5, [(F.col("o_orderstatus"), F.lit("O"))], (F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice") > 100000), F.lit(True)))
    return o.select("o_orderkey", ok.alias("accepted"))


def x03_halves(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.bounded_halves(F.col("text"), 40, "\n[cut]\n").alias("t"), text.nearby(F.col("text"), F.lit(30), F.lit(35), 20).alias("near"))


def e27_location(spark, sf_dir):
    x = _t(spark, sf_dir, "documents").select("doc_id", text.line_and_column(F.col("text"), F.length("text")).alias("at"))
    return x.select("doc_id", "at.line", "at.column")


def f09_sql_structure(spark, sf_dir):
    q = F.concat(F.lit("SELECT 'limit ''x' -- order by\nFROM t "), F.when(F.col("p_size") > 20, F.concat(F.lit("LIMIT "), F.col("p_size"))).otherwise(F.lit("/* offset 3 */")), F.when(F.col("p_partkey") % 2 == 0, " Order  By a").otherwise(""))
    return _t(spark, sf_dir, "part").select("p_partkey", text.paginated(q).alias("paginated"), text.ordered(q).alias("ordered"))


def parsed_findings(o):
    start = F.struct(F.when(F.col("o_custkey") % 6 != 0, (F.col("o_custkey") % 90).cast("int")).alias("line"))
    result = F.struct(F.col("o_orderstatus").alias("check_id"), F.col("o_orderpriority").alias("path"), start.alias("start"))
    json = F.to_json(F.struct(F.lit("1").alias("version"), F.array(result).alias("results"), F.array().cast("array<string>").alias("errors")))
    x = reports.findings(o.select("o_orderkey", F.when(F.col("o_custkey") % 8 == 1, F.lit('{"results": []}')).otherwise(json).alias("json")), "json")
    return x.select("o_orderkey", "check_id", "path", "line", "problem")


def s10_drift(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("source"), "p_partkey")
    manifest = p.filter("p_partkey % 7 <> 0").select("id", F.sha2(F.when(F.col("p_partkey") % 5 == 0, F.lit("old")).otherwise(F.col("source")), 256).alias("sha256"))
    return reports.drift(p.filter("p_partkey % 11 <> 0"), manifest)


def k01_stylish(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")
    x = l.select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("column"), F.lit("warning").alias("severity"), F.col("l_returnflag").alias("message"), (F.floor("l_quantity") / 64).alias("probability"), F.lit("a/b").alias("rule_id"))
    return sinks.stylish(x).select("text")


_GRADE = """(SELECT o_orderpriority AS scope, o_totalprice > 100000 AS expected, round(o_totalprice) AS latency, ['correct', 'miss', 'unsupported'][o_custkey % 3 + 1] AS category,
 ['hit', 'miss', 'false_positive', 'correct_rejection', 'unsupported'][o_custkey % 5 + 1] AS status, ['matched', 'miss', 'error', 'matched'][o_custkey % 4 + 1] AS outcome FROM orders)"""
_KEY = "sha256('1:1' || '1:p' || length(CAST(o_custkey AS VARCHAR)) || ':' || o_custkey || length(o_orderpriority) || ':' || o_orderpriority)"

QUERIES = {
    d02_severity: """SELECT l_orderkey, l_linenumber, max(CASE WHEN l_orderkey % 11 = 0 OR l_tax * 12 < 0.25 OR l_discount * 10 < 0.35 THEN NULL WHEN l_discount * 10 >= 0.65 AND l_returnflag <> 'R' THEN 'error' ELSE 'warning' END) AS severity
 FROM lineitem GROUP BY 1, 2""",
    d03_choice_gate: "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_custkey % 2 = 0 THEN round(o_totalprice / 1000000, 6) WHEN o_orderstatus = 'P' AND o_custkey % 2 = 1 THEN 0 END AS p FROM orders",
    j21_resolved_rules: """WITH q AS (SELECT DISTINCT p_brand AS ns, CAST(p_size AS VARCHAR) AS name FROM part WHERE p_size <= 30),
 x AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'syntax' WHEN p_brand NOT IN (SELECT ns FROM q) THEN 'no plugin' WHEN (p_brand, CAST(p_size AS VARCHAR)) NOT IN (SELECT (ns, name) FROM q) THEN 'no rule'
 WHEN p_partkey % 4 = 3 THEN 'configuration' END AS problem FROM part)
 SELECT p_partkey, CASE WHEN problem IS NULL THEN ['warning', 'error', NULL, NULL][p_partkey % 4 + 1] END AS cap, problem FROM x""",
    j22_every_rule: """SELECT i AS rule_ord, r AS rule_id, c AS cap, count(*) AS "rows", sum(o_orderkey)::BIGINT AS keys FROM orders, (VALUES (0, 'a/one', 'error'), (1, 'a/two', 'warning'), (2, 'b/one', 'error')) AS v(i, r, c) GROUP BY 1, 2, 3""",
    j23_answered: "SELECT o_orderkey, c_mktsegment AS answer, CASE WHEN c_custkey IS NULL THEN 'missing answer' END AS problem FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 <> 0",
    x07_cache_key: f"SELECT o_orderkey, {_KEY} AS key FROM orders",
    j28_cache_lookup: """SELECT o.o_orderkey, (SELECT 'r' || max(c.o_orderkey) FROM orders c WHERE c.o_custkey = o.o_custkey AND c.o_orderpriority = o.o_orderpriority AND c.o_orderkey % 3 = 0) AS response FROM orders o""",
    d06_cache_misses: f"SELECT DISTINCT {_KEY} AS key FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders c WHERE c.o_custkey = o.o_custkey AND c.o_orderpriority = o.o_orderpriority AND c.o_orderkey % 3 = 0)",
    d08_evaluated: "SELECT DISTINCT o_orderpriority, CASE WHEN o_orderpriority NOT LIKE '5%' THEN substr(o_orderpriority, 3) END AS response, CASE WHEN o_orderpriority LIKE '5%' THEN 'refused' END AS error FROM orders",
    a02_run_stats: """SELECT count(*) FILTER (o_custkey % 3 <> 0) AS requests, count(*) FILTER (o_custkey % 3 = 0) AS cache_hits,
 coalesce(sum(o_custkey) FILTER (o_custkey % 3 <> 0 AND o_orderstatus <> 'P'), 0)::BIGINT AS input_tokens, coalesce(sum(o_orderkey) FILTER (o_custkey % 3 <> 0 AND o_orderstatus <> 'P'), 0)::BIGINT AS output_tokens FROM orders""",
    w01_question_id: "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag || '_' || l_linestatus || '_' || l_linenumber AS qid FROM lineitem",
    a07_usage: """SELECT o_orderpriority, sum(o_custkey)::BIGINT AS input_tokens, sum(2 * o_custkey)::BIGINT AS output_tokens, count(DISTINCT o_orderkey % 3) AS repetitions,
 sum(o_custkey) / count(DISTINCT o_orderkey % 3) AS input_tokens_each, sum(2 * o_custkey) / count(DISTINCT o_orderkey % 3) AS output_tokens_each FROM orders GROUP BY 1""",
    a12_repetitions: """SELECT o_orderkey % 3 AS repetition, count(*) AS cases, max(o_orderkey) + 5 - min(o_orderkey) AS seconds, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95,
 count(*) / (max(o_orderkey) + 5 - min(o_orderkey)) AS cases_a_second FROM orders GROUP BY 1""",
    a13_baseline: f"""SELECT *, CASE WHEN applicable > 0 THEN correct / applicable END AS correctness, CASE WHEN positives > 0 THEN found / positives END AS recall FROM (SELECT scope, count(*) FILTER (category <> 'unsupported') AS applicable,
 count(*) FILTER (category = 'correct') AS correct, count(*) FILTER (category = 'unsupported') AS unsupported, count(*) FILTER (category <> 'unsupported' AND expected) AS positives, count(*) FILTER (category = 'correct' AND expected) AS found,
 round(avg(latency) FILTER (category <> 'unsupported'), 3) AS mean, quantile_disc(latency, 0.95) FILTER (category <> 'unsupported') AS p95 FROM {_GRADE} GROUP BY 1)""",
    a14_scanner: f"""SELECT *, CASE WHEN supported > 0 THEN correct / supported END AS accuracy, CASE WHEN expected_issues > 0 THEN detected / expected_issues END AS recall FROM (SELECT scope, count(*) FILTER (status <> 'unsupported') AS supported,
 count(*) FILTER (status IN ('hit', 'correct_rejection')) AS correct, count(*) FILTER (status = 'miss') AS misses, count(*) FILTER (status = 'false_positive') AS false_positives, count(*) FILTER (status <> 'unsupported' AND expected) AS expected_issues,
 count(*) FILTER (status = 'hit') AS detected, count(*) FILTER (status = 'unsupported') AS unsupported FROM {_GRADE} GROUP BY 1)""",
    a15_scopes: f"""SELECT *, CASE WHEN matched + misses > 0 THEN matched / (matched + misses) END AS accuracy FROM (SELECT scope, count(*) FILTER (outcome = 'matched') AS matched, count(*) FILTER (outcome = 'miss') AS misses,
 count(*) FILTER (outcome = 'error') AS errors FROM {_GRADE} GROUP BY 1)""",
    a16_capabilities: """SELECT *, CASE WHEN applicable > 0 THEN detected / applicable ELSE 0 END AS recall FROM (SELECT o_orderpriority AS scope, count(*) FILTER (o_custkey % 3 <> 2) AS applicable,
 count(*) FILTER (o_custkey % 3 <> 2 AND o_totalprice > 100000) AS detected FROM orders GROUP BY 1)""",
    a17_scenarios: """SELECT event_type AS scenario, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, CAST(length(event_type) AS INT) AS requests, min(event_id % 2) AS cache_hits,
 min(event_id % 2) = max(event_id % 2) AS consistent FROM events GROUP BY event_type""",
    a20_corpus_problems: """WITH f AS (SELECT CAST(c_custkey % 100 AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS r, c_acctbal > 9000 AS e FROM customer), n AS (SELECT CAST(n_nationkey AS VARCHAR) AS r FROM nation WHERE n_nationkey <> 3)
 SELECT id, 'repeated' AS problem FROM f GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'unknown rule' FROM f WHERE r NOT IN (SELECT r FROM n)
 UNION ALL SELECT r, 'no positive' FROM n WHERE r NOT IN (SELECT r FROM f WHERE e) UNION ALL SELECT r, 'no negative' FROM n WHERE r NOT IN (SELECT r FROM f WHERE NOT e)""",
    a21_abstained: "SELECT l_orderkey, bool_and(l_linestatus = 'O') AS abstained FROM lineitem GROUP BY 1",
    a22_accepted: "SELECT o_orderkey, o_custkey % 5 = 0 AND o_orderstatus = 'O' AND (o_custkey % 2 <> 0 OR o_totalprice > 100000) AS accepted FROM orders",
    x03_halves: "SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE left(text, 20) || chr(10) || '[cut]' || chr(10) || right(text, 20) END AS t, substr(text, 11, 45) AS near FROM documents",
    e27_location: """SELECT doc_id, CAST(length(p) - length(replace(p, chr(10), '')) + 1 AS INT) AS line, CAST(length(p) - coalesce(length(regexp_extract(p, '(?s)^(.*\\n)', 1)), 0) + 1 AS INT) AS "column"
 FROM (SELECT doc_id, text AS p FROM documents)""",
    f09_sql_structure: "SELECT p_partkey, p_size > 20 AS paginated, p_partkey % 2 = 0 AS ordered FROM part",
    s10_drift: """SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 11 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'unexpected' ELSE 'changed' END AS problem FROM part
 WHERE (p_partkey % 11 = 0) <> (p_partkey % 7 = 0) OR (p_partkey % 5 = 0 AND p_partkey % 11 <> 0 AND p_partkey % 7 <> 0)""",
    k01_stylish: "SELECT l_orderkey || ':' || l_linenumber || '  warning  ' || l_returnflag || ' (' || CAST(floor(floor(l_quantity) / 64 * 100 + 0.5) AS BIGINT) || '%)  a/b' AS text FROM lineitem",
}


def r_comment_rules(spark, sf_dir):
    x = rules.comment_candidates(_t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value")))
    return x.select("doc_id", "rule_id")


def r_diagnostics(spark, sf_dir):
    x = rules.comment_candidates(_t(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("value"))).withColumn("t", rules.thresholds(F.col("rule_id")))
    p = (F.col("conv_id") % 13 + F.col("turn")) / 16
    found = decisions.severity(p, F.lit(0.8), F.col("t.warn"), F.col("t.error"), F.col("t.confidence"))
    return x.select("conv_id", "turn", "rule_id", "t.finding", found.alias("severity")).filter("severity IS NOT NULL").distinct()


_BARE = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_IGNORED = rules.IGNORED.replace("{tool}", "cairn").replace("\\A", "^")
_CANDIDATES = f"""SELECT @ids, unnest(list_filter([CASE WHEN plain THEN 'comments/no-useless-comments' END, CASE WHEN seen THEN 'comments/no-misleading-comments' END, CASE WHEN seen THEN 'comments/no-commented-out-code' END,
 CASE WHEN plain AND ({" OR ".join(f"regexp_matches(v, '{p}')" for p in rules.HISTORY)}) THEN 'comments/no-change-history-comments' END, CASE WHEN plain AND length(b) >= 100 THEN 'comments/prefer-concise-comments' END,
 CASE WHEN todo THEN 'comments/require-actionable-todos' END, CASE WHEN regexp_matches(v, '{rules.SUPPRESSION.replace("{tool}", "cairn")}') THEN 'comments/require-justified-suppressions' END,
 CASE WHEN old THEN 'comments/require-actionable-deprecations' END], lambda x: x IS NOT NULL)) AS rule_id FROM (SELECT *, length(b) >= 8 AND NOT ignored AND NOT todo AND NOT old AS plain, length(b) > 0 AND NOT ignored AND NOT todo AS seen
 FROM (SELECT *, regexp_matches(b, '{_IGNORED}') AS ignored, regexp_matches(v, '{rules.TODO}') AS todo, regexp_matches(v, '{rules.DEPRECATED}') AS old FROM (SELECT *, text AS v, {_BARE} AS b FROM @table)))"""
_THRESHOLDS = ", ".join(f"('{r}', '{f}', {w}, {e})" for r, f, w, e, _ in rules.RULES)

QUERIES |= {
    r_comment_rules: _CANDIDATES.replace("@ids", "doc_id").replace("@table", "documents"),
    r_diagnostics: f"""SELECT DISTINCT conv_id, turn, c.rule_id, finding, CASE WHEN (conv_id % 13 + turn) / 16 >= e THEN 'error' ELSE 'warning' END AS severity
 FROM ({_CANDIDATES.replace("@ids", "conv_id, turn").replace("@table", "conversations")}) c JOIN (VALUES {_THRESHOLDS}) t(rule_id, finding, w, e) ON t.rule_id = c.rule_id WHERE (conv_id % 13 + turn) / 16 >= w""",
}
