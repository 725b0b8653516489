"""What names stand for and what rules ask about, on small facts with nulls, ties, empty tables and hot files."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import names
from cairn.plans import fact_rules

FILE = "file string"


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_exports_belong_to_the_function_that_starts_at_their_value(spark):
    f = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 10), (None, 4, 10), ("a", 5, None)], f"{FILE}, id int, start long")
    e = spark.createDataFrame([("a", 10, "export default"), ("a", 10, "export"), ("a", None, "export"), (None, 10, "export"), ("b", 11, "export")], f"{FILE}, target long, words string")
    assert [(r.id, r.export) for r in names.exported(f, e, "file").collect()] == [(1, "export")]
    assert names.exported(f, e.limit(0), "file").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_unused_results_and_scopes_give_what_all_pairs_give(spark, seed):
    r = random.Random(seed)
    calls, uses, scopes = [], [], []
    for i in range(200):
        start = r.randrange(300)
        calls.append((r.choice("aaaaaaab"), i, start, start + r.randrange(1, 9), start + r.randrange(60), r.choice(["x", "y", None]), r.choice(["fetch", "self.fetch", "Promise.all", None])))
        uses.append((r.choice("aaaaaaab"), r.choice(["x", "y", "z", None]), r.choice([r.randrange(360), None])))
    for _ in range(30):
        start = r.randrange(300)
        scopes.append((r.choice(["a", "b", None]), r.choice(["fetch", "Promise", None]), start, start + r.randrange(40)))
    c = spark.createDataFrame(calls, f"{FILE}, id int, start long, end long, until long, name string, callee string")
    u = spark.createDataFrame(uses, f"{FILE}, name string, start long")
    d = spark.createDataFrame(scopes, f"{FILE}, name string, start long, end long")
    got = names.unused_results(c, u, "file")
    assert got.columns == c.columns
    taken = lambda x: any(f == x[0] and n == x[5] and s is not None and x[3] <= s <= x[4] for f, n, s in uses)
    assert ids(got) == [x[1] for x in calls if x[5] and not taken(x)]
    held = lambda x: any(f == x[0] and n == "fetch" and s <= x[2] and x[3] <= e for f, n, s, e in scopes)
    assert ids(names.platform_calls(c, d, "file", ["fetch", "self.fetch"], "fetch")) == [x[1] for x in calls if x[6] == "self.fetch" or x[6] == "fetch" and not held(x)]


def test_typed_parameters_stand_once_by_position(spark):
    p = spark.createDataFrame([("a", 1, 2, "s", "T"), ("a", 1, 0, "t", "T"), ("a", 1, 1, "s", "T"), ("a", 1, 3, None, "T"), ("a", 2, 0, "s", "U"), ("a", 3, 0, "s", None)], f"{FILE}, function int, position int, name string, type string")
    assert [(r.function, r.names) for r in names.typed_parameters(p, "file", "T").collect()] == [(1, ["t", "s"])]
    c = spark.createDataFrame([("a", 1, "s.addEventListener", "abort", 1), ("a", 1, "s.addEventListener", "done", 2), ("a", 2, "s.addEventListener", "abort", 3), ("a", 1, "r.addEventListener", "abort", 4), ("b", 1, "s.addEventListener", "abort", 5), ("a", None, None, None, 6)], f"{FILE}, function int, callee string, event string, id int")
    assert ids(names.listener_calls(c, p, "file", "T", "abort")) == [1]


def test_members_come_from_neighbouring_words(spark):
    words = ["err", "?.", "message", ".", "length", "err", ".", ".", "x", "(", ".", "y"]
    x = spark.createDataFrame([("a", i, w, i * 10, i * 10 + 5) for i, w in enumerate(words)] + [("b", 0, "err", 0, 1), ("b", 2, "message", 2, 3), ("b", 1, None, 1, 2)], f"{FILE}, place int, word string, start long, end long")
    assert sorted((r.path, r.start, r.end) for r in names.members_of(x, "file").collect()) == [("err.message", 0, 25), ("message.length", 20, 45)]


def test_handlers_that_read_rethrow_or_replace(spark):
    h = spark.createDataFrame([("a", 1, 0, 10, "err"), ("a", 2, 20, 30, "err"), ("a", 3, 40, 50, "{ m }"), ("a", 4, 60, 70, None), (None, 5, 0, 10, "err")], f"{FILE}, id int, start long, end long, binding string")
    m = spark.createDataFrame([("a", "err.message", 2, 5), ("a", "err.messages", 22, 25), ("a", "err.message", 28, 31), ("a", "{ m }.message", 42, 43), (None, "err.message", 2, 5)], f"{FILE}, path string, start long, end long")
    assert ids(names.reading_member(h, m, "file", "message")) == [1]
    s = spark.createDataFrame([("a", 1, "throw", "err"), ("a", 2, "throw", "err"), ("a", 2, "throw", "err"), ("a", 3, "throw", "m"), ("a", 4, "throw", None), (None, 5, "throw", "err"), ("a", 9, "throw", "err")], f"{FILE}, handler int, kind string, thrown string")
    calls = s.select("file", "handler").limit(0)
    assert ids(names.rethrowing_only(h, s, calls, "file")) == [1]
    assert names.rethrowing_only(h, s, s.filter("handler = 1"), "file").count() == 0
    assert ids(names.replacing(h, s, "file")) == [3, 4]
    more = s.unionByName(spark.createDataFrame([("a", 1, "throw", None), ("a", 2, "return", "x")], s.schema))
    assert ids(names.replacing(h, more, "file")) == [1, 3, 4] and names.rethrowing_only(h, more, calls, "file").count() == 0


def test_operators_are_told_by_errors_first(spark):
    callees = ["console.error", "appLogger.WARN", "log.trace", "span.addEvent", "Sentry.captureException", "span.setAttribute", "render", "console.errors", None]
    x = spark.createDataFrame([(c,) for c in callees], "callee string").select(fact_rules.call_kind(F.col("callee")))
    assert [r[0] for r in x.collect()] == ["error_log", "log", "diagnostic_log", "telemetry_name", "exception_telemetry", "telemetry", None, None, None]


def test_helpers_calls_count_as_those_of_the_test(spark):
    f = spark.createDataFrame([("a", "t", "test", 5), ("a", "empty", "test", 0), ("a", "huge", "test", 12001), ("a", "h", "function", 5), ("a", None, "test", 5)], f"{FILE}, id string, kind string, size int")
    c = spark.createDataFrame([("a", "h", "Date.now"), ("a", "h", "expect.toThrow"), ("a", "t", "page.sleep"), ("a", "t", None), ("a", "huge", "Date.now")], f"{FILE}, function string, callee string")
    helpers = spark.createDataFrame([("a", "t", "h"), ("a", "t", "h"), ("a", "empty", "h"), ("a", None, "h")], f"{FILE}, id string, function string")
    got = sorted((r.rule_id.split("/")[1], r.id, r.n) for r in fact_rules.tests(f, c, helpers).filter("id IS NOT NULL").collect())
    assert got == [("no-fixed-delay-synchronization", "t", 1), ("no-nondeterministic-tests", "t", 1), ("no-vacuous-tests", "t", 1)]
    assert fact_rules.tests(f.limit(0), c, helpers).count() == 0


def test_every_rule_with_thresholds_is_selected_somewhere(spark):
    from cairn.plans import rule_queries, rules

    sql = " ".join(rule_queries.QUERIES.values())
    missing = [r for r, *_ in rules.RULES if not r.startswith(("comments/", "security/")) and f"'{r}'" not in sql]
    assert missing == []


def test_members_of_a_row_need_no_join(spark):
    from cairn.plans import registry

    words = ["err", "?.", "message", ".", "length", None, ".", "x", "(", ".", "y", "."]
    d = spark.createDataFrame([(1, words), (2, []), (3, None), (4, ["a", "."]), (5, ["a", ".", "b"])], "id int, w array<string>")
    got = {r.id: [tuple(x) for x in r.m or []] for r in d.select("id", names.members_within(F.col("w")).alias("m")).collect()}
    assert got == {1: [("err.message", 0, 3), ("message.length", 2, 5)], 2: [], 3: [], 4: [], 5: [("a.b", 0, 3)]}
    x = registry.queries()["j18_members_of_words"](spark, "/root/testdata/sf0.001")
    assert "Join" not in x._jdf.queryExecution().optimizedPlan().toString()


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize(("query", "most"), [("r_async", 11), ("r_relational", 7), ("r_resources", 8)])
def test_rules_share_the_readings_of_facts(spark, query, most):
    from cairn.plans import registry

    assert scans(registry.queries()[query](spark, "/root/testdata/sf0.001")) <= most


def test_platform_calls_of_several_guards_are_told_in_one_sweep(spark):
    c = spark.createDataFrame([("a", i, 10 * i, 10 * i + 5, x) for i, x in enumerate(["fetch", "Promise.all", "fetch", "Promise.all", "self.fetch", "other", None])], f"{FILE}, id int, start long, end long, callee string")
    d = spark.createDataFrame([("a", "fetch", 0, 12), ("a", "Promise", 25, 40), ("a", None, 0, 90)], f"{FILE}, name string, start long, end long")
    assert ids(names.platform_calls(c, d, "file", {"fetch": ["fetch", "self.fetch"], "Promise": ["Promise.all"]})) == [1, 2, 4]


def test_members_of_other_names_are_not_swept(spark):
    h = spark.createDataFrame([("a", 0, 10, "err")], f"{FILE}, start long, end long, binding string")
    m = spark.createDataFrame([("a", "err.message", 2, 5), ("a", "err.code", 2, 5)], f"{FILE}, path string, start long, end long")
    x = names.reading_member(h, m, "file", "message")
    assert x.count() == 1 and "endswith(path" in x._jdf.queryExecution().analyzed().toString().lower()
