"""Runs with a cache, answers and routes on small tables with nulls, repeats and empty sides."""

import json

from pyspark.sql import functions as F

from cairn.operators import decisions, routes, runs

REQUEST = "id int, key string, payload string"


def test_runs_ask_once_and_keep_no_failure(spark):
    def provider():
        def call(x):
            if x == "bad":
                raise ValueError("refused")
            return x.upper()

        return call

    rows = [(1, "a", "one"), (2, "a", "one"), (3, "b", "bad"), (4, None, "one"), (5, None, "two"), (6, None, "two"), (7, "c", None)]
    requests = spark.createDataFrame(rows, REQUEST)
    empty = spark.createDataFrame([], "key string, response string")
    first = runs.run(requests, empty, provider)
    got = {r.id: (r.response, r.error) for r in first.answers.collect()}
    assert got == {1: ("ONE", None), 2: ("ONE", None), 3: (None, "refused"), 4: ("ONE", None), 5: ("TWO", None), 6: ("TWO", None), 7: (None, "no payload")}
    assert [tuple(r) for r in first.cache.collect()] == [("a", "ONE")]
    s = first.sample.first()
    assert (s.requests, s.failed, s.cache_hits, s.entries, s.bytes) == (5, 2, 0, 1, 3)
    s = runs.run(requests, first.cache.unionByName(first.cache), provider).sample.first()
    assert (s.requests, s.failed, s.cache_hits, s.entries) == (4, 2, 1, 1)
    s = runs.run(requests.limit(0), empty, provider).sample.first()
    assert (s.requests, s.failed, s.cache_hits, s.entries, s.bytes) == (0, 0, 0, 0, 0)


def test_answers_must_fit_their_question(spark):
    answer = "a struct<type: string, choice: string, score: double, noul: double, confidence: double, probabilities: map<string, double>>, kind string, labels array<string>"
    good, both = {"x": 0.5, "y": 0.5}, ["x", "y"]
    cases = [
        (("choice", "x", None, None, 0.5, good), "choice", both, None), (None, "choice", both, "missing answer"), (("score", "x", None, None, 0.5, good), "choice", both, "wrong type"), (("odd", "x", None, None, 0.5, good), "odd", both, "wrong type"),
        (("choice", "z", None, None, 0.5, good), "choice", both, "invalid choice"), (("choice", None, None, None, 0.5, good), "choice", both, "invalid choice"), (("choice", "x", None, None, float("nan"), good), "choice", both, "invalid confidence"),
        (("choice", "x", None, None, 0.5, {"x": 1.0}), "choice", both, "invalid labels"), (("choice", "x", None, None, 0.5, None), "choice", both, "invalid labels"), (("choice", "x", None, None, 0.5, {"x": 1.5, "y": 0.0}), "choice", both, "invalid probability"),
        (("score", None, 0.5, None, 0.5, {"0": 0.5, "1": 0.5}), "score", both, None), (("score", None, 1.5, None, 0.5, {"0": 0.5, "1": 0.5}), "score", both, "invalid score"), (("score", None, float("nan"), None, 0.5, {}), "score", both, "invalid score"),
        (("score", None, 0.0, None, 0.5, {}), "score", [], "invalid score"), (("noul", None, None, 1.0, None, None), "noul", None, None), (("noul", None, None, None, None, None), "noul", both, "invalid noul"),
    ]
    x = spark.createDataFrame([c[:3] for c in cases], answer).select(decisions.answer_problem(F.col("a"), F.col("kind"), F.col("labels")).alias("p"))
    assert [r.p for r in x.coalesce(1).collect()] == [c[3] for c in cases]


def test_routes_need_a_receiver_a_path_and_a_handler(spark):
    imports = spark.createDataFrame([("a", "f", "fastify", "default"), ("a", "e", "express", "*"), ("b", "R", "express", "Router"), ("b", "f", "koa", "default"), (None, "f", "fastify", "default")], "file string, local string, module string, imported string")
    made = spark.createDataFrame([("a", "app", 1, "f"), ("a", "app", 9, "e"), ("a", "api", 5, "e"), ("a", "api", 7, "f"), ("a", "web", 3, "e.Router"), ("b", "r", 1, "R"), ("b", "k", 1, "f"), ("b", None, 1, "R")], "file string, receiver string, start int, callee string")
    bound = routes.receivers(imports, made)
    assert {(r.file, r.object, r.framework) for r in bound.collect()} == {("a", "app", "express"), ("a", "api", "fastify"), ("a", "web", "express"), ("b", "r", "express")}
    calls = spark.createDataFrame([("a", 1, "app", "get"), ("a", 2, "api", "route"), ("a", 3, "api", "post"), ("a", 4, "app", "route"), ("a", 5, "app", "use"), ("a", 6, "nobody", "get"), ("b", 7, "r", "put"), ("b", 8, "r", "get")], "file string, id int, object string, property string")
    args = [("a", 1, 0, "string", "/x", "'/x'"), ("a", 1, 1, "name", "mw", "mw"), ("a", 1, 2, "name", "h", "h"), ("a", 2, 0, "object", None, "{}"), ("a", 3, 0, "string", "/y", "'/y'"), ("a", 3, 1, "object", None, "{}"), ("a", 3, 2, "function", "fn9", "() => 1"),
        ("a", 4, 0, "object", None, "{}"), ("a", 6, 0, "string", "/", "'/'"), ("a", 6, 1, "name", "h", "h"), ("b", 7, 0, "string", "/z", "'/z'"), ("b", 8, 0, "name", "p", "p"), ("b", 8, 1, "name", "h", "h")]
    args = spark.createDataFrame(args, "file string, call int, position int, kind string, value string, text string")
    props = [("a", 2, 0, 0, "method", "string", "get", "'get'"), ("a", 2, 0, 1, "path", "string", "/p", "'/p'"), ("a", 2, 0, 2, "handler", "name", "twice", "twice"), ("a", 2, 0, 3, "preHandler", "name", "auth", "auth"), ("a", 2, 0, 4, "schema", "object", None, "{s}"),
        ("a", 2, 0, 5, "method", "string", "post", "'post'"), ("a", 3, 1, 0, "onRequest", "name", "log", "log"), ("a", 4, 0, 0, "method", "string", "get", "'get'")]
    props = spark.createDataFrame(props, "file string, call int, position int, ord int, name string, kind string, value string, text string")
    functions = spark.createDataFrame([("a", "f1", "h"), ("a", "f2", "twice"), ("a", "f3", "twice"), ("b", "f4", "h"), ("a", "f5", None)], "file string, id string, name string")
    x = routes.with_handlers(routes.routes(calls, args, props, bound), functions).collect()
    assert {(r.id, r.framework, r.method, r.path, r.function, tuple(tuple(a) for a in r.attachments)) for r in x} == {
        (1, "express", "GET", "/x", "f1", (("middleware", "mw"),)), (2, "fastify", "GET", "/p", None, (("schema", "{s}"), ("middleware", "auth"))), (3, "fastify", "POST", "/y", "fn9", (("middleware", "log"),)),
    }
    assert routes.routes(calls, args, props.limit(0), bound.limit(0)).count() == 0


def test_only_what_was_collected_is_judged(spark):
    def provider():
        def call(payload):
            asked = json.loads(payload)
            if asked.get("state") == "bad":
                raise ValueError("refused")
            return ("todo" if asked.get("state") in ("a", "b") else "other") if asked["stage"] == "collect" else "judged " + asked["state"]

        return call

    targets = spark.createDataFrame([(1, "a", False), (2, "a", None), (3, "a", True), (4, "b", False), (5, "c", False), (6, "bad", False), (7, None, False)], "id int, state string, suppressed boolean")
    empty = spark.createDataFrame([], "key string, response string")
    x = runs.collected(targets, empty, provider, "p", "todo")
    assert {r.id: r.response for r in x.judged.collect()} == {1: "judged a", 2: "judged a", 4: "judged b"}
    assert [(r.id, r.error) for r in x.problems.collect()] == [(6, "refused")]
    assert {r.stage: (r.requests, r.cache_hits, r.failed) for r in x.sample.collect()} == {"collect": (5, 0, 1), "judge": (2, 0, 0)}
    again = runs.collected(targets, x.cache, provider, "p", "todo")
    assert {r.stage: (r.requests, r.cache_hits, r.failed) for r in again.sample.collect()} == {"collect": (2, 3, 1), "judge": (0, 2, 0)}
    assert runs.collected(targets.limit(0), empty, provider, "p", "todo").judged.count() == 0
