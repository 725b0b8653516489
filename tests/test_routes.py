"""Routes from small facts: repeated names, object arguments anywhere, and few shuffles."""

from cairn.operators import routes


def test_options_are_those_of_the_route_s_own_argument(spark):
    calls = spark.createDataFrame([("a", 1, "app", "route"), ("a", 2, "app", "get"), ("a", 3, "app", "get"), ("a", 4, "web", "route"), ("a", 5, "web", "post"), ("a", None, "app", "get")], "file string, id int, object string, property string")
    bound = spark.createDataFrame([("a", "app", "fastify"), ("a", "web", "express")], "file string, object string, framework string")
    rows = [("a", 1, 3, "object", None, "o"), ("a", 2, 1, "string", "/x", "x"), ("a", 2, 2, "object", None, "o"), ("a", 2, 3, "name", "h", "h"), ("a", 3, 1, "string", "/y", "y"), ("a", 3, 2, "object", None, "o")]
    rows += [("a", 5, 1, "string", "/z", "z"), ("a", 5, 2, "object", None, "mid"), ("a", 5, 4, "function", "f", "f")]
    arguments = spark.createDataFrame(rows, "file string, call int, position int, kind string, value string, text string")
    p = [(1, 3, 0, "method", "string", "put"), (1, 3, 1, "url", "name", "u"), (1, 3, 2, "path", "string", "/p"), (1, 3, 3, "handler", "name", "h"), (1, 3, 5, "method", "string", "get"), (1, 3, 6, "preHandler", "name", "b"), (1, 3, 7, "schema", "name", "s"), (1, 3, 8, "other", "name", "q")]
    p += [(2, 2, 0, "onRequest", "name", "r"), (2, 3, 0, "schema", "name", "no"), (3, 2, 0, "schema", "name", "y"), (5, 2, 0, "schema", "name", "no")]
    properties = spark.createDataFrame([("a", c, pos, o, n, k, v, f"t{v}") for c, pos, o, n, k, v in p], "file string, call int, position int, ord int, name string, kind string, value string, text string")
    x = routes.routes(calls, arguments, properties, bound)
    got = {r.id: (r.framework, r.method, r.path, tuple(r.handler), [tuple(a) for a in r.attachments]) for r in x.collect()}
    assert got == {
        1: ("fastify", "PUT", "/p", ("name", "h"), [("schema", "ts"), ("middleware", "tb")]), 2: ("fastify", "GET", "/x", ("name", "h"), [("middleware", "tr")]),
        3: ("fastify", "GET", "/y", ("object", None), []), 5: ("express", "POST", "/z", ("function", "f"), [("middleware", "mid")]),
    }


def test_calls_meet_their_arguments_and_options_by_one_key(spark):
    from cairn.plans import registry

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.queries()["e10_routes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # No row of arguments or of options is dealt by its position.
    dealt = [x.split(")")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert any("l_orderkey" in x for x in dealt) and not any("position" in x for x in dealt)
