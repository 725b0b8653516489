"""Facts of nodes against plain recursion over random trees, deep chains and odd JSON."""

import json
import random

from pyspark.sql import functions as F

from cairn.operators import syntax


def _tree(r, depth, counter):
    """A random node; starts go up in the order of the text."""
    counter[0] += 1
    start = counter[0]
    if depth == 0 or r.random() < 0.2:
        return r.choice([{"type": "Identifier", "name": r.choice("abcd"), "start": start}, {"type": "Literal", "value": r.choice(["a", 1, None, True]), "start": start}])
    sub = lambda: _tree(r, depth - 1, counter)
    kind = r.randrange(5)
    if kind < 2:
        of, computed = sub(), r.random() < 0.4
        return {"type": "MemberExpression", "start": start, "computed": computed, "object": of, "property": sub() if computed else {"type": "Identifier", "name": r.choice("xyz")}}
    if kind == 2:
        return {"type": "CallExpression", "start": start, "callee": sub(), "arguments": [sub() for _ in range(r.randrange(3))]}
    if kind == 3:
        return {"type": "ObjectExpression", "start": start, "properties": [{"type": "Property", "key": {"type": "Identifier", "name": "k"}, "value": sub()} for _ in range(r.randrange(3))]}
    return {"type": "FunctionExpression", "start": start, "params": [sub()], "body": sub()}


def _path(n):
    if n["type"] == "Identifier":
        return n["name"]
    if n["type"] != "MemberExpression":
        return None
    p = n["property"]
    part = (p["value"] if p["type"] == "Literal" and isinstance(p["value"], str) else None) if n["computed"] else p["name"]
    of = _path(n["object"])
    return None if of is None or part is None else f"{of}.{part}"


def _reads(n):
    path = _path(n)
    if path is not None:
        return [path]
    below = {"MemberExpression": lambda: [n["object"]] + [n["property"]] * n["computed"], "CallExpression": lambda: [n["callee"], *n["arguments"]], "ObjectExpression": lambda: [p["value"] for p in n["properties"]], "FunctionExpression": lambda: [n["body"]]}
    return [x for c in below.get(n["type"], list)() for x in _reads(c)]


def test_references_and_paths_of_random_trees(spark):
    r = random.Random(5)
    trees = [_tree(r, 6, [0]) for _ in range(400)]
    d = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "id int, j string")
    node, bound = F.try_parse_json("j"), syntax.levels(F.col("j"))
    for x in d.select("id", syntax.references(node, bound).alias("r"), syntax.static_path(node, bound).alias("p")).collect():
        assert x.r == list(dict.fromkeys(_reads(trees[x.id])))
        assert x.p == _path(trees[x.id])


def test_patterns_of_any_depth_and_odd_rows(spark):
    name = {"type": "Identifier", "name": "deep", "start": 4}
    deep = name
    for i in range(300):
        deep = {"type": "ArrayPattern", "elements": [None, deep]} if i % 2 else {"type": "AssignmentPattern", "left": deep, "right": name}
    late, tie = {"type": "Identifier", "name": "late"}, [{"type": "Identifier", "name": n, "start": 1} for n in "ba"]
    loop = {"type": "VariableDeclaration", "declarations": [{"type": "VariableDeclarator", "id": {"type": "ObjectPattern", "properties": [{"type": "RestElement", "argument": late}, {"type": "Property", "key": name, "value": tie[0]}, {"type": "Property", "value": tie[1]}]}}]}
    rows = {1: json.dumps(deep), 2: json.dumps(loop), 3: None, 4: "{broken", 5: "[]", 6: '{"type": "Literal", "value": "{{{"}', 7: json.dumps({"type": "ArrayPattern", "elements": [name, name]}), 8: json.dumps({"type": "ArrayPattern", "elements": [{"type": "Identifier", "name": f"n{i:05}", "start": i} for i in range(20000)]})}
    d = spark.createDataFrame(list(rows.items()), "id int, j string")
    got = {x.id: x.n for x in d.select("id", syntax.binding_names(F.try_parse_json("j"), syntax.levels(F.col("j"))).alias("n")).collect()}
    assert got.pop(8) == [f"n{i:05}" for i in range(20000)]
    assert got == {1: ["deep"], 2: ["a", "b", "late"], 3: [], 4: [], 5: [], 6: [], 7: ["deep", "deep"]}


def test_long_member_chains(spark):
    chain = {"type": "Identifier", "name": "o", "start": 1}
    for _ in range(400):
        chain = {"type": "OptionalMemberExpression", "object": chain, "property": {"type": "PrivateIdentifier", "name": "m"}}
    d = spark.createDataFrame([(json.dumps(chain),)], "j string")
    node, bound = F.try_parse_json("j"), syntax.levels(F.col("j"))
    x = d.select(syntax.static_path(node, bound).alias("p"), syntax.references(node, bound).alias("r"), syntax.callee(node, bound).alias("c")).first()
    assert x.p == x.c == x.r[0] == "o" + ".m" * 400 and len(x.r) == 1


def test_calls_keep_other_columns_and_leave_out_what_is_no_call(spark):
    call = {"type": "CallExpression", "start": 10, "callee": {"type": "Literal", "value": 1}, "arguments": [{"type": "TemplateLiteral", "expressions": [], "start": 12, "end": 17}, {"type": "TemplateLiteral", "expressions": [{"type": "Identifier", "name": "e", "start": 20}], "start": 18, "end": 25}]}
    rows = [(1, json.dumps(call), 'f(`a"b`, `${e}xx`)', None, "kept"), (2, json.dumps(call["callee"]), "1", "AwaitExpression", ""), (3, None, None, None, None), (4, json.dumps(call | {"type": "NewExpression", "arguments": []}), "", "AwaitExpression", "")]
    d = spark.createDataFrame(rows, "id int, j string, source string, parent string, kind string")
    got = {x.id: x for x in syntax.calls(d, "j", "source", "parent").collect()}
    assert set(got) == {1, 4}
    assert (got[1].relation, got[1].callee, got[1].awaited, got[1].usage, got[1].kind, got[1].references) == ("call", None, False, "other", "kept", ["e"])
    assert [json.loads(a.value) if a.value else None for a in got[1].arguments] == ['a"b', None]
    assert (got[4].relation, got[4].awaited, got[4].usage, got[4].arguments) == ("constructor", None, "await", [])
    assert syntax.calls(d.limit(0), "j", "source", "parent").count() == 0 == syntax.declared(d.limit(0), "id", "j").count()


def test_walks_are_dealt_over_tasks_whatever_the_row_groups(spark):
    from cairn.plans import registry

    for name in ("e22_binding_names", "e15_response_chain", "e17_calls"):
        x = registry.queries()[name](spark, "/root/testdata/sf0.01")
        rows = [r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect()]
        assert len(rows) == 4 and max(rows) < 2 * min(rows)
