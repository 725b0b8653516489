"""Facts of nodes whose JSON is written from the tables' rows, with SQL that takes them from the rows themselves."""

from pyspark.sql import Column, functions as F

from cairn.operators import syntax
from cairn.plans.tables import table as _t


def _spread(spark, sf_dir, name, *columns):
    """The columns of a table, dealt evenly: a file of few row groups would leave the walks to as few tasks."""
    return _t(spark, sf_dir, name).select(*columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def _json(x) -> Column:
    """The JSON text of dicts and lists; a column in them is text that stands as it is."""
    if isinstance(x, Column):
        return x.cast("string")
    if isinstance(x, dict):
        parts = [p for i, (k, v) in enumerate(x.items()) for p in (F.lit(f'{", " if i else ""}"{k}": '), _json(v))]
        return F.concat(F.lit("{"), *parts, F.lit("}"))
    if isinstance(x, list):
        return F.concat(F.lit("["), *[p for i, v in enumerate(x) for p in (F.lit(", " if i else ""), _json(v))], F.lit("]"))
    return F.lit({True: "true", False: "false", None: "null"}[x] if x is None or isinstance(x, bool) else str(x) if isinstance(x, int) else f'"{x}"')


def _quoted(*parts) -> Column:
    return F.concat(F.lit('"'), *[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit('"'))


def _named(name, start=None):
    return {"type": "Identifier", "name": name} | ({} if start is None else {"start": start})


def _member(of, name, computed=False):
    return {"type": "MemberExpression", "computed": computed, "object": of, "property": name if isinstance(name, dict) else _named(name)}


def _call(of, *arguments):
    return {"type": "CallExpression", "callee": of, "arguments": list(arguments)}


def e22_binding_names(spark, sf_dir):
    # Patterns as deep as a part's size; every fifth one's rest stands first.
    p = _spread(spark, sf_dir, "part", "p_partkey", "p_size", "p_name", "p_brand", "p_type")
    size, word = F.col("p_size"), F.element_at(F.split("p_name", " "), 1)
    deep = F.concat(F.repeat(F.lit('{"type": "ArrayPattern", "elements": [null, '), size), _json(_named(_quoted(word), 2)), F.repeat(F.lit("]}"), size))
    rest = F.when(F.col("p_partkey") % 5 == 0, 0).otherwise(3)
    properties = [{"type": "Property", "key": _named("key"), "value": _named(_quoted(F.col("p_brand")), 1)}, {"type": "Property", "value": {"type": "AssignmentPattern", "left": deep, "right": _named("no")}}]
    more = [{"type": "RestElement", "argument": _named(_quoted(F.col("p_type")), rest)}]
    pattern = F.when(size % 2 == 0, _json({"type": "ObjectPattern", "properties": properties + more})).otherwise(_json({"type": "ObjectPattern", "properties": properties}))
    x = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, _json({"type": "TSParameterProperty", "parameter": pattern})).otherwise(pattern).alias("json"))
    return x.select("p_partkey", F.array_join(syntax.binding_names(F.try_parse_json("json"), syntax.levels(F.col("json"))), ",").alias("names"))


def e21_argument_facts(spark, sf_dir):
    # Calls of one argument, of eight kinds by customer, with members of up to seven names.
    o = _spread(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").withColumn("n", (F.col("o_custkey") % 7 + 1).cast("int"))
    order, line, customer, status = (F.col(c).cast("string") for c in ("o_orderkey", "n", "o_custkey", "o_orderstatus"))
    chain = F.concat(F.repeat(F.lit('{"type": "MemberExpression", "property": {"type": "Identifier", "name": "m"}, "start": 2, "end": 3, "object": '), F.col("n")), _json(_named(_quoted("o", order), 2)), F.repeat(F.lit("}"), F.col("n")))
    prop = lambda key, value, computed=False: {"type": "Property", "computed": computed, "key": key, "value": value}
    source = F.when(F.col("o_custkey") % 8 == 6, F.concat(F.lit("`t"), order, F.lit("`"))).otherwise("x")
    at = {"start": 2, "end": F.length(source) + 2}
    kinds = [
        {"type": "Literal", "value": _quoted(status)},
        {"type": "Literal", "value": order},
        {"type": "ObjectExpression", "properties": [prop(_named("id"), _named(_quoted("s", customer), 5)), prop(_named("key", 8), _named("v", 9), True), prop(_named("flag"), _member(_named("o", 11), _quoted(status))), prop(_named("id"), _named(_quoted("s", customer), 14))]},
        chain,
        _member(_member(_member(_named("o", 3), "a"), _named(_quoted("i", line), 7), True), "z"),
        {"type": "ArrowFunctionExpression", "params": [{"type": "ArrayPattern", "elements": [_named("p", 3), None, _named(_quoted("q", line), 6)]}, _named("r", 9)], "body": _call(_member(_named("r", 20), "run"), _named(_quoted("l", line), 26))},
        {"type": "TemplateLiteral", "expressions": []},
        {"type": "NewExpression", "callee": _named("F", 6), "arguments": [_named(_quoted("a", line), 8)]},
    ]
    argument = F.lit(None).cast("string")
    for i, k in enumerate(kinds):
        argument = F.when(F.col("o_custkey") % 8 == i, _json(k | at if isinstance(k, dict) else k)).otherwise(argument)
    x = o.select("o_orderkey", _json(_call(_named("g"), argument) | {"start": 0}).alias("json"), F.concat(F.lit("g("), source, F.lit(")")).alias("source"), F.lit("ExpressionStatement").alias("parent"))
    x = syntax.calls(x, "json", "source", "parent").select("o_orderkey", F.col("arguments")[0].alias("a")).select("*", "a.*")
    joined = lambda c: F.array_join(c, ",")
    return x.select("o_orderkey", "kind", joined("references").alias("refs"), joined("properties").alias("properties"), "value", F.array_join(F.transform("bindings", joined), ";").alias("bindings"))


def e17_calls(spark, sf_dir):
    o = _spread(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customer = F.col("o_custkey").cast("string")
    kind = F.when(F.col("o_orderstatus") == "P", _quoted("NewExpression")).otherwise(_quoted("CallExpression"))
    parents = {"1-URGENT": "AwaitExpression", "2-HIGH": "ReturnStatement", "3-MEDIUM": "VariableDeclarator", "4-NOT SPECIFIED": "SwitchStatement", "5-LOW": "SwitchCase"}
    parent = F.element_at(F.create_map(*[F.lit(x) for p in parents.items() for x in p]), F.col("o_orderpriority"))
    of = _member({"type": "ChainExpression", "expression": _member(_call(_named("open")), _quoted("db", customer))}, "query")
    arguments = [_named(_quoted("c", customer), 20), _member(_named(_quoted("c", customer), 30), "p"), {"type": "SpreadElement", "argument": _named(_quoted("c", customer), 40)}, {"type": "Literal", "value": None}]
    x = o.select("o_orderkey", _json({"type": kind, "start": 0, "callee": of, "arguments": arguments}).alias("json"), F.lit("").alias("source"), parent.alias("parent"))
    x = syntax.calls(x, "json", "source", "parent")
    kinds = F.array_join(F.transform("arguments", lambda a: a["kind"]), ",")
    return x.select("o_orderkey", "relation", "callee", kinds.alias("kinds"), F.array_join("references", ",").alias("refs"), "awaited", "usage")


def e17_declared(spark, sf_dir):
    # An order's priority says what its node is; every tenth order's node is there twice.
    o = _spread(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customer, status = F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    at = {"start": F.col("o_orderkey"), "end": F.col("o_orderkey") + 5}
    asserted = {"type": "TSAsExpression", "expression": {"type": "ChainExpression", "expression": _member(_named("db"), {"type": "Literal", "value": _quoted("t", customer)}, True)}}
    nodes = {
        "1-URGENT": {"type": "VariableDeclarator", "id": _named(_quoted("v", customer)), "init": asserted},
        "2-HIGH": {"type": "VariableDeclaration", "kind": F.when(status == "F", _quoted("await using")).when(status == "O", _quoted("using")).otherwise(_quoted("const"))},
        "3-MEDIUM": _member(_member(_named("o"), "p"), _quoted(customer)),
        "4-NOT SPECIFIED": _member(_named("o"), _named("i"), True),
        "5-LOW": {"type": "VariableDeclarator", "id": _named("w"), "init": {"type": "Literal", "value": 1}},
    }
    json = F.lit(None).cast("string")
    for priority, node in nodes.items():
        json = F.when(F.col("o_orderpriority") == priority, _json(node | at)).otherwise(json)
    x = o.withColumn("json", json).select("o_custkey", "o_orderkey", "json")
    return syntax.declared(x.unionByName(x.filter("o_orderkey % 10 = 0")), "o_custkey", "json")


def e15_response_chain(spark, sf_dir):
    # Up to three headers, a literal status, for every third order a later one that is none.
    o = _spread(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    n, key = (F.col("o_custkey") % 4).cast("int"), F.col("o_orderkey")
    opened = lambda i: F.concat(F.lit('{"type": "CallExpression", "arguments": [], "start": 0, "end": '), (i * 10).cast("string"), F.lit(', "callee": {"type": "MemberExpression", "property": {"type": "Identifier", "name": "setHeader"}, "object": '))
    headers = F.when(n > 0, F.array_join(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), opened), "")).otherwise("")
    chain = F.concat(headers, _json(_named("res")), F.repeat(F.lit("}}"), n))
    chain = _json(_call(_member(chain, "status"), {"type": "Literal", "value": key % 300 + 200}))
    chain = F.when(key % 3 == 0, _json(_call(_member(chain, "code"), _named("code")))).otherwise(chain)
    x = o.select("o_orderkey", _json(_call(_member(chain, "send"))).alias("json")).select("o_orderkey", syntax.response_chain(F.col("json")).alias("r"))
    return x.select("o_orderkey", "r.status", F.array_join(F.transform("r.headers", lambda h: h["end"].cast("string")), ",").alias("headers"))


QUERIES = {
    e22_binding_names: """SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_partkey % 5 = 0 THEN p_type || ',' ELSE '' END || p_brand || ',' || split_part(p_name, ' ', 1)
 || CASE WHEN p_size % 2 = 0 AND p_partkey % 5 <> 0 THEN ',' || p_type ELSE '' END AS names FROM part""",
    e21_argument_facts: """SELECT o_orderkey, ['literal', 'literal', 'object', 'member', 'member', 'function', 'template', 'call'][o_custkey % 8 + 1] AS kind,
 CASE o_custkey % 8 WHEN 2 THEN 's' || o_custkey || ',v,o.' || o_orderstatus WHEN 3 THEN 'o' || o_orderkey || repeat('.m', (o_custkey % 7 + 1)::INT) WHEN 4 THEN 'o.a,i' || (o_custkey % 7 + 1) WHEN 5 THEN 'r.run,l' || (o_custkey % 7 + 1) WHEN 7 THEN 'F,a' || (o_custkey % 7 + 1) ELSE '' END AS refs,
 CASE WHEN o_custkey % 8 = 2 THEN 'id,flag' END AS properties, CASE o_custkey % 8 WHEN 0 THEN '"' || o_orderstatus || '"' WHEN 1 THEN o_orderkey::VARCHAR WHEN 6 THEN '"t' || o_orderkey || '"' END AS value,
 CASE WHEN o_custkey % 8 = 5 THEN 'p,q' || (o_custkey % 7 + 1) || ';r' END AS bindings FROM orders""",
    e17_calls: """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'constructor' ELSE 'call' END AS relation, 'db' || o_custkey || '.query' AS callee, 'identifier,member,spread,literal' AS kinds, 'c' || o_custkey || ',c' || o_custkey || '.p' AS refs,
 CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority = '1-URGENT' END AS awaited, CASE o_orderpriority WHEN '1-URGENT' THEN 'await' WHEN '2-HIGH' THEN 'return' WHEN '3-MEDIUM' THEN 'assignment' WHEN '4-NOT SPECIFIED' THEN 'condition' ELSE 'other' END AS usage FROM orders""",
    e17_declared: """WITH x AS (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH'))
 SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'alias' WHEN '2-HIGH' THEN 'declaration' ELSE 'member' END AS relation, o_orderkey AS start, o_orderkey + 5 AS "end",
 CASE o_orderpriority WHEN '1-URGENT' THEN 'v' || o_custkey WHEN '2-HIGH' THEN CASE WHEN o_orderstatus = 'F' THEN 'await-using' ELSE 'using' END WHEN '3-MEDIUM' THEN 'o.p.' || o_custkey END AS name,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'db.t' || o_custkey END AS target FROM x WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM', '4-NOT SPECIFIED') OR o_orderpriority = '2-HIGH' AND o_orderstatus IN ('F', 'O')""",
    e15_response_chain: """SELECT o_orderkey, CAST(o_orderkey % 300 + 200 AS INT) AS status, ['', '10', '10,20', '10,20,30'][o_custkey % 4 + 1] AS headers FROM orders""",
}
