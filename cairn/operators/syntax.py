"""Facts of calls, arguments and patterns whose nodes are JSON: {"type": ..., "start": ..., "end": ..., and a field for each child}.

Nodes are read as VARIANT and walked by level inside their row: what is walked is the row's own JSON, so nothing is shuffled,
and its number of braces bounds the levels, so no depth is fixed. A level without nodes costs next to nothing. JSON that is
null, broken or over 1000 levels deep (the parser's own bound) has no facts. Names that stand at the same start, or at none,
are in order of code points, those without a start last.
"""

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions import text

# The field of a pattern's node that holds what it binds, kinds of values, what a call's parent makes of it,
# functions, wrappers of a reference, methods of a response, options that page or order rows, calls that take SQL.
PATTERN_FIELD = {
    "ArrayPattern": "elements",
    "AssignmentPattern": "left",
    "ObjectPattern": "properties",
    "ObjectProperty": "value",
    "Property": "value",
    "RestElement": "argument",
    "TSParameterProperty": "parameter",
    "VariableDeclaration": "declarations",
    "VariableDeclarator": "id",
}
FUNCTIONS = ["FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression", "TSDeclareFunction"]
VALUE_KIND = {
    "ArrayExpression": "array",
    "CallExpression": "call",
    "NewExpression": "call",
    "Identifier": "identifier",
    "Literal": "literal",
    "ObjectExpression": "object",
    "SpreadElement": "spread",
    "TemplateLiteral": "template",
} | dict.fromkeys(FUNCTIONS, "function")
USAGE = {
    "AwaitExpression": "await",
    "ReturnStatement": "return",
    "ExpressionStatement": "expression",
    "VariableDeclarator": "assignment",
    "AssignmentExpression": "assignment",
    "CallExpression": "argument",
    "NewExpression": "argument",
} | dict.fromkeys(["IfStatement", "SwitchStatement", "ConditionalExpression", "WhileStatement", "DoWhileStatement", "ForStatement"], "condition")
WRAPPERS = ["ChainExpression", "TSAsExpression", "TSSatisfiesExpression", "TSNonNullExpression"]
STATUS_METHODS = ["status", "code", "sendStatus"]
HEADER_METHODS = ["header", "set", "setHeader"]
PAGE_OPTIONS = ["limit", "offset", "skip", "take"]
ORDER_OPTIONS = ["orderby", "order_by"]
QUERY_CALL = r"(?i)(?:^|\.)query\z"

_NODES = "array<variant>"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _get(node: Column, field: str, kind: str = "variant") -> Column:
    return F.try_variant_get(node, f"$.{field}", kind)


def _type(node: Column) -> Column:
    return _get(node, "type", "string")


def _string(node: Column, field: str) -> Column:
    """The field where it is a string, null where it is a number or anything else."""
    return F.when(F.schema_of_variant(_get(node, field)) == "STRING", _get(node, field, "string"))


def _name(node: Column) -> Column:
    return F.coalesce(_string(node, "name"), _string(node, "value"))


def _is_member(node: Column) -> Column:
    return F.coalesce(_type(node).endswith("MemberExpression"), F.lit(False))


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _nodes(value: Column) -> Column:
    """A field's nodes in their order: those of a list, or the one it holds; never null."""
    listed = _once(value, lambda v: F.coalesce(F.try_variant_get(v, "$", _NODES), F.array(v)))
    return F.filter(listed, lambda n: _type(n).isNotNull())


def levels(json: Column) -> Column:
    """How many levels the nodes of a JSON text can have at most: its opening braces, 1 at least."""
    return F.greatest(F.lit(1), F.length(json) - F.length(F.replace(json, F.lit("{"), F.lit(""))))


def _spine(root: Column, bound: Column, below) -> Column:
    """root and the nodes below it, outermost first, where each has one below(node) or null."""
    step = lambda a, _: F.when(_type(a["node"]).isNotNull(), F.struct(below(a["node"]).alias("node"), F.concat(a["passed"], F.array(a["node"])).alias("passed"))).otherwise(a)
    zero = F.struct(root.alias("node"), F.array().cast(_NODES).alias("passed"))
    return F.aggregate(F.sequence(F.lit(1), bound), zero, step, lambda a: a["passed"])


def _gathered(level: Column, bound: Column, below, found) -> Column:
    """found(entry) of all entries that below(entry) leads to, nulls left out, ordered by (start, name)."""
    none = F.array().cast("array<struct<late:boolean,start:bigint,name:string>>")
    more = lambda a: F.filter(F.transform(a["level"], found), lambda x: x["name"].isNotNull())
    step = lambda a, _: F.when(F.size(a["level"]) > 0, F.struct(F.flatten(F.transform(a["level"], below)).alias("level"), F.concat(a["out"], more(a)).alias("out"))).otherwise(a)
    out = F.aggregate(F.sequence(F.lit(1), bound), F.struct(level.alias("level"), none.alias("out")), step, lambda a: a["out"])
    return F.transform(F.array_sort(out), lambda x: x["name"])


def _found(node: Column, name: Column) -> Column:
    start = _get(node, "start", "bigint")
    return F.struct(start.isNull().alias("late"), start.alias("start"), name.alias("name"))


def binding_names(pattern: Column, bound: Column) -> Column:
    """The names that a pattern binds, at any depth, in order of place; repeats stay. Empty for what binds nothing."""
    held = lambda n: F.try_variant_get(n, F.try_element_at(_map({t: f"$.{f}" for t, f in PATTERN_FIELD.items()}), _type(n)), "variant")
    named = lambda n: _found(n, F.when(_type(n) == "Identifier", _name(n)))
    return _gathered(_nodes(pattern), bound, lambda n: _nodes(held(n)), named)


def _property(member: Column) -> Column:
    """The name of a member's property where it is static, null where it is computed at run time."""
    p = _get(member, "property")
    literal = F.when(_type(p) == "Literal", _string(p, "value"))
    return F.when(F.coalesce(_get(member, "computed", "boolean"), F.lit(False)), literal).otherwise(_name(p))


def references(root: Column, bound: Column) -> Column:
    """The distinct names and static dotted paths that are read below root, in order of their first place.

    A path that is dynamic somewhere counts with its static part and with what its computed properties read. The keys
    of objects and the parameters of functions are no references.
    """
    entry = lambda n, path: F.struct(n.alias("node"), path.cast("string").alias("path"))

    def below(e):
        n = e["node"]
        return _once(F.when(_is_member(n), _property(n)), lambda static: found_below(e, n, static))

    def found_below(e, n, static):
        path = F.when(static.isNotNull(), F.concat_ws(".", static, e["path"]))
        of_object = F.transform(_nodes(_get(n, "object")), lambda c: entry(c, path))
        computed = F.when(static.isNull() & _get(n, "computed", "boolean"), _get(n, "property"))
        of_member = F.concat(of_object, F.transform(_nodes(computed), lambda c: entry(c, F.lit(None))))
        is_property = _type(n).isin("Property", "ObjectProperty")
        fields = F.map_filter(F.try_variant_get(n, "$", "map<string,variant>"), lambda k, _: ~(is_property & (k == "key")) & (~_type(n).isin(FUNCTIONS) | (k == "body")))
        others = F.flatten(F.transform(F.map_values(fields), _nodes))
        return F.when(_type(n) == "Identifier", F.array().cast("array<struct<node:variant,path:string>>")).when(_is_member(n), of_member).otherwise(F.transform(others, lambda c: entry(c, F.lit(None))))

    named = lambda e: _found(e["node"], F.when((_type(e["node"]) == "Identifier") & _name(e["node"]).isNotNull(), F.concat_ws(".", _name(e["node"]), e["path"])))
    return F.array_distinct(_gathered(F.transform(_nodes(root), lambda n: entry(n, F.lit(None))), bound, below, named))


def static_path(node: Column, bound: Column) -> Column:
    """The dotted path of an identifier or a member, null where a part of it is dynamic or neither."""
    spine = _spine(node, bound, lambda n: F.when(_is_member(n), _get(n, "object")))
    part = lambda n: F.when(_is_member(n), _property(n)).when(_type(n) == "Identifier", _name(n))
    parts = F.reverse(F.transform(spine, part))
    ends = _type(F.try_element_at(spine, F.lit(-1))) == "Identifier"
    return F.when(ends & F.forall(parts, lambda p: p.isNotNull()), F.array_join(parts, "."))


def static_reference(node: Column, bound: Column) -> Column:
    """static_path of what type assertions and optional chains around it hold."""
    spine = _spine(node, bound, lambda n: F.when(_type(n).isin(WRAPPERS), _get(n, "expression")))
    return static_path(F.try_element_at(spine, F.lit(-1)), bound)


def callee(node: Column, bound: Column) -> Column:
    """The names of what is called, outermost object first, parts without a name left out; null without any."""
    spine = _spine(node, bound, lambda n: F.when(_is_member(n), _get(n, "object")).when(_type(n) == "ChainExpression", _get(n, "expression")))
    part = lambda n: F.when(_is_member(n), _name(_get(n, "property"))).when(_type(n) == "Identifier", _name(n))
    names = F.filter(F.reverse(F.transform(spine, part)), lambda p: p.isNotNull())
    return F.when(F.size(names) > 0, F.array_join(names, "."))


def usage(parent_type: Column) -> Column:
    """What becomes of a call's value, by the type of the node that holds the call."""
    return F.coalesce(F.try_element_at(_map(USAGE), parent_type), F.lit("other"))


def value_kind(node: Column) -> Column:
    return F.when(_is_member(node), "member").otherwise(F.coalesce(F.try_element_at(_map(VALUE_KIND), _type(node)), F.lit("other")))


def object_keys(node: Column) -> Column:
    """The distinct names of an object's properties that are not computed, in their order; null for what is no object."""
    plain = F.filter(_nodes(_get(node, "properties")), lambda p: _type(p).isin("Property", "ObjectProperty") & ~F.coalesce(_get(p, "computed", "boolean"), F.lit(False)))
    names = F.transform(plain, lambda p: _name(_get(p, "key")))
    return F.when(_type(node) == "ObjectExpression", F.array_distinct(F.filter(names, lambda n: n.isNotNull())))


def literal_json(node: Column, source: Column) -> Column:
    """The value of a literal, or of a template without expressions (its source between the quotes), as JSON; else null."""
    value = _get(node, "value")
    scalar = F.schema_of_variant(value).rlike(r"^(VOID|STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$")
    whole = F.coalesce(F.size(_get(node, "expressions", _NODES)) == 0, F.lit(False))
    quoted = F.to_json(F.array(F.substr(source, F.lit(2), F.length(source) - 2)))
    return F.when((_type(node) == "Literal") & scalar, F.to_json(value)).when((_type(node) == "TemplateLiteral") & whole, F.substr(quoted, F.lit(2), F.length(quoted) - 2))


def argument(node: Column, bound: Column, source: Column) -> Column:
    """kind, references, properties, value (JSON) and bindings (the names of each parameter of a function) of one argument."""
    params = F.transform(_nodes(_get(node, "params")), lambda p: binding_names(p, bound))
    return F.struct(
        value_kind(node).alias("kind"),
        references(node, bound).alias("references"),
        object_keys(node).alias("properties"),
        literal_json(node, source).alias("value"),
        F.when(_type(node).isin(FUNCTIONS), params).alias("bindings"),
    )


def calls(nodes: DataFrame, json: str, source: str, parent_type: str) -> DataFrame:
    """The calls and constructions among nodes with relation, callee, arguments, references, awaited (calls only) and usage.

    source is the node's own text. Rows whose JSON is neither a call nor a construction are left out.
    """
    node, bound = F.col("_node"), F.col("_bound")
    x = nodes.withColumns({"_node": F.try_parse_json(json), "_bound": levels(F.col(json))})
    x = x.filter(_type(node).isin("CallExpression", "NewExpression"))
    at = lambda n, f: _get(n, f, "int")
    own = lambda n: F.substr(F.col(source), at(n, "start") - at(node, "start") + 1, at(n, "end") - at(n, "start"))
    is_call = _type(node) == "CallExpression"
    x = x.withColumn("arguments", F.transform(_nodes(_get(node, "arguments")), lambda n: argument(n, bound, own(n))))
    return x.withColumns({
        "relation": F.when(is_call, "call").otherwise("constructor"),
        "callee": callee(_get(node, "callee"), bound),
        "references": F.array_distinct(F.flatten(F.transform("arguments", lambda a: a["references"]))),
        "awaited": F.when(is_call, F.coalesce(F.col(parent_type) == "AwaitExpression", F.lit(False))),
        "usage": usage(F.col(parent_type)),
    }).drop("_node", "_bound")


def declared(nodes: DataFrame, key: str, json: str) -> DataFrame:
    """(key, relation, start, end, name, target) of aliases, resource declarations and static members, members once for each range.

    An alias binds name to target, a reference. A declaration's name is using or await-using. A member's name is its path,
    null where it is dynamic: the members of such a key are not complete.
    """
    node, bound, no = F.col("_node"), F.col("_bound"), F.lit(None).cast("string")
    x = nodes.select(key, F.try_parse_json(json).alias("_node"), levels(F.col(json)).alias("_bound"))
    place = [key, _get(node, "start", "bigint").alias("start"), _get(node, "end", "bigint").alias("end")]
    kind = _get(node, "kind", "string")
    fact = lambda relation, name, target: F.struct(F.lit(relation).alias("relation"), name.alias("name"), target.alias("target"))
    resource = F.when(kind.isin("using", "await using"), fact("declaration", F.replace(kind, F.lit(" "), F.lit("-")), no))
    one = F.when(_type(node) == "VariableDeclarator", fact("alias", _name(_get(node, "id")), static_reference(_get(node, "init"), bound))).otherwise(resource)
    # The list keeps Spark from working the walk out once more in the filter.
    variables = x.filter(_type(node).isin("VariableDeclarator", "VariableDeclaration")).select(*place, F.explode(F.array(one)).alias("_fact"))
    variables = variables.filter("_fact.relation = 'declaration' OR _fact.name IS NOT NULL AND _fact.target IS NOT NULL").select(key, "start", "end", "_fact.*")
    members = x.filter(_is_member(node)).select(*place, static_path(node, bound).alias("name")).groupBy(key, "start", "end").agg(F.min("name").alias("name"))
    return variables.unionByName(members.withColumns({"relation": F.lit("member"), "target": no}))


def response_chain(json: Column) -> Column:
    """status and headers of a response's chain of calls: the literal status nearest the end, and where header calls start and end, in the order they are made."""
    node, bound = F.try_parse_json(json), levels(json)
    spine = _spine(node, bound, lambda n: _once(_type(n), lambda t: F.when(t == "CallExpression", _get(n, "callee")).when(t.endswith("MemberExpression"), _get(n, "object"))))
    return _once(F.filter(spine, lambda n: _type(n) == "CallExpression"), _told)


def _told(made: Column) -> Column:
    method = lambda n: F.when(_is_member(_get(n, "callee")), _name(_get(_get(n, "callee"), "property")))
    first = lambda n: F.try_element_at(_nodes(_get(n, "arguments")), F.lit(1))
    number = lambda n: F.when((_type(first(n)) == "Literal") & F.schema_of_variant(_get(first(n), "value")).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$"), _get(first(n), "value", "int"))
    statuses = F.filter(F.transform(made, lambda n: F.when(method(n).isin(STATUS_METHODS), number(n))), lambda s: s.isNotNull())
    places = F.transform(F.reverse(F.filter(made, lambda n: method(n).isin(HEADER_METHODS))), lambda n: F.struct(_get(n, "start", "bigint").alias("start"), _get(n, "end", "bigint").alias("end")))
    return F.struct(F.try_element_at(statuses, F.lit(1)).alias("status"), places.alias("headers"))


def pagination(name: Column, arguments: Column) -> Column:
    """paginated and ordered of a call named so, from arguments as calls() gives them; null where nothing tells.

    The first object with an option that pages rows decides, whatever the case of its keys; without one, the SQL that is a
    query call's first argument.
    """
    keys = F.transform(arguments, lambda a: F.transform(F.coalesce(a["properties"], F.array().cast("array<string>")), F.lower))
    pages = F.try_element_at(F.filter(keys, lambda k: F.arrays_overlap(k, F.lit(PAGE_OPTIONS))), F.lit(1))
    value = F.try_element_at(arguments, F.lit(1))["value"]
    sql = F.when(name.rlike(QUERY_CALL) & value.startswith('"'), F.try_variant_get(F.try_parse_json(value), "$", "string"))
    by_sql = F.when(sql.isNotNull(), F.struct(text.paginated(sql).alias("paginated"), text.ordered(sql).alias("ordered")))
    return F.when(pages.isNotNull(), F.struct(F.lit(True).alias("paginated"), F.arrays_overlap(pages, F.lit(ORDER_OPTIONS)).alias("ordered"))).otherwise(by_sql)
