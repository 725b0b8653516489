"""Routes of web frameworks from facts: receivers bound to a factory, then method, path, handler and attachments.

imports(file, local, module, imported), declarators(file, receiver, start, callee), calls(file, id, object, property),
arguments(file, call, position, kind, value, text) and, of object arguments, properties(file, call, position, ord, name,
kind, value, text). A kind is string, function, name, object or anything else; value is a literal, a function's id or a
name. Rows with a null file, call or name match nothing. Arguments and properties are reduced to a row for each call.
"""

from pyspark.sql import Column, DataFrame, functions as F

#: What makes a receiver: module, what is imported of it, what stands behind its local name, framework.
FACTORIES = [
    ("fastify", "default", "", "fastify"),
    ("fastify", "*", "", "fastify"),
    ("fastify", "fastify", "", "fastify"),
    ("express", "default", "", "express"),
    ("express", "default", ".Router", "express"),
    ("express", "*", "", "express"),
    ("express", "*", ".Router", "express"),
    ("express", "Router", "", "express"),
]
#: Methods that routes are registered by, and the options that hold middleware, in order.
METHODS = ["delete", "get", "head", "options", "patch", "post", "put", "trace"]
HOOKS = ["onRequest", "preParsing", "preValidation", "preHandler"]


def receivers(imports: DataFrame, declarators: DataFrame) -> DataFrame:
    """(file, object, framework) of names given a factory's result; of several such bindings in a file the last by start holds."""
    known = imports.sparkSession.createDataFrame(FACTORIES, "module string, imported string, suffix string, framework string")
    made = imports.join(F.broadcast(known), ["module", "imported"])  # eight rows
    made = made.select("file", F.concat("local", "suffix").alias("callee"), "framework").distinct()
    bound = declarators.join(made, ["file", "callee"]).filter("receiver IS NOT NULL")
    return bound.groupBy("file", F.col("receiver").alias("object")).agg(F.max_by("framework", F.struct("start", "framework")).alias("framework"))


def _options(properties: DataFrame) -> DataFrame:
    """(file, id, options) of every call with object arguments: (position, method, path, handler, attached) of each; of a repeated name the first counts.

    The first of each name that counts is taken in one reduction, so a name that is repeated without end is one value.
    """
    held = ["schema", *HOOKS]
    names = ["method", "url", "path", "handler", *held]
    entry = F.struct("ord", "kind", "value", "text")
    first = properties.filter(F.col("name").isin(names)).groupBy("file", F.col("call").alias("id"), "position").agg(*[F.min(F.when(F.col("name") == n, entry)).alias(n) for n in names])
    literal = lambda n: F.when(F.col(f"{n}.kind") == "string", F.col(f"{n}.value"))
    attached = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.lit("schema" if n == "schema" else "middleware").alias("kind"), F.col(f"{n}.text").alias("text"))) for n in held]))
    handler = F.when(F.col("handler").isNotNull(), F.struct("handler.kind", "handler.value"))
    options = F.struct("position", literal("method").alias("method"), F.coalesce(literal("url"), literal("path")).alias("path"), handler.alias("handler"), attached.alias("attached"))
    return first.groupBy("file", "id").agg(F.collect_list(options).alias("options"))


def routes(calls: DataFrame, arguments: DataFrame, properties: DataFrame, bound: DataFrame) -> DataFrame:
    """(file, id, framework, method, path, handler(kind, value), attachments(kind, text)) of the calls that register a route on a receiver(file, object, framework).

    `receiver.method(path, ..., handler)` needs a literal path and two arguments: what is between them is middleware, or
    for fastify options as the second of three or more. `receiver.route(options)` is fastify's; it needs a literal method
    and path, and a handler. Calls that lack any of these are no routes.
    """
    asked = calls.filter(F.col("property").isin([*METHODS, "route"])).join(bound, ["file", "object"]).select("file", "id", "property", "framework")
    # All three meet by call. Of the arguments only what a route can take is kept before.
    args = arguments.groupBy("file", F.col("call").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", "kind", "value", "text"))).alias("args"))
    a, n = F.col("args"), F.size("args")
    texts = F.transform(F.slice(a, 2, F.greatest(n - 2, F.lit(0))), lambda x: x["text"])
    place = lambda i: F.when(F.get(a, F.lit(i))["kind"] == "object", F.get(a, F.lit(i))["position"])
    last = F.element_at(a, -1)
    args = args.select("file", "id", n.alias("n"), place(0).alias("p0"), F.when(n >= 3, place(1)).alias("p1"), F.when((n >= 2) & (a[0]["kind"] == "string"), a[0]["value"]).alias("literal"), F.struct(last["kind"].alias("kind"), last["value"].alias("value")).alias("last"), texts.alias("texts"))
    by_object, fastify = F.col("property") == "route", F.col("framework") == "fastify"
    listed = asked.filter(~by_object | fastify).join(args, ["file", "id"]).join(_options(properties), ["file", "id"], "left")
    at = F.when(fastify, F.when(by_object, F.col("p0")).otherwise(F.col("p1")))
    listed = listed.withColumn("_at", at).withColumn("o", F.get(F.filter("options", lambda o: o["position"] == F.col("_at")), F.lit(0)))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    between = F.transform("texts", lambda t: F.struct(F.lit("middleware").alias("kind"), t.alias("text")))
    path: Column = F.when(by_object, F.col("o.path")).otherwise(F.col("literal"))
    method = F.when(by_object, F.col("o.method")).otherwise(F.col("property"))
    handler = F.when(by_object, F.col("o.handler")).otherwise(F.col("last"))
    attached = F.when(F.col("framework") == "express", between).otherwise(F.coalesce("o.attached", none))
    out = listed.select("file", "id", "framework", F.upper(method).alias("method"), path.alias("path"), handler.alias("handler"), attached.alias("attachments"))
    return out.filter("method IS NOT NULL AND path IS NOT NULL AND handler IS NOT NULL")


def with_handlers(found: DataFrame, functions: DataFrame) -> DataFrame:
    """found with function: the id of the route's handler, an inline function or the file's one function(file, id, name) of that name; null where it is neither, or not told."""
    unique = functions.filter("name IS NOT NULL").groupBy("file", "name").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id")).filter("_n = 1").drop("_n")
    x = found.withColumn("name", F.when(F.col("handler.kind") == "name", F.col("handler.value"))).join(unique, ["file", "name"], "left").drop("name")
    return x.withColumn("function", F.when(F.col("handler.kind") == "function", F.col("handler.value")).otherwise(F.col("_id"))).drop("_id")
