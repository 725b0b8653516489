"""Closures over edges: reachability, and functional edges followed to their end."""

import math

from pyspark.sql import DataFrame, functions as F

from cairn.functions.recovery import kept


def reachable(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, depth): what each of starts(start) reaches over edges(src, dst), at its least depth; itself only over a cycle.

    Breadth first, one join a round, over pairs not met before; `most` bounds the depth (null: until nothing is new).
    Each round is checkpointed, so the lineage stays short and lost executors cost a round at most.
    """
    e = edges.select("src", "dst").distinct()
    new = kept(starts.select("start").distinct().join(e, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(1).alias("depth")).distinct())
    seen, depth = new, 1
    while (most is None or depth < most) and not new.isEmpty():
        depth += 1
        step = new.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        new = kept(step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = kept(seen.unionByName(new))
    return seen


def functional(edges: DataFrame) -> DataFrame:
    """edges(src, dst) of sources with one distinct target that is not the source itself."""
    x = edges.groupBy("src").agg(F.min("dst").alias("dst"), F.max("dst").alias("_last"))
    return x.filter((F.col("dst") == F.col("_last")) & (F.col("src") != F.col("dst"))).drop("_last")


def resolved(names: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """names with root: the end of the path over functional edges(src, dst); the name itself if it has no edge or meets a cycle.

    Paths are doubled: after k rounds each source has gone 2 ** k steps. Rounds end when nothing moves, or after log2 of
    the edges; what still has an edge then goes round a cycle.
    """
    at = kept(edges.select("src", "dst"))
    ends = edges.select(F.col("src").alias("_inner"))
    for _ in range(max(0, math.ceil(math.log2(max(1, at.count()))))):
        step = at.select(F.col("src").alias("_mid"), F.col("dst").alias("_far"))
        moved = kept(at.join(step, F.col("dst") == F.col("_mid"), "left").select("src", F.coalesce("_far", "dst").alias("dst"), F.col("_far").isNotNull().alias("_moved")))
        at = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            break
    at = at.join(ends, F.col("dst") == F.col("_inner"), "left_anti")
    return names.join(at.select(F.col("src").alias(name), F.col("dst").alias("_root")), name, "left").withColumn("root", F.coalesce("_root", name)).drop("_root")


def static_paths(members: DataFrame) -> DataFrame:
    """(id, path, links) of members(id, object, name): the names from the first object to the member, joined by dots.

    `object` is the id of the member that a name is taken from, null for a first object. A null name is dynamic: no path
    goes through it. Paths through it, through an object that is not there, or round a cycle are null, with null links
    for a cycle. Ranking by pointer doubling: each round joins what a member's path begins with, so a chain of n links
    takes log2(n) rounds, and long chains and many short ones cost alike; payloads are the paths themselves.
    """
    start = members.select("id", F.col("object").alias("up"), F.col("name").alias("path"), F.lit(1).cast("long").alias("links"), F.col("name").isNotNull().alias("fixed"))
    at = kept(start)
    rounds = math.ceil(math.log2(max(1, at.count()))) + 1
    for _ in range(rounds):
        if at.filter("up IS NOT NULL").isEmpty():
            break
        above = at.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("links").alias("_links"), F.col("fixed").alias("_fixed"))
        both = at.join(above, F.col("up") == F.col("_id"), "left")
        fixed = F.when(F.col("up").isNull(), F.col("fixed")).otherwise(F.col("fixed") & F.coalesce("_fixed", F.lit(False)))
        path = F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("_path", F.lit("."), "path"))
        # What has no path any more carries none on.
        at = kept(both.select("id", F.col("_up").alias("up"), F.when(fixed, path).alias("path"), (F.col("links") + F.coalesce("_links", F.lit(0))).alias("links"), fixed.alias("fixed")))
    ended = F.col("up").isNull()
    return at.select("id", F.when(ended & F.col("fixed"), F.col("path")).alias("path"), F.when(ended, F.col("links")).alias("links"))


def reference_paths(members: DataFrame, owner: str) -> DataFrame:
    """(owner, paths, partial) of members(id, object, name, start, owner): each owner's longest static paths, distinct, in the order of their first place.

    A member that another is taken from is part of a longer path and stands for none itself. partial: one of the
    owner's longest members has no static path.
    """
    inner = members.filter("object IS NOT NULL").select(F.col("object").alias("_inner")).distinct()
    whole = members.join(inner, F.col("id") == F.col("_inner"), "left_anti").join(static_paths(members).select(F.col("id").alias("_id"), "path"), F.col("id") == F.col("_id"))
    first = whole.groupBy(owner, "path").agg(F.min("start").alias("start"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("start", "path")))), lambda x: x.path)
    return first.groupBy(owner).agg(listed.alias("paths"), F.bool_or(F.col("path").isNull()).alias("partial"))
