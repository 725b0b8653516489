"""Manifests of tables as trees of hashes: two tables are equal if their roots are, and differences are found by descent.

A row belongs to the range of its key's hash, a range to the one of all but its last hex digit. The order of rows does
not count, and no task holds more than one range's rows, about `ROWS` of them.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cairn.functions.recovery import kept

ROWS = 1024


def depth_for(rows: int) -> int:
    """Hex digits that leave about ROWS rows or fewer to a range."""
    digits = 0
    while rows > ROWS << (4 * digits):
        digits += 1
    return digits


def leaves(rows: DataFrame, key: str, depth: int) -> DataFrame:
    """(range, key, hash) of each row: the range of its key, and a hash of all its columns, nulls told from empty texts."""
    columns = sorted(rows.columns)
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    return rows.select(F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("null")), 256), 1, depth).alias("range"), F.col(key).alias("key"), F.sha2(text, 256).alias("hash"))


def manifest(rows: DataFrame, key: str, depth: int) -> DataFrame:
    """(range, hash, rows) of every range of the tree, the root being ''. Repeated rows count; ranges without rows have no entry."""
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    level = kept(leaves(rows, key, depth).groupBy("range").agg(joined("hash").alias("hash"), F.count(F.lit(1)).alias("rows")))
    levels = [level]
    for digits in range(depth - 1, -1, -1):
        # 16 entries a range at most.
        level = kept(level.groupBy(F.substring("range", 1, digits).alias("range")).agg(joined(F.concat("range", F.lit(":"), "hash")).alias("hash"), F.sum("rows").alias("rows")))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def differing(ours: DataFrame, pinned: DataFrame, depth: int) -> DataFrame:
    """(range) of the lowest ranges in which two manifests differ, by descent: a level's entries are compared only below a range that differs."""
    at = None
    for digits in range(depth + 1):
        a = ours.filter(F.length("range") == digits).select("range", "hash")
        b = pinned.filter(F.length("range") == digits).select(F.col("range").alias("_range"), F.col("hash").alias("_hash"))
        if at is not None:
            above = at.select(F.col("range").alias("_above"))
            a = a.join(above, F.substring("range", 1, digits - 1) == F.col("_above"), "left_semi")
            b = b.join(above, F.substring("_range", 1, digits - 1) == F.col("_above"), "left_semi")
        both = a.join(b, F.col("range") == F.col("_range"), "full")
        # Each level is read by both sides of the next.
        at = kept(both.filter(~F.col("hash").eqNullSafe(F.col("_hash"))).select(F.coalesce("range", "_range").alias("range")))
        if at.isEmpty():
            return at
    return at


def changes(ours: DataFrame, pinned: DataFrame, key: str, depth: int) -> DataFrame:
    """(key, change) of the rows by which two tables differ: added, removed or changed, keys being unique. Only rows of differing ranges are compared."""
    ranges = differing(manifest(ours, key, depth), manifest(pinned, key, depth), depth).select(F.col("range").alias("_at"))
    side = lambda x, k, h: leaves(x, key, depth).join(ranges, F.col("range") == F.col("_at"), "left_semi").select(F.col("key").alias(k), F.col("hash").alias(h))
    both = side(ours, "a", "x").join(side(pinned, "b", "y"), F.col("a").eqNullSafe(F.col("b")), "full").filter(~F.col("x").eqNullSafe(F.col("y")))
    change = F.when(F.col("y").isNull(), "added").when(F.col("x").isNull(), "removed").otherwise("changed")
    return both.select(F.coalesce("a", "b").alias("key"), change.alias("change"))
