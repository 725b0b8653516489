"""Candidates grouped by canonical evidence, and bounded prefixes of evidence."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def state_hash(state: Column) -> Column:
    """The key of canonical evidence."""
    return F.sha2(state, 256)


def batches(candidates: DataFrame) -> DataFrame:
    """One row per distinct evidence of candidates(state, ord): its hash, its candidates and its first place."""
    return candidates.groupBy(state_hash(F.col("state")).alias("state_hash")).agg(F.count(F.lit(1)).alias("candidates"), F.min("ord").alias("first_ord"))


def question_index(candidates: DataFrame) -> DataFrame:
    """candidates with their place, from 0, in the batch of their evidence."""
    return candidates.withColumn("question", F.row_number().over(W.partitionBy(state_hash(F.col("state"))).orderBy("ord")) - 1)


def bounded_prefix(rows: DataFrame, group: str, order: str, text: str, most: int, separator: int = 1) -> DataFrame:
    """The first rows of each group whose texts, joined by a separator, are at most `most` long; it stops at the first overflow."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(F.length(text) + separator).over(w) - separator).filter(F.col("_sum") <= most).drop("_sum")


def bounded_unique(values: Column, most: int = 20) -> Column:
    """Distinct values, first ones first, at most `most`."""
    return F.slice(F.array_distinct(values), 1, most)


def bounded_rows(rows: DataFrame, group: str, order: str, text: str, most: int, count: int) -> DataFrame:
    """The first rows of each group, at most `count`, whose texts are together at most `most` long, without separators."""
    w = W.partitionBy(group).orderBy(order)
    x = rows.withColumn("_sum", F.sum(F.length(text)).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return x.filter((F.col("_sum") <= most) & (F.col("_n") <= count)).drop("_sum", "_n")


def after_first(rows: DataFrame, group: str, order: str, event: Column) -> DataFrame:
    """The rows of a group that come after its first event; none where there is no event."""
    first = F.min(F.when(event, F.col(order))).over(W.partitionBy(group))
    return rows.withColumn("_first", first).filter(F.col(order) > F.col("_first")).drop("_first")


def last_of(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, value) of the last row of each group; null values count, and of rows in one place the greatest value."""
    return rows.groupBy(group).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(order, value)).alias("_l")).select(group, F.col("_l.v").alias(value))


def sized(rows: DataFrame, order: str, n: int) -> DataFrame:
    """n rows: those of `rows` by order, again and again, with place from 0; none where rows is empty.

    A fixture list is bounded by its manifest, so its places come from one window; the n rows are dealt over tasks.
    """
    numbered = rows.withColumn("_at", F.row_number().over(W.orderBy(order)) - 1)
    total = rows.agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0")
    places = rows.sparkSession.range(n).select(F.col("id").alias("place"))
    at = places.join(F.broadcast(total)).withColumn("_at", F.col("place") % F.col("_n")).drop("_n")
    return at.join(numbered, "_at").drop("_at")


def by_places(ids: list[str], rows: DataFrame, key: str) -> DataFrame:
    """The rows of the listed ids, with their place in the list; raises ValueError if one is missing or listed twice."""
    if len(set(ids)) != len(ids):
        raise ValueError("ids are listed twice")
    wanted = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"place int, {key} string")
    out = wanted.join(rows, key, "left_semi").select(key)
    if gone := sorted(set(ids) - {r[0] for r in out.collect()}):  # no more rows than the list has
        raise ValueError(f"unknown ids: {', '.join(gone)}")
    return wanted.join(rows, key)


def unique_by_range(rows: DataFrame, key: str, ord: str) -> DataFrame:
    """rows(key, start, end, ord) with one row for each key and range, that of the least ord."""
    return rows.groupBy(key, "start", "end").agg(F.min(ord).alias(ord))
