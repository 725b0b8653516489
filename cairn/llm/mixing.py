"""Mixing sources to target weights by capped water-filling."""

from pyspark.sql import DataFrame, Window as W, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def water_fill(totals: DataFrame, weights: tuple = (5, 2, 1), most_epochs: int = 3) -> DataFrame:
    """totals(source, size, one row each) with weight and target.

    Sources by code point, null last, weigh `weights`, repeating. All sizes are shared out by weight; a target
    stops at most_epochs times its source's size, and the excess is shared again by weight until none is above.
    With the sources in order of cap / weight the clamped ones come first, so one running sum finds them all.
    The table has a row per source, and no more.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (n % len(weights) + 1).cast("int"))
    x = totals.withColumn("weight", w).withColumn("cap", F.col("size") * most_epochs)
    by = W.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    past = by.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = x.withColumns({"spent": F.coalesce(F.sum("cap").over(past), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(past), F.lit(0.0))})
    x = x.withColumns({"all_size": F.sum("size").over(all_rows), "all_weight": F.sum("weight").over(all_rows)})
    x = x.withColumn("level", (F.col("all_size") - F.col("spent")) / (F.col("all_weight") - F.col("weight_before")))
    x = x.withColumn("clamped", F.col("cap") / F.col("weight") < F.col("level"))
    x = x.withColumn("common", F.max(F.when(~F.col("clamped"), F.struct(-F.col("weight_before"), "level"))).over(all_rows)["level"])
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.least(F.col("common") * F.col("weight"), F.col("cap").cast("double")))
    return x.select("source", F.col("size").alias("source_size"), "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), most_epochs: int = 3, seed: int = 17, buckets: int = 4096, keep: tuple = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and repeats of every document, with the columns in `keep`.

    A source's target over its size is its epochs: each document is taken as often as the whole part, and the
    fractional part takes a seeded choice of documents once more: those first in the order of md5(seed, doc_id)
    whose sizes add up to the words still missing, to within half a document. That order is cut into buckets whose
    sums give each bucket's start, so a source of any size is spread over `buckets` groups. size is the number of
    words; a null text has none and is taken like an empty one. Rows of equal doc_id and size are interchangeable.
    A null source is a source of its own. An empty table gives an empty table.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *keep)
    rows = rows.withColumn("order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    rows = rows.withColumn("bucket", F.conv(F.substring("order", 1, 3), 16, 10).cast("int") % buckets)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    plan = water_fill(sums.groupBy("source").agg(F.sum("in_bucket").alias("size")), weights, most_epochs)
    plan = plan.withColumn("epochs", F.least(F.coalesce(F.expr("try_divide(target, source_size)"), F.lit(0.0)), F.lit(float(most_epochs))))
    plan = plan.withColumn("whole", F.floor("epochs"))
    plan = plan.withColumn("missing", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    plan = sums.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select("s.source", "s.bucket", "start", "source_size", "target", "whole", "missing")
    both = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket")))
    both = both.select("r.*", "start", "source_size", "target", "whole", "missing")
    inside = W.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    both = both.withColumn("repeats", F.least(F.col("whole") + F.when((at <= F.col("missing")) & (F.col("missing") > 0), 1).otherwise(0), F.lit(most_epochs)).cast("int"))
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "source", "repeats", *keep)


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it. Documents taken no time go; columns stay as they are."""
    columns = docs.columns
    own = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    out = mix(own, keep=("_row",), **options).filter("repeats > 0")
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("_row.*")
