"""Sharding by jump consistent hashing, in SQL functions only."""

from pyspark.sql import Column, DataFrame, functions as F

#: Multiplier of the generator in the published jump consistent hash, as two 32-bit halves.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
#: Jumps are Poisson with mean ln(shards) at most 22; so many never happen.
MOST_JUMPS = 200


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a long key (null counts as 0).

    Going from n to n + 1 shards, a key either stays or moves to shard n. The 64-bit state is kept as two
    32-bit halves, since a product of longs overflows.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), F.shiftrightunsigned(key, 32).alias("h"), key.bitwiseAND(F.lit(0xFFFFFFFF)).alias("l")
    )

    def step(s, _):
        a, b = F.shiftright(s.l, 16) * F.lit(LOW), s.l.bitwiseAND(F.lit(0xFFFF)) * F.lit(LOW)
        t = b + F.lit(1) + F.shiftleft(a.bitwiseAND(F.lit(0xFFFF)), 16)
        high = (
            F.shiftright(a, 16)
            + F.shiftright(t, 32)
            + F.shiftleft((F.shiftright(s.h, 16) * F.lit(LOW)).bitwiseAND(F.lit(0xFFFF)), 16)
            + s.h.bitwiseAND(F.lit(0xFFFF)) * F.lit(LOW)
            + F.shiftleft((F.shiftright(s.l, 16) * F.lit(HIGH)).bitwiseAND(F.lit(0xFFFF)), 16)
            + s.l.bitwiseAND(F.lit(0xFFFF)) * F.lit(HIGH)
        ).bitwiseAND(F.lit(0xFFFFFFFF))
        jump = F.floor((s.j + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
        return F.when(s.j < shards, F.struct(s.j.alias("b"), jump.cast("long").alias("j"), high.alias("h"), t.bitwiseAND(F.lit(0xFFFFFFFF)).alias("l"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS))), start, step, lambda s: s.b.cast("int"))


def assign_shards(df: DataFrame, key: str, shards: int, to: str = "shard") -> DataFrame:
    """df with its shard in column `to`. A key that is no integer is hashed first; rows of one key share a shard. An empty table stays empty."""
    kind = dict(df.dtypes)[key]
    k = F.col(f"`{key}`")
    return df.withColumn(to, jump_hash(k if kind in ("tinyint", "smallint", "int", "bigint") else F.when(k.isNotNull(), F.xxhash64(k)), shards))


def shard_digest(docs: DataFrame, shards: int = 24, buckets: int = 1024) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 8; text_crc32 of a null text is null. Slots count from 0
    without gaps inside each shard: rows are ranked inside hashed buckets of a shard, and the buckets' counts are
    summed up, so no task sees a whole shard. Equal rows are counted before they are dealt out, so any number of
    them moves as one row; they get slots next to each other. A null doc_id counts as key 0. Other columns are ignored.
    """
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumns({"shard": jump_hash(F.col("doc_id"), shards), "grown_shard": jump_hash(F.col("doc_id"), shards + 1), "bucket": F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int")})
    from pyspark.sql import Window as W

    inside = W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    # At most shards * buckets rows, whatever the input: small enough to broadcast.
    counts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    ahead = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("offset"))
    out = ranked.join(F.broadcast(counts), ["shard", "bucket"])
    out = out.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("before") + F.col("i")).alias("slot"), "grown_shard")
