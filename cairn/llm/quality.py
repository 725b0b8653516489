"""Quality rules: cross-document line frequency, in SQL functions only."""

from pyspark.sql import Column, DataFrame, functions as F

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), WHITE, " "))


def frequent_lines(docs: DataFrame, host: str, max_documents: int) -> DataFrame:
    """(host, line hash) of normalised lines found in over max_documents distinct documents of a host.

    Documents count as distinct by their text: copies of one document don't make its lines boilerplate.
    """
    lines = docs.select(F.col(host).alias("host"), F.xxhash64("text").alias("content"), F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(WORD))
    lines = lines.select("host", "content", F.xxhash64(normalised(F.col("line"))).alias("line")).distinct()
    return lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") > max_documents)


def removed_share(docs: DataFrame, host: str, max_documents: int) -> DataFrame:
    """(doc_id, content, words, removed): the words in lines of each document and those in lines that frequent_lines() removes.

    Equal rows are counted together, which leaves the share as it is.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("content"), F.col(host).alias("host"), F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(WORD))
    lines = lines.select("doc_id", "content", "host", F.xxhash64(normalised(F.col("line"))).alias("line"), F.size(F.split(F.btrim("line", F.lit(BLANK)), WHITE)).alias("words"))
    often = frequent_lines(docs, host, max_documents).select(F.col("host").alias("h"), F.col("line").alias("l"))
    both = lines.join(often, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")), "left")
    return both.groupBy("doc_id", "content").agg(F.sum("words").alias("words"), F.sum(F.when(F.col("l").isNotNull(), F.col("words")).otherwise(0)).alias("removed"))


def strip_lines(docs: DataFrame, host: str = "source", max_documents: int = 30) -> DataFrame:
    """docs with the frequent lines taken out of the text; other lines keep their order. A text all of whose lines go becomes empty."""
    name = {"_content": F.xxhash64("text")}
    parts = docs.select("doc_id", F.col(host).alias("host"), F.xxhash64("text").alias("content"), F.posexplode(F.split("text", "\n")).alias("at", "line")).distinct()
    parts = parts.withColumn("key", F.xxhash64(normalised(F.col("line"))))
    often = frequent_lines(docs, host, max_documents).select(F.col("host").alias("h"), F.col("line").alias("l"))
    left = parts.join(often, F.col("host").eqNullSafe(F.col("h")) & (F.col("key") == F.col("l")), "left_anti")
    text = left.groupBy("doc_id", "content").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x.line), "\n").alias("_text"))
    text = text.select(F.col("doc_id").alias("_id"), F.col("content").alias("_c"), "_text")
    out = docs.withColumns(name).join(text, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_content") == F.col("_c")), "left")
    kept = F.when(F.col("text").isNotNull(), F.coalesce("_text", F.lit("")))
    return out.select(*[kept.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def base_metrics(docs: DataFrame, keep: tuple = ()) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of whole texts; null counts as empty.

    For n_repeat_words the windows' hashes are sorted with their positions in their low bits (as many bits as the
    text needs), so that equal windows stand side by side; the covered words are summed from the positions' gaps.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    x = docs.select(*keep, text.alias("_t"), F.btrim(text, F.lit(BLANK)).alias("_b"))
    x = x.select(*keep, "_t", F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.split("_b", WHITE)).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda l: l.rlike(WORD))
    x = x.select(
        *keep,
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.expr("shiftleft(1L, cast(ceil(log2(greatest(size(_w), 2))) as int)) - 1").alias("_mask"),
    )
    x = x.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    windows = F.expr("sort_array(transform(sequence(0, size(_w) - 3), i -> (xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)) & ~_mask) | i))")
    x = x.withColumn("_s", F.when(F.col("n_words") >= 4, windows)).drop("_w")
    x = x.withColumn("_d", F.expr("sort_array(transform(filter(_s, (v, i) -> coalesce((v & ~_mask) = (get(_s, i - 1) & ~_mask), false) or coalesce((v & ~_mask) = (get(_s, i + 1) & ~_mask), false)), v -> v & _mask))")).drop("_s")
    covered = F.expr("if(size(_d) > 0, 3L + aggregate(transform(_d, (v, i) -> if(i = 0, 0L, least(3L, v - get(_d, i - 1)))), 0L, (a, v) -> a + v), 0L)")
    return x.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_d", "_mask")


def quality_rules(docs: DataFrame, host: str = "source", max_documents: int = 30, least_left: int = 50, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """The base metrics, base_failed and kept of every document.

    base_failed: under min_words words, or over max_repeat % of the words in repeated 3-word windows. kept: not
    base_failed, and at least least_left % of its words stand in lines that stay when the lines found in over
    max_documents documents of its host are removed. Null texts have no words and fail; equal rows get equal
    answers; a null host is a host of its own; an empty table gives an empty table; other columns are ignored.
    """
    base = base_metrics(docs.select("doc_id", "text", F.xxhash64("text").alias("content")), keep=("doc_id", "content"))
    gone = removed_share(docs, host, max_documents).filter("removed > 0").select(F.col("doc_id").alias("_id"), F.col("content").alias("_c"), "words", "removed")
    out = base.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_c")), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    enough = F.coalesce(100 * (F.col("words") - F.col("removed")) >= least_left * F.col("words"), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & enough).alias("kept"))
