"""Diagnostics as ordered rows, text, JSON, and cache entries."""

from pyspark.sql import DataFrame, functions as F


def ordered(rows: DataFrame) -> DataFrame:
    """rows(filename, line, column, rule_id) in report order; names by Unicode collation, so a, A, b, B."""
    return rows.orderBy(F.collate(F.col("filename"), "UNICODE"), "line", "column", F.collate(F.col("rule_id"), "UNICODE"))


def stylish(diagnostics: DataFrame) -> DataFrame:
    """diagnostics with a text line each: place, severity, message, probability in whole per cent (halves up) and rule."""
    percent = F.floor(F.col("probability") * 100 + F.lit(0.5)).cast("long")
    return diagnostics.withColumn("text", F.format_string("%d:%d  %s  %s (%d%%)  %s", "line", "column", "severity", "message", percent, "rule_id"))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text per row; absent values are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: SHA-256 over the sorted hashes of the projected rows, so order does not count and repeats do.

    Hashes are summed up in two steps, first by their first two digits, so no task holds more than a part of them.
    """
    x = rows.select(F.sha2(F.to_json(F.struct(*columns)), 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    part = x.groupBy(F.left("h", F.lit(2)).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "h", "n"))), ","), 256).alias("h"))
    return part.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p", "h"))), ","), 256).alias("fingerprint"))


def add_to_cache(entries: DataFrame, cache: DataFrame, path: str, key: str) -> None:
    """Appends the entries whose keys the cache lacks; Spark commits the files of all tasks at once."""
    entries.join(cache.select(key), key, "left_anti").dropDuplicates([key]).write.mode("append").parquet(path)
