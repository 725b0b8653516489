"""Selections over facts of functions, loops, handlers and calls, and small reductions of runs."""

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions import text
from cairn.operators import nesting


def selected_functions(functions: DataFrame, calls: DataFrame, callee: str, most: int = 12000) -> DataFrame:
    """functions(id, kind, start, source) of the kind function, not empty nor over `most` characters, with at least one call(id, callee, start) that matches; evidence holds those, by start.

    Calls are filtered and aggregated before the join. Null kinds, sources and callees select nothing.
    """
    found = calls.filter(F.col("callee").rlike(callee)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "callee"))).alias("evidence"))
    return functions.filter((F.col("kind") == "function") & F.length("source").between(1, most)).join(found, "id")


def retry_loops(loops: DataFrame, catches: DataFrame, calls: DataFrame, key: str) -> DataFrame:
    """(key, id) of loops(key, id, start, end, kind, bindings) that may retry: they contain one of catches(key, id, start, end).

    for-in loops never do. A for-of loop does if it binds nothing (empty or null), or if one of
    calls(key, id, start, end, references) in it, outside all catches of the key, uses none of its bindings.
    """
    loops = loops.filter("kind <> 'for-in'")
    held = nesting.holds_any(loops, catches.select(key, "start", "end"), key, "_held").filter("_held IS NOT NULL").drop("_held")
    bound = held.filter("kind = 'for-of' AND size(bindings) > 0")
    # Only keys with such a loop are looked at further; each loop is told once, not with every call in it.
    asked = calls.select(key, "start", "end", "references").join(bound.select(key).distinct(), key, "left_semi")
    free = nesting.in_any(asked, catches.select(key, "start", "end"), key, "_caught").filter("_caught IS NULL").drop("_caught")
    ignoring = nesting.met_without(bound, free, key, "bindings", "references")
    return held.filter("kind <> 'for-of' OR coalesce(size(bindings), 0) <= 0").select(key, "id").unionByName(ignoring)


def duplicate_reports(calls: DataFrame, handler: str, callee: str) -> DataFrame:
    """(handler, n) of handlers whose binding two or more matching calls(handler, callee, references, binding) report."""
    hit = F.col("callee").rlike(callee) & F.array_contains("references", F.col("binding"))
    return calls.filter(hit).groupBy(handler).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")





def ordered_facts(facts: Column) -> Column:
    """facts(start, ord, ...) by start, in their first order where equal."""
    return F.array_sort(facts)


def range_length(start: Column, end: Column) -> Column:
    return end - start


def arrays_equal(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values in the same order; two nulls are equal."""
    return a.eqNullSafe(b)


def retry_delay_ms(retry_after: Column, attempt: Column, now_ms: Column, jitter: Column) -> Column:
    """Milliseconds to wait: the header's seconds or HTTP date (not before now), else 250 doubled by attempt plus up to 100 by jitter (0 to 1)."""
    said = text.trimmed(retry_after)
    seconds = F.when(said == "", 0.0).when(said.rlike(r"\A\+?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"), said.cast("double"))
    date = F.try_to_timestamp(F.concat(F.regexp_extract(said, r"(\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT\z", 1), F.lit(" +0000")), F.lit("dd MMM yyyy HH:mm:ss Z"))
    until = F.when(date.isNotNull(), F.greatest(F.lit(0.0), (F.unix_millis(date) - now_ms).cast("double")))
    return F.coalesce(seconds * 1000, until, F.lit(250.0) * F.pow(F.lit(2.0), attempt) + jitter * 100)


def exit_code(results: DataFrame, errors: Column, severity: Column) -> DataFrame:
    """One row: 2 if any row has an operational error, else 1 if any diagnostic is an error, else 0 (an empty table too)."""
    failed, wrong = F.bool_or(errors), F.bool_or(severity == "error")
    return results.agg(F.when(failed, 2).when(wrong, 1).otherwise(0).alias("exit_code"))


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """All rows of the tables, duplicates kept, with the place of their table in the column part."""
    out = parts[0].withColumn("part", F.lit(0))
    for i, x in enumerate(parts[1:], 1):
        out = out.unionByName(x.withColumn("part", F.lit(i)))
    return out


def id_differences(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, problem): ids of expected alone are missing, of found alone unexpected; nulls are left out."""
    e = expected.select(key, F.lit(1).alias("side")).unionByName(found.select(key, F.lit(2).alias("side"))).filter(F.col(key).isNotNull())
    sides = e.groupBy(key).agg(F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo = hi")
    return sides.select(key, F.when(F.col("lo") == 1, "missing").otherwise("unexpected").alias("problem"))


def distinct_sorted(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): the distinct values of each key in code-point order; nulls are left out."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def cache_storage(entries: DataFrame, content: str) -> DataFrame:
    """One row: the number of entries and the bytes they hold."""
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).alias("bytes"))


def benchmark_summary(cases: DataFrame, fixtures: int) -> DataFrame:
    """One row over cases(repetition, model, accepted, began, ended in ms): totals, throughput in cases a second by the mean duration of repetitions, and models."""
    samples = cases.groupBy("repetition").agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("ok"), (F.max("ended") - F.min("began")).alias("ms"), F.collect_set("model").alias("models"))
    mean = F.avg("ms")
    out = samples.agg(F.sum("n").alias("total"), F.sum("ok").alias("passed"), F.when(mean > 0, fixtures * 1000 / mean).otherwise(0.0).alias("throughput"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))), ",").alias("models"))
    return out.select("total", "passed", (F.col("total") - F.col("passed")).alias("failed"), "throughput", "models")
