"""Places in a global order, and what follows from them: streams aligned by place, exact percentiles.

Rows are dealt to partitions by ranges of the order. A row's place is its place in its partition and the rows of the
partitions before, so no task sees more than one partition, also where one group holds most rows.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from cairn.functions.recovery import kept

#: The bits of monotonically_increasing_id that count inside a partition.
INSIDE = (1 << 33) - 1


def with_place(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """rows with their place, from 0, in the order of the columns; rows of equal order take places next to each other.

    Order by columns that tell rows apart where the places must not change between runs. Nulls come first.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(INSIDE)).alias("_in"))
    x = kept(x)
    sizes = x.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition, so one task can add them up
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return x.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_p", "_before")


def within(rows: DataFrame, group: list[str], order: list, name: str = "place") -> DataFrame:
    """rows with their place, from 0, in the order of the columns inside their group; null groups are a group each."""
    x = with_place(rows, [*group, *order], "_global")
    first = x.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.min("_global").alias("_first"))
    same = F.lit(True)
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    return x.join(first, same).withColumn(name, F.col("_global") - F.col("_first")).drop("_global", "_first", *[f"_{g}" for g in group])


def replayed(candidates: DataFrame, answers: DataFrame, case: str, order: str) -> DataFrame:
    """(case, n, candidate, answer, state): the n-th of candidates(case, order, candidate) of a case takes the n-th of its answers(case, order, answer).

    state is `answered`, `missing` for a candidate without an answer, or `surplus` for an answer that no candidate
    consumes. A null answer is an answer. Equal orders are told apart by candidate or answer.
    """
    c = within(candidates.select(case, order, "candidate"), [case], [order, "candidate"], "n").select(F.col(case).alias("_c"), F.col("n").alias("_n"), "candidate", F.lit(True).alias("_asked"))
    a = within(answers.select(case, order, "answer"), [case], [order, "answer"], "n").select(case, "n", "answer", F.lit(True).alias("_given"))
    both = c.join(a, F.col("_c").eqNullSafe(F.col(case)) & (F.col("_n") == F.col("n")), "full")
    state = F.when(F.col("_asked").isNull(), "surplus").when(F.col("_given").isNull(), "missing").otherwise("answered")
    return both.select(F.when(F.col("_asked"), F.col("_c")).otherwise(F.col(case)).alias(case), F.coalesce("_n", "n").alias("n"), "candidate", "answer", state.alias("state"))


def case_results(cases: DataFrame, rows: DataFrame, case: str) -> DataFrame:
    """cases(case, expected_finding, expected_candidates, finding_choice) with what replayed() rows say of each.

    actual_candidates; actual_finding: an answer is the case's finding choice; errors: missing and surplus answers; agrees:
    no errors, and candidates and finding as expected. A case without rows has no candidates and no finding.
    """
    x = rows.withColumnRenamed(case, "_case").join(cases.select(F.col(case).alias("_id"), "finding_choice"), F.col("_case").eqNullSafe(F.col("_id")))
    sums = x.groupBy("_id").agg(
        F.count_if(F.col("state") != "surplus").alias("actual_candidates"),
        F.coalesce(F.bool_or((F.col("state") == "answered") & (F.col("answer") == F.col("finding_choice"))), F.lit(False)).alias("actual_finding"),
        F.count_if(F.col("state") != "answered").alias("errors"),
    )
    out = cases.join(sums, F.col(case).eqNullSafe(F.col("_id")), "left").drop("_id")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("actual_candidates", "errors")} | {"actual_finding": F.coalesce("actual_finding", F.lit(False))}
    agrees = (F.col("errors") == 0) & F.col("actual_candidates").eqNullSafe(F.col("expected_candidates")) & F.col("actual_finding").eqNullSafe(F.col("expected_finding"))
    return out.withColumns(zero).withColumn("agrees", agrees)


def percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, *shares): the nearest-rank percentiles of the values of each group, null values left out; a group without values has none."""
    x = within(rows.filter(F.col(value).isNotNull()).select(group, value), [group], [value])
    n = x.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    x = x.join(n, F.col(group).eqNullSafe(F.col("_g")))
    rank = lambda share: F.greatest(F.ceil(F.lit(share) * F.col("_n")), F.lit(1)) - 1
    picked = x.filter(F.exists(F.array(*[rank(s) for s in shares.values()]), lambda r: r == F.col("place")))
    return picked.groupBy(group).agg(*[F.max(F.when(F.col("place") == rank(s), F.col(value))).alias(name) for name, s in shares.items()])
