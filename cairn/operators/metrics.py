"""Evaluation metrics."""

from pyspark.sql import Column, DataFrame, functions as F


def detection_metrics(cases: DataFrame, *by: str) -> DataFrame:
    """Confusion counts and ratios of cases(expected, actual, valid), by the given columns; a ratio over nothing is null."""
    e, a, ok = F.col("expected"), F.col("actual"), F.col("valid")
    n = lambda c: F.count_if(ok & c)
    x = cases.groupBy(*by).agg(n(e & a).alias("tp"), n(~e & a).alias("fp"), n(~e & ~a).alias("tn"), n(e & ~a).alias("fn"))
    ratio = lambda num, den: F.expr(f"try_divide({num}, {den})")
    x = x.withColumns({"precision": ratio("tp", "tp + fp"), "recall": ratio("tp", "tp + fn"), "fpr": ratio("fp", "fp + tn"), "specificity": ratio("tn", "fp + tn")})
    return x.withColumn("f1", ratio("2 * tp", "2 * tp + fp + fn"))


def nearest_rank(value: str, fraction: float) -> Column:
    """The nearest-rank percentile, 0 over no rows."""
    return F.coalesce(F.expr(f"percentile_disc({fraction}) within group (order by {value})"), F.lit(0.0))


def agreement(expected: Column, actual: Column) -> list:
    """correct, incorrect and rate (0 over no rows) over all cases, nulls equal."""
    same = F.count_if(expected.eqNullSafe(actual))
    return [same.alias("correct"), F.count_if(~expected.eqNullSafe(actual)).alias("incorrect"), F.coalesce(F.try_divide(same, F.count(F.lit(1))), F.lit(0.0)).alias("rate")]


def outcomes(cases: DataFrame, *by: str) -> DataFrame:
    """Four agreements over all cases, failed ones too: labels, diagnostics, abstentions and strict, each with matches and rate.

    cases(expected_choices, actual_choices, expected_finding, actual_finding, expected_abstention, actual_abstention, accepted);
    a null expected abstention is none, a null of any other column equals only a null. abstained and abstentions_expected count the abstentions.
    """
    none = F.lit(False)
    wanted = F.coalesce("expected_abstention", none)
    same = {
        "label": F.col("expected_choices").eqNullSafe(F.col("actual_choices")),
        "diagnostic": F.col("expected_finding").eqNullSafe(F.col("actual_finding")),
        "abstention": wanted.eqNullSafe(F.col("actual_abstention")),
        "strict": F.coalesce("accepted", none),
    }
    n = F.count(F.lit(1))
    counts = [c for name, s in same.items() for c in (F.count_if(s).alias(f"{name}_matches"), F.coalesce(F.try_divide(F.count_if(s), n), F.lit(0.0)).alias(f"{name}_rate"))]
    return cases.groupBy(*by).agg(n.alias("cases"), *counts, F.count_if("actual_abstention").alias("abstained"), F.count_if(wanted).alias("abstentions_expected"))


def abstention_metrics(cases: DataFrame, *by: str) -> DataFrame:
    """Counts over cases(expected, actual, valid): expected over all of them, the others over valid ones; a null expected is none."""
    e, a = F.coalesce(F.col("expected"), F.lit(False)), F.col("valid") & F.col("actual")
    return cases.groupBy(*by).agg(F.count_if(e).alias("expected"), F.count_if(a).alias("actual"), F.count_if(a & e).alias("correct"), F.count_if(a & ~e).alias("unexpected"))


def summary(value: str) -> list:
    """mean, p50 and p95 of a group; the mean of nothing is NaN."""
    return [F.coalesce(F.avg(value), F.lit(float("nan"))).alias("mean"), nearest_rank(value, 0.5).alias("p50"), nearest_rank(value, 0.95).alias("p95")]


def found_in_any(cases: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """cases(key, expected) with findings and status: a finding of any repetition detects the case."""
    n = findings.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    x = cases.join(n, key, "left").withColumn("findings", F.coalesce("n", F.lit(0)).cast("long")).drop("n")
    found = F.col("findings") > 0
    hit = F.when(found, "hit").otherwise("miss")
    return x.withColumn("status", F.when(F.col("expected"), hit).otherwise(F.when(found, "false_positive").otherwise("correct_rejection")))


def agreed_in_all(cases: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """cases(key, expected) with status: matched if each of runs(key, found, failed) agrees; error if one failed or there is none."""
    told = runs.groupBy(key).agg(F.bool_or("failed").alias("failed"), F.bool_and("found").alias("all"), F.bool_or("found").alias("any"))
    x = cases.join(told, key, "left")
    agree = F.when(F.col("expected"), F.col("all")).otherwise(~F.col("any"))
    status = F.when(F.coalesce("failed", F.lit(True)), "error").when(agree, "matched").otherwise("miss")
    return x.withColumn("status", status).drop("failed", "all", "any")


def usage(*by: str):
    """A function of samples(input_tokens, output_tokens, repetition): totals and means of a repetition, by the given columns."""

    def apply(samples: DataFrame) -> DataFrame:
        x = samples.groupBy(*by).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.countDistinct("repetition").alias("repetitions"))
        each = lambda c: F.try_divide(F.col(c), F.col("repetitions")).alias(f"{c}_each")
        return x.select("*", each("input_tokens"), each("output_tokens"))

    return apply


def repetitions(samples: DataFrame, *by: str) -> DataFrame:
    """Per repetition of samples(repetition, latency, ended, began): cases, seconds, cases a second (0 in no time), p50 and p95 of latency."""
    x = samples.groupBy(*by, "repetition").agg(F.count(F.lit(1)).alias("cases"), (F.max("ended") - F.min("began")).alias("seconds"), nearest_rank("latency", 0.5).alias("p50"), nearest_rank("latency", 0.95).alias("p95"))
    return x.withColumn("cases_a_second", F.coalesce(F.try_divide(F.col("cases").cast("double"), F.col("seconds").cast("double")), F.lit(0.0)))


def baseline_report(cases: DataFrame, *by: str) -> DataFrame:
    """Over cases(category, expected, latency): applicable cases, those right, their share, recall of the expected, mean latency (0 over nothing) and p95.

    Operational errors are applicable misses; unsupported cases are left out of all but their count.
    """
    use, good = F.col("category") != "unsupported", F.col("category") == "correct"
    x = cases.groupBy(*by).agg(
        F.count_if(use).alias("applicable"), F.count_if(good).alias("correct"), F.count_if(~use).alias("unsupported"), F.count_if(use & F.col("expected")).alias("positives"),
        F.count_if(good & F.col("expected")).alias("found"), F.coalesce(F.avg(F.when(use, F.col("latency"))), F.lit(0.0)).alias("mean"),
        F.coalesce(F.expr("percentile_disc(0.95) within group (order by if(category <> 'unsupported', latency, null))"), F.lit(0.0)).alias("p95"),
    )
    return x.withColumns({"correctness": F.expr("try_divide(correct, applicable)"), "recall": F.expr("try_divide(found, positives)")})


def scanner_summary(cases: DataFrame, *by: str) -> DataFrame:
    """Over cases(status, expected) of one scanner: counts, accuracy and recall of the supported ones; null over nothing."""
    s = F.col("status")
    n = lambda c, to: F.count_if(c).alias(to)
    x = cases.groupBy(*by).agg(
        n(s != "unsupported", "supported"), n(s.isin("hit", "correct_rejection"), "correct"), n(s == "miss", "misses"), n(s == "false_positive", "false_positives"),
        n((s != "unsupported") & F.col("expected"), "expected_issues"), n(s == "hit", "detected"), n(s == "unsupported", "unsupported"),
    )
    return x.withColumns({"accuracy": F.expr("try_divide(correct, supported)"), "recall": F.expr("try_divide(detected, expected_issues)")})


def scope_summary(cases: DataFrame) -> DataFrame:
    """By scope over cases(scope, status): matched, misses, errors, and accuracy, which leaves errors out."""
    x = cases.groupBy("scope").agg(*[F.count_if(F.col("status") == s).alias(to) for s, to in (("matched", "matched"), ("miss", "misses"), ("error", "errors"))])
    return x.withColumn("accuracy", F.expr("try_divide(matched, matched + misses)"))


def capability_recall(cases: DataFrame, *by: str) -> DataFrame:
    """applicable, detected and recall over cases(coverage, found); the recall of nothing is 0."""
    use = F.col("coverage") != "unsupported"
    x = cases.groupBy(*by).agg(F.count_if(use).alias("applicable"), F.count_if(use & F.col("found")).alias("detected"))
    return x.withColumn("recall", F.coalesce(F.expr("try_divide(detected, applicable)"), F.lit(0.0)))


def scenario_summary(samples: DataFrame, duration: str, *constant: str) -> DataFrame:
    """By scenario: mean, p50 and p95 of the duration, each column that repetitions must agree on, and whether they do."""
    same = F.lit(True)
    for c in constant:
        same = same & (F.min(c) == F.max(c))
    return samples.groupBy("scenario").agg(*summary(duration), *[F.min(c).alias(c) for c in constant], same.alias("consistent"))


def scenario_comparison(scenarios: DataFrame) -> DataFrame:
    """One row over scenarios(scenario, mean, requests): overhead of a cold cache, gain of a warm one, and calls it avoids."""
    at = lambda s, c: F.max(F.when(F.col("scenario") == s, F.col(c)))
    return scenarios.agg(
        F.try_divide(at("cold", "mean"), at("uncached", "mean")).alias("cold_overhead"), F.try_divide(at("uncached", "mean"), at("warm", "mean")).alias("warm_speedup"),
        (at("uncached", "requests") - at("warm", "requests")).alias("calls_avoided"),
    )


def cycle_comparison(scenarios: DataFrame) -> DataFrame:
    """scenario_comparison over scenarios with input_tokens, output_tokens and fingerprint too: the tokens that a warm cache saves, and whether all diagnostics are the same."""
    at = lambda s, c: F.max(F.when(F.col("scenario") == s, F.col(c)))
    saved = [(at("uncached", c) - at("warm", c)).alias(f"{c}_avoided") for c in ("input_tokens", "output_tokens")]
    match = (F.count("fingerprint") == F.count(F.lit(1))) & (F.min("fingerprint") == F.max("fingerprint"))
    # Both sides are one row.
    return scenario_comparison(scenarios).join(scenarios.agg(*saved, F.coalesce(match, F.lit(False)).alias("diagnostics_match")), F.lit(True))


def cache_behaves(scenarios: DataFrame, n: int) -> DataFrame:
    """valid: without and with a cold cache n calls and no hit, warm only hits, and one call after one change."""
    want = {"uncached": (n, 0), "cold": (n, 0), "warm": (0, n), "incremental": (1, n - 1)}
    good = F.lit(True)
    for s, (calls, hits) in want.items():
        good = good & (F.count_if((F.col("scenario") == s) & (F.col("requests") == calls) & (F.col("cache_hits") == hits)) == 1)
    return scenarios.agg(good.alias("valid"))


def abstained(choices: Column, marker: str = "insufficient_context") -> Column:
    """True where there are choices and all are the marker."""
    return (F.size(choices) > 0) & F.forall(choices, lambda c: c.eqNullSafe(F.lit(marker)))


def accepted(errors: Column, pairs: list[tuple[Column, Column]], abstention: tuple[Column, Column]) -> Column:
    """Strict agreement: no error, each (expected, actual) equal, and the abstention too where one is expected."""
    out = errors == 0
    for expected, actual in pairs:
        out = out & expected.eqNullSafe(actual)
    return out & (abstention[0].isNull() | abstention[0].eqNullSafe(abstention[1]))


def corpus_problems(fixtures: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, problem) over fixtures(id, rule_id, expected) and rules(rule_id): repeated ids, unknown rules, and rules without both polarities."""
    repeated = fixtures.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated").alias("problem"))
    unknown = fixtures.join(rules, "rule_id", "left_anti").select("id", F.lit("unknown rule").alias("problem"))
    seen = fixtures.groupBy("rule_id").agg(F.bool_or("expected").alias("pos"), F.bool_or(~F.col("expected")).alias("neg"))
    x = rules.join(seen, "rule_id", "left")
    one = lambda c, p: x.filter(~F.coalesce(F.col(c), F.lit(False))).select(F.col("rule_id").alias("id"), F.lit(p).alias("problem"))
    return repeated.unionByName(unknown).unionByName(one("pos", "no positive")).unionByName(one("neg", "no negative"))
