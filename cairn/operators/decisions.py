"""From rules and candidates to answers and findings: configuration, batches, the cache, providers and severities."""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions import text


def severity(probability: Column, confidence: Column, warn: Column, error: Column, least: Column) -> Column:
    """error or warning by inclusive thresholds; null below both, at too little confidence, and for anything not finite."""
    inf = float("inf")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (c > -inf) & (c < inf)
    return F.when(~(finite(probability) & finite(confidence)) | (confidence < least) | (probability < warn), None).when(probability >= error, "error").when(probability >= warn, "warning")


def capped(found: Column, cap: Column) -> Column:
    """A rule that only warns turns errors into warnings; no severity is raised."""
    return F.when(found.isNotNull(), F.when(cap == "warning", "warning").otherwise(found))


def choice_probability(kind: Column, choice: Column, probabilities: Column, finding: Column) -> Column:
    """The probability of the finding where an answer chose it (0 if its map lacks it); null for every other answer."""
    return F.when((kind == "choice") & (choice == finding), F.coalesce(F.try_element_at(probabilities, finding), F.lit(0.0)))


def resolved_rules(config: DataFrame, plugins: DataFrame) -> DataFrame:
    """config(rule_id, severity) with namespace, name, cap and problem, one row each; nothing is dropped.

    plugins(namespace, name) lists the rules there are. The namespace ends at the first slash. problem says why a
    rule can't run (null: it can); cap is null for such rules and for those that are off.
    """
    at = F.instr("rule_id", "/")
    x = config.withColumns({"namespace": F.expr("substring(rule_id, 1, instr(rule_id, '/') - 1)"), "name": F.expr("substring(rule_id, instr(rule_id, '/') + 1)")})
    p = plugins.select("namespace", "name").distinct()
    x = x.join(p.select("namespace").distinct().withColumn("_plugin", F.lit(True)), "namespace", "left")
    x = x.join(p.withColumn("_rule", F.lit(True)), ["namespace", "name"], "left")
    problem = F.when((at <= 1) | (at == F.length("rule_id")), "syntax").when(F.col("_plugin").isNull(), "no plugin").when(F.col("_rule").isNull(), "no rule")
    problem = problem.when(~F.coalesce(F.col("severity").isin("off", "warn", "error"), F.lit(False)), "configuration")
    x = x.withColumn("problem", problem)
    cap = F.when(F.col("problem").isNull(), F.when(F.col("severity") == "warn", "warning").when(F.col("severity") == "error", "error"))
    return x.withColumn("cap", cap).drop("_plugin", "_rule")


def with_every_rule(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """rows once for each configured (rule_id, cap), in order: an explode of a literal, without a join or a shuffle."""
    if not rules:
        return rows.withColumns({"rule_ord": F.lit(0), "rule_id": F.lit(""), "cap": F.lit("")}).filter(F.lit(False))
    array = F.array(*[F.struct(F.lit(i).alias("rule_ord"), F.lit(r).alias("rule_id"), F.lit(c).alias("cap")) for i, (r, c) in enumerate(rules)])
    return rows.withColumn("_rule", F.explode(array)).select(*rows.columns, "_rule.*")


def question_id(rule_id: Column, place: Column) -> Column:
    """The key of a question in its batch."""
    return F.concat_ws("_", text.sanitize_id(rule_id), place.cast("string"))


def answered(candidates: DataFrame, answers: DataFrame, on: list[str]) -> DataFrame:
    """candidates with their answers' columns and problem: 'missing answer' where there is none."""
    x = candidates.join(answers.withColumn("_there", F.lit(True)), on, "left")
    return x.withColumn("problem", F.when(F.col("_there").isNull(), "missing answer")).drop("_there")


def answer_problem(answer: Column, kind: Column, labels: Column) -> Column:
    """The first reason why an answer(type, choice, score, noul, confidence, probabilities) to a question of the kind choice, score or noul is of no use; null if there is none.

    labels are a choice's criteria, or a score's from the lowest: its labels are their places, and it may lie between them.
    Probabilities must name exactly the labels, and all numbers be finite and between 0 and 1.
    """
    steps = F.when(F.size(labels) > 0, F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    expected = F.when(kind == "score", steps).otherwise(labels)
    shares, noul = answer["probabilities"], kind == "noul"
    fits = {
        "missing answer": answer.isNotNull(),
        "wrong type": (answer["type"] == kind) & kind.isin("choice", "score", "noul"),
        "invalid noul": ~noul | text.is_probability(answer["noul"]),
        "invalid choice": (kind != "choice") | F.array_contains(labels, answer["choice"]),
        "invalid score": (kind != "score") | (~F.isnan(answer["score"]) & answer["score"].between(F.lit(0), F.size(labels) - 1)),
        "invalid confidence": noul | text.is_probability(answer["confidence"]),
        "invalid labels": noul | text.same_keys(F.map_keys(shares), F.array_distinct(expected)),
        "invalid probability": noul | F.forall(F.map_values(shares), text.is_probability),
    }
    return F.coalesce(*[F.when(~F.coalesce(fit, F.lit(False)), F.lit(problem)) for problem, fit in fits.items()])


def cache_key(provider: Column, state: Column, questions: Column, version: int = 1) -> Column:
    """SHA-256 over the version, the provider and the whole request, each part's length before it."""
    parts = [F.lit(str(version)), provider, state, questions]
    return F.sha2(F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in parts]), 256)


def cache_hits(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """requests with the cached response, null where there is none; several entries of a key count as the last by `written`."""
    last = cache.groupBy(key).agg(F.max_by("response", "written").alias("response"))
    return requests.join(last, key, "left")


def cache_misses(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The requests to make: those whose key is not in the cache, once each."""
    return requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def evaluate(requests: DataFrame, provider: Callable[[], Callable[[str], str]], payload: str, concurrency: int = 32) -> DataFrame:
    """requests with response and error, from a provider made once in each task and called with `concurrency` payloads in flight.

    A call that raises gives its own row an error and no response; all other rows go on. A null payload is an error.
    """
    fields = requests.schema.simpleString()[len("struct<") : -1]

    def run(batches):
        call = provider()

        def one(x):
            if x is None:
                return None, "no payload"
            try:
                return call(x), None
            except Exception as e:  # a provider's failure is data
                return None, str(e) or type(e).__name__

        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                got = list(pool.map(one, b[payload].astype(object).where(b[payload].notna(), None)))
                yield b.assign(response=pd.Series([r for r, _ in got], dtype=object, index=b.index), error=pd.Series([e for _, e in got], dtype=object, index=b.index))

    return requests.mapInPandas(run, f"{fields}, response string, error string")


def run_stats(requests: DataFrame) -> DataFrame:
    """Counters over requests(cached, error, input_tokens, output_tokens): failed calls count, their tokens do not."""
    call = ~F.col("cached")
    good = call & F.col("error").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0)).cast("long").alias(c)
    return requests.agg(F.count_if(call).alias("requests"), F.count_if("cached").alias("cache_hits"), total("input_tokens"), total("output_tokens"))
