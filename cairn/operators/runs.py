"""Runs over requests with a cache of answers: only what the cache lacks is asked, and a cycle of runs shows it."""

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from cairn.functions.recovery import kept
from cairn.operators import decisions, sinks


class Run(NamedTuple):
    """answers(id, key, response, error) of every request, the cache after the run, and one row of counts."""

    answers: DataFrame
    cache: DataFrame
    sample: DataFrame


def run(requests: DataFrame, cache: DataFrame, provider: Callable[[], Callable[[str], str]], concurrency: int = 32) -> Run:
    """Answers requests(id, key, payload) from cache(key, response), and the rest by the provider, each key once however many requests share it.

    Answers are kept (checkpointed) before they are used, so that none is asked for again when a task is lost. A failed call
    is its requests' error and no entry: the next run asks again. Requests with a null key are never cached and share a
    call by payload. The sample counts calls, keys found in the cache, failed calls, and the cache's entries and bytes.
    """
    asked = requests.groupBy("key", F.when(F.col("key").isNull(), F.col("payload")).alias("_alone")).agg(F.min("payload").alias("payload"))
    held = cache.groupBy("key").agg(F.min("response").alias("response"))
    made = kept(decisions.evaluate(asked.join(held, "key", "left_anti"), provider, "payload", concurrency).select("key", "_alone", "response", "error"))
    found = asked.join(held, "key").select("key", "_alone", "response", F.lit(None).cast("string").alias("error"))
    given = found.unionByName(made).withColumnsRenamed({"key": "_key", "_alone": "_payload"})
    same = F.col("key").eqNullSafe(F.col("_key")) & F.when(F.col("key").isNull(), F.col("payload")).eqNullSafe(F.col("_payload"))
    answers = requests.join(given, same, "left").select("id", "key", "response", "error")
    after = kept(held.unionByName(made.filter("error IS NULL AND key IS NOT NULL").select("key", "response")))
    calls = made.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    stored = after.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.octet_length("response")), F.lit(0)).cast("long").alias("bytes"))
    hits = found.agg(F.count(F.lit(1)).alias("cache_hits"))
    # Three tables of one row each.
    sample = reduce(lambda a, b: a.join(b, F.lit(True)), [hits, stored, sinks.fingerprint(answers, "id", "response", "error")], calls)
    return Run(answers, after, sample)


def cycle(requests: DataFrame, changed: DataFrame, provider: Callable[[], Callable[[str], str]], concurrency: int = 32) -> DataFrame:
    """(scenario, requests, failed, cache_hits, entries, bytes, fingerprint) of four runs: without a cache, with an empty one, with the one this fills, and over `changed` with it too.

    The uncached run stores nothing. The work of the last follows what changed, not the table.
    """
    empty = requests.select("key", F.lit(None).cast("string").alias("response")).limit(0)
    uncached = run(requests, empty, provider, concurrency).sample.withColumns({"entries": F.lit(0).cast("long"), "bytes": F.lit(0).cast("long")})
    cold = run(requests, empty, provider, concurrency)
    samples = {"uncached": uncached, "cold": cold.sample, "warm": run(requests, cold.cache, provider, concurrency).sample, "incremental": run(changed, cold.cache, provider, concurrency).sample}
    return reduce(DataFrame.unionByName, [x.withColumn("scenario", F.lit(name)) for name, x in samples.items()])


class Collected(NamedTuple):
    """judged(id, response, error), the targets that collecting failed for (id, error), the cache after both stages, and their counts (stage, ...)."""

    judged: DataFrame
    problems: DataFrame
    cache: DataFrame
    sample: DataFrame


def _stage(targets: DataFrame, stage: str, provider_id: str) -> DataFrame:
    payload = F.to_json(F.struct(F.lit(stage).alias("stage"), "state"))
    key = F.when(F.col("state").isNotNull(), decisions.cache_key(F.lit(provider_id), F.col("state"), F.lit(stage)))
    return targets.select("id", key.alias("key"), payload.alias("payload"))


def collected(targets: DataFrame, cache: DataFrame, provider: Callable[[], Callable[[str], str]], provider_id: str, wanted: str, concurrency: int = 32) -> Collected:
    """Asks the provider about targets(id, state, suppressed) twice: whether each is a candidate at all, then, if the answer is `wanted`, what to say of it.

    Suppressed targets (null: not suppressed) are never asked about. Payloads are JSON of stage (collect or judge) and
    state; equal states share a call in each stage. Both stages use one cache, and answers of the first are kept before the
    second is planned, so a lost task repeats no call. A target whose first call failed is a problem and not judged; all
    other targets go on.
    """
    open_ = targets.filter(~F.coalesce("suppressed", F.lit(False))).select("id", "state")
    first = run(_stage(open_, "collect", provider_id), cache, provider, concurrency)
    answers = kept(first.answers.select("id", "response", "error"))
    candidates = open_.join(answers.filter(F.col("response") == wanted).select("id"), "id", "left_semi")
    second = run(_stage(candidates, "judge", provider_id), first.cache, provider, concurrency)
    sample = first.sample.withColumn("stage", F.lit("collect")).unionByName(second.sample.withColumn("stage", F.lit("judge")))
    return Collected(second.answers.select("id", "response", "error"), answers.filter("error IS NOT NULL").select("id", "error"), second.cache, sample)


class Isolated(NamedTuple):
    """The candidates of sound (file, rule) pairs, and a row (file, rule, error, failures) for each pair that failed."""

    candidates: DataFrame
    errors: DataFrame


def isolated(candidates: DataFrame, problems: DataFrame, place: str = "place") -> Isolated:
    """Keeps a rule's failure on a file to itself: problems(file, rule, place, error) drop all candidates(file, rule, ...) of their pair and of no other.

    The error is that of the first place (the least text of several there, a null place last). Null files and rules are
    values of their own. Only the failed pairs are looked up, so a pair with many candidates moves none of them when these fit a broadcast.
    """
    last = F.col(place).isNull()
    errors = problems.groupBy("file", "rule").agg(F.min(F.struct(last, place, "error"))["error"].alias("error"), F.count(F.lit(1)).alias("failures"))
    failed = errors.select(F.col("file").alias("_file"), F.col("rule").alias("_rule"))
    same = F.col("file").eqNullSafe(F.col("_file")) & F.col("rule").eqNullSafe(F.col("_rule"))
    return Isolated(candidates.join(failed, same, "left_anti"), errors)
