"""From source files to diagnostics: comments and functions, candidates, directives, requests, answers and severities."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from cairn.functions import text
from cairn.functions.recovery import kept
from cairn.operators import decisions, evidence, joins
from cairn.plans import rules
from cairn.sources import functions, scripts

ANSWERS = "map<string, struct<type: string, choice: string, confidence: double, probabilities: map<string, double>>>"
PLACE = ["filename", "start", "end", "line", "column"]


def candidates(files: DataFrame, tool: str = "cairn") -> DataFrame:
    """(*PLACE, rule_id, state) of what the comment and security rules ask about, without what directives suppress.

    state is canonical JSON. A comment that is itself the line directive does not suppress its own target.
    """
    notes = scripts.comments(files)
    asked = rules.comment_candidates(notes, tool).withColumn("state", F.to_json(F.struct(text.bounded_evidence(F.col("value"), 1000).alias("comment"), F.col("style").alias("style"))))
    code = rules.security_candidates(functions.bounded(functions.functions(files), None))
    code = code.withColumn("state", F.to_json(F.struct(F.slice("callees", 1, 20).alias("calls"), text.bounded_evidence(F.col("source"), 4000).alias("function"), "name")))
    found = asked.select(*PLACE, "rule_id", "state").unionByName(code.select(*PLACE, "rule_id", "state"))
    return unsuppressed(found, notes, tool)


def unsuppressed(found: DataFrame, notes: DataFrame, tool: str) -> DataFrame:
    """found(*PLACE, rule_id) that neither a line nor a region directive among notes suppresses."""
    d = notes.withColumn("d", text.directive(F.col("value"), tool)).filter("d IS NOT NULL").select("filename", "start", "end", "line", "end_line", "d.*")
    next_line = F.col("command") == "disable-next-line"
    lines = d.filter(F.col("command").isin("disable-line", "disable-next-line"))
    lines = lines.select(F.col("filename").alias("_f"), F.when(next_line, F.col("end_line") + 1).otherwise(F.col("line")).alias("_l"), F.col("start").alias("_s"), F.col("end").alias("_e"), "rules")
    itself = (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e"))
    hit = (F.col("filename") == F.col("_f")) & (F.col("line") == F.col("_l")) & ~itself & (F.col("rules").isNull() | F.expr("array_contains(rules, rule_id)"))
    left = found.join(lines, hit, "left_anti")
    regions = d.filter(F.col("command").isin("disable", "enable")).select("filename", F.col("end").alias("at"), F.col("end").alias("ord"), (F.col("command") == "disable").alias("off"), "rules")
    told = joins.region_suppressed(left.withColumns({"at": F.col("start"), "rule": F.col("rule_id")}), regions, "filename")
    return told.filter("NOT suppressed").select(*found.columns)


def requests(found: DataFrame) -> DataFrame:
    """(state_hash, payload): one request per evidence over all files, each rule asked about it once.

    Equal candidates share a question, so a request holds at most one question a rule however often its evidence occurs.
    """
    asked = found.select(evidence.state_hash(F.col("state")).alias("state_hash"), "state", "rule_id").distinct()
    questions = asked.groupBy("state_hash").agg(F.first("state").alias("state"), F.array_sort(F.collect_list("rule_id")).alias("rules"))
    return questions.select("state_hash", F.to_json(F.struct("state", F.transform("rules", lambda r: F.struct(text.sanitize_id(r).alias("id"), r.alias("rule"))).alias("questions"))).alias("payload"))


def diagnose(found: DataFrame, answers: DataFrame, warn_only: tuple[str, ...] = (), criteria: dict[str, list[str]] | None = None) -> DataFrame:
    """found with finding, probability, severity and problem, from answers(state_hash, response, error).

    A failed request is the problem of all its candidates, as is an answer that is missing or no choice with numbers
    between 0 and 1 for it; other requests go on. Where criteria name a rule's choices, an answer must give exactly these
    their probabilities. severity is null where nothing is to be reported.
    """
    x = found.withColumn("state_hash", evidence.state_hash(F.col("state"))).join(answers.select("state_hash", F.from_json("response", ANSWERS).alias("_r"), "error"), "state_hash", "left")
    x = x.withColumn("_a", F.try_element_at("_r", text.sanitize_id(F.col("rule_id")))).withColumn("_t", rules.thresholds(F.col("rule_id")))
    numbers = F.map_values("_a.probabilities")
    good = (F.col("_a.type") == "choice") & F.col("_a.choice").isNotNull() & text.is_probability(F.col("_a.confidence")) & F.forall(numbers, lambda p: text.is_probability(p))
    good = good & F.map_contains_key("_a.probabilities", F.col("_a.choice"))
    if criteria:
        known = F.try_element_at(F.create_map(*[c for r, labels in criteria.items() for c in (F.lit(r), F.array(*map(F.lit, labels)))]), F.col("rule_id"))
        good = good & (known.isNull() | text.same_keys(F.map_keys("_a.probabilities"), F.array_distinct(known)))
    problem = F.coalesce(F.col("error"), F.when(F.col("_a").isNull(), "missing answer"), F.when(~F.coalesce(good, F.lit(False)), "invalid answer"))
    x = x.withColumn("problem", problem)
    p = decisions.choice_probability(F.col("_a.type"), F.col("_a.choice"), F.col("_a.probabilities"), F.col("_t.finding"))
    x = x.withColumn("probability", F.when(F.col("problem").isNull(), p))
    s = decisions.severity(F.col("probability"), F.col("_a.confidence"), F.col("_t.warn"), F.col("_t.error"), F.col("_t.confidence"))
    cap = F.when(F.col("rule_id").isin(*warn_only), "warning") if warn_only else F.lit(None).cast("string")
    return x.withColumn("severity", decisions.capped(s, cap)).select(*found.columns, F.col("_t.finding").alias("finding"), "probability", "severity", "problem")


def run(files: DataFrame, provider: Callable[[], Callable[[str], str]], tool: str = "cairn", concurrency: int = 32, criteria: dict[str, list[str]] | None = None) -> DataFrame:
    """The diagnosed candidates of files(filename, source). Answers are kept before they are used, so no call is made twice for one plan."""
    found = kept(candidates(files, tool))
    answers = kept(decisions.evaluate(requests(found), provider, "payload", concurrency))
    return diagnose(found, answers, criteria=criteria)
