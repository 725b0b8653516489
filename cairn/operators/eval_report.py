"""The report on evaluation runs as rows of text: a group of lines for each provider and model, made without collecting the cases."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cairn.operators import metrics

# The columns of the table and their widths, and its note.
HEADINGS = [("Cases", 5), ("Err", 3), ("TP", 3), ("FP", 3), ("TN", 3), ("FN", 3), ("Prec", 6), ("Recall", 6), ("FPR", 6), ("Abstain", 7), ("Unexp", 5)]
NOTE = "Rates describe this fixture corpus; Cases shows the sample support."

_BY = ["provider", "model"]


def _left(c: Column, width) -> Column:
    return F.rpad(c, F.greatest(F.length(c), width), " ")


def _right(c: Column, width: int) -> Column:
    c = c.cast("string")
    return F.lpad(c, F.greatest(F.length(c), F.lit(width)), " ")


def _rate(part: Column, whole: Column) -> Column:
    """Per cent with one digit, halves up, worked out in whole numbers; a dash over nothing."""
    tenths = F.floor((part * 2000 + whole) / (whole * 2))
    whole_digits = F.floor(tenths / 10).cast("string")
    return F.when(whole > 0, F.concat(whole_digits, F.lit("."), (tenths % 10).cast("string"), F.lit("%"))).otherwise("—")


def _counted(cases: DataFrame, *by: str) -> DataFrame:
    """cases, failed, detection and abstention counts by the given columns: one pass each, partial counts first."""
    n = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.coalesce("failed", F.lit(False))).alias("failed"), F.count_if(~F.coalesce("valid", F.lit(False))).alias("invalid"), F.countDistinct("repetition").alias("runs"))
    found = metrics.detection_metrics(cases, *by).select(*by, "tp", "fp", "tn", "fn")
    held = cases.select(*by, F.col("expected_abstention").alias("expected"), F.col("actual_abstention").alias("actual"), "valid")
    held = metrics.abstention_metrics(held, *by).withColumnsRenamed({c: f"abstention_{c}" for c in ("expected", "actual", "correct", "unexpected")})
    return n.join(found, list(by)).join(held, list(by))


def report(cases: DataFrame) -> DataFrame:
    """(provider, model, section, place, line): in this order the report's lines; no rows over no cases.

    cases(provider, model, repetition, rule_id, id, expected, actual, valid, expected_abstention, actual_abstention, failed);
    null names are empty ones. Groups and rules are in order of code points, failures in that of repetitions and ids. All rows of a failed case
    stay rows, so a report may be as long as its failures.
    """
    x = cases.select("repetition", "id", "expected", "actual", "valid", "expected_abstention", "actual_abstention", "failed", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*_BY, "rule_id")])
    groups, rules = _counted(x, *_BY), _counted(x, *_BY, "rule_id")
    width = rules.groupBy(*_BY).agg(F.greatest(F.max(F.length("rule_id")), F.lit(len("Rule"))).alias("width"))
    groups = groups.join(width, _BY)
    c = F.col
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    s = lambda name: c(name).cast("string")
    head = [
        text(c("provider"), "/", c("model"), " · ", s("runs"), F.when(c("runs") == 1, " run").otherwise(" runs")),
        text("Cases: ", s("cases"), " · passed ", (c("cases") - c("failed")).cast("string"), " · failed ", s("failed")),
        text("Detection: ", (c("cases") - c("invalid")).cast("string"), " scored · ", s("invalid"), " invalid"),
        text("Abstentions: ", s("abstention_correct"), "/", s("abstention_expected"), " expected correct · ", s("abstention_actual"), " actual · ", s("abstention_unexpected"), " unexpected"),
        F.lit(""),
        F.concat_ws("  ", _left(F.lit("Rule"), c("width")), *[_right(F.lit(h), w) for h, w in HEADINGS]),
    ]
    place = lambda i: F.lit(f"{i:02}")
    lines = lambda rows, section, texts: rows.select(*_BY, F.explode(F.array(*[F.struct(F.lit(section).alias("section"), place(i).alias("place"), t.alias("line")) for i, t in enumerate(texts)])).alias("_l")).select(*_BY, "_l.*")
    cells = [c("cases"), c("invalid"), c("tp"), c("fp"), c("tn"), c("fn"), _rate(c("tp"), c("tp") + c("fp")), _rate(c("tp"), c("tp") + c("fn")), _rate(c("fp"), c("fp") + c("tn")), text(s("abstention_correct"), "/", s("abstention_expected")), c("abstention_unexpected")]
    table = rules.join(width, _BY).select(*_BY, F.lit(2).alias("section"), c("rule_id").alias("place"), F.concat_ws("  ", _left(c("rule_id"), c("width")), *[_right(v, w) for v, (_, w) in zip(cells, HEADINGS)]).alias("line"))
    failed = x.filter("failed").select(*_BY, F.lit(5).alias("section"), text(F.lpad(s("repetition"), 10, "0"), ":", s("id")).alias("place"), text("  run ", s("repetition"), ": ", s("id"), " (", c("rule_id"), ")").alias("line"))
    return reduce(DataFrame.unionByName, [lines(groups, 1, head), table, lines(groups, 3, [F.lit(""), F.lit(NOTE)]), lines(groups.filter("failed > 0"), 4, [F.lit(""), F.lit("Failures:")]), failed])
