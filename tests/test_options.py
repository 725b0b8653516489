"""Failures kept to their file and rule, patterns of one's own and pagination, with nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import runs, syntax
from cairn.plans import fact_rules


def test_failures_drop_their_own_file_and_rule_only(spark):
    c = [("a", "r", 1), ("a", "r", 2), ("a", "s", 1), ("b", "r", 1), (None, "r", 1), (None, "s", 1), ("a", None, 1)]
    p = [("a", "r", 2, "late"), ("a", "r", 1, "y"), ("a", "r", 1, "x"), (None, "r", 5, "of null"), ("gone", "r", None, "z"), ("gone", "r", 3, "first")]
    candidates = spark.createDataFrame(c, "file string, rule string, id int")
    problems = spark.createDataFrame(p, "file string, rule string, place int, error string")
    x = runs.isolated(candidates, problems)
    assert sorted(map(tuple, x.candidates.collect()), key=repr) == sorted([("a", "s", 1), ("b", "r", 1), (None, "s", 1), ("a", None, 1)], key=repr)
    assert sorted(map(tuple, x.errors.collect()), key=repr) == sorted([("a", "r", "x", 3), (None, "r", "of null", 1), ("gone", "r", "first", 2)], key=repr)
    none = runs.isolated(candidates, problems.limit(0))
    assert none.candidates.count() == len(c) and none.errors.count() == 0
    assert runs.isolated(candidates.limit(0), problems).candidates.count() == 0


def test_custom_patterns_are_added_to_the_fixed_ones(spark):
    callees = ["console.error", "audit", "audit.debug", "boom", "captureException", "startSpan", None, "else"]
    d = spark.createDataFrame([(c,) for c in callees], "c string")
    kinds = lambda **custom: {r.c: r.k for r in d.select("c", fact_rules.call_kind(F.col("c"), **custom).alias("k")).collect()}
    plain = {"console.error": "error_log", "audit": None, "audit.debug": None, "boom": None, "captureException": "exception_telemetry", "startSpan": "telemetry_name", None: None, "else": None}
    assert kinds() == plain
    assert kinds(logging=["^audit"], exception_telemetry=["^boom"], telemetry_name=["Exception"]) == plain | {"audit": "log", "audit.debug": "diagnostic_log", "boom": "exception_telemetry", "captureException": "telemetry_name"}
    assert kinds(error_logging=["^audit", "Span"])["audit.debug"] == kinds(error_logging=["Span"])["startSpan"] == "error_log"
    with pytest.raises(ValueError, match="loging"):
        fact_rules.call_kind(F.col("c"), loging=["x"])


def test_pagination_where_nothing_tells(spark):
    shape = "array<struct<kind:string,properties:array<string>,value:string>>"
    rows = [(1, "q.query", None), (2, "query", []), (3, "query", [("literal", None, '"select 1 limit 1"')]), (4, "query", [("literal", None, "3")]), (5, None, [("object", ["LIMIT", "orderby"], None)]), (6, "query", [("object", ["where"], None)]), (7, "query", [("object", [], None), ("object", ["skip"], None), ("object", ["take", "orderBy"], None)]), (8, "query", [("literal", None, "null")])]
    d = spark.createDataFrame(rows, f"id int, c string, a {shape}")
    got = {r.id: r.p and tuple(r.p) for r in d.select("id", syntax.pagination(F.col("c"), F.col("a")).alias("p")).collect()}
    assert got == {1: None, 2: None, 3: (True, False), 4: None, 5: (True, True), 6: None, 7: (True, False), 8: None}
