"""Evaluation reports and agreements on small cases, with nulls, single runs and empty tables."""

from cairn.operators import eval_report, metrics

CASES = "provider string, model string, repetition int, rule_id string, id string, expected boolean, actual boolean, valid boolean, expected_abstention boolean, actual_abstention boolean, failed boolean, kind string"


def test_lines_of_a_report(spark):
    rows = [("p", "m", 1, "a/long-rule", f"c{i}", i < 8, i < 1, True, None, False, 1 <= i < 8, "x") for i in range(16)]
    rows += [("p", "m", 1, "b", "bad", True, None, False, True, True, True, "x"), (None, "m", 2, None, None, None, None, None, None, None, None, None)]
    got = eval_report.report(spark.createDataFrame(rows, CASES)).orderBy("provider", "model", "section", "place").collect()
    lines = [r.line for r in got if r.provider == "p"]
    assert lines[:9] == [
        "p/m · 1 run",
        "Cases: 17 · passed 9 · failed 8",
        "Detection: 16 scored · 1 invalid",
        "Abstentions: 0/1 expected correct · 0 actual · 0 unexpected",
        "",
        "Rule         Cases  Err   TP   FP   TN   FN    Prec  Recall     FPR  Abstain  Unexp",
        "a/long-rule     16    0    1    0    8    7  100.0%   12.5%    0.0%      0/0      0",
        "b                1    1    0    0    0    0       —       —       —      0/1      0",
        "",
    ]
    assert lines[-2:] == ["  run 1: c7 (a/long-rule)", "  run 1: bad (b)"] or lines[-1] == "  run 1: c7 (a/long-rule)"
    assert lines[10:12] == ["", "Failures:"] and len(lines) == 20
    other = [r.line for r in got if r.provider == ""]
    assert other[0] == "/m · 1 run" and len(other) == 9 and "Failures:" not in other
    assert eval_report.report(spark.createDataFrame([], CASES)).count() == 0


def test_halves_of_tenths_go_up(spark):
    # 1 of 16 is 6.25 %, 1 of 3 is 33.33 %, 2 of 3 is 66.67 %.
    rows = [("p", "m", 1, r, str(i), True, i < hits, True, None, False, False, "") for r, n, hits in (("a", 16, 1), ("b", 3, 1), ("c", 3, 2)) for i in range(n)]
    got = eval_report.report(spark.createDataFrame(rows, CASES)).filter("section = 2").orderBy("place").collect()
    assert [r.line.split()[8] for r in got] == ["6.3%", "33.3%", "66.7%"]


def test_outcomes_count_failed_cases_and_nulls(spark):
    schema = "g int, expected_choices array<string>, actual_choices array<string>, expected_finding boolean, actual_finding boolean, expected_abstention boolean, actual_abstention boolean, accepted boolean"
    rows = [(1, ["a"], ["a"], True, True, None, False, True), (1, ["a", "b"], ["b", "a"], True, None, True, True, None), (1, None, None, None, None, False, None, False), (1, [], None, False, False, True, False, False)]
    d = spark.createDataFrame(rows, schema)
    x = metrics.outcomes(d, "g").first()
    assert (x.cases, x.label_matches, x.diagnostic_matches, x.abstention_matches, x.strict_matches, x.abstained, x.abstentions_expected) == (4, 2, 3, 2, 1, 1, 2)
    empty = metrics.outcomes(d.limit(0)).first()
    assert empty.cases == 0 and empty.label_rate == empty.strict_rate == 0.0


def test_cycles_match_by_their_fingerprints(spark):
    schema = "scenario string, mean double, requests int, input_tokens int, output_tokens int, fingerprint string"
    rows = [("uncached", 10.0, 9, 90, 18, "f"), ("cold", 12.0, 9, 90, 18, "f"), ("warm", 2.0, 0, 0, 0, "f"), ("incremental", 3.0, 1, 10, 2, "f")]
    x = metrics.cycle_comparison(spark.createDataFrame(rows, schema)).first()
    assert (x.cold_overhead, x.warm_speedup, x.calls_avoided, x.input_tokens_avoided, x.output_tokens_avoided, x.diagnostics_match) == (1.2, 5.0, 9, 90, 18, True)
    for other in ("g", None):
        assert metrics.cycle_comparison(spark.createDataFrame(rows[:3] + [(*rows[3][:5], other)], schema)).first().diagnostics_match is False
    assert metrics.cycle_comparison(spark.createDataFrame([], schema)).first().diagnostics_match is False
