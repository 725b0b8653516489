"""Places, replay and manifests against plain Python, with one group over many partitions and odd rows."""

import math
import random

import pytest

from cairn.operators import merkle, nesting, ordinals


@pytest.fixture
def many_cuts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_places_are_gapless_within_groups(many_cuts):
    r = random.Random(3)
    rows = [(r.choice(["a"] * 9 + ["b", None]), r.randrange(50), i) for i in range(2000)]
    x = ordinals.within(many_cuts.createDataFrame(rows, "g string, v int, id int"), ["g"], ["v", "id"]).collect()
    for g in ("a", "b", None):
        want = [i for _, _, i in sorted((h, v, i) for h, v, i in rows if h == g)] if g else [i for _, i in sorted((v, i) for h, v, i in rows if h is None)]
        assert [y.id for y in sorted((y for y in x if y.g == g), key=lambda y: y.place)] == want
        assert sorted(y.place for y in x if y.g == g) == list(range(len(want)))


def test_percentiles_are_those_of_nearest_ranks(many_cuts):
    r = random.Random(4)
    rows = [("one", 7.0), ("null", None)] + [("hot", float(r.randrange(90))) for _ in range(1500)]
    got = {x.g: (x.p50, x.p95) for x in ordinals.percentiles(many_cuts.createDataFrame(rows, "g string, v double"), "g", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    hot = sorted(v for g, v in rows if g == "hot")
    assert got == {"one": (7.0, 7.0), "hot": (hot[math.ceil(0.5 * 1500) - 1], hot[math.ceil(0.95 * 1500) - 1])}


def test_replay_names_missing_and_surplus_answers(spark):
    c = spark.createDataFrame([("x", 2, 20), ("x", 1, 10), ("y", 1, 30), (None, 1, 40)], "id string, ord int, candidate int")
    a = spark.createDataFrame([("x", 5, "safe"), ("z", 1, "finding"), (None, 1, None), ("y", 1, "finding"), ("y", 2, "safe")], "id string, ord int, answer string")
    rows = ordinals.replayed(c, a, "id", "ord")
    got = sorted(map(tuple, rows.collect()), key=repr)
    want = [("x", 0, 10, "safe", "answered"), ("x", 1, 20, None, "missing"), ("y", 0, 30, "finding", "answered"), ("y", 1, None, "safe", "surplus"), ("z", 0, None, "finding", "surplus"), (None, 0, 40, None, "answered")]
    assert got == sorted(want, key=repr)
    cases = spark.createDataFrame([("x", False, 2, "finding"), ("y", True, 1, "finding"), ("w", False, 0, "finding")], "id string, expected_finding boolean, expected_candidates int, finding_choice string")
    res = {r.id: (r.actual_candidates, r.actual_finding, r.errors, r.agrees) for r in ordinals.case_results(cases, rows, "id").collect()}
    assert res == {"x": (2, False, 1, False), "y": (1, True, 1, False), "w": (0, False, 0, True)}
    empty = ordinals.replayed(c.limit(0), a.limit(0), "id", "ord")
    assert empty.count() == 0


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_manifests_name_what_changed(spark, depth):
    ours = [(i, f"t{i}" if i % 7 else None, i % 3) for i in range(500)] + [(None, "", 0)]
    pinned = [r for r in ours if r[0] != 17] + [(900, "new", 0)]
    pinned[40] = (pinned[40][0], "other", 0)
    pinned[42] = (pinned[42][0], "", pinned[42][2])
    a, b = (spark.createDataFrame(x, "id int, t string, n int") for x in (ours, pinned))
    changed = {40: "changed", 43: "changed"} if pinned[42][0] == 43 else {40: "changed", 42: "changed"}
    got = {r.key: r.change for r in merkle.changes(a, b, "id", depth).collect()}
    assert got == {17: "added", 900: "removed", pinned[40][0]: "changed", pinned[42][0]: "changed"} and len(changed) == 2
    root = lambda x: merkle.manifest(x, "id", depth).filter("range = ''").first()
    assert root(a) == root(a.orderBy("t").repartition(3)) and root(a).hash != root(b).hash and root(a).rows == 501
    assert merkle.changes(a, a.repartition(2), "id", depth).count() == 0
    # Below an equal range nothing is compared, so few of the lowest ranges are left.
    if depth:
        assert merkle.differing(merkle.manifest(a, "id", depth), merkle.manifest(b, "id", depth), depth).count() <= 4


def test_what_a_range_holds(spark):
    outer = spark.createDataFrame([("f", 1, 0, 10), ("f", 2, 20, 30), ("g", 3, 0, 10), ("f", 4, 5, 5)], "k string, id long, start long, end long")
    inner = spark.createDataFrame([("f", 7, 3, 9), ("f", 8, 9, 21), ("f", 9, 5, 5), ("f", 10, 25, 21)], "k string, id long, start long, end long")
    got = {(r.k, r.id): (r.start, r.end, r.held is not None) for r in nesting.holds_any(outer, inner, "k", "held").collect()}
    assert got == {("f", 1): (0, 10, True), ("f", 2): (20, 30, False), ("g", 3): (0, 10, False), ("f", 4): (5, 5, True)}
