"""Sweeps over ranges and pointer doubling over chains, against brute force, with keys cut over many partitions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.operators import graphs, joins, nesting

SCHEMA = "k string, id long, start long, end long"


@pytest.fixture
def many_cuts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def ranges(seed, n, width, longest):
    """One key with nine in ten of the rows, crossing, nested, equal and single-place ranges, null keys and places, and ranges that end before they start."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = r.randrange(width)
        rows.append((r.choice("aaaaaaaaab"), i, s, s + r.choice([0, 1, r.randrange(longest), r.randrange(longest) // 8])))
    rows += [(None, n, 1, 5), ("a", n + 1, None, 5), ("a", n + 2, 5, None), ("a", n + 3, 9, 2), ("a", n + 4, 0, width + longest), ("a", n + 5, 0, width + longest)]
    return rows


def good(x):
    return None not in x and x[2] <= x[3]


@pytest.mark.parametrize(("n", "width", "longest"), [(400, 3000, 200), (300, 40, 12), (0, 10, 5)])
def test_sweeps_give_what_all_pairs_give(many_cuts, n, width, longest):
    inner, outer = ranges(1, n, width, longest), ranges(2, n, width, longest)
    a, b = (many_cuts.createDataFrame(x, SCHEMA) for x in (inner, outer))
    holds = lambda o, i: good(o) and good(i) and o[0] == i[0] and o[2] <= i[2] and o[3] >= i[3]
    best = lambda i, of: min(((o[3] - o[2], o[2], o[1]) for o in of), default=(None,) * 3)[2]
    got = {r.id: r.outer_id for r in joins.smallest_enclosing(a, b, "k").collect()}
    assert got == {i[1]: best(i, [o for o in outer if holds(o, i)]) for i in inner}
    got = {r.id: r.parent_id for r in joins.parent(a, "k").collect()}
    assert got == {i[1]: best(i, [o for o in inner if holds(o, i) and o[2:] != i[2:]]) for i in inner}
    for strict in (False, True):
        got = sorted((r.id, r.outer_id) for r in joins.contained(a, b, "k", strict).collect())
        assert got == sorted((i[1], o[1]) for i in inner for o in outer if holds(o, i) and not (strict and o[2:] == i[2:]))


def test_all_partitions_of_a_hot_key_sweep(many_cuts):
    rows = [("a", i, i, 1000 if i % 50 == 0 else i + 3) for i in range(1000)]
    x = many_cuts.createDataFrame(rows, SCHEMA)
    got = {r.id: r.parent_id for r in joins.parent(x, "k").collect()}
    want = {}
    for _, i, s, e in rows:
        around = [(q - p, p, j) for _, j, p, q in rows if p <= s and q >= e and (p, q) != (s, e)]
        want[i] = min(around)[2] if around else None
    assert got == want


def test_a_million_children_are_swept_by_many_tasks(many_cuts):
    children = many_cuts.range(1_000_000).select(F.lit("a").alias("k"), "id", (F.col("id") * 2 + 10).alias("start"), (F.col("id") * 2 + 11).alias("end"))
    outer = many_cuts.createDataFrame([("a", 7, 0, 3_000_000), ("a", 8, 10, 13)], SCHEMA)
    found = nesting.smallest_around(children, outer, "k", "outer").groupBy("outer").count().collect()
    assert {r.outer: r["count"] for r in found} == {7: 999_998, 8: 2}


def test_regions_of_one_kind_and_range_count_once(spark):
    node = "k string, type string, start long, end long, parent_type string, is_argument boolean, final_start long, final_end long"
    rows = [
        ("f", "ForStatement", 0, 100, None, False, None, None), ("f", "WhileStatement", 0, 100, None, False, None, None), ("f", "IfStatement", 0, 100, None, False, None, None),
        ("f", "ArrowFunctionExpression", 10, 90, "CallExpression", True, None, None), ("f", "FunctionExpression", 12, 88, "CallExpression", False, None, None), ("f", "FunctionDeclaration", 13, 87, None, None, None, None),
        ("f", "TryStatement", 20, 80, None, False, 60, 80), ("f", "TryStatement", 21, 59, None, False, None, None), ("f", "CatchClause", 40, 59, None, False, None, None), ("f", None, 41, 58, None, None, None, None),
    ]
    calls = spark.createDataFrame([("f", "final", 61, 62), ("f", "caught", 45, 46), ("f", "outside", 200, 201), ("g", "elsewhere", 45, 46)], "k string, name string, start long, end long")
    got = {r.name: [tuple(x) for x in r.control] for r in nesting.control_regions(calls, spark.createDataFrame(rows, node), "k").collect()}
    around = [("conditional", 0, 100), ("loop", 0, 100), ("callback", 10, 90)]
    assert got == {"final": [*around, ("finally", 60, 80)], "caught": [*around, ("catch", 40, 59)], "outside": [], "elsewhere": []}


def test_handlers_own_nothing_of_nested_barriers(spark):
    barriers = spark.createDataFrame([("f", "h", 0, 100), ("f", "nested", 20, 40), ("f", "catch", 50, 60)], "k string, id string, start long, end long")
    handlers = spark.createDataFrame([("f", "h", "req", None, 2), ("f", "catch", None, None, 0), ("f", "idle", None, None, 1)], "k string, id string, request string, response string, parameters int")
    facts = spark.createDataFrame([("f", 1, 5, "call", "res", "send"), ("f", 21, 25, "call", "x", "inner"), ("f", 51, 52, "throw", None, "e"), ("f", 53, 54, "call", "log", "log"), ("f", 70, 71, "read", "req", "body"), ("f", 72, 73, "return", None, "v")], "k string, start long, end long, kind string, object string, name string")
    got = {r.id: ([x.name for x in r.calls], [x.name for x in r.exits], [x.name for x in r.sources], r.requests_complete, r.responses_complete) for r in nesting.handler_flow(handlers, facts, barriers, "k").collect()}
    assert got == {"h": (["send"], ["v"], ["body"], True, False), "catch": (["log"], ["e"], [], True, True), "idle": ([], [], [], False, True)}


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_paths_of_any_length(spark, n):
    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(n)] + [(5000, 5001, "x"), (5001, 5000, "y"), (6000, 9999, "lost"), (7000, 0, None), (7001, 7000, "z")]
    got = {r.id: (r.path, r.links) for r in graphs.static_paths(spark.createDataFrame(rows, "id long, object long, name string")).collect()}
    want = {i: (".".join(f"n{j}" for j in range(i + 1)), i + 1) for i in range(n)}
    assert got == want | {5000: (None, None), 5001: (None, None), 6000: (None, 1), 7000: (None, 2), 7001: (None, 3)}


def test_longest_paths_in_order(spark):
    rows = [(1, None, "a", 0, "f"), (2, 1, "b", 0, "f"), (3, None, "c", 5, "f"), (4, None, "a", 9, "f"), (5, 4, "b", 9, "f"), (6, None, None, 12, "g"), (7, None, "d", 13, "g")]
    got = {r.owner: (r.paths, r.partial) for r in graphs.reference_paths(spark.createDataFrame(rows, "id long, object long, name string, start long, owner string"), "owner").collect()}
    assert got == {"f": (["a.b", "c"], False), "g": (["d"], True)}


def test_a_sweep_gives_out_batches_of_bounded_size():
    import pyarrow as pa

    n, kind = 3000, pa.int64()
    row = pa.struct([("id", kind)])
    schema = pa.schema([("row", row), ("outers", pa.list_(kind))])
    held = [{"pid": 0, "key": "a", "start": 0, "end": 10_000 + i, "id": i, "row": None, "asks": None, "holds": True} for i in range(n)]
    asks = [{"pid": 0, "key": "a", "start": 1 + i, "end": 5000, "id": None, "row": {"id": i}, "asks": True, "holds": False} for i in range(n)]
    fields = pa.schema([("pid", pa.int32()), ("key", pa.string()), ("start", kind), ("end", kind), ("id", kind), ("row", row), ("asks", pa.bool_()), ("holds", pa.bool_())])
    given = nesting._swept(nesting.Every, [pa.RecordBatch.from_pylist(held + asks, fields)], False, False, schema)
    sizes = [(len(b.column("outers").flatten()), max(len(x) for x in b.column("outers"))) for b in given]
    assert sum(s for s, _ in sizes) == n * n and max(s for s, _ in sizes) <= nesting.BATCH + nesting.LISTED and max(x for _, x in sizes) <= nesting.LISTED


@pytest.mark.parametrize("large", [5, 60, 10_000])
def test_keys_cut_for_windows_give_what_all_pairs_give(many_cuts, monkeypatch, large):
    monkeypatch.setattr(nesting, "LARGE", large)
    inner, outer = ranges(3, 300, 2000, 60), ranges(4, 120, 2000, 90)
    a, b = (many_cuts.createDataFrame(x, SCHEMA) for x in (inner, outer))
    holds = lambda o, i: good(o) and good(i) and o[0] == i[0] and o[2] <= i[2] and o[3] >= i[3]
    small = [o for o in outer if o[3] is None or o[2] is None or o[3] - o[2] < 100]
    b = b.filter("end IS NULL OR start IS NULL OR end - start < 100")
    assert {r.id: r.h is not None for r in nesting.in_any(a, b, "k", "h").collect()} == {i[1]: any(holds(o, i) for o in small) for i in inner}
    assert {r.id: r.h is not None for r in nesting.holds_any(b, a, "k", "h").collect()} == {o[1]: any(holds(o, i) for i in inner) for o in small}


@pytest.mark.parametrize("seed", [1, 2])
def test_loops_are_met_once_by_calls_without_their_names(many_cuts, seed):
    r = random.Random(seed)
    names = lambda: r.choice([None, [], ["x"], ["y"], ["x", "y"], ["x", None], [None]])
    loops, calls = ([(*x, names()) for x in ranges(n, 300, 2000, 90)] for n in (seed, seed + 5))
    schema = f"{SCHEMA}, names array<string>"
    a, b = many_cuts.createDataFrame(loops, schema), many_cuts.createDataFrame(calls, schema)
    disjoint = lambda p, q: not {x for x in p or [] if x} & {x for x in q or [] if x}
    want = sorted({(o[0], o[1]) for o in loops for i in calls if good(o[:4]) and good(i[:4]) and o[0] == i[0] and o[2] <= i[2] and o[3] >= i[3] and disjoint(o[4], i[4])})
    assert sorted(tuple(x) for x in nesting.met_without(a, b.withColumnRenamed("names", "seen"), "k", "names", "seen").collect()) == want and want


def test_a_loop_that_was_met_is_not_open_any_more():
    state = nesting.Unmet(list)
    for i in range(1000):
        state.add(i, 10_000 - i, {"id": i, "names": ["x"]})
    assert state.around(5000, 5001, {"id": None, "names": ["x"]}) == []
    assert len(state.around(5000, 9500, {"id": None, "names": ["y"]})) == 501 and len(state.open(5000)) == 499
    assert state.around(5000, 9500, {"id": None, "names": None}) == []


def test_ranges_without_ids_are_told_by_true(spark):
    inner = spark.createDataFrame([("a", 1, 2, 3), ("a", 2, 8, 12), ("b", 3, 2, 3), (None, 4, 2, 3)], SCHEMA.replace("id long", "n long"))
    outer = spark.createDataFrame([("a", 1, 0, 9)], SCHEMA).drop("id")
    assert {x.n: x.h for x in nesting.in_any(inner, outer, "k", "h").collect()} == {1: True, 2: None, 3: None, 4: None}


def test_control_lists_follow_ranges_that_open_and_close(many_cuts):
    r = random.Random(7)
    types = {"IfStatement": "conditional", "ForStatement": "loop", "CatchClause": "catch"}
    nodes = [(k, r.choice([*types]), s, e, None, False, None, None) for k, _, s, e in ranges(8, 300, 900, 120)]
    calls = ranges(9, 300, 900, 12)
    node = "k string, type string, start long, end long, parent_type string, is_argument boolean, final_start long, final_end long"
    n = many_cuts.createDataFrame(nodes, node)
    got = {x.id: [tuple(c) for c in x.control] for x in nesting.control_regions(many_cuts.createDataFrame(calls, SCHEMA), n, "k").collect()}
    for k, i, s, e in calls:
        around = {(types[x[1]], x[2], x[3]) for x in nodes if good((x[0], 0, x[2], x[3])) and good((k, i, s, e)) and x[0] == k and x[2] <= s and x[3] >= e}
        assert got[i] == sorted(around, key=lambda c: (c[1], -c[2], c[0]))
    state = nesting.Listed(lambda: nesting.array("q"))
    state.add(0, 9, 4)
    assert state.around(1, 2) is state.around(3, 4) and list(state.around(1, 2)) == [0, -9, 4] and list(state.around(20, 20)) == []


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize(("rows", "piece"), [(1, 4), (7, 3), (50, 4), (1000, 16), (1000, 1 << 10)])
def test_pairs_do_not_depend_on_where_rows_are_cut(monkeypatch, rows, piece, strict):
    for name, value in (("PIECE", piece), ("LISTED", 20), ("BATCH", 30)):
        monkeypatch.setattr(nesting, name, value)
    kind = pa.struct([("k", pa.string()), ("id", pa.int64())])
    fields = pa.schema([("key", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("id", pa.int64()), ("pid", pa.int32()), ("asks", pa.bool_()), ("holds", pa.bool_()), ("row", kind)])
    inner, outer = ([x for x in ranges(n, 150, 30, 15) if good(x)] for n in (6, 7))
    given = [{"key": k, "start": s, "end": e, "id": None if i == 9 else i, "pid": 0, "asks": None, "holds": True, "row": None} for k, i, s, e in outer]
    given += [{"key": k, "start": s, "end": e, "id": None, "pid": 0, "asks": True, "holds": False, "row": {"k": k, "id": i}} for k, i, s, e in inner]
    given.sort(key=lambda r: (r["key"], r["start"], -r["end"], not r["holds"], r["id"] or 0))
    # A second partition in the same task: nothing is open in it that the first one left.
    given += [{**r, "pid": 1} for r in given]
    batches = [pa.RecordBatch.from_pylist(given[at : at + rows], fields) for at in range(0, len(given), rows)]
    out = pa.schema([("rows", pa.list_(kind)), ("outers", pa.list_(pa.int64()))])
    got = [r for b in nesting._paired(iter(batches), strict, out) for r in b.to_pylist()]
    want = [(k, i, None if o == 9 else o) for k, i, s, e in inner for q, o, a, b in outer if k == q and a <= s and b >= e and not (strict and (a, b) == (s, e))]
    assert all(0 < len(r["rows"]) * len(r["outers"]) <= max(20, piece) for r in got)
    assert sorted([(i["k"], i["id"], o) for r in got for i in r["rows"] for o in r["outers"]], key=str) == sorted(want * 2, key=str)


def test_written_pairs_take_little_room(spark, tmp_path):
    r = random.Random(8)
    ids = r.sample(range(10**6), 6000)
    x = spark.createDataFrame([("a", i, s, s + r.randrange(60_000)) for i, s in zip(ids, r.choices(range(200_000), k=6000))], SCHEMA).repartition(4)
    joins.contained(x, x, "k", strict=True).write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert pairs > 1_500_000 and sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < pairs / 2
