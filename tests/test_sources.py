"""Sources over small fixtures."""

import json

from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import decisions, graphs, joins
from cairn.plans import rules
from cairn.sources import files, functions, reports, scripts


def test_comments_and_no_others():
    source = "const a = 'x // no'; // yes\nconst r = /[/*]\\/*/; /* b\n c */ `t ${ f(`}`) /* in */ } // no`\n//\U0001f600\n/* open"
    got = scripts.comments_of(source)
    assert [(c[5], c[6]) for c in got] == [("line", " yes"), ("block", " b\n c "), ("line", "\U0001f600"), ("block", " open")]
    assert [(c[2], c[4]) for c in got] == [(1, 1), (2, 3), (4, 4), (5, 5)]
    wide = source.encode("utf-16-le")
    for c in got:
        assert wide[2 * c[0] : 2 * c[1]].decode("utf-16-le").startswith(("//", "/*"))


def test_division_is_no_pattern():
    assert [c[6] for c in scripts.comments_of("x = a / b; // c / d")] == [" c / d"]
    assert scripts.comments_of("") == []


def test_top_level_imports_only():
    source = 'import a from "a";\nimport { b,\n c } from "b"\nconst d = import("d"); function f() { return import.meta }\nimport "e"; // import x from "x"'
    assert scripts.imports_of(source) == ['import a from "a";', 'import { b,\n c } from "b"', 'import "e";']


def test_files_are_read_and_chosen(spark, tmp_path):
    for name in ("a.ts", "lib/b.jsx", "node_modules/c.js", "d.py", "lib/e f.mjs"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"// {name}\nx")
    got = files.read(spark, str(tmp_path))
    assert sorted(r.filename for r in got.collect()) == ["a.ts", "lib/b.jsx", "lib/e f.mjs"]
    assert [r.filename for r in files.read(spark, str(tmp_path), ["lib/*.{js,jsx}"]).collect()] == ["lib/b.jsx"]
    assert sorted((r.filename, r.value) for r in scripts.comments(got).collect())[0] == ("a.ts", " a.ts")


def test_directives(spark):
    rows = [(" cairn-disable-next-line a/b, c/d -- why",), ("* cairn-enable",), (" cairn-disabled x",), ("see cairn-disable",), (None,), (" cairn-disable -- all\n x/y",)]
    got = spark.createDataFrame(rows, "c string").select(text.directive(F.col("c"), "cairn").alias("d")).collect()
    assert [r.d and (r.d.command, r.d.rules) for r in got] == [("disable-next-line", ["a/b", "c/d"]), ("enable", None), None, None, None, ("disable", None)]


def test_region_directives(spark):
    d = spark.createDataFrame([("f", 10, 1, True, None), ("f", 20, 2, False, ["a"]), ("f", 30, 3, True, ["b"]), ("f", 40, 4, False, None)], "file string, at int, ord long, off boolean, rules array<string>")
    t = spark.createDataFrame([("f", at, r) for at in (5, 10, 25, 35, 45) for r in "ab"] + [("g", 50, "a")], "file string, at int, rule string")
    got = {(r.file, r.at, r.rule) for r in joins.region_suppressed(t, d, "file").filter("suppressed").collect()}
    assert got == {("f", 10, "a"), ("f", 10, "b"), ("f", 25, "b"), ("f", 35, "b")}


def test_reports(spark):
    sarif = '{"runs": [{"results": [{"ruleId": "r", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "x%20y/id1/a+b.ts"}, "region": {"startLine": 3}}}]}, {}]}]}'
    got = reports.sarif(spark.createDataFrame([(sarif,), ("{}",), (None,)], "json string"), "json", ["id2", "id1"]).drop("json").collect()
    assert [tuple(r) for r in got] == [("r", "m", "x y/id1/a+b.ts", 3, "id1"), ("", "", None, None, None)]
    pages = spark.createDataFrame([('{"total": 1, "issues": [{"key": "k", "rule": "r", "component": "c", "message": "m", "status": "s"}]}',), ('{"issues": []}',), ('{"total": 0, "issues": []}',)], "json string")
    assert [(r.rule, r.problem) for r in reports.issues(pages, "json").collect()] == [("r", None), (None, "page")]
    case = lambda i, **x: {"id": i, "filename": "f.ts", "source": "s", "rationale": "why", "rule_id": "a/b", "expected_finding": True, "tags": ["t"]} | x
    corpus = {"default_expected_candidates": 1, "rule_choices": {"a/b": {"finding": "bad", "safe": "good"}}}
    corpus["fixtures"] = [case("a"), case("b", expected_finding=False, expected_candidates=2), case("c", tags=None), case("d", expected_candidates=0, expected_choice="bad"), case("e"), case("e"), case("f", rule_id="b/c"), case("g", expected_choices=["x", "y"], expected_candidates=2)]
    got = reports.fixtures(spark.createDataFrame([(json.dumps(corpus),), (json.dumps([case("z", expected_candidates=1, expected_choice="bad")]),), ("x",)], "json string"), "json").collect()
    told = {r.id: (r.expected_choices, r.problem) for r in got}
    assert told["a"] == (["bad"], None) and told["b"] == (["good", "good"], None) and told["g"] == (["x", "y"], None) and told["z"] == (["bad"], None) and told[None][1] == "corpus"
    assert [told[i][1] for i in "cdef"] == ["incomplete", "choices", "repeated", "choices"]
    manifest = {"schemaVersion": 1, "corpus": "c", "pinnedFixtureList": "p", "officialSuite": "s", "cases": [{"id": "a", "sourceSha256": "h", "scope": "native", "reason": "r"}, {"id": "b", "sourceSha256": "h", "scope": "odd", "reason": "r"}]}
    got = reports.scope_manifest(spark.createDataFrame([(json.dumps(manifest),), ("{}",)], "json string"), "json").collect()
    assert sorted((r.id or "", r.problem or "") for r in got) == [("", "manifest"), ("a", ""), ("b", "entry")]
    ids = spark.createDataFrame([('["a", "b"]',), ('["a", "a"]',), ("[]",), ("x",)], "j string").select(reports.unique_ids(F.col("j")).alias("i")).collect()
    assert [r.i for r in ids] == [["a", "b"], None, None, None]


def test_paths_cycles_and_empty_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("m", "p"), ("m", "q"), ("s", "s")], "src string, dst string")
    names = spark.createDataFrame([(n,) for n in "abcxyzmsu"], "n string")
    got = {r.n: r.root for r in graphs.resolved(names, graphs.functional(e), "n").collect()}
    assert got == {"a": "c", "b": "c", "c": "c", "x": "x", "y": "y", "z": "z", "m": "m", "s": "s", "u": "u"}
    assert graphs.resolved(names, graphs.functional(e.limit(0)), "n").filter("n = root").count() == 9
    got = {(r.node, r.depth) for r in graphs.reachable(names.filter("n = 'x'").toDF("start"), e).collect()}
    assert got == {("y", 1), ("x", 2)}
    assert graphs.reachable(names.limit(0).toDF("start"), e).count() == 0


def test_severity_of_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    x = spark.createDataFrame([(0.9, 0.7), (0.97, 0.7), (0.8, 0.7), (1.0, 0.6), (nan, 0.9), (inf, 0.9), (1.0, nan), (None, 0.9)], "p double, c double")
    got = [r.s for r in x.select(decisions.severity(F.col("p"), F.col("c"), F.lit(0.9), F.lit(0.97), F.lit(0.7)).alias("s")).collect()]
    assert got == ["warning", "error", None, None, None, None, None, None]


def test_rules(spark):
    assert len(rules.RULES) == 49 == len({r[0] for r in rules.RULES})
    f = spark.createDataFrame([("exec(req.body.x)", ["exec"]), ("exec(x)", ["exec"]), ("res.redirect(req.query.to)", ["res.redirect"]), (None, None)], "source string, callees array<string>")
    got = sorted((r.source, r.rule_id) for r in rules.security_candidates(f).collect())
    assert got == [("exec(req.body.x)", "security/no-untrusted-command-execution"), ("res.redirect(req.query.to)", "security/no-sensitive-data-exposure"), ("res.redirect(req.query.to)", "security/no-unsafe-redirect")]


SCRIPT = """import x from "x";
top();
export async function load<T>(req: Request, n = f(1)): Promise<{ a: T }> {
  const rows = await this.db.query(`select`);
  rows.map((r) => clean(r.id)); // call() in a comment
  if (n > 1) { make().run(o[k](2)); new Thing(n); }
  return rows;
}
const arrow = async (a): Promise<void> => go(a)
const other = x => x.y.z(1);
class A extends B {
  constructor(q) { super(q); init(q); }
  async send(m) { return m?.go(); }
}
const o = { one(a) { return two(a); }, three: function () { four() }, five: (a) => { six?.(a) } };
test("adds 'em", () => { expect(add(1)).toBe(2); });
it.each([1])("each", function named() { run(); });
describe("not a test", () => {});
"""


def test_functions_and_their_calls():
    got = functions.functions_of(SCRIPT)
    told = {(f[5] or f[8] or f[9][:12]): (f[4], f[6], f[7], [c[0] for c in f[10]]) for f in got}
    assert told == {
        "load": ("function", "function", True, ["f", "db.query", "rows.map", "make", "run", "o.k"]),
        "(r) => clean": ("function", "function", False, ["clean"]),
        "arrow": ("function", "function", True, ["go"]),
        "other": ("function", "function", False, ["x.y.z"]),
        "constructor": ("function", "constructor", False, ["init"]),
        "send": ("function", "method", True, ["m.go"]),
        "one": ("function", "method", False, ["two"]),
        "three": ("function", "method", False, ["four"]),
        "five": ("function", "method", False, ["six"]),
        "adds 'em": ("test", "function", False, ["expect", "add", "toBe"]),
        "named": ("test", "function", False, ["run"]),
        "() => {}": ("function", "function", False, []),
    }
    load = got[0]
    assert load[9].startswith("async function load") and load[9].endswith("return rows;\n}") and load[2:4] == (3, 8)
    assert [f[9] for f in got if f[5] == "arrow"] == ["async (a): Promise<void> => go(a)"]
    assert [f[9] for f in got if f[5] == "constructor"] == ["constructor(q) { super(q); init(q); }"]
    assert functions.functions_of("") == [] and functions.functions_of("(((") == []


def test_functions_as_rows(spark):
    x = spark.createDataFrame([("a.ts", SCRIPT), ("b.ts", None), ("c.ts", "const f = (req, res) => res.redirect(req.query.to)")], "filename string, source string")
    got = functions.bounded(functions.functions(x))
    assert got.filter("filename = 'b.ts'").count() == 0 and got.filter("name = 'send'").first().callees == ["m.go"]
    assert {(r.filename, r.rule_id) for r in rules.security_candidates(got.filter("filename = 'c.ts'")).collect()} == {("c.ts", "security/no-sensitive-data-exposure"), ("c.ts", "security/no-unsafe-redirect")}
