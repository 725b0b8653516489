"""Reports of scanners and fixture manifests, from JSON text to rows."""

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions import text

FINDINGS = "version string, results array<struct<check_id: string, path: string, start: struct<line: int>>>, errors array<string>"
PLACE = "struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>"
SARIF = f"runs array<struct<results: array<struct<ruleId: string, message: struct<text: string>, locations: array<{PLACE}>>>>>"
ISSUES = "paging struct<total: long>, total long, issues array<struct<key: string, rule: string, component: string, message: string, status: string, severity: string, type: string, line: long>>"
CASE = "id string, filename string, source string, rationale string, rule_id string, expected_finding boolean, expected_candidates int, expected_choice string, expected_choices array<string>, collection_choices array<string>, expected_abstention boolean, tags array<string>"
CORPUS = f"default_expected_candidates int, rule_choices map<string, struct<finding: string, safe: string>>, fixtures array<struct<{', '.join(x.replace(' ', ': ', 1) for x in CASE.split(', '))}>>"
MAPPINGS = "schemaVersion int, fixtures array<struct<id: string, sourceSha256: string, coverage: string, ruleId: string, reason: string>>"
SCOPES = "schemaVersion int, corpus string, pinnedFixtureList string, officialSuite string, cases array<struct<id: string, sourceSha256: string, scope: string, reason: string, officialQueryIds: array<string>, customQueryIds: array<string>>>"


def _parsed(reports: DataFrame, json: str, schema: str) -> DataFrame:
    return reports.withColumn("_r", F.from_json(json, schema))


def findings(reports: DataFrame, json: str) -> DataFrame:
    """reports with one row per finding: place, check_id, path, line and problem. A report or finding that lacks a required part is a row with a problem."""
    x = _parsed(reports, json, FINDINGS)
    broken = F.col("_r.version").isNull() | F.col("_r.results").isNull() | F.col("_r.errors").isNull()
    x = x.withColumn("_b", F.coalesce(broken, F.lit(True)))
    x = x.select(*reports.columns, "_b", F.posexplode_outer(F.when(~F.col("_b"), F.col("_r.results"))).alias("place", "_f")).filter("_b OR place IS NOT NULL")
    f = F.col("_f")
    bad = F.when(F.col("_b"), "report").when(f["check_id"].isNull() | f["path"].isNull() | f["start"]["line"].isNull(), "finding")
    return x.select(*reports.columns, "place", f["check_id"].alias("check_id"), f["path"].alias("path"), f["start"]["line"].alias("line"), bad.alias("problem"))


def sarif(reports: DataFrame, json: str, ids: list[str]) -> DataFrame:
    """reports with one row per result: rule_id, message (empty if absent), uri, line, and the listed id that is a segment of the uri."""
    x = _parsed(reports, json, SARIF).select(*reports.columns, F.explode("_r.runs").alias("_run")).select(*reports.columns, F.explode("_run.results").alias("_f"))
    place = F.try_element_at(F.col("_f.locations"), F.lit(1))["physicalLocation"]
    x = x.withColumn("uri", text.decoded_path(place["artifactLocation"]["uri"]))
    segments = F.split("uri", "/")
    listed = F.array(*[F.lit(i) for i in ids]) if ids else F.array().cast("array<string>")
    fixture = F.try_element_at(F.filter(listed, lambda i: F.array_contains(segments, i)), F.lit(1))
    return x.select(*reports.columns, F.coalesce("_f.ruleId", F.lit("")).alias("rule_id"), F.coalesce("_f.message.text", F.lit("")).alias("message"), "uri", place["region"]["startLine"].alias("line"), fixture.alias("fixture_id"))


def issues(pages: DataFrame, json: str) -> DataFrame:
    """pages with one row per issue, with the total the page states; a page without a total or an issue without a required part has a problem."""
    x = _parsed(pages, json, ISSUES).withColumn("total", F.coalesce("_r.paging.total", "_r.total")).withColumn("_b", F.col("total").isNull() | (F.col("total") < 0) | F.col("_r.issues").isNull())
    x = x.select(*pages.columns, "total", "_b", F.explode_outer(F.when(~F.col("_b"), F.col("_r.issues"))).alias("_f")).filter("_b OR _f IS NOT NULL")
    gone = F.lit(False)
    for c in ("key", "rule", "component", "message", "status"):
        gone = gone | (F.coalesce(F.col(f"_f.{c}"), F.lit("")) == "")
    return x.select(*pages.columns, "total", "_f.*", F.when(F.col("_b"), "page").when(gone, "issue").alias("problem"))


def fixtures(files: DataFrame, json: str) -> DataFrame:
    """files with one row per case of a corpus, an array of cases or an object with defaults around it.

    expected_candidates is the corpus' default where a case has none; expected_choices are as many as the candidates: the
    case's own, else its rule's finding or safe label. problem: incomplete for a missing or empty part, choices for a
    number of choices that isn't that of the candidates, repeated for an id met twice; a text that is no corpus has one row, corpus.
    """
    rows = F.when(F.col(json).rlike(r"\A\s*\["), F.concat(F.lit('{"fixtures":'), F.col(json), F.lit("}"))).otherwise(F.col(json))
    x = files.withColumn("_r", F.from_json(rows, CORPUS))
    x = x.select(*files.columns, F.col("_r.default_expected_candidates").alias("_n"), F.col("_r.rule_choices").alias("_c"), F.col("_r.fixtures").isNull().alias("_none"), F.explode_outer("_r.fixtures").alias("_f")).filter("_none OR _f IS NOT NULL")
    f, names = F.col("_f"), [c.split(" ")[0] for c in CASE.split(", ")]
    x = x.select(*files.columns, "_none", "_c", *[f[c].alias(c) for c in names if c not in ("expected_candidates", "expected_choice", "expected_choices")], F.coalesce(f["expected_candidates"], "_n").alias("expected_candidates"), F.coalesce(f["expected_choices"], F.when(f["expected_choice"].isNotNull(), F.array(f["expected_choice"]))).alias("_own"))
    label = F.try_element_at("_c", F.col("rule_id"))
    label = F.when(F.col("expected_finding"), label["finding"]).otherwise(label["safe"])
    x = x.withColumn("expected_choices", F.coalesce("_own", F.array_repeat(label, F.col("expected_candidates"))))
    gone = F.lit(False)
    for c in ("id", "filename", "source", "rationale"):
        gone = gone | (F.coalesce(F.col(c), F.lit("")) == "")
    gone = gone | ~F.coalesce(F.col("rule_id").rlike(r"\A[^/]+/[^/]+\z"), F.lit(False)) | F.col("expected_finding").isNull() | F.coalesce(F.col("expected_candidates") < 0, F.lit(True)) | ~F.coalesce((F.size("tags") >= 0) & F.forall("tags", lambda t: F.coalesce(t, F.lit("")) != ""), F.lit(False))
    choices = (F.size("expected_choices") != F.col("expected_candidates")) | F.exists("expected_choices", lambda c: c.isNull()) | (F.col("_own").isNotNull() & (F.col("expected_candidates") == 0))
    twice = x.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("_twice"))
    x = x.join(twice, "id", "left").withColumn("problem", F.when(F.col("_none"), "corpus").when(gone, "incomplete").when(F.coalesce(choices, F.lit(True)), "choices").when(F.col("_twice"), "repeated"))
    return x.drop("_twice", "_none", "_c", "_own")


def _manifest(files: DataFrame, json: str, schema: str, rows: str, head: tuple[str, ...], wrong) -> DataFrame:
    """files with one row per entry of rows, each with a problem: manifest, entry (wrong(entry) holds) or repeated (an id met twice in one file)."""
    x = _parsed(files, json, schema)
    bad = F.coalesce(F.col("_r.schemaVersion") != 1, F.lit(True)) | F.col(f"_r.{rows}").isNull()
    for c in head:
        bad = bad | (F.coalesce(F.col(f"_r.{c}"), F.lit("")) == "")
    ids = F.transform(F.col(f"_r.{rows}"), lambda e: e["id"])
    x = x.select(*files.columns, bad.alias("_b"), ids.alias("_ids"), F.explode_outer(F.when(~bad, F.col(f"_r.{rows}"))).alias("_f")).filter("_b OR _f IS NOT NULL")
    twice = F.size(F.filter("_ids", lambda i: i == F.col("_f.id"))) > 1
    problem = F.when(F.col("_b"), "manifest").when(F.coalesce(wrong(F.col("_f")), F.lit(True)), "entry").when(twice, "repeated")
    return x.select(*files.columns, "_f.*", problem.alias("problem"))


def case_mappings(files: DataFrame, json: str) -> DataFrame:
    """files with one row per mapping of a case to a scanner's rule (schemaVersion 1): benchmark_owned ones name a rule, unsupported ones a reason."""
    need = lambda e: e["id"].isNull() | e["sourceSha256"].isNull() | ~(((e["coverage"] == "benchmark_owned") & e["ruleId"].isNotNull()) | ((e["coverage"] == "unsupported") & e["reason"].isNotNull()))
    return _manifest(files, json, MAPPINGS, "fixtures", (), need)


def scope_manifest(files: DataFrame, json: str) -> DataFrame:
    """files with one row per case of a scope manifest (schemaVersion 1): id, sourceSha256 and reason are told, and the scope is native, custom or unsupported."""
    need = lambda e: (F.coalesce(e["id"], F.lit("")) == "") | (F.coalesce(e["sourceSha256"], F.lit("")) == "") | (F.coalesce(e["reason"], F.lit("")) == "") | ~e["scope"].isin("native", "custom", "unsupported")
    return _manifest(files, json, SCOPES, "cases", ("corpus", "pinnedFixtureList", "officialSuite"), need)


def drift(fixtures: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, problem) of what fixtures(id, source) and manifest(id, sha256) disagree on: missing, unexpected or changed."""
    f = fixtures.select("id", F.sha2("source", 256).alias("_now"))
    x = f.join(manifest.select("id", "sha256"), "id", "full")
    problem = F.when(F.col("_now").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("_now") != F.col("sha256"), "changed")
    return x.select("id", problem.alias("problem")).filter("problem IS NOT NULL")


def unique_ids(json: Column) -> Column:
    """The array of a JSON list of distinct, nonempty strings; null if it is none, is empty or repeats one."""
    x = F.from_json(json, "array<string>")
    good = (F.size(x) > 0) & (F.size(F.array_distinct(x)) == F.size(x)) & F.forall(x, lambda i: F.coalesce(i, F.lit("")) != "")
    return F.when(good, x)
