"""Source files to diagnostics with a provider that answers by rule."""

import json

from cairn.plans import run

SOURCE = """// Adds one to the number given.
const add = (n) => n + 1;
// cairn-disable-next-line comments/no-useless-comments -- wanted
// Takes one from the number given.
// cairn-disable
// Never shown to anybody at all.
// cairn-enable
// TODO
// broken comment that a provider refuses
export const go = (req, res) => res.redirect(req.query.to);
"""


def test_files_to_diagnostics(spark):
    def provider():
        def call(payload):
            x = json.loads(payload)
            if "refuses" in x["state"]:
                raise OSError("refused")
            finding = {"comments_no-useless-comments": ("redundant", 0.98), "security_no-unsafe-redirect": ("unsafe_redirect", 0.92), "comments_no-misleading-comments": ("misleading", 7.0)}
            out = {}
            for q in x["questions"]:
                choice, p = finding.get(q["id"], ("insufficient_context", 0.99))
                if q["id"] != "comments_require-actionable-todos":
                    out[q["id"]] = {"type": "choice", "choice": choice, "confidence": 0.9, "probabilities": {choice: p}}
            return json.dumps(out)

        return call

    files = spark.createDataFrame([("a.ts", SOURCE), ("b.ts", SOURCE.splitlines()[0]), ("c.ts", ""), ("d.ts", None)], "filename string, source string")
    rows = run.run(files, provider).collect()
    found = sorted((r.filename, r.line, r.rule_id, r.severity) for r in rows if r.severity)
    assert found == [("a.ts", 1, "comments/no-useless-comments", "error"), ("a.ts", 10, "security/no-unsafe-redirect", "warning"), ("b.ts", 1, "comments/no-useless-comments", "error")]
    problems = {(r.line, r.rule_id.split("/")[1], r.problem) for r in rows if r.filename == "a.ts" and r.problem}
    assert {(9, "no-useless-comments", "refused"), (8, "require-actionable-todos", "missing answer"), (1, "no-misleading-comments", "invalid answer")} <= problems
    assert not {r.line for r in rows if r.filename == "a.ts"} & {6, 7}
    assert {r.rule_id for r in rows if r.filename == "a.ts" and r.line in (3, 5)} == {"comments/require-justified-suppressions"}
    assert {r.rule_id for r in rows if r.filename == "a.ts" and r.line == 4} == {"comments/no-misleading-comments", "comments/no-commented-out-code"}
    assert run.requests(run.candidates(files)).filter("payload LIKE '%Adds one%'").count() == 1
    assert run.run(files.limit(0), provider).count() == 0
