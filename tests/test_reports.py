from pyspark.sql import functions as F

from arborlake.functions.redact import SECRETS
from arborlake.operators import reports as P
from arborlake.plans.text_queries import _THREATS


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "text string").select(col).first()[0]


def test_reports(spark):
    rows = [("ok", "Date: 2026-05-20\nStatus: pass\n- [x] a\nAuthor: A\nReviewer: B\nVersion: 2"), ("bad", "Status: pass\n- [ ] a\nAuthor: A\nReviewer: a\n"), ("old", "Date: 2025-01-01\n> Status: pass\nVersion: 1\n"), ("none", None)]
    got = {}
    for r in P.report_findings(spark.createDataFrame(rows, "doc string, text string"), "2026-06-01", version="2").collect():
        got.setdefault(r.doc, set()).add(r.check)
    assert got == {"bad": {"undated", "open boxes", "not independent"}, "old": {"stale", "other version"}, "none": {"undated"}}


def test_guides_ratios_design(spark):
    docs = spark.createDataFrame([("a", "<button> x"), ("b", "<table>")], "doc string, text string")
    guides = spark.createDataFrame([("button",)], "name string")
    assert [tuple(r) for r in P.guide_coverage(docs, guides, {"button": "<button", "table": "<table"}).collect()] == [("table", 1)]
    d = spark.createDataFrame([("d", "#000000 on #ffffff is 21:1\n#777777 on #ffffff 9.0:1\n")], "doc string, text string")
    assert [r.ok for r in P.declared_ratios(d).orderBy("fg").collect()] == [True, False]
    t = spark.createDataFrame([("d", "# Colors\ntext: #999999\nbackground: #ffffff\n## Typography\n## Spacing\n")], "doc string, text string")
    assert {r.finding for r in P.design_lint(t).collect()} == {"missing section: components", "low contrast: text on background"}


def test_gates_entries_facts(spark):
    s = spark.createDataFrame([("good-one", "me", "# T\nhelps", "a long enough description"), ("Bad", "x", "rm -rf /\nAKIA" + "A" * 16, None)], "name string, owner string, body string, description string")
    got = {}
    for r in P.gates(s, spark.createDataFrame([("me",)], "owner string"), SECRETS, _THREATS).collect():
        got.setdefault(r.name, set()).add(r.gate)
    assert got == {"Bad": {"ownership", "name", "secrets", "safety", "structure", "completeness"}}
    e = one(spark, "- First. More\n  here\n- Second one\n", P.legacy_entries(F.col("text")))
    assert [(x.title, x.body) for x in e] == [("First", "First. More here"), ("Second one", "Second one")]
    f = spark.createDataFrame([("r/pyproject.toml", "[project.scripts]"), ("r/tests/a.ts", ""), ("q/x.go", None)], "rel_path string, content string")
    assert {r.repo: (r.languages, r.has_tests, r.is_cli) for r in P.project_facts(f).collect()} == {"r": ("python,typescript", True, True), "q": ("go", False, False)}
    assert one(spark, "body", P.completed_front_matter(F.col("text"), F.lit("n"))) == "---\nname: n\ndescription: Notes on n\n---\nbody"
    assert one(spark, "---\nname: z\n---\nbody", P.completed_front_matter(F.col("text"), F.lit("n"))) == "---\nname: z\ndescription: Notes on n\n---\nbody"
    r = one(spark, "| alt | a/b.html | 2026-01-02 |\n| x | c.md |  |\n", P.register_entries(F.col("text")))
    assert [(x.check, x.file, str(x.expires)) for x in r] == [("alt", "a/b.html", "2026-01-02"), ("x", "c.md", "None")]
