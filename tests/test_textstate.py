from pyspark.sql import functions as F

from arborlake.operators import textstate as T


def test_views_of_code(spark):
    src = '/* note\n x */ <!-- a -->\n```\ncode\n```\nend'
    out = T.blank_comments(src)
    assert len(out) == len(src) and out.count("\n") == src.count("\n") and out.endswith("end") and "note" not in out
    assert T.blank_comments(None) is None and T.blank_comments("") == ""
    py = 'def f(x):\n    """Doc."""\n    y = 1\n    return y\n\n\nclass A:\n    def g(self):\n        return 2\n'
    cut = T.pruned_python(py)
    assert "return" not in cut and "Doc." in cut and "def g(self)" in cut and T.pruned_python("def (") == "def ("
    rows = [("def f(x):\n    '''Doc.'''\n    return 1", None), ("func f() {\n  x\n}", ""), ("anything", " f(x) "), (None, None), ("one line", None)]
    got = [r.v for r in spark.createDataFrame(rows, "a string, b string").select(T.signature_view(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == ["def f(x):\n    '''Doc.'''", "func f() {", "f(x)", "", "one line"]


def test_reads_by_budget(spark):
    big = "def f():\n" + "    x = 1\n" * 400
    rows = [("a.py", "x = 1\n"), ("b.py", big), ("c.go", "func F() {\n" + "\tx := 1\n" * 500 + "}\n"), ("d.py", None)]
    got = {r.rel_path: (r["mode"], r.text) for r in T.budgeted_read(spark.createDataFrame(rows, "rel_path string, content string"), 100).collect()}
    assert got["a.py"] == ("full", "x = 1\n") and got["b.py"][0] == "pruned" and got["c.go"] == ("map", "F") and set(got) == {"a.py", "b.py", "c.go"}


def test_fences_and_runs(spark):
    lines = ["text", "```", "ran 12 tests", "```", "    42 ms", "end"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, i int, line string")
    assert [r.i for r in T.fenced(df).where("inside").collect()] == [2]
    assert {(r.first, r.last, tuple(r["values"])) for r in T.receipt_runs(df).collect()} == {(2, 2, ("12",)), (4, 4, ("42",))}


def test_import_budget(spark):
    pages = spark.createDataFrame([("a", "@b\n@c\n"), ("b", "x" * 50), ("c", "y" * 60)], "path string, text string")
    assert [(r.path, r.state) for r in T.expand_imports(pages, budget=100).orderBy("root", "ord").collect()] == [("b", "ok"), ("c", "over budget")]
    assert [r.state for r in T.expand_imports(pages, per_file=55).orderBy("root", "ord").collect()] == ["ok", "too large"]
    assert T.expand_imports(pages.limit(0)).count() == 0
