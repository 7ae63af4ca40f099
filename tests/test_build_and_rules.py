from pyspark.sql import functions as F

from arborlake.core import lookup
from arborlake.functions import lines as L
from arborlake.functions import rules as R
from arborlake.functions import scalars as S
from arborlake.operators import build as B
from arborlake.operators import concepts as C
from arborlake.operators.resolve import newest_payloads


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(*cols).first()


def test_line_steps(spark):
    t = F.col("t")
    lines = lambda fn: one(spark, "a\na\n\n\nb\n\n", L.join_lines(fn(L.split_lines(t))))[0]
    assert lines(L.collapse_blank) == "a\na\n\nb\n" and lines(L.collapse_repeats) == "a [repeated 2 times]\n\n\nb\n"
    log = "\n".join(["x%d" % i for i in range(50)] + ["ERROR: bad"] + ["y%d" % i for i in range(50)])
    out = one(spark, log, L.generic_filter(t))[0].split("\n")
    assert out[:2] == ["x0", "x1"] and out[25:27] == ["... [41 lines omitted] ...", "ERROR: bad"] and len(out) == 62
    for v in (None, ""):
        assert one(spark, v, L.generic_filter(t))[0] == v
    assert one(spark, "\x1b[31mred\x1b[0m", L.generic_filter(t))[0] == "red"


def test_filter_spec(spark):
    spec = L.FilterSpec("s", strip=["noise"], keep=["keepnoise"], replace=[("v([0-9])", "w$1")], short_circuit=[("ALL OK", "fine", "boom")], max_width=12, on_empty="none")
    run = lambda x: one(spark, x, spec.compile(F.col("t")))[0]
    assert run("noise\nkeepnoise\nv1\nnoise: fatal\n") == "keepnoise\nw1\nnoise: fatal" and run("noise\n") == "none" and run("  ") == "none"
    assert run("ALL OK\nx") == "fine" and run("ALL OK boom") == "ALL OK boom" and run("0123456789abcdef") == "0123456789ab..."
    assert one(spark, "x = 1\n" + "/" * 41 + "\ny = 2", L.join_lines(L.entropy_filter(L.split_lines(F.col("t")), 1.0)))[0] == "x = 1\ny = 2"


def test_scalars(spark):
    t = F.col("t")
    assert one(spark, "Con", S.slug(t))[0] == "mem-con" and one(spark, "??", S.slug(t))[0] == "mem-node" and one(spark, "A/B c", S.slug(t))[0] == "a-b-c"
    assert one(spark, "src/a.py#L3-L9", S.anchor(t))[0] == ("src/a.py", 3, 9, True)
    assert not one(spark, "a/../b#L1-L2", S.anchor(t))[0].valid and not one(spark, "a#L5-L2", S.anchor(t))[0].valid and not one(spark, "x", S.anchor(t))[0].valid
    assert abs(one(spark, "#000", S.contrast(t, F.lit("#ffffff")))[0] - 21) < 1e-9
    assert [one(spark, "x", S.hsl_channel(F.lit(120.0), F.lit(1.0), F.lit(0.5), k))[0] for k in range(3)] == [0, 255, 0]
    assert one(spark, "x", S.composite(F.lit(0), F.lit(255), F.lit(0.5)))[0] == 128
    assert one(spark, "XMLParser_a getUserData", S.snake_and_camel(t))[0] == ["XML", "Parser", "get", "User", "Data"]


def test_rules(spark):
    t = F.col("t")
    assert one(spark, "a a b", R.unique_patch(t, "a", "c"))[0] == ("a a b", "not unique") and one(spark, "a b", R.unique_patch(t, "a", "c"))[0] == ("c b", None)
    assert one(spark, "---\ncontent_hash: abc1\n---\ncontent_hash: fff", R.recorded_hash(t))[0] == "abc1" and one(spark, "x", R.recorded_hash(t))[0] is None
    assert one(spark, "- a\n  more\n* b\n", R.list_entries(F.split(t, "\n")))[0] == ["a more", "b"]
    assert one(spark, "### Use one store — SOUND", R.decision(t))[0] == ("SOUND", "Use one store")
    assert one(spark, "agent:x", R.scope_folder(t))[0] == "memory/agents/x" and one(spark, "Fix the DB now", R.branch_words(t))[0] == "fix-db-now"
    assert one(spark, "123-x", R.numeric_prefix(t))[0] == 123 and one(spark, "20250101-101010-x", R.numeric_prefix(t))[0] is None


def test_assembly(spark):
    files = spark.createDataFrame([("r/a/x.py",), ("r/y.py",), ("r/y.py",)], "rel_path string")
    payload = '{"definitions":[{"kind":"class","local_name":"A","start_line":1,"start_byte":0,"end_byte":90},{"kind":"function","local_name":"f","start_line":2,"start_byte":10,"end_byte":40},{"kind":"function","local_name":"f","start_line":9,"start_byte":50,"end_byte":80},{"kind":"function","local_name":"g","start_line":12,"start_byte":100,"end_byte":120}]}'
    cache = spark.createDataFrame([("r/y.py", "h", "python", payload, "2"), ("r/y.py", "h0", "python", "{}", "1"), ("r/z.py", "h", "python", "not json", "1")], "file_path string, sha256 string, language string, payload_json string, updated_at string")
    targets = spark.createDataFrame([("external:os.path",), ("file:r/y.py",)], "target string")
    n, e = B.assemble(files, newest_payloads(cache), targets)
    got = {r.id: (r.kind, r.parent_id) for r in n.collect()}
    assert got == {
        "dir:r": ("directory", None), "dir:r/a": ("directory", "dir:r"), "file:r/a/x.py": ("file", "dir:r/a"), "file:r/y.py": ("file", "dir:r"), "class:r/y.py::A": ("class", "file:r/y.py"),
        "method:r/y.py::A.f": ("method", "class:r/y.py::A"), "method:r/y.py::A.f:L9": ("method", "class:r/y.py::A"), "function:r/y.py::g": ("function", "file:r/y.py"), "external:os.path": ("external", None),
    }
    assert e.count() == 7


def test_concepts(spark):
    rows = spark.createDataFrame([('{"id":"mem-a","kind":"DECISION","status":"zzz","relations":[{"kind":"x","target":"mem-b"}]}',), ("broken",), ('{"id":"mem-c","status":"superseded"}',)], "payload string")
    got = {r.id: (r.kind, r.status, r.relations) for r in C.parse_concepts(rows).collect()}
    assert got == {"mem-a": ("decision", "draft", ["mem-b"]), "mem-c": ("fact", "superseded", [])}
    assert C.index_lines(C.parse_concepts(rows)).count() == 1
    r = one(spark, "# T\n\nFirst para\nmore\n\n```bash\n$ make x\n# no\nls\n```\n", C.readme_summary(F.col("t")))[0]
    assert r.title == "T" and r.paragraph == "First para\nmore" and r.commands == ["make x", "ls"]
    assert set(one(spark, "12 tests in 3.5 s, at 4f2a9c1 and 77", C.claims(F.col("t")))[0]) == {"12", "3.5", "4f2a9c1"}


def test_skewed_lookup(spark):
    left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("2", 2)], "k string, v int")
    for hot_rows in (1000, 10_000):
        got = lookup(left, right, "k", 9000, hot_rows)
        assert got.count() == 9000 and got.where("v = 1").count() == 3000 and got.where("v = 2").count() == 1 and got.where("k is null").count() == 3000
