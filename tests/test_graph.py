import json
import random

import pytest
from pyspark.sql import functions as F

from arborlake.operators import audit as A
from arborlake.operators import graph as G
from arborlake.operators import resolve as R
from arborlake.operators import search as Q
from arborlake.operators import windows as W
from arborlake.operators.components import connected_components

NODES = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, parent_id string, signature string, external int, snippet string, community_id long"
EDGES = "id long, source_id string, target_id string, kind string, resolved int, confidence string"
COMM = "id long, label string, node_count int, cohesion double, hub_node_id string, top_files string"


def nodes(spark, rows):
    """rows: (id, kind, file, community)."""
    return spark.createDataFrame([(i, k, i, i, f, "python", n, n + 3, None, None, 0, f"def {i}(x):\n    return x\n", c) for n, (i, k, f, c) in enumerate(rows)], NODES)


def edges(spark, rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], EDGES)


@pytest.fixture(scope="module")
def hub(spark):
    n = nodes(spark, [("file:a.py", "file", "a.py", None), ("file:b.py", "file", "b.py", None), ("caller", "function", "src/a.py", 1), ("target", "function", "lib/b.py", 2), ("god_hub", "function", "lib/b.py", 2)])
    e = edges(spark, [("file:a.py", "file:b.py", "imports", 1, None), ("caller", "target", "calls", 1, "extracted"), ("caller", "god_hub", "calls", 1, "INFERRED"), ("target", "god_hub", "calls", 1, "EXTRACTED"), ("target", "god_hub", "calls", 0, "EXTRACTED")])
    e = e.unionByName(e.limit(2))
    c = spark.createDataFrame([(1, "one", 1, 1.0, None, "[]"), (2, "two", 2, 0.05, "god_hub", "[]")], COMM)
    return G.node_view(n), G.edge_view(e), c, n


def test_hubs_surprise_path(spark, hub):
    n, e, c, _ = hub
    assert [(r.id, r.degree) for r in G.hub_nodes(n, e).collect()] == [("caller", 2), ("god_hub", 2), ("target", 2)]
    s = {(r.source_id, r.target_id): r.score for r in G.surprise(n, e).collect()}
    assert s[("caller", "god_hub")] == 80 and ("target", "god_hub") not in s
    assert [tuple(r) for r in G.shortest_path(e, "caller", "god_hub").orderBy("hop").collect()] == [(0, "caller"), (1, "god_hub")]
    assert G.shortest_path(e, "god_hub", "caller").count() == 0
    assert G.import_cycles(e).count() == 0
    files = spark.createDataFrame([("lib/b.py",)], "file_path string")
    r = {x.id: x.hop for x in G.impact(n, e, G.file_targets(n, files)).collect()}
    assert r == {"target": 0, "god_hub": 0, "caller": 1}
    risk = G.impact_risk(n, e, c, G.file_targets(n, files)).first()
    assert (risk.direct, risk.transitive, risk.hubs, risk.bridges, risk.low_cohesion, risk.risk) == (1, 0, 0, 2, True, "high")


def test_blocked_hub_is_reached_not_expanded(spark):
    e = edges(spark, [("a", "b", "calls", 1, None), ("b", "c", "calls", 1, None), ("c", "d", "calls", 1, None)])
    seeds = spark.createDataFrame([("a",)], "id string")
    stop = spark.createDataFrame([("b",)], "id string")
    assert {r.id for r in G.bfs(e, seeds, 5, stop).collect()} == {"a", "b"}
    assert {r.id: r.via for r in G.bfs(e, seeds, 2).collect()} == {"a": None, "b": "a", "c": "b"}
    assert G.bfs(e, seeds.limit(0), 3).count() == 0


def test_nearest_rank(spark):
    df = spark.range(100).withColumnRenamed("id", "v")
    assert tuple(G.nearest_rank(df, "v", lambda n: F.floor(n * 99 / 100)).first()) == (100, 99)
    assert G.nearest_rank(df.limit(0), "v", lambda n: n).count() == 0


def test_cycles_and_order(spark):
    f = [(f"file:{a}", f"file:{b}", "imports", 1, None) for a, b in ("ab", "bc", "ca", "ba", "cd", "de")]
    assert {tuple(r) for r in G.import_cycles(edges(spark, f)).collect()} == {(2, "file:a > file:b"), (3, "file:a > file:b > file:c")}
    n = G.node_view(nodes(spark, [(x, "function", "f.py", None) for x in "uvwxyz"]))
    e = edges(spark, [("u", "v", "calls", 1, None), ("v", "w", "calls", 1, None), ("x", "y", "calls", 1, None), ("y", "x", "calls", 1, None), ("z", "x", "calls", 1, None), ("u", "u", "calls", 1, None)])
    assert {r.id: r.level for r in G.topological_levels(n, e).collect()} == {"w": 0, "v": 1, "u": 2, "x": None, "y": None, "z": None}
    assert [r.id for r in G.topological_order(n, e).orderBy("position").collect()] == ["w", "v", "u", "x", "y", "z"]


@pytest.mark.parametrize("most", [0, 25, 100])
def test_order_of_more_nodes_than_one_task_takes(spark, most):
    rng = random.Random(9)
    ids = [f"n{k:02d}" for k in range(60)]
    rank = rng.sample(ids, 60)  # most edges lead down in this order, so that few are on cycles
    pairs = {(rank[a], rank[b]) for a, b in (sorted(rng.sample(range(60), 2), reverse=True) for _ in range(70))} | {(rank[50], rank[57]), (rank[57], rank[50])}
    waits, want = {i: {b for a, b in pairs if a == i} for i in ids}, []
    while ready := [i for i in ids if i not in want and waits[i] <= set(want)]:
        want.append(ready[0])
    assert 25 < len(want) < 60
    want += [i for i in ids if i not in want]
    n = G.node_view(nodes(spark, [(x, "function", "f.py", None) for x in [*ids, ids[0], None]]))
    e = edges(spark, [(a, b, "calls", 1, None) for a, b in [*pairs, (ids[3], ids[3]), (ids[4], "gone"), (None, ids[1])]])
    got = G.topological_order(n, e, most)
    assert got.dtypes == [("position", "int"), ("id", "string")]
    assert [tuple(r) for r in got.orderBy("position").collect()] == list(enumerate(want))


def test_order_of_cycles_alone_and_of_nothing(spark):
    n = G.node_view(nodes(spark, [(x, "method", "f.py", None) for x in "ba"]))
    e = edges(spark, [("a", "b", "calls", 1, None), ("b", "a", "calls", 1, None)])
    for most in (1, 2):
        assert [tuple(r) for r in G.topological_order(n, e, most).orderBy("position").collect()] == [(0, "a"), (1, "b")]
    assert G.topological_order(n.limit(0), e).count() == 0


@pytest.mark.parametrize("partitions", ["3", "7"])
def test_communities(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    n = G.node_view(nodes(spark, [(x, "method", "f.py", None) for x in ("a1", "a2", "b1", "b2", "lone")] + [("d", "directory", None, None)]))
    e = edges(spark, [("a1", "a2", "calls", 1, None), ("b1", "b2", "calls", 1, None)])
    got = {r.id: r.community for r in G.detect_communities(n, e).collect()}
    assert got["a1"] == got["a2"] != got["b1"] == got["b2"] and got["lone"] == "lone" and "d" not in got
    assert {r.id: r.community for r in G.detect_communities(n, e).collect()} == got
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_super_hub_joins_its_neighbours_and_labels_settle(spark):
    ring = [f"a{k:02d}" for k in range(60)]
    n = G.node_view(nodes(spark, [(x, "method", "f.py", None) for x in [*ring, "hub"]]))
    e = edges(spark, [(x, "a00", "inherits", 1, None) for x in ring[1:30]] + [(x, "hub", "calls", 1, None) for x in ring] + [(f"p{k}", f"p{k + 1}", "calls", 1, None) for k in range(120)])
    assert [r.node_id for r in G.super_hubs(e).collect()] == ["hub"]
    got = {r.id: r.community for r in G.detect_communities(n, e).collect()}
    assert got["hub"] == got["a00"] == got["a29"]


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    rows = [(f"n{rng.randrange(150):03d}", f"n{rng.randrange(150):03d}") for _ in range(110)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(80)] + [("h", f"s{i:03d}") for i in range(60)] + [("own", "own"), (None, "x")]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in rows[:-1]:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert got == {x: find(x) for x in up}


def test_running_sum_and_slugs(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    want, acc = set(), {}
    for k, o, v in rows:
        acc[k] = acc.get(k, 0) + v
        want.add((k, o, acc[k]))
    assert {(r.k, r.o, r.running) for r in W.running_sum(df, ["k"], ["o"], F.col("v")).collect()} == want
    assert sorted(r.number for r in W.numbered(df, ["o"]).collect()) == list(range(500))
    s = spark.createDataFrame([("1", "a"), ("2", "A"), ("3", "index"), ("4", "a_2"), ("5", "a")], "id string, s string")
    u = {r.id: r.unique_slug for r in W.unique_slugs(s, F.col("s"), ["id"]).collect()}
    assert len({x.lower() for x in u.values()}) == 5 and u["1"] == "a" and u["5"] == "a_3" and u["3"] == "index_2"


def test_call_tiers(spark):
    defs = spark.createDataFrame([("m", "p/a.py", "run", "A.run", "p/a.py::A", 1), ("f", "p/a.py", "help", "help", None, 2), ("x", "p/b.py", "load", "load", None, 1), ("u", "q/c.py", "only", "only", None, 1), ("t1", "p/d.py", "twin", "twin", None, 1), ("t2", "q/e.py", "twin", "twin", None, 1), ("g", "q/e.py", "get", "get", None, 3), ("k", "p/b.py", "go", "Car.go", "p/b.py::Car", 4)], "id string, file_path string, name string, qualified_name string, class_id string, seq int")
    imports = spark.createDataFrame([("p/a.py", "p/b.py", ["load", "Car"], 0)], "file_path string, target_file string, names array<string>, ord int")
    calls = [("c1", "p/a.py::A", "run", "self"), ("c2", None, "help", None), ("c3", None, "load", None), ("c4", None, "load", "b"), ("c5", None, "go", "Car"), ("c6", None, "only", None), ("c7", None, "twin", None), ("c8", None, "nope", "z"), ("c9", None, "get", None)]
    c = spark.createDataFrame([(i, "p/a.py", k, n, r) for i, k, n, r in calls], "call_id string, file_path string, class_id string, name string, receiver string")
    got = {r.call_id: (r.target, r.tier, r.score, r.resolved) for r in R.resolve_calls(c, defs, imports).collect()}
    assert got == {"c1": ("m", 1, 100, True), "c2": ("f", 2, 100, True), "c3": ("x", 3, 95, True), "c4": ("x", 4, 90, True), "c5": ("k", 5, 80, True), "c6": ("u", 6, 65, True), "c7": ("t1", 7, 40, True), "c8": ("external:z.nope", 8, 20, False), "c9": ("external:get", 8, 20, False)}


def test_import_resolution(spark):
    files = spark.createDataFrame([("r/pkg/helper.py",), ("r/pkg/__init__.py",), ("r/web/a.ts",), ("r/web/lib/index.js",), ("r/src/net/mod.rs",), ("r/go/cache/x.go",), ("r/main.py",)], "rel_path string")
    imps = [("r/main.py", "pkg.helper"), ("r/main.py", "pkg"), ("r/pkg/helper.py", "."), ("r/main.py", "numpy"), ("r/web/lib/index.js", "../a"), ("r/web/a.ts", "./lib"), ("r/src/lib.rs", "crate::net"), ("r/go/m.go", "x.org/y/cache")]
    i = spark.createDataFrame([(f, n, t) for n, (f, t) in enumerate(imps)], "file_path string, ord int, path_text string")
    got = [r.target for r in R.resolve_imports(i, files).orderBy("ord").collect()]
    assert got == ["file:r/pkg/helper.py", "file:r/pkg/__init__.py", "file:r/pkg/__init__.py", "external:numpy", "file:r/web/a.ts", "file:r/web/lib/index.js", "file:r/src/net/mod.rs", "file:r/go/cache/x.go"]


def test_python_extraction_feeds_the_resolver(spark):
    src = "import os\nfrom a import b\n\n\nclass A(B):\n    def f(self):\n        self.g()\n        os.path.join(1)\n\n    def g(self):\n        return 1\n"
    files = spark.createDataFrame([("r/a.py", src), ("r/b.py", "def ("), ("r/c.py", None)], "rel_path string, content string")
    p = R.extract_python(files).withColumn("sha256", F.lit("x")).withColumn("language", F.lit("python")).withColumn("updated_at", F.lit("1"))
    n = R.newest_payloads(p)
    assert {(r.kind, r.name, r.parent_ord) for r in R.definitions(n).collect()} == {("class", "A", None), ("function", "f", 0), ("function", "g", 0)}
    calls, defs = R.payload_calls(n)
    got = {r.call_id.split("@")[-1]: r.tier for r in R.resolve_calls(calls, defs, spark.createDataFrame([], "file_path string, target_file string, names array<string>, ord int")).collect()}
    assert got == {"g": 1, "join": 8}


def test_search(spark, hub):
    n, e, _, raw = hub
    assert Q.query_terms("getUserData") == ["getUserData", "get", "User", "Data"] and Q.query_terms("a_b") == ["a_b"]
    got = {r.id: r.tier for r in Q.search(raw, n, e, "target").collect()}
    assert got["target"] == "anchor" and set(got) == {"target", "god_hub", "caller"}
    assert {r["mode"] for r in Q.search(raw, n, e, "target", budget=8).collect()} != {"full"}
    assert Q.search(raw, n, e, "zzz").count() == 0


def test_lifecycle_and_links(spark):
    s = spark.createDataFrame([("young", 0, 0, 950), ("idle", 0, 0, 0), ("busy", 90, 1, 0), ("rare", 1, 1, 0)], "name string, use int, view int, anchor int")
    assert {r.name: r.action for r in A.lifecycle(s, 1000, capacity=1).collect()} == {"young": "keep", "idle": "archive", "busy": "keep", "rare": "archive"}
    docs = spark.createDataFrame([("d", "docs/d.md", "[a](x.md) [b](../y.md) [c](https://z) [d](gone.md#p)")], "doc string, path string, text string")
    paths = spark.createDataFrame([("docs/x.md",), ("y.md",)], "path string")
    assert [tuple(r) for r in A.broken_links(docs, paths).collect()] == [("d", "gone.md")]
    c = spark.createDataFrame([("mem-a", ["mem-b", "other"]), ("mem-c", ["mem-a"])], "id string, relations array<string>")
    assert [tuple(r) for r in A.broken_relations(c).collect()] == [("mem-a", "mem-b")]


def test_empty_graph(spark):
    n, e = G.node_view(spark.createDataFrame([], NODES)), G.edge_view(spark.createDataFrame([], EDGES))
    c = spark.createDataFrame([], COMM)
    for df in (G.hub_nodes(n, e), G.surprise(n, e), G.community_hubs(n, e), G.topological_levels(n, e), G.import_cycles(e), G.incident_summary(n, e), G.detect_communities(n, e), G.review_questions(n, e, c), G.super_hubs(e), G.god_flags(e)):
        assert df.count() == 0


def test_self_calls_of_two_classes_with_the_same_method(spark):
    d = lambda kind, name, s, e: {"kind": kind, "local_name": name, "start_line": s, "end_line": e, "start_byte": s, "end_byte": e}
    call = lambda at: {"name": "close", "receiver": "self", "node_start_byte": at, "start_line": at}
    defs = [d("class", "A", 0, 100), d("function", "run", 10, 40), d("function", "close", 50, 90), d("class", "B", 200, 300), d("function", "run", 210, 240), d("function", "close", 250, 290)]
    p = json.dumps({"definitions": defs, "imports": [], "calls": [call(20), call(220)], "inheritances": [], "parse_had_errors": False})
    cache = spark.createDataFrame([("r/a.py", "x", "python", p, "2024-01-01")], "file_path string, sha256 string, language string, payload_json string, updated_at string")
    calls, found = R.payload_calls(R.newest_payloads(cache))
    none = spark.createDataFrame([], "file_path string, target_file string, names array<string>, ord int")
    got = {r.call_id: (r.target, r.tier) for r in R.resolve_calls(calls, found, none).collect()}
    assert got == {"r/a.py@20@close": ("method:r/a.py::A.close", 1), "r/a.py@220@close": ("method:r/a.py::B.close", 1)}


def test_base_classes_by_tiers(spark):
    defs = spark.createDataFrame([("c:a::Own", "p/a.py", "Own", "Own", None, 1), ("c:a::In.Own", "p/a.py", "Inner", "In.Inner", None, 2), ("c:b::Base", "p/b.py", "Base", "Base", None, 1), ("c:c::Base", "p/c.py", "Base", "Base", None, 1), ("c:d::Only", "q/d.py", "Only", "Only", None, 1), ("c:b::Far", "p/b.py", "Far", "Far", None, 3), ("c:e::Far", "p/e.py", "Far", "Far", None, 3)], "id string, file_path string, name string, qualified_name string, class_id string, seq int")
    imports = spark.createDataFrame([("p/a.py", "p/b.py", [], 0), ("p/a.py", "p/c.py", ["Base"], 1)], "file_path string, target_file string, names array<string>, ord int")
    want = {"Own": ("c:a::Own", 1), "In.Inner": ("c:a::In.Own", 1), "x.Own": ("c:a::Own", 1), "m.Base": ("c:c::Base", 2), "Far": ("c:b::Far", 3), "Only": ("c:d::Only", 4), "z.Gone": ("external:z.Gone", 5)}
    rows = [(b, "p/a.py", b) for b in want]
    bases = spark.createDataFrame([*rows, *rows[:2], ("n", "p/a.py", None)], "inh_id string, file_path string, base_name string")
    got = {r.inh_id: (r.target, r.tier, r.resolved) for r in R.resolve_inheritances(bases, defs, imports).collect()}
    assert got == {b: (t, k, k < 5) for b, (t, k) in want.items()}


def test_base_classes_with_orders_beyond_int(spark):
    defs = spark.createDataFrame([("c:b::Base", "p/b.py", "Base", "Base", None, 1), ("c:c::Base", "p/c.py", "Base", "Base", None, 1)], "id string, file_path string, name string, qualified_name string, class_id string, seq int")
    imports = spark.createDataFrame([("p/a.py", "p/b.py", [], 9_000_000_001), ("p/a.py", "p/c.py", [], 9_000_000_000), ("p/z.py", "p/b.py", ["Base"], 9_000_000_001), ("p/z.py", "p/c.py", ["Base"], 9_000_000_000)], "file_path string, target_file string, names array<string>, ord long")
    bases = spark.createDataFrame([("1", "p/a.py", "Base"), ("2", "p/z.py", "Base")], "inh_id string, file_path string, base_name string")
    assert {r.inh_id: (r.target, r.tier) for r in R.resolve_inheritances(bases, defs, imports).collect()} == {"1": ("c:c::Base", 3), "2": ("c:b::Base", 2)}


def test_whole_graph_of_a_small_tree(spark):
    import json

    from arborlake.operators import build as B

    d = lambda kind, name, a, z, line: {"kind": kind, "local_name": name, "receiver_type": None, "start_line": line, "end_line": line, "start_byte": a, "end_byte": z}
    a = {"definitions": [d("class", "A", 0, 90, 1), d("function", "f", 10, 40, 2), d("function", "g", 50, 80, 4)], "imports": [{"path_text": "b", "start_line": 1, "imported_names": ["Base", "help"]}], "calls": [{"name": "g", "receiver": "self", "node_start_byte": 20, "start_line": 2}, {"name": "help", "receiver": None, "node_start_byte": 60, "start_line": 4}, {"name": "odd", "receiver": "z", "node_start_byte": 95, "start_line": 9}], "inheritances": [{"base_name": "Base", "class_start_byte": 0, "start_line": 1}]}
    b = {"definitions": [d("class", "Base", 0, 10, 1), d("function", "help", 20, 30, 3)], "imports": [], "calls": [], "inheritances": []}
    cache = spark.createDataFrame([("r/a.py", "h", "python", json.dumps(a), "1"), ("r/b.py", "h", "python", json.dumps(b), "1")], "file_path string, sha256 string, language string, payload_json string, updated_at string")
    files = spark.createDataFrame([("r/a.py", ""), ("r/b.py", "")], "rel_path string, content string")
    nodes, edges = B.assemble_graph(files, R.newest_payloads(cache))
    got = {(r.source_id, r.target_id, r.kind, r.score) for r in edges.where("kind <> 'contains'").collect()}
    assert got == {
        ("file:r/a.py", "file:r/b.py", "imports", 100), ("method:r/a.py::A.f", "method:r/a.py::A.g", "calls", 100), ("method:r/a.py::A.g", "function:r/b.py::help", "calls", 95),
        ("file:r/a.py", "external:z.odd", "calls", 20), ("class:r/a.py::A", "class:r/b.py::Base", "inherits", 95),
    }
    ids = {r.id for r in nodes.collect()}
    assert {x for s, t, *_ in got for x in (s, t)} <= ids


def test_halving_stops_at_the_first_fit():
    from arborlake.operators.search import halved

    assert halved([10] * 20, 100) == 10 and halved([10] * 20, 60) == 5 and halved([10] * 20, 0) == 1 and halved([10] * 200, 0) == 6 and halved([], 5) == 0 and halved([9], 1) == 1
