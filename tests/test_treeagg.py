import random
from collections import defaultdict

from arborlake.operators.treeagg import edge_key_stats, heavy_keys

SCHEMA = "id long, source_id string, target_id string, kind string, resolved int, confidence_score double"


def brute(rows):
    once = {(r[0], r[3], r[1], r[2]): r for r in rows}
    out = defaultdict(lambda: [0, set()])
    for r in once.values():
        g = out[(r[3], r[2])]
        g[0] += 1
        g[1].add(r[1])
    return {k: (n, len(s - {None})) for k, (n, s) in out.items()}


def make(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.4
        rows.append((i, f"s{0 if hot and rng.random() < 0.5 else rng.randrange(50)}", "hub" if hot else rng.choice([None, *map(str, range(30))]), rng.choice(["calls", None, "imports"]), 1, 0.5))
    return rows + rows[: n // 10]


def test_rounds_equal_brute_force(spark):
    rows = make(2000)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 as _chunk", "8 as n")
    for chunk_rows, fan_in in ((10, 2), (50, 3), (400, 16), (10**6, 16)):
        out = {(r.kind, r.target_id): (r.n_edges, r.n_callers) for r in edge_key_stats(df, chunk_rows, fan_in).collect()}
        assert out == brute(rows)


def test_heavy_keys_and_empty(spark):
    rows = make(1000)
    want = {k for k, v in brute(rows).items() if v[0] >= 15}
    assert {tuple(r) for r in heavy_keys(spark.createDataFrame(rows, SCHEMA)).collect()} == want
    assert heavy_keys(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_are_placed_once(spark):
    """Without hot keys one exchange brings all rows together; the aggregates after it need none."""
    df = spark.createDataFrame(make(500), SCHEMA)
    plan = edge_key_stats(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
