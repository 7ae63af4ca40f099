import random

import pytest

from arborlake.operators.hierarchy import cyclic_nodes, descendants, hierarchy, resolve_hierarchy

SCHEMA = "id string, parent_id string, kind string"


def brute(rows):
    parent = {}
    for i, p, *_ in rows:
        if i is None:
            continue
        p = p or None
        if i not in parent or (p is not None and (parent[i] is None or p < parent[i])):
            parent[i] = p
    out = {}
    for i in parent:
        path, at = [], i
        while at is not None and at in parent and at not in path:
            path.append(at)
            at = parent[at]
        if at in path:
            out[i] = (None, None, min(path[path.index(at) :]), None)
        else:
            out[i] = (path[-1], len(path) - 1, None, path[::-1])
    return out


def got(df):
    return {r.id: (r.root, r.depth, r.cycle_min_id, r.path) for r in df.collect()}


@pytest.mark.parametrize("local_rows", [7, 60, 10_000])
def test_random_forests(spark, local_rows):
    rng = random.Random(local_rows)
    ids = [f"n{i:03d}" for i in range(300)]
    rows = [(i, rng.choice([None, "", "gone", *ids[: k + 3], *ids[max(0, k - 2) : k]]), "x") for k, i in enumerate(ids)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(resolve_hierarchy(df, local_rows=local_rows)) == brute(rows)


def test_long_chain_and_global_cycle(spark):
    chain = [(f"c{i:04d}", f"c{i - 1:04d}" if i else None, "x") for i in range(900)]
    ring = [(f"r{i:03d}", f"r{(i + 37) % 200:03d}", "x") for i in range(200)]
    rows = chain + ring + [("tail", "r100", "x"), ("own", "own", "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(resolve_hierarchy(df, local_rows=50)) == brute(rows)
    assert {tuple(r) for r in cyclic_nodes(df, local_rows=50).where("id in ('tail', 'own')").collect()} == {("tail", "r000"), ("own", "own")}


def test_dirt_and_empty(spark):
    rows = [(None, "a", "x"), ("a", None, "x"), ("a", None, "x"), ("b", "a", None), ("c", "", "x"), ("d", "gone", "x")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as root", "2 as depth", "3 as next", "4 as path")
    out = {r.id: r for r in hierarchy(df).collect()}
    assert set(out) == {"a", "b", "c", "d"}
    assert out["a"].n_descendants == 1 and out["b"].path == "a > b" and out["d"].root == "d" and out["d"].depth == 0
    assert [tuple(r) for r in descendants(df).collect()] == [("a", "b", 1)]
    empty = spark.createDataFrame([], SCHEMA)
    assert hierarchy(empty).count() == 0 and cyclic_nodes(empty).count() == 0


def test_hub_parent(spark):
    rows = [("hub", "top", "x"), ("top", None, "x")] + [(f"k{i}", "hub", "x") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(resolve_hierarchy(df, local_rows=100)) == brute(rows)


def test_hub_inside_the_quotient(spark):
    """Many chains hang below one node, so that the hub is the exit of many exits."""
    rows = [("hub", "top", "x"), ("top", None, "x")]
    for c in range(150):
        rows += [(f"c{c:03d}_{i}", f"c{c:03d}_{i - 1}" if i else "hub", "x") for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    assert got(resolve_hierarchy(df, locality=F.xxhash64("id"), local_rows=40)) == brute(rows)
