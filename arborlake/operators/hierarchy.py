"""Parent-child links to full hierarchies by contraction of partition-local chains.

Every row (id, parent) is a step of a chain. Rows are placed so that many steps
meet in one task; there each chain is contracted to its fragment exit, the first
ancestor that lives elsewhere. The distinct exits form a quotient forest with
one weighted step each, which is contracted again until it fits one task. Then
the solved exits are joined back level by level. A chain that closes on itself
inside a task is a local cycle; one that closes in the quotient is a global one,
and both carry the smallest id on the cycle with them.

Exits that nobody else leaves by drop out each round, and a step between two
rows is contracted when the lower row draws "follow the parent" and the upper
one "stay", a quarter of the steps by expectation, so the levels shrink
geometrically whatever the ids look like.

Defined results: rows without id are ignored; repeated ids keep the smallest
non-empty parent; a null, empty or missing parent makes the row's top a root; a
row that is its own parent is a cycle of one. Other columns are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.core import LOCAL_ROWS, lookup, pieces, scratch, small

_STEP = "id string, next string, hops long, seg_min string, top string"
_OPEN, _ROOT, _CYCLE = 0, 1, 2


def _contract_rows(ids, nexts, hops, mins, tops, paths):
    """Contract the chains of one task; returns parallel lists (exit, hops, min, top, path, state, cycle_min)."""
    at = {k: i for i, k in enumerate(ids)}
    n = len(ids)
    done = [False] * n
    exit_, total, low, top, state, cyc = list(nexts), list(hops), list(mins), list(tops), [_OPEN] * n, [None] * n
    path = paths
    for start in range(n):
        if done[start]:
            continue
        chain, seen, i = [], {}, start
        while i is not None and not done[i] and i not in seen:
            seen[i] = len(chain)
            chain.append(i)
            i = at.get(nexts[i]) if nexts[i] is not None else None
        if i is not None and not done[i]:
            ring = chain[seen[i] :]
            least = min(mins[j] for j in ring)
            for j in ring:
                state[j], cyc[j], done[j], exit_[j] = _CYCLE, least, True, None
            chain = chain[: seen[i]]
        for j in reversed(chain):
            up = at.get(nexts[j]) if nexts[j] is not None else None
            if up is None:
                state[j] = _ROOT if nexts[j] is None else _OPEN
            elif state[up] == _CYCLE:
                state[j], cyc[j], exit_[j] = _CYCLE, cyc[up], None
            else:
                state[j], exit_[j], top[j] = state[up], exit_[up], top[up]
                total[j] = hops[j] + total[up]
                low[j] = min(mins[j], low[up])
                if path is not None:
                    path[j] = path[up] + path[j]
            done[j] = True
    return exit_, total, low, top, path, state, cyc


def _contractor(with_path: bool):
    def run(batches):
        rows: dict[str, tuple] = {}
        for b in batches:
            cols = [b["id"], b["next"], b["hops"], b["seg_min"], b["top"]] + ([b["path"]] if with_path else [])
            for r in zip(*cols, strict=True):
                nxt = r[1] if isinstance(r[1], str) and r[1] else None
                old = rows.get(r[0])
                if old is None or (nxt is not None and (old[1] is None or nxt < old[1])):
                    rows[r[0]] = (r[0], nxt, *r[2:])
        if not rows:
            return
        c = list(zip(*rows.values(), strict=True))
        exit_, total, low, top, path, state, cyc = _contract_rows(
            c[0], c[1], c[2], c[3], c[4], [list(p) for p in c[5]] if with_path else None
        )
        out = {"id": c[0], "next": exit_, "hops": total, "seg_min": low, "top": top, "state": state, "cycle_min_id": cyc}
        if with_path:
            out["path"] = path
        for i in range(0, len(c[0]), 20_000):
            yield pd.DataFrame({k: v[i : i + 20_000] for k, v in out.items()})

    return run


def _contract(steps: DataFrame, with_path: bool) -> DataFrame:
    schema = _STEP + ", state int, cycle_min_id string" + (", path array<string>" if with_path else "")
    return steps.mapInPandas(_contractor(with_path), schema)


def resolve_hierarchy(
    nodes: DataFrame,
    id_col: str = "id",
    parent_col: str = "parent_id",
    locality: Column | None = None,
    with_path: bool = True,
    local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """One row a distinct id: (id, parent_id, root, depth, cycle_min_id[, path]).

    root and depth (0 for a root) and path (ids from the root down to the node)
    are null exactly for nodes whose chain never ends, which have cycle_min_id.
    locality orders rows so that related ones sort together (default: the id
    without its prefix up to the first colon); it changes the work, not the result.
    local_rows bounds the rows that one task contracts in the last level.
    """
    spark = nodes.sparkSession
    order = locality if locality is not None else F.regexp_replace(id_col, "^[^:]*:", "")
    rows = nodes.where(F.col(id_col).isNotNull())
    steps = rows.select(
        F.col(id_col).alias("id"),
        F.nullif(F.col(parent_col), F.lit("")).alias("next"),
        F.lit(1).cast("long").alias("hops"),
        F.col(id_col).alias("seg_min"),
        F.col(id_col).alias("top"),
        *([F.array(F.col(id_col)).alias("path")] if with_path else []),
        order.alias("_at"),
    )
    n = rows.count()
    steps = steps.repartitionByRange(pieces(n, local_rows, spark), "_at", "id").drop("_at")
    levels = [scratch(_contract(steps, with_path), "hier")]
    sizes = [n]
    while True:
        base = levels[-1]
        exits = base.where(F.col("state") == _OPEN).groupBy(F.col("next").alias("id")).agg(F.lit(1).alias("_x")).select("id")
        quotient = base.join(exits, "id", "left_semi").where(F.col("state") == _OPEN).select("id", "next", "hops", "seg_min", "top", *(["path"] if with_path else []))
        solved = base.join(exits, "id", "left_semi").where(F.col("state") != _OPEN)
        quotient = scratch(quotient, "quot")
        m = quotient.count()
        if m <= local_rows:
            level = _contract(quotient.coalesce(1), with_path)
        else:
            # a parent with too many steps below it is not followed: its children would meet in one task, and
            # they leave the quotient anyway once what is below them has been contracted
            hot = quotient.groupBy("next").count().where(F.col("count") > local_rows // 4).select("next", F.lit(1).alias("_hot"))  # fewer than 4 m / local_rows rows
            q = quotient.join(small(hot), "next", "left")
            follow = (F.pmod(F.xxhash64("id", F.lit(len(levels))), F.lit(2)) == 0) & F.col("_hot").isNull()
            q = q.repartition(pieces(m, local_rows, spark), F.when(follow, F.col("next")).otherwise(F.col("id"))).select(quotient.columns)
            level = _contract(q, with_path)
        # rows already solved below stay known to the level above
        levels.append(scratch(level.unionByName(solved.select(level.columns)), "hier"))
        sizes.append(m)
        if m <= local_rows:
            break
    last = levels[-1]  # its open rows leave by a row solved earlier, or by a parent that has no row
    done = _finish(last, _finish(last.where(F.col("state") != _OPEN), None, with_path, 0), with_path, sizes[-1])
    for lower, size in zip(reversed(levels[:-1]), reversed(sizes[:-1]), strict=True):
        done = _finish(lower, scratch(done, "done"), with_path, size)
    return done.select("id", "root", "depth", "cycle_min_id", *(["path"] if with_path else []))


def _finish(level: DataFrame, above: DataFrame | None, with_path: bool, rows: int) -> DataFrame:
    """Answers of one level from the answers for its exits; an exit that no row answers is a missing parent."""
    if above is None:
        joined = level.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("a_root", "string"), ("a_depth", "long"), ("a_cycle", "string"))), *([F.lit(None).cast("array<string>").alias("a_path")] if with_path else []))
    else:
        answers = above.select(
            F.col("id").alias("next"), F.col("root").alias("a_root"), F.col("depth").alias("a_depth"), F.col("cycle_min_id").alias("a_cycle"), *([F.col("path").alias("a_path")] if with_path else [])
        )
        opened = lookup(level.where(F.col("state") == _OPEN), answers, "next", rows)
        closed = level.where(F.col("state") != _OPEN)
        joined = opened.unionByName(closed, allowMissingColumns=True)
    cyclic = F.coalesce(F.col("cycle_min_id"), F.col("a_cycle"))
    live = cyclic.isNull()
    return joined.select(
        "id",
        F.when(live, F.coalesce("a_root", "top")).alias("root"),
        F.when(live, F.coalesce(F.col("a_depth") + F.col("hops"), F.col("hops") - 1)).alias("depth"),
        cyclic.alias("cycle_min_id"),
        *([F.when(live, F.when(F.col("a_path").isNotNull(), F.concat("a_path", "path")).otherwise(F.col("path"))).alias("path")] if with_path else []),
    )


def cyclic_nodes(nodes: DataFrame, **how) -> DataFrame:
    """(id, cycle_min_id) of the nodes whose chain of parents never ends."""
    return resolve_hierarchy(nodes, with_path=False, **how).where(F.col("cycle_min_id").isNotNull()).select("id", "cycle_min_id")


def hierarchy(nodes: DataFrame, **how) -> DataFrame:
    """(id, root, depth, path, n_descendants, cycle_min_id) for every node; path is null and counts are 0 on endless chains."""
    full = scratch(resolve_hierarchy(nodes, **how), "tree")
    below = full.where(F.col("depth") > 0).select(F.explode(F.slice("path", 1, F.col("depth").cast("int"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_descendants"))
    return full.join(below, "id", "left").select("id", "root", "depth", F.array_join("path", " > ").alias("path"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"), "cycle_min_id")


def descendants(nodes: DataFrame, **how) -> DataFrame:
    """(ancestor_id, descendant_id, distance): every proper ancestor of every node that has a root."""
    full = resolve_hierarchy(nodes, **how).where(F.col("depth") > 0)
    return full.select("id", "depth", F.posexplode(F.slice("path", 1, F.col("depth").cast("int"))).alias("pos", "ancestor_id")).select(
        "ancestor_id", F.col("id").alias("descendant_id"), (F.col("depth") - F.col("pos")).alias("distance")
    )
