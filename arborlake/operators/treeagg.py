"""Per-key results without a reducer that receives every row or every partial of a hot key.

Rows are counted into a table of fixed size by the hash of their key; a key with
more than CHUNK_ROWS rows can only lie in a counter above that. Rows of such
counters are cut into chunks of about CHUNK_ROWS rows by a second value, all
others are placed by their key, and one exchange brings every chunk to its task,
where it is combined at once. Only the chunks of hot counters go on: rounds of
fan-in merge the states of F neighbouring chunks at a time until one state a key
is left. The most that any task merges in a round is F states of a key,
whatever share of the rows the key holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.core import bucket, scratch

CHUNK_ROWS = 50_000
FAN_IN = 16
#: Counters that tell where hot keys may lie.
COUNTERS = 1 << 16


def tree_aggregate(
    df: DataFrame,
    keys: list[str],
    first: dict[str, Column],
    merge: dict[str, Column],
    spread: Column,
    chunk_rows: int = CHUNK_ROWS,
    fan_in: int = FAN_IN,
    within: Callable[[DataFrame, list[str]], DataFrame] | None = None,
    counted: str | None = None,
    again: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """Aggregate by keys: one exchange for all rows, ceil(log_fan_in(chunks)) more for the states of hot keys.

    first: state columns from rows, merge: the same columns from states (both by
    name). spread: a hash that puts a row of a hot key into a chunk; it
    should differ from row to row. within: what to do to the rows of a chunk
    first; it gets the columns that place them and must group by these among
    others, so that it needs no exchange. counted, again: for distinct counts,
    the counted value and how to merge what within left of one value, which
    chunks of hot keys may have in common; chunks are by that value from there on,
    so counts of states add up. Null keys form a group of their own, as in GROUP
    BY. An empty input gives an empty result.
    """
    at = bucket(F.hash(*keys), COUNTERS)
    hot = {r[0]: -(-r[1] // chunk_rows) for r in df.groupBy(at.alias("c")).count().where(F.col("count") > chunk_rows).collect()}  # COUNTERS rows at most
    states = lambda x, by: x.groupBy(*by).agg(*(c.alias(n) for n, c in first.items()))
    if not hot:
        rows = df.repartition(*keys)
        return states(within(rows, keys) if within else rows, keys)
    place = [*keys, "_chunk"]
    chunks = F.element_at(F.map_from_arrays(F.lit(list(hot)), F.lit(list(hot.values()))), at)
    rows = df.withColumn("_chunk", F.when(chunks.isNotNull(), F.pmod(spread, chunks)).otherwise(F.lit(-1)).cast("long")).repartition(*place)
    rows = within(rows, place) if within else rows
    if counted:
        rows = scratch(rows, "chunks")
        parts = rows.where("_chunk >= 0").withColumn("_chunk", F.pmod(F.xxhash64(counted), F.lit(max(hot.values()))).cast("long"))
        rows = rows.where("_chunk = -1").unionByName(again(parts, place))
    state = scratch(states(rows, place), "chunks")
    done, chunks = state.where("_chunk = -1"), max(hot.values())
    state = state.where("_chunk >= 0")
    while chunks > 1:
        chunks = -(-chunks // fan_in)
        state = state.withColumn("_chunk", F.floor(F.col("_chunk") / fan_in)).groupBy(*place).agg(*(c.alias(n) for n, c in merge.items()))
    return done.unionByName(state).drop("_chunk")


def edge_key_stats(edges: DataFrame, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(kind, target_id, n_edges, n_callers, n_resolved, max_score) over distinct edges.

    Replayed rows (same id and ends) count once; rows without id count once for
    each different (kind, source_id, target_id). A null source is no caller.
    """

    def once(rows: DataFrame, place: list[str]) -> DataFrame:
        x = rows.groupBy(*place, "source_id", "id").agg(F.max("resolved").alias("resolved"), F.max("confidence_score").alias("score"))
        return x.groupBy(*place, "source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("resolved").alias("r"), F.max("score").alias("m"))

    def callers(parts: DataFrame, place: list[str]) -> DataFrame:
        return parts.groupBy(*place, "source_id").agg(F.sum("n").alias("n"), F.sum("r").alias("r"), F.max("m").alias("m"))

    return tree_aggregate(
        edges.select("id", "kind", "source_id", "target_id", "resolved", "confidence_score"),
        ["kind", "target_id"],
        {"n_edges": F.sum("n"), "n_callers": F.count("source_id"), "n_resolved": F.sum("r"), "max_score": F.max("m")},
        {"n_edges": F.sum("n_edges"), "n_callers": F.sum("n_callers"), "n_resolved": F.sum("n_resolved"), "max_score": F.max("max_score")},
        F.xxhash64("source_id", "id"),
        chunk_rows,
        fan_in,
        once,
        "source_id",
        callers,
    )


def heavy_keys(edges: DataFrame, share: float = 0.015) -> DataFrame:
    """(kind, target_id) of keys that hold at least the share of all distinct edges."""
    stats = scratch(edge_key_stats(edges), "keys")
    total = stats.agg(F.sum("n_edges")).first()[0] or 0
    return stats.where(F.col("n_edges") >= F.lit(share * total)).select("kind", "target_id")
