"""Connected components of an undirected edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.core import drop, lookup, scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every id that has an edge; component is the smallest id reachable.

    Large-star and small-star rounds (Kiveris et al. 2014) until a round changes
    nothing: every round links neighbours to the smallest one seen. The minima are
    summed map-side, and vertices with very many edges, which the stars make, meet
    their minimum by broadcast (core.lookup), so none is sent to one task. The
    written table of a round is the input of the next. Loops give a component of
    one; null ends are ignored.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    own = e.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    own = scratch(own, "ids")
    e = scratch(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    rows = e.count()
    while rows:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = lookup(both, low, "u", 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup(large, least, "u", 2 * rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        nxt = scratch(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
        drop(large)
        count = nxt.count()
        same = count == rows and nxt.join(e, ["u", "v"], "left_anti").isEmpty()
        drop(e)
        e, rows = nxt, count
        if same:
            break
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    return own.join(roots, own.id == roots.u, "left").select("id", F.coalesce("component", "id").alias("component"))
