"""Ranked neighbourhood search: anchors by substring, community and neighbour expansion, budgeted output.

The anchor scan is one pass over the nodes with all terms compiled into the
plan; only the first rows of every term survive a task. What follows works on
at most a few hundred ids, which is the feature's own limit. LIKE folds case and
takes % and _ of the query as wildcards. External nodes never match; a null
community counts as 0 and is not expanded; no match gives no row.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions import lines as L
from arborlake.functions import scalars as S


def query_terms(query: str) -> list[str]:
    """The query, then its words of two characters or more."""
    words = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", query)
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", words)
    words = [w for w in re.split(r"[^A-Za-z0-9]+", words) if len(w) >= 2]
    return [query, *(w for w in dict.fromkeys(words) if w.lower() != query.lower())]


def anchors(n: DataFrame, query: str, rows: int = 10) -> DataFrame:
    """(id, term): for each term in order its first rows by id, each node with its first term, cut to rows in all."""
    x = n.where("external = 0 and kind <> 'directory'").select("id", "name", "qualified_name")
    terms = query_terms(query)
    hits = F.filter(F.array(*(F.when(F.col("name").ilike(f"%{t}%") | F.col("qualified_name").ilike(f"%{t}%"), F.lit(k)) for k, t in enumerate(terms))), lambda v: v.isNotNull())
    each = x.select("id", F.explode(hits).alias("term")).withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy("id"))).where(F.col("r") <= rows)
    return each.groupBy("id").agg(F.min("term").alias("term")).orderBy("term", "id").limit(rows)


def snippet_anchors(nodes: DataFrame, query: str, rows: int = 10) -> DataFrame:
    """(id, term): fallback over the text of nodes."""
    return nodes.where("external = 0 and snippet is not null").where(F.col("snippet").ilike(f"%{query}%")).select("id", F.lit(0).alias("term")).distinct().orderBy("id").limit(rows)


def expand(n: DataFrame, e: DataFrame, found: DataFrame, community_rows: int = 15, bridge_rows: int = 20) -> DataFrame:
    """(id, tier): the anchors, members of their communities, and neighbours of both."""
    x = n.select("id", "kind", "file_path", "start_line", F.coalesce("community_id", F.lit(0)).alias("c"), "external")
    a = F.broadcast(found.select("id"))  # at most the anchor limit
    am = x.join(a, "id", "left_semi")
    files = am.select("file_path").distinct().withColumn("own", F.lit(1))
    comm = x.where("external = 0 and c <> 0").join(F.broadcast(am.select("c").distinct()), "c", "left_semi").join(F.broadcast(files), "file_path", "left")
    comm = comm.orderBy(F.col("own").desc_nulls_last(), F.col("start_line").asc_nulls_first(), "id").limit(community_rows).select("id").join(a, "id", "left_anti")
    base = a.unionByName(comm)
    b = F.broadcast(base)
    out = e.join(b.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    inn = e.join(b.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("id"))
    near = out.unionByName(inn).distinct().join(b, "id", "left_anti").orderBy("id").limit(bridge_rows)
    near = x.where("external = 0").join(F.broadcast(near), "id", "left_semi").select("id")
    return reduce(DataFrame.unionByName, (t.select("id", F.lit(k).alias("tier")) for k, t in (("anchor", a), ("bridge", near), ("community", comm))))


def ranked(n: DataFrame, e: DataFrame, tiers: DataFrame) -> DataFrame:
    """(position, id, tier, edge_count): anchors, bridges, communities; most edges first within a tier."""
    w = F.broadcast(tiers.select("id"))
    ends = e.select(F.explode(F.array("source_id", "target_id")).alias("id")).join(w, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("edge_count"))
    rank = F.when(F.col("tier") == "anchor", 0).when(F.col("tier") == "bridge", 1).otherwise(2)
    x = tiers.join(ends, "id", "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))
    return x.select(F.row_number().over(Window.orderBy(rank, F.desc("edge_count"), "id")).alias("position"), "id", "tier", "edge_count")


def halved(sizes: list[int], room: int, times: int = 5) -> int:
    """How many of the sizes are kept: halved until their sum fits, at most so often, never below one."""
    keep = len(sizes)
    for _ in range(times):
        if keep <= 1:
            break
        keep = max(1, keep // 2)
        if sum(sizes[:keep]) <= room:
            break
    return keep


def search(nodes: DataFrame, n: DataFrame, e: DataFrame, query: str, rows: int = 10, budget: int = 8000) -> DataFrame:
    """(position, id, tier, mode, block) within a token budget; budget 0 keeps everything.

    Stages: as it is; without bridges; texts to signatures; to one-liners; then
    halvings of what is no anchor, at most five, fewest edges first out, one kept.
    The first stage and the first halving that fit are chosen on totals of at most
    a few dozen rows.
    """
    found = anchors(n, query, rows)
    if found.isEmpty():
        found = snippet_anchors(nodes, query, rows)
    hits = ranked(n, e, expand(n, e, found))
    text = nodes.select("id", "name", "kind", "file_path", "start_line", "end_line", "snippet").dropDuplicates(["id"])
    x = text.join(F.broadcast(hits), "id")
    first = F.get(L.split_lines(F.coalesce("snippet", F.lit(""))), F.lit(0))
    loc = F.concat(F.coalesce("file_path", F.lit("")), F.when(F.col("start_line") > 0, F.format_string(":L%d-L%d", "start_line", "end_line")).otherwise(F.lit("")))
    forms = {"full": L.join_lines(L.entropy_filter(L.split_lines(F.coalesce("snippet", F.lit(""))))), "signature": F.coalesce(first, F.col("name")), "map": F.format_string("%s (%s) — %s", "name", "kind", loc)}
    x = x.select("position", "id", "tier", "edge_count", *(f.alias(k) for k, f in forms.items()))
    size = {k: S.tokens_floor(F.col(k)) for k in forms}
    r = {k: {t or "all": v for t, v in x.groupBy("tier").agg(F.sum(c).alias("s")).collect()} for k, c in size.items()}  # three tiers
    total = lambda k, tiers: sum(v for t, v in r[k].items() if t in tiers)
    every, core = ("anchor", "bridge", "community"), ("anchor", "community")
    stages = [("full", every), ("full", core), ("signature", core), ("map", core)]
    mode, tiers = next(((k, t) for k, t in stages if not budget or total(k, t) <= budget), ("map", core))
    out = x.where(F.col("tier").isin(*tiers))
    if budget and total(mode, tiers) > budget:
        order = (F.desc("edge_count"), "id")
        sizes = [r[0] for r in out.where("tier <> 'anchor'").orderBy(*order).select(size[mode]).collect()]  # the rows that expand allows: a few dozen
        keep = halved(sizes, budget - total(mode, ("anchor",)))
        out = out.where("tier = 'anchor'").unionByName(out.where("tier <> 'anchor'").orderBy(*order).limit(keep))
    return out.select("position", "id", "tier", F.lit(mode).alias("mode"), F.concat(F.lit("--- START "), "id", F.lit("\n"), F.col(mode), F.lit("\n--- END")).alias("block"))


def glob_lookup(n: DataFrame, pattern: str) -> DataFrame:
    """(match, what): files and symbols by a pattern with * and ?, anywhere if it has none."""
    like = pattern.replace("*", "%").replace("?", "_")
    like = like if "%" in like else f"%{like}%"
    files = n.where(F.col("file_path").ilike(like)).select(F.col("file_path").alias("match"), F.lit("file").alias("what"))
    names = n.where(F.col("name").ilike(like) & (F.col("external") == 0)).select(F.col("id").alias("match"), F.lit("symbol").alias("what"))
    return files.unionByName(names).distinct()
