"""Property-graph analytics over node, edge and community tables.

Edges are a multiset: degrees count every distinct edge row. Every ranking ends
with an id so that its order is total. Heavy text columns stay off the joins.
Null or lower-case confidence reads as its upper case, null as EXTRACTED; an
absent confidence column is supplied. Empty tables give empty results.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlake.core import bucket, drop, lookup, scratch
from arborlake.operators.windows import numbered

#: Names too common to be hubs.
NOISE_LABELS = (
    "str int bool float dict list set tuple None Optional Any Union Path Callable Iterable Mapping Sequence Type Mock MagicMock pytest self this cls args kwargs object"
).split()
CLUSTERABLE = ("class", "function", "method")
#: Fixed values of hub detection, scoring and risk.
HUB_FLOOR, GOD_FLOOR = 50, 20


def node_view(nodes: DataFrame) -> DataFrame:
    """Nodes with repeated rows once and without their text."""
    return nodes.drop("snippet", "signature").distinct()


def edge_view(edges: DataFrame) -> DataFrame:
    """Edges with replayed rows once and confidence normalized; schema-on-read for older tables without confidence."""
    if "confidence" not in edges.columns:
        edges = edges.withColumn("confidence", F.lit("EXTRACTED"))
    return edges.select("id", "source_id", "target_id", "kind", "resolved", F.coalesce(F.upper("confidence"), F.lit("EXTRACTED")).alias("confidence")).distinct()


def degrees(e: DataFrame, kinds=("calls", "inherits"), resolved: bool = True) -> DataFrame:
    """(node_id, degree): endpoints of edges of the kinds, both ends counted, one shuffle after map-side sums."""
    e = e.where(F.col("kind").isin(*kinds))
    if resolved:
        e = e.where("resolved = 1")
    return e.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).where("node_id is not null").groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def hub_nodes(n: DataFrame, e: DataFrame, top: int = 10) -> DataFrame:
    """Top symbols by degree over resolved calls, inherits and imports; noise names leave after twice the rows are ranked."""
    d = degrees(e, ("calls", "inherits", "imports"))
    ranked = n.where("external = 0").where(F.col("kind").isin(*CLUSTERABLE)).join(d, n.id == d.node_id).orderBy(F.desc("degree"), "id").limit(2 * top)
    return ranked.where(~F.coalesce(F.col("name").isin(NOISE_LABELS), F.lit(False))).orderBy(F.desc("degree"), "id").limit(top).select("id", "name", "kind", "file_path", "community_id", "degree")


def in_out_degrees(n: DataFrame, e: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, edge_count) over all kinds for every node."""
    ends = e.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return n.select("id").join(d, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"), (F.coalesce("in_degree", F.lit(0)) + F.coalesce("out_degree", F.lit(0))).alias("edge_count"))


def nearest_rank(values: DataFrame, col: str, index) -> DataFrame:
    """One row (n, value): the value at 0-based position index(n) of the ascending order, from a histogram of the values.

    Only the distinct values meet in one task, never the rows.
    """
    h = values.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("cum", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return h.where(F.col("cum") > index(F.col("n"))).groupBy("n").agg(F.min("v").alias("value"))


def hub_threshold(e: DataFrame) -> DataFrame:
    """One row: nearest-rank 99th percentile of the degrees, and the threshold that is at least the floor."""
    p = nearest_rank(degrees(e), "degree", lambda n: F.floor(n * 99 / 100))
    return p.select(F.col("n").alias("nodes"), F.col("value").alias("p99"), F.greatest(F.lit(HUB_FLOOR), "value").alias("threshold"))


def _threshold(e: DataFrame) -> int:
    r = hub_threshold(e).first()
    return r["threshold"] if r else HUB_FLOOR


def super_hubs(e: DataFrame) -> DataFrame:
    return degrees(e).where(F.col("degree") > _threshold(e))


def god_flags(e: DataFrame) -> DataFrame:
    """(node_id, degree) of the top twentieth by degree over all kinds, at least the floor."""
    d = degrees(e, ("calls", "inherits", "imports", "contains"), resolved=False)
    r = nearest_rank(d, "degree", lambda n: n - 1 - F.floor(n / 20)).first()
    return d.where(F.col("degree") >= max(GOD_FLOOR, r["value"] if r else 0))


def confidence_counts(e: DataFrame) -> DataFrame:
    return e.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


def confidence_by_kind(e: DataFrame) -> DataFrame:
    """One row a kind with a column for each confidence."""
    return e.groupBy("kind").agg(*(F.count_if(F.col("confidence") == c).alias(c.lower()) for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS")))


def surprise(n: DataFrame, e: DataFrame) -> DataFrame:
    """(id, source_id, target_id, kind, confidence, score) of edges above 30 hundredths.

    40 across communities, 25 across top directories, 25 or 15 for ambiguous or
    inferred; every edge is scored. Whole hundredths keep the sums exact.
    """
    side = lambda p: n.select(F.col("id").alias(f"{p}_id"), F.col("community_id").alias(f"{p}_c"), F.nullif(F.substring_index("file_path", "/", 1), F.lit("")).alias(f"{p}_d"))
    x = e.withColumnRenamed("source_id", "s_id").withColumnRenamed("target_id", "t_id").join(side("s"), "s_id").join(side("t"), "t_id")
    score = (
        F.when(F.col("s_c") != F.col("t_c"), 40).otherwise(0)
        + F.when(F.col("s_d") != F.col("t_d"), 25).otherwise(0)
        + F.when(F.col("confidence") == "AMBIGUOUS", 25).when(F.col("confidence") == "INFERRED", 15).otherwise(0)
    )
    return x.select("id", F.col("s_id").alias("source_id"), F.col("t_id").alias("target_id"), "kind", "confidence", score.alias("score")).where("score > 30")


def review_questions(n: DataFrame, e: DataFrame, communities: DataFrame) -> DataFrame:
    """(category, target, question): two loose communities, two ambiguous edges, two god nodes."""
    low = communities.distinct().where("cohesion < 0.15 and node_count >= 5").orderBy("cohesion", "id").limit(2)
    a = low.select(F.lit("low_cohesion").alias("category"), F.format_string("Community %s (%s)", F.col("id").cast("string"), "label").alias("target"), F.format_string("Community '%s' (%s nodes) is loose. Split it?", "label", F.col("node_count").cast("string")).alias("question"))
    amb = e.where("confidence = 'AMBIGUOUS'").orderBy("id").limit(2)
    b = amb.select(F.lit("ambiguous_edge").alias("category"), F.format_string("%s -> %s", "source_id", "target_id").alias("target"), F.format_string("Is the %s edge intended?", "kind").alias("question"))
    g = hub_nodes(n, e, 2)
    c = g.select(F.lit("bridge_node").alias("category"), F.col("id").alias("target"), F.format_string("Symbol '%s' has degree %s. Refactor?", "name", F.col("degree").cast("string")).alias("question"))
    return a.unionByName(b).unionByName(c)


def graph_stats(n: DataFrame, e: DataFrame, communities: DataFrame) -> DataFrame:
    """(metric, value): counts of nodes and edges, in all and by kind, resolved edges, communities."""
    out = [
        n.agg(F.count(F.lit(1)).alias("value")).select(F.lit("nodes").alias("metric"), "value"),
        n.groupBy(F.concat(F.lit("nodes."), "kind").alias("metric")).agg(F.count(F.lit(1)).alias("value")),
        e.agg(F.count(F.lit(1)).alias("value")).select(F.lit("edges").alias("metric"), "value"),
        e.groupBy(F.concat(F.lit("edges."), "kind").alias("metric")).agg(F.count(F.lit(1)).alias("value")),
        e.agg(F.count_if(F.col("resolved") == 1).alias("value")).select(F.lit("edges.resolved").alias("metric"), "value"),
        communities.distinct().agg(F.count(F.lit(1)).alias("value")).select(F.lit("communities").alias("metric"), "value"),
    ]
    return reduce(DataFrame.unionByName, out)


# --- communities -----------------------------------------------------------


def member_edges(n: DataFrame, e: DataFrame) -> DataFrame:
    """(source_id, target_id, s_c, t_c): calls and inherits between clusterable nodes with their communities."""
    m = n.where(F.col("kind").isin(*CLUSTERABLE)).select("id", "community_id")
    return (
        e.where("kind in ('calls', 'inherits')")
        .select("source_id", "target_id", "kind")
        .join(m.select(F.col("id").alias("source_id"), F.col("community_id").alias("s_c")), "source_id")
        .join(m.select(F.col("id").alias("target_id"), F.col("community_id").alias("t_c")), "target_id")
    )


def community_metrics(n: DataFrame, e: DataFrame) -> DataFrame:
    """(community_id, node_count, internal_edges, cohesion in ten-thousandths)."""
    size = n.where(F.col("kind").isin(*CLUSTERABLE) & F.col("community_id").isNotNull()).groupBy("community_id").agg(F.count(F.lit(1)).alias("node_count"))
    inner = member_edges(n, e).where("s_c = t_c").groupBy(F.col("s_c").alias("community_id")).agg(F.count(F.lit(1)).alias("internal_edges"))
    x = size.join(inner, "community_id", "left").withColumn("internal_edges", F.coalesce("internal_edges", F.lit(0)))
    possible = F.col("node_count") * (F.col("node_count") - 1)
    cohesion = F.when(F.col("node_count") <= 1, F.lit(10000)).otherwise(F.least(F.lit(10000), F.floor(F.col("internal_edges") * 10000 / possible)))
    return x.select("community_id", "node_count", "internal_edges", cohesion.cast("long").alias("cohesion_bp"))


def community_hubs(n: DataFrame, e: DataFrame) -> DataFrame:
    """(community_id, hub_id, degree, label): member with most edges inside the clusterable graph, smallest id on ties."""
    me = member_edges(n, e)
    d = me.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    m = n.where(F.col("kind").isin(*CLUSTERABLE) & F.col("community_id").isNotNull()).join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = m.groupBy("community_id").agg(F.min(F.struct((-F.col("degree")).alias("neg"), "id", "name", "file_path")).alias("b"))
    parent = F.when(F.size(F.split("b.file_path", "/")) > 1, F.element_at(F.split("b.file_path", "/"), -2)).otherwise(F.lit("root"))
    return best.select("community_id", F.col("b.id").alias("hub_id"), (-F.col("b.neg")).alias("degree"), F.concat_ws("/", F.coalesce(parent, F.lit("root")), "b.name").alias("label"))


def community_top_files(n: DataFrame, top: int = 5) -> DataFrame:
    """(community_id, rank, file_path, members): the files with most members, by name on ties."""
    c = n.where(F.col("kind").isin(*CLUSTERABLE) & F.col("community_id").isNotNull() & F.col("file_path").isNotNull()).groupBy("community_id", "file_path").agg(F.count(F.lit(1)).alias("members"))
    w = Window.partitionBy("community_id").orderBy(F.desc("members"), "file_path")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def renumbered_communities(n: DataFrame) -> DataFrame:
    """(community_id, new_id): 1-based by size descending, then smallest member id. Only one row a community is ordered."""
    s = n.where(F.col("kind").isin(*CLUSTERABLE) & F.col("community_id").isNotNull()).groupBy("community_id").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    x = numbered(s.withColumn("smaller", -F.col("size")), ["smaller", "first"], "new_id", 1)
    return x.select("community_id", F.col("new_id").cast("int").alias("new_id"))


def reattach_hubs(n: DataFrame, e: DataFrame, hubs: DataFrame) -> DataFrame:
    """(id, community_id): majority community of each hub's neighbours, smallest id on ties."""
    me = member_edges(n, e)
    h = hubs.select(F.col("node_id").alias("id"))
    both = me.select(F.col("source_id").alias("id"), F.col("t_c").alias("c")).unionByName(me.select(F.col("target_id").alias("id"), F.col("s_c").alias("c"))).where("c is not null")
    votes = both.join(h, "id", "left_semi").groupBy("id", "c").agg(F.count(F.lit(1)).alias("v"))
    return votes.groupBy("id").agg(F.min(F.struct((-F.col("v")).alias("neg"), "c")).alias("b")).select("id", F.col("b.c").alias("community_id"))


def detect_communities(n: DataFrame, e: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, community): deterministic weighted label propagation over calls (3) and inherits (10).

    Labels start as the node's id; each round a node takes the label with most
    weight among its neighbours and itself, the smallest label on ties; super-hubs
    take part only at the end, by majority of their neighbours' labels. Rounds end when
    two in a row, in which every node had its turn, change no label; a warning says
    if the bound was hit before. A round is two shuffles on the node
    id with map-side sums; its written table is the next round's input.
    Nodes without edges keep their own community.
    """
    hubs = super_hubs(e).select(F.col("node_id").alias("id"))
    w = member_edges(n, e).where("source_id <> target_id").select("source_id", "target_id", F.when(F.col("kind") == "calls", 3).otherwise(10).alias("w"))
    both = w.unionByName(w.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "w")).groupBy("source_id", "target_id").agg(F.sum("w").alias("w"))
    both = scratch(both.join(hubs.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(hubs.withColumnRenamed("id", "target_id"), "target_id", "left_anti"), "weights")
    ids = n.where(F.col("kind").isin(*CLUSTERABLE)).select("id").distinct()
    labels = scratch(ids.withColumn("label", F.col("id")), "labels")
    calm = 0
    for k in range(rounds):
        # the half of the nodes that moves alternates, so that two nodes cannot swap for ever
        mine = F.pmod(F.xxhash64("id", F.lit(k // 2)), F.lit(2)) == k % 2
        votes = both.join(labels.select(F.col("id").alias("target_id"), "label"), "target_id").groupBy(F.col("source_id").alias("id"), "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("neg"), "label")).alias("b")).select("id", F.col("b.label").alias("next"))
        moved = scratch(labels.join(best, "id", "left").select("id", F.when(mine, F.coalesce("next", "label")).otherwise(F.col("label")).alias("label"), (mine & (F.col("next") != F.col("label"))).alias("moved")), "labels")
        labels = moved.select("id", "label")
        calm = 0 if moved.where("moved").limit(1).count() else calm + 1 if k % 2 == 0 or calm else 0
        if calm == 2:
            break
    else:
        warnings.warn(f"detect_communities: labels still changed after {rounds} rounds", stacklevel=2)
    free = labels.join(hubs, "id", "left_anti").withColumnRenamed("label", "community_id")
    attached = reattach_hubs(n.drop("community_id").join(free, "id", "left"), e, hubs.withColumnRenamed("id", "node_id")).withColumnRenamed("community_id", "joined")
    return labels.join(attached, "id", "left").select("id", F.coalesce("joined", "label").alias("community"))


# --- traversal -------------------------------------------------------------


def bfs(edges: DataFrame, seeds: DataFrame, max_hops: int, blocked: DataFrame | None = None) -> DataFrame:
    """(id, hop, via): breadth-first hops along (source_id -> target_id) from seeds (id) at hop 0; via is the smallest predecessor.

    blocked ids are reached but not expanded, unless they are seeds. Each hop is
    one shuffle join of a frontier with the edges and an anti join with what was
    seen; its table is written, so a lost executor costs a hop at most.
    """
    e = scratch(edges.select("source_id", "target_id").distinct(), "adj")
    seen = scratch(seeds.select("id").distinct().select("id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via")), "seen")
    front = seen.select("id")
    for hop in range(1, max_hops + 1):
        step = e.join(front.withColumnRenamed("id", "source_id"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.min("source_id").alias("via")).where("id is not null")
        new = scratch(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"), "via"), "hop")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        front = new.select("id")
        if blocked is not None:
            front = front.join(blocked.select("id"), "id", "left_anti")
    return seen


def shortest_path(e: DataFrame, source: str, target: str, max_hops: int = 8) -> DataFrame:
    """(hop, id) along one shortest directed path over resolved calls, inherits and imports, smallest predecessors; empty if there is none."""
    spark = e.sparkSession
    links = e.where("resolved = 1 and kind in ('calls', 'inherits', 'imports')")
    seen = bfs(links, spark.createDataFrame([(source,)], "id string"), max_hops)
    path, at = [], target
    for _ in range(max_hops + 1):  # at most max_hops look-ups of one row
        r = seen.where(F.col("id") == at).first()
        if r is None:
            break
        path.append((r["hop"], at))
        if r["via"] is None:
            break
        at = r["via"]
    return spark.createDataFrame(path if path and path[-1][1] == source else [], "hop int, id string")


def resolve_symbols(n: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, how) for queries (query): exact id, name or qualified name, else up to five that contain it, ignoring case."""
    exact = reduce(DataFrame.unionByName, (n.select("id", F.col(c).alias("query")) for c in ("id", "name", "qualified_name"))).join(queries, "query").select("query", "id").distinct().withColumn("how", F.lit("exact"))
    rest = queries.join(exact.select("query").distinct(), "query", "left_anti")
    # no key to meet on: the queries go to the nodes in blocks of bounded size, all nodes against each
    rest = scratch(rest.distinct(), "queries")
    blocks = max(1, -(-rest.count() // 1000))
    found = F.expr("name ilike concat('%', query, '%') or qualified_name ilike concat('%', query, '%')")
    like = reduce(DataFrame.unionByName, (n.join(F.broadcast(rest.where(bucket("query", blocks) == k)), found).select("query", "id") for k in range(blocks))).distinct()
    like = like.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("id"))).where("r <= 5").select("query", "id", F.lit("like").alias("how"))
    return exact.unionByName(like)


def impact(n: DataFrame, e: DataFrame, targets: DataFrame, hops: int = 3) -> DataFrame:
    """(id, hop) of everything that reaches the targets (id) by resolved calls and inherits, super-hubs reached but not expanded."""
    hops = min(6, max(1, hops))
    rev = e.where("resolved = 1 and kind in ('calls', 'inherits')").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    blocked = super_hubs(e).select(F.col("node_id").alias("id"))
    return bfs(rev, targets, hops, blocked).select("id", "hop")


def file_targets(n: DataFrame, files: DataFrame) -> DataFrame:
    """(id): classes, functions and methods of the files (file_path)."""
    return n.where(F.col("kind").isin(*CLUSTERABLE)).join(files.distinct(), "file_path", "left_semi").select("id").distinct()


def crossed_bridges(n: DataFrame, reached: DataFrame, cap: int = 25) -> DataFrame:
    """(caller_id, target_id) pairs of different known communities, smallest first, at most cap.

    The cap is the feature. Only the smallest members of each community can be in
    it, so at most cap of a community meet, and no product of the sides is made.
    """
    m = reached.join(n.select("id", "community_id").where("community_id is not null"), "id")
    first = m.withColumn("side", F.when(F.col("hop") == 0, "t").otherwise("c")).withColumn("r", F.row_number().over(Window.partitionBy("side", "community_id").orderBy("id"))).where(F.col("r") <= cap)
    t = first.where("side = 't'").select(F.col("id").alias("target_id"), F.col("community_id").alias("tc"), F.lit(1).alias("k")).orderBy("target_id")
    c = first.where("side = 'c'").select(F.col("id").alias("caller_id"), F.col("community_id").alias("cc"), F.lit(1).alias("k")).orderBy("caller_id").limit(cap * cap)
    return c.join(t.limit(cap * cap), "k").where("tc <> cc").orderBy("caller_id", "target_id").limit(cap).select("caller_id", "target_id")


def impact_risk(n: DataFrame, e: DataFrame, communities: DataFrame, targets: DataFrame, hops: int = 3) -> DataFrame:
    """One row (direct, transitive, hubs, bridges, low_cohesion, risk) by the risk ladder."""
    reached = scratch(impact(n, e, targets, hops), "reach")
    hubs = super_hubs(e).select(F.col("node_id").alias("id"))
    r = reached.agg(F.count_if(F.col("hop") == 1).alias("direct"), F.count_if(F.col("hop") > 1).alias("transitive"))
    h = reached.where("hop > 0").join(hubs, "id", "left_semi").agg(F.count(F.lit(1)).alias("hubs"))
    b = crossed_bridges(n, reached).agg(F.count(F.lit(1)).alias("bridges"))
    mine = reached.join(n.select("id", "community_id"), "id").select(F.col("community_id").alias("id")).distinct()
    low = communities.distinct().join(mine, "id", "left_semi").agg(F.coalesce(F.min("cohesion") < 0.10, F.lit(False)).alias("low_cohesion"))
    one = reduce(lambda x, y: x.join(y, "k"), (x.withColumn("k", F.lit(1)) for x in (r, h, b, low))).drop("k")
    risk = F.when((F.col("hubs") >= 2) | (F.col("direct") + F.col("transitive") >= 50), "critical").when((F.col("hubs") >= 1) | F.col("low_cohesion") | (F.col("direct") + F.col("transitive") >= 20), "high").when((F.col("direct") + F.col("transitive") >= 5) | (F.col("bridges") >= 3), "medium").otherwise("low")
    return one.withColumn("risk", risk)


def import_cycles(e: DataFrame, max_len: int | None = None) -> DataFrame:
    """(length, cycle): simple import cycles between files, each once from its smallest file; of any length unless max_len is given.

    Paths grow by a file a round until none is open. A canonical answer in place of the order-dependent depth-first one. Files that
    are on no cycle are trimmed first: whoever has no edge in or none out goes.
    """
    f = e.where("kind = 'imports' and resolved = 1 and source_id like 'file:%' and target_id like 'file:%' and source_id <> target_id").select("source_id", "target_id").distinct()
    f = scratch(f, "imports")
    size = f.count()
    while size:
        g = scratch(f.join(f.select(F.col("source_id").alias("target_id")).distinct(), "target_id", "left_semi").join(f.select(F.col("target_id").alias("source_id")).distinct(), "source_id", "left_semi").select("source_id", "target_id"), "imports")
        m = g.count()
        f, done = g, m == size
        size = m
        if done:
            break
    paths = f.where("source_id < target_id").select(F.array("source_id", "target_id").alias("p"), F.col("target_id").alias("end"))
    out, k = [], 2
    while True:
        paths = scratch(paths, "paths")
        if paths.isEmpty() and out:
            break
        closed = paths.join(f, paths.end == f.source_id).where(F.col("target_id") == F.col("p")[0])
        out.append(closed.select(F.lit(k).alias("length"), F.array_join("p", " > ").alias("cycle")))
        if k == max_len:
            break
        paths = paths.join(f, paths.end == f.source_id).where((F.col("target_id") > F.col("p")[0]) & ~F.array_contains("p", F.col("target_id"))).select(F.concat("p", F.array("target_id")).alias("p"), F.col("target_id").alias("end"))
        k += 1
    return reduce(DataFrame.unionByName, out)


def topological_levels(n: DataFrame, e: DataFrame) -> DataFrame:
    """(id, level): 0 for nodes without dependencies, else one more than the deepest dependency; null on or above a cycle.

    Peels one level a round over contains, calls and inherits among clusterable
    nodes until a round finds none; self edges do not count. A round writes what is
    left of the nodes and edges; the tables of the round before are deleted.
    """
    m = n.where(F.col("kind").isin(*CLUSTERABLE)).select("id").distinct()
    d = e.where("kind in ('contains', 'calls', 'inherits') and source_id <> target_id").select("source_id", "target_id").distinct()
    d = scratch(d.join(m.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(m.withColumnRenamed("id", "target_id"), "target_id", "left_semi"), "deps")
    left, done, level = scratch(m, "left"), None, 0
    while True:
        waiting = d.select(F.col("source_id").alias("id")).distinct().withColumn("w", F.lit(True))
        state = scratch(left.join(waiting, "id", "left"), "level")
        ready = state.where("w is null").select("id", F.lit(level).alias("level"))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        rest = scratch(d.join(ready.select(F.col("id").alias("target_id")), "target_id", "left_anti").select("source_id", "target_id"), "deps")
        drop(d)
        if level == 0:
            drop(left)
        d, left, level = rest, state.where("w").select("id"), level + 1
    rest = left.select("id", F.lit(None).cast("int").alias("level"))
    return rest if done is None else done.unionByName(rest)


def topological_order(n: DataFrame, e: DataFrame, max_nodes: int = 100_000) -> DataFrame:
    """(position, id): Kahn's order with the smallest ready id first, cyclic remainder by id, of any number of nodes.

    The place of a node in that order is a key, an array of ranks by id: of the key of each dependency
    the ranks above its own, the greatest of these, then its own rank. A round gives the keys of
    one level of the nodes, as topological_levels peels them, and writes what is left, so there are as
    many rounds as levels until at most max_nodes nodes are left. One task orders these by a
    heap; there, nodes below one another share the key of the first, and sub tells them apart.
    Null ids are no nodes.
    """
    import heapq

    import pandas as pd

    m = n.where(F.col("kind").isin(*CLUSTERABLE) & F.col("id").isNotNull()).select("id").distinct()
    ids = scratch(numbered(m, ["id"], "r"), "ranks")
    rank = lambda x, y: ids.select(F.col("id").alias(x), F.col("r").alias(y))
    d = e.where("kind in ('contains', 'calls', 'inherits') and source_id <> target_id").select("source_id", "target_id").distinct()
    d = scratch(d.join(rank("source_id", "s"), "source_id").join(rank("target_id", "t"), "target_id").select("s", "t"), "deps")
    none = F.array().cast("array<long>")
    left, state, done, size = ids.select("r", F.lit(None).cast("array<long>").alias("best")), None, [], ids.count()
    while size > max_nodes:
        waiting = d.select(F.col("s").alias("r")).distinct().withColumn("w", F.lit(True))
        before, state = state, scratch(left.join(waiting, "r", "left"), "state")
        left = state.select("r", "best")
        if before is not None:
            drop(before)
        ready = scratch(state.where("w is null").select("r", F.concat(F.coalesce("best", none), F.array("r")).alias("key")), "ready")
        gone = ready.count()
        if not gone:
            break
        done.append(ready.select("r", "key", F.lit(0).alias("sub")))
        met = scratch(lookup(d, ready.withColumnRenamed("r", "t"), "t", d.count()).select("s", "t", "key"), "deps")
        drop(d)
        gain = met.where("key is not null").groupBy(F.col("s").alias("r")).agg(F.max(F.filter("key", lambda x: x > F.col("s"))).alias("gain"))
        left = state.where("w").select("r", "best").join(gain, "r", "left").select("r", F.greatest("best", "gain").alias("best"))
        d, size = met.where("key is null").select("s", "t"), size - gone
    if size > max_nodes:  # all on or above a cycle
        done.append(left.select("r", F.lit(None).cast("array<long>").alias("key"), F.lit(0).alias("sub")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        waits: dict[int, int] = {}
        users: dict[int, list[int]] = {}
        key: dict[int, tuple[int, ...]] = {}
        for s, t, best in zip(pdf["s"].tolist(), pdf["t"].tolist(), pdf["best"], strict=True):
            waits.setdefault(s, 0)
            if t < 0:
                key[s] = (*(() if best is None else best.tolist()), s)
            else:
                waits[s] += 1
                users.setdefault(t, []).append(s)
        ready = [(key[i], i) for i, w in waits.items() if not w]
        heapq.heapify(ready)
        out = []
        while ready:
            k, i = heapq.heappop(ready)
            out.append((i, k, len(out)))
            for u in users.get(i, ()):
                key[u] = max(key[u], k if k[-1] > u else (*(x for x in k if x > u), u))
                waits[u] -= 1
                if not waits[u]:
                    heapq.heappush(ready, (key[u], u))
        out += [(i, None, 0) for i, w in waits.items() if w]
        return pd.DataFrame(out, columns=["r", "key", "sub"])

    if size <= max_nodes:
        rows = left.select(F.col("r").alias("s"), F.lit(-1).cast("long").alias("t"), "best").unionByName(d.select("s", "t", F.lit(None).cast("array<long>").alias("best")))
        done.append(rows.groupBy(F.lit(1).alias("k")).applyInPandas(run, "r long, key array<long>, sub int"))
    out = reduce(DataFrame.unionByName, done).select("r", F.col("key").isNull().alias("late"), F.coalesce("key", none).alias("key"), "sub")
    return numbered(out.join(ids, "r"), ["late", "key", "sub", "r"], "position").select(F.col("position").cast("int").alias("position"), "id")


def incident_summary(n: DataFrame, e: DataFrame, relations: int = 20) -> DataFrame:
    """(id, degree, extracted, inferred, ambiguous, callers, callees): per-node edge counts, and the first neighbours by id.

    The lists hold the smallest `relations` ids, which are the feature; they are
    ranked before they are collected, so no hub's neighbours meet in one list.
    """
    m = n.where(F.col("kind").isin(*CLUSTERABLE)).select("id").distinct()
    both = e.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.lit("out").alias("dir"), "kind", "confidence").unionByName(e.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), F.lit("in").alias("dir"), "kind", "confidence"))
    c = both.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), *(F.count_if(F.col("confidence") == x).alias(x.lower()) for x in ("EXTRACTED", "INFERRED", "AMBIGUOUS")))
    near = both.where("kind in ('calls', 'contains', 'inherits')").select("id", "dir", "other").distinct()
    w = Window.partitionBy("id", "dir").orderBy("other")
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= relations)
    lists = near.groupBy("id").agg(*(F.array_join(F.array_sort(F.collect_list(F.when(F.col("dir") == d, F.col("other")))), ", ").alias(a) for d, a in (("in", "callers"), ("out", "callees"))))
    z = F.lit(0)
    return m.join(c, "id", "left").join(lists, "id", "left").select("id", *(F.coalesce(x, z).alias(x) for x in ("degree", "extracted", "inferred", "ambiguous")), F.coalesce("callers", F.lit("")).alias("callers"), F.coalesce("callees", F.lit("")).alias("callees"))


def file_context(n: DataFrame, e: DataFrame, communities: DataFrame, top: int = 8) -> DataFrame:
    """(file_path, rank, id, label, in_degree, out_degree): each file's symbols by callers, with their community."""
    d = in_out_degrees(n, e)
    c = communities.select(F.col("id").alias("community_id"), "label").distinct()
    s = n.where(F.col("kind").isin(*CLUSTERABLE) & F.col("file_path").isNotNull()).select("id", "file_path", "community_id").join(d, "id").join(c, "community_id", "left")
    w = Window.partitionBy("file_path").orderBy(F.desc("in_degree"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("file_path", "rank", "id", "label", "in_degree", "out_degree")


def with_text(result: DataFrame, nodes: DataFrame) -> DataFrame:
    """Join the heavy text back to a small result, last."""
    return lookup(result, nodes.select("id", "snippet").dropDuplicates(["id"]), "id", 1 << 30)


def impact_bundle(n: DataFrame, e: DataFrame, communities: DataFrame, targets: DataFrame, top: int = 5) -> DataFrame:
    """(part, json): the impact of targets (id), the top hubs, questions and import cycles, and the graph's statistics.

    Every part is there; one without rows has an empty list. Lists are bounded by top.
    """
    parts = {
        "impact": impact_risk(n, e, communities, targets),
        "hubs": hub_nodes(n, e, top),
        "questions": review_questions(n, e, communities).limit(top),
        "cycles": import_cycles(e).orderBy("length", "cycle").limit(top),
        "stats": graph_stats(n, e, communities),
    }
    as_json = lambda name, d: d.agg(F.to_json(F.coalesce(F.collect_list(F.to_json(F.struct(*d.columns))), F.array().cast("array<string>"))).alias("json")).select(F.lit(name).alias("part"), "json")
    return reduce(DataFrame.unionByName, (as_json(k, d) for k, d in parts.items()))
