"""Graph queries over the node, edge and community tables, with their SQL."""

from __future__ import annotations

from arborlake.core import scratch, table
from arborlake.operators import graph as G
from arborlake.operators.components import connected_components

_NOISE = ", ".join(f"'{x}'" for x in G.NOISE_LABELS)
_V = """n AS (SELECT DISTINCT id, kind, name, qualified_name, file_path, language, start_line, end_line, parent_id, external, community_id FROM nodes),
e AS (SELECT DISTINCT id, source_id, target_id, kind, resolved, coalesce(upper(confidence), 'EXTRACTED') AS confidence FROM edges),
c AS (SELECT DISTINCT * FROM communities)"""
_DEG = """d AS (SELECT node_id, count(*) AS degree FROM (SELECT source_id AS node_id FROM e WHERE resolved = 1 AND kind IN ('calls', 'inherits')
 UNION ALL SELECT target_id FROM e WHERE resolved = 1 AND kind IN ('calls', 'inherits')) GROUP BY 1),
t AS (SELECT greatest(50, max(degree)) AS threshold, max(degree) AS p99 FROM (SELECT degree, row_number() OVER (ORDER BY degree) AS r, count(*) OVER () AS k FROM d) WHERE r = floor(k * 99 / 100) + 1),
h AS (SELECT node_id, degree FROM d, t WHERE degree > threshold)"""
_MEM = """m AS (SELECT e.source_id, e.target_id, a.community_id AS s_c, b.community_id AS t_c FROM e JOIN n a ON a.id = e.source_id JOIN n b ON b.id = e.target_id
 WHERE e.kind IN ('calls', 'inherits') AND a.kind IN ('class', 'function', 'method') AND b.kind IN ('class', 'function', 'method'))"""
_IO = """io AS (SELECT n.id, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree FROM n
 LEFT JOIN (SELECT target_id, count(*) AS k FROM e GROUP BY 1) i ON i.target_id = n.id LEFT JOIN (SELECT source_id, count(*) AS k FROM e GROUP BY 1) o ON o.source_id = n.id)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def _g(s, d):
    return G.node_view(table(s, d, "nodes")), G.edge_view(table(s, d, "edges"))


def _c(s, d):
    return table(s, d, "communities")


def _seeds(n):
    """Every method is a seed."""
    return n.where("kind = 'method'").select("id")


def _calls(e):
    return e.where("resolved = 1 and kind in ('calls', 'inherits', 'imports')")


def _components(s, d):
    n, e = _g(s, d)
    return connected_components(G.member_edges(n, e), "source_id", "target_id")


def _impact(s, d):
    n, e = _g(s, d)
    return G.impact(n, scratch(e, "e"), _seeds(n))


def _path(s, d):
    _, e = _g(s, d)
    e = scratch(e, "e")
    ends = _calls(e).where("source_id like 'function:%' and target_id like 'function:%'").selectExpr("min(source_id) as a").first()
    far = G.bfs(_calls(e), s.createDataFrame([(ends[0],)], "id string"), 4).groupBy("hop").agg({"id": "min"}).orderBy("hop", ascending=False).first() if ends[0] else None
    return G.shortest_path(e, ends[0] or "", far[1] if far else "")


QUERIES = {
    "hub_nodes": lambda s, d: G.hub_nodes(*_g(s, d)),
    "degree_map": lambda s, d: G.degrees(_g(s, d)[1]),
    "in_out_degree": lambda s, d: G.in_out_degrees(*_g(s, d)),
    "hub_threshold": lambda s, d: G.hub_threshold(_g(s, d)[1]),
    "super_hubs": lambda s, d: G.super_hubs(_g(s, d)[1]),
    "god_flags": lambda s, d: G.god_flags(_g(s, d)[1]),
    "confidence_breakdown": lambda s, d: G.confidence_counts(_g(s, d)[1]),
    "confidence_pivot": lambda s, d: G.confidence_by_kind(_g(s, d)[1]),
    "surprise_edges": lambda s, d: G.surprise(*_g(s, d)),
    "review_questions": lambda s, d: G.review_questions(*_g(s, d), _c(s, d)),
    "graph_stats": lambda s, d: G.graph_stats(*_g(s, d), _c(s, d)),
    "community_metrics": lambda s, d: G.community_metrics(*_g(s, d)),
    "community_hub": lambda s, d: G.community_hubs(*_g(s, d)),
    "community_top_files": lambda s, d: G.community_top_files(_g(s, d)[0]),
    "community_renumber": lambda s, d: G.renumbered_communities(_g(s, d)[0]),
    "hub_reattach": lambda s, d: G.reattach_hubs(*_g(s, d), G.god_flags(_g(s, d)[1])),
    "connected_components": _components,
    "detect_communities": lambda s, d: G.detect_communities(*_g(s, d)),
    "reach_hops": lambda s, d: G.bfs(_calls(_g(s, d)[1]), _seeds(_g(s, d)[0]), 3).select("id", "hop"),
    "shortest_path": _path,
    "symbol_disambiguation": lambda s, d: G.resolve_symbols(_g(s, d)[0], s.createDataFrame([("emit",), ("external:logkit.emit",), ("Lantern",), ("nothing at all",)], "query string")),
    "impact_radius": _impact,
    "impact_risk": lambda s, d: G.impact_risk(*_g(s, d), _c(s, d), _seeds(_g(s, d)[0])),
    "crossed_bridges": lambda s, d: G.crossed_bridges(_g(s, d)[0], _impact(s, d)),
    "import_cycles_k": lambda s, d: G.import_cycles(_g(s, d)[1]),
    "topo_levels": lambda s, d: G.topological_levels(*_g(s, d)),
    "topo_order": lambda s, d: G.topological_order(*_g(s, d)),
    "plan_incident": lambda s, d: G.incident_summary(*_g(s, d)),
    "file_context": lambda s, d: G.file_context(*_g(s, d), _c(s, d)),
}


def _listing(s, d):
    from pyspark.sql import functions as F

    c = _c(s, d).distinct()
    m = _g(s, d)[0].where("community_id is not null").groupBy("community_id").agg(F.count(F.lit(1)).alias("members"))
    return c.join(m, c.id == m.community_id, "left").select("id", "label", "node_count", "hub_node_id", F.coalesce("members", F.lit(0)).alias("members"))


QUERIES["community_listing"] = _listing

SQL = {
    "hub_nodes": _with(_V) + f"""SELECT * FROM (SELECT * FROM (SELECT n.id, n.name, n.kind, n.file_path, n.community_id, d.degree FROM n JOIN (
 SELECT node_id, count(*) AS degree FROM (SELECT source_id AS node_id FROM e WHERE kind IN ('calls','inherits','imports') AND resolved = 1
 UNION ALL SELECT target_id FROM e WHERE kind IN ('calls','inherits','imports') AND resolved = 1) GROUP BY 1) d ON d.node_id = n.id
 WHERE n.external = 0 AND n.kind IN ('class','function','method') ORDER BY degree DESC, id LIMIT 20) WHERE name NOT IN ({_NOISE}) ORDER BY degree DESC, id LIMIT 10)""",
    "degree_map": _with(_V, _DEG) + "SELECT * FROM d",
    "in_out_degree": _with(_V, _IO) + "SELECT id, in_degree, out_degree, in_degree + out_degree AS edge_count FROM io",
    "hub_threshold": _with(_V, _DEG) + "SELECT (SELECT count(*) FROM d) AS nodes, p99, threshold FROM t",
    "super_hubs": _with(_V, _DEG) + "SELECT * FROM h",
    "god_flags": _with(_V) + """, d AS (SELECT node_id, count(*) AS degree FROM (SELECT source_id AS node_id FROM e UNION ALL SELECT target_id FROM e) GROUP BY 1)
SELECT * FROM d WHERE degree >= greatest(20, (SELECT degree FROM (SELECT degree, row_number() OVER (ORDER BY degree DESC) AS r, count(*) OVER () AS k FROM d) WHERE r = k // 20 + 1))""",
    "confidence_breakdown": _with(_V) + "SELECT confidence, count(*) AS n FROM e GROUP BY 1",
    "confidence_pivot": _with(_V) + "SELECT kind, count(*) FILTER (confidence = 'EXTRACTED') AS extracted, count(*) FILTER (confidence = 'INFERRED') AS inferred, count(*) FILTER (confidence = 'AMBIGUOUS') AS ambiguous FROM e GROUP BY 1",
    "surprise_edges": _with(_V) + """SELECT * FROM (SELECT e.id, source_id, target_id, e.kind, confidence,
 CASE WHEN a.community_id <> b.community_id THEN 40 ELSE 0 END + CASE WHEN nullif(split_part(a.file_path, '/', 1), '') <> nullif(split_part(b.file_path, '/', 1), '') THEN 25 ELSE 0 END
 + CASE confidence WHEN 'AMBIGUOUS' THEN 25 WHEN 'INFERRED' THEN 15 ELSE 0 END AS score FROM e JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id) WHERE score > 30""",
    "review_questions": _with(_V) + f"""SELECT 'low_cohesion' AS category, printf('Community %s (%s)', id::VARCHAR, label) AS target, printf('Community ''%s'' (%s nodes) is loose. Split it?', label, node_count::VARCHAR) AS question
 FROM (SELECT * FROM c WHERE cohesion < 0.15 AND node_count >= 5 ORDER BY cohesion, id LIMIT 2)
UNION ALL SELECT 'ambiguous_edge', printf('%s -> %s', source_id, target_id), printf('Is the %s edge intended?', kind) FROM (SELECT * FROM e WHERE confidence = 'AMBIGUOUS' ORDER BY id LIMIT 2)
UNION ALL SELECT 'bridge_node', id, printf('Symbol ''%s'' has degree %s. Refactor?', name, degree::VARCHAR) FROM (SELECT * FROM (SELECT n.id, n.name, d.degree FROM n JOIN (
 SELECT node_id, count(*) AS degree FROM (SELECT source_id AS node_id FROM e WHERE kind IN ('calls','inherits','imports') AND resolved = 1
 UNION ALL SELECT target_id FROM e WHERE kind IN ('calls','inherits','imports') AND resolved = 1) GROUP BY 1) d ON d.node_id = n.id
 WHERE n.external = 0 AND n.kind IN ('class','function','method') ORDER BY degree DESC, id LIMIT 4) WHERE name NOT IN ({_NOISE}) ORDER BY degree DESC, id LIMIT 2)""",
    "graph_stats": _with(_V) + """SELECT 'nodes' AS metric, count(*) AS value FROM n UNION ALL SELECT 'nodes.' || kind, count(*) FROM n GROUP BY kind UNION ALL SELECT 'edges', count(*) FROM e
UNION ALL SELECT 'edges.' || kind, count(*) FROM e GROUP BY kind UNION ALL SELECT 'edges.resolved', count(*) FILTER (resolved = 1) FROM e UNION ALL SELECT 'communities', count(*) FROM c""",
    "community_metrics": _with(_V, _MEM) + """SELECT s.community_id, s.node_count, coalesce(i.k, 0) AS internal_edges,
 CASE WHEN s.node_count <= 1 THEN 10000 ELSE least(10000, floor(coalesce(i.k, 0) * 10000 / (s.node_count * (s.node_count - 1))))::BIGINT END AS cohesion_bp
FROM (SELECT community_id, count(*) AS node_count FROM n WHERE kind IN ('class','function','method') AND community_id IS NOT NULL GROUP BY 1) s
LEFT JOIN (SELECT s_c, count(*) AS k FROM m WHERE s_c = t_c GROUP BY 1) i ON i.s_c = s.community_id""",
    "community_hub": _with(_V, _MEM) + """, d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM m UNION ALL SELECT target_id FROM m) GROUP BY 1),
r AS (SELECT n.*, coalesce(d.degree, 0) AS degree, row_number() OVER (PARTITION BY community_id ORDER BY coalesce(d.degree, 0) DESC, n.id) AS r FROM n LEFT JOIN d ON d.id = n.id WHERE kind IN ('class','function','method') AND community_id IS NOT NULL)
SELECT community_id, id AS hub_id, degree, concat_ws('/', CASE WHEN len(string_split(file_path, '/')) > 1 THEN string_split(file_path, '/')[-2] ELSE 'root' END, name) AS label FROM r WHERE r = 1""",
    "community_top_files": _with(_V) + """SELECT * FROM (SELECT community_id, row_number() OVER (PARTITION BY community_id ORDER BY members DESC, file_path) AS rank, file_path, members FROM (
 SELECT community_id, file_path, count(*) AS members FROM n WHERE kind IN ('class','function','method') AND community_id IS NOT NULL AND file_path IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 5""",
    "community_renumber": _with(_V) + "SELECT community_id, row_number() OVER (ORDER BY k DESC, f) AS new_id FROM (SELECT community_id, count(*) AS k, min(id) AS f FROM n WHERE kind IN ('class','function','method') AND community_id IS NOT NULL GROUP BY 1)",
    "hub_reattach": _with(_V, _MEM) + """, d AS (SELECT node_id, count(*) AS degree FROM (SELECT source_id AS node_id FROM e UNION ALL SELECT target_id FROM e) GROUP BY 1),
g AS (SELECT node_id FROM d WHERE degree >= greatest(20, (SELECT degree FROM (SELECT degree, row_number() OVER (ORDER BY degree DESC) AS r, count(*) OVER () AS k FROM d) WHERE r = k // 20 + 1))),
v AS (SELECT id, c, count(*) AS v FROM (SELECT source_id AS id, t_c AS c FROM m UNION ALL SELECT target_id, s_c FROM m) WHERE c IS NOT NULL AND id IN (SELECT node_id FROM g) GROUP BY 1, 2)
SELECT id, c AS community_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, c) AS r FROM v) WHERE r = 1""",
    "community_listing": _with(_V) + "SELECT c.id, label, node_count, hub_node_id, coalesce(k, 0) AS members FROM c LEFT JOIN (SELECT community_id, count(*) AS k FROM n GROUP BY 1) x ON x.community_id = c.id",
    "reach_hops": _with(_V, """r AS (SELECT id, 0 AS hop FROM n WHERE kind = 'method' UNION SELECT e.target_id, r.hop + 1 FROM r JOIN e ON e.source_id = r.id WHERE e.resolved = 1 AND e.kind IN ('calls','inherits','imports') AND r.hop < 3)""", recursive=True) + "SELECT id, min(hop) AS hop FROM r WHERE id IS NOT NULL GROUP BY 1",
    "symbol_disambiguation": _with(_V) + """, q AS (SELECT unnest(['emit', 'external:logkit.emit', 'Lantern', 'nothing at all']) AS query),
x AS (SELECT DISTINCT query, n.id FROM n, q WHERE n.id = query OR name = query OR qualified_name = query)
SELECT query, id, 'exact' AS how FROM x UNION ALL SELECT query, id, 'like' FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY id) AS r FROM (
 SELECT DISTINCT query, n.id FROM n, q WHERE query NOT IN (SELECT query FROM x) AND (name ILIKE '%' || query || '%' OR qualified_name ILIKE '%' || query || '%'))) WHERE r <= 5""",
    "impact_radius": _with(_V, _DEG, """r AS (SELECT id, 0 AS hop FROM n WHERE kind = 'method' UNION SELECT e.source_id, r.hop + 1 FROM r JOIN e ON e.target_id = r.id WHERE e.resolved = 1 AND e.kind IN ('calls','inherits') AND r.hop < 3
 AND (r.hop = 0 OR r.id NOT IN (SELECT node_id FROM h)))""", recursive=True) + "SELECT id, min(hop) AS hop FROM r WHERE id IS NOT NULL GROUP BY 1",
    "import_cycles_k": _with(_V) + """, f AS (SELECT DISTINCT source_id AS s, target_id AS t FROM e WHERE kind = 'imports' AND resolved = 1 AND source_id LIKE 'file:%' AND target_id LIKE 'file:%' AND source_id <> target_id)
SELECT 2 AS length, concat_ws(' > ', a.s, a.t) AS cycle FROM f a JOIN f b ON b.s = a.t AND b.t = a.s WHERE a.s < a.t
UNION ALL SELECT 3, concat_ws(' > ', a.s, a.t, b.t) FROM f a JOIN f b ON b.s = a.t JOIN f c ON c.s = b.t AND c.t = a.s WHERE a.s < a.t AND a.s < b.t AND a.t <> b.t
UNION ALL SELECT 4, concat_ws(' > ', a.s, a.t, b.t, c.t) FROM f a JOIN f b ON b.s = a.t JOIN f c ON c.s = b.t JOIN f d ON d.s = c.t AND d.t = a.s WHERE a.s < a.t AND a.s < b.t AND a.s < c.t AND a.t <> b.t AND a.t <> c.t AND b.t <> c.t""",
    "plan_incident": _with(_V) + """, b AS (SELECT source_id AS id, target_id AS o, 'out' AS dir, kind, confidence FROM e UNION ALL SELECT target_id, source_id, 'in', kind, confidence FROM e),
k AS (SELECT id, count(*) AS degree, count(*) FILTER (confidence = 'EXTRACTED') AS extracted, count(*) FILTER (confidence = 'INFERRED') AS inferred, count(*) FILTER (confidence = 'AMBIGUOUS') AS ambiguous FROM b GROUP BY 1),
l AS (SELECT id, string_agg(o, ', ' ORDER BY o) FILTER (dir = 'in') AS callers, string_agg(o, ', ' ORDER BY o) FILTER (dir = 'out') AS callees FROM (
 SELECT id, dir, o, row_number() OVER (PARTITION BY id, dir ORDER BY o) AS r FROM (SELECT DISTINCT id, dir, o FROM b WHERE kind IN ('calls','contains','inherits'))) WHERE r <= 20 GROUP BY 1)
SELECT n.id, coalesce(degree, 0) AS degree, coalesce(extracted, 0) AS extracted, coalesce(inferred, 0) AS inferred, coalesce(ambiguous, 0) AS ambiguous, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees
FROM (SELECT DISTINCT id FROM n WHERE kind IN ('class','function','method')) n LEFT JOIN k ON k.id = n.id LEFT JOIN l ON l.id = n.id""",
    "file_context": _with(_V, _IO) + """SELECT * FROM (SELECT n.file_path, row_number() OVER (PARTITION BY n.file_path ORDER BY in_degree DESC, n.id) AS rank, n.id, c.label, in_degree, out_degree
 FROM n JOIN io ON io.id = n.id LEFT JOIN c ON c.id = n.community_id WHERE n.kind IN ('class','function','method') AND n.file_path IS NOT NULL) WHERE rank <= 8""",
}
