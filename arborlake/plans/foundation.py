"""Queries of the two general training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborlake.core import table
from arborlake.operators import hierarchy as H
from arborlake.operators import treeagg as A


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nodes").select("id", "parent_id", "kind")


QUERIES = {
    "p1_found": lambda s, d: H.cyclic_nodes(_nodes(s, d)),
    "p1_hierarchy": lambda s, d: H.hierarchy(_nodes(s, d)),
    "p1_descendants": lambda s, d: H.descendants(_nodes(s, d)),
    "p6_found": lambda s, d: A.heavy_keys(table(s, d, "edges")),
    "p6_key_stats": lambda s, d: A.edge_key_stats(table(s, d, "edges")),
}

_WALK = """
WITH RECURSIVE n AS (SELECT id, min(nullif(parent_id, '')) AS p FROM nodes WHERE id IS NOT NULL GROUP BY id),
up AS (SELECT id, id AS anc, 0 AS d FROM n
       UNION ALL SELECT up.id, n.p, up.d + 1 FROM up JOIN n ON n.id = up.anc JOIN n AS q ON q.id = n.p WHERE up.d < 400),
"""

SQL = {
    "p1_found": _WALK
    + """ring AS (SELECT id, anc FROM up WHERE d > 200)
SELECT id, min(anc) AS cycle_min_id FROM ring GROUP BY id""",
    "p1_descendants": _WALK
    + """bad AS (SELECT DISTINCT id FROM up WHERE d > 200)
SELECT anc AS ancestor_id, id AS descendant_id, CAST(d AS BIGINT) AS distance FROM up WHERE d > 0 AND id NOT IN (SELECT id FROM bad)""",
    "p1_hierarchy": _WALK
    + """bad AS (SELECT id, min(anc) AS c FROM up WHERE d > 200 GROUP BY id),
good AS (SELECT * FROM up WHERE id NOT IN (SELECT id FROM bad)),
t AS (SELECT id, max(d) AS depth, arg_max(anc, d) AS root, string_agg(anc, ' > ' ORDER BY d DESC) AS path FROM good GROUP BY id),
b AS (SELECT anc AS id, count(*) AS c FROM good WHERE d > 0 GROUP BY anc)
SELECT n.id, t.root, CAST(t.depth AS BIGINT) AS depth, t.path, coalesce(b.c, 0) AS n_descendants, bad.c AS cycle_min_id
FROM n LEFT JOIN t ON t.id = n.id LEFT JOIN b ON b.id = n.id LEFT JOIN bad ON bad.id = n.id""",
    "p6_found": """WITH e AS (SELECT DISTINCT id, kind, source_id, target_id FROM edges)
SELECT kind, target_id FROM e GROUP BY kind, target_id HAVING count(*) >= 0.015 * (SELECT count(*) FROM e)""",
    "p6_key_stats": """WITH e AS (SELECT id, kind, source_id, target_id, max(resolved) AS r, max(confidence_score) AS s FROM edges GROUP BY ALL)
SELECT kind, target_id, count(*) AS n_edges, count(DISTINCT source_id) AS n_callers, sum(r)::BIGINT AS n_resolved, max(s) AS max_score
FROM e GROUP BY kind, target_id""",
}
