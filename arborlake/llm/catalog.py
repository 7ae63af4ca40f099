"""Queries of the text operators over the whole tables."""

from __future__ import annotations

from arborlake.core import table
from arborlake.llm import credentials, docpairs, leaks, neardup, origin, packing, sentences, syntax

QUERIES = {
    "p2_found": lambda s, d: origin.machine_files(table(s, d, "discovered_files")),
    "p2_origin": lambda s, d: origin.classify_origin(table(s, d, "discovered_files")),
    "p3_found": lambda s, d: credentials.credential_records(table(s, d, "nodes"), table(s, d, "extract_cache")),
    "p3_masked": lambda s, d: credentials.scan_records(table(s, d, "nodes"), table(s, d, "extract_cache")),
    "p4_found": lambda s, d: syntax.invalid_files(table(s, d, "discovered_files")),
    "p4_flags": lambda s, d: syntax.flag_invalid(table(s, d, "discovered_files")),
    "p4_rates": lambda s, d: syntax.invalid_rates(table(s, d, "discovered_files")),
    "p5_found": lambda s, d: neardup.near_duplicate_pairs(neardup.code_records(table(s, d, "nodes"))),
    "p5_groups": lambda s, d: neardup.near_duplicate_groups(neardup.code_records(table(s, d, "nodes"))),
    "p7_found": lambda s, d: docpairs.documented(table(s, d, "nodes")),
    "p7_pairs": lambda s, d: docpairs.documented_pairs(table(s, d, "nodes")),
    "p8_containers": lambda s, d: packing.fill_containers(table(s, d, "documents")),
    "p8_fill": lambda s, d: packing.container_fill(table(s, d, "documents")),
    "p9_found": lambda s, d: leaks.leaked(table(s, d, "eval_items"), table(s, d, "documents")),
    "p9_alignments": lambda s, d: leaks.leak_alignments(table(s, d, "eval_items"), table(s, d, "documents")),
    "p10_found": lambda s, d: sentences.prose_sentences(table(s, d, "documents")),
}

#: What SQL can say; the others are tested against brute force, round trips or fixtures in tests/llm.
SQL: dict[str, str] = {
    "p5_found": """
        WITH s AS (SELECT row_number() OVER () AS r, id, regexp_extract_all(lower(snippet), '[a-z0-9_]+') AS t
                   FROM (SELECT DISTINCT id, snippet FROM nodes WHERE kind IN ('function', 'method') AND id IS NOT NULL AND snippet IS NOT NULL)),
        g AS (SELECT DISTINCT r, id, t[k] || ' ' || t[k + 1] || ' ' || t[k + 2] AS run FROM (SELECT r, id, t, unnest(range(1, len(t) - 1)) AS k FROM s)),
        n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
        b AS (SELECT x.r AS rx, y.r AS ry, any_value(x.id) AS ix, any_value(y.id) AS iy, count(*) AS both_have FROM g x JOIN g y ON x.run = y.run AND x.id < y.id GROUP BY x.r, y.r)
        SELECT DISTINCT ix AS id_a, iy AS id_b FROM b JOIN n p ON p.r = rx JOIN n q ON q.r = ry WHERE 10 * both_have >= 6 * (p.n + q.n - both_have)""",
    "p9_found": """
        WITH t AS (SELECT 'i' AS side, item_id AS id, text FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL
                   UNION SELECT 'd', doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        low AS (SELECT side, id, regexp_replace(lower(regexp_replace(text, '[\u00ad\u200b-\u200f\u2060\ufeff]', '', 'g')), '</?[a-z!][^<>\n]{0,200}>|&(?:[a-z]{2,8}|#[0-9]{1,6});', ' ', 'g') AS x FROM t),
        one AS (SELECT row_number() OVER () AS r, side, id, regexp_extract_all(regexp_replace(x, '(\\p{L})[-\u2010\u2011]\\r?\\n[ \\t>/#*;%!-]*(\\p{L})', '\\1\\2', 'g'), '[\\p{L}\\p{N}]+') AS w FROM low),
        win AS (SELECT side, id, list_slice(w, k, k + 11) AS run FROM (SELECT side, id, w, unnest(range(1, len(w) - 10)) AS k FROM one WHERE len(w) >= 12))
        SELECT DISTINCT i.id AS item_id, d.id AS doc_id FROM win i JOIN win d ON i.run = d.run WHERE i.side = 'i' AND d.side = 'd'""",
}
