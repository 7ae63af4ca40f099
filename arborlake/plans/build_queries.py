"""Graph assembly and report queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.core import table
from arborlake.operators import build as B
from arborlake.operators import concepts as C
from arborlake.operators import graph as G
from arborlake.operators import reports as P
from arborlake.operators import resolve as R
from arborlake.operators import textstate as T
from arborlake.plans.graph_queries import _V, _g, _with
from arborlake.plans.search_queries import _BEST, _CALLS, _IMP, _PAY, _SYM
from arborlake.plans.text_queries import _LS, _lines


def _files(s, d):
    return table(s, d, "discovered_files")


def _payloads(s, d):
    return R.newest_payloads(table(s, d, "extract_cache"))


def _assembled(s, d):
    return B.assemble_graph(_files(s, d), _payloads(s, d))


def _concepts(s, d):
    t = table(s, d, "documents").where("text is not null and text <> ''")
    return C.parse_concepts(t.select(F.to_json(F.struct(F.concat(F.lit("mem-"), "doc_id").alias("id"), F.col("doc_kind").alias("kind"), F.substring("text", 1, 40).alias("title"), F.when(F.col("doc_kind") == "concept", "stable").otherwise("odd").alias("status"), F.array("source").alias("tags"))).alias("payload")))


QUERIES = {
    "folder_nodes": lambda s, d: B.folder_nodes(_files(s, d)),
    "file_nodes": lambda s, d: B.file_nodes(_files(s, d)),
    "definition_nodes": lambda s, d: B.definition_nodes(_payloads(s, d)),
    "assembled_nodes": lambda s, d: _assembled(s, d)[0],
    "assembled_graph": lambda s, d: _assembled(s, d)[1],
    "stored_containment": lambda s, d: B.containment(_g(s, d)[0].select("id", F.nullif("parent_id", F.lit("")).alias("parent_id"))),
    "context_carry": lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", F.split("text", "\r?\n").alias("ls")).select("doc_id", F.posexplode(F.transform("ls", lambda x, i: F.concat(F.when(i > 0, F.regexp_extract(F.get("ls", i - 1), r"(?s)(.{0,60})$", 1)).otherwise(F.lit("")), F.lit(" | "), x))).alias("i", "context")),
    "claim_counts": lambda s, d: _lines(s, d).select("doc_id", F.size(C.claims(F.col("line"))).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("claims")),
    "page_links": lambda s, d: table(s, d, "documents").where("doc_path is not null").select("doc_id", C.page_links(F.concat(F.lit("[p]("), "doc_path", F.lit(")"))).alias("link")),
    "parsed_concepts": lambda s, d: _concepts(s, d).select("id", "kind", "status", "confidence", F.size("tags").alias("tags"), F.size("relations").alias("relations")),
    "concept_index": lambda s, d: C.index_lines(_concepts(s, d)),
    "glob_matches": lambda s, d: _files(s, d).select("rel_path").distinct().where(C.applies_to(["**/vendor/*/", "*.kt", "tests/*"], F.col("rel_path"))),
    "transcript_window": lambda s, d: C.transcript_slice(_lines(s, d).select(F.col("doc_id").alias("file"), F.col("i").alias("ord"), F.col("i").alias("offset"), F.col("line").alias("text")), 1, 80, 400),
    "confidence_report": lambda s, d: C.confidence_report(G.confidence_counts(_g(s, d)[1])),
    "community_articles": lambda s, d: C.community_articles(_g(s, d)[0].where("community_id is not null").select("community_id", "id").distinct()),
    "skill_usage": lambda s, d: C.usage(table(s, d, "events").select(F.concat_ws("/", F.lit("home/skills"), F.col("user_id").cast("string"), F.when(F.col("event_type") == "click", "SKILL.md").otherwise(F.concat("event_type", F.lit(".md")))).alias("path"))),
    "readme_summary": lambda s, d: table(s, d, "documents").where("doc_kind = 'concept' and text is not null").select("doc_id", C.readme_summary(F.col("text")).alias("r")).select("doc_id", "r.title", F.size("r.commands").alias("commands")),
}
SQL = {
    "folder_nodes": """SELECT DISTINCT 'dir:' || folder AS id, 'directory' AS kind, string_split(folder, '/')[-1] AS name, CASE WHEN contains(folder, '/') THEN 'dir:' || regexp_replace(folder, '/[^/]*$', '') END AS parent_id FROM (
 SELECT array_to_string(p[:k], '/') AS folder FROM (SELECT p, unnest(range(1, len(p))) AS k FROM (SELECT string_split(rel_path, '/') AS p FROM discovered_files)))""",
    "file_nodes": "SELECT DISTINCT 'file:' || rel_path AS id, 'file' AS kind, string_split(rel_path, '/')[-1] AS name, CASE WHEN contains(rel_path, '/') THEN 'dir:' || regexp_replace(rel_path, '/[^/]*$', '') END AS parent_id FROM discovered_files",
    "stored_containment": _with(_V) + "SELECT parent_id AS source_id, id AS target_id, 'contains' AS kind FROM n WHERE parent_id <> '' AND parent_id IN (SELECT id FROM n)",
    "context_carry": "WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS ls FROM documents WHERE text IS NOT NULL)) SELECT doc_id, i, coalesce(right(lag(line) OVER (PARTITION BY doc_id ORDER BY i), 60), '') || ' | ' || line AS context FROM l",
    "page_links": "SELECT doc_id, '[p](' || regexp_replace(doc_path, '\\.md$', '.html') || ')' AS link FROM documents WHERE doc_path IS NOT NULL",
    "parsed_concepts": "SELECT 'mem-' || doc_id AS id, 'fact' AS kind, CASE WHEN doc_kind = 'concept' THEN 'stable' ELSE 'draft' END AS status, 'unverified' AS confidence, 1 AS tags, 0 AS relations FROM documents WHERE text IS NOT NULL AND text <> ''",
    "glob_matches": "SELECT DISTINCT rel_path FROM discovered_files WHERE regexp_matches(rel_path, '^(?:.*/)?vendor/[^/]*(?:/|$)') OR regexp_matches(rel_path, '(?:^|/)[^/]*\\.kt(?:/|$)') OR regexp_matches(rel_path, '^tests/[^/]*(?:/|$)')",
    "transcript_window": f"WITH {_LS} SELECT file, ord, text FROM (SELECT doc_id AS file, i AS ord, left(line, 80) AS text, sum(length(left(line, 80))) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM l WHERE i >= 1) WHERE used - length(text) < 400",
    "confidence_report": _with(_V) + "SELECT confidence, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM e), 0)::INT AS percent FROM e GROUP BY 1",
    "community_articles": _with(_V) + """SELECT community_id, string_agg(id, ', ' ORDER BY id) FILTER (r <= 25) AS listed, greatest(0, count(*) - 25) AS more FROM (SELECT community_id, id, row_number() OVER (PARTITION BY community_id ORDER BY id) AS r FROM (SELECT DISTINCT community_id, id FROM n WHERE community_id IS NOT NULL)) GROUP BY 1""",
    "skill_usage": "SELECT user_id::VARCHAR AS skill, count(*) FILTER (event_type = 'click') AS uses, count(*) FILTER (event_type <> 'click') AS views FROM events GROUP BY 1",
    "readme_summary": "SELECT doc_id, nullif(regexp_extract(text, '(?m)^#\\s+(.+)$', 1), '') AS title, 0 AS commands FROM documents WHERE doc_kind = 'concept' AND text IS NOT NULL",
}


def _pages(s):
    rows = [("a", "@b\n@c\n"), ("b", "@c\nx\n@a\n"), ("c", "end"), ("d", "@nope\n"), ("e", "no refs")]
    return s.createDataFrame(rows, "path string, text string")


QUERIES |= {
    "fenced_lines": lambda s, d: T.fenced(_lines(s, d).withColumn("line", F.when(F.col("i") % 7 == 3, "```").otherwise(F.col("line")))).groupBy("doc_id").agg(F.count_if("fence").alias("marks"), F.count_if("inside").alias("inside")),
    "receipt_runs": lambda s, d: T.receipt_runs(table(s, d, "nodes").where("snippet is not null").select(F.col("id").alias("doc_id"), "snippet").distinct().select("doc_id", F.posexplode(F.split("snippet", "\n")).alias("i", "line"))).select("doc_id", "first", "last", F.size("values").alias("values")),
    "import_expansion": lambda s, d: T.expand_imports(_pages(s)),
    "signature_views": lambda s, d: table(s, d, "nodes").where("kind in ('function', 'method')").select("id", T.signature_view(F.col("snippet"), F.col("signature")).alias("view")).distinct(),
    "blanked_comments": lambda s, d: T.apply_text(table(s, d, "discovered_files").where("content is not null").select("rel_path", "content").distinct(), T.blank_comments, "content"),
    "budgeted_read": lambda s, d: T.budgeted_read(table(s, d, "discovered_files"), 800),
}
SQL |= {
    "fenced_lines": f"WITH {_LS}, f AS (SELECT doc_id, i, CASE WHEN i % 7 = 3 THEN '```' ELSE line END AS line FROM l), g AS (SELECT doc_id, i, regexp_matches(line, '^\\s*(?:```|~~~)') AS fence FROM f), h AS (SELECT doc_id, fence, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS odd FROM g) SELECT doc_id, count(*) FILTER (fence) AS marks, count(*) FILTER (NOT fence AND odd) AS inside FROM h GROUP BY 1",
    "import_expansion": "SELECT * FROM (VALUES ('a', 1, 'b', 'ok'), ('a', 2, 'c', 'ok'), ('a', 3, 'a', 'cycle'), ('a', 4, 'c', 'ok'), ('b', 1, 'c', 'ok'), ('b', 2, 'a', 'ok'), ('b', 3, 'b', 'cycle'), ('b', 4, 'c', 'ok'), ('d', 1, 'nope', 'missing')) v(root, ord, path, state)",
}

QUERIES |= {
    "project_facts": lambda s, d: P.project_facts(table(s, d, "discovered_files")),
    "status_claims": lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", F.length(P.unquoted(F.col("text"))).alias("n"), P.claims_status(F.concat(F.lit("Status: "), F.col("doc_kind"), F.lit("\n"), F.col("text")), "concept").alias("claims")),
}
_LN = "CASE lower(regexp_extract(rel_path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.LANGUAGES.items()) + " END"
SQL |= {
    "project_facts": f"""SELECT repo, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, bool_or(regexp_matches(rel_path, '/tests?/')) AS has_tests, bool_or(base = 'Makefile') AS has_make,
 bool_or(base IN ('main.go', 'cli.py', '__main__.py', 'main.rs') OR coalesce(regexp_matches(content, '\\[project\\.scripts\\]|"bin"\\s*:'), false)) AS is_cli
FROM (SELECT DISTINCT rel_path, content, split_part(rel_path, '/', 1) AS repo, string_split(rel_path, '/')[-1] AS base, {_LN} AS lang FROM discovered_files) GROUP BY 1""",
}

# no payload of the tables has base classes, so the SQL has no inherits part
_LINKS = f"""bc AS ({_BEST("call_id", R.TIERS)}),
lk AS (SELECT 'file:' || file_path AS source_id, coalesce('file:' || target, 'external:' || path_text) AS target_id, 'imports' AS kind, (target IS NOT NULL)::INT AS resolved, CASE WHEN target IS NULL THEN 'AMBIGUOUS' ELSE 'EXTRACTED' END AS confidence, CASE WHEN target IS NULL THEN 20 ELSE 100 END AS score FROM ri
 UNION ALL SELECT source_id, target, 'calls', resolved::INT, confidence, score FROM bc JOIN k USING (call_id)),
al AS ({SQL["folder_nodes"]} UNION ALL {SQL["file_nodes"]} UNION ALL SELECT id, kind, name, parent_id FROM sy
 UNION ALL SELECT DISTINCT target_id, 'external', string_split(regexp_replace(target_id, '^external:', ''), '.')[-1], NULL FROM lk WHERE target_id LIKE 'external:%'),
an2 AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY id ORDER BY kind, name, parent_id NULLS FIRST) = 1)"""
SQL |= {
    "assembled_nodes": _with(_PAY, _SYM, _IMP, _CALLS, _LINKS) + "SELECT * FROM an2",
    "assembled_graph": _with(_PAY, _SYM, _IMP, _CALLS, _LINKS) + "SELECT parent_id AS source_id, id AS target_id, 'contains' AS kind, 1 AS resolved, 'EXTRACTED' AS confidence, 100 AS score FROM an2 WHERE parent_id IN (SELECT id FROM an2) UNION ALL SELECT * FROM lk",
}
