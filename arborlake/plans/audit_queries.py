"""Audit, register, naming, planning and sink queries, with their SQL. Markup and registers, which no table holds, are given inline."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.core import scratch, table
from arborlake.functions import scalars as S
from arborlake.operators import audit as A
from arborlake.operators import graph as G
from arborlake.operators import windows as W
from arborlake.plans.graph_queries import _V, _g, _with

_PAGES = [
    ("a.html", '<main id="m"><label for="q">Find</label><input id="q" placeholder="x"><input id="z" placeholder="only"><div onclick="go()">x</div><div role="button" tabindex="0" onclick="go()">y</div></main>'),
    ("b.html", '<!-- <div tabindex="9"> --><ul role="list"><li tabindex="3" aria-labelledby="nope m">a</li></ul><div role="tablist"><span role="presentation">t</span></div><video autoplay src="v"></video>'),
    ("c.html", '<nav role="navigation"><div role="listbox"><div role="option">o</div></div><img alt="image" src="s"></nav>'),
    ("d.html", ""),
]
_PALETTE = [(1, "ink", "#222222"), (2, "paper", "#ffffff"), (3, "mist", "#cccccc"), (4, "sea", "#0a7"), (5, "sun", "#ffcc00")]
_REGISTER = [(1, "clickable", "a.html", "2026-12-01"), (2, "positive-tabindex", "b.html", "2025-01-01"), (3, "clickable", "a.html", None), (4, "media-autoplay", "b.html", "2026-06-10")]
_CLAIMS = [("r1", 4, "42"), ("r1", 30, "42"), ("r1", 5, "7"), ("r2", 2, "9")]
_RUNS = [("r1", 5, 9, ["42", "43"]), ("r2", 40, 41, ["9"])]
_OLD = [("agents", "Setup", "old setup", 1), ("agents", "Notes", "mine", 2), ("agents", "Rules", "old rules", 3)]
_NEW = [("agents", "rules", "new rules", 1), ("agents", "Layout", "new layout", 2)]
TODAY = "2026-06-01"


def _rows(s, rows, schema):
    return s.createDataFrame(rows, schema)


def _values(rows, cols):
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(map(lit, v)) + "]"
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") v({cols}))"


def _tags(s):
    return A.tags(_rows(s, _PAGES, "doc string, html string"))


def _findings(s):
    t = _tags(s)
    return A.pattern_findings(t).unionByName(A.clickable_findings(t)).unionByName(A.redundant_roles(t))


def _register(s):
    return _rows(s, _REGISTER, "entry int, `check` string, doc string, expires string").withColumn("expires", F.col("expires").cast("date"))


def _concepts(s, d):
    """Documents seen as concepts: the first line is the title, the source and language are tags."""
    t = table(s, d, "documents").where("text is not null and text <> ''")
    title = F.regexp_replace(F.trim(F.split("text", "\n")[0]), "^#+ ", "")
    status = F.when(F.col("doc_kind") == "concept", "stable").when(F.col("doc_kind") == "log", "deprecated").otherwise("draft")
    return t.select("doc_id", F.substring(title, 1, 150).alias("title"), F.col("doc_kind").alias("kind"), status.alias("status"), F.array("source", F.coalesce("lang", F.lit("und"))).alias("tags"), "text", "source", "created_at")


_CON = """con AS (SELECT doc_id, left(regexp_replace(trim(string_split(text, chr(10))[1]), '^#+ ', ''), 150) AS title, doc_kind AS kind, CASE doc_kind WHEN 'concept' THEN 'stable' WHEN 'log' THEN 'deprecated' ELSE 'draft' END AS status,
 source, coalesce(lang, 'und') AS lang, text, created_at FROM documents WHERE text IS NOT NULL AND text <> '')"""


def _staleness(s, d):
    """Pages recorded for the newest cached file against the file now: stale if the hash differs or none was recorded."""
    n = table(s, d, "nodes").where("kind in ('class', 'function', 'method')").select("id", "file_path", "snippet").distinct()
    old = table(s, d, "extract_cache").groupBy("file_path").agg(F.max_by("sha256", F.struct("updated_at", "sha256")).alias("recorded"))
    f = table(s, d, "discovered_files").select(F.col("rel_path").alias("file_path"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("now")).distinct()
    x = n.join(f.join(old, "file_path", "left"), "file_path", "left")
    return x.select("id", S.content_hash(F.col("snippet")).alias("hash"), (~F.col("recorded").eqNullSafe(F.col("now"))).alias("needs_update"))


def _element_nodes(s, d):
    """Graph elements as JSON lines: data wrappers, the parent only where there is one."""
    n, e = _g(s, d)
    nodes = n.select(F.to_json(F.struct(F.struct("id", "kind", F.col("name").alias("label"), F.nullif("parent_id", F.lit("")).alias("parent")).alias("data"))).alias("element"))
    edges = W.numbered(e.select("id", "source_id", "target_id", "kind"), ["id"])
    edges = edges.select(F.to_json(F.struct(F.struct(F.concat(F.lit("e"), "number").alias("id"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), "kind").alias("data"))).alias("element"))
    return nodes.unionByName(edges)


def _visual(s, d):
    """Edges without containment, coloured by the source's community along the golden ratio."""
    n, e = _g(s, d)
    hue = F.floor(F.pmod(F.coalesce("community_id", F.lit(0)) * 618034, F.lit(1000000)) * 360 / 1000000)
    return e.where("kind <> 'contains'").join(n.select(F.col("id").alias("source_id"), "community_id"), "source_id").select("id", "source_id", "target_id", hue.cast("long").alias("hue"))


def _repo_files(s, d):
    return table(s, d, "discovered_files").select("rel_path", F.substring_index("rel_path", "/", 1).alias("repo"), F.regexp_replace("rel_path", "^[^/]*/", "").alias("inner"), F.octet_length(F.coalesce("content", F.lit(""))).alias("bytes"), "content").distinct()


def _pragma(c):
    return F.exists(F.slice(F.split(F.coalesce(c, F.lit("")), "\n"), 1, 10), lambda x: x.contains("lint: exempt"))




QUERIES = {
    "pattern_findings": lambda s, d: A.pattern_findings(_tags(s)),
    "clickable_elements": lambda s, d: A.clickable_findings(_tags(s)),
    "orphan_refs": lambda s, d: A.orphaned_references(_tags(s)),
    "composite_roles": lambda s, d: A.composite_roles(_tags(s)),
    "redundant_roles": lambda s, d: A.redundant_roles(_tags(s)),
    "placeholder_only": lambda s, d: A.placeholder_only(_tags(s)),
    "findings_verdict": lambda s, d: A.findings_summary(_findings(s)),
    "exceptions_in_force": lambda s, d: A.exceptions_in_force(_findings(s), _register(s), TODAY),
    "exception_expiry": lambda s, d: A.expiry_status(_register(s), TODAY),
    "contrast_pairs": lambda s, d: A.contrast_pairs(_rows(s, _PALETTE, "ord int, name string, hex string")),
    "contrast_ratio": lambda s, d: table(s, d, "part").select("p_partkey", F.round(S.contrast(S.to_hex(F.pmod("p_partkey", F.lit(256)), F.pmod(F.col("p_partkey") * 7, F.lit(256)), F.col("p_size")), F.lit("#ffffff")), 4).alias("ratio")).withColumn("verdict", S.verdict(F.col("ratio"), "text")),
    "receipts_coverage": lambda s, d: A.receipts(_rows(s, _CLAIMS, "doc string, line int, value string"), _rows(s, _RUNS, "doc string, first int, last int, `values` array<string>")),
    "section_upsert": lambda s, d: A.upsert_sections(_rows(s, _OLD, "doc string, heading string, body string, pos int"), _rows(s, _NEW, "doc string, heading string, body string, pos int")),
    "anchor_parse": lambda s, d: table(s, d, "nodes").where("file_path is not null and start_line is not null").select("id", S.anchor(F.concat("file_path", F.lit("#L"), F.col("start_line").cast("string"), F.lit("-L"), F.col("end_line").cast("string"))).alias("a")).distinct().select("id", "a.path", "a.first", "a.last", "a.valid"),
    "stale_class": lambda s, d: table(s, d, "extract_cache").select("file_path", "sha256").distinct().join(table(s, d, "discovered_files").select(F.col("rel_path").alias("file_path"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("now")).distinct(), "file_path", "left").select("file_path", "sha256", F.when(F.col("now").isNull(), "file_not_found").when(F.col("now") != F.col("sha256"), "hash_mismatch").otherwise("fresh").alias("state")),
    "plan_staleness": _staleness,
    "concept_search": lambda s, d: _concepts(s, d).where("kind in ('concept', 'article')").where(F.lower("title").contains("walker") | F.exists("tags", lambda t: F.lower(t).contains("walker")) | F.lower("text").contains("walker")).select("doc_id", "title"),
    "client_search": lambda s, d: _concepts(s, d).where(F.lower(F.concat_ws(" ", "title", "kind", F.array_join("tags", " "))).contains("harbor")).orderBy("doc_id").limit(12).select("doc_id", "title"),
    "concept_order": lambda s, d: W.numbered(_concepts(s, d).where("status <> 'deprecated'").select("doc_id", (F.col("status") != "stable").alias("k1"), F.lower("title").alias("k2")), ["k1", "k2", "doc_id"], "position", 1).select("doc_id", "position"),
    "running_budget": lambda s, d: W.within_budget(_concepts(s, d).select("source", "created_at", "doc_id", F.octet_length("text").alias("bytes")), ["source"], ["created_at", "doc_id"], F.col("bytes"), 20000).select("source", "doc_id", F.col("used").cast("long").alias("used")),
    "recent_digest": lambda s, d: W.newest(_concepts(s, d).select("source", "created_at", "doc_id", F.substring("text", 1, 150).alias("clip")), ["source"], ["created_at", "doc_id"], 20).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "doc_id", "clip"))), lambda x: x["clip"]), "\n").alias("digest")).select("source", F.substring("digest", 1, 20000).alias("digest")),
    "newest_50": lambda s, d: W.newest(table(s, d, "documents").where("doc_kind = 'log'").select("doc_kind", "ingested_at", "doc_id"), ["doc_kind"], ["ingested_at", "doc_id"], 50).select("doc_id", "rank"),
    "unique_slugs": lambda s, d: W.unique_slugs(table(s, d, "nodes").where("name is not null").select("id", "name").distinct(), S.slug(F.col("name")), ["id"]).select("id", "slug", "unique_slug"),
    "graph_elements": _element_nodes,
    "visual_edges": _visual,
    "meta_table": lambda s, d: G.graph_stats(*_g(s, d), table(s, d, "communities")).where("metric in ('nodes', 'edges', 'communities')").selectExpr("metric as key", "cast(value as string) as value").unionByName(s.createDataFrame([("schema_version", "2")], "key string, value string")),
    "changed_only": lambda s, d: QUERIES["stale_class"](s, d).where("state = 'hash_mismatch'").select("file_path").distinct(),
    "orphan_sweep": lambda s, d: table(s, d, "discovered_files").select("rel_path").distinct().join(table(s, d, "extract_cache").select(F.col("file_path").alias("rel_path")).distinct(), "rel_path", "left_anti"),
    "search_index": lambda s, d: _concepts(s, d).select("doc_id", F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("title"), "kind", F.substring("text", 1, 80).alias("summary")),
    "file_budget": lambda s, d: _repo_files(s, d).where((F.col("bytes") > 4 * 1500) & ~_pragma("content")).select("rel_path", "bytes"),
    "install_missing": lambda s, d: _install(s, d),
    "paired_files": lambda s, d: _pairs(s, d),
    "doc_sections": lambda s, d: table(s, d, "documents").where("doc_path is not null").select("doc_id", F.regexp_replace("doc_path", "^[^/]*/", "").alias("p")).select("doc_id", F.when(F.size(F.split("p", "/")) <= 1, "Overview").when(F.col("p").startswith("tests/"), "Tests").otherwise(F.initcap(F.replace(F.split("p", "/")[0], F.lit("_"), F.lit(" ")))).alias("section")),
}


def _install(s, d):
    """(inner, state): files of the largest repository that the second one lacks or has."""
    f = _repo_files(s, d).select("repo", "inner")
    top = [r[0] for r in f.groupBy("repo").count().orderBy(F.desc("count"), "repo").limit(2).collect()]
    a, b = (f.where(F.col("repo") == r).select("inner").distinct() for r in (top + ["", ""])[:2])
    return a.join(b, "inner", "left_anti").select("inner", F.lit("created").alias("state")).unionByName(a.join(b, "inner", "left_semi").select("inner", F.lit("kept").alias("state")))


def _pairs(s, d):
    """(inner, repositories): paths that more than one repository has."""
    return _repo_files(s, d).select("repo", "inner").distinct().groupBy("inner").agg(F.count(F.lit(1)).alias("repositories")).where("repositories > 1")


_PG = "pg AS " + _values(_PAGES, "doc, html")
_TG = """tg AS (SELECT doc, unnest(t) AS tag, generate_subscripts(t, 1) - 1 AS ord FROM (SELECT doc, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<[A-Za-z][^<>]*>') AS t FROM pg)),
ta AS (SELECT *, lower(regexp_extract(tag, '^<([A-Za-z0-9]+)', 1)) AS name FROM tg)"""


def _at(a):
    return f"CASE WHEN regexp_matches(tag, '(?i)[\\s]{a}\\s*=') THEN regexp_extract(tag, '(?i)[\\s]{a}\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1) END"


_FIND = "fi AS (" + " UNION ALL ".join(f"SELECT doc, ord, '{n}' AS \"check\", '{lv}' AS level FROM ta WHERE regexp_matches(tag, '{p.replace(chr(39), chr(39) * 2)}')" for n, lv, p in A.TAG_RULES) + ")"
_CLICK = f"ck AS (SELECT doc, ord, 'clickable' AS \"check\", CASE WHEN {_at('role')} IS NOT NULL AND regexp_matches(tag, '(?i)\\btabindex\\s*=') THEN 'WARN' ELSE 'ERROR' END AS level FROM ta WHERE name IN ('div', 'span') AND regexp_matches(tag, '(?i)\\bon(?:click|keydown)\\s*='))"
_RED = "rr AS (SELECT doc, ord, 'redundant-role' AS \"check\", 'WARN' AS level FROM ta WHERE lower(" + _at("role") + ") = CASE name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.NATIVE_ROLES.items()) + " END)"
_ALLF = "af AS (SELECT * FROM fi UNION ALL SELECT * FROM ck UNION ALL SELECT * FROM rr)"
_REG = "rg AS (SELECT entry, \"check\", doc, CAST(expires AS DATE) AS expires FROM " + _values(_REGISTER, 'entry, "check", doc, expires') + ")"
_LUM = "(0.2126 * {r} + 0.7152 * {g} + 0.0722 * {b})"


def _lin(c):
    return f"(CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END)"


SQL = {
    "pattern_findings": _with(_PG, _TG, _FIND) + "SELECT * FROM fi",
    "clickable_elements": _with(_PG, _TG, _CLICK) + "SELECT * FROM ck",
    "orphan_refs": _with(_PG, _TG) + "SELECT DISTINCT doc, ref FROM (SELECT doc, unnest(string_split_regex(concat_ws(' ', " + ", ".join(_at(a) for a in ("for", "aria-labelledby", "aria-describedby", "aria-controls")) + "), '\\s+')) AS ref FROM ta) r WHERE ref <> '' AND NOT EXISTS (SELECT 1 FROM ta WHERE ta.doc = r.doc AND " + _at("id") + " = r.ref)",
    "composite_roles": _with(_PG, _TG, "ro AS (SELECT DISTINCT doc, lower(" + _at("role") + ") AS role FROM ta)") + "SELECT doc, role FROM ro WHERE " + " OR ".join(f"(role = '{k}' AND NOT EXISTS (SELECT 1 FROM ro q WHERE q.doc = ro.doc AND q.role IN ({', '.join(repr(x) for x in v)})))" for k, v in A.CHILD_ROLES.items()),
    "redundant_roles": _with(_PG, _TG, _RED) + "SELECT * FROM rr",
    "placeholder_only": _with(_PG, _TG) + f"SELECT doc, ord FROM ta i WHERE name IN ('input', 'textarea') AND {_at('placeholder')} IS NOT NULL AND {_at('aria-label')} IS NULL AND {_at('aria-labelledby')} IS NULL AND NOT EXISTS (SELECT 1 FROM (SELECT doc, {_at('for')} AS f FROM ta WHERE name = 'label') l WHERE l.doc = i.doc AND l.f = {_at('id')})",
    "findings_verdict": _with(_PG, _TG, _FIND, _CLICK, _RED, _ALLF) + "SELECT errors, warnings, CASE WHEN errors > 0 THEN 'fail' WHEN warnings > 0 THEN 'pass with warnings' ELSE 'pass' END AS verdict FROM (SELECT count(*) FILTER (level = 'ERROR') AS errors, count(*) FILTER (level = 'WARN') AS warnings FROM af)",
    "exceptions_in_force": _with(_PG, _TG, _FIND, _CLICK, _RED, _ALLF, _REG) + f"SELECT af.*, x.e AS exception FROM af LEFT JOIN (SELECT \"check\", doc, min(entry) AS e FROM rg WHERE expires >= DATE '{TODAY}' GROUP BY 1, 2) x ON x.\"check\" = af.\"check\" AND x.doc = af.doc",
    "exception_expiry": _with(_REG) + f"SELECT entry, CASE WHEN expires IS NULL THEN 'missing' WHEN expires < DATE '{TODAY}' THEN 'expired' WHEN expires - DATE '{TODAY}' <= 14 THEN 'soon' ELSE 'ok' END AS status FROM rg",
    "contrast_ratio": "SELECT p_partkey, ratio, CASE WHEN ratio >= 4.5 THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT p_partkey, round(1.05 / (" + _LUM.format(r=_lin("(p_partkey % 256)"), g=_lin("(p_partkey * 7 % 256)"), b=_lin("p_size")) + " + 0.05), 4) AS ratio FROM part)",
    "receipts_coverage": "SELECT c.doc, c.line, c.value, coalesce(bool_or(r.first IS NOT NULL AND c.line BETWEEN r.first - 4 AND r.last + 4), false) AS covered FROM " + _values(_CLAIMS, "doc, line, value") + " c LEFT JOIN " + _values(_RUNS, "doc, first, last, vals") + " r ON r.doc = c.doc AND list_contains(r.vals, c.value) GROUP BY 1, 2, 3",
    "section_upsert": "SELECT coalesce(o.doc, n.doc) AS doc, coalesce(o.heading, n.heading) AS heading, coalesce(n.body, o.body) AS body, row_number() OVER (PARTITION BY coalesce(o.doc, n.doc) ORDER BY o.pos ASC NULLS LAST, n.pos) AS position FROM " + _values(_OLD, "doc, heading, body, pos") + " o FULL JOIN " + _values(_NEW, "doc, heading, body, pos") + " n ON n.doc = o.doc AND lower(trim(n.heading)) = lower(trim(o.heading))",
    "anchor_parse": "SELECT DISTINCT id, file_path AS path, start_line AS first, end_line AS last, start_line >= 1 AND start_line <= end_line AS valid FROM nodes WHERE file_path IS NOT NULL AND start_line IS NOT NULL",
    "stale_class": "SELECT c.file_path, c.sha256, CASE WHEN f.now IS NULL THEN 'file_not_found' WHEN f.now <> c.sha256 THEN 'hash_mismatch' ELSE 'fresh' END AS state FROM (SELECT DISTINCT file_path, sha256 FROM extract_cache) c LEFT JOIN (SELECT DISTINCT rel_path, sha256(coalesce(content, '')) AS now FROM discovered_files) f ON f.rel_path = c.file_path",
    "plan_staleness": """SELECT n.id, sha256(coalesce(n.snippet, '')) AS hash, f.now IS DISTINCT FROM o.r AS needs_update FROM (SELECT DISTINCT id, file_path, snippet FROM nodes WHERE kind IN ('class', 'function', 'method')) n
LEFT JOIN (SELECT DISTINCT rel_path, sha256(coalesce(content, '')) AS now FROM discovered_files) f ON f.rel_path = n.file_path LEFT JOIN (SELECT file_path, arg_max(sha256, (updated_at, sha256)) AS r FROM extract_cache GROUP BY 1) o ON o.file_path = f.rel_path""",
    "concept_search": _with(_CON) + "SELECT doc_id, title FROM con WHERE kind IN ('concept', 'article') AND (contains(lower(title), 'walker') OR contains(lower(source), 'walker') OR contains(lower(lang), 'walker') OR contains(lower(text), 'walker'))",
    "client_search": _with(_CON) + "SELECT doc_id, title FROM con WHERE contains(lower(concat_ws(' ', title, kind, source, lang)), 'harbor') ORDER BY doc_id LIMIT 12",
    "concept_order": _with(_CON) + "SELECT doc_id, row_number() OVER (ORDER BY status <> 'stable', lower(title), doc_id) AS position FROM con WHERE status <> 'deprecated'",
    "running_budget": _with(_CON) + "SELECT source, doc_id, used::BIGINT AS used FROM (SELECT source, doc_id, strlen(text) AS b, sum(strlen(text)) OVER (PARTITION BY source ORDER BY created_at ASC NULLS FIRST, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM con) WHERE used - b < 20000",
    "recent_digest": _with(_CON) + "SELECT source, left(string_agg(left(text, 150), chr(10) ORDER BY created_at ASC NULLS FIRST, doc_id), 20000) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at DESC NULLS LAST, doc_id DESC) AS r FROM con) WHERE r <= 20 GROUP BY 1",
    "newest_50": "SELECT doc_id, r AS rank FROM (SELECT doc_id, row_number() OVER (ORDER BY ingested_at DESC NULLS LAST, doc_id DESC) AS r FROM documents WHERE doc_kind = 'log') WHERE r <= 50",
    "visual_edges": _with(_V) + "SELECT e.id, source_id, target_id, floor((coalesce(community_id, 0) * 618034 % 1000000) * 360 / 1000000)::BIGINT AS hue FROM e JOIN n ON n.id = e.source_id WHERE e.kind <> 'contains'",
    "meta_table": _with(_V) + "SELECT 'nodes' AS key, count(*)::VARCHAR AS value FROM n UNION ALL SELECT 'edges', count(*)::VARCHAR FROM e UNION ALL SELECT 'communities', count(*)::VARCHAR FROM c UNION ALL SELECT 'schema_version', '2'",
    "changed_only": "SELECT DISTINCT c.file_path FROM extract_cache c JOIN discovered_files f ON f.rel_path = c.file_path WHERE sha256(coalesce(content, '')) <> c.sha256",
    "orphan_sweep": "SELECT DISTINCT rel_path FROM discovered_files WHERE rel_path NOT IN (SELECT file_path FROM extract_cache)",
    "search_index": _with(_CON) + "SELECT doc_id, coalesce(nullif(title, ''), 'doc-' || doc_id) AS title, kind, left(text, 80) AS summary FROM con",
    "file_budget": "SELECT DISTINCT rel_path, strlen(coalesce(content, '')) AS bytes FROM discovered_files WHERE strlen(coalesce(content, '')) > 6000 AND len(list_filter(string_split(content, chr(10))[1:10], lambda x: contains(x, 'lint: exempt'))) = 0",
    "paired_files": "SELECT * FROM (SELECT regexp_replace(rel_path, '^[^/]*/', '') AS \"inner\", count(DISTINCT split_part(rel_path, '/', 1)) AS repositories FROM discovered_files GROUP BY 1) WHERE repositories > 1",
    "doc_sections": "SELECT doc_id, CASE WHEN NOT contains(p, '/') THEN 'Overview' WHEN starts_with(p, 'tests/') THEN 'Tests' ELSE upper(p[1]) || lower(split_part(p, '/', 1)[2:]) END AS section FROM (SELECT doc_id, regexp_replace(doc_path, '^[^/]*/', '') AS p FROM documents WHERE doc_path IS NOT NULL)",
}
