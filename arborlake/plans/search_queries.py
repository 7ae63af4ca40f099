"""Search, extraction and resolution queries over the node, edge, file and cache tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.core import scratch, table
from arborlake.operators import resolve as R
from arborlake.operators import search as Q
from arborlake.plans.graph_queries import _V, _g, _with

QUERY = "sealLantern"


def _payloads(s, d):
    return R.newest_payloads(table(s, d, "extract_cache"))


def _files(s, d):
    return table(s, d, "discovered_files")


def _calls(s, d):
    p = scratch(_payloads(s, d), "payloads")
    calls, defs = R.payload_calls(p)
    return R.resolve_calls(calls, defs, R.resolved_imports(p, _files(s, d)))


def _bases(s, d):
    """Base classes by name, from the inherits edges, resolved against the definitions of the node table."""
    n, e = _g(s, d)
    defs = n.where("kind in ('class', 'function', 'method')").select("id", "file_path", "name", "qualified_name", F.lit(None).cast("string").alias("class_id"), F.coalesce("start_line", F.lit(0)).alias("seq"))
    at = e.where("kind = 'inherits'").join(n.select(F.col("id").alias("source_id"), "file_path"), "source_id")
    base = F.element_at(F.split("target_id", "::|external:"), -1)
    bases = at.select(F.concat_ws(" > ", "source_id", "target_id").alias("inh_id"), "file_path", base.alias("base_name"))
    i = e.where("kind = 'imports' and resolved = 1 and source_id like 'file:%' and target_id like 'file:%'").groupBy("source_id", "target_id").agg(F.min("id").alias("ord"))
    imports = i.select(F.substring("source_id", 6, 1_000_000).alias("file_path"), F.substring("target_id", 6, 1_000_000).alias("target_file"), F.array().cast("array<string>").alias("names"), "ord")
    return R.resolve_inheritances(bases, defs, imports)


def _expanded(s, d):
    n, e = _g(s, d)
    return Q.expand(n, e, Q.anchors(n, QUERY))


QUERIES = {
    "anchor_search": lambda s, d: Q.anchors(_g(s, d)[0], QUERY),
    "snippet_fallback": lambda s, d: Q.snippet_anchors(table(s, d, "nodes"), "the walker"),
    "search_expand": _expanded,
    "search_ranked": lambda s, d: Q.ranked(*_g(s, d), _expanded(s, d)),
    "search_blocks": lambda s, d: Q.search(table(s, d, "nodes"), *_g(s, d), QUERY),
    "path_glob_lookup": lambda s, d: Q.glob_lookup(_g(s, d)[0], "*ledger*_index*"),
    "ext_language": lambda s, d: _files(s, d).select("rel_path", R.language_of(F.col("rel_path")).alias("language")).distinct(),
    "language_counts": lambda s, d: _files(s, d).select("rel_path", R.language_of(F.col("rel_path")).alias("language")).distinct().groupBy("language").agg(F.count(F.lit(1)).alias("n")),
    "kept_files": lambda s, d: R.kept_files(_files(s, d), ignore=("vendors/", "tests/**/index.*", "!tests/index.py")).select("rel_path", "language"),
    "ancestor_dirs": lambda s, d: R.ancestor_folders(_files(s, d)),
    "extract_cache_hit_miss": lambda s, d: R.cache_state(_files(s, d), table(s, d, "extract_cache")),
    "payload_counts": lambda s, d: _payloads(s, d).select("file_path", F.size("p.definitions").alias("definitions"), F.size("p.imports").alias("imports"), F.size("p.calls").alias("calls"), F.coalesce("p.parse_had_errors", F.lit(False)).alias("errors")),
    "definition_nesting": lambda s, d: R.definitions(_payloads(s, d)),
    "call_innermost": lambda s, d: R.innermost_calls(_payloads(s, d)),
    "import_candidates": lambda s, d: R.import_candidates(R.file_imports(_payloads(s, d))),
    "import_resolution": lambda s, d: R.resolve_imports(R.file_imports(_payloads(s, d)), _files(s, d)),
    "tiered_call_resolution": _calls,
    "tiered_inheritance": _bases,
    "python_extraction": lambda s, d: R.extract_python(_files(s, d)),
}
_T = Q.query_terms(QUERY)
_LIKE = " ".join(f"WHEN {k} THEN name ILIKE '%{t}%' OR qualified_name ILIKE '%{t}%'" for k, t in enumerate(_T))
_ANCH = f"""a AS (SELECT id, min(term) AS term FROM (SELECT id, term, row_number() OVER (PARTITION BY term ORDER BY id) AS r FROM n, (SELECT unnest(range({len(_T)})) AS term)
 WHERE external = 0 AND kind <> 'directory' AND CASE term {_LIKE} END) WHERE r <= 10 GROUP BY id ORDER BY term, id LIMIT 10)"""
_EXP = """am AS (SELECT * FROM n WHERE id IN (SELECT id FROM a)),
cm AS (SELECT id FROM (SELECT id FROM n WHERE external = 0 AND coalesce(community_id, 0) <> 0 AND community_id IN (SELECT community_id FROM am) ORDER BY CASE WHEN file_path IN (SELECT file_path FROM am WHERE file_path IS NOT NULL) THEN 0 ELSE 1 END, start_line ASC NULLS FIRST, id LIMIT 15) WHERE id NOT IN (SELECT id FROM a)),
ba AS (SELECT id FROM a UNION ALL SELECT id FROM cm),
br AS (SELECT id FROM (SELECT DISTINCT id FROM (SELECT target_id AS id FROM e WHERE source_id IN (SELECT id FROM ba) UNION ALL SELECT source_id FROM e WHERE target_id IN (SELECT id FROM ba)) WHERE id NOT IN (SELECT id FROM ba) ORDER BY id LIMIT 20) WHERE id IN (SELECT id FROM n WHERE external = 0)),
ti AS (SELECT id, 'anchor' AS tier FROM a UNION ALL SELECT id, 'bridge' FROM br UNION ALL SELECT id, 'community' FROM cm)"""
_LANG = "CASE lower(regexp_extract(rel_path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.LANGUAGES.items()) + " END"
_PAY = """np AS (SELECT file_path, arg_max(payload_json, (updated_at, sha256, language, payload_json)) AS j FROM extract_cache WHERE file_path IS NOT NULL GROUP BY 1),
df AS (SELECT file_path, unnest(from_json(j->'definitions', '[{"kind":"VARCHAR","local_name":"VARCHAR","start_byte":"INTEGER","end_byte":"INTEGER"}]'), recursive := true) FROM np),
cl AS (SELECT file_path, unnest(from_json(j->'calls', '[{"name":"VARCHAR","receiver":"VARCHAR","node_start_byte":"INTEGER"}]'), recursive := true) FROM np)"""

SQL = {
    "anchor_search": _with(_V, _ANCH) + "SELECT * FROM a",
    "snippet_fallback": "SELECT DISTINCT id, 0 AS term FROM nodes WHERE external = 0 AND snippet ILIKE '%the walker%' ORDER BY id LIMIT 10",
    "search_expand": _with(_V, _ANCH, _EXP) + "SELECT * FROM ti",
    "search_ranked": _with(_V, _ANCH, _EXP) + """SELECT row_number() OVER (ORDER BY CASE tier WHEN 'anchor' THEN 0 WHEN 'bridge' THEN 1 ELSE 2 END, k DESC, id) AS position, id, tier, k AS edge_count FROM (
 SELECT ti.*, (SELECT count(*) FROM e WHERE source_id = ti.id) + (SELECT count(*) FROM e WHERE target_id = ti.id) AS k FROM ti)""",
    "path_glob_lookup": _with(_V) + "SELECT DISTINCT file_path AS match, 'file' AS what FROM n WHERE file_path ILIKE '%ledger%_index%' UNION SELECT DISTINCT id, 'symbol' FROM n WHERE name ILIKE '%ledger%_index%' AND external = 0",
    "ext_language": f"SELECT DISTINCT rel_path, {_LANG} AS language FROM discovered_files",
    "language_counts": f"SELECT language, count(*) AS n FROM (SELECT DISTINCT rel_path, {_LANG} AS language FROM discovered_files) GROUP BY 1",
    "kept_files": f"""SELECT DISTINCT rel_path, {_LANG} AS language FROM discovered_files WHERE {_LANG} IS NOT NULL AND strlen(coalesce(content, '')) <= 2000000
 AND len(list_intersect(string_split(rel_path, '/'), [{", ".join(f"'{x}'" for x in R.SKIPPED_FOLDERS)}])) = 0
 AND NOT (CASE WHEN regexp_matches(rel_path, '^tests/index\\.py(?:/|$)') THEN false WHEN regexp_matches(rel_path, '^tests/(?:.*/)?index\\.[^/]*(?:/|$)') THEN true ELSE regexp_matches(rel_path, '(?:^|/)vendors(?:/|$)') END)""",
    "ancestor_dirs": """SELECT DISTINCT folder, CASE WHEN contains(folder, '/') THEN regexp_replace(folder, '/[^/]*$', '') END AS parent FROM (SELECT array_to_string(p[:k], '/') AS folder FROM (
 SELECT p, unnest(range(1, len(p))) AS k FROM (SELECT string_split(rel_path, '/') AS p FROM discovered_files)))""",
    "extract_cache_hit_miss": """SELECT rel_path, CASE WHEN c.s IS NULL THEN 'miss' WHEN c.s = f.s THEN 'hit' ELSE 'stale' END AS state FROM (SELECT DISTINCT rel_path, sha256(coalesce(content, '')) AS s FROM discovered_files) f
LEFT JOIN (SELECT file_path, arg_max(sha256, (updated_at, sha256)) AS s FROM extract_cache GROUP BY 1) c ON c.file_path = f.rel_path""",
    "payload_counts": _with(_PAY) + "SELECT file_path, json_array_length(j->'definitions')::INT AS definitions, json_array_length(j->'imports')::INT AS imports, json_array_length(j->'calls')::INT AS calls, coalesce((j->>'parse_had_errors')::BOOLEAN, false) AS errors FROM np",
    "definition_nesting": _with(_PAY) + """, o AS (SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY start_byte, -end_byte, local_name, kind) - 1 AS ord, kind, local_name AS name, start_byte AS start, end_byte AS "end" FROM df)
SELECT o.file_path, o.ord, o.kind, o.name, o.start, o."end", (SELECT max(q.ord) FROM o q WHERE q.file_path = o.file_path AND q.ord < o.ord AND q.start <= o.start AND q."end" >= o."end") AS parent_ord FROM o""",
    "call_innermost": _with(_PAY) + """, cr AS (SELECT *, row_number() OVER () AS rid FROM cl)
SELECT cr.file_path, node_start_byte AS pos, cr.name AS callee, receiver, arg_max(df.local_name, (df.start_byte, df.local_name)) AS caller FROM cr LEFT JOIN df ON df.file_path = cr.file_path AND df.kind IN ('function', 'method') AND df.start_byte <= node_start_byte AND node_start_byte < df.end_byte
GROUP BY rid, cr.file_path, node_start_byte, cr.name, receiver""",
}


_SYM = """dl AS (SELECT file_path, unnest(from_json(j->'definitions', '[{"kind":"VARCHAR","local_name":"VARCHAR","start_byte":"INTEGER","end_byte":"INTEGER","start_line":"INTEGER"}]'), recursive := true) FROM np),
ol AS (SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY start_byte, -end_byte, local_name, kind, start_line) - 1 AS ord, kind, local_name AS name, start_byte AS st, end_byte AS en, start_line AS line FROM dl),
pl AS (SELECT o.*, (SELECT max(q.ord) FROM ol q WHERE q.file_path = o.file_path AND q.ord < o.ord AND q.st <= o.st AND q.en >= o.en) AS po FROM ol o),
ql AS (SELECT x.file_path, x.ord, x.name, x.st, x.line, CASE WHEN x.kind = 'function' AND p.name IS NOT NULL THEN 'method' ELSE x.kind END AS k, concat_ws('.', p.name, x.name) AS q, p.name AS pn, p.kind AS pk FROM pl x LEFT JOIN ol p ON p.file_path = x.file_path AND p.ord = x.po),
sy AS (SELECT k || ':' || file_path || '::' || q || CASE WHEN r > 1 THEN ':L' || line ELSE '' END AS id, k AS kind, name, q AS qualified_name, file_path, st AS seq,
 CASE WHEN pn IS NULL THEN 'file:' || file_path ELSE pk || ':' || file_path || '::' || pn END AS parent_id, CASE WHEN pk = 'class' AND k = 'method' THEN pk || ':' || file_path || '::' || pn END AS class_id
 FROM (SELECT *, row_number() OVER (PARTITION BY file_path, k, q ORDER BY st, ord) AS r FROM ql))"""
_EXT = lambda c: f"lower(regexp_extract({c}, '\\.([A-Za-z0-9]+)$', 1))"
_NORM = lambda c: f"substr(list_reduce(list_prepend('', list_filter(string_split({c}, '/'), lambda s: s NOT IN ('', '.'))), lambda a, s: CASE WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || s END), 2)"
_IMP = f"""im AS (SELECT file_path, i.path_text, i.imported_names AS names, ord FROM (SELECT file_path, unnest(a) AS i, generate_subscripts(a, 1) - 1 AS ord FROM (SELECT file_path, from_json(j->'imports', '[{{"path_text":"VARCHAR","imported_names":["VARCHAR"]}}]') AS a FROM np))),
ix AS (SELECT *, {_EXT("file_path")} AS ext, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '' END AS here, split_part(file_path, '/', 1) AS root, length(regexp_extract(path_text, '^(\\.*)', 1)) AS dots, path_text AS t FROM im),
iy AS (SELECT *, {_NORM("concat_ws('/', CASE WHEN dots > 0 THEN array_to_string(list_slice(string_split(here, '/'), 1, greatest(len(string_split(here, '/')) - dots + 1, 0)), '/') ELSE root END, replace(regexp_replace(t, '^\\.+', ''), '.', '/'))")} AS py, {_NORM("concat_ws('/', here, t)")} AS js,
 replace(regexp_replace(t, '^(?:crate|self|super)(?:::)?', ''), '::', '/') AS rest FROM ix),
iz AS (SELECT *, CASE WHEN regexp_matches(t, '^crate(::|$)') THEN {_NORM("concat_ws('/', root, 'src', CASE WHEN rest = '' THEN 'lib' ELSE rest END)")} WHEN starts_with(t, 'self::') THEN {_NORM("concat_ws('/', here, rest)")} WHEN starts_with(t, 'super::') THEN {_NORM("concat_ws('/', here, '..', rest)")} END AS rs FROM iy),
cs AS (SELECT file_path, ord, path_text, CASE WHEN ext = 'py' THEN [py || '.py', py || '/__init__.py'] WHEN ext IN ('js', 'jsx', 'mjs', 'cjs', 'ts', 'tsx') AND starts_with(t, '.') THEN
 list_concat(list_concat(CASE WHEN regexp_matches(t, '\\.\\w+$') THEN [js] ELSE [] END, list_transform({list(R._SUFFIXES)}, lambda x: js || x)), list_transform({list(R._SUFFIXES)}, lambda x: js || '/index' || x)) WHEN ext = 'rs' AND rs IS NOT NULL THEN [rs || '.rs', rs || '/mod.rs'] END AS a FROM iz),
cd AS (SELECT file_path, ord, path_text, unnest(a) AS candidate, generate_subscripts(a, 1) - 1 AS rank FROM cs),
fp AS (SELECT DISTINCT rel_path, {_EXT("rel_path")} AS ext FROM discovered_files WHERE rel_path IS NOT NULL),
di AS (SELECT file_path, ord, arg_min(candidate, rank) AS target FROM cd JOIN fp ON rel_path = candidate GROUP BY 1, 2),
nk AS (SELECT ext, key, min(rel_path) AS only_file FROM (SELECT DISTINCT ext, rel_path, unnest([regexp_replace(string_split(rel_path, '/')[-1], '\\.[^.]*$', ''), string_split(rel_path, '/')[-2]]) AS key FROM fp WHERE ext IN ('go', 'cs', 'swift')) WHERE key IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1),
ri AS (SELECT im.file_path, im.ord, im.path_text, im.names, coalesce(di.target, nk.only_file, (SELECT min(rel_path) FROM fp WHERE fp.ext IN ('java', 'kt') AND fp.ext = CASE WHEN {_EXT("im.file_path")} = 'kts' THEN 'kt' ELSE {_EXT("im.file_path")} END AND ends_with(fp.rel_path, '/' || replace(im.path_text, '.', '/') || '.' || fp.ext) HAVING count(*) = 1)) AS target
 FROM im LEFT JOIN di ON di.file_path = im.file_path AND di.ord = im.ord LEFT JOIN nk ON nk.ext = {_EXT("im.file_path")} AND nk.key = string_split(string_split(im.path_text, '/')[-1], '.')[-1])"""
_LAST = """xp AS (SELECT DISTINCT id, file_path, seq, unnest([name, qualified_name]) AS xn FROM {defs}),
la AS (SELECT file_path AS xf, xn, arg_max(id, (seq, id)) AS target FROM xp WHERE xn IS NOT NULL GROUP BY 1, 2),
an AS (SELECT xn, min(id) AS target FROM xp WHERE xn IS NOT NULL GROUP BY 1 HAVING count(*) = 1)"""
_NOISY = ", ".join(f"'{x}'" for x in R.NOISE_CALLS)
_PICK = lambda table, k: "CASE tier " + " ".join(f"WHEN {t} THEN " + (str(v[k]) if k == 0 else f"'{v[k]}'") for t, v in table.items()) + " END"
_CALLS = f"""cr AS (SELECT *, row_number() OVER () AS rid FROM cl),
cx AS (SELECT cr.rid, cr.file_path, cr.name, receiver, node_start_byte AS pos, max({{'s': df.start_byte, 'n': df.local_name}}) AS b FROM cr LEFT JOIN df ON df.file_path = cr.file_path AND df.kind IN ('function', 'method') AND df.start_byte <= node_start_byte AND node_start_byte < df.end_byte GROUP BY ALL),
cm AS (SELECT file_path, name, seq, min(class_id) AS class_id, min(id) AS src FROM sy WHERE kind <> 'class' GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT coalesce(src, 'file:' || cx.file_path) AS source_id, concat_ws('@', cx.file_path, pos::VARCHAR, cx.name) AS call_id, cx.file_path, cm.class_id, cx.name, receiver, receiver IN ('self', 'this') AS own FROM cx LEFT JOIN cm ON cm.file_path = cx.file_path AND cm.name = b.n AND cm.seq = b.s),
{_LAST.format(defs="sy")},
nm AS (SELECT file_path, target, ord, unnest(names) AS nm FROM ri WHERE target IS NOT NULL),
mo AS (SELECT DISTINCT file_path, target, ord, unnest([stem, replace(stem, '_', '')]) AS mo FROM (SELECT *, regexp_replace(string_split(target, '/')[-1], '\\.[^.]*$', '') AS stem FROM ri WHERE target IS NOT NULL)),
ne AS (SELECT regexp_replace(file_path, '/?[^/]*$', '') AS xd, xn, min(id) AS target FROM xp WHERE xn IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1),
cm1 AS (SELECT class_id, name, arg_max(id, (seq, id)) AS target FROM sy WHERE class_id IS NOT NULL GROUP BY 1, 2),
ta AS (SELECT call_id, 1 AS tier, 0 AS o, target FROM k JOIN cm1 USING (class_id, name) WHERE own
 UNION ALL SELECT call_id, 2, 0, target FROM k JOIN la ON xf = file_path AND xn = name WHERE receiver IS NULL
 UNION ALL SELECT call_id, 3, -ord, la.target FROM k JOIN nm ON nm.file_path = k.file_path AND nm.nm = k.name JOIN la ON xf = nm.target AND xn = k.name WHERE receiver IS NULL
 UNION ALL SELECT call_id, 4, ord, la.target FROM k JOIN mo ON mo.file_path = k.file_path AND mo.mo = receiver JOIN la ON xf = mo.target AND xn = k.name WHERE NOT own
 UNION ALL SELECT call_id, 5, w - ord * 2, la.target FROM k JOIN nm ON nm.file_path = k.file_path AND nm.nm = receiver, (SELECT unnest([0, 1]) AS w) JOIN la ON xf = nm.target AND xn = CASE WHEN w = 0 THEN receiver || '.' || k.name ELSE k.name END WHERE NOT own
 UNION ALL SELECT call_id, 6, 0, target FROM k JOIN an ON xn = name WHERE receiver IS NULL AND name NOT IN ({_NOISY})
 UNION ALL SELECT call_id, 7, 0, target FROM k JOIN ne ON xd = regexp_replace(file_path, '/?[^/]*$', '') AND xn = name WHERE receiver IS NULL AND name NOT IN ({_NOISY})
 UNION ALL SELECT call_id, 8, 0, 'external:' || concat_ws('.', receiver, name) FROM k)"""
_BASES = f"""xx AS (SELECT id, file_path, name, qualified_name, coalesce(start_line, 0) AS seq FROM n WHERE kind IN ('class', 'function', 'method')), {_LAST.format(defs="xx")},
ba AS (SELECT DISTINCT concat_ws(' > ', source_id, target_id) AS inh_id, n.file_path, regexp_split_to_array(target_id, '::|external:')[-1] AS base FROM e JOIN n ON n.id = source_id WHERE e.kind = 'inherits'),
bb AS (SELECT *, string_split(base, '.')[-1] AS raw FROM ba),
ii AS (SELECT substr(source_id, 6) AS f, substr(target_id, 6) AS tf, min(id) AS ord FROM e WHERE kind = 'imports' AND resolved = 1 AND source_id LIKE 'file:%' AND target_id LIKE 'file:%' GROUP BY 1, 2),
ta AS (SELECT inh_id, 1 AS tier, 0 AS o, target FROM bb JOIN la ON xf = file_path AND xn = base UNION ALL SELECT inh_id, 1, 1, target FROM bb JOIN la ON xf = file_path AND xn = raw
 UNION ALL SELECT inh_id, 3, ord, target FROM bb JOIN ii ON f = file_path JOIN la ON xf = tf AND xn = raw UNION ALL SELECT inh_id, 4, 0, target FROM bb JOIN an ON xn = raw UNION ALL SELECT inh_id, 5, 0, 'external:' || base FROM bb)"""
_BEST = lambda key, table: f"SELECT {key}, target, tier, {_PICK(table, 0)} AS score, {_PICK(table, 1)} AS confidence, tier < {max(table)} AS resolved FROM (SELECT {key}, tier, target FROM ta QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY tier, o, target) = 1)"

SQL |= {
    "definition_nodes": _with(_PAY, _SYM) + "SELECT id, kind, name, parent_id FROM sy",
    "import_candidates": _with(_PAY, _IMP) + "SELECT file_path, ord, path_text, rank, candidate FROM cd",
    "import_resolution": _with(_PAY, _IMP) + "SELECT file_path, ord, path_text, coalesce('file:' || target, 'external:' || path_text) AS target, target IS NOT NULL AS resolved, CASE WHEN target IS NULL THEN 'AMBIGUOUS' ELSE 'EXTRACTED' END AS confidence FROM ri",
    "tiered_call_resolution": _with(_PAY, _SYM, _IMP, _CALLS) + _BEST("call_id", R.TIERS),
    "tiered_inheritance": _with(_V, _BASES) + _BEST("inh_id", R.BASE_TIERS),
}
