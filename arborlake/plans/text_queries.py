"""Line, log, naming and scanning queries over documents, files and nodes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.core import table
from arborlake.functions import lines as L
from arborlake.functions import scalars as S


def _docs(s, d):
    return table(s, d, "documents").where("text is not null")


def _lines(s, d):
    """(doc_id, i, line), 0-based."""
    return _docs(s, d).select("doc_id", F.posexplode(L.split_lines(F.col("text"))).alias("i", "line"))


def _each(fn):
    """doc_id and the text after an array-of-lines step."""
    return lambda s, d: _docs(s, d).select("doc_id", L.join_lines(fn(L.split_lines(F.col("text")))).alias("out"))


_LS = """s AS (SELECT doc_id, CASE WHEN text = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(text, '\\r?\\n') END AS ls FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, CASE WHEN len(ls) > 0 AND ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM s),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM x)"""
_BL = """b AS (SELECT *, trim(regexp_replace(line, '\\s', ' ', 'g')) = '' AS blank FROM l),
k AS (SELECT doc_id, i, CASE WHEN blank THEN '' ELSE line END AS line FROM (SELECT *, lag(blank) OVER (PARTITION BY doc_id ORDER BY i) AS pb FROM b) WHERE NOT (blank AND coalesce(pb, false)))"""
_RUN = """g AS (SELECT *, trim(regexp_replace(line, '\\s', ' ', 'g')) = '' AS blank, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM {src}),
h AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> line OR blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g),
r AS (SELECT doc_id, min(i) AS i, CASE WHEN count(*) > 1 THEN any_value(line) || ' [repeated ' || count(*) || ' times]' ELSE any_value(line) END AS line FROM h GROUP BY doc_id, island)"""
_OUT = "SELECT x.doc_id, coalesce(o.out, '') AS out FROM x LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS out FROM {src} GROUP BY 1) o ON o.doc_id = x.doc_id"
_ERR = "(" + " OR ".join(f"regexp_matches(line, '{p}')" for p in L.GENERIC_ERRORS) + ")"
_HT = """n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn, count(*) OVER (PARTITION BY doc_id) AS m FROM {src}),
t AS (SELECT doc_id, rn AS i, line FROM n WHERE m <= 60 OR rn <= 25 OR rn > m - 35 OR {err}
 UNION ALL SELECT DISTINCT doc_id, 25.5 AS i, '... [' || (m - 60) || ' lines omitted] ...' FROM n WHERE m > 60)"""
_ENT = "CASE WHEN length({s}) = 0 THEN 0.0 ELSE -list_sum(list_transform(list_distinct(string_split({s}, '')), lambda c: ((length({s}) - length(replace({s}, c, ''))) / length({s})) * log2((length({s}) - length(replace({s}, c, ''))) / length({s})))) END"

_SECRETS = [
    ("aws_access_key_id", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github_token", r"\b(?:gh[pousr]_[A-Za-z0-9_]{36,}|github_pat_[A-Za-z0-9_]{82})\b"),
    ("slack_token", r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b"),
    ("private_key_block", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("bearer_token", r"(?i)\bbearer\s+[A-Za-z0-9\-._~+/]+=*"),
    ("api_key_assignment", r"""(?i)\b(?:api_key|apikey|secret_key|client_secret)\s*[:=]\s*["'][A-Za-z0-9_\-]{16,}["']"""),
]
_PII = [("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b"), ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"), ("us_phone", r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"), ("credit_card", r"\b(?:[0-9][ -]?){13,16}\b")]
_THREATS = [
    ("exfiltration", r"(?i)\b(?:curl|wget|fetch)\b.*(?:\|\s*(?:bash|sh|pwsh|powershell)|--upload-file|-T\s+|-d\s+@)"),
    ("exfiltration", r"(?i)\b(?:nc|ncat|netcat)\b.*-[le]"),
    ("exfiltration", r"/dev/tcp/[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+/[0-9]+"),
    ("injection", r"(?i)\bignore\s+(?:all\s+|any\s+)?previous\s+instructions\b"),
    ("injection", r"(?i)\bsystem\s+prompt\s+override\b"),
    ("injection", r"(?i)\bdisregard\s+(?:all\s+|any\s+)?(?:prior|previous)\s+(?:guidelines|instructions)\b"),
    ("destructive", r"(?i)\brm\s+-(?:rf|fr)\s+(?:/|~|\$HOME|\*\s*$)"),
    ("destructive", r"(?i)\bdel\s+/[sfq]\s+[a-z]:\\"),
    ("destructive", r"(?i)\bmkfs(?:\.\w+)?\b"),
    ("destructive", r"(?i)\bdd\s+if=.*of=/dev/[sh]d[a-z]"),
    ("persistence", r"(?i)\bcrontab\b"),
    ("persistence", r"(?i)\b(?:~/\.(?:bashrc|zshrc|profile)|/etc/cron)"),
    ("persistence", r"(?i)\b(?:systemctl\s+enable|launchctl\s+load)\b"),
    ("network", r"(?i)\b(?:ngrok|localtunnel|cloudflared)\b"),
    ("network", r"(?i)\b(?:ssh\s+-R|reverse\s+tunnel)\b"),
    ("obfuscation", r"(?i)\b(?:base64\s+-d|base64\s+--decode)\s*\|\s*(?:bash|sh|pwsh)"),
    ("obfuscation", r"(?i)\b(?:eval|exec)\s*\(\s*(?:base64\.|bytes\.fromhex|__import__)"),
]


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def secret_hits(snippets, rules=_SECRETS):
    """(id, rule) for every rule that matches a text; one pass, rules compiled into the plan."""
    hits = F.filter(F.array(*(F.when(F.col("snippet").rlike(p), F.lit(n)) for n, p in rules)), lambda x: x.isNotNull())
    return snippets.select("id", F.explode(hits).alias("rule"))


def threat_hits(lines, rules=_THREATS):
    """(doc_id, line_no, family, snippet) for every rule and line, snippet at most 100 characters."""
    hits = F.filter(F.array(*(F.when(F.col("line").rlike(p), F.lit(n)) for n, p in rules)), lambda x: x.isNotNull())
    return lines.select("doc_id", (F.col("i") + 1).alias("line_no"), F.explode(hits).alias("family"), F.substring(F.trim("line"), 1, 100).alias("snippet"))


def _pii(s, d):
    n = [F.regexp_count("text", F.lit(p)).alias(k) for k, p in _PII]
    cards = F.size(F.filter(F.regexp_extract_all("text", F.lit(_PII[3][1]), 0), lambda c: S.luhn(c))).alias("valid_cards")
    return _docs(s, d).select("doc_id", *n, cards)


def _savings(s, d, by):
    e = table(s, d, "events").select("event_type", F.floor("value").cast("long").alias("raw"), F.get_json_object("props", "$.k").cast("long").alias("filtered"))
    saved = F.greatest(F.lit(0), F.col("raw") - F.col("filtered"))
    aggs = [F.count(F.lit(1)).alias("runs"), F.sum("raw").alias("raw"), F.sum("filtered").alias("filtered"), F.sum(saved).alias("saved")]
    g = e.groupBy("event_type").agg(*aggs) if by else e.agg(*aggs)
    return g.withColumn("permille", F.when(F.col("raw") > 0, F.floor(F.col("saved") * 1000 / F.col("raw"))).otherwise(0))


_SAVE = "count(*) AS runs, sum(raw)::BIGINT AS raw, sum(filtered)::BIGINT AS filtered, sum(greatest(0, raw - filtered))::BIGINT AS saved, CASE WHEN sum(raw) > 0 THEN floor(sum(greatest(0, raw - filtered)) * 1000 / sum(raw))::BIGINT ELSE 0 END AS permille FROM (SELECT event_type, floor(value)::BIGINT AS raw, (props->>'k')::BIGINT AS filtered FROM events)"

_SPEC = next(x for x in L.SPECS if x.name == "changelog")  # changelog: keep headings and fixes

_INTENT = [
    ("full", "fix modify refactor change update add implement edit write".split()),
    ("map", "architecture dependencies imports exports linkages outline".split()),
    ("signatures", ["find references", "understand", "trace", "call flow", "signature", "interface", "overview", "read"]),
]


def _intent(s, d):
    t, col = F.lower("text"), None
    for mode, words in _INTENT:
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        col = F.when(hit, mode) if col is None else col.when(hit, mode)
    return _docs(s, d).select("doc_id", col.when(F.octet_length("text") < 4096, "full").otherwise("signatures").alias("mode"))


def _signature_nodes(s, d):
    return table(s, d, "nodes").select("id", "name", "qualified_name", "file_path", "kind", "snippet", "start_line", "end_line").distinct()


QUERIES = {
    "line_entropy": lambda s, d: _docs(s, d).select("doc_id", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("doc_id", "ch").count().groupBy("doc_id").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.log2("count")).alias("h")).select("doc_id", F.round(F.log2("n") - F.col("h") / F.col("n"), 4).alias("entropy")),
    "entropy_filter_keep_blank": _each(lambda ls: L.entropy_filter(ls)),
    "entropy_filter_strict": _each(lambda ls: L.entropy_filter(ls, 3.5, False)),
    "token_estimates": lambda s, d: _docs(s, d).select("doc_id", S.tokens_floor(F.col("text")).alias("by_floor"), S.tokens_ceil(F.col("text")).alias("by_ceil"), S.tokens_bytes(F.col("text")).alias("by_bytes")),
    "collapse_blanks": _each(L.collapse_blank),
    "collapse_duplicates": _each(L.collapse_repeats),
    "head_tail_rescue": _each(lambda ls: L.head_tail(ls)),
    "truncate_lines": _each(lambda ls: F.transform(ls, lambda x: L.truncate_line(x, 60))),
    "ansi_strip": lambda s, d: _docs(s, d).select("doc_id", L.strip_ansi(F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b[0m"))).alias("out")),
    "generic_filter": lambda s, d: _docs(s, d).select("doc_id", L.generic_filter(F.col("text")).alias("out")),
    "spec_filter": lambda s, d: _docs(s, d).where("doc_kind = 'changelog'").select("doc_id", _SPEC.compile(F.col("text")).alias("out")),
    "error_lines": lambda s, d: _lines(s, d).where(L.any_of(F.col("line"), L.GENERIC_ERRORS)).select("doc_id", "i", "line"),
    "grep_lines": lambda s, d: _lines(s, d).where(F.col("line").rlike("(?i)walker|dateibaum")).select("doc_id", (F.col("i") + 1).alias("line_no"), "line"),
    "savings_record": lambda s, d: _docs(s, d).select("doc_id", S.tokens_ceil(F.col("text")).alias("raw"), S.tokens_ceil(L.generic_filter(F.col("text"))).alias("filtered")).withColumn("saved", F.greatest(F.lit(0), F.col("raw") - F.col("filtered"))),
    "savings_summary": lambda s, d: _savings(s, d, False),
    "savings_by_command": lambda s, d: _savings(s, d, True),
    "secret_hits": lambda s, d: secret_hits(table(s, d, "nodes").select("id", "snippet").distinct()),
    "pii_counts": _pii,
    "luhn_cards": lambda s, d: table(s, d, "orders").select("o_orderkey", S.luhn(F.concat(F.lit("4539-1488-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))).alias("valid")),
    "threat_scan": lambda s, d: threat_hits(_lines(s, d)),
    "snippet_threats": lambda s, d: threat_hits(table(s, d, "nodes").where("snippet is not null").select(F.col("id").alias("doc_id"), "snippet").distinct().select("doc_id", F.posexplode(L.split_lines(F.col("snippet"))).alias("i", "line"))),
    "slugs": lambda s, d: _signature_nodes(s, d).where("qualified_name is not null").select("id", S.slug(F.col("qualified_name")).alias("slug")).distinct(),
    "safe_names": lambda s, d: _signature_nodes(s, d).where("name is not null").select("id", S.safe_filename(F.concat("name", F.lit(" (x)"))).alias("file"), S.safe_component(F.col("qualified_name")).alias("component")).distinct(),
    "doc_paths": lambda s, d: _signature_nodes(s, d).where("kind in ('class', 'function', 'method')").select("id", S.doc_path(F.col("file_path"), F.col("qualified_name")).alias("path")).distinct(),
    "content_sha": lambda s, d: _signature_nodes(s, d).select("id", S.content_hash(F.col("snippet")).alias("sha256")).distinct(),
    "name_words": lambda s, d: _signature_nodes(s, d).where("name is not null").select("id", F.explode(S.snake_and_camel(F.col("name"))).alias("word")).distinct(),
    "map_lines": lambda s, d: _signature_nodes(s, d).where("kind in ('class', 'function', 'method')").select("id", F.concat(F.col("name"), F.lit(" ("), F.col("kind"), F.lit(") — "), F.col("file_path"), F.when(F.col("start_line") > 0, F.concat(F.lit(":L"), F.col("start_line").cast("string"), F.lit("-L"), F.col("end_line").cast("string"))).otherwise(F.lit(""))).alias("line")).distinct(),
    "snippet_clip": lambda s, d: _signature_nodes(s, d).where("snippet is not null").select("id", F.when(F.length("snippet") > 400, F.concat(F.substring("snippet", 1, 400), F.lit("\n... [clipped]"))).otherwise(F.col("snippet")).alias("clipped")).distinct(),
    "intent_class": _intent,
    "first_match_line": lambda s, d: _docs(s, d).select("doc_id", "text", (F.instr("text", ".") - 1).alias("p")).where("p >= 0").select("doc_id", S.line_of(F.col("text"), F.col("p")).alias("line_no")),
    "document_budget": lambda s, d: _docs(s, d).select("doc_id", F.size(L.split_lines(F.col("text"))).alias("lines"), F.octet_length("text").alias("bytes"), F.array_max(F.transform(L.split_lines(F.col("text")), lambda x: F.length(x))).alias("longest")).withColumn("violations", F.concat_ws(",", F.when(F.col("lines") > 200, "lines"), F.when(F.col("bytes") > 25600, "bytes"), F.when(F.col("longest") > 150, "width"))),
    "markdown_sections": lambda s, d: _lines(s, d).groupBy("doc_id").agg(F.count_if(F.col("line").rlike("^#{1,2} ")).alias("sections"), F.count_if(F.col("line").rlike("^[-*] ")).alias("bullets"), F.count_if(F.col("line").rlike("^>")).alias("quotes")),
}

SQL = {
    "line_entropy": "WITH c AS (SELECT doc_id, ch, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text IS NOT NULL) WHERE ch <> '' GROUP BY 1, 2) SELECT doc_id, round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 4) AS entropy FROM c GROUP BY 1",
    "entropy_filter_keep_blank": f"WITH {_LS}, f AS (SELECT doc_id, i, line FROM (SELECT *, trim(line) AS t FROM l) WHERE length(t) < 10 OR {_ENT.format(s='t')} >= 3.0) " + _OUT.format(src="f"),
    "entropy_filter_strict": f"WITH {_LS}, f AS (SELECT doc_id, i, line FROM (SELECT *, trim(line) AS t FROM l) WHERE {_ENT.format(s='t')} >= 3.5) " + _OUT.format(src="f"),
    "token_estimates": "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS by_floor, greatest(1, (length(text) + 3) // 4) AS by_ceil, round_even(strlen(text) / 4, 0)::BIGINT AS by_bytes FROM documents WHERE text IS NOT NULL",
    "collapse_blanks": f"WITH {_LS}, {_BL} " + _OUT.format(src="k"),
    "collapse_duplicates": f"WITH {_LS}, {_RUN.format(src='l')} " + _OUT.format(src="r"),
    "head_tail_rescue": f"WITH {_LS}, {_HT.format(src='l', err=_ERR)} " + _OUT.format(src="t"),
    "truncate_lines": f"WITH {_LS}, f AS (SELECT doc_id, i, CASE WHEN length(line) > 60 THEN left(line, 60) || '...' ELSE line END AS line FROM l) " + _OUT.format(src="f"),
    "ansi_strip": "SELECT doc_id, text AS out FROM documents WHERE text IS NOT NULL",
    "generic_filter": f"WITH {_LS}, {_BL}, {_RUN.format(src='k')}, {_HT.format(src='r', err=_ERR)} " + _OUT.format(src="t"),
    "error_lines": f"WITH {_LS} SELECT doc_id, i, line FROM l WHERE {_ERR}",
    "grep_lines": f"WITH {_LS} SELECT doc_id, i + 1 AS line_no, line FROM l WHERE regexp_matches(line, '(?i)walker|dateibaum')",
    "savings_summary": "SELECT " + _SAVE,
    "savings_by_command": "SELECT event_type, " + _SAVE + " GROUP BY event_type",
    "secret_hits": "SELECT id, rule FROM (SELECT DISTINCT id, snippet FROM nodes) n, (SELECT unnest(['" + "', '".join(n for n, _ in _SECRETS) + "']) AS rule) r WHERE CASE rule " + " ".join(f"WHEN '{n}' THEN regexp_matches(snippet, {_q(p)})" for n, p in _SECRETS) + " END",
    "pii_counts": "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, {_q(p)})) AS {k}" for k, p in _PII) + f""",
 len(list_filter(list_transform(regexp_extract_all(text, {_q(_PII[3][1])}), lambda c: regexp_replace(c, '[^0-9]', '', 'g')), lambda g: length(g) BETWEEN 13 AND 16 AND
 list_sum(list_transform(range(length(g)), lambda k: CASE WHEN k % 2 = 0 THEN substr(g, length(g) - k, 1)::INT ELSE (2 * substr(g, length(g) - k, 1)::INT) // 10 + (2 * substr(g, length(g) - k, 1)::INT) % 10 END)) % 10 = 0)) AS valid_cards FROM documents WHERE text IS NOT NULL""",
    "luhn_cards": """SELECT o_orderkey, list_sum(list_transform(range(16), lambda k: CASE WHEN k % 2 = 0 THEN substr(g, 16 - k, 1)::INT ELSE (2 * substr(g, 16 - k, 1)::INT) // 10 + (2 * substr(g, 16 - k, 1)::INT) % 10 END)) % 10 = 0 AS valid
FROM (SELECT o_orderkey, '45391488' || lpad(o_orderkey::VARCHAR, 8, '0') AS g FROM orders)""",
    "threat_scan": f"WITH {_LS}" + " SELECT doc_id, i + 1 AS line_no, family, left(trim(line), 100) AS snippet FROM (" + " UNION ALL ".join(f"SELECT *, '{n}' AS family FROM l WHERE regexp_matches(line, {_q(p)})" for n, p in _THREATS) + ")",
    "slugs": "SELECT DISTINCT id, left(CASE WHEN c = '' THEN 'mem-node' WHEN c IN (" + ", ".join(f"'{x}'" for x in S.RESERVED) + ") THEN 'mem-' || c ELSE c END, 60) AS slug FROM (SELECT id, regexp_replace(regexp_replace(lower(translate(qualified_name, '/\\', '--')), '[^a-z0-9_-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS c FROM nodes WHERE qualified_name IS NOT NULL)",
    "safe_names": """SELECT DISTINCT id, CASE WHEN x = '' THEN 'unnamed' ELSE left(x, 200) END AS file, CASE WHEN c = '' THEN '_' ELSE c END AS component FROM (SELECT id,
 regexp_replace(regexp_replace(regexp_replace(translate(name || ' (x)', '/\\: ', '---_'), '[()]', '', 'g'), '[<>:"/\\\\|?*#%\\x00-\\x1f\\x7f]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS x,
 regexp_replace(regexp_replace(qualified_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS c FROM nodes WHERE name IS NOT NULL)""",
    "doc_paths": """SELECT DISTINCT id, 'docs/' || regexp_replace(coalesce(file_path, 'unknown'), '([^/])\\.[^./]*$', '\\1') || '/' || CASE WHEN c = '' THEN '_' ELSE c END || '.md' AS path FROM (SELECT id, file_path,
 regexp_replace(regexp_replace(qualified_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS c FROM nodes WHERE kind IN ('class', 'function', 'method'))""",
    "content_sha": "SELECT DISTINCT id, sha256(coalesce(snippet, '')) AS sha256 FROM nodes",
    "name_words": """SELECT DISTINCT id, word FROM (SELECT id, unnest(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' +')) AS word FROM nodes WHERE name IS NOT NULL) WHERE length(word) >= 2""",
    "map_lines": "SELECT DISTINCT id, name || ' (' || kind || ') — ' || file_path || CASE WHEN start_line > 0 THEN ':L' || start_line || '-L' || end_line ELSE '' END AS line FROM nodes WHERE kind IN ('class', 'function', 'method')",
    "snippet_clip": "SELECT DISTINCT id, CASE WHEN length(snippet) > 400 THEN left(snippet, 400) || chr(10) || '... [clipped]' ELSE snippet END AS clipped FROM nodes WHERE snippet IS NOT NULL",
    "intent_class": "SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{m}'" for m, ws in _INTENT) + " WHEN strlen(text) < 4096 THEN 'full' ELSE 'signatures' END AS mode FROM documents WHERE text IS NOT NULL",
    "first_match_line": "SELECT doc_id, len(string_split(left(text, instr(text, '.') - 1), chr(10))) AS line_no FROM documents WHERE instr(text, '.') > 0",
    "document_budget": f"WITH {_LS} SELECT *, concat_ws(',', CASE WHEN lines > 200 THEN 'lines' END, CASE WHEN bytes > 25600 THEN 'bytes' END, CASE WHEN longest > 150 THEN 'width' END) AS violations FROM (SELECT x.doc_id, len(ls) AS lines, strlen(text) AS bytes, list_max(list_transform(ls, lambda v: length(v))) AS longest FROM x JOIN documents d ON d.doc_id = x.doc_id)",
    "markdown_sections": f"WITH {_LS} SELECT doc_id, count(*) FILTER (regexp_matches(line, '^#{{1,2}} ')) AS sections, count(*) FILTER (regexp_matches(line, '^[-*] ')) AS bullets, count(*) FILTER (regexp_matches(line, '^>')) AS quotes FROM l GROUP BY 1",
}
SQL["spec_filter"] = (
    f"WITH {_LS}, f AS (SELECT l.doc_id, i, line FROM l JOIN documents d ON d.doc_id = l.doc_id WHERE doc_kind = 'changelog' AND (regexp_matches(line, '^#') OR regexp_matches(line, 'Fixed:') OR "
    + " OR ".join(f"regexp_matches(line, {_q(p)})" for p in L.SPEC_ERRORS)
    + f")), b AS (SELECT * FROM f), {_RUN.format(src='f')}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn, count(*) OVER (PARTITION BY doc_id) AS m FROM r), "
    + "t AS (SELECT doc_id, rn AS i, line FROM n WHERE m <= 40 OR rn <= 20 OR rn > m - 20 OR "
    + " OR ".join(f"regexp_matches(line, {_q(p)})" for p in L.SPEC_ERRORS)
    + " UNION ALL SELECT DISTINCT doc_id, 20.5, '... [' || (m - 40) || ' lines omitted] ...' FROM n WHERE m > 40) "
    + "SELECT d.doc_id, coalesce(o.out, 'no fixes') AS out FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS out FROM t GROUP BY 1) o ON o.doc_id = d.doc_id WHERE d.doc_kind = 'changelog' AND d.text IS NOT NULL"
)
SQL["savings_record"] = f"WITH {_LS}, {_BL}, {_RUN.format(src='k')}, {_HT.format(src='r', err=_ERR)}, o AS ({_OUT.format(src='t')}) SELECT d.doc_id, greatest(1, (length(text) + 3) // 4) AS raw, greatest(1, (length(out) + 3) // 4) AS filtered, greatest(0, greatest(1, (length(text) + 3) // 4) - greatest(1, (length(out) + 3) // 4)) AS saved FROM documents d JOIN o ON o.doc_id = d.doc_id"
