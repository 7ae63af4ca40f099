"""Rule, redaction and naming queries, with their SQL; commands, which no table holds, are given inline."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.core import table
from arborlake.functions import redact as X
from arborlake.functions import rules as R
from arborlake.functions.lines import SPECS
from arborlake.sources.files import design_tokens, front_matter

COMMANDS = [
    "git status", "git push origin main --force", "git push --force CONFIRMED", "rm -rf /", "rm -rf build", "uv run pytest -q", "pytest -q | tail", "filtered -- git log", "", "make all", "docker ps -a", "docker exec x sh",
    "terraform destroy", "psql -c 'DROP TABLE t'", "kubectl delete pod x -n prod", "npm run build", "tail -f log", "/usr/bin/git commit -m secret", "cargo.exe build --release", "format c:", "echo hi",
]
DESCRIPTIONS = ["Add the user login API to my app", "Fix DB", "I want to do it", "Parse big JSON logs with fast path lookups now", "a b c"]


def _commands(s):
    return s.createDataFrame([(i, c) for i, c in enumerate(COMMANDS)], "i int, command string")


def _inline(rows):
    return "(SELECT * FROM (VALUES " + ", ".join("(%d, '%s')" % (i, r.replace("'", "''")) for i, r in enumerate(rows)) + ") v(i, x))"


QUERIES = {
    "command_route": lambda s, d: _commands(s).select("i", R.route_command(F.col("command")).alias("spec")),
    "rewrite_decision": lambda s, d: _commands(s).select("i", R.rewrite_decision(F.col("command")).alias("r")).select("i", "r.action", "r.reason", "r.command"),
    "deny_guard": lambda s, d: _commands(s).select("i", R.denied(F.col("command")).alias("reason")),
    "command_redaction": lambda s, d: _commands(s).select("i", X.hidden_command(F.col("command")).alias("shown")),
    "branch_words": lambda s, d: s.createDataFrame(list(enumerate(DESCRIPTIONS)), "i int, x string").select("i", R.branch_words(F.col("x")).alias("name")),
    "numeric_prefix": lambda s, d: table(s, d, "orders").select("o_orderkey", R.numeric_prefix(F.concat(F.lpad(F.col("o_orderkey").cast("string"), 4, "0"), F.lit("-x"))).alias("n")),
    "redact_spans": lambda s, d: X.redact(table(s, d, "documents").where("text is not null").select("doc_id", "text")),
    "redact_snippets": lambda s, d: X.redact(table(s, d, "nodes").where("snippet is not null").select("id", "snippet").distinct(), "snippet").where("redactions > 0"),
    "payload_fields": lambda s, d: table(s, d, "events").select("event_id", R.first_field(F.col("props"), "$.missing", "$.k").alias("k")),
    "valid_names": lambda s, d: table(s, d, "nodes").where("name is not null").select("id", R.valid_name(F.regexp_replace(F.lower("name"), "_", "-")).alias("ok")).distinct(),
    "contained_paths": lambda s, d: table(s, d, "discovered_files").select("rel_path", R.inside(F.col("abs_path"), "/srv/scan/00").alias("ok")).distinct(),
    "list_entry_counts": lambda s, d: table(s, d, "documents").where("doc_kind = 'changelog' and text is not null").select("doc_id", F.size(R.list_entries(F.split("text", "\n"))).alias("entries")),
    "front_matter": lambda s, d: front_matter(table(s, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("---\ntitle: 'T'\nkind: x\nenv: no\n---\n"), F.col("text")).alias("text"))).select("path", F.element_at("meta", "title").alias("title"), F.size("meta").alias("keys"), F.length("body").alias("n")),
    "design_tokens": lambda s, d: design_tokens(s.createDataFrame([("a.css", ":root { --ink: #222; --gap-1: 4px }"), ("t.json", '{"ink": {"$value": "#222222"}, "sea": { "value": "teal" }}')], "path string, text string")),
    "patched_files": lambda s, d: table(s, d, "discovered_files").where("content is not null").select("rel_path", R.unique_patch(F.col("content"), "class ", "type ").alias("p")).distinct().select("rel_path", F.col("p.error").alias("error"), F.sha2("p.text", 256).alias("sha")),
}
_C = _inline(COMMANDS)
_PROG = r"regexp_replace(lower(string_split_regex(string_split_regex({x}, '\s+')[1], '[/\\]')[-1]), '\.(?:exe|cmd|bat)$', '')"
_ROUTE = "CASE " + " ".join(f"WHEN regexp_matches(x, '^(?:{p.match_command})') THEN '{p.name}'" for p in sorted(SPECS, key=lambda p: p.name)) + " END"
_KNOWN = "(" + " OR ".join(f"(prog = '{p}'" + (")" if v is None else " AND sub IN (" + ", ".join(f"'{y}'" for y in v.split()) + "))") for p, v in R.REWRITTEN.items()) + ")"
_SAFE = "(" + " OR ".join(f"(prog = '{p}' AND lower(sub) IN (" + ", ".join(f"'{y}'" for y in v.split()) + "))" for p, v in X.SAFE_SUBCOMMANDS.items()) + ")"
SQL = {
    "command_route": f"SELECT i, {_ROUTE} AS spec FROM {_C}",
    "rewrite_decision": rf"""SELECT i, CASE WHEN reason = 'token_filter_candidate' THEN 'rewrite' ELSE 'skip' END AS action, reason, CASE WHEN reason = 'token_filter_candidate' THEN 'filtered -- ' || trim(x) ELSE x END AS command FROM (
 SELECT *, CASE WHEN trim(x) = '' THEN 'empty_command' WHEN regexp_matches(x, '^filtered\s') THEN 'already_wrapped' WHEN regexp_matches(x, '{R.COMPOUND}') THEN 'compound_or_pipe' WHEN NOT coalesce({_KNOWN} OR ({_ROUTE}) IS NOT NULL, false) THEN 'no_rewrite_candidate' ELSE 'token_filter_candidate' END AS reason FROM (
 SELECT *, {_PROG.format(x='y')} AS prog, string_split_regex(y, '\s+')[2] AS sub FROM (SELECT *, regexp_replace(trim(x), '^(?:uv\s+run|poetry\s+run)\s+', '') AS y FROM {_C})))""",
    "deny_guard": f"SELECT i, CASE " + " ".join(f"WHEN regexp_matches(x, '{p.replace(chr(39), chr(39) * 2)}')" + (f" AND NOT contains(x, '{R.MARKER}')" if e else "") + f" THEN '{r}'" for p, r, e in R.DENIED) + f" END AS reason FROM {_C}",
    "command_redaction": rf"""SELECT i, CASE WHEN trim(x) = '' THEN '' WHEN len(p) = 1 THEN p[1] WHEN coalesce({_SAFE}, false) THEN p[1] || ' ' || p[2] || CASE WHEN len(p) > 2 THEN ' [args redacted]' ELSE '' END ELSE p[1] || ' [args redacted]' END AS shown
FROM (SELECT *, {_PROG.format(x='x')} AS prog, string_split_regex(trim(x), '\s+') AS p, string_split_regex(trim(x), '\s+')[2] AS sub FROM {_C})""",
    "numeric_prefix": "SELECT o_orderkey, CASE WHEN length(p) >= 3 THEN p::BIGINT END AS n FROM (SELECT o_orderkey, CASE WHEN length(o_orderkey::VARCHAR) > 4 THEN left(o_orderkey::VARCHAR, 4) ELSE lpad(o_orderkey::VARCHAR, 4, '0') END AS p FROM orders)",
    "payload_fields": "SELECT event_id, props->>'k' AS k FROM events",
    "valid_names": "SELECT DISTINCT id, regexp_matches(m, '^[a-z0-9]+(?:-[a-z0-9]+)*$') AND length(m) BETWEEN 2 AND 64 AS ok FROM (SELECT id, replace(lower(name), '_', '-') AS m FROM nodes WHERE name IS NOT NULL)",
    "contained_paths": "SELECT DISTINCT rel_path, starts_with(abs_path, '/srv/scan/00/') AS ok FROM discovered_files",
    "list_entry_counts": "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*[-*] '))) AS entries FROM documents WHERE doc_kind = 'changelog' AND text IS NOT NULL",
    "front_matter": "SELECT doc_id::VARCHAR AS path, 'T' AS title, 2 AS keys, length(text) AS n FROM documents WHERE text IS NOT NULL",
    "design_tokens": "SELECT * FROM (VALUES ('a.css', '--ink', '#222'), ('a.css', '--gap-1', '4px'), ('t.json', 'ink', '#222222'), ('t.json', 'sea', 'teal')) v(path, token, value)",
    "patched_files": "SELECT DISTINCT rel_path, CASE n WHEN 0 THEN 'not found' WHEN 1 THEN NULL ELSE 'not unique' END AS error, sha256(CASE WHEN n = 1 THEN replace(content, 'class ', 'type ') ELSE content END) AS sha FROM (SELECT rel_path, content, (length(content) - length(replace(content, 'class ', ''))) // 6 AS n FROM discovered_files WHERE content IS NOT NULL)",
}
