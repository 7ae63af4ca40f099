"""Ordered rule tables over commands, names and small texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlake.functions.lines import SPECS, FilterSpec

#: Operators of compound commands; programs and subcommands whose output is filtered.
COMPOUND = r"(?:\||&&|;|>|<|\$\(|`)"
REWRITTEN = {"git": "status diff log branch show", "pytest": None, "ruff": "check format", "mypy": None, "cargo": "build check test clippy run", "npm": "test run install build", "pnpm": "test run install build", "yarn": "test run install build", "docker": "build run ps images"}
#: Refused commands (pattern, reason, whether the marker exempts), in order.
DENIED = (
    (r"(?i)\brm\s+(?:-(?:rf|fr)|-r\s+-f|-f\s+-r|--recursive\s+--force|--force\s+--recursive)\b(?:\s+-\S+)*\s+[\"']?(?:/|~)(?:/|\*)?[\"']?(?:\s|$)", "recursive removal of root or home", False),
    (r"(?i)\bgit\s+push\b.*(?:--force(?:-with-lease)?(?:=\S+)?\b|(?:^|\s)-f\b)", "forced push", True),
    (r"(?i)\bgit\s+reset\b.*--hard\b", "hard reset", True),
    (r"(?i)\bDROP\s+(?:TABLE|DATABASE|SCHEMA)\b|\bTRUNCATE\s+(?:TABLE\s+)?\w+", "dropped or truncated table", True),
    (r"(?i)\bmkfs\b|\bdiskpart\b|\bformat ", "disk format", False),
    (r"(?i)\bterraform\s+destroy\b", "destroyed infrastructure", True),
    (r"(?i)\bkubectl\s+delete\b.*\bprod|\bprod.*\bkubectl\s+delete\b", "deletion in production", True),
)
MARKER = "CONFIRMED"
STOP_WORDS = "i a an the to for of in on at by with from is are was were be been being have has had do does did will would should could can may might must shall this that these those my your our their want need add get set".split()


def first_match(value: Column, rules) -> Column:
    """The name of the first (name, pattern) that is found in the value, null without."""
    out = F
    for name, pattern in rules:
        out = out.when(value.rlike(pattern), name)
    return out.otherwise(F.lit(None).cast("string"))


def route_command(command: Column, specs: list[FilterSpec] = SPECS) -> Column:
    """The filter spec for a command: the first by name whose pattern matches."""
    return first_match(command, [(s.name, "^(?:" + s.match_command + ")") for s in sorted(specs, key=lambda s: s.name)])


def rewrite_decision(command: Column, wrapper: str = "filtered") -> Column:
    """struct(action, reason, command): whether a command is wrapped so that its output is filtered."""
    c = F.trim(command)
    inner = F.regexp_replace(c, r"^(?:uv\s+run|poetry\s+run)\s+", "")
    parts = F.split(inner, r"\s+")
    prog = F.regexp_replace(F.lower(F.element_at(F.split(parts[0], r"[/\\]"), -1)), r"\.(?:exe|cmd|bat)$", "")
    known = F.lit(False)
    for p, subs in REWRITTEN.items():
        known = known | ((prog == p) & (F.lit(True) if subs is None else F.coalesce(F.get(parts, F.lit(1)).isin(*subs.split()), F.lit(False))))
    reason = F.when(c == "", "empty_command").when(c.rlike(rf"^{wrapper}\s"), "already_wrapped").when(c.rlike(COMPOUND), "compound_or_pipe").when(~(known | route_command(c).isNotNull()), "no_rewrite_candidate").otherwise("token_filter_candidate")
    go = reason == "token_filter_candidate"
    return F.struct(F.when(go, "rewrite").otherwise("skip").alias("action"), reason.alias("reason"), F.when(go, F.concat(F.lit(f"{wrapper} -- "), c)).otherwise(command).alias("command"))


def denied(command: Column) -> Column:
    """The reason of the first rule that refuses the command, null if none does."""
    ok = command.contains(MARKER)
    out = F
    for pattern, reason, exempt in DENIED:
        hit = command.rlike(pattern)
        out = out.when(hit & ~ok if exempt else hit, reason)
    return out.otherwise(F.lit(None).cast("string"))


def branch_words(description: Column) -> Column:
    """A branch name of up to four telling words: no stop words, three letters or an acronym written in capitals."""
    words = F.filter(F.split(F.regexp_replace(F.lower(description), "[^a-z0-9]", " "), " +"), lambda w: w != "")
    said = F.filter(F.split(F.regexp_replace(description, "[^0-9A-Za-z_]", " "), " +"), lambda w: w != "")
    good = F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & ((F.length(w) >= 3) | F.array_contains(said, F.upper(w))))
    plain = F.slice(words, 1, 3)
    return F.array_join(F.when(F.size(good) == 0, plain).when(F.size(good) == 4, good).otherwise(F.slice(good, 1, 3)), "-")


def fitted_branch(prefix: Column, name: Column, limit: int = 244) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.regexp_replace(F.substring(F.concat(prefix, F.lit("-"), clean), 1, limit), "-+$", "")


def numeric_prefix(name: Column) -> Column:
    """The leading number of three digits or more of a folder name; date stamps have none."""
    return F.when(name.rlike("^[0-9]{3,}-") & ~name.rlike("^[0-9]{8}-[0-9]{6}-"), F.regexp_extract(name, "^([0-9]+)", 1).cast("long"))


def first_field(payload: Column, *paths: str) -> Column:
    """The first string among alternative JSON paths."""
    return F.coalesce(*(F.nullif(F.get_json_object(payload, p), F.lit("")) for p in paths))


def recorded_hash(page: Column) -> Column:
    """The content hash that a page's front matter records, or that its text holds without front matter."""
    head = F.regexp_extract(page, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*\n", 1)
    src = F.when(head != "", head).otherwise(page)
    return F.nullif(F.regexp_extract(src, r"content_hash:\s*([0-9a-fA-F]+)", 1), F.lit(""))


def unique_patch(text: Column, old: str, new: str) -> Column:
    """struct(text, error): old replaced by new if it occurs exactly once."""
    n = (F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)
    return F.struct(F.when(n == 1, F.replace(text, F.lit(old), F.lit(new))).otherwise(text).alias("text"), F.when(n == 0, "not found").when(n > 1, "not unique").alias("error"))


def valid_name(name: Column) -> Column:
    """2 to 64 lower-case letters, digits and single hyphens, not reserved."""
    from arborlake.functions.scalars import RESERVED

    return name.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$") & F.length(name).between(2, 64) & ~name.isin(*RESERVED)


def scope_folder(scope: Column) -> Column:
    """The folder of a memory scope."""
    return F.when(scope == "project", "memory").when(scope == "local", "memory-local").when(scope == "user", "~/memory").when(scope.startswith("agent:"), F.concat(F.lit("memory/agents/"), F.substring(scope, 7, 200))).when(scope.startswith("agent-local:"), F.concat(F.lit("memory-local/agents/"), F.substring(scope, 13, 200)))


def inside(path: Column, root: str) -> Column:
    """Whether a normalized path is the root or below it, without parent steps."""
    return ((path == root) | path.startswith(root.rstrip("/") + "/")) & ~F.concat(path, F.lit("/")).contains("/../")


def list_entries(lines: Column) -> Column:
    """Entries of a bulleted list: a bullet starts one, other lines continue it."""
    return F.aggregate(
        lines,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.rlike(r"^\s*[-*] "), F.concat(acc, F.array(F.regexp_replace(x, r"^\s*[-*] ", "")))).when((F.size(acc) > 0) & (F.trim(x) != ""), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), F.trim(x))))).otherwise(acc),
    )


def decision(line: Column) -> Column:
    """struct(choice, title) of a decision heading that ends in SOUND, UNSOUND or NEEDS-USER."""
    p = r"^#{2,4}\s+(.*?)\s*[—:-]\s*(SOUND|UNSOUND|NEEDS-USER)\s*$"
    return F.struct(F.nullif(F.regexp_extract(line, p, 2), F.lit("")).alias("choice"), F.nullif(F.regexp_extract(line, p, 1), F.lit("")).alias("title"))
