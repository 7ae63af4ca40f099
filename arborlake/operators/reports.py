"""Checks of written reports, guides and manifests: rule tables over documents, results as finding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions import scalars as S

HEX = r"#[0-9a-fA-F]{6}\b|#[0-9a-fA-F]{3}\b"


def unquoted(text: Column) -> Column:
    """The text without lines that quote."""
    return F.regexp_replace(text, r"(?m)^\s*>.*(?:\n|$)", "")


def claims_status(text: Column, word: str = "pass") -> Column:
    """Whether an unquoted status line claims the word."""
    return unquoted(text).rlike(rf"(?im)^\W*(?:status|verdict|result)\W+.*\b{word}")


def report_findings(reports: DataFrame, today: str, max_age: int = 30, version: str | None = None) -> DataFrame:
    """(doc, level, check): stale or undated reports, a claimed pass with open boxes, a reviewer who is the author, another version."""
    t = F.col("text")
    dated = F.nullif(F.regexp_extract(t, r"(?im)^\W*date\W+([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")).cast("date")
    age = F.datediff(F.lit(today).cast("date"), dated)
    open_boxes, done = F.regexp_count(t, F.lit(r"(?m)^\s*[-*] \[ \]")), F.regexp_count(t, F.lit(r"(?m)^\s*[-*] \[[xX]\]"))
    who = lambda k: F.nullif(F.lower(F.trim(F.regexp_extract(t, rf"(?im)^\W*{k}\W+(.+)$", 1))), F.lit(""))
    v = F.nullif(F.regexp_extract(t, r"(?im)^\W*version\W+([0-9][\w.]*)", 1), F.lit(""))
    f = lambda cond, level, check: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(check).alias("check")))
    all_ = F.array(
        f(dated.isNull(), "ERROR", "undated"),
        f(age > max_age, "WARN", "stale"),
        f(claims_status(t) & (open_boxes > 0), "ERROR", "open boxes"),
        f(claims_status(t) & (open_boxes + done == 0), "WARN", "no boxes"),
        f(who("author") == who("reviewer"), "ERROR", "not independent"),
        f(v != F.lit(version) if version else F.lit(False), "WARN", "other version"),
    )
    return reports.select("doc", F.explode(F.filter(all_, lambda x: x.isNotNull())).alias("f")).select("doc", "f.*")


def guide_coverage(docs: DataFrame, guides: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(component, docs): components whose signature is found in documents but that no guide (name) covers."""
    hits = F.filter(F.array(*(F.when(F.col("text").rlike(p), F.lit(n)) for n, p in rules.items())), lambda x: x.isNotNull())
    used = docs.select("doc", F.explode(hits).alias("component")).groupBy("component").agg(F.count(F.lit(1)).alias("docs"))
    return used.join(guides.select(F.col("name").alias("component")).distinct(), "component", "left_anti")


def declared_ratios(docs: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(doc, fg, bg, declared, actual, ok) of lines that state a contrast ratio for two colours."""
    row = rf"({HEX})[^\n#]{{0,40}}({HEX})[^\n#]{{0,40}}?([0-9]+(?:\.[0-9]+)?)\s*(?::\s*1)"
    x = docs.select("doc", F.explode(F.regexp_extract_all("text", F.lit(f"({row})"), 1)).alias("m"))
    fg, bg, said = (F.regexp_extract("m", row, k) for k in (1, 2, 3))
    actual = S.contrast(fg, bg)
    return x.select("doc", fg.alias("fg"), bg.alias("bg"), said.cast("double").alias("declared"), F.round(actual, 2).alias("actual"), (F.abs(said.cast("double") - actual) <= tolerance).alias("ok"))


def gates(skills: DataFrame, known: DataFrame, secret_rules, threat_rules, max_bytes: int = 20_000, max_lines: int = 400) -> DataFrame:
    """(name, gate): admission gates that a skill (name, owner, body, description) fails; known owners (owner) are a register."""
    from arborlake.functions.lines import any_of
    from arborlake.functions.rules import valid_name

    body = F.coalesce("body", F.lit(""))
    owned = skills.join(known.distinct().withColumn("_known", F.lit(True)), "owner", "left")
    lines = F.size(F.split(body, "\n"))
    fail = F.array(
        F.when(F.col("_known").isNull(), "ownership"),
        F.when(~F.coalesce(valid_name(F.col("name")), F.lit(False)), "name"),
        F.when(any_of(body, [p for _, p in secret_rules]), "secrets"),
        F.when(F.exists(F.split(body, "\n"), lambda x: any_of(x, [p for _, p in threat_rules])), "safety"),
        F.when(~body.rlike(r"(?m)^# "), "structure"),
        F.when((F.octet_length(body) > max_bytes) | (lines > max_lines), "quota"),
        F.when(F.length(F.trim(F.coalesce("description", F.lit("")))) < 20, "completeness"),
    )
    return owned.select("name", F.explode(F.filter(fail, lambda x: x.isNotNull())).alias("gate"))


def legacy_entries(text: Column, width: int = 60) -> Column:
    """Array of struct(title, body) from a bulleted memory file: the first sentence is the title."""
    from arborlake.functions.rules import list_entries

    entries = list_entries(F.split(text, "\n"))
    return F.transform(F.filter(entries, lambda e: F.length(F.trim(e)) > 0), lambda e: F.struct(F.substring(F.regexp_extract(e, r"^(.*?)(?:[.!?](?:\s|$)|$)", 1), 1, width).alias("title"), e.alias("body")))


#: Manifests and what they say.
MANIFESTS = (("pyproject.toml", "python"), ("setup.py", "python"), ("package.json", "javascript"), ("Cargo.toml", "rust"), ("go.mod", "go"), ("pom.xml", "java"), ("build.gradle.kts", "kotlin"))


def project_facts(files: DataFrame) -> DataFrame:
    """(repo, languages, has_tests, has_make, is_cli) by the files of a repository; manifests name a language, else its sources do."""
    from arborlake.operators.resolve import language_of

    x = files.where("rel_path is not null").select("rel_path", "content").distinct().withColumn("repo", F.substring_index("rel_path", "/", 1)).withColumn("base", F.element_at(F.split("rel_path", "/"), -1))
    lang = F
    for name, language in MANIFESTS:
        lang = lang.when(F.col("base") == name, language)
    x = x.withColumn("lang", F.coalesce(lang.otherwise(F.lit(None).cast("string")), language_of(F.col("rel_path"))))
    cli = F.coalesce(F.col("base").isin("main.go", "cli.py", "__main__.py", "main.rs") | F.col("content").rlike(r"\[project\.scripts\]|\"bin\"\s*:"), F.lit(False))
    return x.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"), F.max(F.col("rel_path").rlike("/tests?/")).alias("has_tests"), F.max(F.col("base") == "Makefile").alias("has_make"), F.max(cli).alias("is_cli"))


#: Sections and colour pairs of a design document.
SECTIONS = ("colors", "typography", "spacing", "components")
PAIRS = (("text", "background"), ("primary", "background"), ("on-primary", "primary"))


def design_lint(docs: DataFrame, floor: float = 4.5) -> DataFrame:
    """(doc, finding): sections a design document lacks, and declared colour pairs (name: #hex) below the floor."""
    t = F.lower("text")
    missing = F.array(*(F.when(~t.rlike(rf"(?m)^#{{1,3}}\s+{s}"), F.concat(F.lit("missing section: "), F.lit(s))) for s in SECTIONS))
    colour = lambda n: F.nullif(F.regexp_extract(t, rf"(?m)^\W*{n}\W+(#[0-9a-f]{{6}}|#[0-9a-f]{{3}})\b", 1), F.lit(""))
    low = F.array(*(F.when(colour(a).isNotNull() & colour(b).isNotNull() & (S.contrast(colour(a), colour(b)) < floor), F.lit(f"low contrast: {a} on {b}")) for a, b in PAIRS))
    return docs.select("doc", F.explode(F.filter(F.concat(missing, low), lambda x: x.isNotNull())).alias("finding"))


def completed_front_matter(page: Column, name: Column) -> Column:
    """A page with front matter that has a name and a description, added where they are missing."""
    has = page.rlike(r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)")
    block = F.regexp_extract(page, r"(?s)\A---[ \t]*\n(.*?\n)---[ \t]*(?:\n|\z)", 1)
    rest = F.when(has, F.regexp_replace(page, r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)", "")).otherwise(page)
    line = lambda k, v: F.when(block.rlike(rf"(?m)^{k}\s*:"), F.lit("")).otherwise(F.concat(F.lit(f"{k}: "), v, F.lit("\n")))
    return F.concat(F.lit("---\n"), block, line("name", name), line("description", F.concat(F.lit("Notes on "), name)), F.lit("---\n"), rest)


def register_entries(text: Column) -> Column:
    """Array of struct(check, file, expires) from table rows | check | file | date | of a register."""
    row = r"(?m)^\|\s*([\w-]+)\s*\|\s*([\w./-]+)\s*\|\s*([0-9]{4}-[0-9]{2}-[0-9]{2})?\s*\|"
    rows = F.regexp_extract_all(text, F.lit(f"({row})"), 1)
    return F.transform(rows, lambda r: F.struct(F.regexp_extract(r, row, 2 - 1).alias("check"), F.regexp_extract(r, row, 2).alias("file"), F.nullif(F.regexp_extract(r, row, 3), F.lit("")).cast("date").alias("expires")))
