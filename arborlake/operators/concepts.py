"""Concepts, registers and reports over semi-structured text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.operators.resolve import glob_regex

#: Allowed values of a concept's fields; others fall back to the first.
KINDS = ("fact", "decision", "pattern", "pitfall", "convention", "reference")
STATUSES = ("draft", "stable", "deprecated", "superseded")
CONFIDENCES = ("unverified", "observed", "verified")


def one_of(value: Column, allowed: tuple[str, ...]) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(*allowed), v).otherwise(F.lit(allowed[0]))


def parse_concepts(rows: DataFrame, col: str = "payload") -> DataFrame:
    """Concept records from JSON: unknown enum values fall back, absent lists are empty, unreadable payloads are left out."""
    schema = "id string, kind string, title string, summary string, status string, confidence string, paths array<string>, tags array<string>, relations array<struct<kind:string,target:string>>"
    x = rows.select("*", F.from_json(col, schema).alias("c")).where("c.id is not null")
    empty = F.array().cast("array<string>")
    return x.select(F.col("c.id").alias("id"), one_of(F.col("c.kind"), KINDS).alias("kind"), F.coalesce("c.title", F.lit("")).alias("title"), F.coalesce("c.summary", F.lit("")).alias("summary"), one_of(F.col("c.status"), STATUSES).alias("status"), one_of(F.col("c.confidence"), CONFIDENCES).alias("confidence"), F.coalesce("c.paths", empty).alias("paths"), F.coalesce("c.tags", empty).alias("tags"), F.transform(F.coalesce("c.relations", F.array().cast("array<struct<kind:string,target:string>>")), lambda r: r["target"]).alias("relations"))


def applies_to(patterns: list[str], path: Column) -> Column:
    """Whether a path matches one of the globs; no glob matches all."""
    out = F.lit(not patterns)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


def index_lines(concepts: DataFrame, width: int = 150, rows: int = 192) -> DataFrame:
    """(position, line): pointers of living concepts, stable and verified first, each at most width long, at most rows of them."""
    live = concepts.where(~F.col("status").isin("deprecated", "superseded"))
    order = [F.when(F.col("status") == "stable", 0).otherwise(1), F.when(F.col("confidence") == "verified", 0).otherwise(1), F.lower("title"), F.col("id")]
    top = live.orderBy(*order).limit(rows)
    head = F.concat(F.lit("* ["), "title", F.lit("]("), "id", F.lit(") "))
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("position"), F.substring(F.concat(head, F.col("summary")), 1, width).alias("line"))


def transcript_slice(lines: DataFrame, start: int, clip: int = 4000, budget: int = 200_000) -> DataFrame:
    """(file, ord, text): records from a byte offset on, each clipped, until the budget is used.

    lines: file, ord, offset, text. The running size is per file.
    """
    from arborlake.operators.windows import within_budget

    x = lines.where(F.col("offset") >= start).select("file", "ord", F.substring("text", 1, clip).alias("text"))
    return within_budget(x, ["file"], ["ord"], F.length("text"), budget).select("file", "ord", "text")


#: What may follow or precede a number that claims a measurement.
_UNIT = r"(?:%|ms|s|x|kb|mb|gb|rows|files|tests|lines|passed|failed|seconds|minutes)"


def claims(line: Column) -> Column:
    """The numbers of a line that carry a unit, and hexadecimal ids of 7 to 40 digits."""
    numbers = F.regexp_extract_all(line, F.lit(rf"(?i)\b([0-9]+(?:\.[0-9]+)?)\s?{_UNIT}\b"), 1)
    return F.array_distinct(F.concat(numbers, F.regexp_extract_all(line, F.lit(r"\b((?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{7,40})\b"), 1)))


def page_links(text: Column) -> Column:
    """Links to Markdown pages as links to the built pages."""
    return F.regexp_replace(text, r"\]\(([^)\s:]+)\.md(#[^)]*)?\)", "]($1.html$2)")


def readme_summary(text: Column) -> Column:
    """struct(title, paragraph, commands): first heading, first paragraph that is no heading, up to five commands from fences."""
    title = F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)
    body = F.regexp_replace(text, r"(?s)```.*?```", "")
    paragraph = F.trim(F.regexp_extract(body, r"(?m)^(?![#>\-*|`\s])([^\n]+(?:\n(?![#\s])[^\n]+)*)", 1))
    fences = F.regexp_extract_all(text, F.lit(r"(?s)```(?:bash|sh|shell|console)\n(.*?)```"), 1)
    commands = F.filter(F.flatten(F.transform(fences, lambda f: F.split(f, "\n"))), lambda c: (F.trim(c) != "") & ~c.startswith("#"))
    return F.struct(F.nullif(title, F.lit("")).alias("title"), F.nullif(paragraph, F.lit("")).alias("paragraph"), F.slice(F.transform(commands, lambda c: F.regexp_replace(F.trim(c), r"^\$ ", "")), 1, 5).alias("commands"))


def usage(paths: DataFrame, main: str = "SKILL.md") -> DataFrame:
    """(skill, uses, views): reads of a skill's main file are uses, of its other files views (path)."""
    parts = F.split("path", "/")
    at = F.array_position(parts, "skills")
    x = paths.where((at > 0) & (F.size(parts) > at + 1)).select(F.get(parts, at.cast("int")).alias("skill"), (F.element_at(parts, -1) == main).alias("is_main"))
    return x.groupBy("skill").agg(F.count_if("is_main").alias("uses"), F.count_if(~F.col("is_main")).alias("views"))


def recall_index(keep: DataFrame, pages: DataFrame, width: int = 60) -> DataFrame:
    """(category, entries): kept names with the start of their description, sorted, one line a category.

    The keep list is a bounded register of at most 10,000 names.
    """
    if keep.limit(10_001).count() > 10_000:
        raise ValueError("a keep list holds at most 10,000 names")
    x = keep.join(pages, "name").select(F.coalesce("category", F.lit("general")).alias("category"), F.concat("name", F.lit(": "), F.substring("description", 1, width)).alias("entry"))
    return x.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("entry")), "; ").alias("entries"))


def confidence_report(counts: DataFrame) -> DataFrame:
    """(confidence, n, percent) with whole percents of all edges (confidence, n)."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.select("confidence", "n", F.when(F.lit(total) > 0, F.round(F.col("n") * 100 / F.lit(max(total, 1)), 0)).otherwise(0).cast("int").alias("percent"))


def community_articles(members: DataFrame, top: int = 25) -> DataFrame:
    """(community_id, listed, more): the first members by id and how many are left out (community_id, id)."""
    w = Window.partitionBy("community_id").orderBy("id")
    n = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("n"))
    first = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).groupBy("community_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("listed"))
    return n.join(first, "community_id").select("community_id", "listed", F.greatest(F.lit(0), F.col("n") - top).alias("more"))
