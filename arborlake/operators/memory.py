"""A store of concepts as pages in scopes: listing, saving behind a secret gate, a log of changes, and a verdict on a bundle.

pages: scope, path, text. Pages that cannot be read as a concept are left out of
every listing; index and log pages are no concepts; repeated rows count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.redact import SECRETS
from arborlake.functions.scalars import anchor, slug
from arborlake.operators.concepts import KINDS, one_of
from arborlake.sources.files import front_matter

#: Pages that are no concepts, and bounds of a bundle.
INDEX_PAGES = ("MEMORY.md", "log.md", "index.md")
MAX_LINES, MAX_BYTES = 200, 25 * 1024


def list_concepts(pages: DataFrame, scopes: tuple[str, ...] = ("project", "local"), kind: str | None = None) -> DataFrame:
    """(scope_order, scope, path, id, kind, title): concepts of the scopes in their order, then by path."""
    name = F.element_at(F.split("path", "/"), -1)
    x = pages.where(F.col("scope").isin(*scopes) & F.col("path").endswith(".md") & ~name.isin(*INDEX_PAGES) & F.col("text").isNotNull()).select("scope", "path", "text").distinct()
    m = front_matter(x.withColumn("key", F.concat_ws("\u0001", "scope", "path")), key="key").select(F.split("key", "\u0001").alias("k"), "meta")
    order = F.array_position(F.array(*map(F.lit, scopes)), F.col("k")[0]) - 1
    rows = m.where(F.col("meta")["id"].isNotNull()).select(order.cast("int").alias("scope_order"), F.col("k")[0].alias("scope"), F.col("k")[1].alias("path"), F.col("meta")["id"].alias("id"), one_of(F.coalesce(F.col("meta")["kind"], F.lit("")), KINDS).alias("kind"), F.coalesce(F.col("meta")["title"], F.lit("")).alias("title"))
    return rows if kind is None else rows.where(F.col("kind") == kind)


def holds_secret(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for _, p in SECRETS))


def save_concepts(concepts: DataFrame, pages: DataFrame, scope: str = "project") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages after, refused (id, reason), log (ts, action, id, title)): concepts (id, kind, title, summary, body, ts) written over the pages of a scope.

    Nothing with a secret is stored in a tracked scope; local is not tracked. Of
    several versions of an id the newest counts.
    """
    new = concepts.where("id is not null").groupBy("id").agg(F.max(F.struct("ts", "kind", "title", "summary", "body")).alias("m")).select("id", "m.*")
    secret = holds_secret(F.concat_ws(" ", "body", "summary")) & F.lit(scope != "local")
    refused = new.where(secret).select("id", F.lit("secret").alias("reason"))
    kept = new.where(~F.coalesce(secret, F.lit(False))).withColumn("kind", one_of(F.coalesce("kind", F.lit("")), KINDS))
    quoted = lambda c: F.to_json(F.array(F.coalesce(c, F.lit(""))))
    value = lambda c: F.substring(quoted(F.col(c)), 2, 1_000_000_000)
    line = lambda k, c: F.concat(F.lit(f"{k}: "), F.regexp_replace(value(c), r"\]$", ""), F.lit("\n"))
    text = F.concat(F.lit("---\n"), line("id", "id"), F.lit("kind: "), "kind", F.lit("\n"), line("title", "title"), line("summary", "summary"), F.lit("---\n\n"), F.trim(F.coalesce("body", F.lit(""))), F.lit("\n"))
    written = kept.select(F.lit(scope).alias("scope"), F.concat_ws("/", "kind", F.concat(slug(F.col("id")), F.lit(".md"))).alias("path"), text.alias("text"))
    after = pages.select("scope", "path", "text").join(written.select("scope", "path"), ["scope", "path"], "left_anti").unionByName(written)
    log = kept.select("ts", F.lit("SAVED").alias("action"), "id", "title")
    return after, refused, log


def change_log(entries: DataFrame, top: int | None = None) -> DataFrame:
    """(ts, line) newest first; ties by id."""
    x = entries.select("ts", "id", F.concat(F.lit("## "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("Z - ["), F.upper("action"), F.lit("] `"), "id", F.lit("`: "), F.coalesce("title", F.lit(""))).alias("line")).orderBy(F.desc("ts"), "id")
    return (x if top is None else x.limit(top)).select("ts", "line")


def bundle_verdict(concepts: DataFrame, pages: DataFrame, current: DataFrame) -> DataFrame:
    """One row (total, lines, bytes, within_budget, stale, broken, valid) of a bundle.

    concepts: id, relations (ids), sources (array of struct resource, sha256).
    pages: text of the index pages. current: path, sha256 of the sources as they
    are now; a source is stale if it is gone, its anchor is no anchor, or its hash
    differs. A relation is broken if it names a concept of the store that is not there.
    """
    ids = concepts.select("id").distinct()
    rel = concepts.select("id", F.explode("relations").alias("target")).where("target like 'mem-%'").distinct()
    broken = rel.join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    src = concepts.select("id", F.explode("sources").alias("s")).select("id", "s.resource", "s.sha256").distinct()
    path = F.substring_index("resource", "#", 1)
    bad = F.col("resource").contains("#") & ~anchor(F.col("resource"))["valid"]
    seen = src.withColumn("path", path).join(current.select("path", F.col("sha256").alias("now")), "path", "left")
    stale = seen.where(F.col("now").isNull() | bad | (F.col("now") != F.col("sha256"))).select("id", "resource").distinct()
    size = pages.agg(F.coalesce(F.sum(F.size(F.split("text", "\n"))), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    one = lambda d, n: d.agg(F.count(F.lit(1)).alias(n)).withColumn("k", F.lit(1))
    x = one(ids, "total").join(one(stale, "stale"), "k").join(one(broken, "broken"), "k").join(size.withColumn("k", F.lit(1)), "k").drop("k")
    x = x.withColumn("within_budget", (F.col("lines") <= MAX_LINES) & (F.col("bytes") <= MAX_BYTES))
    return x.withColumn("valid", F.col("within_budget") & (F.col("stale") == 0)).select("total", "lines", "bytes", "within_budget", "stale", "broken", "valid")
