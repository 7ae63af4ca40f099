"""Document audits, coverage checks and registers.

Tags are extracted once a document into an array of structs; every check is an
expression over it or an anti join on (document, id). Nothing crosses documents
but what a rule says must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions import scalars as S

#: Pattern checks (name, level, pattern on a tag), child roles of composite roles, native roles.
TAG_RULES = (
    ("positive-tabindex", "ERROR", r"(?i)\btabindex\s*=\s*[\"']?\s*[1-9]"),
    ("outline-none", "WARN", r"(?i)outline\s*:\s*(?:none|0)\b"),
    ("nullified-alt", "WARN", r"(?i)<img\b[^>]*\balt\s*=\s*[\"']\s*(?:image|photo|picture)\s*[\"']"),
    ("media-autoplay", "ERROR", r"(?i)<(?:video|audio)\b[^>]*\bautoplay\b"),
    ("redundant-alert", "ERROR", r"(?i)role\s*=\s*[\"']alert[\"'][^>]*aria-live|aria-live[^>]*role\s*=\s*[\"']alert[\"']"),
)
CHILD_ROLES = {"tablist": ["tab"], "listbox": ["option"], "menu": ["menuitem", "menuitemcheckbox", "menuitemradio"], "radiogroup": ["radio"], "tree": ["treeitem"], "grid": ["row"]}
NATIVE_ROLES = {"button": "button", "nav": "navigation", "main": "main", "header": "banner", "footer": "contentinfo", "ul": "list", "li": "listitem", "a": "link"}


def tags(pages: DataFrame, key: str = "doc", html: str = "html") -> DataFrame:
    """(doc, ord, tag, name): opening tags outside comments."""
    clean = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return pages.select(F.col(key).alias("doc"), F.posexplode(F.regexp_extract_all(clean, F.lit(r"<[A-Za-z][^<>]*>"), 0)).alias("ord", "tag")).withColumn("name", F.lower(F.regexp_extract("tag", r"^<([A-Za-z0-9]+)", 1)))


def attribute(tag: Column, name: str) -> Column:
    """The quoted value of an attribute, null without it."""
    v = F.regexp_extract(tag, rf"(?i)[\s]{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.when(tag.rlike(rf"(?i)[\s]{name}\s*="), v)


def pattern_findings(t: DataFrame) -> DataFrame:
    """(doc, ord, check, level) by the rule table."""
    hits = F.filter(F.array(*(F.when(F.col("tag").rlike(p), F.struct(F.lit(n).alias("check"), F.lit(lv).alias("level"))) for n, lv, p in TAG_RULES)), lambda x: x.isNotNull())
    return t.select("doc", "ord", F.explode(hits).alias("f")).select("doc", "ord", "f.*")


def clickable_findings(t: DataFrame) -> DataFrame:
    """div and span with a click handler: WARN with role and tabindex, else ERROR."""
    x = t.where("name in ('div', 'span')").where(F.col("tag").rlike(r"(?i)\bon(?:click|keydown)\s*="))
    ok = attribute(F.col("tag"), "role").isNotNull() & F.col("tag").rlike(r"(?i)\btabindex\s*=")
    return x.select("doc", "ord", F.lit("clickable").alias("check"), F.when(ok, "WARN").otherwise("ERROR").alias("level"))


def orphaned_references(t: DataFrame) -> DataFrame:
    """(doc, ref): ids that labels and descriptions point to and the same document lacks."""
    ids = t.select("doc", attribute(F.col("tag"), "id").alias("ref")).where("ref is not null")
    refs = t.select("doc", F.explode(F.split(F.concat_ws(" ", *(attribute(F.col("tag"), a) for a in ("for", "aria-labelledby", "aria-describedby", "aria-controls"))), r"\s+")).alias("ref")).where("ref <> ''").distinct()
    return refs.join(ids, ["doc", "ref"], "left_anti")


def composite_roles(t: DataFrame) -> DataFrame:
    """(doc, role): composite roles without any of their child roles in the document."""
    table = F.create_map(*(x for k, v in CHILD_ROLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    r = t.select("doc", F.lower(attribute(F.col("tag"), "role")).alias("role")).where("role is not null").distinct()
    need = r.where(F.col("role").isin(*CHILD_ROLES)).select("doc", "role", F.explode(F.element_at(table, F.col("role"))).alias("child"))
    have = r.select("doc", F.col("role").alias("child"), F.lit(1).alias("hit"))
    return need.join(have, ["doc", "child"], "left").groupBy("doc", "role").agg(F.max("hit").alias("hit")).where("hit is null").select("doc", "role")


def redundant_roles(t: DataFrame) -> DataFrame:
    table = F.create_map(*(F.lit(x) for kv in NATIVE_ROLES.items() for x in kv))
    return t.where(F.element_at(table, F.col("name")) == F.lower(attribute(F.col("tag"), "role"))).select("doc", "ord", F.lit("redundant-role").alias("check"), F.lit("WARN").alias("level"))


def placeholder_only(t: DataFrame) -> DataFrame:
    """(doc, ord): inputs with a placeholder but no label, by attribute or by a label's for."""
    inputs = t.where("name in ('input', 'textarea')").withColumn("id", attribute(F.col("tag"), "id")).where(attribute(F.col("tag"), "placeholder").isNotNull() & attribute(F.col("tag"), "aria-label").isNull() & attribute(F.col("tag"), "aria-labelledby").isNull())
    labels = t.where("name = 'label'").select("doc", attribute(F.col("tag"), "for").alias("id")).where("id is not null")
    return inputs.join(labels, ["doc", "id"], "left_anti").select("doc", "ord")


def contrast_pairs(palette: DataFrame, floor: float = 4.5) -> DataFrame:
    """(a, b, ratio) of unordered colour pairs (ord, name, hex) of one palette below the floor; a palette is bounded to 500 colours."""
    if palette.limit(501).count() > 500:
        raise ValueError("a palette holds at most 500 colours")
    x, y = palette.alias("x"), F.broadcast(palette).alias("y")
    r = F.round(S.contrast(F.col("x.hex"), F.col("y.hex")), 4)
    return x.join(y, F.col("x.ord") < F.col("y.ord")).select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), r.alias("ratio")).where(F.col("ratio") < floor)


def broken_links(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """(doc, target): relative Markdown links (doc, path, text) whose file (path) is missing."""
    links = docs.select("doc", "path", F.explode(F.regexp_extract_all("text", F.lit(r"\]\(([^)\s#]+)[^)]*\)"), 1)).alias("target")).where(~F.col("target").rlike(r"^(?:[a-z]+:|/|#)"))
    full = F.regexp_replace(F.concat_ws("/", F.nullif(F.regexp_replace("path", "/?[^/]*$", ""), F.lit("")), "target"), r"(?:^|/)\./", "/")
    return links.withColumn("full", F.regexp_replace(full, r"[^/]+/\.\./", "")).join(paths.select(F.col("path").alias("full")).distinct(), "full", "left_anti").select("doc", "target").distinct()


def broken_relations(concepts: DataFrame) -> DataFrame:
    """(id, target): relations to mem-* targets that no concept has (id, relations array)."""
    r = concepts.select("id", F.explode("relations").alias("target")).where("target like 'mem-%'")
    return r.join(concepts.select(F.col("id").alias("target")).distinct(), "target", "left_anti").select("id", "target")


def receipts(claims: DataFrame, runs: DataFrame, window: int = 3) -> DataFrame:
    """(doc, line, value, covered): a claim is covered by a run of lines within the window that shows its value.

    claims: doc, line, value; runs: doc, first, last, values (array). The join is on
    (doc, value), so only runs that show the value meet the claim.
    """
    r = runs.select("doc", "first", "last", F.explode(F.array_distinct("values")).alias("value"))
    hit = claims.join(r, ["doc", "value"], "left").withColumn("ok", F.coalesce(F.col("line").between(F.col("first") - window - 1, F.col("last") + window + 1), F.lit(False)))
    return hit.groupBy("doc", "line", "value").agg(F.max("ok").alias("covered"))


def exceptions_in_force(findings: DataFrame, register: DataFrame, today: str) -> DataFrame:
    """(doc, ord, check, level, exception): findings with the first exception in force on (check, doc), null without.

    register: entry, check, doc, expires (date); an entry without expiry is not in force.
    """
    ok = register.where(F.col("expires").isNotNull() & (F.col("expires") >= F.lit(today).cast("date"))).groupBy("check", "doc").agg(F.min("entry").alias("exception"))
    return findings.join(ok, ["check", "doc"], "left")


def expiry_status(register: DataFrame, today: str) -> DataFrame:
    """(entry, status): missing, expired, soon (14 days) or ok."""
    left = F.datediff("expires", F.lit(today).cast("date"))
    return register.select("entry", F.when(F.col("expires").isNull(), "missing").when(left < 0, "expired").when(left <= 14, "soon").otherwise("ok").alias("status"))


def findings_summary(findings: DataFrame) -> DataFrame:
    """One row (errors, warnings, verdict)."""
    return findings.agg(F.count_if(F.col("level") == "ERROR").alias("errors"), F.count_if(F.col("level") == "WARN").alias("warnings")).withColumn("verdict", F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "pass with warnings").otherwise("pass"))


def upsert_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc, heading, body, position): managed sections replaced, others kept in place, missing ones appended (a full outer join by heading)."""
    o = old.select("doc", F.lower(F.trim("heading")).alias("k"), F.col("heading").alias("oh"), F.col("body").alias("ob"), F.col("pos").alias("op"))
    n = new.select("doc", F.lower(F.trim("heading")).alias("k"), F.col("heading").alias("nh"), F.col("body").alias("nb"), F.col("pos").alias("np"))
    x = o.join(n, ["doc", "k"], "full_outer")
    w = Window.partitionBy("doc").orderBy(F.col("op").asc_nulls_last(), "np", "k")
    return x.select("doc", F.coalesce("oh", "nh").alias("heading"), F.coalesce("nb", "ob").alias("body"), F.row_number().over(w).alias("position"))


def lifecycle(skills: DataFrame, now: int, maturity: int = 100, capacity: int = 50) -> DataFrame:
    """(name, action): young ones stay, unused ones leave, of the rest the least used above capacity leave; ties by SHA-256 of the name."""
    tenure = F.greatest(F.lit(0), F.lit(now) - F.col("anchor"))
    x = skills.withColumn("tenure", tenure).withColumn("state", F.when(tenure < maturity, "young").when((F.col("use") == 0) & (F.col("view") == 0), "idle").otherwise("active"))
    active = x.where("state = 'active'").withColumn("rate", F.col("use") / F.greatest(F.lit(1), "tenure")).withColumn("sha", F.sha2("name", 256))
    kept = active.orderBy(F.desc("rate"), F.desc("sha")).limit(capacity).select("name", F.lit(1).alias("kept"))
    return x.join(kept, "name", "left").select("name", F.when(F.col("state") == "young", "keep").when(F.col("kept") == 1, "keep").otherwise("archive").alias("action"))
