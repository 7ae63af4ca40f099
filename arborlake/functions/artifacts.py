"""Small rules over paths and pages: routing, source files, template stacks, ignored artifacts, pair tables, front matter, diffs.

Null input gives null or no row unless a docstring says otherwise.
"""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.redact import redact
from arborlake.functions.scalars import contrast

#: Extensions of code, and endings that make a target a file.
CODE = "c cc cpp cxx h hh hpp hxx cs csx go java kt kts scala clj cljs js jsx mjs cjs ts tsx py pyw pyi rb rake rs swift php sh bash zsh fish lua zig pl pm r dart v sv proto sql ex exs erl hrl".split()
FILE_ENDINGS = (".py", ".ts", ".go")
#: Keys that a page's front matter may not set.
FORBIDDEN = ("runtime", "parameters", "executor", "attester")


def is_file_target(target: Column) -> Column:
    """Whether an impact target names a file (a path or a known ending) rather than a symbol."""
    t = F.trim(F.replace(target, F.lit("\\"), F.lit("/")))
    out = t.contains("/")
    for e in FILE_ENDINGS:
        out = out | t.endswith(e)
    return out


def is_source_file(path: Column) -> Column:
    """Whether the extension is one of code; no extension is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1)).isin(CODE)


def template_paths(names: DataFrame, files: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """(name, path): the first existing file of each template's stack: own overrides, own, shared overrides, shared; unsafe names have none."""
    stack = (".agents/templates/overrides/", ".agents/templates/", ".specify/templates/overrides/", ".specify/templates/")
    safe = names.where(F.col(name).rlike(r"^[A-Za-z0-9_][A-Za-z0-9._-]*$") & ~F.col(name).contains("..")).select(F.col(name).alias("name")).distinct()
    wanted = safe.select("name", F.posexplode(F.array(*(F.concat(F.lit(p), "name", F.lit(".md")) for p in stack))).alias("priority", "path"))
    return wanted.join(files.select(F.col(path).alias("path")).distinct(), "path").groupBy("name").agg(F.min_by("path", "priority").alias("path"))


def ignored_artifacts(patterns: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(artifact, pattern): the first ignore rule by line (repository, line_no, pattern) that hides an artifact (repository, artifact)."""
    p = patterns.where("pattern is not null").withColumn("pattern", F.trim("pattern")).where((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))
    exact = p.withColumn("artifact", F.regexp_replace("pattern", "^/+|/+$", ""))
    named = artifacts.join(exact, ["repository", "artifact"])
    every = artifacts.join(p.where(F.col("pattern").isin("*.md", "**/*.md")), "repository")
    hit = named.select("repository", "artifact", "line_no", "pattern").unionByName(every.select("repository", "artifact", "line_no", "pattern"))
    return hit.groupBy("repository", "artifact").agg(F.min_by("pattern", "line_no").alias("pattern"))


def reference_pairs(pages: DataFrame, header: str, page: str = "page", text: str = "text") -> DataFrame:
    """(page, pairing, ratio, normal, large): rows of the table below the header line, up to its first other line."""
    lines = F.transform(F.split(F.col(text), "\r?\n"), lambda x: F.trim(x))
    at = F.array_position(F.transform(lines, lambda x: x.startswith(header)), True).cast("int")
    rest = F.slice(lines, at + 1, F.size(lines))
    stop = F.array_position(F.transform(rest, lambda x: ~x.startswith("|")), True).cast("int")
    rows = F.when(at > 0, F.slice(rest, 1, F.when(stop > 0, stop - 1).otherwise(F.size(rest))))
    cells = pages.select(F.col(page).alias("page"), F.explode(F.filter(rows, lambda x: ~x.startswith("|---"))).alias("row")).select("page", F.transform(F.split(F.regexp_replace("row", r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x)).alias("c")).where("size(c) = 4")
    return cells.select("page", F.col("c")[0].alias("pairing"), F.col("c")[1].try_cast("double").alias("ratio"), F.col("c")[2].alias("normal"), F.col("c")[3].alias("large")).where("ratio is not null")


def recomputed_pairs(pairs: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """pairs with the ratio computed from the two colours in the pairing and whether it agrees."""
    a, b = (F.get(F.regexp_extract_all("pairing", F.lit("(#[0-9A-Fa-f]{6})"), 1), F.lit(k)) for k in (0, 1))
    return pairs.withColumn("computed", F.bround(contrast(a, b), 2)).withColumn("agrees", F.abs(F.col("computed") - F.col("ratio")) <= tolerance)


def evidence_pages(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with the text masked and evidence_path, named by the hash of what is stored; equal evidence has one path."""
    r = redact(rows, text).withColumn(text, F.concat(F.trim(F.col(text)), F.lit("\n")))
    return r.withColumn("evidence_path", F.concat(F.lit("references/evidence-"), F.sha2(F.col(text), 256), F.lit(".md")))


def _scalar(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, (bool, int, float)):
        return json.dumps(v)
    t = str(v)
    plain = t and t == t.strip() and not set(t) & set(":#{}[]&*!|>'\"%@`,\n") and t.lower() not in ("null", "true", "false", "yes", "no", "~") and not t[0].isdigit() and t[0] not in "-?."
    return t if plain else json.dumps(t, ensure_ascii=False)


def dump_front_matter(meta: dict, body: str = "") -> str:
    """A page of a --- block of key: value lines and its body; lists item by item, text of several lines as a block."""
    out = []
    for k, v in meta.items():
        if k in FORBIDDEN:
            continue
        if isinstance(v, (list, tuple)):
            out += [f"{k}:", *(f"- {_scalar(x)}" for x in v)] if v else [f"{k}: []"]
        elif isinstance(v, str) and "\n" in v.strip("\n"):
            out += [f"{k}: |-", *("  " + x for x in v.rstrip("\n").split("\n"))]
        else:
            out.append(f"{k}: {_scalar(v)}")
    tail = body.strip()
    return "---\n" + "\n".join(out) + "\n---\n" + (f"\n{tail}\n" if tail else "")


def load_front_matter(text: str) -> tuple[dict, str]:
    """(meta, body) of a page, with lists and block texts; no or an open block gives an empty meta."""
    lines = text.split("\n")
    if lines[0].strip() != "---" or "---" not in (x.strip() for x in lines[1:]):
        return {}, text
    end = next(k for k in range(1, len(lines)) if lines[k].strip() == "---")
    meta, key, mode = {}, None, ""
    for x in lines[1:end]:
        if key and mode and (x.startswith("  ") or not x.strip()):
            meta[key] += ("\n" if mode == "|" else " ") * bool(meta[key]) + x[2:]
        elif key and x.lstrip().startswith("- ") and isinstance(meta[key], list):
            meta[key].append(_unquoted(x.lstrip()[2:]))
        elif ":" in x and not x.startswith((" ", "#", "-")):
            key, _, v = x.partition(":")
            key, v = key.strip(), v.strip()
            mode = v[0] if v[:1] in ("|", ">") and len(v) <= 2 else ""
            meta[key] = "" if mode else [] if v in ("", "[]") else _unquoted(v)
            if key in FORBIDDEN:
                del meta[key]
                key = None
    return meta, "\n".join(lines[end + 1 :]).strip("\n")


def _unquoted(v: str):
    v = v.strip()
    if v[:1] == '"' and v[-1:] == '"' and len(v) > 1:
        try:
            return json.loads(v)
        except ValueError:
            return v[1:-1]
    if v[:1] == "'" and v[-1:] == "'" and len(v) > 1:
        return v[1:-1].replace("''", "'")
    return {"null": None, "~": None, "true": True, "false": False}.get(v, int(v) if v.lstrip("-").isdigit() else v)


def unified_diff(old: Column, new: Column) -> Column:
    """The unified difference of two texts, three lines of context; equal texts give an empty one, null counts as empty."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["".join(difflib.unified_diff((x or "").splitlines(True), (y or "").splitlines(True), "old", "new")) for x, y in zip(a, b, strict=True)])

    return run(old, new)
