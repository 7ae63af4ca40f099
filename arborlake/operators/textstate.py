"""Operators over lines that carry state, recursive inclusion, and reduced views of code."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.core import scratch
from arborlake.functions.lines import bind, split_lines


def fenced(lines: DataFrame) -> DataFrame:
    """lines (doc_id, i, line) with fence (a fence mark) and inside (between marks), by the parity of marks above."""
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.col("line").rlike(r"^\s*(?:```|~~~)")
    return lines.withColumn("fence", mark).withColumn("inside", ~F.col("fence") & (F.coalesce(F.sum(mark.cast("int")).over(w), F.lit(0)) % 2 == 1))


def receipt_runs(lines: DataFrame) -> DataFrame:
    """(doc_id, first, last, values): runs of fenced or indented lines with the numbers and hexadecimal ids they show."""
    x = fenced(lines).withColumn("shown", F.col("inside") | F.col("line").rlike(r"^(?:    |\t)\S"))
    w = Window.partitionBy("doc_id").orderBy("i")
    x = x.withColumn("new", F.col("shown") & ~F.coalesce(F.lag("shown").over(w), F.lit(False))).withColumn("run", F.sum(F.col("new").cast("int")).over(w)).where("shown")
    values = F.regexp_extract_all("line", F.lit(r"\b([0-9]+(?:\.[0-9]+)?|[0-9a-f]{7,40})\b"), 1)
    return x.groupBy("doc_id", "run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(values)))).alias("values")).drop("run")


def expand_imports(pages: DataFrame, depth: int = 5, per_file: int = 100_000, budget: int = 256_000) -> DataFrame:
    """(root, ord, path, state): files that a page (path, text) pulls in by @path lines, in order of depth and place.

    state is ok, cycle, missing or too large; a cycle is not followed. Depth and
    budget bound the recursion; each level is one join on the referenced path.
    """
    ref = F.regexp_extract_all("text", F.lit(r"(?m)^@(\S+)\s*$"), 1)
    refs = scratch(pages.select("path", F.posexplode(ref).alias("k", "to")), "refs")
    size = pages.select(F.col("path").alias("to"), F.octet_length("text").alias("bytes"))
    level = refs.select(F.col("path").alias("root"), F.array("path", "to").alias("trail"), F.array("k").alias("place"), "to")
    out = None
    for _ in range(depth):
        cycle = F.array_contains(F.slice("trail", 1, F.size("trail") - 1), F.col("to"))
        hit = level.join(size, "to", "left").withColumn("state", F.when(cycle, "cycle").when(F.col("bytes").isNull(), "missing").when(F.col("bytes") > per_file, "too large").otherwise("ok"))
        hit = scratch(hit.select("root", "trail", "place", F.col("to"), "bytes", "state"), "level")
        out = hit if out is None else out.unionByName(hit)
        if hit.where("state = 'ok'").isEmpty():
            break
        level = hit.where("state = 'ok'").join(refs.select(F.col("path").alias("p"), F.col("to").alias("n"), "k"), F.col("to") == F.col("p")).select("root", F.concat("trail", F.array("n")).alias("trail"), F.concat("place", F.array("k")).alias("place"), F.col("n").alias("to"))
    w = Window.partitionBy("root").orderBy("place")
    used = F.sum(F.when(F.col("state") == "ok", F.col("bytes")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("ord", F.row_number().over(w)).withColumn("used", used).select("root", "ord", F.col("to").alias("path"), F.when((F.col("state") == "ok") & (F.col("used") > budget), "over budget").otherwise(F.col("state")).alias("state"))


def signature_view(snippet: Column, signature: Column) -> Column:
    """The signature if there is one, else the lines down to the one that opens the body and the first line of documentation."""

    def run(ls: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: F.rtrim(F.get(ls, i)).rlike("[:{]$"))
        last = F.coalesce(F.get(opens, F.lit(0)), F.lit(0))
        head = F.slice(ls, F.lit(1), last + 1)
        doc = F.get(ls, last + 1)
        return F.array_join(F.when(F.trim(doc).rlike(r"^(?:[rR]?\"\"\"|[rR]?'''|/\*)"), F.concat(head, F.array(doc))).otherwise(head), "\n")

    made = F.when(F.coalesce(snippet, F.lit("")) == "", F.lit("")).otherwise(bind(split_lines(snippet), run))
    return F.when(F.trim(F.coalesce(signature, F.lit(""))) != "", F.trim(signature)).otherwise(made)


def blank_comments(text: str | None) -> str | None:
    """Markup or code with comments and fenced samples blanked, every offset kept."""
    if not text:
        return text
    return re.sub(r"(?s)<!--.*?-->|/\*.*?\*/|```.*?```", lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def pruned_python(text: str | None) -> str | None:
    """Python code with the bodies of functions replaced by ..., documentation kept; unparsable text stays."""
    if not text:
        return text
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return text
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            doc = n.body[:1] if ast.get_docstring(n) is not None else []
            n.body = [*doc, ast.Expr(ast.Constant(...))]
    return ast.unparse(tree)


def apply_text(df: DataFrame, fn, col: str = "text") -> DataFrame:
    """A text function over a column in Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fn(x) if isinstance(x, str) else None)

    return df.withColumn(col, run(F.col(col)))


def budgeted_read(files: DataFrame, budget: int = 4000) -> DataFrame:
    """(rel_path, mode, text): files whole, Python bodies pruned where that is too long, else one line a definition, by token budget."""
    from arborlake.functions.scalars import tokens_floor

    x = files.where("rel_path is not null and content is not null").select("rel_path", F.col("content").alias("full"), F.when(F.col("rel_path").endswith(".py"), F.col("content")).alias("pruned")).distinct()
    x = apply_text(x, pruned_python, "pruned")
    names = F.array_join(F.regexp_extract_all("full", F.lit(r"(?m)^\s*(?:export |public |pub |async )*(?:def|class|func|function|fn|fun|interface|struct)\s+([\w$]+)"), 1), "\n")
    mode = F.when(tokens_floor(F.col("full")) <= budget, "full").when(F.col("pruned").isNotNull() & (tokens_floor(F.col("pruned")) <= budget), "pruned").otherwise("map")
    return x.withColumn("mode", mode).select("rel_path", "mode", F.when(F.col("mode") == "full", F.col("full")).when(F.col("mode") == "pruned", F.col("pruned")).otherwise(names).alias("text"))
