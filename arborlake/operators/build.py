"""Graph assembly: folders, files and definitions to nodes and containment edges, in declarative steps.

Ids: dir:<path>, file:<path>, <kind>:<path>::<qualified name>, external:<dotted
name>. The first row of an id wins; a repeated symbol of a file at another line
gets the suffix :L<line>. Texts are clipped at 4,000 characters plus a marker.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.core import scratch
from arborlake.operators import resolve as R
from arborlake.operators.resolve import ancestor_folders, symbols

CLIP, MARK = 4000, "\n... [truncated]"


def clip(text: Column, limit: int = CLIP) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(MARK))).otherwise(text)


def folder_nodes(files: DataFrame) -> DataFrame:
    """(id, kind, name, parent_id): one node a folder above a file."""
    f = ancestor_folders(files)
    return f.select(F.concat(F.lit("dir:"), "folder").alias("id"), F.lit("directory").alias("kind"), F.element_at(F.split("folder", "/"), -1).alias("name"), F.concat(F.lit("dir:"), "parent").alias("parent_id"))


def file_nodes(files: DataFrame) -> DataFrame:
    p = F.col("rel_path")
    folder = F.when(F.instr(p, "/") > 0, F.concat(F.lit("dir:"), F.regexp_replace(p, "/[^/]*$", "")))
    return files.where(p.isNotNull()).select(F.concat(F.lit("file:"), p).alias("id"), F.lit("file").alias("kind"), F.element_at(F.split(p, "/"), -1).alias("name"), folder.alias("parent_id")).distinct()


def definition_nodes(payloads: DataFrame) -> DataFrame:
    """(id, kind, name, parent_id): classes, functions and methods with their innermost parent; functions inside another definition are methods."""
    return symbols(payloads).select("id", "kind", "name", "parent_id")


def external_nodes(targets: DataFrame) -> DataFrame:
    """(id, kind, name, parent_id): one placeholder a dotted name, named by its last part."""
    t = targets.where("target like 'external:%'").select("target").distinct()
    return t.select(F.col("target").alias("id"), F.lit("external").alias("kind"), F.element_at(F.split(F.regexp_replace("target", "^external:", ""), r"\."), -1).alias("name"), F.lit(None).cast("string").alias("parent_id"))


def containment(nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, kind): an edge for every node whose parent has a row."""
    return nodes.where("parent_id is not null").join(nodes.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi").select(F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("kind"))


def assemble(files: DataFrame, payloads: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, contains edges) of a source tree; the first row of an id wins."""
    n = reduce(DataFrame.unionByName, (folder_nodes(files), file_nodes(files), definition_nodes(payloads), external_nodes(targets)))
    n = n.groupBy("id").agg(F.min(F.struct("kind", "name", "parent_id")).alias("m")).select("id", "m.*")
    return n, containment(n)


def assemble_graph(files: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a source tree: edges (source_id, target_id, kind, resolved, confidence, score) contain, import, call and inherit.

    One edge an occurrence for calls and imports; scores in hundredths. External
    targets become nodes of their own.
    """
    p = scratch(payloads, "payloads")
    found = R.resolve_imports(R.file_imports(p), files)
    imports = scratch(R.resolved_imports(p, files), "imports")
    calls, defs = R.payload_calls(p, with_source=True)
    defs = scratch(defs, "defs")
    edge = lambda kind, score: ("source_id", F.col("target").alias("target_id"), F.lit(kind).alias("kind"), F.col("resolved").cast("int").alias("resolved"), "confidence", score.alias("score"))
    i = found.withColumn("source_id", F.concat(F.lit("file:"), "file_path")).select(*edge("imports", F.when(F.col("resolved"), 100).otherwise(20)))
    c = R.resolve_calls(calls, defs, imports).join(calls.select("call_id", "source_id"), "call_id").select(*edge("calls", F.col("score")))
    bases = scratch(R.payload_bases(p, defs), "bases")
    h = R.resolve_inheritances(bases, defs, imports).join(bases.select("inh_id", "source_id"), "inh_id").select(*edge("inherits", F.col("score")))
    links = scratch(reduce(DataFrame.unionByName, (i, c, h)), "links")
    nodes, inside = assemble(files, p, links.select(F.col("target_id").alias("target")))
    return nodes, inside.withColumn("resolved", F.lit(1)).withColumn("confidence", F.lit("EXTRACTED")).withColumn("score", F.lit(100)).unionByName(links)
