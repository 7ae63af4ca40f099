"""Writers: the graph store, JSON elements, ledgers, and pages written only when they change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("nodes", "edges", "communities", "extract_cache", "meta")


def write_store(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet; a table is replaced by its commit, edges laid out by kind and sorted by target for pruning."""
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"no table of the store: {name}")
        w = df.sortWithinPartitions("target_id").write.partitionBy("kind") if name == "edges" else df.write
        w.mode("overwrite").parquet(f"{folder}/{name}")


def read_store(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that exist, tolerant of older stores that lack some."""
    out = {}
    for name in TABLES:
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}")
        except Exception:
            continue
    return out


def capabilities(store: dict[str, DataFrame]) -> dict[str, bool]:
    """Which optional parts a store has."""
    edges = store.get("edges")
    return {"has_communities": "communities" in store, "has_edge_confidence": edges is not None and "confidence" in edges.columns, "has_cache": "extract_cache" in store}


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(path)


def changed_pages(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pages (path, body) whose text differs from what is there, or that are new."""
    o = old.select("path", F.sha2("body", 256).alias("was"))
    return new.join(o, "path", "left").where(~F.col("was").eqNullSafe(F.sha2("body", 256))).select("path", "body")


def orphans(new: DataFrame, old: DataFrame) -> DataFrame:
    """Paths that this run did not produce."""
    return old.select("path").join(new.select("path"), "path", "left_anti")


def plan_json(plan: DataFrame) -> DataFrame:
    """One JSON document a plan row."""
    return plan.select(F.to_json(F.struct(*plan.columns), {"ignoreNullFields": "false"}).alias("json"))
