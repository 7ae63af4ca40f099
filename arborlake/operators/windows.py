"""Ordered operators that stay distributed when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.core import scratch


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "running") -> DataFrame:
    """df with the sum of value over the rows of the same keys up to and with this one, in the total order given.

    Rows are range-partitioned by keys and order, so a hot key spreads over many
    tasks; each task sums its stretch, and the totals of the stretches, one row a
    key and task, give every stretch its offset. Null order values come first.
    """
    spread = scratch(df.withColumn("_v", value).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_part", *keys).orderBy(*(F.col(o).asc_nulls_first() for o in order)).rowsBetween(Window.unboundedPreceding, 0)
    totals = spread.groupBy("_part", *keys).agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    x = spread.withColumn("_s", F.sum("_v").over(w)).withColumnRenamed("_part", "_p")
    on = [x["_p"] == offsets["_part"], *(x[k].eqNullSafe(offsets[f"_k{i}"]) for i, k in enumerate(keys))]
    return x.join(offsets, on, "left").withColumn(name, F.col("_s") + F.col("_o")).drop("_v", "_s", "_o", "_p", "_part", *(f"_k{i}" for i in range(len(keys))))


def numbered(df: DataFrame, order: list[str], name: str = "number", start: int = 0) -> DataFrame:
    """df with consecutive numbers in the total order given, without meeting in one task."""
    return running_sum(df.withColumn("_all", F.lit(0)), ["_all"], order, F.lit(1), name).withColumn(name, (F.col(name) - 1 + start).cast("long")).drop("_all")


def within_budget(df: DataFrame, keys: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """The first rows of each key whose sizes before them stay below the budget."""
    return running_sum(df.withColumn("_size", size), keys, order, F.col("_size"), "used").where(F.col("used") - F.col("_size") < budget).drop("_size")


def newest(df: DataFrame, keys: list[str], order: list[str], keep: int) -> DataFrame:
    """The last keep rows of each key; ranked before the shuffle, so a hot key sends keep rows a task."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(o).desc_nulls_last() for o in order))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def unique_slugs(df: DataFrame, slug: Column, order: list[str]) -> DataFrame:
    """df with unique_slug: later rows of a slug, ignoring case, get _2, _3 and so on; "index" is taken from the start.

    A made-up name that an own name already holds takes the next number after that name's own count.
    """
    x = df.withColumn("slug", slug).withColumn("_low", F.lower(slug))
    x = running_sum(x, ["_low"], order, F.lit(1), "_n").withColumn("_n", F.col("_n") + F.when(F.col("_low") == "index", 1).otherwise(0))
    taken = x.select(F.col("_low").alias("_made")).distinct().withColumn("_hit", F.lit(1))
    x = x.withColumn("_made", F.when(F.col("_n") > 1, F.concat("_low", F.lit("_"), F.col("_n").cast("string"))))
    x = x.join(taken, "_made", "left")
    return x.withColumn("unique_slug", F.when(F.col("_n") == 1, F.col("slug")).when(F.col("_hit").isNull(), F.concat("slug", F.lit("_"), F.col("_n").cast("string"))).otherwise(F.concat("slug", F.lit("_"), F.col("_n").cast("string"), F.lit("_"), F.substring(F.sha2(F.concat_ws("/", *order), 256), 1, 8)))).drop("_low", "_n", "_made", "_hit")
