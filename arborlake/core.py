"""Session, table access and the scale helpers every operator shares."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be handled by one task when an operator needs them together.
LOCAL_ROWS = 200_000
#: A broadcast side must stay below this many rows, counted before use.
BROADCAST_ROWS = 50_000

#: Rows of one key from which it is not sent to one task.
HOT_ROWS = 1_000_000

_scratch: list[tuple[SparkSession, str]] = []


def session(app: str = "arborlake", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is tuned for; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local folder on a local master, an error on a cluster."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        there = os.path.join(tempfile.gettempdir(), f"arborlake-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def scratch(df: DataFrame, name: str = "t") -> DataFrame:
    """Write a plan once to the shared folder and go on from the written table.

    Cuts the lineage with files that outlive a lost executor; the files are deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arborlake-scratch/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _scratch.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:
        pass


def drop(df: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more, as of the round before the last."""
    files = df.inputFiles()[:1]
    for spark, path in [x for x in _scratch if files and x[1].rpartition("/")[2] in files[0]]:
        _scratch.remove((spark, path))
        _delete(spark, path)


@atexit.register
def drop_scratch() -> None:
    """Delete every scratch table of this driver."""
    while _scratch:
        _delete(*_scratch.pop())


def pieces(df_rows: int, per_task: int, spark: SparkSession) -> int:
    """Partitions so that none holds more than per_task rows, and all cores have work."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "8")), -(-df_rows // per_task), 1)


def lookup(left: DataFrame, right: DataFrame, key: str, rows: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """left LEFT JOIN right USING (key), where right has one row a key and left, of that many rows, may be skewed.

    Keys with more than hot_rows rows of left (more where that would be over
    BROADCAST_ROWS keys, so their number is bounded by counting) meet their row of
    right by broadcast; the others meet by a shuffle. Keys are compared as equal
    values; a null key finds nothing and is not shuffled.
    """
    most = max(rows // BROADCAST_ROWS, hot_rows)
    if rows > most:
        hot = scratch(left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > most).select(key), "hot")
    if rows <= most or hot.isEmpty():
        none = left.where(F.col(key).isNull())
        return left.where(F.col(key).isNotNull()).join(right, key, "left").unionByName(none.join(F.broadcast(right.limit(0)), key, "left"))
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    stay = F.col("_hot").isNotNull() | F.col(key).isNull()
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    return marked.where(~stay).drop("_hot").join(right, key, "left").unionByName(marked.where(stay).drop("_hot").join(few, key, "left"))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if it has been counted to be at most limit rows, else leave the choice to the planner."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def bucket(col: Column | str, n: int, seed: int = 0) -> Column:
    """A stable bucket number 0..n-1 for a value."""
    return F.pmod(F.xxhash64(col if isinstance(col, Column) else F.col(col), F.lit(seed)), F.lit(n)).cast("int")
