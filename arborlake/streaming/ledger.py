"""Structured Streaming forms of the incremental parts: totals, counters, queues, cache upserts.

File sources with checkpointed offsets take the place of byte offsets and
polling; foreachBatch sinks are keyed by batch id or merge by key, so a batch
that is run again leaves the same tables.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.core import bucket, scratch

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Events from a folder that Parquet files are added to."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_totals(events: DataFrame) -> DataFrame:
    """(event_type, runs, raw, filtered, saved): ledger totals, for complete or update mode."""
    raw, kept = F.floor("value").cast("long"), F.get_json_object("props", "$.k").cast("long")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), F.sum(raw).alias("raw"), F.sum(kept).alias("filtered"), F.sum(F.greatest(F.lit(0), raw - kept)).alias("saved"))


def windowed_totals(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A demonstration beyond the batch semantics: totals by tumbling event-time windows, rows later than the watermark dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("runs"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "runs", "value")


def counters(events: DataFrame) -> DataFrame:
    """(user_id, use, view, patch): running counters a user, for update mode."""
    count = lambda t: F.count_if(F.col("event_type") == t)
    return events.groupBy("user_id").agg(count("click").alias("use"), count("view").alias("view"), count("purchase").alias("patch"))


def drain(intents: DataFrame, valid, accepted: str, rejected: str, checkpoint: str):
    """Start draining a queue of intents: each batch lands split by validity in folders named by its id, once."""

    def land(batch: DataFrame, epoch: int) -> None:
        batch = batch.withColumn("_ok", F.coalesce(valid, F.lit(False)))
        batch.where("_ok").drop("_ok").write.mode("overwrite").parquet(f"{accepted}/batch={epoch}")
        batch.where("not _ok").drop("_ok").write.mode("overwrite").parquet(f"{rejected}/batch={epoch}")

    return intents.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_cache(payloads: DataFrame, cache: str, checkpoint: str, buckets: int = 64):
    """Start keeping the newest payload of each file in a table in buckets by path; a batch rewrites the buckets it touches, no others.

    A batch that is run again merges to the same rows.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = scratch(batch.where("file_path is not null").select("file_path", "updated_at", "sha256", "payload_json", bucket("file_path", buckets).alias("bucket")), "batch")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # buckets rows at most
        try:
            rows = new.unionByName(spark.read.schema(new.schema).parquet(cache).where(F.col("bucket").isin(touched)))
        except AnalysisException:  # the first batch
            rows = new
        best = rows.groupBy("bucket", "file_path").agg(F.max(F.struct("updated_at", "sha256", "payload_json")).alias("m"))
        best = scratch(best.select("file_path", "m.updated_at", "m.sha256", "m.payload_json", "bucket"), "merged")
        best.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(cache)

    return payloads.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_memory(result: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now into a table of the session and return it; for tests and small reports."""
    q = result.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return result.sparkSession.table(name)
