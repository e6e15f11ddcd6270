"""The usage log as a stream: sliding windows with late data, and maintenance of a distinct log.

Reading is incremental; windows are closed by a watermark, so state stays bounded by the window length and the
allowed lateness. Retries of an id are dropped while its watermark lives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "id bigint, timestamp bigint, command string, query string, query_len int, result_count int, hit boolean, used_type boolean, used_lang boolean, used_path boolean, used_limit boolean, repo string, indexed_files int"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Usage events of a growing parquet folder, with their event time."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("at", F.timestamp_seconds("timestamp"))


def distinct_events(events: DataFrame, late: str = "2 days") -> DataFrame:
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])


def window_counts(events: DataFrame, length: str = "1 day", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """Totals, hits and results per command and window."""
    w = events.withWatermark("at", late).groupBy(F.window("at", length, slide).alias("w"), "command")
    return w.agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("hits"), F.sum("result_count").alias("results")).select("w.start", "w.end", "command", "total", "hits", "results")


def append_distinct(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the distinct events as they come; a restart resumes from the checkpoint."""
    return distinct_events(events).drop("at").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
