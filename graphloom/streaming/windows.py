"""Blocks that arrive as a stream: counts by kind in windows of event time, and the degree of each function as its events come in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def arriving(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """path: a folder or a pattern."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def windowed_kinds(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n); works on streams and on tables alike."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "kind", "n")


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over all that has arrived, and returns its final rows.

    Each batch writes only the windows that it changed, so that state holds windows which the watermark hasn't passed and nothing else; rows
    that come later than that are dropped. Of each window and kind the row of the last batch is final. Offsets and state lie in the folder, so a run that
    breaks off goes on where it was, and a batch that is written again takes its own place.
    """
    spark, run = stream.sparkSession, uuid.uuid4().hex
    out = f"{folder}/{run}/rows"
    write = lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}")
    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/{run}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("start", "kind").agg(F.max_by("n", "batch").alias("n"))
