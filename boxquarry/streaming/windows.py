"""Windowed counts of an event stream."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquarry.sources.scratch import scratch_path


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window and type; events more than ``late`` behind the latest are dropped by a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("begins"), "event_type", "n", "total")


def hourly_counts(spark: SparkSession, path: str) -> DataFrame:
    """All that is in the table now, through a stream with its own checkpoint; the result is read from what the stream wrote.

    The stream runs in update mode, so each window's latest counts win.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    top = scratch_path(spark, "stream")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name if os.path.splitext(name)[1] else "*").parquet(folder)
    counts = windowed(source)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{top}/out/number={number}")

    run = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema("begins timestamp_ntz, event_type string, n long, total double, batch long").parquet(f"{top}/out/*")
    return rows.groupBy("begins", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))
