"""A tail of progress rows: what each run began with and where it is now, kept by a stream over restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def summary(rows: DataFrame, run: str, order: list[str], value: str) -> DataFrame:
    """(run, rows, first_value, last_value, delta) by the order of rows; works on a table and on a stream alike."""
    at = F.struct(*order)
    out = rows.groupBy(run).agg(F.count("*").alias("rows"), F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"))
    return out.withColumn("delta", F.col("last_value") - F.col("first_value"))


def tail(spark: SparkSession, folder: str, schema: str, run: str, order: list[str], value: str, state: str, out: str, files: int = 1, every: str | None = None) -> None:
    """Reads what is new in ``folder`` since the last call with this ``state``, ``files`` files a batch, and writes the runs that it changes to ``out``.

    The state of a run is one row, whatever number of rows it has had.  With ``every`` (an interval) it goes on polling until it is stopped.
    A batch that is repeated after a failure writes the same folder again.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/number={number}")

    writer = summary(source, run, order, value).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    writer.start().awaitTermination()


def latest(spark: SparkSession, out: str, run: str, kind: str) -> DataFrame:
    """The last summary of each run that ``tail`` has written."""
    names = ["rows", "first_value", "last_value", "delta"]
    rows = spark.read.schema(f"{run} {kind}, rows long, first_value double, last_value double, delta double, batch long").parquet(f"{out}/*")
    return rows.groupBy(run).agg(*[F.max_by(n, "batch").alias(n) for n in names])
