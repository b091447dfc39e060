"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from boxquarry.sources.scratch import scratch_path as new_path


def cut(frame: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: lost executors need no work before this again."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Delete the files of a table that ``cut`` has written, once nothing reads it any more."""
    spark = frame.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def reclaim(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished jobs: it does so once the driver's collector has found their plans unused."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucketed(frame: DataFrame, key: str, name: str) -> DataFrame:
    """Like ``cut``, as a table bucketed by ``key``: later joins on it don't shuffle these rows."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).format("parquet").saveAsTable(table)
    return spark.table(table)


def drop_bucketed(frame: DataFrame) -> None:
    """Drop a table that ``bucketed`` has written, and its files, once nothing reads it any more."""
    spark, files = frame.sparkSession, frame.inputFiles()
    name = files[0].rsplit("/", 2)[1].replace("-", "_") if files else None
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(spark.read.schema(frame.schema).parquet(files[0].rsplit("/", 1)[0]))


def free_name(frame: DataFrame, wanted: str) -> str:
    """A column name like ``wanted`` that the frame doesn't have, in any case of letters."""
    taken = {c.lower() for c in frame.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
