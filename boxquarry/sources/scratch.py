"""A folder that the driver and all executors share, for tables that a query writes and reads again."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the session's spark.checkpoint.dir.

    Where it names none and all tasks run in this process, under a temporary folder; executors elsewhere wouldn't see that.
    """
    top = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="boxquarry-")
            atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
        top = _OWN["dir"]
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: what follows sees one version of them and needs no work before this again."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
