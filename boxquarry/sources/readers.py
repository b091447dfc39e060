"""Readers of label files, lists, manifests and reports.  All of them are lazy and split by Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dataset_config(text: str) -> dict:
    """A dataset's YAML settings; ``names`` as a mapping of class number to name, each split as a list of values."""
    import yaml

    out = yaml.safe_load(text) or {}
    if not isinstance(out, dict):
        raise ValueError("a dataset's settings are a mapping")
    names = out.get("names") or {}
    out["names"] = dict(enumerate(names)) if isinstance(names, list) else {int(k): str(v) for k, v in names.items()}
    for split in ("train", "val", "test"):
        value = out.get(split)
        out[split] = [] if value is None else [value] if isinstance(value, str) else list(value)
    return out


def image_list(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(ord, image) of a list's lines, without blank ones and comments; repeats stay, as they count as exposure."""
    lines = spark.read.text(path if isinstance(path, str) else list(path)).select(F.monotonically_increasing_id().alias("ord"), F.trim("value").alias("image"))
    return lines.where((F.col("image") != "") & ~F.col("image").startswith("#"))


def file_inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of files below a folder, once for each path in any case of letters; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    return files.groupBy(F.lower("path").alias("key")).agg(F.min("path").alias("path"), F.min_by("length", "path").alias("length")).drop("key")


def parse_labels(lines: DataFrame, classes: int, fields: int = 5, mode: str = "report", whole_float_class: bool = False) -> DataFrame:
    """Parsed label lines: (file, line_no, class_id, values, problem), from (file, line_no, value).

    mode ``report`` keeps bad lines with their problem, ``lenient`` leaves them out, ``strict`` raises when one is read.
    A class written ``1.0`` counts only with ``whole_float_class``.  Blank lines are no labels.
    """
    parts = F.split(F.trim("value"), r"\s+")
    number = F.element_at(parts, 1)
    class_id = F.floor(number.try_cast("double")).cast("int") if whole_float_class else F.when(number.rlike(r"^[+-]?\d+$"), number.try_cast("int"))
    out = lines.where(F.trim("value") != "").select("file", "line_no", class_id.alias("class_id"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda v: v.try_cast("double")).alias("values"), F.size(parts).alias("_n"))
    problem = (
        F.when(F.col("_n") != fields, "wrong_number_of_fields")
        .when(F.col("class_id").isNull(), "class_is_no_number")
        .when(F.exists("values", lambda v: v.isNull() | F.isnan(v)), "value_is_no_number")
        .when((F.col("class_id") < 0) | (F.col("class_id") >= classes), "class_out_of_range")
        .when(F.exists("values", lambda v: (v < 0) | (v > 1)), "value_out_of_range")
    )
    out = out.withColumn("problem", problem).drop("_n")
    if mode == "lenient":
        return out.where("problem is null")
    if mode == "strict":
        return out.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(" ", "problem", "file"))))
    return out


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of all lines of text files; lines count from 0, blank ones too."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


def manifest(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """A CSV manifest with a header: all columns are strings, quotes and line ends inside them are kept."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("encoding", "UTF-8").csv(path)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return rows


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Objects, one a line; a line that is no object of this schema raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def report(spark: SparkSession, path: str, schema: T.StructType | str, tag: str, multi_line: bool = True) -> DataFrame:
    """JSON reports of one ``schema`` tag, one a file or one a line; another tag raises when it is read."""
    rows = spark.read.schema(schema).option("multiLine", str(multi_line).lower()).option("mode", "FAILFAST").json(path)
    right = F.assert_true(F.col("schema") == tag, F.concat(F.lit("another schema: "), F.coalesce("schema", F.lit("none"))))
    return rows.where(right.isNull())


def optional(spark: SparkSession, read, schema: T.StructType | str) -> DataFrame:
    """What ``read()`` gives, or no rows of ``schema`` if its path doesn't exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


PROPOSALS = """schema string, names map<string,string>, match_iou double, rows array<struct<image:string,source_group:string,labels:array<struct<class_id:int,xyxy:array<double>>>,
predictions:array<struct<class_id:int,confidence:double,xyxy:array<double>,area_ratio:double,gate_class:string,gate_conf:double>>>>"""


def proposals(spark: SparkSession, path: str, tag: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Labels and predictions of a proposal document, numbered within their image."""
    rows = report(spark, path, PROPOSALS, tag, multi_line).select(F.inline("rows"))
    corners = [F.col("x.xyxy")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]
    labels = rows.select("image", "source_group", F.posexplode("labels").alias("label_index", "x")).select("image", "source_group", "label_index", "x.class_id", *corners)
    preds = rows.select("image", "source_group", F.posexplode("predictions").alias("pred_index", "x")).select("image", "source_group", "pred_index", "x.class_id", "x.confidence", *corners, "x.gate_class", "x.gate_conf")
    return labels, preds


def require(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """``rows``, raising when one is read that doesn't meet the condition."""
    return rows.where(F.assert_true(condition, F.lit(message)).isNull())


def latest_run(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The manifest of the run whose folder ``key=name`` has the largest name."""
    runs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(folder).select("path")
    last = runs.agg(F.max(F.regexp_extract("path", f"/({key}=[^/]+)/", 1)).alias("name")).first()["name"]
    return manifest(spark, f"{folder}/{last}")
