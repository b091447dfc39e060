"""Writers of label files, lists, manifests and reports.  Spark's committer keeps the output of finished tasks only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_label_lines(lines: DataFrame, path: str, key: str = "image") -> None:
    """One folder for each image, with its lines in the order of ``line_no``; lines: (key, line_no, line)."""
    whole = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("value"))
    whole.write.partitionBy(key).text(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.option("header", "true").option("escape", '"').csv(path)


def write_union(frames: list[DataFrame], path: str) -> None:
    """One manifest with the columns of all frames; absent values are empty."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    write_manifest(out, path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_list(rows: DataFrame, path: str, unique: bool = False) -> None:
    """Image paths by ``ord``; ``unique`` keeps each path's first place only."""
    if unique:
        rows = rows.groupBy("image").agg(F.min("ord").alias("ord"))
    rows.repartitionByRange("ord").sortWithinPartitions("ord").select("image").write.text(path)


def append_new(rows: DataFrame, existing: DataFrame, key: list[str], path: str) -> None:
    """Append the rows whose key the existing inventory doesn't have."""
    rows.join(existing, key, "left_anti").write.mode("append").option("header", "true").csv(path)


def report_json(rows: DataFrame) -> DataFrame:
    """Each row as JSON text with its keys in order, without time stamps of its own."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))


def markdown_table(rows: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; over ``most`` rows raise."""
    held = rows.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"over {most} rows are no table for readers")
    line = lambda values: "| " + " | ".join("" if v is None else str(v) for v in values) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *(line(r) for r in held)])
