"""Images, labelled boxes and predicted boxes derived from the orders and lineitem tables.

The tables that the engine is tested on have no boxes, so a fixed rule in whole numbers makes them: an order is an image, and
its lines are, by turns, a labelled box (with shifted copies as predictions) and a stray prediction.
Each relation stands here twice: as DataFrames and as SQL for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, WindowSpec
from pyspark.sql import functions as F

#: Lines that one task sorts, on average, in tables of more than a few times as many.
TASK_LINES = 500_000

# Class names and face values by class number.
CLASSES = [
    ("USD_1", "USD", 1.0),
    ("USD_5", "USD", 5.0),
    ("USD_10", "USD", 10.0),
    ("USD_20", "USD", 20.0),
    ("USD_50", "USD", 50.0),
    ("USD_100", "USD", 100.0),
    ("KHR_500", "KHR", 500.0),
    ("KHR_1000", "KHR", 1000.0),
    ("KHR_2000", "KHR", 2000.0),
    ("KHR_5000", "KHR", 5000.0),
    ("KHR_10000", "KHR", 10000.0),
    ("KHR_20000", "KHR", 20000.0),
    ("KHR_50000", "KHR", 50000.0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classes(spark: SparkSession) -> DataFrame:
    """(class_id, class_name, currency, face_value): thirteen rows."""
    rows = [(k, *c) for k, c in enumerate(CLASSES)]
    return F.broadcast(spark.createDataFrame(rows, "class_id long, class_name string, currency string, face_value double").coalesce(1))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("image"),
        F.when(F.col("o_orderkey") % 10 < 8, "train").when(F.col("o_orderkey") % 10 == 8, "val").otherwise("test").alias("split"),
        F.col("o_orderpriority").alias("source_group"),
        F.when(F.col("o_orderkey") % 3 == 0, "synthetic").otherwise("real").alias("source_family"),
        (640 + 64 * (F.col("o_custkey") % 4)).alias("width"),
        (480 + 48 * (F.col("o_custkey") % 3)).alias("height"),
    )


def _order() -> WindowSpec:
    """An order's lines by their number, ties by what a box is made of: lines that are equal in these make equal boxes, so no other column needs to travel."""
    return W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, rn): what all boxes are made of, so that labels and predictions can share one shuffle.

    A large table is dealt to as many tasks as its rows ask for: Spark's own number is fixed, or less by what fits its cores, and what a task holds grew with the table.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    rows = lines.count()
    if rows > 4 * TASK_LINES:
        # no fewer than joins would take, or these would deal the lines again
        lines = lines.repartition(max(-(-rows // TASK_LINES), int(spark.conf.get("spark.sql.shuffle.partitions"))), "l_orderkey")
    return lines.withColumn("rn", F.row_number().over(_order()).cast("long"))


def _placed(lines: DataFrame, *more: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    return lines.select(
        F.col("l_orderkey").alias("image"),
        "rn",
        F.col("l_partkey").alias("p"),
        F.col("l_suppkey").alias("s"),
        (F.col("l_partkey") % 400).alias("x1"),
        (F.col("l_partkey") * 7 % 300).alias("y1"),
        (20 + 3 * q).alias("w"),
        (20 + 2 * q).alias("h"),
        *more,
    )


def gt_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, label_index, class_id, x1, y1, x2, y2)."""
    a = _placed(_lines(spark, sf_dir).where("rn % 2 = 1"))
    return a.select("image", F.expr("(rn - 1) div 2").alias("label_index"), (F.col("s") % 13).alias("class_id"), "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"))


def pred_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, pred_index, class_id, confidence, x1, y1, x2, y2, gate_class, gate_conf)."""
    # copies 0 and 1 of a labelled line are shifted; a line between labels is a stray prediction, copy 2
    copies = "case when rn % 2 = 0 then array(2L) when l_partkey % 5 <> 0 and l_partkey % 4 = 0 then array(0L, 1L) when l_partkey % 5 <> 0 then array(0L) when l_partkey % 4 = 0 then array(1L) else array() end"
    lines = _lines(spark, sf_dir).withColumn("copies", F.expr(copies).cast("array<bigint>"))
    # an index is the number of copies before: a sum in the order of the lines, and the place among the line's own
    lines = lines.withColumn("before", F.sum(F.size("copies")).over(_order().rowsBetween(W.unboundedPreceding, W.currentRow)) - F.size("copies"))
    a = _placed(lines, "before", "copies").select("image", "rn", "p", "s", "x1", "y1", "w", "h", "before", F.posexplode("copies").alias("at", "c"))
    a = a.withColumns({"dx": F.when(F.col("c") == 2, 0).otherwise(F.col("p") % 7 * 2 + F.col("c") * 5), "dy": F.when(F.col("c") == 2, 0).otherwise(F.col("p") % 5)})
    shifted = F.when((F.col("p") % 11 == 0) & (F.col("c") < 2), (F.col("s") + 1) % 13).otherwise(F.col("s") % 13)
    return a.select(
        "image",
        (F.col("before") + F.col("at")).cast("long").alias("pred_index"),
        shifted.alias("class_id"),
        ((F.col("p") * (1 + 2 * F.col("c")) % 1000) / F.lit(1000.0)).alias("confidence"),
        (F.col("x1") + F.col("dx")).alias("x1"),
        (F.col("y1") + F.col("dy")).alias("y1"),
        (F.col("x1") + F.col("dx") + F.col("w")).alias("x2"),
        (F.col("y1") + F.col("dy") + F.col("h")).alias("y2"),
        (F.col("s") % 14).alias("gate_class"),
        (F.col("s") * 37 % 100 / F.lit(100.0)).alias("gate_conf"),
    )


_CLASS_SQL = ", ".join(f"({k}, '{n}', '{c}', {v}::DOUBLE)" for k, (n, c, v) in enumerate(CLASSES))

#: Common table expressions of the same relations.
CTES = {
    "classes": f"classes(class_id, class_name, currency, face_value) AS (VALUES {_CLASS_SQL})",
    "images": """images AS (SELECT o_orderkey AS image, CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split,
  o_orderpriority AS source_group, CASE WHEN o_orderkey % 3 = 0 THEN 'synthetic' ELSE 'real' END AS source_family,
  640 + 64 * (o_custkey % 4) AS width, 480 + 48 * (o_custkey % 3) AS height FROM orders)""",
    "lines": """lines AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS rn,
  l_partkey AS p, l_suppkey AS s, l_partkey % 400 AS x1, l_partkey * 7 % 300 AS y1, 20 + 3 * l_quantity::BIGINT AS w, 20 + 2 * l_quantity::BIGINT AS h FROM lineitem)""",
    "gt": "gt AS MATERIALIZED (SELECT image, (rn - 1) // 2 AS label_index, s % 13 AS class_id, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM lines WHERE rn % 2 = 1)",
    "preds": """copies AS (SELECT *, CASE WHEN c = 2 THEN 0 ELSE p % 7 * 2 + c * 5 END AS dx, CASE WHEN c = 2 THEN 0 ELSE p % 5 END AS dy FROM lines, (VALUES (0), (1), (2)) v(c)
  WHERE CASE c WHEN 0 THEN rn % 2 = 1 AND p % 5 <> 0 WHEN 1 THEN rn % 2 = 1 AND p % 4 = 0 ELSE rn % 2 = 0 END),
preds AS MATERIALIZED (SELECT image, row_number() OVER (PARTITION BY image ORDER BY rn, c) - 1 AS pred_index, CASE WHEN p % 11 = 0 AND c < 2 THEN (s + 1) % 13 ELSE s % 13 END AS class_id,
  (p * (1 + 2 * c) % 1000) / 1000::DOUBLE AS confidence, x1 + dx AS x1, y1 + dy AS y1, x1 + dx + w AS x2, y1 + dy + h AS y2, s % 14 AS gate_class, (s * 37 % 100) / 100::DOUBLE AS gate_conf FROM copies)""",
}


def with_ctes(*names: str, recursive: bool = False) -> str:
    """A WITH clause of these relations and what they need, ending in a comma-free list."""
    wanted = [n for n in CTES if n in names or n == "lines" and {"gt", "preds"} & set(names)]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(CTES[n] for n in wanted)


def sql_area(b: str) -> str:
    return f"(greatest({b}.x2 - {b}.x1, 0) * greatest({b}.y2 - {b}.y1, 0))"


def sql_intersection(a: str, b: str) -> str:
    return f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0))"


def sql_iou(a: str, b: str) -> str:
    both = sql_intersection(a, b)
    union = f"({sql_area(a)} + {sql_area(b)} - {both})"
    return f"(CASE WHEN {union} > 0 THEN {both}::DOUBLE / {union} ELSE 0 END)"
