"""Queries that balance, cap, repeat and mix rows by class.

Draws are orders of hashes, so every machine draws the same rows.  Caps are window ranks with a limit, which Spark applies
before the shuffle; whole numberings go by sorted ranges, never by one task a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from boxquarry.operators import selection as sel
from boxquarry.plans import adapters as a
from boxquarry.plans.adapters import with_ctes
from boxquarry.plans.registry import query

_BASE = with_ctes("classes", "images", "gt", "preds")

#: Images by their class with the fewest boxes of all, the smaller number first.
_LEADING = f"""{_BASE}, total AS (SELECT class_id, count(*) AS n FROM gt GROUP BY 1),
lead AS (SELECT gt.image, arg_min(class_id, (n, class_id)) AS class_id, count(DISTINCT class_id) AS kinds FROM gt JOIN total USING (class_id) GROUP BY 1),
li AS (SELECT lead.*, split, source_group, source_family FROM lead JOIN images USING (image))"""


def _leading(spark: SparkSession, d: str) -> DataFrame:
    """(image, class_id, kinds, split, source_group, source_family) of images with labels; class_id is their rarest class."""
    q = a.gt_boxes(spark, d)
    total = q.groupBy("class_id").agg(F.count("*").alias("n"))
    lead = q.join(total, "class_id").groupBy("image").agg(F.min_by("class_id", F.struct("n", "class_id")).alias("class_id"), F.countDistinct("class_id").alias("kinds"))
    return lead.join(a.images(spark, d).select("image", "split", "source_group", "source_family"), "image")


def _rank(seed: str) -> str:
    return f"sha256(concat('{seed}:', image))"


def _hash(seed: str) -> Column:
    return sel.hash_order(seed, "image")


@query("i5_exact_sample", f"{_BASE} SELECT image, split FROM images WHERE split = 'val' ORDER BY {_rank('i5')} LIMIT 40")
def i5_exact_sample(spark: SparkSession, d: str) -> DataFrame:
    """Exactly 40 rows, or an error if there are fewer."""
    return sel.exact_sample(a.images(spark, d).where("split = 'val'").select("image", "split"), [_hash("i5")], 40)


@query("i7_duplicate_from_pool", f"{_BASE}, pool AS (SELECT image, row_number() OVER (ORDER BY {_rank('i7')}) - 1 AS k FROM images WHERE split = 'test' ORDER BY k LIMIT 20) SELECT i AS row, image FROM range(70) t(i) JOIN pool ON k = i % 20")
def i7_duplicate_from_pool(spark: SparkSession, d: str) -> DataFrame:
    """Seventy rows from a pool of twenty, in turn."""
    pool = a.images(spark, d).where("split = 'test'").select("image", _hash("i7").alias("h")).orderBy("h").limit(20)
    pool = pool.select("image", (F.row_number().over(W.orderBy("h")) - 1).alias("k"))
    return spark.range(70).withColumnRenamed("id", "row").join(F.broadcast(pool), F.col("row") % 20 == F.col("k")).select("row", "image")


@query("i8_cyclic_take", f"{_LEADING}, pool AS (SELECT class_id, image, row_number() OVER (PARTITION BY class_id ORDER BY {_rank('i8')}) - 1 AS k FROM li WHERE split = 'test' QUALIFY k < 25), n AS (SELECT class_id, count(*) AS n FROM pool GROUP BY 1) SELECT class_id, image, len(range(k, 25, n)) AS times FROM pool JOIN n USING (class_id)")
def i8_cyclic_take(spark: SparkSession, d: str) -> DataFrame:
    """Twenty-five draws a class from its pool, which is gone through again where it is smaller."""
    pool = sel.top_per_group(_leading(spark, d).where("split = 'test'"), ["class_id"], [_hash("i8")], 25, rank="r")
    n = pool.groupBy("class_id").agg(F.count("*").alias("n"))
    return pool.join(n, "class_id").select("class_id", "image", F.ceil((25 - (F.col("r") - 1)) / F.col("n")).cast("long").alias("times"))


@query("i10_empties_sample", f"{_BASE} SELECT image FROM images ANTI JOIN gt USING (image) ORDER BY {_rank('i10')} LIMIT 15")
def i10_empties_sample(spark: SparkSession, d: str) -> DataFrame:
    return a.images(spark, d).join(a.gt_boxes(spark, d), "image", "left_anti").orderBy(_hash("i10")).limit(15).select("image")


@query("i15_class_cap_by_path", f"{_BASE}, p AS (SELECT image, pred_index, class_id, confidence FROM preds QUALIFY row_number() OVER (PARTITION BY class_id, image ORDER BY confidence DESC, pred_index) <= 1) SELECT image, pred_index, class_id FROM p QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY confidence DESC, image, pred_index) <= 30")
def i15_class_cap_by_path(spark: SparkSession, d: str) -> DataFrame:
    """The surest candidates of each class, one an image."""
    p = sel.top_per_group(a.pred_boxes(spark, d), ["class_id", "image"], [F.desc("confidence"), F.asc("pred_index")], 1)
    return sel.top_per_group(p, ["class_id"], [F.desc("confidence"), F.asc("image"), F.asc("pred_index")], 30).select("image", "pred_index", "class_id")


@query("i17_bucket_rows", f"{_BASE}, k AS (SELECT image, CASE WHEN count(DISTINCT class_id) = 1 THEN 'only_' || min(class_id) WHEN bool_or(class_id = 12) THEN 'mixed_with_12' ELSE 'mixed' END AS bucket FROM gt GROUP BY 1) SELECT coalesce(bucket, 'empty') AS bucket, count(*) AS images FROM images LEFT JOIN k USING (image) GROUP BY 1")
def i17_bucket_rows(spark: SparkSession, d: str) -> DataFrame:
    only = F.concat(F.lit("only_"), F.min("class_id").cast("string"))
    bucket = F.when(F.countDistinct("class_id") == 1, only).when(F.bool_or(F.col("class_id") == 12), "mixed_with_12").otherwise("mixed")
    k = a.gt_boxes(spark, d).groupBy("image").agg(bucket.alias("bucket"))
    return a.images(spark, d).join(k, "image", "left").groupBy(F.coalesce("bucket", F.lit("empty")).alias("bucket")).agg(F.count("*").alias("images"))


@query(
    "i20_calibrated_select",
    f"""{_BASE}, b AS (SELECT image, label_index, class_id, (x2 - x1)::DOUBLE AS w, (y2 - y1)::DOUBLE AS h, source_family FROM gt JOIN images USING (image)),
t AS (SELECT class_id, avg(w) AS mw, stddev_samp(w) AS sw, avg(h) AS mh, stddev_samp(h) AS sh FROM b WHERE source_family = 'real' GROUP BY 1),
s AS (SELECT image, label_index, class_id, round(sqrt(pow((w - mw) / greatest(sw, 1e-6), 2) + pow((h - mh) / greatest(sh, 1e-6), 2)), 6) AS distance FROM b JOIN t USING (class_id) WHERE source_family = 'synthetic')
SELECT image, label_index, class_id, distance FROM s QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY distance, image, label_index) <= 15""",
)
def i20_calibrated_select(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic boxes nearest to the real ones of their class, in standard deviations."""
    b = a.gt_boxes(spark, d).join(a.images(spark, d).select("image", "source_family"), "image").select("image", "label_index", "class_id", F.expr("double(x2 - x1)").alias("w"), F.expr("double(y2 - y1)").alias("h"), "source_family")
    t = b.where("source_family = 'real'").groupBy("class_id").agg(F.avg("w").alias("mw"), F.stddev_samp("w").alias("sw"), F.avg("h").alias("mh"), F.stddev_samp("h").alias("sh"))
    part = lambda v, m, s: F.pow((F.col(v) - F.col(m)) / F.greatest(F.col(s), F.lit(1e-6)), 2)
    s = b.where("source_family = 'synthetic'").join(t, "class_id").select("image", "label_index", "class_id", F.round(F.sqrt(part("w", "mw", "sw") + part("h", "mh", "sh")), 6).alias("distance"))
    return sel.top_per_group(s, ["class_id"], [F.col("distance"), F.col("image"), F.col("label_index")], 15)


def _swapped(rows: DataFrame, out: Column, pool: DataFrame) -> DataFrame:
    """``rows`` (ord, image) in which rows of ``out`` have an image of ``pool`` (k, image), in turn, at the same place; with an empty pool they go."""
    n = pool.count()
    gone, kept = rows.where(out), rows.where(~out)
    if not n:
        return kept.select("ord", "image")
    numbered = sel.number_rows(gone.select("ord"), [F.col("ord")], "at").withColumn("k", F.col("at") % n)
    return kept.select("ord", "image").unionByName(numbered.join(F.broadcast(pool), "k").select("ord", "image"))


def _pool(rows: DataFrame, seed: str, most: int) -> DataFrame:
    """(k, image): the first rows in an order of hashes, numbered from 0; ``most`` rows at most."""
    first = rows.select("image", _hash(seed).alias("h")).orderBy("h").limit(most)
    return first.select((F.row_number().over(W.orderBy("h")) - 1).cast("long").alias("k"), "image")


@query(
    "i30_replace_by_prefix",
    f"""{_BASE}, r AS (SELECT image AS ord, image, source_group LIKE '1-%' AS gone FROM images WHERE split <> 'test'), pool AS (SELECT image, row_number() OVER (ORDER BY {_rank('i30')}) - 1 AS k FROM images WHERE split = 'test' ORDER BY k LIMIT 50),
g AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS pos FROM r WHERE gone) SELECT ord, image FROM r WHERE NOT gone UNION ALL SELECT ord, pool.image FROM g JOIN pool ON k = pos % (SELECT count(*) FROM pool)""",
)
def i30_replace_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one prefix give their places in the list to rows of a pool, in turn."""
    i = a.images(spark, d)
    rows = i.where("split <> 'test'").select(F.col("image").alias("ord"), "image", "source_group")
    return _swapped(rows, F.col("source_group").startswith("1-"), _pool(i.where("split = 'test'"), "i30", 50))


@query(
    "r31_hard_negative_swap",
    f"""{_BASE}, hard AS (SELECT image FROM preds ANTI JOIN gt USING (image) WHERE confidence >= 0.5 UNION SELECT image FROM preds WHERE confidence >= 0.97), r AS (SELECT image AS ord, image, image % 17 = 0 AS gone FROM images),
pool AS (SELECT image, row_number() OVER (ORDER BY {_rank('r31')}) - 1 AS k FROM hard ORDER BY k LIMIT 30), g AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS pos FROM r WHERE gone)
SELECT ord, image FROM r WHERE NOT gone UNION ALL SELECT ord, pool.image FROM g JOIN pool ON k = pos % (SELECT count(*) FROM pool)""",
)
def r31_hard_negative_swap(spark: SparkSession, d: str) -> DataFrame:
    p = a.pred_boxes(spark, d)
    hard = p.where("confidence >= 0.97").select("image").unionByName(p.where("confidence >= 0.5").join(a.gt_boxes(spark, d), "image", "left_anti").select("image")).distinct()
    return _swapped(a.images(spark, d).select(F.col("image").alias("ord"), "image"), F.col("image") % 17 == 0, _pool(hard, "r31", 30))


@query(
    "i31_dose_rows",
    f"""{_BASE}, k AS (SELECT image, source_group, row_number() OVER (PARTITION BY source_group ORDER BY image) - 1 AS pos, count(*) OVER (PARTITION BY source_group) AS n FROM images WHERE source_family = 'synthetic'), d(source_group, dose) AS (VALUES ('1-URGENT', 12), ('2-HIGH', 6), ('3-MEDIUM', 3))
SELECT source_group, image FROM k JOIN d USING (source_group) WHERE n <= dose OR pos IN (SELECT unnest([round_even(i * (n - 1) / (dose - 1)::DOUBLE, 0)::BIGINT for i in range(dose)]))""",
)
def i31_dose_rows(spark: SparkSession, d: str) -> DataFrame:
    """A dose of evenly spread rows for each of some groups."""
    rows = a.images(spark, d).where("source_family = 'synthetic'").select("source_group", "image")
    parts = [sel.spread(rows.where(F.col("source_group") == name), ["source_group"], [F.col("image")], dose) for name, dose in (("1-URGENT", 12), ("2-HIGH", 6), ("3-MEDIUM", 3))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "i33_cycling_draws",
    f"""{_LEADING}, pool AS (SELECT class_id, image FROM li QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY {_rank('i33')}) <= 7), w AS (SELECT class_id, image, wrap, row_number() OVER (PARTITION BY class_id, wrap ORDER BY sha256(concat(wrap, ':', image))) - 1 AS pos, count(*) OVER (PARTITION BY class_id, wrap) AS n FROM pool, range(40) t(wrap))
SELECT class_id, wrap * n + pos AS draw, image FROM w WHERE wrap * n + pos < 40""",
)
def i33_cycling_draws(spark: SparkSession, d: str) -> DataFrame:
    """Forty draws a class from a pool of up to seven images, in a new order on each round."""
    pool = sel.top_per_group(_leading(spark, d), ["class_id"], [_hash("i33")], 7).select("class_id", "image")
    rounds = pool.withColumn("wrap", F.explode(F.sequence(F.lit(0), F.lit(39))))
    order = F.sha2(F.concat_ws(":", F.col("wrap").cast("string"), F.col("image").cast("string")), 256)
    w = W.partitionBy("class_id", "wrap")
    rounds = rounds.select("class_id", "image", "wrap", (F.row_number().over(w.orderBy(order)) - 1).alias("at"), F.count("*").over(w).alias("n"))
    return rounds.select("class_id", (F.col("wrap") * F.col("n") + F.col("at")).alias("draw"), "image").where("draw < 40")


def _mix_sql(scale: int) -> str:
    return f"SELECT {scale} AS scale, class_id, count(*) AS boxes, sum(n)::BIGINT AS exposures FROM (SELECT image, CASE WHEN source_family = 'synthetic' THEN {scale} ELSE 1 END AS n FROM images) JOIN gt USING (image) GROUP BY class_id"


def _mix(spark: SparkSession, d: str, scales: list[int]) -> DataFrame:
    """Exposures of each class in lists of all real rows once and all synthetic rows so many times."""
    b = a.images(spark, d).join(a.gt_boxes(spark, d), "image")
    counts = b.groupBy("class_id", "source_family").agg(F.count("*").alias("n"))
    scaled = counts.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales])))
    return scaled.groupBy("scale", "class_id").agg(F.sum("n").alias("boxes"), F.sum(F.when(F.col("source_family") == "synthetic", F.col("n") * F.col("scale")).otherwise(F.col("n"))).alias("exposures"))


@query("r5_mix_exposures", f"{_BASE} {_mix_sql(3)}")
def r5_mix_exposures(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, [3])


@query("r7_scaled_mixes", f"{_BASE} {_mix_sql(2)} UNION ALL {_mix_sql(4)}")
def r7_scaled_mixes(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, [2, 4])


@query("r6_mix_rows", f"{_BASE} SELECT image, unnest(range(1, CASE WHEN source_family = 'synthetic' AND split = 'train' THEN 3 ELSE 1 END + 1)) AS copy FROM images WHERE split <> 'test'")
def r6_mix_rows(spark: SparkSession, d: str) -> DataFrame:
    times = F.when((F.col("source_family") == "synthetic") & (F.col("split") == "train"), 3).otherwise(1)
    return sel.repeat_rows(a.images(spark, d).where("split <> 'test'"), times).select("image", F.col("copy").cast("long").alias("copy"))


@query("r8_bounded_rows", f"{_BASE} SELECT image, split FROM images ORDER BY {_rank('r8')} LIMIT 120")
def r8_bounded_rows(spark: SparkSession, d: str) -> DataFrame:
    return a.images(spark, d).orderBy(_hash("r8")).limit(120).select("image", "split")


@query(
    "r30_class_floor_and_mined",
    f"{_LEADING} SELECT image, class_id, 'floor' AS why FROM li QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY {_rank('r30')}) <= 12 UNION ALL SELECT image, class_id, 'mined' FROM preds WHERE confidence >= 0.9 QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY confidence DESC, image, pred_index) <= 8",
)
def r30_class_floor_and_mined(spark: SparkSession, d: str) -> DataFrame:
    floor = sel.top_per_group(_leading(spark, d), ["class_id"], [_hash("r30")], 12).select("image", "class_id", F.lit("floor").alias("why"))
    mined = sel.top_per_group(a.pred_boxes(spark, d).where("confidence >= 0.9"), ["class_id"], [F.desc("confidence"), F.asc("image"), F.asc("pred_index")], 8)
    return floor.unionByName(mined.select("image", "class_id", F.lit("mined").alias("why")))


@query(
    "r32_recipes_by_worst_class",
    f"{_BASE}, n AS (SELECT source_group, class_id, count(*) FILTER (source_family = 'real') AS r, count(*) AS n FROM gt JOIN images USING (image) GROUP BY ALL), w AS (SELECT source_group, min(round(r / n, 9)) AS worst, arg_min(class_id, (round(r / n, 9), class_id)) AS worst_class FROM n GROUP BY 1) SELECT source_group, worst, worst_class, row_number() OVER (ORDER BY worst DESC, source_group) AS place FROM w",
)
def r32_recipes_by_worst_class(spark: SparkSession, d: str) -> DataFrame:
    """Recipes (groups) by the share of their worst class, the best first; a row for each recipe."""
    n = a.gt_boxes(spark, d).join(a.images(spark, d), "image").groupBy("source_group", "class_id").agg(F.round(F.count_if(F.col("source_family") == "real") / F.count("*"), 9).alias("share"))
    w = n.groupBy("source_group").agg(F.min("share").alias("worst"), F.min_by("class_id", F.struct("share", "class_id")).alias("worst_class"))
    return w.withColumn("place", F.row_number().over(W.orderBy(F.desc("worst"), "source_group")).cast("long"))
