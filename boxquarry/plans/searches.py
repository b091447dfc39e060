"""Queries that search for a subset: all combinations, annealing, an integer programme; and the tail of progress rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquarry.operators import search as se
from boxquarry.operators import selection as sel
from boxquarry.plans import adapters as a
from boxquarry.plans.adapters import with_ctes
from boxquarry.plans.registry import query
from boxquarry.sources.scratch import cut, scratch_path
from boxquarry.streaming import progress

_BASE = with_ctes("classes", "images", "gt", "preds")
_CLASSES = len(a.CLASSES)

_VECTORS = f"""{_BASE}, cl AS (SELECT image, class_id, count(*) AS n FROM gt GROUP BY ALL), v AS (SELECT image, list_transform(range({_CLASSES}), lambda c: coalesce(m[c], 0)::BIGINT) AS n FROM (SELECT image, map_from_entries(list((class_id, n))) AS m FROM cl GROUP BY 1))"""


def _score_sql(n: str, least: int, spread: int, ratio: float) -> str:
    """The seven numbers of a balance as a struct, in the order in which they are compared."""
    low, high = f"list_min({n})", f"list_max({n})"
    ratio_now = f"CASE WHEN {low} > 0 THEN round({high} / {low}::DOUBLE, 6) ELSE 1000000.0::DOUBLE END"
    return f"""{{'deficit': list_sum(list_transform({n}, lambda x: greatest({least} - x, 0)))::DOUBLE, 'spread_over': greatest({high} - {low} - {spread}, 0)::DOUBLE, 'ratio_over': greatest({ratio_now} - {ratio}, 0)::DOUBLE, 'spread': ({high} - {low})::DOUBLE,
 'mean_distance': round(list_sum(list_transform({n}, lambda x: abs(x - list_sum({n}) / {_CLASSES}::DOUBLE))), 6), 'least': (0 - {low})::DOUBLE, 'total': (0 - list_sum({n}))::DOUBLE}}"""


def _sum_sql(*names: str) -> str:
    out = names[0]
    for n in names[1:]:
        out = f"list_transform(list_zip({out}, {n}), lambda x: x[1] + x[2])"
    return out


def _vectors(spark: SparkSession, d: str, by: list[str]) -> DataFrame:
    """Counts of all classes as one array a group."""
    b = a.gt_boxes(spark, d).join(a.images(spark, d), "image")
    return b.groupBy(*by).agg(F.array(*[F.count_if(F.col("class_id") == c) for c in range(_CLASSES)]).alias("n"))


_POOL, _SIZE = 20, 5


@query(
    "i22_best_combination",
    f"""{_VECTORS}, p AS (SELECT image, n FROM v JOIN images USING (image) WHERE split = 'test' ORDER BY list_sum(n) DESC, image LIMIT {_POOL}),
s AS (SELECT [a.image, b.image, c.image, d.image, e.image] AS images, {_sum_sql('a.n', 'b.n', 'c.n', 'd.n', 'e.n')} AS n FROM p a JOIN p b ON a.image < b.image JOIN p c ON b.image < c.image JOIN p d ON c.image < d.image JOIN p e ON d.image < e.image),
q AS (SELECT images, {_score_sql('n', 1, 3, 4.0)} AS score, NOT (list_min(n) >= 1 AND list_max(n) - list_min(n) <= 3 AND list_max(n) / list_min(n)::DOUBLE <= 4) AS late FROM s),
best AS (SELECT * FROM q ORDER BY coalesce(late, TRUE), score, images LIMIT 1)
SELECT unnest(images) AS image, CASE WHEN coalesce(late, TRUE) THEN 'failed_constraints' ELSE 'passed' END AS status, score.deficit, score.spread_over, score.ratio_over, score.spread, score.mean_distance, score.least, score.total FROM best""",
)
def i22_best_combination(spark: SparkSession, d: str) -> DataFrame:
    """Of the twenty fullest test images, the five that are balanced best by class, of all 15,504 combinations."""
    v = _vectors(spark, d, ["image", "split"]).where("split = 'test'")
    pool = v.orderBy(F.desc(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)), "image").limit(_POOL)
    return se.best_combination(pool, "image", "n", _SIZE, se.Balance(1, 3, 4.0))


@query(
    "i23_balance_scores",
    f"""{_VECTORS}, s AS (SELECT source_group, split, list_transform(range({_CLASSES}), lambda c: coalesce(m[c], 0)::BIGINT) AS n FROM (SELECT source_group, split, map_from_entries(list((class_id, n))) AS m FROM (SELECT source_group, split, class_id, sum(n)::BIGINT AS n FROM cl JOIN images USING (image) GROUP BY ALL) GROUP BY ALL)),
q AS (SELECT source_group, split, {_score_sql('n', 40, 30, 1.5)} AS score FROM s)
SELECT source_group, split, score.deficit, score.spread_over, score.ratio_over, score.spread, score.mean_distance, score.least, score.total, row_number() OVER (ORDER BY score, source_group, split) AS place FROM q""",
)
def i23_balance_scores(spark: SparkSession, d: str) -> DataFrame:
    """Sources and splits by how well their boxes are balanced over the classes."""
    rows = _vectors(spark, d, ["source_group", "split"]).toPandas()  # a row for each source and split
    scores = se.Balance(40, 30, 1.5).scores(np.array(rows["n"].to_list(), dtype=np.int64).reshape(len(rows), _CLASSES))
    order = sorted(range(len(rows)), key=lambda k: (*scores[k], rows["source_group"][k], rows["split"][k]))
    out = [(rows["source_group"][k], rows["split"][k], *map(float, scores[k]), place + 1) for place, k in enumerate(order)]
    return spark.createDataFrame(out, "source_group string, split string, deficit double, spread_over double, ratio_over double, spread double, mean_distance double, least double, total double, place long")


def _candidates(spark: SparkSession, d: str, most: int) -> tuple[se.Candidates, se.Goal]:
    """The ``most`` synthetic images whose boxes look most like real ones, and what real ones look like."""
    b = a.gt_boxes(spark, d).join(a.images(spark, d), "image")
    w, h = (F.col("x2") - F.col("x1")) / F.col("width"), (F.col("y2") - F.col("y1")) / F.col("height")
    whole = lambda c: F.round(c * se.UNIT, 0).cast("long")
    b = b.select("image", "class_id", "source_family", "source_group", "width", "height", whole(w).alias("w"), whole(h).alias("h"), whole(w * h).alias("area"), whole((F.col("x1") + F.col("x2")) / 2 / F.col("width")).alias("cx"))
    metrics = ["w", "h", "area"]
    real = b.where("source_family = 'real'").groupBy("class_id").agg(*[F.sum(m).alias(m) for m in metrics], F.count("*").alias("n"), F.countDistinct("image").alias("images")).toPandas().set_index("class_id")  # a row a class
    means = np.array([[real[m].get(c, 0) / max(real["n"].get(c, 0), 1) / se.UNIT for m in metrics] for c in range(_CLASSES)])
    total = np.array([real[m].sum() / max(real["n"].sum(), 1) / se.UNIT for m in metrics])
    images = b.where("source_family = 'real'").agg(F.countDistinct("image").alias("k")).first()["k"]
    far = F.sqrt(sum(F.pow(F.avg(m) / se.UNIT - F.lit(float(t)), 2) for m, t in zip(metrics, total, strict=True)))
    by_class = lambda m: F.array(*[F.sum(F.when(F.col("class_id") == c, F.col(m)).otherwise(0)) for c in range(_CLASSES)]).alias(m)
    near = b.where("source_family = 'synthetic'").groupBy("image", "source_group", "width", "height").agg(far.alias("far"), by_class("w"), by_class("h"), by_class("area"), F.array(*[F.count_if(F.col("class_id") == c) for c in range(_CLASSES)]).alias("n"), F.sum("cx").alias("cx"), F.count("*").alias("boxes"))
    rows = near.orderBy("far", "image").limit(most).toPandas().sort_values("image")
    stack = lambda name: np.array(rows[name].to_list(), dtype=np.int64).reshape(len(rows), -1)
    groups, widths, heights = (sorted(rows[c].unique()) for c in ("source_group", "width", "height"))
    c = se.Candidates(
        names=rows["image"].tolist(),
        image=np.stack([rows["boxes"].to_numpy() * se.UNIT], axis=1),
        boxes=np.stack([stack(m) for m in metrics], axis=2),
        counts=stack("n"),
        root=np.array([groups.index(x) for x in rows["source_group"]], dtype=np.int64),
        profile=np.array([widths.index(x) for x in rows["width"]], dtype=np.int64),
        conditions=(rows["height"].to_numpy()[:, None] == np.array(heights)[None, :]).astype(np.int64),
        ranged=(rows["cx"].to_numpy() // np.maximum(rows["boxes"].to_numpy(), 1))[:, None].astype(np.int64),
    )
    present = c.counts.any(axis=0)  # a class that no candidate has can't be asked for
    c.counts, c.boxes = c.counts[:, present], c.boxes[:, present]
    goal = se.Goal(
        image=np.array([real["n"].sum() / max(images, 1)]), image_limits=np.array([0.5]), box=total, box_limits=np.array([0.03, 0.03, 0.02]), class_box=means[present], class_limits=np.array([0.08, 0.08, 0.05]), class_weights=np.array([1.0, 1.0, 5.0]),
        min_per_class=4, max_class_ratio=2.5, max_class_spread=8, root_min={0: 4}, root_max={1: 18}, min_profiles=3, min_conditions=3, min_class_profiles=2, min_class_conditions=2, min_ranges=np.array([0.2]),
    )
    return c, goal


@query("i24_annealed_subset")
def i24_annealed_subset(spark: SparkSession, d: str) -> DataFrame:
    """Forty of the 400 synthetic images nearest to real ones, annealed towards the real ones' geometry and balanced classes."""
    c, goal = _candidates(spark, d, 400)
    score, broken, chosen = se.annealed_subset(spark, c, goal, min(40, len(c.names)), restarts=12, steps=500, seed=2606)
    return spark.createDataFrame([(i, round(score, 6), broken) for i in chosen], "image long, score double, broken long")


@query("i26_pattern_mix")
def i26_pattern_mix(spark: SparkSession, d: str) -> DataFrame:
    """Real images, as many as a set of added synthetic ones, with as many boxes of each class as can be had without one more: (image, missing)."""
    i, b = a.images(spark, d), a.gt_boxes(spark, d)
    counts = b.groupBy("image", "class_id").agg(F.count("*").alias("n")).join(i.select("image", "source_family"), "image")
    labelled = counts.select("image", "source_family").distinct()
    added = labelled.where("source_family = 'synthetic'").orderBy(sel.hash_order("i26", "image"), "image").limit(30).select("image")
    wanted = counts.join(F.broadcast(added), "image").groupBy("class_id").agg(F.sum("n").alias("n")).orderBy("class_id").collect()  # a row a class
    classes, target = [r["class_id"] for r in wanted], [r["n"] for r in wanted]
    rows = added.count()
    if not rows:
        return spark.createDataFrame([], "image long, missing long")
    vectors = se.patterns_of(counts.where("source_family = 'real'"), "image", classes, target)
    ranked = cut(sel.top_per_group(vectors.withColumn("h", sel.hash_order("i26", "image")), ["vector"], [F.col("h"), F.col("image")], rows, rank="r"), "patterns")
    # one row a pattern: no more rows of one than are asked for in all
    patterns = ranked.groupBy("vector").agg(F.count("*").alias("n")).orderBy(F.desc(F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x)), F.desc("n"), "vector").collect()
    found = se.mix_patterns(np.array([r["vector"] for r in patterns]), [r["n"] for r in patterns], target, rows)
    if found is None:
        raise ValueError("no such rows")
    taken = spark.createDataFrame([(r["vector"], t) for r, t in zip(patterns, found.times, strict=True) if t], "vector array<long>, times long")
    return ranked.join(F.broadcast(taken), "vector").where("r <= times").select("image", F.lit(sum(found.missing)).cast("long").alias("missing"))


@query(
    "o3_progress_tail",
    "SELECT user_id, count(*) AS rows, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value, arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) AS delta FROM events GROUP BY user_id",
)
def o3_progress_tail(spark: SparkSession, d: str) -> DataFrame:
    """First and last value of each run from a stream that is stopped, and started again when half of the rows have come later."""
    e = a.table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    top = scratch_path(spark, "progress")
    schema, half = "user_id long, ts timestamp_ntz, event_id long, value double", F.xxhash64("event_id") % 2 == 0
    for part in (half, ~half):
        e.where(part).write.mode("append").parquet(f"{top}/rows")
        progress.tail(spark, f"{top}/rows", schema, "user_id", ["ts", "event_id"], "value", f"{top}/state", f"{top}/out")
    return progress.latest(spark, f"{top}/out", "user_id", "long")
