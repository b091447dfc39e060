"""Queries that join evidence, bucket it, and rank it for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from boxquarry.functions import geometry as g
from boxquarry.operators import matching
from boxquarry.operators import selection as sel
from boxquarry.plans import adapters as a
from boxquarry.plans.adapters import sql_area, sql_iou, with_ctes
from boxquarry.plans.registry import query

_BASE = with_ctes("classes", "images", "gt", "preds")

#: Labels, predictions and classes of each image, and the labels that no prediction of their class overlaps at all.
_ROLL = f"""{_BASE}, lab AS (SELECT image, count(*) AS labels, count(DISTINCT class_id) AS kinds, min(class_id) AS first_class FROM gt GROUP BY 1),
pre AS (SELECT image, count(*) AS preds, max(confidence) AS surest FROM preds GROUP BY 1),
roll AS (SELECT i.*, coalesce(labels, 0) AS labels, coalesce(kinds, 0) AS kinds, first_class, coalesce(preds, 0) AS preds, surest, abs(coalesce(preds, 0) - coalesce(labels, 0)) AS error FROM images i LEFT JOIN lab USING (image) LEFT JOIN pre USING (image))"""


def _roll(spark: SparkSession, d: str) -> DataFrame:
    """Each image with its numbers of labels, classes and predictions, the surest prediction and the count error."""
    lab = a.gt_boxes(spark, d).groupBy("image").agg(F.count("*").alias("labels"), F.countDistinct("class_id").alias("kinds"), F.min("class_id").alias("first_class"))
    pre = a.pred_boxes(spark, d).groupBy("image").agg(F.count("*").alias("preds"), F.max("confidence").alias("surest"))
    out = a.images(spark, d).join(lab, "image", "left").join(pre, "image", "left").fillna(0, ["labels", "kinds", "preds"])
    return out.withColumn("error", F.abs(F.col("preds") - F.col("labels")))


def _first_of(cases: list[tuple[str, Column]], other: str | None = None) -> Column:
    out = F.lit(other).cast("string")
    for name, fits in reversed(cases):
        out = F.when(fits, name).otherwise(out)
    return out


# ---- filters and routes ----

_FUSION = "CASE WHEN gate_class >= 11 AND gate_conf >= 0.7 THEN 'rejected_by_class' WHEN gate_class <> class_id AND gate_conf < 0.3 THEN 'rejected_by_disagreement' WHEN gate_class <> class_id THEN 'renamed' ELSE 'kept' END"


@query("c13_browser_fusion", f"{_BASE} SELECT image, pred_index, {_FUSION} AS fate, CASE WHEN {_FUSION} = 'renamed' THEN gate_class ELSE class_id END AS final_class, CASE WHEN {_FUSION} = 'renamed' THEN round(confidence * gate_conf, 9) ELSE confidence END AS score FROM preds")
def c13_browser_fusion(spark: SparkSession, d: str) -> DataFrame:
    """A detector's box meets a second opinion: it is rejected, renamed with a combined score, or kept."""
    differs = F.col("gate_class") != F.col("class_id")
    fate = _first_of([("rejected_by_class", (F.col("gate_class") >= 11) & (F.col("gate_conf") >= 0.7)), ("rejected_by_disagreement", differs & (F.col("gate_conf") < 0.3)), ("renamed", differs)], "kept")
    renamed = F.col("fate") == "renamed"
    return a.pred_boxes(spark, d).withColumn("fate", fate).select(
        "image", "pred_index", "fate", F.when(renamed, F.col("gate_class")).otherwise(F.col("class_id")).alias("final_class"), F.when(renamed, F.round(F.col("confidence") * F.col("gate_conf"), 9)).otherwise(F.col("confidence")).alias("score")
    )


@query("c16_model_filters", "WITH e AS (SELECT event_id, event_type, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events) SELECT event_id, k FROM e WHERE contains(event_type, 'c') AND abs(value - round(value, 1)) <= 1e-9 AND k >= 50")
def c16_model_filters(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = a.table(spark, d, "events").select("event_id", "event_type", "value", k.alias("k"))
    return e.where(F.col("event_type").contains("c") & (F.abs(F.col("value") - F.round("value", 1)) <= 1e-9) & (F.col("k") >= 50)).select("event_id", "k")




@query("c20_review_focus", f"{_BASE}, s AS (SELECT image, list_distinct(list(class_id)) AS g FROM gt GROUP BY 1), p AS (SELECT image, list_distinct(list(class_id)) AS p FROM preds GROUP BY 1) SELECT image, coalesce(list_has_any(g, [3, 7]), false) AS in_labels, coalesce(list_has_any(p, [3, 7]), false) AS in_predictions FROM images LEFT JOIN s USING (image) LEFT JOIN p USING (image) WHERE coalesce(list_has_any(g, [3, 7]), false) OR coalesce(list_has_any(p, [3, 7]), false)")
def c20_review_focus(spark: SparkSession, d: str) -> DataFrame:
    """Images with a focus class among their labels or predictions."""
    has = F.bool_or(F.col("class_id").isin(3, 7))
    s, p = a.gt_boxes(spark, d).groupBy("image").agg(has.alias("in_labels")), a.pred_boxes(spark, d).groupBy("image").agg(has.alias("in_predictions"))
    out = a.images(spark, d).select("image").join(s, "image", "left").join(p, "image", "left").fillna(False)
    return out.where("in_labels or in_predictions")


@query("c23_visible_rows", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(trim(text)) > 0 AND contains(lower(text), 'the') AND turn < 4")
def c23_visible_rows(spark: SparkSession, d: str) -> DataFrame:
    t = a.table(spark, d, "conversations")
    return t.where((F.col("role") == "user") & (F.length(F.trim("text")) > 0) & F.lower("text").contains("the") & (F.col("turn") < 4)).select("conv_id", "turn")


@query("c25_single_class_view", f"{_BASE} SELECT image, label_index, 0 AS class_id, class_id AS was FROM gt")
def c25_single_class_view(spark: SparkSession, d: str) -> DataFrame:
    return a.gt_boxes(spark, d).select("image", "label_index", F.lit(0).alias("class_id"), F.col("class_id").alias("was"))


# ---- geometry and joins ----


@query("d4_iou_matrix", f"{_BASE} SELECT p.image, p.pred_index, list(round({sql_iou('p', 'l')}, 9) ORDER BY l.label_index) AS ious FROM preds p JOIN gt l USING (image) GROUP BY ALL")
def d4_iou_matrix(spark: SparkSession, d: str) -> DataFrame:
    """For each prediction, its IoU with every label of the image, in the labels' order."""
    p, q = a.pred_boxes(spark, d), a.gt_boxes(spark, d)
    x = p.select("image", "pred_index", *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")]).join(q.select("image", "label_index", *[F.col(c).alias(f"l_{c}") for c in ("x1", "y1", "x2", "y2")]), "image")
    held = F.array_sort(F.collect_list(F.struct("label_index", g.rounded(g.iou(g.box("p_"), g.box("l_")), 9).alias("iou"))))
    return x.groupBy("image", "pred_index").agg(F.transform(held, lambda v: v["iou"]).alias("ious"))


_CAUSE = "CASE WHEN n = 0 THEN 'no_proposal' WHEN sure = 0 THEN 'all_unsure' WHEN same = 0 THEN 'other_class_only' ELSE 'misplaced' END"


@query(
    "d19_no_box_cause",
    f"""{_BASE}, k AS (SELECT l.image, l.label_index, count(p.pred_index) AS n, count(*) FILTER (p.confidence >= 0.3) AS sure, count(*) FILTER (p.class_id = l.class_id) AS same, coalesce(max({sql_iou('p', 'l')}), 0) AS best FROM gt l LEFT JOIN preds p ON p.image = l.image GROUP BY ALL)
SELECT image, label_index, {_CAUSE} AS cause FROM k WHERE best < 0.5""",
)
def d19_no_box_cause(spark: SparkSession, d: str) -> DataFrame:
    """Why no prediction of the image overlaps a label by half."""
    p = a.pred_boxes(spark, d).select("image", "confidence", F.col("class_id").alias("pc"), *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    k = a.gt_boxes(spark, d).join(p, "image", "left").groupBy("image", "label_index").agg(
        F.count("pc").alias("n"), F.count_if(F.col("confidence") >= 0.3).alias("sure"), F.count_if(F.col("pc") == F.col("class_id")).alias("same"), F.coalesce(F.max(F.when(F.col("pc").isNotNull(), g.iou(g.box("p_"), g.box()))), F.lit(0.0)).alias("best")
    )
    cause = _first_of([("no_proposal", F.col("n") == 0), ("all_unsure", F.col("sure") == 0), ("other_class_only", F.col("same") == 0)], "misplaced")
    return k.where("best < 0.5").select("image", "label_index", cause.alias("cause"))


@query("e19_crop_to_box", f"{_BASE}, crops AS (SELECT image, pred_index % 3 AS label_index, pred_index, confidence FROM preds) SELECT c.image, c.pred_index, c.label_index, l.class_id, c.confidence FROM crops c JOIN gt l USING (image, label_index)")
def e19_crop_to_box(spark: SparkSession, d: str) -> DataFrame:
    crops = a.pred_boxes(spark, d).select("image", (F.col("pred_index") % 3).alias("label_index"), "pred_index", "confidence")
    return crops.join(a.gt_boxes(spark, d).select("image", "label_index", "class_id"), ["image", "label_index"]).select("image", "pred_index", "label_index", "class_id", "confidence")


@query("e23_errors_by_variant", f"{_ROLL}, o AS (SELECT image AS key, unnest([image, image + 1, image + 2]) AS variant FROM images WHERE image % 50 = 0) SELECT key, count(r.image) AS variants, coalesce(sum(error), 0)::BIGINT AS errors, arg_max(r.image, (error, -r.image)) AS worst FROM o LEFT JOIN roll r ON r.image = o.variant GROUP BY key")
def e23_errors_by_variant(spark: SparkSession, d: str) -> DataFrame:
    """Rows that stand for several images, with the errors of all of them."""
    o = a.images(spark, d).where("image % 50 = 0").select(F.col("image").alias("key"), F.explode(F.array("image", F.col("image") + 1, F.col("image") + 2)).alias("variant"))
    r = _roll(spark, d).select(F.col("image").alias("variant"), F.col("image").alias("hit"), "error")
    return o.join(r, "variant", "left").groupBy("key").agg(F.count("hit").alias("variants"), F.coalesce(F.sum("error"), F.lit(0)).alias("errors"), F.max_by("hit", F.struct("error", -F.col("hit"))).alias("worst"))


# ---- first of many ----


@query("f9_unique_in_class_source", f"{_BASE} SELECT class_id, source_group, image % 97 AS key, min(image) AS image, count(*) AS seen FROM gt JOIN images USING (image) GROUP BY 1, 2, 3")
def f9_unique_in_class_source(spark: SparkSession, d: str) -> DataFrame:
    b = a.gt_boxes(spark, d).join(a.images(spark, d), "image")
    return b.groupBy("class_id", "source_group", (F.col("image") % 97).alias("key")).agg(F.min("image").alias("image"), F.count("*").alias("seen"))


@query("f11_best_by_rank", "SELECT p_type, arg_min(p_partkey, (CASE WHEN p_brand LIKE '%1' THEN 0 WHEN p_brand LIKE '%2' THEN 1 ELSE 2 END, -p_retailprice, p_partkey)) AS best FROM part GROUP BY 1")
def f11_best_by_rank(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("p_brand").endswith("1"), 0).when(F.col("p_brand").endswith("2"), 1).otherwise(2)
    return a.table(spark, d, "part").groupBy("p_type").agg(F.min_by("p_partkey", F.struct(rank, -F.col("p_retailprice"), "p_partkey")).alias("best"))


# ---- totals ----


@query("g31_positive_error_totals", f"{_ROLL} SELECT class_name, count(*) AS images, sum(error)::BIGINT AS errors, count(*) FILTER (preds > labels) AS over, count(*) FILTER (preds < labels) AS under FROM roll JOIN classes ON class_id = first_class WHERE error > 0 GROUP BY 1")
def g31_positive_error_totals(spark: SparkSession, d: str) -> DataFrame:
    r = _roll(spark, d).where("error > 0").join(a.classes(spark), F.col("class_id") == F.col("first_class"))
    return r.groupBy("class_name").agg(F.count("*").alias("images"), F.sum("error").alias("errors"), F.count_if(F.col("preds") > F.col("labels")).alias("over"), F.count_if(F.col("preds") < F.col("labels")).alias("under"))


@query("g35_bank_coverage", "SELECT p_brand, count(*) AS assets, count(DISTINCT p_type) AS kinds, count(*) FILTER (p_size >= 25) AS large, count(*) FILTER (p_size >= 25) > 0 AND count(*) FILTER (p_size < 25) > 0 AS both_sides FROM part GROUP BY 1")
def g35_bank_coverage(spark: SparkSession, d: str) -> DataFrame:
    large = F.count_if(F.col("p_size") >= 25)
    return a.table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("assets"), F.countDistinct("p_type").alias("kinds"), large.alias("large"), ((large > 0) & (F.count_if(F.col("p_size") < 25) > 0)).alias("both_sides"))


@query("g37_metadata_diversity", "SELECT event_type, round(max(value) - min(value), 6) AS range, count(DISTINCT json_extract_string(props, '$.k')) AS kinds, CASE WHEN count(*) < 4 THEN 1 WHEN count(*) < 16 THEN 2 ELSE 3 END AS needed FROM events GROUP BY 1")
def g37_metadata_diversity(spark: SparkSession, d: str) -> DataFrame:
    e = a.table(spark, d, "events")
    return e.groupBy("event_type").agg(F.round(F.max("value") - F.min("value"), 6).alias("range"), F.countDistinct(F.get_json_object("props", "$.k")).alias("kinds"), F.when(F.count("*") < 4, 1).when(F.count("*") < 16, 2).otherwise(3).alias("needed"))


_EFFECT = "CASE WHEN best >= 0.5 AND gated THEN 'lost_hit' WHEN best >= 0.5 THEN 'kept_hit' WHEN gated THEN 'removed_false' ELSE 'kept_false' END"


@query("g39_gate_effects", f"{_BASE}, k AS (SELECT p.image, p.pred_index, p.class_id, p.gate_class >= 11 AND p.gate_conf >= 0.5 AS gated, coalesce(max({sql_iou('p', 'l')}), 0) AS best FROM preds p LEFT JOIN gt l ON p.image = l.image AND p.class_id = l.class_id GROUP BY ALL) SELECT class_id, {_EFFECT} AS effect, count(*) AS n FROM k GROUP BY 1, 2")
def g39_gate_effects(spark: SparkSession, d: str) -> DataFrame:
    """What a gate does to boxes that hit a label of their class, and to the others."""
    p = a.pred_boxes(spark, d)
    best = matching.overlaps(p, a.gt_boxes(spark, d), match_classes=True).groupBy("image", "pred_index").agg(F.max("iou").alias("best"))
    k = p.join(best, ["image", "pred_index"], "left").fillna(0.0, ["best"])
    gated, hit = (F.col("gate_class") >= 11) & (F.col("gate_conf") >= 0.5), F.col("best") >= 0.5
    return k.groupBy("class_id", _first_of([("lost_hit", hit & gated), ("kept_hit", hit), ("removed_false", gated)], "kept_false").alias("effect")).agg(F.count("*").alias("n"))


@query("g41_family_class_counts", f"{_BASE} SELECT class_id, count(*) FILTER (source_family = 'real') AS real, count(*) FILTER (source_family = 'synthetic') AS synthetic, count(*) FILTER (source_family = 'synthetic') - count(*) FILTER (source_family = 'real') AS delta, round(avg(x2 - x1) FILTER (source_family = 'synthetic') - avg(x2 - x1) FILTER (source_family = 'real'), 6) AS width_delta FROM gt JOIN images USING (image) GROUP BY 1")
def g41_family_class_counts(spark: SparkSession, d: str) -> DataFrame:
    b = a.gt_boxes(spark, d).join(a.images(spark, d), "image")
    real, made = F.col("source_family") == "real", F.col("source_family") == "synthetic"
    width = lambda c: F.avg(F.when(c, F.expr("x2 - x1")))
    return b.groupBy("class_id").agg(F.count_if(real).alias("real"), F.count_if(made).alias("synthetic"), (F.count_if(made) - F.count_if(real)).alias("delta"), F.round(width(made) - width(real), 6).alias("width_delta"))


@query("g42_teacher_student_buckets", f"{_BASE} SELECT class_id || '|' || gate_class AS pair, count(*) AS n FROM preds GROUP BY 1 ORDER BY n DESC, pair LIMIT 80")
def g42_teacher_student_buckets(spark: SparkSession, d: str) -> DataFrame:
    pair = F.concat_ws("|", F.col("class_id").cast("string"), F.col("gate_class").cast("string"))
    return a.pred_boxes(spark, d).groupBy(pair.alias("pair")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair").limit(80)


# ---- queues ----


@query("h2_representative_issues", f"{_ROLL} SELECT source_group, error, min(image) AS image, count(*) AS images FROM roll WHERE error > 0 GROUP BY 1, 2")
def h2_representative_issues(spark: SparkSession, d: str) -> DataFrame:
    return _roll(spark, d).where("error > 0").groupBy("source_group", "error").agg(F.min("image").alias("image"), F.count("*").alias("images"))


@query("h13_unique_sorted_spread", f"{_BASE}, u AS (SELECT image, row_number() OVER (ORDER BY image) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT image FROM preds WHERE confidence >= 0.9)) SELECT image FROM u WHERE n <= 25 OR pos IN (SELECT round_even(i * (n - 1) / 24::DOUBLE, 0)::BIGINT FROM range(25) t(i))")
def h13_unique_sorted_spread(spark: SparkSession, d: str) -> DataFrame:
    u = a.pred_boxes(spark, d).where("confidence >= 0.9").select("image").distinct().withColumn("all", F.lit(1))
    return sel.spread(u, ["all"], [F.col("image")], 25).select("image")


@query("h19_image_targets", f"{_BASE} SELECT image, round(min({sql_area('gt')} / (width * height)::DOUBLE), 9) AS least FROM gt JOIN images USING (image) GROUP BY 1 ORDER BY least, image LIMIT 150")
def h19_image_targets(spark: SparkSession, d: str) -> DataFrame:
    b = a.gt_boxes(spark, d).join(a.images(spark, d), "image")
    least = F.round(F.min(g.area(g.box()) / (F.col("width") * F.col("height")).cast("double")), 9)
    return b.groupBy("image").agg(least.alias("least")).orderBy("least", "image").limit(150)


@query("h20_queue_rank", f"{_ROLL} SELECT image, error, row_number() OVER (ORDER BY error DESC, image) AS place FROM roll")
def h20_queue_rank(spark: SparkSession, d: str) -> DataFrame:
    """Every image with its place in the queue; numbered by sorted ranges."""
    return sel.number_rows(_roll(spark, d).select("image", "error"), [-F.col("error"), F.col("image")], "k").select("image", "error", (F.col("k") + 1).alias("place"))


# ---- evidence ----


@query("m7_obligation_rows", f"{_ROLL}, u AS (SELECT first_class, source_group, min(image) AS image FROM roll WHERE error > 0 AND first_class IS NOT NULL GROUP BY first_class, source_group, image % 31) SELECT first_class, source_group, image FROM u QUALIFY row_number() OVER (PARTITION BY first_class ORDER BY image) <= 20")
def m7_obligation_rows(spark: SparkSession, d: str) -> DataFrame:
    u = _roll(spark, d).where("error > 0 and first_class is not null").groupBy("first_class", "source_group", F.col("image") % 31).agg(F.min("image").alias("image"))
    return sel.top_per_group(u, ["first_class"], [F.col("image")], 20).select("first_class", "source_group", "image")


@query("m8_semantic_rows", f"{_ROLL} SELECT source_group, image, labels FROM roll WHERE kinds >= 2 AND split = 'train' QUALIFY row_number() OVER (PARTITION BY source_group ORDER BY kinds DESC, sha256(concat('m8:', image))) <= 15")
def m8_semantic_rows(spark: SparkSession, d: str) -> DataFrame:
    return sel.top_per_group(_roll(spark, d).where("kinds >= 2 and split = 'train'"), ["source_group"], [F.desc("kinds"), sel.hash_order("m8", "image")], 15).select("source_group", "image", "labels")


@query("m10_positive_error_ingest", f"{_ROLL} SELECT image, first_class, CASE WHEN preds < labels THEN 'recall' ELSE 'precision' END AS need, error FROM roll WHERE labels > 0 AND error >= 2")
def m10_positive_error_ingest(spark: SparkSession, d: str) -> DataFrame:
    return _roll(spark, d).where("labels > 0 and error >= 2").select("image", "first_class", F.when(F.col("preds") < F.col("labels"), "recall").otherwise("precision").alias("need"), "error")


@query("m11_scorecard_ingest", f"{_ROLL}, s AS (SELECT source_group, split, round(avg(error), 6) AS mean_error, count(*) AS images FROM roll GROUP BY ALL) SELECT source_group || '/' || split AS axis, mean_error, images, mean_error > 0.9 AS obliged FROM s")
def m11_scorecard_ingest(spark: SparkSession, d: str) -> DataFrame:
    s = _roll(spark, d).groupBy("source_group", "split").agg(F.round(F.avg("error"), 6).alias("mean_error"), F.count("*").alias("images"))
    return s.select(F.concat_ws("/", "source_group", "split").alias("axis"), "mean_error", "images", (F.col("mean_error") > 0.9).alias("obliged"))


_FALSE = f"f AS (SELECT p.image, p.pred_index, p.class_id, p.confidence, {sql_area('p')} AS area, coalesce(max({sql_iou('p', 'l')}), 0) AS best FROM preds p LEFT JOIN gt l ON l.image = p.image AND l.class_id = p.class_id GROUP BY ALL HAVING coalesce(max({sql_iou('p', 'l')}), 0) < 0.5)"


def _false(spark: SparkSession, d: str) -> DataFrame:
    """Predictions that overlap no label of their class by half."""
    p = a.pred_boxes(spark, d).withColumn("area", g.area(g.box()))
    best = matching.best_per_prediction(p, a.gt_boxes(spark, d), more=("class_id", "confidence", "area"))
    return best.where("same is null or same < 0.5").drop("near", "same")


@query(
    "m12_fp_delta_queue",
    f"{_BASE}, {_FALSE}, n AS (SELECT class_id, count(*) FILTER (image % 2 = 1) - count(*) FILTER (image % 2 = 0) AS delta FROM f GROUP BY 1) SELECT image, pred_index, class_id, delta FROM f JOIN n USING (class_id) WHERE delta > 0 AND image % 2 = 1 ORDER BY delta DESC, confidence DESC, area DESC, image, pred_index LIMIT 200",
)
def m12_fp_delta_queue(spark: SparkSession, d: str) -> DataFrame:
    """False boxes of the candidate (odd images) in classes where it has more of them than the baseline."""
    f = _false(spark, d)
    n = f.groupBy("class_id").agg((F.count_if(F.col("image") % 2 == 1) - F.count_if(F.col("image") % 2 == 0)).alias("delta")).where("delta > 0")
    rows = f.where("image % 2 = 1").join(F.broadcast(n), "class_id")
    return rows.orderBy(F.desc("delta"), F.desc("confidence"), F.desc("area"), "image", "pred_index").limit(200).select("image", "pred_index", "class_id", "delta")


@query("m14_geometry_slices", f"{_BASE}, b AS (SELECT image, {sql_area('gt')} / (width * height)::DOUBLE AS share, x1 <= 0 OR y1 <= 0 OR x2 >= width OR y2 >= height AS edge, (x2 - x1) / (y2 - y1)::DOUBLE AS aspect FROM gt JOIN images USING (image)) SELECT slice, count(*) AS boxes, count(DISTINCT image) AS images FROM (SELECT image, unnest(list_filter([CASE WHEN share < 0.02 THEN 'small' END, CASE WHEN edge THEN 'edge' END, CASE WHEN aspect > 1.45 THEN 'wide' END, CASE WHEN share >= 0.05 AND NOT edge THEN 'clear' END], lambda x: x IS NOT NULL)) AS slice FROM b) GROUP BY 1")
def m14_geometry_slices(spark: SparkSession, d: str) -> DataFrame:
    b = a.gt_boxes(spark, d).join(a.images(spark, d), "image")
    share, edge = g.area(g.box()) / (F.col("width") * F.col("height")).cast("double"), g.touches_edge(g.box(), F.col("width"), F.col("height"))
    slices = F.array(F.when(share < 0.02, "small"), F.when(edge, "edge"), F.when(F.expr("double(x2 - x1) / (y2 - y1)") > 1.45, "wide"), F.when((share >= 0.05) & ~edge, "clear"))
    return b.select("image", F.explode(F.array_compact(slices)).alias("slice")).groupBy("slice").agg(F.count("*").alias("boxes"), F.countDistinct("image").alias("images"))


@query("m17_view_counts", f"{_ROLL} SELECT split, source_group, count(*) AS rows, sum(error)::BIGINT AS errors, count(*) FILTER (labels = 0) AS without_labels FROM roll GROUP BY 1, 2")
def m17_view_counts(spark: SparkSession, d: str) -> DataFrame:
    return _roll(spark, d).groupBy("split", "source_group").agg(F.count("*").alias("rows"), F.sum("error").alias("errors"), F.count_if(F.col("labels") == 0).alias("without_labels"))


@query("m21_reviewed_proposals", f"{_BASE}, r AS (SELECT image, pred_index, CASE WHEN x2 - x1 < 30 THEN 'too_thin' WHEN class_id > 12 THEN 'bad_class' WHEN confidence < 0.2 THEN 'unsure' END AS reason FROM preds) SELECT image, count(*) FILTER (reason IS NULL) AS accepted, count(reason) AS rejected, min(reason) AS first_reason FROM r GROUP BY 1")
def m21_reviewed_proposals(spark: SparkSession, d: str) -> DataFrame:
    reason = _first_of([("too_thin", F.expr("x2 - x1 < 30")), ("bad_class", F.col("class_id") > 12), ("unsure", F.col("confidence") < 0.2)])
    return a.pred_boxes(spark, d).withColumn("reason", reason).groupBy("image").agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count("reason").alias("rejected"), F.min("reason").alias("first_reason"))


@query("m22_policy_rows", f"{_BASE} SELECT image, min(pred_index) AS pred_index FROM preds JOIN images USING (image) WHERE confidence >= 0.5 AND gate_conf >= 0.3 AND split <> 'test' AND source_family = 'real' GROUP BY 1")
def m22_policy_rows(spark: SparkSession, d: str) -> DataFrame:
    b = a.pred_boxes(spark, d).where("confidence >= 0.5 and gate_conf >= 0.3").join(a.images(spark, d).where("split <> 'test' and source_family = 'real'"), "image")
    return b.groupBy("image").agg(F.min("pred_index").alias("pred_index"))


@query("m23_taxonomy_gaps", f"{_BASE}, n AS (SELECT class_id, count(*) AS boxes, count(DISTINCT source_group) AS groups FROM gt JOIN images USING (image) WHERE split = 'val' GROUP BY 1) SELECT class_name, coalesce(boxes, 0) AS boxes, CASE WHEN coalesce(boxes, 0) = 0 THEN 'collect' WHEN groups < 5 THEN 'diversify' WHEN boxes < 230 THEN 'extend' ELSE 'covered' END AS action FROM classes LEFT JOIN n USING (class_id)")
def m23_taxonomy_gaps(spark: SparkSession, d: str) -> DataFrame:
    n = a.gt_boxes(spark, d).join(a.images(spark, d).where("split = 'val'"), "image").groupBy("class_id").agg(F.count("*").alias("boxes"), F.countDistinct("source_group").alias("groups"))
    action = _first_of([("collect", F.col("boxes") == 0), ("diversify", F.col("groups") < 5), ("extend", F.col("boxes") < 230)], "covered")
    return a.classes(spark).join(n, "class_id", "left").fillna(0, ["boxes", "groups"]).select("class_name", "boxes", action.alias("action"))


@query("m24_edge_audit", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most, count(*) FILTER (value > 40) AS sharp FROM events GROUP BY 1")
def m24_edge_audit(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"), F.count_if(F.col("value") > 40).alias("sharp"))


@query("m25_gate_review_targets", f"{_BASE}, k AS (SELECT class_id, count(*) FILTER (gate_class >= 11 AND gate_conf >= 0.5) AS gated, count(*) AS n FROM preds GROUP BY 1) SELECT class_id, gated, n, CASE WHEN gated * 10 >= n THEN 'more_positives' WHEN gated = 0 THEN 'none' ELSE 'watch' END AS target, row_number() OVER (ORDER BY gated DESC, class_id) AS place FROM k")
def m25_gate_review_targets(spark: SparkSession, d: str) -> DataFrame:
    k = a.pred_boxes(spark, d).groupBy("class_id").agg(F.count_if((F.col("gate_class") >= 11) & (F.col("gate_conf") >= 0.5)).alias("gated"), F.count("*").alias("n"))
    target = _first_of([("more_positives", F.col("gated") * 10 >= F.col("n")), ("none", F.col("gated") == 0)], "watch")
    # one row for each class
    return k.select("class_id", "gated", "n", target.alias("target"), F.row_number().over(W.orderBy(F.desc("gated"), "class_id")).cast("long").alias("place"))


@query("m26_aspect_repair", f"{_BASE}, b AS (SELECT image, label_index, class_id, round(abs((x2 - x1) / (y2 - y1)::DOUBLE - 1.25), 9) AS off FROM gt) SELECT class_id, arg_max((image, label_index), (off, -image, -label_index))[1] AS worst_image, arg_min((image, label_index), (off, image, label_index))[1] AS donor_image FROM b GROUP BY 1")
def m26_aspect_repair(spark: SparkSession, d: str) -> DataFrame:
    """For each class, the image whose box is farthest from the wanted shape and the one that could stand in."""
    b = a.gt_boxes(spark, d).select("image", "label_index", "class_id", F.round(F.abs(F.expr("double(x2 - x1) / (y2 - y1)") - 1.25), 9).alias("off"))
    return b.groupBy("class_id").agg(F.max_by("image", F.struct("off", -F.col("image"), -F.col("label_index"))).alias("worst_image"), F.min_by("image", F.struct("off", "image", "label_index")).alias("donor_image"))


@query("r21_bucket_cap_by_errors", f"{_ROLL} SELECT image, source_group, error FROM roll WHERE error >= 1 AND kinds >= 2 QUALIFY row_number() OVER (PARTITION BY source_group ORDER BY error DESC, surest DESC, image) <= 10")
def r21_bucket_cap_by_errors(spark: SparkSession, d: str) -> DataFrame:
    return sel.top_per_group(_roll(spark, d).where("error >= 1 and kinds >= 2"), ["source_group"], [F.desc("error"), F.desc_nulls_last("surest"), F.asc("image")], 10).select("image", "source_group", "error")


@query("m16_overlap_focus_packet", f"{_ROLL}, k AS (SELECT image, source_group, error, CASE WHEN error >= 3 THEN 'counts' WHEN kinds >= 3 THEN 'classes' END AS bucket FROM roll), t AS (SELECT * FROM k WHERE bucket IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY error DESC, image) <= 25) SELECT image, bucket, CASE WHEN source_group LIKE '1%' THEN 'expert' ELSE 'queue' END AS route FROM t")
def m16_overlap_focus_packet(spark: SparkSession, d: str) -> DataFrame:
    k = _roll(spark, d).withColumn("bucket", _first_of([("counts", F.col("error") >= 3), ("classes", F.col("kinds") >= 3)])).where("bucket is not null")
    t = sel.top_per_group(k, ["bucket"], [F.desc("error"), F.asc("image")], 25)
    return t.select("image", "bucket", F.when(F.col("source_group").startswith("1"), "expert").otherwise("queue").alias("route"))


@query(
    "r1_scene_pick",
    f"""{_ROLL}, s AS (SELECT image, split, image % 40 AS origin, CASE WHEN labels >= 4 THEN 'pile' WHEN kinds >= 3 THEN 'mixed' WHEN error >= 2 THEN 'hard' END AS scene, labels * 10 + error AS score FROM roll),
o AS (SELECT * FROM s WHERE scene IS NOT NULL QUALIFY row_number() OVER (PARTITION BY origin ORDER BY score DESC, CASE split WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, image) = 1)
SELECT scene, image, score FROM o QUALIFY row_number() OVER (PARTITION BY scene ORDER BY score DESC, image) <= 15""",
)
def r1_scene_pick(spark: SparkSession, d: str) -> DataFrame:
    """The best image of each origin, in its first scene, up to 15 a scene."""
    s = _roll(spark, d).select("image", "split", (F.col("image") % 40).alias("origin"), _first_of([("pile", F.col("labels") >= 4), ("mixed", F.col("kinds") >= 3), ("hard", F.col("error") >= 2)]).alias("scene"), (F.col("labels") * 10 + F.col("error")).alias("score"))
    split = F.when(F.col("split") == "test", 0).when(F.col("split") == "val", 1).otherwise(2)
    o = sel.first_of_key(s.where("scene is not null"), ["origin"], [F.desc("score"), split, F.col("image")])
    return sel.top_per_group(o, ["scene"], [F.desc("score"), F.asc("image")], 15).select("scene", "image", "score")


@query("r10_best_with_props", "SELECT event_type, arg_max(event_id, (value, -event_id)) AS best FROM events WHERE props IS NOT NULL AND len(list_filter(['k'], lambda p: NOT contains(props, '\"' || p || '\"'))) = 0 GROUP BY 1")
def r10_best_with_props(spark: SparkSession, d: str) -> DataFrame:
    """The best row of each kind among those that have all wanted properties."""
    props = F.map_keys(F.from_json("props", "map<string,string>"))
    e = a.table(spark, d, "events").where(F.size(F.array_except(F.array(F.lit("k")), props)) == 0)
    return e.groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"))


@query("r18_lookup_by_path", "SELECT l.doc_id, l.quality, d.source FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id + 1")
def r18_lookup_by_path(spark: SparkSession, d: str) -> DataFrame:
    docs = a.table(spark, d, "documents").select((F.col("doc_id") - 1).alias("doc_id"), "source")
    return a.table(spark, d, "labels").join(docs, "doc_id", "left").select("doc_id", "quality", "source")


@query("r23_role_images", f"{_ROLL} SELECT split AS role, count(DISTINCT image) AS images FROM roll WHERE source_family = 'real' AND labels > 0 GROUP BY 1")
def r23_role_images(spark: SparkSession, d: str) -> DataFrame:
    return _roll(spark, d).where("source_family = 'real' and labels > 0").groupBy(F.col("split").alias("role")).agg(F.countDistinct("image").alias("images"))


@query("r25_box_predicate", f"{_BASE} SELECT image, label_index FROM gt JOIN images USING (image) WHERE (x1 + x2) / 2.0 / width BETWEEN 0.2 AND 0.7 AND (x2 - x1) / width::DOUBLE >= 0.1 AND {sql_area('gt')} / (width * height)::DOUBLE <= 0.04")
def r25_box_predicate(spark: SparkSession, d: str) -> DataFrame:
    b = a.gt_boxes(spark, d).join(a.images(spark, d), "image")
    cx, _, w, h = g.to_centre(g.box(), F.col("width"), F.col("height"))
    return b.where(cx.between(0.2, 0.7) & (w >= 0.1) & (g.area(g.box()) / (F.col("width") * F.col("height")).cast("double") <= 0.04)).select("image", "label_index")


@query("r28_review_counters", f"{_ROLL} SELECT source_group, CASE WHEN error = 0 THEN 'accept' WHEN error = 1 THEN 'check' ELSE 'reject' END AS decision, count(*) AS rows, sum(labels)::BIGINT AS labels FROM roll GROUP BY 1, 2")
def r28_review_counters(spark: SparkSession, d: str) -> DataFrame:
    decision = _first_of([("accept", F.col("error") == 0), ("check", F.col("error") == 1)], "reject")
    return _roll(spark, d).groupBy("source_group", decision.alias("decision")).agg(F.count("*").alias("rows"), F.sum("labels").alias("labels"))
