"""Reports in full: staged metrics, buckets of geometry, background probes, quality packs, gates of crops, targets and ledgers.

Images without labels exist in the view of every third class: labels of other classes don't count, and predictions of other classes are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquarry.functions import geometry as g
from boxquarry.operators import metrics
from boxquarry.operators import selection as sel
from boxquarry.operators import statistics as st
from boxquarry.operators.matching import one_by_one
from boxquarry.plans import adapters as a
from boxquarry.plans.adapters import sql_iou, with_ctes
from boxquarry.plans.detection import _match_sql
from boxquarry.plans.registry import query

_BASE = with_ctes("classes", "images", "gt", "preds")
_VIEW = f"{_BASE}, vg AS MATERIALIZED (SELECT * FROM gt WHERE class_id % 3 = 0)"
SHORT_SIDE = 416


def _view(spark: SparkSession, d: str) -> DataFrame:
    return a.gt_boxes(spark, d).where("class_id % 3 = 0")


def _counter(rows: DataFrame, by: Sequence[str], key: str, name: str, count: Column | None = None) -> DataFrame:
    """Counts of ``key`` as a text k=v;k=v in the order of k, for each group: pre-aggregated, so a group holds its distinct keys only."""
    n = rows.groupBy(*by, key).agg((F.count("*") if count is None else count).alias("_n"))
    held = F.array_sort(F.collect_list(F.struct(F.col(key), "_n")))
    return n.groupBy(*by).agg(F.array_join(F.transform(held, lambda x: F.concat_ws("=", x[key].cast("string"), x["_n"].cast("string"))), ";").alias(name))


# ---- staged metrics ----

_RULES = {"reject": "gate_class = 13 AND gate_conf >= 0.3", "rename": "gate_conf >= 0.6 AND gate_class <> 13"}


def _stages() -> dict:
    def rejected(p: Column) -> Column:
        return (p["gate_class"] == 13) & (p["gate_conf"] >= 0.3)

    def renamed(p: Column) -> Column:
        return p.withField("class_id", F.when((p["gate_conf"] >= 0.6) & (p["gate_class"] != 13), p["gate_class"]).otherwise(p["class_id"]))

    gated = lambda all_: F.filter(all_, lambda p: ~rejected(p))
    return {"raw": lambda all_: F.filter(all_, lambda p: F.lit(True)), "gated": gated, "reclassified": lambda all_: F.transform(gated(all_), renamed)}


def _staged(spark: SparkSession, d: str, best: Sequence[str] = ()) -> DataFrame:
    images = a.images(spark, d).select("image", "split", "source_group", "width", "height")
    return metrics.staged_outcomes(images, a.pred_boxes(spark, d), _view(spark, d), _stages(), more=("gate_class", "gate_conf"), best=best)


def _outcomes(staged: DataFrame) -> DataFrame:
    return staged.select("stage", "split", "source_group", one_by_one(F.col("outcomes"))).where("kind is not null")


_CORNERS = "confidence, x1, y1, x2, y2"
_STAGED = f"""{_VIEW}, st AS MATERIALIZED (SELECT 'raw' AS stage, image, pred_index, class_id, {_CORNERS} FROM preds
 UNION ALL SELECT 'gated', image, pred_index, class_id, {_CORNERS} FROM preds WHERE NOT ({_RULES["reject"]})
 UNION ALL SELECT 'reclassified', image, pred_index, CASE WHEN {_RULES["rename"]} THEN gate_class ELSE class_id END, {_CORNERS} FROM preds WHERE NOT ({_RULES["reject"]})),
{_match_sql("st", "p.stage, p.image").replace("JOIN gt l", "JOIN vg l")},
{_match_sql("st", "p.stage, p.image", on="p.image = l.image", name="n").replace("JOIN gt l", "JOIN vg l")},
br AS (SELECT l.image, l.label_index, max({sql_iou("p", "l")}) AS best FROM vg l JOIN preds p ON p.image = l.image GROUP BY ALL),
lo AS MATERIALIZED (SELECT s.stage, l.image, l.class_id, q.class_id AS other, br.best, CASE WHEN m.image IS NOT NULL THEN 'tp' WHEN q.image IS NULL THEN 'no_box' WHEN q.class_id = l.class_id THEN 'same_class_conflict' ELSE 'wrong_class' END AS kind
 FROM vg l CROSS JOIN (VALUES ('raw'), ('gated'), ('reclassified')) s(stage) LEFT JOIN m ON m.stage = s.stage AND m.image = l.image AND m.label_index = l.label_index
 LEFT JOIN n ON n.stage = s.stage AND n.image = l.image AND n.label_index = l.label_index LEFT JOIN st q ON q.stage = s.stage AND q.image = n.image AND q.pred_index = n.pred_index
 LEFT JOIN br ON br.image = l.image AND br.label_index = l.label_index),
xp AS MATERIALIZED (SELECT st.* FROM st ANTI JOIN m ON m.stage = st.stage AND m.image = st.image AND m.pred_index = st.pred_index)"""
_MONEY = {c: "[" + ", ".join(str(v if cur == c else 0.0) for _, cur, v in a.CLASSES) + "]::DOUBLE[]" for c in ("USD", "KHR")}


def _worth(boxes: str, currency: str) -> Column:
    """Face values of an array of boxes; classes without one are worth nothing."""
    values = F.array(*[F.lit(v if c == currency else 0.0) for _, c, v in a.CLASSES])
    return F.aggregate(boxes, F.lit(0.0), lambda acc, x: acc + F.coalesce(F.get(values, x["class_id"].cast("int")), F.lit(0.0)))


_SUMS_SQL = lambda rel, n: f"SELECT stage, image, count(*) AS {n}, sum(coalesce(({_MONEY['USD']})[class_id + 1], 0)) AS {n}_usd, sum(coalesce(({_MONEY['KHR']})[class_id + 1], 0)) AS {n}_khr FROM {rel} GROUP BY ALL"
_TOTALS = f"""ip AS ({_SUMS_SQL("st", "p")}), il AS ({_SUMS_SQL("(SELECT s.stage, vg.* FROM vg CROSS JOIN (VALUES ('raw'), ('gated'), ('reclassified')) s(stage))", "l")}), ix AS (SELECT stage, image, count(*) AS fp FROM xp GROUP BY ALL),
k AS (SELECT stage, image, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (other IS NOT NULL) AS loc, count(*) FILTER (kind = 'no_box') AS nb, count(*) FILTER (kind = 'wrong_class') AS wc, count(*) FILTER (kind = 'same_class_conflict') AS sc FROM lo GROUP BY ALL),
ar AS (SELECT stage, count(*) FILTER (ratio >= 0.05) AS large, round(max(ratio), 9) AS largest FROM (SELECT stage, (x2 - x1) * (y2 - y1) / (width * height)::DOUBLE AS ratio FROM xp JOIN images USING (image)) GROUP BY 1),
t AS (SELECT s.stage, i.image, coalesce(p, 0) AS p, coalesce(l, 0) AS l, coalesce(p_usd, 0) - coalesce(l_usd, 0) AS usd, coalesce(p_khr, 0) - coalesce(l_khr, 0) AS khr, coalesce(tp, 0) AS tp, coalesce(loc, 0) AS loc, coalesce(nb, 0) AS nb, coalesce(wc, 0) AS wc, coalesce(sc, 0) AS sc, coalesce(fp, 0) AS fp
 FROM images i CROSS JOIN (VALUES ('raw'), ('gated'), ('reclassified')) s(stage) LEFT JOIN ip ON ip.stage = s.stage AND ip.image = i.image LEFT JOIN il ON il.stage = s.stage AND il.image = i.image
 LEFT JOIN ix ON ix.stage = s.stage AND ix.image = i.image LEFT JOIN k ON k.stage = s.stage AND k.image = i.image)"""


@query(
    "g5_staged_metrics",
    f"""{_STAGED}, {_TOTALS} SELECT stage, count(*) AS images, sum(p)::BIGINT AS predictions, sum(l)::BIGINT AS gt, sum(tp)::BIGINT AS tp, sum(l - tp)::BIGINT AS fn, sum(fp)::BIGINT AS fp, sum(loc)::BIGINT AS localization_tp, sum(nb)::BIGINT AS no_box_fn,
 sum(wc)::BIGINT AS wrong_class_fn, sum(sc)::BIGINT AS same_class_conflict_fn, count(*) FILTER (l = 0) AS background_images, count(*) FILTER (l = 0 AND fp > 0) AS background_images_with_fp, count(*) FILTER (fp > 0) AS images_with_fp,
 sum(abs(p - l))::BIGINT AS abs_count_error, sum(abs(usd)) AS abs_usd_error, sum(abs(khr)) AS abs_khr_error, count(*) FILTER (p = l) AS exact_count_images, count(*) FILTER (usd = 0 AND khr = 0) AS exact_value_images, max(large) AS large_fp, max(largest) AS largest_fp,
 round(sum(tp) / nullif(sum(l), 0), 9) AS recall, round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 9) AS precision, round(sum(loc) / nullif(sum(l), 0), 9) AS localization_recall FROM t LEFT JOIN ar USING (stage) GROUP BY stage""",
)
def g5_staged_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Totals before the gate, after it and after renaming: hits, kinds of misses, extras, background images, count and value errors, areas of extras."""
    of = lambda test: F.size(F.filter("outcomes", test)).cast("long")
    kind = lambda name: of(lambda x: x["kind"] == name)
    areas = F.transform(F.filter("_s", lambda p: F.exists("outcomes", lambda x: (x["at"] == p["pred_index"]) & (x["kind"] == "fp"))), lambda p: g.area(g.box_in(p)) / (F.col("width") * F.col("height")).cast("double"))
    rows = _staged(spark, d).withColumn("_areas", areas)
    t = rows.select(
        "stage", F.size("_s").cast("long").alias("p"), F.size("_l").cast("long").alias("l"), (_worth("_s", "USD") - _worth("_l", "USD")).alias("usd"), (_worth("_s", "KHR") - _worth("_l", "KHR")).alias("khr"),
        kind("tp").alias("tp"), kind("fp").alias("fp"), kind("no_box").alias("nb"), kind("wrong_class").alias("wc"), kind("same_class_conflict").alias("sc"), of(lambda x: x["other"].isNotNull()).alias("loc"),
        F.size(F.filter("_areas", lambda r: r >= 0.05)).cast("long").alias("large"), F.array_max("_areas").alias("largest"),
    )
    total = lambda c: F.sum(c)
    share = lambda x, y: F.round(metrics.ratio(F.sum(x), y), 9)
    return t.groupBy("stage").agg(
        F.count("*").alias("images"), total("p").alias("predictions"), total("l").alias("gt"), total("tp").alias("tp"), F.sum(F.col("l") - F.col("tp")).alias("fn"), total("fp").alias("fp"), total("loc").alias("localization_tp"), total("nb").alias("no_box_fn"),
        total("wc").alias("wrong_class_fn"), total("sc").alias("same_class_conflict_fn"), F.count_if(F.col("l") == 0).alias("background_images"), F.count_if((F.col("l") == 0) & (F.col("fp") > 0)).alias("background_images_with_fp"), F.count_if(F.col("fp") > 0).alias("images_with_fp"),
        F.sum(F.abs(F.col("p") - F.col("l"))).alias("abs_count_error"), F.sum(F.abs("usd")).alias("abs_usd_error"), F.sum(F.abs("khr")).alias("abs_khr_error"), F.count_if(F.col("p") == F.col("l")).alias("exact_count_images"),
        F.count_if((F.col("usd") == 0) & (F.col("khr") == 0)).alias("exact_value_images"), total("large").alias("large_fp"), F.round(F.max("largest"), 9).alias("largest_fp"),
        share("tp", F.sum("l")).alias("recall"), share("tp", F.sum("tp") + F.sum("fp")).alias("precision"), share("loc", F.sum("l")).alias("localization_recall"),
    )


@query(
    "g5_staged_by_class",
    f"""{_STAGED}, r AS (SELECT stage, image, class_id, kind, other FROM lo UNION ALL SELECT stage, image, class_id, 'fp', NULL FROM xp) SELECT stage, source_group, class_id, count(*) FILTER (kind <> 'fp') AS gt, count(*) FILTER (kind = 'tp') AS tp,
 count(*) FILTER (kind NOT IN ('tp', 'fp')) AS fn, count(*) FILTER (kind = 'fp') AS fp, count(other) AS localization_tp, count(*) FILTER (kind = 'no_box') AS no_box_fn, count(*) FILTER (kind = 'wrong_class') AS wrong_class_fn, count(*) FILTER (kind = 'same_class_conflict') AS same_class_conflict_fn
 FROM r JOIN images USING (image) GROUP BY ALL""",
)
def g5_staged_by_class(spark: SparkSession, d: str) -> DataFrame:
    r = _outcomes(_staged(spark, d))
    k = lambda *names: F.count_if(F.col("kind").isin(*names))
    misses = ("no_box", "wrong_class", "same_class_conflict")
    return r.groupBy("stage", "source_group", "class_id").agg(k("tp", *misses).alias("gt"), k("tp").alias("tp"), k(*misses).alias("fn"), k("fp").alias("fp"), F.count("other").alias("localization_tp"), *[k(m).alias(f"{m}_fn") for m in misses])


@query(
    "g5_no_box_causes",
    f"""{_STAGED} SELECT stage, source_group, class_id, CASE WHEN best IS NULL THEN 'reference_no_prediction' WHEN best >= 0.5 THEN 'reference_had_box_stage_lost' WHEN best >= 0.3 THEN 'reference_near_miss' WHEN best >= 0.1 THEN 'reference_weak_overlap'
 WHEN best > 0 THEN 'reference_touching' ELSE 'reference_disjoint' END AS cause, count(*) AS labels FROM lo JOIN images USING (image) WHERE kind = 'no_box' GROUP BY ALL""",
)
def g5_no_box_causes(spark: SparkSession, d: str) -> DataFrame:
    """Why a stage has no box for a label: it was lost after the first stage, or how near the first stage came."""
    r = _outcomes(_staged(spark, d, ["best_reference"])).where("kind = 'no_box'")
    best = F.col("best_reference")
    cause = F.when(best >= 0.5, "reference_had_box_stage_lost").otherwise(F.concat(F.lit("reference_"), g.iou_bucket(best, 0.5)))
    return r.groupBy("stage", "source_group", "class_id", cause.alias("cause")).agg(F.count("*").alias("labels"))


# ---- reports of a run ----

_KEPT = f"kp AS MATERIALIZED (SELECT * FROM preds WHERE NOT ({_RULES['reject']}))"


@query(
    "g38_report_rollup",
    f"""{_STAGED}, {_TOTALS}, rj AS (SELECT image, count(*) AS rejected FROM preds WHERE {_RULES["reject"]} GROUP BY 1), c AS (SELECT t.*, i.split, coalesce(rejected, 0) AS rejected, p - l AS e FROM t JOIN images i USING (image) LEFT JOIN rj USING (image) WHERE stage = 'gated')
 SELECT split, count(*) AS case_count, sum(l)::BIGINT AS gt_count, sum(p)::BIGINT AS pred_count, sum(tp)::BIGINT AS matched_same_class, sum(loc)::BIGINT AS matched_any_class, sum(abs(e))::BIGINT AS abs_count_error, sum(abs(khr)) AS abs_khr_error, sum(abs(usd)) AS abs_usd_error,
 count(*) FILTER (tp = l AND e = 0 AND khr = 0 AND usd = 0) AS perfect_cases, sum(rejected)::BIGINT AS rejected_proposals, count(*) FILTER (l = 0) AS hard_negative_case_count, coalesce(sum(p) FILTER (l = 0), 0)::BIGINT AS hard_negative_pred_count,
 count(*) FILTER (l > 0) AS positive_case_count, coalesce(sum(-e) FILTER (l > 0 AND e < 0), 0)::BIGINT AS positive_under_count, coalesce(sum(e) FILTER (l > 0 AND e > 0), 0)::BIGINT AS positive_over_count FROM c GROUP BY split""",
)
def g38_report_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Sums over a report's cases: matches, count and value errors, perfect cases, rejected proposals, hard negatives, boxes too few and too many."""
    images = a.images(spark, d).select("image", "split")
    stages = _stages()
    all_ = metrics.staged_outcomes(images, a.pred_boxes(spark, d), _view(spark, d), {"gated": stages["gated"]}, more=("gate_class", "gate_conf"), best=())
    rejected = a.pred_boxes(spark, d).where(_RULES["reject"]).groupBy("image").agg(F.count("*").alias("rejected"))
    n = lambda test: F.size(F.filter("outcomes", test)).cast("long")
    c = all_.join(rejected, "image", "left").select(
        "split", F.coalesce("rejected", F.lit(0)).alias("rejected"), F.size("_s").cast("long").alias("p"), F.size("_l").cast("long").alias("l"), n(lambda x: x["kind"] == "tp").alias("tp"), n(lambda x: x["other"].isNotNull()).alias("loc"),
        (_worth("_s", "USD") - _worth("_l", "USD")).alias("usd"), (_worth("_s", "KHR") - _worth("_l", "KHR")).alias("khr"),
    ).withColumn("e", F.col("p") - F.col("l"))
    some = lambda test, v: F.coalesce(F.sum(F.when(test, v)), F.lit(0))
    l, e = F.col("l"), F.col("e")
    perfect = (F.col("tp") == l) & (e == 0) & (F.col("khr") == 0) & (F.col("usd") == 0)
    return c.groupBy("split").agg(
        F.count("*").alias("case_count"), F.sum("l").alias("gt_count"), F.sum("p").alias("pred_count"), F.sum("tp").alias("matched_same_class"), F.sum("loc").alias("matched_any_class"), F.sum(F.abs(e)).alias("abs_count_error"), F.sum(F.abs("khr")).alias("abs_khr_error"),
        F.sum(F.abs("usd")).alias("abs_usd_error"), F.count_if(perfect).alias("perfect_cases"), F.sum("rejected").alias("rejected_proposals"), F.count_if(l == 0).alias("hard_negative_case_count"), some(l == 0, F.col("p")).alias("hard_negative_pred_count"),
        F.count_if(l > 0).alias("positive_case_count"), some((l > 0) & (e < 0), -e).alias("positive_under_count"), some((l > 0) & (e > 0), e).alias("positive_over_count"),
    )


_COUNTER = lambda rel, by, key, name: f"SELECT {by}, string_agg({key} || '=' || n, ';' ORDER BY {key}) AS {name} FROM (SELECT {by}, {key}, count(*) AS n FROM {rel} GROUP BY ALL) GROUP BY ALL"


@query(
    "g29_background_fp",
    f"""{_VIEW}, bg AS (SELECT image, source_group FROM images ANTI JOIN vg USING (image)), f AS (SELECT p.*, bg.source_group, c.class_name, p.class_id % 3 <> 0 AS ignored FROM preds p JOIN bg USING (image) LEFT JOIN classes c ON c.class_id = p.class_id),
 bc AS ({_COUNTER("(SELECT * FROM f WHERE NOT ignored)", "source_group", "class_name", "by_class")}), ic AS ({_COUNTER("(SELECT * FROM f WHERE ignored)", "source_group", "class_name", "ignored_by_class")}),
 tp AS (SELECT source_group, string_agg(image || ':' || class_name || ':' || confidence, ' ' ORDER BY confidence DESC, image, pred_index) AS top FROM (SELECT *, row_number() OVER (PARTITION BY source_group ORDER BY confidence DESC, image, pred_index) AS r FROM f WHERE NOT ignored) WHERE r <= 5 GROUP BY 1)
 SELECT source_group, n.images, count(DISTINCT f.image) FILTER (NOT ignored) AS images_with_fp, count(*) FILTER (NOT ignored) AS detections, count(f.image) AS raw_detections, count(*) FILTER (ignored) AS ignored_detections,
 round(count(*) FILTER (NOT ignored) / n.images, 9) AS fp_per_image, max(by_class) AS by_class, max(ignored_by_class) AS ignored_by_class, max(top) AS top FROM (SELECT source_group, count(*) AS images FROM bg GROUP BY 1) n LEFT JOIN f USING (source_group) LEFT JOIN bc USING (source_group) LEFT JOIN ic USING (source_group) LEFT JOIN tp USING (source_group) GROUP BY 1, 2""",
)
def g29_background_fp(spark: SparkSession, d: str) -> DataFrame:
    """Detections on images that have no label, by root: counts with and without ignored classes, both by class, and the five surest."""
    bg = a.images(spark, d).join(_view(spark, d).select("image"), "image", "left_anti").select("image", "source_group")
    f = a.pred_boxes(spark, d).join(bg, "image").join(a.classes(spark).select("class_id", "class_name"), "class_id", "left").withColumn("ignored", F.col("class_id") % 3 != 0)
    by = ["source_group"]
    per = f.groupBy("image").agg(F.count_if(~F.col("ignored")).alias("kept"), F.count("*").alias("raw"))
    n = bg.join(per, "image", "left").groupBy(*by).agg(F.count("*").alias("images"), F.count_if(F.col("kept") > 0).alias("images_with_fp"), F.coalesce(F.sum("kept"), F.lit(0)).alias("detections"), F.coalesce(F.sum("raw"), F.lit(0)).alias("raw_detections"))
    kept = f.where("not ignored")
    first = sel.top_per_group(kept, by, [F.desc("confidence"), F.col("image"), F.col("pred_index")], 5, "_r").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(":", "image", "class_name", "confidence").alias("t")))).alias("_t"))
    out = n.join(_counter(kept, by, "class_name", "by_class"), by, "left").join(_counter(f.where("ignored"), by, "class_name", "ignored_by_class"), by, "left").join(first, by, "left")
    top = F.array_join(F.transform("_t", lambda x: x["t"]), " ")
    return out.select("source_group", "images", "images_with_fp", "detections", "raw_detections", (F.col("raw_detections") - F.col("detections")).alias("ignored_detections"), F.round(F.col("detections") / F.col("images"), 9).alias("fp_per_image"), "by_class", "ignored_by_class", top.alias("top"))


# ---- geometry of source groups ----

_LEVELS = [("split", "''", "''"), ("source", "source_group", "''"), ("class", "source_group", "class_id::VARCHAR")]
_QUANTS = ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {n}_p{int(100 * q)}" for c, n in (("am", "area"), ("sm", "short")) for q in (0.1, 0.5, 0.9))


@query(
    "g14_rollup_levels",
    f"""{_VIEW}, b AS (SELECT image, split, source_group, class_id, (x2 - x1) * (y2 - y1) * 1000000 // (width * height) AS am, least((x2 - x1) * 1000000 // width, (y2 - y1) * 1000000 // height) * {SHORT_SIDE} AS sm FROM vg JOIN images USING (image)),
 im AS (SELECT i.image, split, source_group, count(class_id) AS n, count(DISTINCT class_id) AS k FROM images i LEFT JOIN vg USING (image) GROUP BY ALL), ic AS (SELECT DISTINCT image, class_id FROM vg),
 li AS (SELECT 'split' AS level, split, '' AS source_group, '' AS class, image, n, k FROM im UNION ALL SELECT 'source', split, source_group, '', image, n, k FROM im UNION ALL SELECT 'class', split, source_group, class_id::VARCHAR, image, n, k FROM im JOIN ic USING (image)),
 lb AS (SELECT 'split' AS level, split, '' AS source_group, '' AS class, am, sm FROM b UNION ALL SELECT 'source', split, source_group, '', am, sm FROM b UNION ALL SELECT 'class', split, source_group, class_id::VARCHAR, am, sm FROM b),
 x AS (SELECT level, split, source_group, class, count(*) AS boxes, round(avg(am), 6) AS area_mean, {_QUANTS}, count(*) FILTER (am >= 50000) AS area_large, count(*) FILTER (sm < 32 * 1000000) AS short_small FROM lb GROUP BY ALL),
 h1 AS (SELECT level, split, source_group, class, string_agg(n || '=' || c, ';' ORDER BY n) AS boxes_per_image FROM (SELECT level, split, source_group, class, n, count(*) AS c FROM li GROUP BY ALL) GROUP BY ALL),
 h2 AS (SELECT level, split, source_group, class, string_agg(k || '=' || n, ';' ORDER BY k) AS classes_per_image FROM (SELECT level, split, source_group, class, k, count(*) AS n FROM li GROUP BY ALL) GROUP BY ALL),
 ex AS (SELECT level, split, source_group, class, string_agg(image::VARCHAR, ' ' ORDER BY image) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY level, split, source_group, class ORDER BY image) AS r FROM li WHERE n > 0) WHERE r <= 3 GROUP BY ALL)
 SELECT level, split, source_group, class, count(*) AS images, count(*) FILTER (n > 0) AS labeled_images, count(*) FILTER (n = 0) AS empty_images, coalesce(max(boxes), 0) AS boxes, round(coalesce(max(boxes), 0) / count(*), 6) AS box_density, max(boxes_per_image) AS boxes_per_image, max(classes_per_image) AS classes_per_image,
 max(area_mean) AS area_mean, max(area_p10) AS area_p10, max(area_p50) AS area_p50, max(area_p90) AS area_p90, coalesce(max(area_large), 0) AS area_large, max(short_p10) AS short_p10, max(short_p50) AS short_p50, max(short_p90) AS short_p90, coalesce(max(short_small), 0) AS short_small, max(examples) AS examples
 FROM li LEFT JOIN x USING (level, split, source_group, class) LEFT JOIN h1 USING (level, split, source_group, class) LEFT JOIN h2 USING (level, split, source_group, class) LEFT JOIN ex USING (level, split, source_group, class) GROUP BY ALL""",
)
def g14_rollup_levels(spark: SparkSession, d: str) -> DataFrame:
    """Geometry of labels by split, by source group and by class there: histograms of boxes and classes an image, quantiles of areas and short sides, examples.

    Areas are millionths of the image and sides are millionths of its side times 416, as label files have six decimals: exact quantiles so hold a bounded
    number of distinct values at any number of boxes.
    """
    by = ["level", "split", "source_group", "class"]
    labels = _view(spark, d).groupBy("image").agg(F.collect_list(F.struct("class_id", "x1", "y1", "x2", "y2")).alias("_l"))
    im = a.images(spark, d).join(labels, "image", "left").withColumn("_l", F.coalesce("_l", F.array()))
    level = lambda name, source, cls, kept: F.struct(F.lit(name).alias("level"), source.alias("source_group"), cls.alias("class"), kept.alias("kept"))
    none, source = F.lit(""), F.col("source_group")
    own = F.transform(F.array_distinct(F.transform("_l", lambda x: x["class_id"])), lambda c: level("class", source, c.cast("string"), F.filter("_l", lambda x: x["class_id"] == c)))
    sizes = [F.size("_l").alias("n"), F.size(F.array_distinct(F.transform("_l", lambda x: x["class_id"]))).alias("k")]
    li = im.select("image", "split", "width", "height", *sizes, F.inline(F.concat(F.array(level("split", none, none, F.col("_l")), level("source", source, none, F.col("_l"))), own)))
    side = lambda x, hi, lo, of: F.expr(f"(b.{hi} - b.{lo}) * 1000000 div {of}")
    lb = li.select(*by, "width", "height", F.explode("kept").alias("b")).select(*by, F.expr("(b.x2 - b.x1) * (b.y2 - b.y1) * 1000000 div (width * height)").alias("am"), (F.least(side("x", "x2", "x1", "width"), side("y", "y2", "y1", "height")) * SHORT_SIDE).alias("sm"))
    q = [F.round(F.percentile(c, F.lit(s)), 6).alias(f"{n}_p{int(100 * s)}") for c, n in (("am", "area"), ("sm", "short")) for s in (0.1, 0.5, 0.9)]
    x = lb.groupBy(*by).agg(F.count("*").alias("_boxes"), F.round(F.avg("am"), 6).alias("area_mean"), *q, F.count_if(F.col("am") >= 50000).alias("_large"), F.count_if(F.col("sm") < 32 * 1000000).alias("_small"))
    first = sel.top_per_group(li.where("n > 0").select(*by, "image"), by, [F.col("image")], 3).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("image")), lambda i: i.cast("string")), " ").alias("examples"))
    out = li.groupBy(*by).agg(F.count("*").alias("images"), F.count_if(F.col("n") > 0).alias("labeled_images"), F.count_if(F.col("n") == 0).alias("empty_images"))
    for more in (x, _counter(li, by, "n", "boxes_per_image"), _counter(li, by, "k", "classes_per_image"), first):
        out = out.join(more, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        *by, "images", "labeled_images", "empty_images", zero("_boxes").alias("boxes"), F.round(zero("_boxes") / F.col("images"), 6).alias("box_density"), "boxes_per_image", "classes_per_image", "area_mean", "area_p10", "area_p50", "area_p90",
        zero("_large").alias("area_large"), "short_p10", "short_p50", "short_p90", zero("_small").alias("short_small"), "examples",
    )


# ---- quality pack ----

TINY, SMALL = 20.0, 32.0
_QUALITY = f"""{_VIEW}, s AS (SELECT image, count(*) AS note_count, min(least(x2 - x1, y2 - y1)) AS least_short, median(least(x2 - x1, y2 - y1)) AS mid_short, min((x2 - x1) * (y2 - y1)) AS least_area, median((x2 - x1) * (y2 - y1)) AS mid_area FROM vg GROUP BY 1),
q0 AS (SELECT i.image, i.source_group, coalesce(note_count, 0) AS note_count, coalesce(least_short, 0)::DOUBLE AS min_short_px, coalesce(mid_short, 0) AS median_short_px, coalesce(least_short * {SHORT_SIDE} / greatest(width, height)::DOUBLE, 0) AS min_train_short_px, coalesce(mid_short * {SHORT_SIDE} / greatest(width, height)::DOUBLE, 0) AS median_train_short_px,
 coalesce(mid_area / (width * height)::DOUBLE, 0) AS median_area_frac, CASE WHEN note_count IS NULL THEN 0 ELSE o_totalprice END AS sharpness FROM images i JOIN orders o ON o.o_orderkey = i.image LEFT JOIN s USING (image)),
sc AS (SELECT coalesce(quantile_cont(sharpness, 0.1) FILTER (note_count > 0), 0) AS cutoff FROM q0),
q AS (SELECT q0.*, cutoff, concat_ws(';', CASE WHEN note_count = 0 THEN 'no_labels' END, CASE WHEN min_train_short_px < {TINY} THEN 'tiny_at_416' WHEN min_train_short_px < {SMALL} THEN 'small_at_416' END, CASE WHEN sharpness < cutoff THEN 'soft_crop' END) AS flags FROM q0, sc)"""


def _quality(spark: SparkSession, d: str) -> DataFrame:
    """Each image's numbers for the quality pack and its flags; the soft cutoff is the tenth percentile of the images with notes.

    No table has pixels: an order's price stands for the sharpness of an image's softest crop.
    """
    short, area = F.least(F.expr("x2 - x1"), F.expr("y2 - y1")), g.area(g.box())
    s = _view(spark, d).groupBy("image").agg(F.count("*").alias("notes"), F.min(short).alias("least_short"), F.percentile(short, F.lit(0.5)).alias("mid_short"), F.percentile(area, F.lit(0.5)).alias("mid_area"))
    price = a.table(spark, d, "orders").select(F.col("o_orderkey").alias("image"), "o_totalprice")
    longest = F.greatest("width", "height").cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    q = a.images(spark, d).join(price, "image").join(s, "image", "left").select(
        "image", "source_group", F.coalesce("notes", F.lit(0)).alias("note_count"), zero(F.col("least_short").cast("double")).alias("min_short_px"), zero(F.col("mid_short")).alias("median_short_px"), zero(F.col("least_short") * SHORT_SIDE / longest).alias("min_train_short_px"),
        zero(F.col("mid_short") * SHORT_SIDE / longest).alias("median_train_short_px"), zero(F.col("mid_area") / (F.col("width") * F.col("height")).cast("double")).alias("median_area_frac"), F.when(F.col("notes").isNull(), 0.0).otherwise(F.col("o_totalprice")).alias("sharpness"),
    )
    cut = st.quantiles(q.where("note_count > 0"), [], "sharpness", {"cutoff": 0.1}).agg(F.coalesce(F.max("cutoff"), F.lit(0.0)).alias("cutoff"))
    size = F.col("min_train_short_px")
    flags = F.concat_ws(";", F.when(F.col("note_count") == 0, "no_labels"), F.when(size < TINY, "tiny_at_416").when(size < SMALL, "small_at_416"), F.when(F.col("sharpness") < F.col("cutoff"), "soft_crop"))
    return q.crossJoin(F.broadcast(cut)).withColumn("flags", flags)


@query("g32_visual_flags", f"{_QUALITY} SELECT image, note_count, min_short_px, median_short_px, round(min_train_short_px, 6) AS min_train_short_px, round(median_train_short_px, 6) AS median_train_short_px, round(median_area_frac, 9) AS median_area_frac, flags FROM q")
def g32_visual_flags(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).select("image", "note_count", "min_short_px", "median_short_px", F.round("min_train_short_px", 6).alias("min_train_short_px"), F.round("median_train_short_px", 6).alias("median_train_short_px"), F.round("median_area_frac", 9).alias("median_area_frac"), "flags")


_SHARES = {"p00": 0.0, "p05": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p100": 1.0}
_LIMITS = [("tiny_fraction", ">", 0.2), ("small_fraction", ">", 0.3), ("soft_fraction", ">", 0.15), ("p05", "<", 16.0), ("p50", "<", 30.0)]


@query(
    "l28_quality_fractions",
    f"""{_QUALITY}, f AS (SELECT count(*) AS images, greatest(count(*) FILTER (note_count > 0), 1) AS note_rows, max(cutoff) AS cutoff, count(*) FILTER (note_count = 0) AS no_labels, count(*) FILTER (contains(flags, 'tiny_at_416')) AS tiny, count(*) FILTER (contains(flags, 'small_at_416')) AS small, count(*) FILTER (contains(flags, 'soft_crop')) AS soft,
 {", ".join(f"quantile_cont(min_train_short_px, {s}) FILTER (note_count > 0) AS {n}" for n, s in _SHARES.items())} FROM q), v AS (SELECT *, tiny / note_rows AS tiny_fraction, small / note_rows AS small_fraction, soft / note_rows AS soft_fraction FROM f)
 SELECT images, note_rows, round(cutoff, 4) AS soft_cutoff, no_labels, tiny, small, soft, {", ".join(f"round({n}, 6) AS {n}" for n in _SHARES)}, round(tiny_fraction, 9) AS tiny_fraction, round(small_fraction, 9) AS small_fraction, round(soft_fraction, 9) AS soft_fraction,
 concat_ws(';', {", ".join(f"CASE WHEN {n} {o} {v} THEN '{n}' END" for n, o, v in _LIMITS)}) AS failures FROM v""",
)
def l28_quality_fractions(spark: SparkSession, d: str) -> DataFrame:
    """The pack's flags counted, quantiles of the smallest notes, and which of five limits it fails."""
    q = _quality(spark, d)
    has = lambda f: F.count_if(F.contains("flags", F.lit(f)))
    f = q.agg(F.count("*").alias("images"), F.greatest(F.count_if(F.col("note_count") > 0), F.lit(1)).alias("note_rows"), F.max("cutoff").alias("cutoff"), F.count_if(F.col("note_count") == 0).alias("no_labels"), has("tiny_at_416").alias("tiny"), has("small_at_416").alias("small"), has("soft_crop").alias("soft"))
    f = f.crossJoin(F.broadcast(st.quantiles(q.where("note_count > 0"), [], "min_train_short_px", _SHARES)))
    f = f.withColumns({f"{n}_fraction": F.col(n) / F.col("note_rows") for n in ("tiny", "small", "soft")})
    failed = [F.when(F.expr(f"{n} {o} {v}d"), n) for n, o, v in _LIMITS]
    return f.select("images", "note_rows", F.round("cutoff", 4).alias("soft_cutoff"), "no_labels", "tiny", "small", "soft", *[F.round(n, 6).alias(n) for n in _SHARES], *[F.round(f"{n}_fraction", 9).alias(f"{n}_fraction") for n in ("tiny", "small", "soft")], F.concat_ws(";", *failed).alias("failures"))


# ---- synthetic against real ----

#: Limits of mean differences of boxes, whole tables and single classes.
BOX_LIMITS = {"box_area": 0.25, "box_width": 0.35, "box_height": 0.35, "box_aspect": 0.20}
CLASS_LIMITS = {"box_area": 0.30, "box_width": 0.40, "box_height": 0.40, "box_aspect": 0.25}
_METRIC_SQL = {"box_area": "(x2 - x1) * (y2 - y1) / (width * height)::DOUBLE", "box_width": "(x2 - x1) / width::DOUBLE", "box_height": "(y2 - y1) / height::DOUBLE", "box_aspect": "(x2 - x1) / (y2 - y1)::DOUBLE"}
_MEASURED = f"{_BASE}, mb AS (SELECT image, class_id, source_group, source_family, {', '.join(f'{e} AS {n}' for n, e in _METRIC_SQL.items())} FROM gt JOIN images USING (image))"


def _measured(spark: SparkSession, d: str) -> DataFrame:
    b = a.gt_boxes(spark, d).join(a.images(spark, d), "image")
    return b.select("image", "class_id", "source_group", "source_family", *[F.expr(e.replace("::DOUBLE", "")).cast("double").alias(n) for n, e in _METRIC_SQL.items()])


def _deltas(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Means of the real and of the synthetic boxes and their difference by metric: (by, metric, real, synthetic, delta, real_boxes, synthetic_boxes)."""
    long = rows.select(*by, "source_family", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in BOX_LIMITS])))
    mean = lambda f: F.avg(F.when(F.col("source_family") == f, F.col("v")))
    n = lambda f: F.count_if(F.col("source_family") == f)
    out = long.groupBy(*by, "metric").agg(mean("real").alias("real"), mean("synthetic").alias("synthetic"), n("real").alias("real_boxes"), n("synthetic").alias("synthetic_boxes"))
    return out.withColumn("delta", F.col("synthetic") - F.col("real"))


_LONG = "SELECT {by} source_family, unnest([{names}]) AS metric, unnest([{values}]) AS v FROM mb"
_DELTA_SQL = lambda by: f"SELECT {by} metric, avg(v) FILTER (source_family = 'real') AS real, avg(v) FILTER (source_family = 'synthetic') AS synthetic, count(*) FILTER (source_family = 'real') AS real_boxes, count(*) FILTER (source_family = 'synthetic') AS synthetic_boxes FROM ({_LONG.format(by=by, names=', '.join(repr(n) for n in BOX_LIMITS), values=', '.join(BOX_LIMITS))}) GROUP BY ALL"
_LIMIT_SQL = lambda limits, share: "CASE metric " + " ".join(f"WHEN '{n}' THEN {round(v * share, 6)}" for n, v in limits.items()) + " END"
MIN_CROPS = 1000
#: The registered gate asks for a fiftieth of the limits, so that some of the given boxes fail.
GATE_SHARE = 0.02


def crop_gate(measured: DataFrame, classes: DataFrame, crop_limits: dict[str, float], class_limits: dict[str, float], least: int) -> DataFrame:
    """A row for each check (scope, class_id, metric, delta, allowed, failure): failure is null where it passes.

    A family needs ``least`` crops; the means of synthetic and real crops may differ by the limit of each metric, over all and within each class of ``classes``.
    A class without crops of both families is unavailable, and so is every metric where a family has none.
    """
    limit = lambda limits: F.coalesce(*[F.when(F.col("metric") == n, F.lit(v)) for n, v in limits.items()])
    failure = F.when(F.col("delta").isNull(), "unavailable").when(F.abs("delta") > F.col("allowed"), "exceeds")
    whole = measured.sparkSession.createDataFrame([(n,) for n in crop_limits], "metric string").join(_deltas(measured, []), "metric", "left")
    crops = whole.select(F.lit("crop").alias("scope"), F.lit(None).cast("long").alias("class_id"), "metric", "delta", limit(crop_limits).alias("allowed"))
    grid = classes.select("class_id").crossJoin(F.broadcast(measured.sparkSession.createDataFrame([(n,) for n in class_limits], "metric string")))
    within = grid.join(_deltas(measured, ["class_id"]), ["class_id", "metric"], "left").select(F.lit("class").alias("scope"), "class_id", "metric", "delta", limit(class_limits).alias("allowed"))
    n = measured.agg(F.count_if(F.col("source_family") == "real").alias("real"), F.count_if(F.col("source_family") == "synthetic").alias("synthetic"))
    few = lambda f: F.struct(F.lit("family").alias("scope"), F.lit(None).cast("long").alias("class_id"), F.lit(f).alias("metric"), F.col(f).cast("double").alias("delta"), F.lit(float(least)).alias("allowed"), F.when(F.col(f) == 0, "missing").when(F.col(f) < least, "below_minimum").alias("failure"))
    return crops.unionByName(within).withColumn("failure", failure).unionByName(n.select(F.inline(F.array(few("real"), few("synthetic"))))).withColumn("delta", F.round("delta", 6))


_FAMILIES = " UNION ALL ".join(f"SELECT 'family', NULL, '{f}', count(*) FILTER (source_family = '{f}')::DOUBLE, {float(MIN_CROPS)}, CASE WHEN count(*) FILTER (source_family = '{f}') = 0 THEN 'missing' WHEN count(*) FILTER (source_family = '{f}') < {MIN_CROPS} THEN 'below_minimum' END FROM mb" for f in ("real", "synthetic"))


@query(
    "l6_crop_visual_gate",
    f"""{_MEASURED}, w AS ({_DELTA_SQL("")}), c AS ({_DELTA_SQL("class_id,")}), names AS (SELECT unnest([{", ".join(repr(n) for n in BOX_LIMITS)}]) AS metric),
 ch AS (SELECT 'crop' AS scope, NULL::BIGINT AS class_id, metric, synthetic - real AS delta, {_LIMIT_SQL(BOX_LIMITS, GATE_SHARE)} AS allowed FROM names LEFT JOIN w USING (metric) UNION ALL SELECT 'class', class_id, metric, synthetic - real, {_LIMIT_SQL(CLASS_LIMITS, GATE_SHARE)} FROM (SELECT class_id, metric FROM classes, names) k LEFT JOIN c USING (class_id, metric)),
 u AS (SELECT scope, class_id, metric, delta, allowed::DOUBLE AS allowed, CASE WHEN delta IS NULL THEN 'unavailable' WHEN abs(delta) > allowed THEN 'exceeds' END AS failure FROM ch UNION ALL {_FAMILIES}) SELECT scope, class_id, metric, round(delta, 6) AS delta, allowed, failure FROM u""",
)
def l6_crop_visual_gate(spark: SparkSession, d: str) -> DataFrame:
    share = lambda limits: {n: round(v * GATE_SHARE, 6) for n, v in limits.items()}
    return crop_gate(_measured(spark, d), a.classes(spark).select(F.col("class_id").cast("long")), share(BOX_LIMITS), share(CLASS_LIMITS), MIN_CROPS)


_SEVERITY = ", ".join(f"abs(max(synthetic - real) FILTER (metric = '{n}')) / {v}" for n, v in BOX_LIMITS.items())


@query(
    "h18_source_group_targets",
    f"""{_MEASURED}, r AS (SELECT metric, real FROM ({_DELTA_SQL("")})), s AS (SELECT source_group, metric, synthetic, synthetic_boxes FROM ({_DELTA_SQL("source_group,")})), si AS (SELECT source_group, count(*) AS n FROM images WHERE source_family = 'synthetic' GROUP BY 1),
 t AS (SELECT source_group, max(synthetic_boxes) AS synthetic_boxes, [{_SEVERITY}] AS sev, {", ".join(f"max(synthetic - real) FILTER (metric = '{n}') AS delta_{n}" for n in BOX_LIMITS)} FROM s JOIN r USING (metric) GROUP BY 1)
 SELECT source_group, coalesce(si.n, 0) AS synthetic_images, synthetic_boxes, [{", ".join(repr(n) for n in BOX_LIMITS)}][list_position(sev, list_max(sev))] AS dominant_metric, round(list_max(sev), 6) AS severity, {", ".join(f"round(delta_{n}, 6) AS delta_{n}" for n in BOX_LIMITS)},
 CASE WHEN {" AND ".join(f"delta_{n} < 0" for n in BOX_LIMITS if n != "box_aspect")} THEN 'increase_scale' ELSE 'review_group' END AS repair FROM t LEFT JOIN si USING (source_group) WHERE synthetic_boxes > 0""",
)
def h18_source_group_targets(spark: SparkSession, d: str) -> DataFrame:
    """Each source group's synthetic boxes against all real ones: differences of four metrics, the worst by its limit, and what to do."""
    m = _measured(spark, d)
    real = _deltas(m, []).select("metric", F.col("real").alias("of_real"))
    by_group = _deltas(m, ["source_group"]).join(F.broadcast(real), "metric").withColumn("delta", F.col("synthetic") - F.col("of_real"))
    wide = by_group.where("synthetic_boxes > 0").groupBy("source_group").agg(F.max("synthetic_boxes").alias("synthetic_boxes"), *[F.max(F.when(F.col("metric") == n, F.col("delta"))).alias(f"delta_{n}") for n in BOX_LIMITS])
    n = a.images(spark, d).where("source_family = 'synthetic'").groupBy("source_group").agg(F.count("*").alias("synthetic_images"))
    severity = F.array(*[F.abs(f"delta_{m}") / F.lit(v) for m, v in BOX_LIMITS.items()])
    worst = F.array_max(severity)
    smaller = F.lit(True)
    for m in BOX_LIMITS:
        smaller = smaller if m == "box_aspect" else smaller & (F.col(f"delta_{m}") < 0)
    return wide.join(n, "source_group", "left").select(
        "source_group", F.coalesce("synthetic_images", F.lit(0)).alias("synthetic_images"), "synthetic_boxes", F.get(F.array(*[F.lit(m) for m in BOX_LIMITS]), (F.array_position(severity, worst) - 1).cast("int")).alias("dominant_metric"), F.round(worst, 6).alias("severity"),
        *[F.round(f"delta_{m}", 6).alias(f"delta_{m}") for m in BOX_LIMITS], F.when(smaller, "increase_scale").otherwise("review_group").alias("repair"),
    )


@query(
    "k3_feature_means",
    """WITH e AS (SELECT vec_id % 2 AS domain, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, len(embedding) + 1) t(i)), m AS (SELECT i - 1 AS feature, round(avg(v) FILTER (domain = 0), 6) AS mean_even, round(avg(v) FILTER (domain = 1), 6) AS mean_odd FROM e WHERE isfinite(v) GROUP BY 1)
 SELECT feature, mean_even, mean_odd, round(mean_even - mean_odd, 6) AS delta FROM m""",
)
def k3_feature_means(spark: SparkSession, d: str) -> DataFrame:
    """Each feature's mean in two domains and the difference; values that aren't finite don't count."""
    e = a.table(spark, d, "embeddings").select((F.col("vec_id") % 2).alias("domain"), F.posexplode("embedding").alias("feature", "v")).withColumn("v", F.col("v").cast("double"))
    e = e.where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    mean = lambda k: F.round(F.avg(F.when(F.col("domain") == k, F.col("v"))), 6)
    return e.groupBy(F.col("feature").cast("long").alias("feature")).agg(mean(0).alias("mean_even"), mean(1).alias("mean_odd")).withColumn("delta", F.round(F.col("mean_even") - F.col("mean_odd"), 6))
