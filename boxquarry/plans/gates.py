"""Gates, scorecards and sweeps: rows of checks with a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquarry.functions import geometry as g
from boxquarry.operators import matching
from boxquarry.plans import adapters as a
from boxquarry.plans.adapters import sql_area, with_ctes
from boxquarry.plans.detection import _match_sql
from boxquarry.plans.queues import _ROLL, _roll
from boxquarry.plans.registry import query

_BASE = with_ctes("classes", "images", "gt", "preds")


_RESCUE = "grid(rescue) AS (VALUES (0.6::DOUBLE), (0.8::DOUBLE), (0.95::DOUBLE))"


@query(
    "l3_rescue_sweep",
    f"""{_BASE}, {_RESCUE}, gp AS (SELECT rescue, preds.* FROM grid, preds WHERE pred_index % 2 = 0 AND confidence >= 0.25 OR pred_index % 2 = 1 AND confidence >= rescue), {_match_sql(preds='gp', keys='p.rescue, p.image')},
s AS (SELECT rescue, count(*) AS tp FROM m GROUP BY 1), n AS (SELECT rescue, count(*) AS predictions FROM gp GROUP BY 1) SELECT rescue, predictions, tp, predictions - tp AS fp, (SELECT count(*) FROM gt) - tp AS fn FROM n JOIN s USING (rescue)""",
)
def l3_rescue_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A base model's boxes with those of a second model from some confidence on."""
    out = matching.sweep(a.pred_boxes(spark, d), a.gt_boxes(spark, d), [{"rescue": r} for r in (0.6, 0.8, 0.95)], lambda p, g: (p["pred_index"] % 2 == 0) & (p["confidence"] >= 0.25) | (p["pred_index"] % 2 == 1) & (p["confidence"] >= g["rescue"]))
    return out.select("rescue", "predictions", "tp", (F.col("predictions") - F.col("tp")).alias("fp"), (F.col("gt") - F.col("tp")).alias("fn"))


@query(
    "l4_two_stage_sweep",
    f"""{_BASE}, grid(det, cls) AS (SELECT d, c FROM (VALUES (0.3::DOUBLE), (0.6::DOUBLE)) x(d), (VALUES (0.2::DOUBLE), (0.5::DOUBLE)) y(c)),
gp AS (SELECT det, cls, image, pred_index, confidence, x1, y1, x2, y2, CASE WHEN gate_conf >= cls THEN gate_class ELSE class_id END AS class_id FROM grid, preds WHERE confidence >= det), {_match_sql(preds='gp', keys='p.det, p.cls, p.image')},
s AS (SELECT det, cls, count(*) AS tp FROM m GROUP BY ALL), n AS (SELECT det, cls, count(*) AS predictions FROM gp GROUP BY ALL) SELECT det, cls, predictions, coalesce(tp, 0) AS tp FROM n LEFT JOIN s USING (det, cls)""",
)
def l4_two_stage_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Detector threshold times the threshold from which the second stage names the class."""
    grid = [{"det": x, "cls": y} for x in (0.3, 0.6) for y in (0.2, 0.5)]
    named = lambda p, g: F.when(p["gate_conf"] >= g["cls"], p["gate_class"]).otherwise(p["class_id"])
    return matching.sweep(a.pred_boxes(spark, d), a.gt_boxes(spark, d), grid, lambda p, g: p["confidence"] >= g["det"], named).drop("gt")


def _checks_sql(source: str, rules: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS name, {value}::DOUBLE AS value, {passed} AS passed FROM {source}" for name, value, passed in rules)


def _checks(one: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """One row of figures as rows of checks (name, value, passed)."""
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"), p.alias("passed")) for n, v, p in rules])))


@query(
    "l7_negative_gate",
    f"{_BASE}, x AS (SELECT image, count(*) AS n, max(confidence) AS c FROM preds ANTI JOIN (SELECT image FROM gt WHERE class_id < 8) k USING (image) GROUP BY 1), f AS (SELECT count(*) AS images, round(avg(n), 6) AS mean, count(*) FILTER (c >= 0.9) AS sure FROM x) {_checks_sql('f', [('boxes_an_image', 'mean', 'mean <= 2'), ('sure_images', 'sure', 'sure * 2 <= images')])}",
)
def l7_negative_gate(spark: SparkSession, d: str) -> DataFrame:
    p = a.pred_boxes(spark, d).join(a.gt_boxes(spark, d).where("class_id < 8").select("image"), "image", "left_anti")
    one = p.groupBy("image").agg(F.count("*").alias("n"), F.max("confidence").alias("c")).agg(F.count("*").alias("images"), F.round(F.avg("n"), 6).alias("mean"), F.count_if(F.col("c") >= 0.9).alias("sure"))
    return _checks(one, [("boxes_an_image", F.col("mean"), F.col("mean") <= 2), ("sure_images", F.col("sure"), F.col("sure") * 2 <= F.col("images"))])


_REPLICATE = "rep AS (SELECT class_id, pred_index % 3 AS replicate, round(avg(confidence), 9) AS score FROM preds GROUP BY 1, 2)"


def _replicates(spark: SparkSession, d: str) -> DataFrame:
    return a.pred_boxes(spark, d).groupBy("class_id", (F.col("pred_index") % 3).alias("replicate")).agg(F.round(F.avg("confidence"), 9).alias("score"))


@query("l9_replicate_checks", f"{_BASE}, {_REPLICATE}, f AS (SELECT class_id, count(*) AS runs, max(score) - min(score) AS spread FROM rep GROUP BY 1) SELECT class_id, runs, round(spread, 6) AS spread, runs >= 3 AND round(spread, 6) <= 0.05 AS passed FROM f")
def l9_replicate_checks(spark: SparkSession, d: str) -> DataFrame:
    f = _replicates(spark, d).groupBy("class_id").agg(F.count("*").alias("runs"), F.round(F.max("score") - F.min("score"), 6).alias("spread"))
    return f.withColumn("passed", (F.col("runs") >= 3) & (F.col("spread") <= 0.05))


@query("g21_per_class_replicates", f"{_BASE}, {_REPLICATE}, b AS (SELECT class_id, avg(score) AS m FROM rep WHERE replicate < 2 GROUP BY 1), c AS (SELECT class_id, score FROM rep WHERE replicate = 2) SELECT coalesce(b.class_id, c.class_id) AS class_id, round(m, 6) AS baseline, round(score, 6) AS candidate, round(score - m, 6) AS delta FROM b FULL JOIN c ON b.class_id = c.class_id")
def g21_per_class_replicates(spark: SparkSession, d: str) -> DataFrame:
    r = _replicates(spark, d)
    b, c = r.where("replicate < 2").groupBy("class_id").agg(F.avg("score").alias("m")), r.where("replicate = 2").select("class_id", "score")
    return b.join(c, "class_id", "full_outer").select("class_id", F.round("m", 6).alias("baseline"), F.round("score", 6).alias("candidate"), F.round(F.col("score") - F.col("m"), 6).alias("delta"))


@query("l10_transfer_scorecard", f"{_ROLL}, s AS (SELECT split, count(*) FILTER (error = 0) / count(*) AS exact, avg(error) AS mean FROM roll WHERE (image // 10) % 2 = 0 GROUP BY 1), t AS (SELECT split, count(*) FILTER (error = 0) / count(*) AS exact, avg(error) AS mean FROM roll WHERE (image // 10) % 2 = 1 GROUP BY 1) SELECT split, round(t.exact - s.exact, 6) AS exact_delta, round(t.mean - s.mean, 6) AS error_delta, CASE WHEN round(t.exact - s.exact, 6) >= -0.02 AND round(t.mean - s.mean, 6) <= 0.05 THEN 'pass' ELSE 'fail' END AS status FROM s JOIN t USING (split)")
def l10_transfer_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """The candidate's figures (odd tens) against the baseline's in each split."""
    r = _roll(spark, d).withColumn("arm", F.expr("(image div 10) % 2"))
    exact = lambda k: F.count_if((F.col("arm") == k) & (F.col("error") == 0)) / F.count_if(F.col("arm") == k)
    mean = lambda k: F.avg(F.when(F.col("arm") == k, F.col("error")))
    out = r.groupBy("split").agg(F.round(exact(1) - exact(0), 6).alias("exact_delta"), F.round(mean(1) - mean(0), 6).alias("error_delta"))
    return out.withColumn("status", F.when((F.col("exact_delta") >= -0.02) & (F.col("error_delta") <= 0.05), "pass").otherwise("fail"))


_NEED = "need(class_id, least) AS (SELECT class_id, 300 + 10 * class_id FROM classes)"


@query("l13_requirement_summary", f"{_BASE}, {_NEED}, n AS (SELECT class_id, count(DISTINCT image) AS images FROM gt JOIN images USING (image) WHERE split = 'train' AND source_family = 'real' GROUP BY 1) SELECT CASE WHEN coalesce(images, 0) >= least THEN 'met' WHEN coalesce(images, 0) * 10 >= least * 9 THEN 'close' ELSE 'blocked' END AS status, count(*) AS requirements, sum(greatest(least - coalesce(images, 0), 0))::BIGINT AS missing FROM need LEFT JOIN n USING (class_id) GROUP BY 1")
def l13_requirement_summary(spark: SparkSession, d: str) -> DataFrame:
    n = a.gt_boxes(spark, d).join(a.images(spark, d).where("split = 'train' and source_family = 'real'"), "image").groupBy("class_id").agg(F.countDistinct("image").alias("images"))
    need = a.classes(spark).select("class_id", (300 + 10 * F.col("class_id")).alias("least")).join(n, "class_id", "left").fillna(0, ["images"])
    status = F.when(F.col("images") >= F.col("least"), "met").when(F.col("images") * 10 >= F.col("least") * 9, "close").otherwise("blocked")
    return need.groupBy(status.alias("status")).agg(F.count("*").alias("requirements"), F.sum(F.greatest(F.col("least") - F.col("images"), F.lit(0))).alias("missing"))


@query("l16_count_stress_gate", f"{_BASE}, k AS (SELECT image, class_id, count(*) AS n FROM gt GROUP BY 1, 2), m AS (SELECT image, max(n) AS most FROM k GROUP BY 1), f AS (SELECT count(*) AS images, count(*) FILTER (most >= 2) AS repeated, max(most) AS most FROM m) {_checks_sql('f', [('repeated_images', 'repeated', 'repeated >= 10'), ('largest_repeat', 'most', 'most >= 3'), ('repeated_share', 'round(repeated / images, 6)', 'round(repeated / images, 6) <= 0.5')])}")
def l16_count_stress_gate(spark: SparkSession, d: str) -> DataFrame:
    m = a.gt_boxes(spark, d).groupBy("image", "class_id").agg(F.count("*").alias("n")).groupBy("image").agg(F.max("n").alias("most"))
    one = m.agg(F.count("*").alias("images"), F.count_if(F.col("most") >= 2).alias("repeated"), F.max("most").alias("most")).withColumn("share", F.round(F.col("repeated") / F.col("images"), 6))
    return _checks(one, [("repeated_images", F.col("repeated"), F.col("repeated") >= 10), ("largest_repeat", F.col("most"), F.col("most") >= 3), ("repeated_share", F.col("share"), F.col("share") <= 0.5)])


@query("l17_count_contract", f"{_ROLL}, f AS (SELECT count(*) AS rows, (SELECT count(*) FROM images) AS images, sum(labels) AS labels, (SELECT count(*) FROM gt) AS boxes, count(*) FILTER (labels < 0 OR preds < 0) AS negative FROM roll) {_checks_sql('f', [('row_count', 'rows', 'rows = images'), ('label_total', 'labels', 'labels = boxes'), ('negative_counts', 'negative', 'negative = 0')])}")
def l17_count_contract(spark: SparkSession, d: str) -> DataFrame:
    one = _roll(spark, d).agg(F.count("*").alias("rows"), F.sum("labels").alias("labels"), F.count_if((F.col("labels") < 0) | (F.col("preds") < 0)).alias("negative"))
    one = one.crossJoin(a.images(spark, d).agg(F.count("*").alias("images"))).crossJoin(a.gt_boxes(spark, d).agg(F.count("*").alias("boxes")))
    return _checks(one, [("row_count", F.col("rows"), F.col("rows") == F.col("images")), ("label_total", F.col("labels"), F.col("labels") == F.col("boxes")), ("negative_counts", F.col("negative"), F.col("negative") == 0)])


@query("l19_capture_report", "WITH n AS (SELECT p_brand, count(*) FILTER (p_size >= 5 AND p_retailprice >= 950) AS usable, count(*) AS all_rows FROM part GROUP BY 1) SELECT p_brand, usable, all_rows, CASE WHEN usable >= 70 THEN 'met' WHEN usable > 0 THEN 'partial' ELSE 'missing' END AS status FROM n")
def l19_capture_report(spark: SparkSession, d: str) -> DataFrame:
    n = a.table(spark, d, "part").groupBy("p_brand").agg(F.count_if((F.col("p_size") >= 5) & (F.col("p_retailprice") >= 950)).alias("usable"), F.count("*").alias("all_rows"))
    return n.withColumn("status", F.when(F.col("usable") >= 70, "met").when(F.col("usable") > 0, "partial").otherwise("missing"))


@query("l20_threshold_checks", f"{_ROLL}, f AS (SELECT round(count(*) FILTER (error = 0) / count(*), 6) AS exact, round(avg(error), 6) AS mean, max(error) AS most FROM roll) {_checks_sql('f', [('exact_share', 'exact', 'exact >= 0.25'), ('mean_error', 'mean', 'mean <= 1'), ('largest_error', 'most', 'most <= 8')])}")
def l20_threshold_checks(spark: SparkSession, d: str) -> DataFrame:
    one = _roll(spark, d).agg(F.round(F.count_if(F.col("error") == 0) / F.count("*"), 6).alias("exact"), F.round(F.avg("error"), 6).alias("mean"), F.max("error").alias("most"))
    return _checks(one, [("exact_share", F.col("exact"), F.col("exact") >= 0.25), ("mean_error", F.col("mean"), F.col("mean") <= 1), ("largest_error", F.col("most"), F.col("most") <= 8)])


_STATUS = ["pass", "review", "missing", "blocked"]


@query("l22_scorecard_axes", f"{_ROLL}, s AS (SELECT source_group, split, CASE WHEN count(*) < 20 THEN 2 WHEN avg(error) > 1.2 THEN 3 WHEN round(avg(error), 6) > 0.9 THEN 1 ELSE 0 END AS rank FROM roll GROUP BY ALL) SELECT source_group, ({_STATUS})[max(rank) + 1] AS worst, count(*) FILTER (rank = 0) AS passed, count(*) AS axes FROM s GROUP BY 1")
def l22_scorecard_axes(spark: SparkSession, d: str) -> DataFrame:
    """A group is as good as its worst axis."""
    rank = F.when(F.count("*") < 20, 2).when(F.avg("error") > 1.2, 3).when(F.round(F.avg("error"), 6) > 0.9, 1).otherwise(0)
    s = _roll(spark, d).groupBy("source_group", "split").agg(rank.alias("rank"))
    return s.groupBy("source_group").agg(F.element_at(F.array(*[F.lit(x) for x in _STATUS]), F.max("rank") + 1).alias("worst"), F.count_if(F.col("rank") == 0).alias("passed"), F.count("*").alias("axes"))


@query("l24_readiness", f"{_ROLL}, s AS (SELECT source_group, count(*) FILTER (split = 'val') AS val, count(*) FILTER (source_family = 'real') AS real, max(error) AS most FROM roll GROUP BY 1) SELECT source_group, array_to_string(list_filter([CASE WHEN val < 310 THEN 'few_val' END, CASE WHEN real < 1990 THEN 'few_real' END, CASE WHEN most >= 5 THEN 'count_errors' END], lambda x: x IS NOT NULL), ';') AS blockers, NOT (val < 310 OR real < 1990 OR most >= 5) AS ready FROM s")
def l24_readiness(spark: SparkSession, d: str) -> DataFrame:
    s = _roll(spark, d).groupBy("source_group").agg(F.count_if(F.col("split") == "val").alias("val"), F.count_if(F.col("source_family") == "real").alias("real"), F.max("error").alias("most"))
    blockers = F.array_compact(F.array(F.when(F.col("val") < 310, "few_val"), F.when(F.col("real") < 1990, "few_real"), F.when(F.col("most") >= 5, "count_errors")))
    return s.select("source_group", F.array_join(blockers, ";").alias("blockers"), (F.size(blockers) == 0).alias("ready"))


@query("l27_condition_diversity", "WITH f AS (SELECT event_type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY 1) SELECT event_type, n, kinds, kinds >= CASE WHEN n < 4 THEN 1 WHEN n < 16 THEN 2 ELSE 3 END AS passed FROM f")
def l27_condition_diversity(spark: SparkSession, d: str) -> DataFrame:
    f = a.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct(F.get_json_object("props", "$.k")).alias("kinds"))
    return f.withColumn("passed", F.col("kinds") >= F.when(F.col("n") < 4, 1).when(F.col("n") < 16, 2).otherwise(3))


@query("p2_step_arithmetic", f"{_BASE}, n AS (SELECT split, count(*) AS rows FROM images GROUP BY 1) SELECT split, rows, (rows + 31) // 32 AS batches, 4000 // ((rows + 31) // 32) AS epochs, 4000 % ((rows + 31) // 32) AS rest FROM n")
def p2_step_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Whole epochs and left-over batches of 4,000 steps at 32 rows a batch."""
    n = a.images(spark, d).groupBy("split").agg(F.count("*").alias("rows"))
    return n.withColumn("batches", F.expr("(rows + 31) div 32")).selectExpr("split", "rows", "batches", "4000 div batches as epochs", "4000 % batches as rest")


@query("p3_recipe_fan_out", f"{_BASE} SELECT r.recipe, count(*) AS rows, count(*) FILTER (source_family = 'synthetic') AS synthetic FROM images, (VALUES ('all'), ('real'), ('train')) r(recipe) WHERE CASE recipe WHEN 'real' THEN source_family = 'real' WHEN 'train' THEN split = 'train' ELSE true END GROUP BY 1")
def p3_recipe_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """One pass over the rows for all recipes."""
    recipes = F.array_compact(F.array(F.lit("all"), F.when(F.col("source_family") == "real", "real"), F.when(F.col("split") == "train", "train")))
    rows = a.images(spark, d).select("source_family", F.explode(recipes).alias("recipe"))
    return rows.groupBy("recipe").agg(F.count("*").alias("rows"), F.count_if(F.col("source_family") == "synthetic").alias("synthetic"))
