"""Queries over labels and predictions: geometry, joins, matching, suppression, metrics and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from boxquarry.functions import geometry as g
from boxquarry.operators import matching, metrics
from boxquarry.plans import adapters as a
from boxquarry.plans.adapters import sql_area, sql_intersection, sql_iou, with_ctes
from boxquarry.plans.registry import query

_TAKE = "lambda acc, x: CASE WHEN list_contains(acc, x[1]) OR list_contains(acc, x[2]) THEN acc ELSE list_concat(acc, x) END, []::BIGINT[]"


def _match_sql(preds: str = "preds", keys: str = "p.image", on: str = "p.image = l.image AND p.class_id = l.class_id", thr: float = 0.5, name: str = "m", order: str = "p.confidence DESC, p.pred_index, iou DESC, l.label_index") -> str:
    """SQL that folds candidates in order into matches (keys, pred_index, label_index)."""
    names = ", ".join(k.split(".")[-1] for k in keys.split(", "))
    return f"""{name}_c AS MATERIALIZED (SELECT {keys}, p.pred_index, l.label_index, p.confidence, {sql_iou("p", "l")} AS iou FROM {preds} p JOIN gt l ON {on}),
{name}_f AS (SELECT {names}, list_reduce(list([pred_index, -1 - label_index] ORDER BY {order.replace("p.", "").replace("l.", "")}), {_TAKE}) AS a FROM {name}_c WHERE iou > 0 AND iou >= {thr} GROUP BY {names}),
{name} AS MATERIALIZED (SELECT {names}, a[i] AS pred_index, -1 - a[i + 1] AS label_index FROM (SELECT {names}, a, unnest(range(1, len(a) + 1, 2)) AS i FROM {name}_f))"""


def _held_sql(preds: str, labels: str, same: bool = True) -> str:
    """SQL of an image's labels (ls), predictions (ps) and matches (m: prediction, -1 - label, and so on) in one row, by one fold and no join after it."""
    own = lambda rel, index, more: f"SELECT image, list({{'i': {index}, 'c': class_id{more}, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY {index}) AS s FROM {rel} GROUP BY 1"
    pair = f"{{'o0': -a.f, 'o1': a.i, 'o2': -{sql_iou('a', 'b')}, 'o3': b.i, 'same': a.c = b.c}}"
    fits = "z.o2 <= -0.5 AND z.same" if same else "z.o2 <= -0.5"
    return f"""lp AS (SELECT image, coalesce(l.s, []) AS ls, coalesce(p.s, []) AS ps FROM ({own(labels, 'label_index', '')}) l FULL JOIN ({own(preds, 'pred_index', ", 'f': confidence")}) p USING (image)),
held AS (SELECT image, ls, ps, list_reduce(list_transform(list_sort(list_filter(flatten(list_transform(ps, lambda a: list_transform(ls, lambda b: {pair}))), lambda z: {fits})), lambda z: [z.o1, -1 - z.o3]), {_TAKE}) AS m FROM lp)"""


_OUTCOMES = """o AS (SELECT l.image, l.class_id, CASE WHEN m.image IS NULL THEN 'fn' ELSE 'tp' END AS kind FROM gt l LEFT JOIN m ON m.image = l.image AND m.label_index = l.label_index
 UNION ALL SELECT p.image, p.class_id, 'fp' FROM preds p LEFT JOIN m ON m.image = p.image AND m.pred_index = p.pred_index WHERE m.image IS NULL)"""
_TALLY = """count(*) FILTER (kind <> 'fp') AS gt, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fn') AS fn, count(*) FILTER (kind = 'fp') AS fp,
 count(*) FILTER (kind = 'tp') / nullif(count(*) FILTER (kind <> 'fp'), 0) AS recall, count(*) FILTER (kind = 'tp') / nullif(count(*) FILTER (kind <> 'fn'), 0) AS precision"""
_BASE = with_ctes("classes", "images", "gt", "preds")


def _gp(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return a.pred_boxes(spark, d), a.gt_boxes(spark, d)


# ---- geometry ----


@query("d3_iou", f"{_BASE} SELECT p.image, p.pred_index, l.label_index, round({sql_iou('p', 'l')}, 9) AS iou FROM preds p JOIN gt l ON p.image = l.image WHERE {sql_intersection('p', 'l')} > 0")
def d3_iou(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    return matching.overlaps(p, q).select("image", "pred_index", "label_index", g.rounded(F.col("iou"), 9).alias("iou"))


@query(
    "d5_box_coverages",
    f"{_BASE} SELECT p.image, p.pred_index, l.label_index, round({sql_intersection('p', 'l')} / {sql_area('l')}::DOUBLE, 9) AS label_coverage, round({sql_intersection('p', 'l')} / {sql_area('p')}::DOUBLE, 9) AS pred_coverage FROM preds p JOIN gt l ON p.image = l.image WHERE {sql_intersection('p', 'l')} > 0",
)
def d5_box_coverages(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    return matching.overlaps(p, q).select("image", "pred_index", "label_index", g.rounded(F.col("label_coverage"), 9).alias("label_coverage"), g.rounded(F.col("pred_coverage"), 9).alias("pred_coverage"))


@query(
    "d2_normalised_boxes",
    f"{_BASE} SELECT image, label_index, round((x1 + x2) / 2.0::DOUBLE / width, 9) AS cx, round((y1 + y2) / 2.0::DOUBLE / height, 9) AS cy, round((x2 - x1) / width::DOUBLE, 9) AS w, round((y2 - y1) / height::DOUBLE, 9) AS h FROM gt JOIN images USING (image)",
)
def d2_normalised_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = a.gt_boxes(spark, d).join(a.images(spark, d), "image")
    values = g.to_centre(g.box(), F.col("width"), F.col("height"))
    return b.select("image", "label_index", *[F.round(v, 9).alias(n) for v, n in zip(values, ("cx", "cy", "w", "h"), strict=True)])


@query(
    "d8_area_ratio",
    f"{_BASE} SELECT image, label_index, round(greatest(least(x2, width) - least(x1, width), 0) * greatest(least(y2, height) - least(y1, height), 0) / (width * height)::DOUBLE, 9) AS area_ratio, round(least(x1 / width::DOUBLE, y1 / height::DOUBLE, 1 - x2 / width::DOUBLE, 1 - y2 / height::DOUBLE), 9) AS edge_margin, x1 <= 4 OR y1 <= 4 OR x2 >= width - 4 OR y2 >= height - 4 AS touches_edge FROM gt JOIN images USING (image)",
)
def d8_area_ratio(spark: SparkSession, d: str) -> DataFrame:
    b = a.gt_boxes(spark, d).join(a.images(spark, d), "image")
    w, h = F.col("width"), F.col("height")
    return b.select("image", "label_index", F.round(g.area_ratio(g.box(), w, h), 9).alias("area_ratio"), F.round(g.edge_margin(g.box(), w, h), 9).alias("edge_margin"), g.touches_edge(g.box(), w, h, 4).alias("touches_edge"))


@query(
    "d10_crop_boxes",
    f"""{_BASE}, c AS (SELECT image, label_index, greatest(round_even(x1 - (x2 - x1) * 0.125, 0)::BIGINT, 0) AS cx1, greatest(round_even(y1 - (y2 - y1) * 0.125, 0)::BIGINT, 0) AS cy1,
 least(round_even(x2 + (x2 - x1) * 0.125, 0)::BIGINT, width) AS cx2, least(round_even(y2 + (y2 - y1) * 0.125, 0)::BIGINT, height) AS cy2 FROM gt JOIN images USING (image))
SELECT image, label_index, CASE WHEN cx2 > cx1 AND cy2 > cy1 THEN cx1 END AS cx1, CASE WHEN cx2 > cx1 AND cy2 > cy1 THEN cy1 END AS cy1, CASE WHEN cx2 > cx1 AND cy2 > cy1 THEN cx2 END AS cx2, CASE WHEN cx2 > cx1 AND cy2 > cy1 THEN cy2 END AS cy2 FROM c""",
)
def d10_crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = a.gt_boxes(spark, d).join(a.images(spark, d), "image").withColumn("c", g.crop_box(g.box(), F.col("width"), F.col("height"), 0.125))
    return b.select("image", "label_index", *[F.col(f"c.{n}").alias(f"c{n}") for n in ("x1", "y1", "x2", "y2")])


@query("d13_softmax", "WITH e AS (SELECT vec_id, embedding[1:8]::DOUBLE[] AS s FROM embeddings), x AS (SELECT vec_id, s, list_transform(s, lambda v: exp(v - list_max(s))) AS r FROM e) SELECT vec_id, list_position(s, list_max(s))::BIGINT - 1 AS top, round(list_max(r) / list_sum(r), 6) AS share FROM x")
def d13_softmax(spark: SparkSession, d: str) -> DataFrame:
    e = a.table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).cast("array<double>").alias("s"))
    return e.select("vec_id", g.argmax(F.col("s")).alias("top"), F.round(F.array_max(g.softmax(F.col("s"))), 6).alias("share"))


@query("d14_polygon_area", f"{_BASE} SELECT image, label_index, (x2 - x1) * (y2 - y1) * 0.5::DOUBLE AS polygon_area FROM gt")
def d14_polygon_area(spark: SparkSession, d: str) -> DataFrame:
    p = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y1", "x2", "y2")])
    return a.gt_boxes(spark, d).select("image", "label_index", g.polygon_area(p).alias("polygon_area"))


@query("d16_value_totals", f"{_BASE} SELECT image, sum(CASE WHEN currency = 'USD' THEN face_value ELSE 0 END) AS usd, sum(CASE WHEN currency = 'KHR' THEN face_value ELSE 0 END) AS khr FROM gt JOIN classes USING (class_id) GROUP BY image")
def d16_value_totals(spark: SparkSession, d: str) -> DataFrame:
    money = lambda c: F.sum(F.when(F.col("currency") == c, F.col("face_value")).otherwise(0.0))
    return a.gt_boxes(spark, d).join(a.classes(spark), "class_id").groupBy("image").agg(money("USD").alias("usd"), money("KHR").alias("khr"))


_BEST = f"""b AS (SELECT l.image, l.label_index, max({sql_iou('p', 'l')}) AS best FROM preds p JOIN gt l ON p.image = l.image WHERE {sql_intersection('p', 'l')} > 0 GROUP BY ALL)"""


@query(
    "d18_iou_buckets",
    f"""{_BASE}, {_BEST}, k AS (SELECT l.image, b.best, EXISTS (SELECT 1 FROM preds p WHERE p.image = l.image) AS seen FROM gt l LEFT JOIN b USING (image, label_index))
SELECT CASE WHEN NOT seen THEN 'no_prediction' WHEN best IS NULL THEN 'disjoint' WHEN best >= 0.5 THEN 'matched_range' WHEN best >= 0.3 THEN 'near_miss' WHEN best >= 0.1 THEN 'weak_overlap' ELSE 'touching' END AS bucket, count(*) AS labels FROM k GROUP BY 1""",
)
def d18_iou_buckets(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    best = matching.best_per_label(p, q, same_class=False)
    seen = p.groupBy("image").agg(F.count("*").alias("n_preds"))
    near = best.join(seen, "image", "left").withColumn("best", F.when(F.col("n_preds").isNotNull(), F.coalesce("best_iou", F.lit(0.0))))
    return near.groupBy(g.iou_bucket(F.col("best"), 0.5).alias("bucket")).agg(F.count("*").alias("labels"))


@query(
    "d20_fp_kinds",
    f"""{_BASE}, k AS (SELECT p.image, p.pred_index, max(CASE WHEN l.image IS NOT NULL THEN {sql_iou('p', 'l')} END) AS near, max(CASE WHEN p.class_id = l.class_id THEN {sql_iou('p', 'l')} END) AS same FROM preds p LEFT JOIN gt l ON p.image = l.image GROUP BY ALL)
SELECT CASE WHEN near IS NULL THEN 'background' WHEN same >= 0.5 THEN 'duplicate_or_match' WHEN near >= 0.5 THEN 'wrong_class' WHEN near >= 0.1 THEN 'loose_box' ELSE 'stray' END AS kind, count(*) AS predictions FROM k GROUP BY 1""",
)
def d20_fp_kinds(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    k = matching.best_per_prediction(p, q)
    kind = F.when(F.col("near").isNull(), "background").when(F.col("same") >= 0.5, "duplicate_or_match").when(F.col("near") >= 0.5, "wrong_class").when(F.col("near") >= 0.1, "loose_box").otherwise("stray")
    return k.groupBy(kind.alias("kind")).agg(F.count("*").alias("predictions"))


@query(
    "d21_proposal_labels",
    f"""{_BASE}, k AS (SELECT p.image, p.pred_index, coalesce(max(CASE WHEN p.class_id = l.class_id THEN {sql_iou('p', 'l')} END), 0) AS same, coalesce(max({sql_iou('p', 'l')}), 0) AS near FROM preds p LEFT JOIN gt l ON p.image = l.image GROUP BY ALL)
SELECT image, pred_index, CASE WHEN same >= 0.5 THEN 'target' WHEN near < 0.2 THEN 'reject' ELSE 'ignore' END AS proposal_label FROM k""",
)
def d21_proposal_labels(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    k = matching.best_per_prediction(p, q).fillna(0.0, ["near", "same"])
    return k.select("image", "pred_index", F.when(F.col("same") >= 0.5, "target").when(F.col("near") < 0.2, "reject").otherwise("ignore").alias("proposal_label"))


# ---- joins ----


@query("e1_greedy_match", f"{_BASE}, {_match_sql()} SELECT m.image, m.pred_index, m.label_index, round(c.iou, 9) AS iou FROM m JOIN m_c c USING (image, pred_index, label_index)")
def e1_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    return matching.match_predictions(p, q).withColumn("iou", g.rounded(F.col("iou"), 9))


@query("e2_match_any_class", f"{_BASE}, {_match_sql(on='p.image = l.image')} SELECT m.image, m.pred_index, m.label_index, round(c.iou, 9) AS iou FROM m JOIN m_c c USING (image, pred_index, label_index)")
def e2_match_any_class(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    return matching.match_predictions(p, q, match_classes=False).withColumn("iou", g.rounded(F.col("iou"), 9))


@query(
    "e3_label_assignment",
    f"""{_BASE}, {_held_sql('preds', 'gt', same=False)} SELECT image, b.i AS label_index, b.c AS label_class, (list_filter(ps, lambda a: a.i = m[list_position(m, -1 - b.i) - 1])[1]).c AS pred_class FROM (SELECT image, ps, m, unnest(ls) AS b FROM held)""",
)
def e3_label_assignment(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    return matching.label_matches(p, q, match_classes=False).select("image", "label_index", "label_class", "pred_class")


_GLOBAL = "iou DESC, p.confidence DESC, l.label_index DESC, p.pred_index DESC"


@query(
    "e4_global_match",
    f"""{_BASE}, {_match_sql(order=_GLOBAL)},
r AS (SELECT p.image, p.pred_index, l.label_index, p.confidence, {sql_iou('p', 'l')} AS iou FROM preds p JOIN gt l ON p.image = l.image AND p.class_id <> l.class_id
  WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.image = p.image AND m.pred_index = p.pred_index) AND NOT EXISTS (SELECT 1 FROM m WHERE m.image = l.image AND m.label_index = l.label_index)),
w_f AS (SELECT image, list_reduce(list([pred_index, -1 - label_index] ORDER BY iou DESC, confidence DESC, label_index DESC, pred_index DESC), {_TAKE}) AS a FROM r WHERE iou >= 0.5 GROUP BY image),
w AS (SELECT image, a[i] AS pred_index, -1 - a[i + 1] AS label_index FROM (SELECT image, a, unnest(range(1, len(a) + 1, 2)) AS i FROM w_f))
SELECT image, pred_index, label_index, 'matched' AS kind FROM m UNION ALL SELECT image, pred_index, label_index, 'wrong_class' FROM w""",
)
def e4_global_match(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    return matching.match_globally(p, q).drop("iou")


@query("e5_best_prediction", f"{_BASE} SELECT l.image, l.label_index, l.class_id, arg_max(p.pred_index, (iou, -p.pred_index)) AS best_pred, round(max(iou), 9) AS best_iou FROM gt l LEFT JOIN (SELECT p.image, p.class_id, p.pred_index, l.label_index, {sql_iou('p', 'l')} AS iou FROM preds p JOIN gt l ON p.image = l.image AND p.class_id = l.class_id WHERE {sql_intersection('p', 'l')} > 0) p ON p.image = l.image AND p.label_index = l.label_index GROUP BY ALL")
def e5_best_prediction(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    return matching.best_per_label(p, q, same_class=True).withColumn("best_iou", g.rounded(F.col("best_iou"), 9))


@query("e7_new_images", f"{_BASE} SELECT image, split FROM images ANTI JOIN gt USING (image)")
def e7_new_images(spark: SparkSession, d: str) -> DataFrame:
    return a.images(spark, d).join(a.gt_boxes(spark, d).select("image"), "image", "left_anti").select("image", "split")


@query("e8_allow_list", f"{_BASE} SELECT image, source_group FROM images SEMI JOIN (SELECT image FROM preds WHERE confidence >= 0.9) USING (image)")
def e8_allow_list(spark: SparkSession, d: str) -> DataFrame:
    sure = a.pred_boxes(spark, d).where("confidence >= 0.9").select("image")
    return a.images(spark, d).join(sure, "image", "left_semi").select("image", "source_group")


@query(
    "e10_class_compare",
    f"{_BASE}, b AS (SELECT class_id, count(*) AS n FROM gt WHERE image % 2 = 0 GROUP BY 1), c AS (SELECT class_id, count(*) AS n FROM preds WHERE image % 2 = 1 AND confidence >= 0.5 GROUP BY 1) SELECT coalesce(b.class_id, c.class_id) AS class_id, b.n AS baseline, c.n AS candidate, coalesce(c.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN c ON b.class_id = c.class_id",
)
def e10_class_compare(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    b = q.where("image % 2 = 0").groupBy("class_id").agg(F.count("*").alias("baseline"))
    c = p.where("image % 2 = 1 and confidence >= 0.5").groupBy("class_id").agg(F.count("*").alias("candidate"))
    return b.join(c, "class_id", "full_outer").withColumn("delta", F.coalesce("candidate", F.lit(0)) - F.coalesce("baseline", F.lit(0)))


@query(
    "e13_candidate_only",
    f"""{_BASE}, q AS (SELECT image, pred_index AS label_index, class_id, x1, y1, x2, y2 FROM preds WHERE pred_index % 2 = 0), cand AS (SELECT * FROM preds WHERE pred_index % 2 = 1), {_held_sql('cand', 'q')}
SELECT image, a.i AS pred_index, a.c AS class_id FROM (SELECT image, m, unnest(ps) AS a FROM held) WHERE NOT list_contains(m, a.i)""",
)
def e13_candidate_only(spark: SparkSession, d: str) -> DataFrame:
    """Candidate boxes that no baseline box of their class accounts for, each baseline box serving once."""
    p = a.pred_boxes(spark, d)
    base, cand = p.where("pred_index % 2 = 0").withColumnRenamed("pred_index", "label_index"), p.where("pred_index % 2 = 1")
    return cand.join(matching.match_predictions(cand, base), ["image", "pred_index"], "left_anti").select("image", "pred_index", "class_id")


@query(
    "e15_pair_metrics",
    f"""{_BASE}, pr AS (SELECT x.image, x.label_index AS i, y.label_index AS j, {sql_iou('x', 'y')} AS iou, {sql_intersection('x', 'y')} / least({sql_area('x')}, {sql_area('y')})::DOUBLE AS small,
 sqrt(pow(greatest(x.x1 - y.x2, y.x1 - x.x2, 0), 2) + pow(greatest(x.y1 - y.y2, y.y1 - x.y2, 0), 2)) AS gap FROM gt x JOIN gt y ON x.image = y.image AND x.label_index < y.label_index)
SELECT image, count(*) AS pairs, round(max(iou), 9) AS max_iou, round(max(small), 9) AS max_small_ratio, round(min(gap), 6) AS min_gap, count(*) FILTER (iou >= 0.02) AS overlapping FROM pr GROUP BY image""",
)
def e15_pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    q = a.gt_boxes(spark, d)
    x, y = (q.select("image", F.col("label_index").alias(f"{n}_i"), *[F.col(c).alias(f"{n}_{c}") for c in ("x1", "y1", "x2", "y2")]) for n in ("x", "y"))
    pr = x.join(y, "image").where("x_i < y_i")
    bx, by = g.box("x_"), g.box("y_")
    pr = pr.select("image", g.iou(bx, by).alias("iou"), g.overlap_of_smaller(bx, by).alias("small"), g.gap(bx, by).alias("gap"))
    return pr.groupBy("image").agg(F.count("*").alias("pairs"), F.round(F.max("iou"), 9).alias("max_iou"), F.round(F.max("small"), 9).alias("max_small_ratio"), F.round(F.min("gap"), 6).alias("min_gap"), F.count_if(F.col("iou") >= 0.02).alias("overlapping"))


# ---- suppression ----


def _nms_sql(rows: str, order: str, thr: float, keys: str = "image") -> str:
    own = " AND ".join(f"x.{k.strip()} = y.{k.strip()}" for k in keys.split(","))
    return f"""z AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS k FROM ({rows})),
zc AS (SELECT x.image, x.k, x.pred_index, ANY_VALUE(x.class_id) AS class_id, list(y.k) FILTER (y.k IS NOT NULL) AS above FROM z x LEFT JOIN z y ON {own} AND y.k < x.k AND {sql_iou('x', 'y')} >= {thr} GROUP BY ALL),
zf AS (SELECT image{', class_id' if 'class_id' in keys else ''}, list_reduce(list(list_prepend(k, coalesce(above, []::BIGINT[])) ORDER BY k), lambda acc, v: CASE WHEN list_has_any(acc, v[2:]) THEN acc ELSE list_append(acc, v[1]) END, []::BIGINT[]) AS kept FROM zc GROUP BY ALL),
zk AS (SELECT zc.image, zc.pred_index FROM zc JOIN zf ON zf.image = zc.image {'AND zf.class_id = zc.class_id' if 'class_id' in keys else ''} WHERE list_contains(zf.kept, zc.k))"""


@query("f1_nms", f"{_BASE}, {_nms_sql('SELECT * FROM preds', 'confidence DESC, pred_index', 0.5)} SELECT image, pred_index FROM zk")
def f1_nms(spark: SparkSession, d: str) -> DataFrame:
    return matching.suppress(a.pred_boxes(spark, d), 0.5, [-F.col("confidence"), F.col("pred_index")]).select("image", "pred_index")


@query(
    "f2_class_ordered_nms",
    f"{_BASE}, {_nms_sql('SELECT *, min(pred_index) OVER (PARTITION BY image, class_id) AS seen FROM preds', 'seen, confidence DESC, pred_index', 0.5)} SELECT image, pred_index FROM zk",
)
def f2_class_ordered_nms(spark: SparkSession, d: str) -> DataFrame:
    """Classes in the order of their first box, each by confidence, all against one list of kept boxes."""
    p = a.pred_boxes(spark, d).withColumn("seen", F.min("pred_index").over(W.partitionBy("image", "class_id")))
    return matching.suppress(p, 0.5, [F.col("seen"), -F.col("confidence"), F.col("pred_index")]).select("image", "pred_index")


@query("f3_nms_by_score", f"{_BASE}, {_nms_sql('SELECT * FROM preds', 'gate_conf DESC, pred_index', 0.85)} SELECT image, pred_index FROM zk")
def f3_nms_by_score(spark: SparkSession, d: str) -> DataFrame:
    return matching.suppress(a.pred_boxes(spark, d), 0.85, [-F.col("gate_conf"), F.col("pred_index")]).select("image", "pred_index")


@query("f4_nms_45", f"{_BASE}, {_nms_sql('SELECT * FROM preds WHERE confidence >= 0.25', 'confidence DESC, pred_index', 0.45)} SELECT image, pred_index FROM zk")
def f4_nms_45(spark: SparkSession, d: str) -> DataFrame:
    return matching.suppress(a.pred_boxes(spark, d).where("confidence >= 0.25"), 0.45, [-F.col("confidence"), F.col("pred_index")]).select("image", "pred_index")


@query("f6_same_class_dedupe", f"{_BASE}, {_nms_sql('SELECT * FROM preds', 'confidence DESC, pred_index', 0.5, 'image, class_id')} SELECT image, pred_index FROM zk")
def f6_same_class_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return matching.suppress(a.pred_boxes(spark, d), 0.5, [-F.col("confidence"), F.col("pred_index")], ["image", "class_id"]).select("image", "pred_index")


@query("f7_larger_first_dedupe", f"{_BASE}, {_nms_sql('SELECT *, (x2 - x1) * (y2 - y1) AS size FROM preds', 'size DESC, pred_index', 0.5, 'image, class_id')} SELECT image, pred_index FROM zk")
def f7_larger_first_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return matching.suppress(a.pred_boxes(spark, d), 0.5, [-g.area(g.box()), F.col("pred_index")], ["image", "class_id"]).select("image", "pred_index")


# ---- metrics ----


@query("g3_recall_by_class", f"{_BASE}, {_match_sql()}, {_OUTCOMES} SELECT class_name, {_TALLY} FROM o JOIN classes USING (class_id) GROUP BY class_name")
def g3_recall_by_class(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    return metrics.tally(metrics.outcomes(p, q).join(a.classes(spark), "class_id"), ["class_name"])


@query("g3_recall_by_source", f"{_BASE}, {_match_sql()}, {_OUTCOMES} SELECT source_group, split, {_TALLY} FROM o JOIN images USING (image) GROUP BY source_group, split")
def g3_recall_by_source(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    return metrics.tally(metrics.outcomes(p, q).join(a.images(spark, d), "image"), ["source_group", "split"])


@query("g8_recall_by_source_class", f"{_BASE}, {_match_sql()}, {_OUTCOMES} SELECT source_group, class_id, {_TALLY} FROM o JOIN images USING (image) GROUP BY ALL")
def g8_recall_by_source_class(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    return metrics.tally(metrics.outcomes(p, q).join(a.images(spark, d), "image"), ["source_group", "class_id"])


@query("g7_confusion_pairs", f"{_BASE}, {_match_sql(on='p.image = l.image')} SELECT l.class_id AS label_class, p.class_id AS pred_class, count(*) AS n FROM m JOIN gt l ON l.image = m.image AND l.label_index = m.label_index JOIN preds p ON p.image = m.image AND p.pred_index = m.pred_index WHERE l.class_id <> p.class_id GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 30")
def g7_confusion_pairs(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    named = matching.label_matches(p, q, match_classes=False)
    return named.where("label_class <> pred_class").groupBy("label_class", "pred_class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label_class", "pred_class").limit(30)


_AREA = "greatest(least(x2, width) - least(x1, width), 0) * greatest(least(y2, height) - least(y1, height), 0) / (width * height)::DOUBLE"


@query("g4_area_stats", f"{_BASE}, r AS (SELECT source_group, {_AREA} AS r FROM preds JOIN images USING (image)) SELECT source_group, count(*) AS n, round(avg(r), 9) AS mean, round(max(r), 9) AS largest, count(*) FILTER (r >= 0.05) AS at_least_05, count(*) FILTER (r >= 0.1) AS at_least_10 FROM r GROUP BY ALL")
def g4_area_stats(spark: SparkSession, d: str) -> DataFrame:
    r = a.pred_boxes(spark, d).join(a.images(spark, d), "image").withColumn("r", g.area_ratio(g.box(), F.col("width"), F.col("height")))
    return r.groupBy("source_group").agg(F.count("*").alias("n"), F.round(F.avg("r"), 9).alias("mean"), F.round(F.max("r"), 9).alias("largest"), F.count_if(F.col("r") >= 0.05).alias("at_least_05"), F.count_if(F.col("r") >= 0.1).alias("at_least_10"))


def _values_sql(preds: str) -> str:
    total = lambda t, n: f"{n} AS (SELECT image, count(*) AS n, sum(CASE WHEN currency = 'USD' THEN face_value ELSE 0 END) AS usd, sum(CASE WHEN currency = 'KHR' THEN face_value ELSE 0 END) AS khr FROM {t} LEFT JOIN classes USING (class_id) GROUP BY image)"
    return f"{total('gt', 'tg')}, {total(preds, 'tp')}, v AS (SELECT i.*, coalesce(tg.n, 0) AS gt_count, coalesce(tp.n, 0) AS pred_count, coalesce(tp.n, 0) - coalesce(tg.n, 0) AS count_error, coalesce(tp.usd, 0) - coalesce(tg.usd, 0) AS usd_error, coalesce(tp.khr, 0) - coalesce(tg.khr, 0) AS khr_error FROM images i LEFT JOIN tg USING (image) LEFT JOIN tp USING (image))"


@query("g6_value_errors", f"{_BASE}, {_values_sql('preds')} SELECT split, count(*) AS images, round(avg(abs(count_error)), 9) AS mean_count_error, round(avg(abs(usd_error)), 6) AS mean_usd_error, round(avg(abs(khr_error)), 6) AS mean_khr_error, count(*) FILTER (count_error = 0) AS exact_count, count(*) FILTER (usd_error = 0 AND khr_error = 0) AS exact_value FROM v GROUP BY split")
def g6_value_errors(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    v = metrics.per_image_values(a.images(spark, d), p, q, a.classes(spark))
    mean = lambda c, n: F.round(F.avg(F.abs(c)), n).alias(f"mean_{c}")
    return v.groupBy("split").agg(F.count("*").alias("images"), mean("count_error", 9), mean("usd_error", 6), mean("khr_error", 6), F.count_if("exact_count").alias("exact_count"), F.count_if("exact_value").alias("exact_value"))


@query("g9_per_image_rollup", f"{_BASE}, {_match_sql()}, {_OUTCOMES}, r AS (SELECT image, count(*) FILTER (kind <> 'fp') AS gt, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fn') AS fn, count(*) FILTER (kind = 'fp') AS fp FROM o GROUP BY image) SELECT i.image, i.split, coalesce(gt, 0) AS gt, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, coalesce(fp, 0) AS fp FROM images i LEFT JOIN r USING (image)")
def g9_per_image_rollup(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    r = metrics.tally(metrics.outcomes(p, q), ["image"]).drop("recall", "precision")
    return a.images(spark, d).select("image", "split").join(r, "image", "left").fillna(0, ["gt", "tp", "fn", "fp"])


@query(
    "m13_failure_kinds",
    f"""{_BASE}, {_match_sql()}, {_OUTCOMES}, r AS (SELECT image, count(*) FILTER (kind <> 'fp') AS gt, count(*) FILTER (kind = 'fn') AS fn, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind <> 'fn') AS pred_count FROM o GROUP BY image)
SELECT CASE WHEN gt = 0 AND pred_count > 0 THEN 'false_positive_on_empty' WHEN gt > 0 AND pred_count = 0 THEN 'missed_all' WHEN fn > 0 AND fp > 0 THEN 'miss_plus_extra_or_wrong' WHEN fn > 0 THEN 'missed_value' WHEN fp > 0 THEN 'extra_value' ELSE 'value_mismatch' END AS failure, count(*) AS images FROM r WHERE fn > 0 OR fp > 0 GROUP BY 1""",
)
def m13_failure_kinds(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    r = metrics.tally(metrics.outcomes(p, q), ["image"]).withColumn("pred_count", F.col("tp") + F.col("fp"))
    return r.where("fn > 0 or fp > 0").groupBy(metrics.failure_kind().alias("failure")).agg(F.count("*").alias("images"))


# ---- filters on predictions, gates and sweeps ----


@query("c8_class_floor", f"{_BASE} SELECT class_id, count(*) AS n, count(*) FILTER (confidence >= CASE class_id WHEN 0 THEN 0.5 WHEN 3 THEN 0.25 WHEN 7 THEN 0.9 ELSE 0 END) AS kept FROM preds GROUP BY 1")
def c8_class_floor(spark: SparkSession, d: str) -> DataFrame:
    p = a.pred_boxes(spark, d)
    kept = metrics.class_floor(p, {0: 0.5, 3: 0.25, 7: 0.9}).groupBy("class_id").agg(F.count("*").alias("kept"))
    return p.groupBy("class_id").agg(F.count("*").alias("n")).join(kept, "class_id", "left").fillna(0, ["kept"])


@query("c9_ignored_classes", f"{_BASE} SELECT source_group, class_id, count(*) AS ignored FROM preds JOIN images USING (image) WHERE class_id IN (2, 5) GROUP BY ALL")
def c9_ignored_classes(spark: SparkSession, d: str) -> DataFrame:
    return a.pred_boxes(spark, d).where(F.col("class_id").isin(2, 5)).join(a.images(spark, d), "image").groupBy("source_group", "class_id").agg(F.count("*").alias("ignored"))


@query("c10_gate_reject", f"{_BASE} SELECT image, pred_index, gate_class = 13 AND gate_conf >= 0.3 AND confidence <= 0.8 AS rejected FROM preds")
def c10_gate_reject(spark: SparkSession, d: str) -> DataFrame:
    return metrics.gate_reject(a.pred_boxes(spark, d), 13, 0.3, 0.8).select("image", "pred_index", "rejected")


@query("c11_class_thresholds", f"{_BASE} SELECT image, pred_index, gate_class = 13 AND gate_conf >= CASE class_id WHEN 0 THEN 0.2 WHEN 5 THEN 0.6 ELSE 0.4 END AS rejected FROM preds")
def c11_class_thresholds(spark: SparkSession, d: str) -> DataFrame:
    need = F.when(F.col("class_id") == 0, 0.2).when(F.col("class_id") == 5, 0.6).otherwise(0.4)
    return metrics.gate_reject(a.pred_boxes(spark, d), 13, need).select("image", "pred_index", "rejected")


@query("c12_reclassify", f"{_BASE} SELECT image, pred_index, CASE WHEN gate_conf >= 0.6 AND gate_class <> 13 THEN gate_class ELSE class_id END AS class_id, gate_conf >= 0.6 AND gate_class <> 13 AND gate_class <> class_id AS reclassified FROM preds")
def c12_reclassify(spark: SparkSession, d: str) -> DataFrame:
    return metrics.reclassify(a.pred_boxes(spark, d), 0.6, [13]).select("image", "pred_index", "class_id", "reclassified")


@query("c15_fusion", f"{_BASE} SELECT image, pred_index, CASE WHEN confidence >= 0.6 THEN class_id WHEN gate_class = 13 THEN NULL ELSE gate_class END AS fused FROM preds")
def c15_fusion(spark: SparkSession, d: str) -> DataFrame:
    fused = F.when(F.col("confidence") >= 0.6, F.col("class_id")).when(F.col("gate_class") != 13, F.col("gate_class"))
    return a.pred_boxes(spark, d).select("image", "pred_index", fused.alias("fused"))


@query("c5_clean_single", f"{_BASE} SELECT image FROM gt JOIN images USING (image) GROUP BY image HAVING count(*) = 1 AND NOT max((x1 <= 4 OR y1 <= 4 OR x2 >= width - 4 OR y2 >= height - 4)::INT)::BOOLEAN")
def c5_clean_single(spark: SparkSession, d: str) -> DataFrame:
    b = a.gt_boxes(spark, d).join(a.images(spark, d), "image").withColumn("edge", g.touches_edge(g.box(), F.col("width"), F.col("height"), 4))
    return b.groupBy("image").agg(F.count("*").alias("n"), F.bool_or("edge").alias("any")).where("n = 1 and not any").select("image")


@query("c3_geometry_exists", f"{_BASE} SELECT image FROM images SEMI JOIN (SELECT image FROM gt WHERE (x2 - x1) * (y2 - y1) BETWEEN 2000 AND 9000) USING (image)")
def c3_geometry_exists(spark: SparkSession, d: str) -> DataFrame:
    return a.images(spark, d).join(a.gt_boxes(spark, d).where(g.area(g.box()).between(2000, 9000)), "image", "left_semi").select("image")


@query("c17_zero_label", f"{_BASE} SELECT split, count(*) AS images, count(*) FILTER (NOT EXISTS (SELECT 1 FROM gt WHERE gt.image = images.image)) AS backgrounds FROM images GROUP BY split")
def c17_zero_label(spark: SparkSession, d: str) -> DataFrame:
    some = a.gt_boxes(spark, d).select("image").distinct().withColumn("some", F.lit(True))
    return a.images(spark, d).join(some, "image", "left").groupBy("split").agg(F.count("*").alias("images"), F.count_if(F.col("some").isNull()).alias("backgrounds"))


@query("c24_class_remap", f"{_BASE}, remap(old, new) AS (VALUES (0, 20), (1, 21), (2, 22), (6, 3), (7, 4)) SELECT image, label_index, new::BIGINT AS class_id FROM gt JOIN remap ON class_id = old")
def c24_class_remap(spark: SparkSession, d: str) -> DataFrame:
    remap = F.broadcast(spark.createDataFrame([(0, 20), (1, 21), (2, 22), (6, 3), (7, 4)], "class_id long, new long").coalesce(1))
    return a.gt_boxes(spark, d).join(remap, "class_id").select("image", "label_index", F.col("new").alias("class_id"))


@query(
    "c26_rejection_reasons",
    f"""{_BASE}, r AS (SELECT i.image, count(l.image) AS n, coalesce(max((x2 - x1) * (y2 - y1)), 0) AS biggest, coalesce(min((x2 - x1) * (y2 - y1)), 0) AS smallest, coalesce(sum((x2 - x1) * (y2 - y1)), 0) AS total FROM images i LEFT JOIN gt l USING (image) GROUP BY i.image)
SELECT image, concat_ws(',', CASE WHEN n = 0 THEN 'empty_labels' END, CASE WHEN n > 3 THEN 'too_many_boxes' END, CASE WHEN biggest > 15000 THEN 'box_too_large' END, CASE WHEN total > 25000 THEN 'total_box_area_too_large' END, CASE WHEN n > 0 AND smallest < 700 THEN 'box_too_small' END) AS reasons FROM r""",
)
def c26_rejection_reasons(spark: SparkSession, d: str) -> DataFrame:
    size = g.area(g.box())
    r = a.images(spark, d).select("image").join(a.gt_boxes(spark, d).groupBy("image").agg(F.count("*").alias("n"), F.max(size).alias("biggest"), F.min(size).alias("smallest"), F.sum(size).alias("total")), "image", "left").fillna(0)
    why = [("empty_labels", "n = 0"), ("too_many_boxes", "n > 3"), ("box_too_large", "biggest > 15000"), ("total_box_area_too_large", "total > 25000"), ("box_too_small", "n > 0 and smallest < 700")]
    return r.select("image", F.concat_ws(",", *[F.when(F.expr(e), n) for n, e in why]).alias("reasons"))


_GRID = [0.0, 0.3, 0.6, 0.9, 1.1]
_GRID_SQL = f"grid(threshold) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in _GRID)}), gp AS (SELECT threshold, p.* FROM grid, preds p WHERE NOT (gate_class >= 11 AND gate_conf >= threshold))"


@query(
    "l1_gate_sweep",
    f"""{_BASE}, {_GRID_SQL}, {_match_sql(preds='gp', keys='p.threshold, p.image')}, s AS (SELECT threshold, count(*) AS tp FROM m GROUP BY 1)
SELECT g.threshold, coalesce(tp, 0) AS tp, (SELECT count(*) FROM gp WHERE gp.threshold = g.threshold) AS predictions, round(coalesce(tp, 0) / (SELECT count(*) FROM gt), 9) AS recall, round(coalesce(tp, 0) / nullif((SELECT count(*) FROM gp WHERE gp.threshold = g.threshold), 0), 9) AS precision FROM grid g LEFT JOIN s USING (threshold)""",
)
def l1_gate_sweep(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    out = matching.sweep(p, q, [{"threshold": t} for t in _GRID], lambda p, g: ~((p["gate_class"] >= 11) & (p["gate_conf"] >= g["threshold"])))
    return out.select("threshold", "tp", "predictions", F.round(metrics.ratio(F.col("tp"), F.col("gt")), 9).alias("recall"), F.round(metrics.ratio(F.col("tp"), F.col("predictions")), 9).alias("precision"))


@query(
    "l2_utilities",
    f"""{_BASE}, {_GRID_SQL}, {_values_sql('gp').replace('FROM images i LEFT JOIN tg USING (image) LEFT JOIN tp USING (image)', 'FROM grid CROSS JOIN images i LEFT JOIN tg ON tg.image = i.image LEFT JOIN tp ON tp.image = i.image AND tp.threshold = grid.threshold').replace('SELECT i.*', 'SELECT grid.threshold, i.*').replace('tp AS (SELECT image', 'tp AS (SELECT threshold, image').replace('FROM gp LEFT JOIN classes USING (class_id) GROUP BY image', 'FROM gp LEFT JOIN classes USING (class_id) GROUP BY threshold, image')},
u AS (SELECT threshold, count(*) FILTER (usd_error = 0 AND khr_error = 0) AS exact_value, count(*) FILTER (gt_count = 0 AND pred_count > 0) AS background_fp FROM v GROUP BY threshold)
SELECT threshold, exact_value, background_fp, exact_value - 2 * background_fp AS utility, rank() OVER (ORDER BY exact_value - 2 * background_fp DESC) = 1 AS best FROM u""",
)
def l2_utilities(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    grid = F.broadcast(spark.createDataFrame([(t,) for t in _GRID], "threshold double").coalesce(1))
    gp = p.crossJoin(grid).where(~((F.col("gate_class") >= 11) & (F.col("gate_conf") >= F.col("threshold"))))
    money = lambda c: F.sum(F.when(F.col("currency") == c, F.col("face_value")).otherwise(0.0)).alias(c.lower())
    side = lambda b, keys: b.join(a.classes(spark), "class_id", "left").groupBy(*keys).agg(F.count("*").alias("n"), money("USD"), money("KHR"))
    labels = side(q, ["image"]).select("image", F.col("n").alias("gn"), F.col("usd").alias("gusd"), F.col("khr").alias("gkhr"))
    v = a.images(spark, d).select("image").join(labels, "image", "left").crossJoin(grid).join(side(gp, ["threshold", "image"]), ["threshold", "image"], "left").fillna(0)
    u = v.groupBy("threshold").agg(F.count_if((F.col("usd") == F.col("gusd")) & (F.col("khr") == F.col("gkhr"))).alias("exact_value"), F.count_if((F.col("gn") == 0) & (F.col("n") > 0)).alias("background_fp"))
    u = u.withColumn("utility", F.col("exact_value") - 2 * F.col("background_fp"))
    # one row for each grid point
    return u.withColumn("best", F.rank().over(W.orderBy(F.desc("utility"))) == 1)


@query(
    "m2_unlabeled_predictions",
    f"{_BASE}, k AS (SELECT p.image, p.pred_index, p.confidence, coalesce(max({sql_iou('p', 'l')}), 0) AS best FROM preds p LEFT JOIN gt l ON p.image = l.image GROUP BY ALL) SELECT image, pred_index, confidence, round(best, 9) AS best_iou FROM k WHERE confidence >= 0.8 AND best < 0.3",
)
def m2_unlabeled_predictions(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    p = p.where("confidence >= 0.8")
    best = matching.overlaps(p, q).groupBy("image", "pred_index").agg(F.max("iou").alias("best_iou"))
    return p.join(best, ["image", "pred_index"], "left").fillna(0.0, ["best_iou"]).where("best_iou < 0.3").select("image", "pred_index", "confidence", g.rounded(F.col("best_iou"), 9).alias("best_iou"))


@query(
    "m3_teacher_agreement",
    f"{_BASE}, k AS (SELECT l.image, l.label_index, coalesce(bool_or(p.image IS NOT NULL AND ({sql_iou('p', 'l')} >= 0.5 OR ({sql_intersection('p', 'l')} / {sql_area('l')}::DOUBLE >= 0.8 AND {sql_intersection('p', 'l')} / {sql_area('p')}::DOUBLE >= 0.4))), FALSE) AS agreed FROM gt l LEFT JOIN preds p ON p.image = l.image AND p.class_id = l.class_id GROUP BY ALL) SELECT split, count(*) AS labels, count(*) FILTER (agreed) AS agreed FROM k JOIN images USING (image) GROUP BY split",
)
def m3_teacher_agreement(spark: SparkSession, d: str) -> DataFrame:
    """A label is agreed if any prediction of its class covers it well; one prediction may serve several labels."""
    p, q = _gp(spark, d)
    ok = matching.overlaps(p, q, match_classes=True).where("iou >= 0.5 or (label_coverage >= 0.8 and pred_coverage >= 0.4)").select("image", "label_index").distinct().withColumn("ok", F.lit(True))
    return q.join(ok, ["image", "label_index"], "left").join(a.images(spark, d), "image").groupBy("split").agg(F.count("*").alias("labels"), F.count("ok").alias("agreed"))


@query(
    "r17_clear_images",
    f"{_BASE} SELECT image FROM images WHERE NOT EXISTS (SELECT 1 FROM gt WHERE gt.image = images.image AND greatest(least(x2, 220) - greatest(x1, 100), 0) * greatest(least(y2, 220) - greatest(y1, 100), 0) > 144)",
)
def r17_clear_images(spark: SparkSession, d: str) -> DataFrame:
    """Images in which a fixed crop meets no label by more than a hundredth of its area."""
    crop = g.Box(*[F.lit(v) for v in (100, 100, 220, 220)])
    hit = a.gt_boxes(spark, d).where(g.intersection(g.box(), crop) > 144)
    return a.images(spark, d).join(hit, "image", "left_anti").select("image")
