"""Queries that audit, compare runs, route reviews and gate releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from boxquarry.functions import geometry as g
from boxquarry.functions import text as tx
from boxquarry.operators import matching, metrics
from boxquarry.operators import selection as sel
from boxquarry.operators import statistics as st
from boxquarry.plans import adapters as a
from boxquarry.plans.adapters import sql_area, sql_intersection, sql_iou, with_ctes
from boxquarry.plans.detection import _OUTCOMES, _TALLY, _match_sql, _nms_sql
from boxquarry.plans.registry import query

_BASE = with_ctes("classes", "images", "gt", "preds")
_SIZE = "(x2 - x1) * (y2 - y1)"


def _gp(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return a.pred_boxes(spark, d), a.gt_boxes(spark, d)


# ---- filters and routing ----


@query("c1_label_policy", f"{_BASE} SELECT split, count(*) FILTER (NOT EXISTS (SELECT 1 FROM gt WHERE gt.image = i.image)) AS offends_nonempty, count(*) FILTER (EXISTS (SELECT 1 FROM gt WHERE gt.image = i.image)) AS offends_empty FROM images i GROUP BY split")
def c1_label_policy(spark: SparkSession, d: str) -> DataFrame:
    some = a.gt_boxes(spark, d).select("image").distinct().withColumn("some", F.lit(True))
    return a.images(spark, d).join(some, "image", "left").groupBy("split").agg(F.count_if(F.col("some").isNull()).alias("offends_nonempty"), F.count("some").alias("offends_empty"))


@query("c4_partial_like", f"{_BASE} SELECT class_id, count(*) AS partial FROM gt JOIN images USING (image) WHERE x1 <= 4 OR y1 <= 4 OR x2 >= width - 4 OR y2 >= height - 4 OR {_SIZE} < 900 OR (x2 - x1) > 2 * (y2 - y1) GROUP BY class_id")
def c4_partial_like(spark: SparkSession, d: str) -> DataFrame:
    b = a.gt_boxes(spark, d).join(a.images(spark, d), "image")
    edge = g.touches_edge(g.box(), F.col("width"), F.col("height"), 4)
    return b.where(edge | (g.area(g.box()) < 900) | F.expr("(x2 - x1) > 2 * (y2 - y1)")).groupBy("class_id").agg(F.count("*").alias("partial"))


@query("c7_source_filter", f"{_BASE} SELECT source_group, count(*) AS images FROM images WHERE source_group IN ('1-URGENT', '2-HIGH', '5-LOW') AND source_group NOT IN ('2-HIGH') GROUP BY 1")
def c7_source_filter(spark: SparkSession, d: str) -> DataFrame:
    return a.images(spark, d).where(F.col("source_group").isin("1-URGENT", "2-HIGH", "5-LOW") & ~F.col("source_group").isin("2-HIGH")).groupBy("source_group").agg(F.count("*").alias("images"))


@query("c14_reject_before_nms", f"{_BASE}, {_nms_sql('SELECT * FROM preds WHERE NOT (gate_class = 13 AND gate_conf >= 0.3)', 'confidence DESC, pred_index', 0.5)} SELECT image, pred_index FROM zk")
def c14_reject_before_nms(spark: SparkSession, d: str) -> DataFrame:
    p = metrics.gate_reject(a.pred_boxes(spark, d), 13, 0.3).where("not rejected")
    return matching.suppress(p, 0.5, [-F.col("confidence"), F.col("pred_index")]).select("image", "pred_index")


@query("c14_reject_after_nms", f"{_BASE}, {_nms_sql('SELECT * FROM preds', 'confidence DESC, pred_index', 0.5)} SELECT zk.image, zk.pred_index FROM zk JOIN preds p ON p.image = zk.image AND p.pred_index = zk.pred_index WHERE NOT (gate_class = 13 AND gate_conf >= 0.3)")
def c14_reject_after_nms(spark: SparkSession, d: str) -> DataFrame:
    kept = matching.suppress(a.pred_boxes(spark, d), 0.5, [-F.col("confidence"), F.col("pred_index")])
    return metrics.gate_reject(kept, 13, 0.3).where("not rejected").select("image", "pred_index")


@query("c27_quality_flags", f"{_BASE}, f AS (SELECT l_orderkey AS image, (l_linenumber - 1) // 2 AS label_index, bool_or(l_returnflag = 'A') AS flag FROM lineitem GROUP BY ALL) SELECT gt.image, gt.label_index FROM gt JOIN f USING (image, label_index) WHERE flag")
def c27_quality_flags(spark: SparkSession, d: str) -> DataFrame:
    flag = a.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image"), F.expr("(l_linenumber - 1) div 2").alias("label_index")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("flag"))
    return a.gt_boxes(spark, d).join(flag, ["image", "label_index"]).where("flag").select("image", "label_index")


@query("d11_letterbox_inverse", f"{_BASE} SELECT image, pred_index, round(least(greatest((x1 - 16) / 0.5::DOUBLE, 0), width), 6) AS ox1, round(least(greatest((y1 - 24) / 0.5::DOUBLE, 0), height), 6) AS oy1 FROM preds JOIN images USING (image)")
def d11_letterbox_inverse(spark: SparkSession, d: str) -> DataFrame:
    p = a.pred_boxes(spark, d).join(a.images(spark, d), "image")
    back = lambda v, pad, most: F.round(F.least(F.greatest((F.col(v) - pad) / F.lit(0.5), F.lit(0.0)), F.col(most)), 6)
    return p.select("image", "pred_index", back("x1", 16, "width").alias("ox1"), back("y1", 24, "height").alias("oy1"))


# ---- joins of runs ----


@query("e6_lexicographic_best", f"{_BASE}, k AS (SELECT l.image, l.label_index, p.pred_index, {sql_iou('p', 'l')} AS iou, {sql_intersection('p', 'l')} / {sql_area('l')}::DOUBLE AS lc FROM preds p JOIN gt l ON p.image = l.image WHERE {sql_intersection('p', 'l')} > 0) SELECT image, label_index, arg_max(pred_index, (lc, iou, -pred_index)) AS pred_index FROM k GROUP BY ALL")
def e6_lexicographic_best(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    return matching.overlaps(p, q).groupBy("image", "label_index").agg(F.max_by("pred_index", F.struct("label_coverage", "iou", -F.col("pred_index"))).alias("pred_index"))


@query("e9_manifest_join", f"{_BASE}, r AS (SELECT image, count(*) AS n, 'run' AS source FROM preds GROUP BY image), m AS (SELECT image, source_group AS source FROM images WHERE split = 'val') SELECT m.image, m.source, coalesce(n, 0) AS n, r.image IS NULL AS missing FROM m LEFT JOIN r USING (image)")
def e9_manifest_join(spark: SparkSession, d: str) -> DataFrame:
    r = a.pred_boxes(spark, d).groupBy("image").agg(F.count("*").alias("n"))
    m = a.images(spark, d).where("split = 'val'").select("image", F.col("source_group").alias("source"))
    return m.join(r, "image", "left").select("image", "source", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


def _arms(table: str) -> str:
    return f"ta AS (SELECT class_id, count(*) AS a FROM {table} WHERE image % 2 = 0 GROUP BY 1), tb AS (SELECT class_id, count(*) AS b FROM {table} WHERE image % 2 = 1 GROUP BY 1)"


@query("e11_ranked_deltas", f"{_BASE}, {_arms('preds')} SELECT class_id, coalesce(b, 0) - coalesce(a, 0) AS delta, rank() OVER (ORDER BY coalesce(b, 0) - coalesce(a, 0) DESC) AS place FROM ta FULL JOIN tb USING (class_id)")
def e11_ranked_deltas(spark: SparkSession, d: str) -> DataFrame:
    p = a.pred_boxes(spark, d).groupBy("class_id").agg((F.count_if(F.col("image") % 2 == 1) - F.count_if(F.col("image") % 2 == 0)).alias("delta"))
    # one row for each class
    return p.withColumn("place", F.rank().over(W.orderBy(F.desc("delta"))).cast("long"))


@query("e14_transfer_acceptances", f"{_BASE}, k AS (SELECT p.image, p.pred_index, l.label_index, p.class_id AS pc, l.class_id AS lc, {sql_iou('p', 'l')} AS iou FROM preds p LEFT JOIN gt l ON p.image = l.image AND {sql_intersection('p', 'l')} > 0), b AS (SELECT image, pred_index, max(iou) FILTER (label_index IS NOT NULL) AS best, arg_max(lc, (iou, -label_index)) FILTER (label_index IS NOT NULL) AS lc, any_value(pc) AS pc FROM k GROUP BY ALL) SELECT CASE WHEN best IS NULL THEN 'no_overlap' WHEN best < 0.5 THEN 'below_minimum' WHEN lc <> pc THEN 'class_conflict' ELSE 'accepted' END AS outcome, count(*) AS n FROM b GROUP BY 1")
def e14_transfer_acceptances(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    best = matching.overlaps(p, q).groupBy("image", "pred_index").agg(F.max_by(F.struct("iou", "label_class"), F.struct("iou", -F.col("label_index"))).alias("b"))
    k = p.join(best, ["image", "pred_index"], "left")
    outcome = F.when(F.col("b").isNull(), "no_overlap").when(F.col("b.iou") < 0.5, "below_minimum").when(F.col("b.label_class") != F.col("class_id"), "class_conflict").otherwise("accepted")
    return k.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("e21_fused_fragments", f"{_BASE}, k AS (SELECT DISTINCT l.image, l.label_index, p.pred_index FROM gt l JOIN preds p ON p.image = l.image AND p.class_id = l.class_id AND {sql_intersection('p', 'l')} / {sql_area('l')}::DOUBLE >= 0.6) SELECT image, count(DISTINCT label_index) AS supported, count(DISTINCT pred_index) AS proposals FROM k GROUP BY image")
def e21_fused_fragments(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    return matching.overlaps(p, q, match_classes=True).where("label_coverage >= 0.6").groupBy("image").agg(F.countDistinct("label_index").alias("supported"), F.countDistinct("pred_index").alias("proposals"))


@query("e27_last_key_wins", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n FROM events GROUP BY user_id")
def e27_last_key_wins(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count("*").alias("n"))


@query("e28_linked_or_all", "WITH k AS (SELECT o_custkey AS model, o_orderkey AS image, o_orderstatus = 'F' AS relevant FROM orders), r AS (SELECT model, count(*) AS n, count(*) FILTER (relevant) AS m FROM k GROUP BY 1) SELECT model, CASE WHEN m > 0 THEN m ELSE n END AS linked, m = 0 AS fell_back FROM r")
def e28_linked_or_all(spark: SparkSession, d: str) -> DataFrame:
    r = a.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("model")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("m"))
    return r.select("model", F.when(F.col("m") > 0, F.col("m")).otherwise(F.col("n")).alias("linked"), (F.col("m") == 0).alias("fell_back"))


# ---- staged metrics ----


@query("g15_reason_counters", f"{_BASE}, r AS (SELECT split, source_group, CASE WHEN {_SIZE} < 900 THEN 'small' WHEN {_SIZE} > 15000 THEN 'large' ELSE 'plain' END AS reason FROM gt JOIN images USING (image)) SELECT split, source_group, reason, count(*) AS n FROM r GROUP BY GROUPING SETS ((split), (source_group), (reason), (split, reason))")
def g15_reason_counters(spark: SparkSession, d: str) -> DataFrame:
    size = g.area(g.box())
    r = a.gt_boxes(spark, d).join(a.images(spark, d), "image").select("split", "source_group", F.when(size < 900, "small").when(size > 15000, "large").otherwise("plain").alias("reason"))
    sets = [["split"], ["source_group"], ["reason"], ["split", "reason"]]
    return r.groupingSets([[F.col(c) for c in s] for s in sets], "split", "source_group", "reason").agg(F.count("*").alias("n"))


@query("g26_count_targets", "WITH x AS (SELECT o_orderkey % 50 AS scene, count(*) AS n FROM orders GROUP BY 1), y AS (SELECT o_orderkey % 50 AS scene, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1) SELECT count(*) AS differing FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y)")
def g26_count_targets(spark: SparkSession, d: str) -> DataFrame:
    o = a.table(spark, d, "orders").withColumn("scene", F.col("o_orderkey") % 50)
    x, y = o.groupBy("scene").agg(F.count("*").alias("n")), o.groupBy("scene").agg(F.countDistinct("o_orderkey").alias("n"))
    return x.exceptAll(y).agg(F.count("*").alias("differing"))


@query("g34_coverage", "SELECT p_brand, count(DISTINCT p_type) FILTER (p_partkey % 2 = 0) AS front, count(DISTINCT p_type) FILTER (p_partkey % 2 = 1) AS back, array_to_string(list_sort(list(p_partkey))[1:3], ',') AS examples FROM part GROUP BY p_brand")
def g34_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = a.table(spark, d, "part").withColumn("even", F.col("p_partkey") % 2 == 0)
    wide = p.groupBy("p_brand").agg(F.countDistinct(F.when(F.col("even"), F.col("p_type"))).alias("front"), F.countDistinct(F.when(~F.col("even"), F.col("p_type"))).alias("back"))
    first = sel.top_per_group(p, ["p_brand"], [F.col("p_partkey")], 3).groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",").alias("examples"))
    return wide.join(first, "p_brand")


# ---- ranking ----


@query("h1_issue_ranking", f"{_BASE}, i AS (SELECT image, label_index, CASE WHEN {_SIZE} < 800 THEN 3 WHEN x1 <= 4 THEN 2 ELSE 1 END AS severity FROM gt WHERE {_SIZE} < 800 OR x1 <= 4 OR x2 - x1 > 150) SELECT image, label_index, severity FROM i ORDER BY severity DESC, image, label_index LIMIT 300")
def h1_issue_ranking(spark: SparkSession, d: str) -> DataFrame:
    size = g.area(g.box())
    i = a.gt_boxes(spark, d).where((size < 800) | (F.col("x1") <= 4) | F.expr("x2 - x1 > 150"))
    severity = F.when(size < 800, 3).when(F.col("x1") <= 4, 2).otherwise(1)
    return i.select("image", "label_index", severity.alias("severity")).orderBy(F.desc("severity"), "image", "label_index").limit(300)


@query("h8_priority_score", f"{_BASE} SELECT image, pred_index, round(confidence * 10 + CASE WHEN class_id IN (3, 7) THEN 5 ELSE 0 END - CASE WHEN gate_class = 13 THEN 2.5::DOUBLE ELSE 0 END, 6) AS priority FROM preds")
def h8_priority_score(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("confidence") * 10 + F.when(F.col("class_id").isin(3, 7), 5).otherwise(0) - F.when(F.col("gate_class") == 13, 2.5).otherwise(0.0)
    return a.pred_boxes(spark, d).select("image", "pred_index", F.round(score, 6).alias("priority"))


@query("h16_top_deltas", f"{_BASE}, {_arms('gt')} SELECT class_id, b - a AS delta FROM ta JOIN tb USING (class_id) ORDER BY abs(b - a) DESC, class_id LIMIT 5")
def h16_top_deltas(spark: SparkSession, d: str) -> DataFrame:
    q = a.gt_boxes(spark, d).groupBy("class_id").agg(F.count_if(F.col("image") % 2 == 0).alias("a"), F.count_if(F.col("image") % 2 == 1).alias("b")).where("a > 0 and b > 0")
    return q.select("class_id", (F.col("b") - F.col("a")).alias("delta")).orderBy(F.desc(F.abs("delta")), "class_id").limit(5)


@query("i6_with_replacement", f"{_BASE}, p AS (SELECT image, row_number() OVER (ORDER BY sha256(concat('wr:', image))) - 1 AS j FROM images ANTI JOIN gt USING (image)) SELECT image, count(*) AS copies FROM range(600) t(i) JOIN p ON p.j = t.i % (SELECT count(*) FROM p) GROUP BY image")
def i6_with_replacement(spark: SparkSession, d: str) -> DataFrame:
    """Six hundred draws that go round the pool in hash order."""
    pool = a.images(spark, d).join(a.gt_boxes(spark, d), "image", "left_anti").select("image")
    drawn = sel.cycle_join(spark.range(600), pool, [F.col("id")], [sel.hash_order("wr", "image")])
    return drawn.groupBy("image").agg(F.count("*").alias("copies"))


@query("i21_feature_distance", f"{_BASE}, t AS (SELECT class_id, avg(x2 - x1) AS m, greatest(stddev_pop(x2 - x1), 5) AS s FROM gt JOIN images USING (image) WHERE source_family = 'real' GROUP BY 1) SELECT gt.image, gt.label_index, round(abs(x2 - x1 - m) / s, 6) AS distance FROM gt JOIN images USING (image) JOIN t USING (class_id) WHERE source_family = 'synthetic'")
def i21_feature_distance(spark: SparkSession, d: str) -> DataFrame:
    b = a.gt_boxes(spark, d).join(a.images(spark, d).select("image", "source_family"), "image").withColumn("w", F.expr("x2 - x1"))
    t = b.where("source_family = 'real'").groupBy("class_id").agg(F.avg("w").alias("m"), F.greatest(F.stddev_pop("w"), F.lit(5.0)).alias("s"))
    return b.where("source_family = 'synthetic'").join(t, "class_id").select("image", "label_index", F.round(F.abs(F.col("w") - F.col("m")) / F.col("s"), 6).alias("distance"))


# ---- texts ----


@query("j5_class_clues", r"SELECT p_partkey, coalesce(nullif(regexp_extract(lower(p_name), '(?:^|[^0-9])([12]0)(?:[^0-9]|$)', 1), ''), nullif(regexp_extract(lower(p_name), '([0-9]+)$', 1), '')) AS clue FROM part")
def j5_class_clues(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda pattern: F.nullif(F.regexp_extract(F.lower("p_name"), pattern, 1), F.lit(""))
    return a.table(spark, d, "part").select("p_partkey", F.coalesce(pick(r"(?<![0-9])([12]0)(?![0-9])"), pick(r"([0-9]+)$")).alias("clue"))


@query("j9_first_present", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END, ' '), ''), source) AS v FROM documents")
def j9_first_present(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "documents").select("doc_id", tx.first_present(F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")), F.col("source")).alias("v"))


@query("j12_listing_digest", "SELECT source, sha256(string_agg(sha256(text), chr(10) ORDER BY sha256(text))) AS digest FROM documents GROUP BY source")
def j12_listing_digest(spark: SparkSession, d: str) -> DataFrame:
    files = a.table(spark, d, "documents").select("source", F.sha2("text", 256).alias("sha"))
    return files.groupBy("source").agg(tx.fingerprint(["sha"], "sha").alias("digest"))


@query("j21_split_from_path", "SELECT CASE WHEN regexp_extract(url, '/([a-z]{2})/', 1) = '' THEN 'none' ELSE regexp_extract(url, '/([a-z]{2})/', 1) END AS part, count(*) AS n FROM pages GROUP BY 1")
def j21_split_from_path(spark: SparkSession, d: str) -> DataFrame:
    part = F.regexp_extract("url", "/([a-z]{2})/", 1)
    return a.table(spark, d, "pages").groupBy(F.when(part == "", "none").otherwise(part).alias("part")).agg(F.count("*").alias("n"))


# ---- statistics and gates ----


@query("k5_cosine_to_centroid", "WITH e AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)), c AS (SELECT label, i, avg(v) AS c FROM e GROUP BY ALL) SELECT vec_id, round(1 - sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))), 5) AS distance FROM e JOIN c USING (label, i) GROUP BY vec_id")
def k5_cosine_to_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = a.table(spark, d, "embeddings")
    c = st.centroids(e, ["label"], "embedding").select("label", "centroid")
    return e.join(c, "label").select("vec_id", F.round(st.cosine_distance(F.col("embedding"), F.col("centroid")), 5).alias("distance"))


@query("k12_quantile_block", "SELECT round(min(value), 6) AS least, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS most FROM events")
def k12_quantile_block(spark: SparkSession, d: str) -> DataFrame:
    names = {"least": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "most": 1.0}
    q = st.quantiles(a.table(spark, d, "events").select("value"), [], "value", names)
    return q.select(*[F.round(n, 6).alias(n) for n in names])


@query("l14_baseline_deltas", f"{_BASE}, r AS (SELECT source_group, round(avg(confidence), 9) AS v FROM preds JOIN images USING (image) GROUP BY 1) SELECT source_group, v, round(v - (SELECT v FROM r WHERE source_group = '3-MEDIUM'), 9) AS delta FROM r")
def l14_baseline_deltas(spark: SparkSession, d: str) -> DataFrame:
    r = a.pred_boxes(spark, d).join(a.images(spark, d), "image").groupBy("source_group").agg(F.round(F.avg("confidence"), 9).alias("v"))
    base = r.where("source_group = '3-MEDIUM'").agg(F.first("v").alias("b"))
    return r.crossJoin(F.broadcast(base)).select("source_group", "v", F.round(F.col("v") - F.col("b"), 9).alias("delta"))


@query("l15_distribution_gate", f"{_BASE}, n AS (SELECT class_id, count(gt.image) AS n FROM classes LEFT JOIN gt USING (class_id) GROUP BY 1) SELECT max(n) <= 2 * min(n) AS balanced, min(n) >= 100 AS enough FROM n")
def l15_distribution_gate(spark: SparkSession, d: str) -> DataFrame:
    b = st.balance(a.gt_boxes(spark, d).groupBy("class_id").agg(F.count("*").alias("n")), a.classes(spark), "class_id", "n")
    return b.select((F.col("most") <= 2 * F.col("least")).alias("balanced"), (F.col("least") >= 100).alias("enough"))


# ---- audits ----


@query("m4_teacher_student", f"{_BASE}, t AS (SELECT DISTINCT l.image, l.label_index FROM gt l JOIN preds p ON p.image = l.image AND p.class_id = l.class_id AND p.pred_index % 2 = 0 AND {sql_iou('p', 'l')} >= 0.5), s AS (SELECT DISTINCT l.image, l.label_index FROM gt l JOIN preds p ON p.image = l.image AND p.class_id = l.class_id AND p.pred_index % 2 = 1 AND {sql_iou('p', 'l')} >= 0.5) SELECT CASE WHEN t.image IS NOT NULL AND s.image IS NOT NULL THEN 'both' WHEN t.image IS NOT NULL THEN 'teacher_only' WHEN s.image IS NOT NULL THEN 'student_only' ELSE 'neither' END AS bucket, count(*) AS labels FROM gt LEFT JOIN t USING (image, label_index) LEFT JOIN s USING (image, label_index) GROUP BY 1")
def m4_teacher_student(spark: SparkSession, d: str) -> DataFrame:
    p, q = _gp(spark, d)
    hit = matching.overlaps(p, q, match_classes=True, least=0.5).groupBy("image", "label_index").agg(F.bool_or(F.col("pred_index") % 2 == 0).alias("t"), F.bool_or(F.col("pred_index") % 2 == 1).alias("s"))
    k = q.join(hit, ["image", "label_index"], "left").fillna(False, ["t", "s"])
    bucket = F.when(F.col("t") & F.col("s"), "both").when(F.col("t"), "teacher_only").when(F.col("s"), "student_only").otherwise("neither")
    return k.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("labels"))


@query("m20_pseudo_labels", f"{_BASE} SELECT image, pred_index FROM (SELECT *, {_SIZE} AS s FROM preds) WHERE class_id IN (1, 4) AND s BETWEEN 1000 AND 12000 QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY confidence DESC, s DESC, image, pred_index) <= 75")
def m20_pseudo_labels(spark: SparkSession, d: str) -> DataFrame:
    p = a.pred_boxes(spark, d).withColumn("s", g.area(g.box())).where(F.col("class_id").isin(1, 4) & F.col("s").between(1000, 12000))
    return sel.top_per_group(p, ["class_id"], [F.desc("confidence"), F.desc("s"), F.asc("image"), F.asc("pred_index")], 75).select("image", "pred_index")


@query("m27_apply_decisions", "SELECT d.doc_id, coalesce(CASE l.quality WHEN 0 THEN 'drop' WHEN 1 THEN 'keep' END, d.source) AS decision FROM documents d LEFT JOIN labels l USING (doc_id)")
def m27_apply_decisions(spark: SparkSession, d: str) -> DataFrame:
    new = a.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "drop").when(F.col("quality") == 1, "keep").alias("new"))
    return a.table(spark, d, "documents").select("doc_id", "source").join(new, "doc_id", "left").select("doc_id", F.coalesce("new", "source").alias("decision"))


@query("r2_scoreable_images", f"{_BASE}, r AS (SELECT image, count(*) AS n, bool_or({_SIZE} < 900) AS undecided FROM gt GROUP BY image) SELECT gt.image, gt.label_index FROM gt JOIN r USING (image) WHERE n <= 4 AND NOT undecided")
def r2_scoreable_images(spark: SparkSession, d: str) -> DataFrame:
    b = a.gt_boxes(spark, d)
    own = W.partitionBy("image")
    return b.withColumns({"n": F.count("*").over(own), "undecided": F.bool_or(g.area(g.box()) < 900).over(own)}).where("n <= 4 and not undecided").select("image", "label_index")


@query("r12_best_label", f"{_BASE}, k AS (SELECT p.image, p.pred_index, l.label_index, {sql_iou('p', 'l')} AS iou FROM preds p JOIN gt l ON p.image = l.image) SELECT image, pred_index, arg_max(label_index, (iou, -label_index)) AS label_index, round(max(iou), 9) AS iou FROM k GROUP BY ALL")
def r12_best_label(spark: SparkSession, d: str) -> DataFrame:
    """The label with the largest IoU, without a threshold: at 0 the first label stays."""
    p, q = _gp(spark, d)
    p = p.select("image", "pred_index", *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    q = q.select("image", "label_index", *[F.col(c).alias(f"l_{c}") for c in ("x1", "y1", "x2", "y2")])
    k = p.join(q, "image").withColumn("iou", g.iou(g.box("p_"), g.box("l_")))
    return k.groupBy("image", "pred_index").agg(F.max_by("label_index", F.struct("iou", -F.col("label_index"))).alias("label_index"), F.round(F.max("iou"), 9).alias("iou"))


@query("r13_suspect_images", f"{_BASE}, s AS (SELECT image FROM preds WHERE confidence >= 0.8 GROUP BY image HAVING count(*) >= 2) SELECT image FROM images ANTI JOIN s USING (image)")
def r13_suspect_images(spark: SparkSession, d: str) -> DataFrame:
    s = a.pred_boxes(spark, d).where("confidence >= 0.8").groupBy("image").agg(F.count("*").alias("n")).where("n >= 2")
    return a.images(spark, d).join(s, "image", "left_anti").select("image")


@query("r19_one_per_image", f"{_BASE} SELECT image, arg_min(pred_index, pred_index) AS first_index, arg_max(pred_index, (confidence, -pred_index)) AS top_index FROM preds GROUP BY image")
def r19_one_per_image(spark: SparkSession, d: str) -> DataFrame:
    return a.pred_boxes(spark, d).groupBy("image").agg(F.min("pred_index").alias("first_index"), F.max_by("pred_index", F.struct("confidence", -F.col("pred_index"))).alias("top_index"))


@query("r24_variant_keys", r"SELECT coalesce(nullif(regexp_extract(url, '[?]page=([0-9]+)', 1), ''), nullif(split_part(url, '/', 4), ''), 'none') AS variant, count(*) AS n FROM pages GROUP BY 1")
def r24_variant_keys(spark: SparkSession, d: str) -> DataFrame:
    key = F.coalesce(F.nullif(F.regexp_extract("url", r"[?]page=([0-9]+)", 1), F.lit("")), F.nullif(F.split_part("url", F.lit("/"), F.lit(4)), F.lit("")), F.lit("none"))
    return a.table(spark, d, "pages").groupBy(key.alias("variant")).agg(F.count("*").alias("n"))
