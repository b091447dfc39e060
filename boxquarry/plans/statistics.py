"""Queries that count, summarise and compare groups, and gates on such figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from boxquarry.functions import geometry as g
from boxquarry.operators import statistics as st
from boxquarry.plans import adapters as a
from boxquarry.plans.adapters import with_ctes
from boxquarry.plans.registry import query

_BASE = with_ctes("classes", "images", "gt", "preds")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return a.gt_boxes(spark, d).join(a.images(spark, d), "image")


@query("g1_validator", f"{_BASE}, l AS (SELECT image, count(*) AS n FROM gt GROUP BY 1) SELECT split, count(*) AS images, count(DISTINCT i.image) AS unique_images, count(*) FILTER (l.n IS NULL) AS backgrounds, coalesce(sum(l.n), 0)::BIGINT AS boxes FROM images i LEFT JOIN l USING (image) GROUP BY split")
def g1_validator(spark: SparkSession, d: str) -> DataFrame:
    n = a.gt_boxes(spark, d).groupBy("image").agg(F.count("*").alias("n"))
    return a.images(spark, d).join(n, "image", "left").groupBy("split").agg(F.count("*").alias("images"), F.countDistinct("image").alias("unique_images"), F.count_if(F.col("n").isNull()).alias("backgrounds"), F.coalesce(F.sum("n"), F.lit(0)).alias("boxes"))


@query("g1_boxes_per_class", f"{_BASE} SELECT split, class_id, count(*) AS boxes, count(DISTINCT image) AS images FROM gt JOIN images USING (image) GROUP BY ALL")
def g1_boxes_per_class(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).groupBy("split", "class_id").agg(F.count("*").alias("boxes"), F.countDistinct("image").alias("images"))


@query("g2_split_counts", f"{_BASE}, p AS (SELECT split, source_group, count(DISTINCT image) AS u FROM images GROUP BY ALL) SELECT split, sum(u)::BIGINT AS unique_sum, count(*) AS parts FROM p GROUP BY split")
def g2_split_counts(spark: SparkSession, d: str) -> DataFrame:
    """Unique counts for each part, then their sum: an image in two parts counts twice."""
    p = a.images(spark, d).groupBy("split", "source_group").agg(F.countDistinct("image").alias("u"))
    return p.groupBy("split").agg(F.sum("u").alias("unique_sum"), F.count("*").alias("parts"))


_SUMMARY = "count({v}) AS n, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS stdev, round(quantile_cont({v}::DOUBLE, 0.05), 6) AS p05, round(quantile_cont({v}::DOUBLE, 0.5), 6) AS p50, round(quantile_cont({v}::DOUBLE, 0.95), 6) AS p95"


@query("g10_numeric_summary", " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS metric, {_SUMMARY.format(v=c)} FROM lineitem GROUP BY l_returnflag" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def g10_numeric_summary(spark: SparkSession, d: str) -> DataFrame:
    return st.numeric_summary(a.table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"])


@query("g11_family_summaries", f"{_BASE} SELECT source_family, source_group, class_id, count(*) AS boxes, round(avg(x2 - x1), 6) AS mean_width, grouping(source_group)::BIGINT AS g1, grouping(class_id)::BIGINT AS g2 FROM gt JOIN images USING (image) GROUP BY GROUPING SETS ((source_family), (source_family, source_group), (source_family, class_id), (source_family, source_group, class_id))")
def g11_family_summaries(spark: SparkSession, d: str) -> DataFrame:
    b = _labelled(spark, d)
    sets = [["source_family"], ["source_family", "source_group"], ["source_family", "class_id"], ["source_family", "source_group", "class_id"]]
    cols = ["source_family", "source_group", "class_id"]
    return b.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.count("*").alias("boxes"), F.round(F.avg(F.expr("x2 - x1")), 6).alias("mean_width"), F.grouping("source_group").cast("long").alias("g1"), F.grouping("class_id").cast("long").alias("g2"))


@query("g12_class_box_stats", f"{_BASE}, r AS (SELECT class_id, (x2 - x1) * (y2 - y1) AS size FROM gt) SELECT class_id, 'size' AS metric, {_SUMMARY.format(v='size')} FROM r GROUP BY class_id")
def g12_class_box_stats(spark: SparkSession, d: str) -> DataFrame:
    return st.numeric_summary(a.gt_boxes(spark, d).withColumn("size", g.area(g.box())), ["class_id"], ["size"])


@query("g13_family_delta", f"{_BASE} SELECT class_id, round(avg(CASE WHEN source_family = 'real' THEN x2 - x1 END), 6) AS mean_real, round(avg(CASE WHEN source_family = 'synthetic' THEN x2 - x1 END), 6) AS mean_synthetic, round(avg(CASE WHEN source_family = 'real' THEN x2 - x1 END) - avg(CASE WHEN source_family = 'synthetic' THEN x2 - x1 END), 6) AS delta FROM gt JOIN images USING (image) GROUP BY class_id")
def g13_family_delta(spark: SparkSession, d: str) -> DataFrame:
    return st.mean_delta(_labelled(spark, d).withColumn("w", F.expr("x2 - x1")), ["class_id"], "source_family", "real", "synthetic", "w")


@query("g16_grouped_recall", f"{_BASE} SELECT source_family, split, count(*) AS gt, count(*) FILTER (p.image IS NOT NULL) AS hit, round(count(*) FILTER (p.image IS NOT NULL) / count(*), 9) AS recall FROM gt JOIN images USING (image) LEFT JOIN (SELECT DISTINCT image, class_id FROM preds) p ON p.image = gt.image AND p.class_id = gt.class_id GROUP BY ALL")
def g16_grouped_recall(spark: SparkSession, d: str) -> DataFrame:
    seen = a.pred_boxes(spark, d).select("image", "class_id").distinct().withColumn("seen", F.lit(True))
    b = _labelled(spark, d).join(seen, ["image", "class_id"], "left")
    return b.groupBy("source_family", "split").agg(F.count("*").alias("gt"), F.count("seen").alias("hit"), F.round(F.count("seen") / F.count("*"), 9).alias("recall"))


@query("g17_exposures", f"{_BASE} SELECT class_id, count(*) AS exposures FROM (SELECT DISTINCT image, class_id FROM gt) GROUP BY class_id UNION ALL SELECT NULL, count(*) FROM images ANTI JOIN gt USING (image)")
def g17_exposures(spark: SparkSession, d: str) -> DataFrame:
    b = a.gt_boxes(spark, d).select("image", "class_id").distinct()
    none = a.images(spark, d).join(b, "image", "left_anti").select(F.lit(None).cast("long").alias("class_id"))
    return b.groupBy("class_id").agg(F.count("*").alias("exposures")).unionByName(none.groupBy("class_id").agg(F.count("*").alias("exposures")))


@query("g18_class_counts", f"{_BASE} SELECT class_name, count(gt.image) AS boxes FROM classes LEFT JOIN gt USING (class_id) GROUP BY class_name")
def g18_class_counts(spark: SparkSession, d: str) -> DataFrame:
    n = a.gt_boxes(spark, d).groupBy("class_id").agg(F.count("*").alias("boxes"))
    return a.classes(spark).join(n, "class_id", "left").fillna(0, ["boxes"]).select("class_name", "boxes")


@query("g19_nearest_rank", f"{_BASE}, r AS (SELECT class_id, list_sort(list((x2 - x1) * (y2 - y1))) AS v FROM gt GROUP BY 1) SELECT class_id, v[round_even((len(v) - 1) * 0.1::DOUBLE, 0)::BIGINT + 1] AS q10, v[round_even((len(v) - 1) * 0.5::DOUBLE, 0)::BIGINT + 1] AS q50, v[round_even((len(v) - 1) * 0.9::DOUBLE, 0)::BIGINT + 1] AS q90 FROM r")
def g19_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    b = a.gt_boxes(spark, d).select("class_id", g.area(g.box()).alias("size"))
    return st.quantiles(b, ["class_id"], "size", {"q10": 0.1, "q50": 0.5, "q90": 0.9}, linear=False)


@query("g20_replicates", "WITH r AS (SELECT l_suppkey % 5 AS replicate, avg(l_discount) AS v FROM lineitem GROUP BY 1) SELECT count(*) AS n, round(avg(v), 9) AS mean, round(min(v), 9) AS least, round(max(v), 9) AS most, round(stddev_pop(v), 9) AS pstdev FROM r")
def g20_replicates(spark: SparkSession, d: str) -> DataFrame:
    r = a.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("replicate")).agg(F.avg("l_discount").alias("v"))
    return r.agg(F.count("*").alias("n"), F.round(F.avg("v"), 9).alias("mean"), F.round(F.min("v"), 9).alias("least"), F.round(F.max("v"), 9).alias("most"), F.round(F.stddev_pop("v"), 9).alias("pstdev"))


@query("g22_paired_deltas", "WITH r AS (SELECT l_suppkey % 5 AS replicate, l_linenumber, avg(l_quantity) AS v, l_partkey % 2 AS arm FROM lineitem GROUP BY ALL) SELECT x.l_linenumber, round(avg(y.v - x.v), 6) AS mean_delta, round(min(y.v - x.v), 6) AS worst FROM r x JOIN r y ON x.replicate = y.replicate AND x.l_linenumber = y.l_linenumber AND x.arm = 0 AND y.arm = 1 GROUP BY 1")
def g22_paired_deltas(spark: SparkSession, d: str) -> DataFrame:
    r = a.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("replicate"), "l_linenumber", (F.col("l_partkey") % 2).alias("arm")).agg(F.avg("l_quantity").alias("v"))
    both = r.groupBy("replicate", "l_linenumber").agg(F.max(F.when(F.col("arm") == 0, F.col("v"))).alias("x"), F.max(F.when(F.col("arm") == 1, F.col("v"))).alias("y")).where("x is not null and y is not null")
    return both.groupBy("l_linenumber").agg(F.round(F.avg(F.expr("y - x")), 6).alias("mean_delta"), F.round(F.min(F.expr("y - x")), 6).alias("worst"))


@query("g23_class_balance", f"{_BASE}, n AS (SELECT class_id, count(gt.image) AS n FROM classes LEFT JOIN gt USING (class_id) GROUP BY 1) SELECT min(n) AS least, max(n) AS most, max(n) - min(n) AS spread, round(max(n) / nullif(min(n), 0), 6) AS ratio FROM n")
def g23_class_balance(spark: SparkSession, d: str) -> DataFrame:
    return st.balance(a.gt_boxes(spark, d).groupBy("class_id").agg(F.count("*").alias("n")), a.classes(spark), "class_id", "n")


@query("g24_parent_fused", "SELECT l_orderkey % 100 AS scene, count(DISTINCT (l_orderkey, l_returnflag)) AS fused, count(*) AS fragments FROM lineitem GROUP BY 1")
def g24_parent_fused(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("scene")).agg(F.countDistinct("l_orderkey", "l_returnflag").alias("fused"), F.count("*").alias("fragments"))


@query("g25_split_parents", "SELECT count(*) AS split_parents FROM (SELECT l_orderkey, l_partkey % 3 FROM lineitem GROUP BY ALL HAVING count(*) > 1)")
def g25_split_parents(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_partkey") % 3).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("split_parents"))


@query("g27_leakage_groups", "WITH k AS (SELECT md5(text) AS key, doc_id, lang, source, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM documents) SELECT key, count(*) AS rows, array_to_string(list_sort(list_distinct(list(split))), ',') AS splits, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, array_to_string(list_sort(list(doc_id))[1:8], ',') AS examples FROM k GROUP BY key HAVING count(DISTINCT split) > 1")
def g27_leakage_groups(spark: SparkSession, d: str) -> DataFrame:
    """Texts that stand in more than one split; a group keeps its eight smallest ids, found by partial aggregates."""
    k = a.table(spark, d, "documents").select(F.md5("text").alias("key"), "doc_id", "source", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test").alias("split"))
    wide = k.groupBy("key").agg(F.count("*").alias("rows"), F.array_sort(F.collect_set("split")).alias("s"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).where(F.size("s") > 1)
    first = k.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("doc_id"))).where("n <= 8").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("examples"))
    return wide.join(first, "key").select("key", "rows", F.array_join("s", ",").alias("splits"), "sources", "examples")


@query("g28_issue_rollup", f"{_BASE}, iss AS (SELECT image, 3 AS severity, 'tiny_box' AS reason FROM gt WHERE (x2 - x1) * (y2 - y1) < 800 UNION ALL SELECT image, 2, 'touches_left' FROM gt WHERE x1 <= 4 UNION ALL SELECT image, 1, 'wide_box' FROM gt WHERE x2 - x1 > 150) SELECT i.image, count(iss.image) AS issues, coalesce(max(severity), 0)::INT AS worst, coalesce(array_to_string(list_sort(list_distinct(list(reason) FILTER (reason IS NOT NULL))), ','), '') AS reasons FROM images i LEFT JOIN iss USING (image) GROUP BY i.image")
def g28_issue_rollup(spark: SparkSession, d: str) -> DataFrame:
    rules = [("tiny_box", 3, g.area(g.box()) < 800), ("touches_left", 2, F.col("x1") <= 4), ("wide_box", 1, F.expr("x2 - x1 > 150"))]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(n).alias("reason"))) for n, s, c in rules]))
    issues = a.gt_boxes(spark, d).select("image", F.inline(found))
    r = issues.groupBy("image").agg(F.count("*").alias("issues"), F.max("severity").alias("worst"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    return a.images(spark, d).select("image").join(r, "image", "left").fillna(0, ["issues", "worst"]).fillna("", ["reasons"])


@query("g30_mined_per_image", f"{_BASE} SELECT image, count(*) AS n, max(confidence) AS best, array_to_string(list_sort(list_distinct(list(class_id::VARCHAR))), ';') AS class_list FROM preds WHERE confidence >= 0.7 GROUP BY image")
def g30_mined_per_image(spark: SparkSession, d: str) -> DataFrame:
    return a.pred_boxes(spark, d).where("confidence >= 0.7").groupBy("image").agg(F.count("*").alias("n"), F.max("confidence").alias("best"), F.array_join(F.array_sort(F.collect_set(F.col("class_id").cast("string"))), ";").alias("class_list"))


@query("g33_dimension_ranges", "SELECT p_brand, min(try_cast(regexp_extract(p_name, '([0-9]+)', 1) AS BIGINT)) AS least, max(try_cast(regexp_extract(p_name, '([0-9]+)', 1) AS BIGINT)) AS most, min(p_size) AS small, max(p_size) AS large FROM part GROUP BY p_brand")
def g33_dimension_ranges(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("p_name", "([0-9]+)", 1).try_cast("bigint")
    return a.table(spark, d, "part").groupBy("p_brand").agg(F.min(n).alias("least"), F.max(n).alias("most"), F.min("p_size").alias("small"), F.max("p_size").alias("large"))


@query("g36_repeat_stress", f"{_BASE}, c AS (SELECT image, class_id, count(*) AS n FROM gt GROUP BY ALL), m AS (SELECT image, max(n) AS most FROM c GROUP BY image) SELECT most, count(*) AS images FROM m GROUP BY most")
def g36_repeat_stress(spark: SparkSession, d: str) -> DataFrame:
    c = a.gt_boxes(spark, d).groupBy("image", "class_id").agg(F.count("*").alias("n"))
    return c.groupBy("image").agg(F.max("n").alias("most")).groupBy("most").agg(F.count("*").alias("images"))


_CENTRES = "e AS (SELECT label, vec_id % 2 AS domain, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)), c AS (SELECT label, domain, i, avg(v) AS v FROM e GROUP BY ALL), p AS (SELECT label, i, max(v) FILTER (domain = 0) AS x, max(v) FILTER (domain = 1) AS y FROM c GROUP BY ALL)"


@query("k4_centroid_gaps", f"WITH {_CENTRES} SELECT label, round(sqrt(sum((x - y) * (x - y))), 5) AS l2, round(1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 5) AS cosine FROM p GROUP BY label HAVING count(x) > 0 AND count(y) > 0")
def k4_centroid_gaps(spark: SparkSession, d: str) -> DataFrame:
    c = st.centroids(a.table(spark, d, "embeddings").withColumn("domain", F.col("vec_id") % 2), ["label", "domain"], "embedding")
    side = lambda k, n: c.where(F.col("domain") == k).select("label", F.col("centroid").alias(n))
    both = side(0, "x").join(side(1, "y"), "label")
    gap = F.zip_with("x", "y", lambda p, q: p - q)
    return both.select("label", F.round(F.sqrt(st.dot(gap, gap)), 5).alias("l2"), F.round(st.cosine_distance(F.col("x"), F.col("y")), 5).alias("cosine"))


@query("k10_confusion", f"{_BASE}, n AS (SELECT class_id, gate_class, count(*) AS n FROM preds GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY class_id), 9) AS share FROM n")
def k10_confusion(spark: SparkSession, d: str) -> DataFrame:
    n = a.pred_boxes(spark, d).groupBy("class_id", "gate_class").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("class_id")), 9))


@query("k11_inverse_weights", f"{_BASE}, n AS (SELECT class_id, count(*) AS n FROM gt GROUP BY 1) SELECT class_id, round((SELECT sum(n) FROM n) / greatest(1, (SELECT count(*) FROM n) * n)::DOUBLE, 9) AS weight FROM n")
def k11_inverse_weights(spark: SparkSession, d: str) -> DataFrame:
    n = a.gt_boxes(spark, d).groupBy("class_id").agg(F.count("*").alias("n"))
    t = n.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return n.crossJoin(F.broadcast(t)).select("class_id", F.round(F.col("total") / F.greatest(F.lit(1), F.col("k") * F.col("n")).cast("double"), 9).alias("weight"))


@query("l5_domain_gap_gate", f"{_BASE}, m AS (SELECT class_id, avg(CASE WHEN source_family = 'real' THEN x2 - x1 END) - avg(CASE WHEN source_family = 'synthetic' THEN x2 - x1 END) AS delta FROM gt JOIN images USING (image) GROUP BY 1) SELECT class_id, round(delta, 6) AS delta, abs(round(delta, 6)) <= 1.5 AS passed FROM m")
def l5_domain_gap_gate(spark: SparkSession, d: str) -> DataFrame:
    m = st.mean_delta(_labelled(spark, d).withColumn("w", F.expr("x2 - x1")), ["class_id"], "source_family", "real", "synthetic", "w")
    return m.select("class_id", "delta", (F.abs("delta") <= 1.5).alias("passed"))


@query("l8_drop_guard", f"{_BASE}, h AS (SELECT gt.class_id, gt.image % 2 AS arm, count(*) AS gt, count(p.image) AS hit FROM gt LEFT JOIN (SELECT DISTINCT image, class_id FROM preds) p ON p.image = gt.image AND p.class_id = gt.class_id GROUP BY ALL), r AS (SELECT class_id, max(hit / gt) FILTER (arm = 0) AS b, max(hit / gt) FILTER (arm = 1) AS c FROM h GROUP BY 1) SELECT class_id, round(c - b, 9) AS delta, round(c - b, 9) >= -0.01 AS passed FROM r")
def l8_drop_guard(spark: SparkSession, d: str) -> DataFrame:
    seen = a.pred_boxes(spark, d).select("image", "class_id").distinct().withColumn("seen", F.lit(True))
    h = a.gt_boxes(spark, d).join(seen, ["image", "class_id"], "left").withColumn("arm", F.col("image") % 2)
    share = lambda k: F.try_divide(F.count(F.when(F.col("arm") == k, F.col("seen"))).cast("double"), F.count_if(F.col("arm") == k))
    return h.groupBy("class_id").agg(F.round(share(1) - share(0), 9).alias("delta")).withColumn("passed", F.col("delta") >= -0.01)


@query("l12_split_guardrail", f"{_BASE}, b AS (SELECT split, count(*) AS n FROM images WHERE source_family = 'real' AND split <> 'test' GROUP BY 1), c AS (SELECT split, count(*) AS n FROM images WHERE source_family = 'synthetic' AND split <> 'val' GROUP BY 1) SELECT coalesce(b.split, c.split) AS split, b.n AS baseline, c.n AS candidate, CASE WHEN b.n IS NULL OR c.n IS NULL THEN 'missing' WHEN c.n <= b.n THEN 'pass' ELSE 'fail' END AS status FROM b FULL JOIN c ON b.split = c.split")
def l12_split_guardrail(spark: SparkSession, d: str) -> DataFrame:
    i = a.images(spark, d)
    b = i.where("source_family = 'real' and split <> 'test'").groupBy("split").agg(F.count("*").alias("baseline"))
    c = i.where("source_family = 'synthetic' and split <> 'val'").groupBy("split").agg(F.count("*").alias("candidate"))
    status = F.when(F.col("baseline").isNull() | F.col("candidate").isNull(), "missing").when(F.col("candidate") <= F.col("baseline"), "pass").otherwise("fail")
    return b.join(c, "split", "full_outer").withColumn("status", status)


@query("l21_class_minimums", f"{_BASE}, n AS (SELECT class_id, count(DISTINCT image) AS images, count(*) AS boxes FROM gt JOIN images USING (image) WHERE split = 'train' GROUP BY 1) SELECT class_name, coalesce(images, 0) AS images, coalesce(boxes, 0) AS boxes, coalesce(images, 0) >= 1500 AND coalesce(boxes, 0) >= 2000 AS passed FROM classes LEFT JOIN n USING (class_id)")
def l21_class_minimums(spark: SparkSession, d: str) -> DataFrame:
    n = _labelled(spark, d).where("split = 'train'").groupBy("class_id").agg(F.countDistinct("image").alias("images"), F.count("*").alias("boxes"))
    return a.classes(spark).join(n, "class_id", "left").fillna(0, ["images", "boxes"]).select("class_name", "images", "boxes", ((F.col("images") >= 1500) & (F.col("boxes") >= 2000)).alias("passed"))


@query("r14_metadata_summary", "SELECT event_type, count(value) AS n, min(value) AS least, round(median(value), 6) AS median, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY event_type")
def r14_metadata_summary(spark: SparkSession, d: str) -> DataFrame:
    e = a.table(spark, d, "events").select("event_type", "value")
    plain = e.groupBy("event_type").agg(F.count("value").alias("n"), F.min("value").alias("least"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))
    return st.with_quantiles(plain, st.quantiles(e, ["event_type"], "value", {"median": 0.5}), ["event_type"]).withColumn("median", F.round("median", 6))


@query("r11_role_source_recall", f"{_BASE}, h AS (SELECT i.split, i.source_group, count(gt.image) AS gt, count(p.image) AS hit FROM images i LEFT JOIN gt ON gt.image = i.image AND gt.class_id = 12 LEFT JOIN (SELECT DISTINCT image, class_id FROM preds) p ON p.image = gt.image AND p.class_id = gt.class_id GROUP BY ALL) SELECT split, source_group, gt, hit, round(coalesce(hit / nullif(gt, 0), 1.0::DOUBLE), 9) AS recall FROM h")
def r11_role_source_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of one class; 1 where the group has no labels of it."""
    seen = a.pred_boxes(spark, d).where("class_id = 12").select("image").distinct().withColumn("seen", F.lit(True))
    b = a.images(spark, d).join(a.gt_boxes(spark, d).where("class_id = 12").select("image", "label_index"), "image", "left").join(seen, "image", "left")
    hit = F.count(F.when(F.col("label_index").isNotNull(), F.col("seen")))
    out = b.groupBy("split", "source_group").agg(F.count("label_index").alias("gt"), hit.alias("hit"))
    return out.withColumn("recall", F.round(F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("gt")), F.lit(1.0)), 9))
