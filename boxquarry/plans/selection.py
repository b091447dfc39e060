"""Queries that rank, sample, mix and combine rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquarry.functions import geometry as g
from boxquarry.operators import selection as sel
from boxquarry.plans import adapters as a
from boxquarry.plans.adapters import with_ctes
from boxquarry.plans.registry import query

_BASE = with_ctes("classes", "images", "gt", "preds")


@query("h3_capped_review", f"{_BASE}, r AS (SELECT image, pred_index, class_id, confidence, row_number() OVER (PARTITION BY class_id ORDER BY confidence DESC, image, pred_index) AS k FROM preds) SELECT image, pred_index, class_id, confidence FROM r WHERE k <= 25 ORDER BY confidence DESC, image, pred_index LIMIT 200")
def h3_capped_review(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("confidence"), F.asc("image"), F.asc("pred_index")]
    return sel.capped_top(a.pred_boxes(spark, d), ["class_id"], order, 25, 200).select("image", "pred_index", "class_id", "confidence")


@query("h4_first_examples", f"{_BASE} SELECT image, label_index, class_id FROM gt QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY image, label_index) <= 12")
def h4_first_examples(spark: SparkSession, d: str) -> DataFrame:
    return sel.top_per_group(a.gt_boxes(spark, d), ["class_id"], [F.col("image"), F.col("label_index")], 12).select("image", "label_index", "class_id")


@query("h5_cluster_representatives", "WITH r AS (SELECT md5(text) AS key, doc_id, n_chars, source FROM documents) SELECT key, arg_max(doc_id, (n_chars, -doc_id)) AS representative, count(*) AS variants, array_to_string(list_sort(list_distinct(list(source)))[1:12], ',') AS sources FROM r GROUP BY key")
def h5_cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    r = a.table(spark, d, "documents").select(F.md5("text").alias("key"), "doc_id", "n_chars", "source")
    return r.groupBy("key").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("representative"), F.count("*").alias("variants"), F.array_join(F.slice(F.array_sort(F.collect_set("source")), 1, 12), ",").alias("sources"))


@query(
    "h10_candidate_tags",
    f"""{_BASE}, r AS (SELECT image, count(*) AS n, count(DISTINCT class_id) AS kinds, max((x2 - x1) * (y2 - y1)) AS biggest FROM gt GROUP BY image)
SELECT image, concat_ws(',', CASE WHEN n >= 4 THEN 'crowded' END, CASE WHEN kinds >= 3 THEN 'mixed' END, CASE WHEN biggest > 15000 THEN 'large' END) AS tags, n * 2 + CASE WHEN kinds >= 3 THEN 5 ELSE 0 END + CASE WHEN biggest > 15000 THEN 3 ELSE 0 END AS priority FROM r""",
)
def h10_candidate_tags(spark: SparkSession, d: str) -> DataFrame:
    r = a.gt_boxes(spark, d).groupBy("image").agg(F.count("*").alias("n"), F.countDistinct("class_id").alias("kinds"), F.max(g.area(g.box())).alias("biggest"))
    mixed, large = F.col("kinds") >= 3, F.col("biggest") > 15000
    tags = F.concat_ws(",", F.when(F.col("n") >= 4, "crowded"), F.when(mixed, "mixed"), F.when(large, "large"))
    return r.select("image", tags.alias("tags"), (F.col("n") * 2 + F.when(mixed, 5).otherwise(0) + F.when(large, 3).otherwise(0)).alias("priority"))


@query("h11_top_ranked", f"{_BASE}, r AS (SELECT i.source_group, p.image, max(confidence) AS best FROM preds p JOIN images i USING (image) GROUP BY ALL) SELECT source_group, image, best FROM r QUALIFY row_number() OVER (PARTITION BY source_group ORDER BY best DESC, image) <= 40")
def h11_top_ranked(spark: SparkSession, d: str) -> DataFrame:
    r = a.pred_boxes(spark, d).join(a.images(spark, d), "image").groupBy("source_group", "image").agg(F.max("confidence").alias("best"))
    return sel.top_per_group(r, ["source_group"], [F.desc("best"), F.asc("image")], 40)


@query(
    "h12_spread",
    f"""{_BASE}, r AS (SELECT source_group, image, row_number() OVER (PARTITION BY source_group ORDER BY image) - 1 AS pos, count(*) OVER (PARTITION BY source_group) AS n FROM images)
SELECT source_group, image FROM r WHERE n <= 9 OR pos IN (SELECT round_even(i * (n - 1) / 8::DOUBLE, 0)::BIGINT FROM range(9) t(i))""",
)
def h12_spread(spark: SparkSession, d: str) -> DataFrame:
    return sel.spread(a.images(spark, d).select("source_group", "image"), ["source_group"], [F.col("image")], 9)


@query("h14_best_rows", f"{_BASE}, r AS (SELECT class_id, count(*) AS n FROM gt GROUP BY 1) SELECT class_id, n FROM r WHERE n = (SELECT max(n) FROM r)")
def h14_best_rows(spark: SparkSession, d: str) -> DataFrame:
    r = a.gt_boxes(spark, d).groupBy("class_id").agg(F.count("*").alias("n"))
    return r.join(F.broadcast(r.agg(F.max("n").alias("n"))), "n").select("class_id", "n")


@query("h15_top_prediction", f"{_BASE} SELECT image, pred_index, class_id, confidence FROM preds QUALIFY row_number() OVER (PARTITION BY image ORDER BY confidence DESC, pred_index) = 1")
def h15_top_prediction(spark: SparkSession, d: str) -> DataFrame:
    return sel.first_of_key(a.pred_boxes(spark, d), ["image"], [F.desc("confidence"), F.asc("pred_index")]).select("image", "pred_index", "class_id", "confidence")


@query("h17_dominant_metric", f"{_BASE}, s AS (SELECT class_id, avg(x2 - x1) AS width, avg(y2 - y1) AS height, avg(x1) AS x_pos FROM gt GROUP BY 1), u AS (SELECT class_id, 'width' AS metric, round(width, 6) AS v FROM s UNION ALL SELECT class_id, 'height', round(height, 6) FROM s UNION ALL SELECT class_id, 'x_pos', round(x_pos, 6) FROM s) SELECT class_id, metric, v FROM u QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY v DESC, metric) = 1")
def h17_dominant_metric(spark: SparkSession, d: str) -> DataFrame:
    s = a.gt_boxes(spark, d).groupBy("class_id").agg(*[F.round(F.avg(e), 6).alias(n) for n, e in (("width", F.expr("x2 - x1")), ("height", F.expr("y2 - y1")), ("x_pos", F.col("x1")))])
    u = s.unpivot("class_id", ["width", "height", "x_pos"], "metric", "v")
    return sel.first_of_key(u, ["class_id"], [F.desc("v"), F.asc("metric")])


@query("h22_partial_focus", f"{_BASE}, r AS (SELECT *, (x2 - x1) * (y2 - y1) AS size, label_index % 2 AS side FROM gt) SELECT DISTINCT image, label_index FROM (SELECT image, label_index FROM r WHERE size < 3000 UNION ALL SELECT image, label_index FROM r QUALIFY row_number() OVER (PARTITION BY class_id, side ORDER BY size, image, label_index) <= 5)")
def h22_partial_focus(spark: SparkSession, d: str) -> DataFrame:
    r = a.gt_boxes(spark, d).withColumns({"size": g.area(g.box()), "side": F.col("label_index") % 2})
    least = sel.top_per_group(r, ["class_id", "side"], [F.col("size"), F.col("image"), F.col("label_index")], 5)
    return r.where("size < 3000").unionByName(least).select("image", "label_index").distinct()


@query("i4_hash_sample", "SELECT o_orderkey FROM orders ORDER BY sha256(concat('7:', o_orderkey)) LIMIT 500")
def i4_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "orders").select("o_orderkey").orderBy(sel.hash_order("7", "o_orderkey")).limit(500)


@query("i13_hash_sample_per_family", f"{_BASE} SELECT source_family, image FROM images QUALIFY row_number() OVER (PARTITION BY source_family ORDER BY sha256(concat('crop:', image))) <= 100")
def i13_hash_sample_per_family(spark: SparkSession, d: str) -> DataFrame:
    return sel.top_per_group(a.images(spark, d).select("source_family", "image"), ["source_family"], [sel.hash_order("crop", "image")], 100)


@query("i14_single_class_cap", f"{_BASE}, s AS (SELECT image, min(class_id) AS class_id FROM gt GROUP BY image HAVING count(DISTINCT class_id) = 1) SELECT image, class_id FROM s QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY sha256(concat('cap:', image))) <= 60")
def i14_single_class_cap(spark: SparkSession, d: str) -> DataFrame:
    s = a.gt_boxes(spark, d).groupBy("image").agg(F.min("class_id").alias("class_id"), F.max("class_id").alias("last")).where("class_id = last").drop("last")
    return sel.top_per_group(s, ["class_id"], [sel.hash_order("cap", "image")], 60)


@query("i12_equal_domains", f"{_BASE}, b AS (SELECT DISTINCT g.class_id, i.source_family, g.image FROM gt g JOIN images i USING (image)), r AS (SELECT *, row_number() OVER (PARTITION BY class_id, source_family ORDER BY sha256(concat('dom:', image))) AS k FROM b), n AS (SELECT class_id, least(count(*) FILTER (source_family = 'real'), count(*) FILTER (source_family = 'synthetic'), 30) AS cap FROM b GROUP BY 1) SELECT class_id, source_family, image FROM r JOIN n USING (class_id) WHERE k <= cap")
def i12_equal_domains(spark: SparkSession, d: str) -> DataFrame:
    """As many real as synthetic images of each class, at most thirty of either."""
    b = a.gt_boxes(spark, d).join(a.images(spark, d), "image").select("class_id", "source_family", "image").distinct()
    n = b.groupBy("class_id").agg(F.least(F.count_if(F.col("source_family") == "real"), F.count_if(F.col("source_family") == "synthetic"), F.lit(30)).alias("cap"))
    r = sel.top_per_group(b, ["class_id", "source_family"], [sel.hash_order("dom", "image")], 30, rank="k")
    return r.join(n, "class_id").where("k <= cap").select("class_id", "source_family", "image")


@query("i16_class_pools", f"{_BASE}, s AS (SELECT i.image, count(DISTINCT class_id) AS kinds, min(class_id) AS one FROM images i LEFT JOIN gt USING (image) GROUP BY 1) SELECT CASE kinds WHEN 0 THEN 'empty' WHEN 1 THEN 'single' ELSE 'multi' END AS pool, CASE WHEN kinds = 1 THEN one END AS class_id, count(*) AS images FROM s GROUP BY ALL")
def i16_class_pools(spark: SparkSession, d: str) -> DataFrame:
    s = a.images(spark, d).select("image").join(a.gt_boxes(spark, d).groupBy("image").agg(F.countDistinct("class_id").alias("kinds"), F.min("class_id").alias("only")), "image", "left").fillna(0, ["kinds"])
    pool = F.when(F.col("kinds") == 0, "empty").when(F.col("kinds") == 1, "single").otherwise("multi")
    return s.groupBy(pool.alias("pool"), F.when(F.col("kinds") == 1, F.col("only")).alias("class_id")).agg(F.count("*").alias("images"))


@query("i18_repeat_rule", f"{_BASE}, s AS (SELECT DISTINCT image FROM gt WHERE class_id = 4) SELECT s.image, c AS copy FROM s JOIN images USING (image), (VALUES (1), (2), (3)) v(c) WHERE regexp_matches(source_group, '^[12]-')")
def i18_repeat_rule(spark: SparkSession, d: str) -> DataFrame:
    s = a.gt_boxes(spark, d).where("class_id = 4").select("image").distinct().join(a.images(spark, d), "image").where(F.col("source_group").rlike("^[12]-"))
    return sel.repeat_rows(s.select("image"), F.lit(3))


@query("i19_apportion", f"{_BASE}, w AS (SELECT class_id, count(*) AS n FROM gt GROUP BY 1), s AS (SELECT class_id, n / (k + 0.5::DOUBLE) AS q, k FROM w, range(100) t(k) ORDER BY q DESC, class_id, k LIMIT 100) SELECT w.class_id, w.n, coalesce(c, 0) AS seats FROM w LEFT JOIN (SELECT class_id, count(*) AS c FROM s GROUP BY 1) USING (class_id)")
def i19_apportion(spark: SparkSession, d: str) -> DataFrame:
    return sel.apportion(a.gt_boxes(spark, d).groupBy("class_id").agg(F.count("*").alias("n")), 100, "class_id", "n")


@query("i27_union_all", f"{_BASE} SELECT image, count(*) AS exposures FROM (SELECT image FROM images WHERE split = 'train' UNION ALL SELECT image FROM gt WHERE class_id = 1) GROUP BY image")
def i27_union_all(spark: SparkSession, d: str) -> DataFrame:
    both = a.images(spark, d).where("split = 'train'").select("image").unionByName(a.gt_boxes(spark, d).where("class_id = 1").select("image"))
    return both.groupBy("image").agg(F.count("*").alias("exposures"))


@query("i27_union_distinct", f"{_BASE} SELECT image FROM images WHERE split = 'val' UNION SELECT image FROM gt WHERE class_id = 1")
def i27_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return a.images(spark, d).where("split = 'val'").select("image").unionByName(a.gt_boxes(spark, d).where("class_id = 1").select("image")).distinct()


@query("i28_except", f"{_BASE} SELECT image FROM images EXCEPT SELECT image FROM preds WHERE confidence >= 0.5")
def i28_except(spark: SparkSession, d: str) -> DataFrame:
    return a.images(spark, d).select("image").subtract(a.pred_boxes(spark, d).where("confidence >= 0.5").select("image"))


@query("i29_intersect", f"{_BASE} SELECT image FROM gt WHERE class_id = 2 INTERSECT SELECT image FROM preds WHERE class_id = 3")
def i29_intersect(spark: SparkSession, d: str) -> DataFrame:
    return a.gt_boxes(spark, d).where("class_id = 2").select("image").intersect(a.pred_boxes(spark, d).where("class_id = 3").select("image"))


@query("i32_round_robin", f"{_BASE}, s AS (SELECT image, min(class_id) AS class_id FROM gt GROUP BY image), r AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY sha256(concat('rr:', image))) AS k FROM s) SELECT image, class_id, k FROM r ORDER BY k, class_id LIMIT 200")
def i32_round_robin(spark: SparkSession, d: str) -> DataFrame:
    s = a.gt_boxes(spark, d).groupBy("image").agg(F.min("class_id").alias("class_id"))
    # no class gives more than the whole sample
    r = sel.top_per_group(s, ["class_id"], [sel.hash_order("rr", "image")], 200, rank="k")
    return r.orderBy("k", "class_id").limit(200).select("image", "class_id", F.col("k").cast("long").alias("k"))


@query("e26_round_robin_join", f"{_BASE}, p AS (SELECT image, row_number() OVER (ORDER BY image) - 1 AS i FROM images WHERE split = 'val'), n AS (SELECT image AS negative, row_number() OVER (ORDER BY image) - 1 AS j FROM images ANTI JOIN gt USING (image)) SELECT image, negative FROM p JOIN n ON n.j = p.i % (SELECT count(*) FROM n)")
def e26_round_robin_join(spark: SparkSession, d: str) -> DataFrame:
    i = a.images(spark, d)
    negative = i.join(a.gt_boxes(spark, d), "image", "left_anti").select(F.col("image").alias("negative"))
    return sel.cycle_join(i.where("split = 'val'").select("image"), negative, [F.col("image")], [F.col("negative")])


@query("f8_ordered_unique", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1")
def f8_ordered_unique(spark: SparkSession, d: str) -> DataFrame:
    return sel.first_of_key(a.table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "role"], [F.col("turn")])


@query("f10_best_asset", "SELECT p_brand, p_type, arg_max(p_partkey, (p_retailprice, p_size, -p_partkey)) AS best FROM part GROUP BY ALL")
def f10_best_asset(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_size", -F.col("p_partkey"))).alias("best"))


@query("f12_keeper_by_priority", "SELECT doc_id AS excluded FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY CASE source WHEN 'src0' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END, doc_id) > 1")
def f12_keeper_by_priority(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("source") == "src0", 0).when(F.col("source") == "src1", 1).otherwise(2)
    r = a.table(spark, d, "documents").select("doc_id", F.md5("text").alias("key"), rank.alias("rank"))
    # the keeper comes from one aggregate, so that a text with many copies needs no sort in one task
    keeper = r.groupBy("key").agg(F.min(F.struct("rank", "doc_id")).alias("k"))
    return r.join(keeper, "key").where(F.col("doc_id") != F.col("k.doc_id")).select(F.col("doc_id").alias("excluded"))


@query("f13_unique_ids", "WITH r AS (SELECT part.p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS base FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM r) SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS id FROM k")
def f13_unique_ids(spark: SparkSession, d: str) -> DataFrame:
    r = a.table(spark, d, "part").select("p_partkey", F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "_").alias("base"))
    # a base name may have very many rows: numbered by ranges, not in one window
    numbered = sel.number_in_groups(r, ["base"], [F.col("p_partkey")], "n", "size")
    return numbered.select("p_partkey", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat("base", F.lit("_"), (F.col("n") + 1).cast("string"))).alias("id"))


@query("r33_progress_rows", "SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id")
def r33_progress_rows(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return a.table(spark, d, "events").groupBy("user_id").agg(F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))


@query("r3_label_cap", f"{_BASE} SELECT image, label_index, class_id FROM gt QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY sha256(concat('9:', image, ':', label_index))) <= 50")
def r3_label_cap(spark: SparkSession, d: str) -> DataFrame:
    return sel.top_per_group(a.gt_boxes(spark, d), ["class_id"], [sel.hash_order("9", "image", "label_index")], 50).select("image", "label_index", "class_id")


@query("r4_fragment_boxes", f"{_BASE}, v(part, l, t, r, b) AS (VALUES ('full', 0, 0, 4, 4), ('left', 0, 0, 2, 4), ('right', 2, 0, 4, 4), ('top', 0, 0, 4, 2), ('bottom', 0, 2, 4, 4), ('top_left', 0, 0, 2, 2), ('top_right', 2, 0, 4, 2), ('bottom_left', 0, 2, 2, 4), ('bottom_right', 2, 2, 4, 4)) SELECT image, label_index, part, x1 + (x2 - x1) * l / 4::DOUBLE AS fx1, y1 + (y2 - y1) * t / 4::DOUBLE AS fy1, x1 + (x2 - x1) * r / 4::DOUBLE AS fx2, y1 + (y2 - y1) * b / 4::DOUBLE AS fy2 FROM gt, v")
def r4_fragment_boxes(spark: SparkSession, d: str) -> DataFrame:
    parts = [("full", 0, 0, 4, 4), ("left", 0, 0, 2, 4), ("right", 2, 0, 4, 4), ("top", 0, 0, 4, 2), ("bottom", 0, 2, 4, 4), ("top_left", 0, 0, 2, 2), ("top_right", 2, 0, 4, 2), ("bottom_left", 0, 2, 2, 4), ("bottom_right", 2, 2, 4, 4)]
    at = lambda lo, hi, k: (F.col(lo) + (F.col(hi) - F.col(lo)) * k / F.lit(4.0)).cast("double")
    made = F.array(*[F.struct(F.lit(n).alias("part"), at("x1", "x2", le).alias("fx1"), at("y1", "y2", t).alias("fy1"), at("x1", "x2", r).alias("fx2"), at("y1", "y2", b).alias("fy2")) for n, le, t, r, b in parts])
    return a.gt_boxes(spark, d).select("image", "label_index", F.inline(made))
