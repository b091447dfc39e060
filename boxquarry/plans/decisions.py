"""Review decisions and what follows from them: routes, variants, merges, relabelled boxes, comparisons, requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquarry.functions import geometry as g
from boxquarry.operators import contracts
from boxquarry.operators import selection as sel
from boxquarry.operators.statistics import quantiles
from boxquarry.plans import adapters as a
from boxquarry.plans.adapters import sql_iou, with_ctes
from boxquarry.plans.registry import query

_BASE = with_ctes("classes", "images", "gt", "preds")

# Uses that a review may name, decisions that count as accepted, and buckets whose training variants are taken.
USES = ["trusted_overlap_eval", "train_anchor_candidate", "hard_negative_context", "partial_policy_unclear", "unknown_or_foreign", "exclude_duplicate_or_flat", "exclude"]
ACCEPTED = ["accept", "accepted", "approved", "reviewed", "use", "usable"]
TRAIN_BUCKETS = ["train_anchor_candidate", "hard_negative_context"]

_SAID = ["Train-Anchor Candidate", "trusted_overlap_eval", "", "hard negative context", "bogus use"]
_ROUTE = ["", "train_anchor_candidate", " Trusted-Overlap-Eval ", "later"]
_DECIDED = ["Accept", "approved ", "maybe", "", "USE", "reject"]


def _pick_sql(values: list[str], n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({n}) % {len(values)} + 1]"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(repr(v) for v in values) + ")"


_REVIEWS = f"""{_BASE}, rv AS (SELECT image, split, {_pick_sql(_SAID, 'image')} AS said, {_pick_sql(_ROUTE, 'image // 5')} AS route, {_pick_sql(_DECIDED, 'image // 20')} AS decided, image || '| ' || (image + 1) || '|' || image || '| |' || (image + 2) AS variants FROM images),
nr AS (SELECT *, replace(replace(lower(trim(said)), '-', '_'), ' ', '_') AS u, replace(replace(lower(trim(route)), '-', '_'), ' ', '_') AS f, replace(replace(lower(trim(decided)), '-', '_'), ' ', '_') AS x FROM rv),
rt AS (SELECT *, CASE WHEN u = '' AND f = '' AND x = '' THEN NULL WHEN u <> '' AND u NOT IN {_in(USES)} THEN 'invalid_usable_as' WHEN f IN {_in(USES)} AND u <> '' AND f <> u THEN 'conflicting_usable_as_and_final_route' WHEN u = '' AND f NOT IN {_in(USES)} THEN 'missing_usable_as' WHEN x NOT IN {_in(ACCEPTED)} THEN 'review_decision_not_accepted' END AS reason,
 CASE WHEN u = '' AND f = '' AND x = '' OR u <> '' AND u NOT IN {_in(USES)} OR f IN {_in(USES)} AND u <> '' AND f <> u OR u = '' AND f NOT IN {_in(USES)} OR x NOT IN {_in(ACCEPTED)} THEN NULL WHEN u <> '' THEN u ELSE f END AS bucket FROM nr)"""


def _routed(spark: SparkSession, d: str) -> DataFrame:
    """(image, split, variants, reason, bucket): each reviewed cluster's bucket, or the reason why it has none; neither where nothing was said."""
    pick = lambda values, n: F.array(*[F.lit(v) for v in values])[(n % len(values)).cast("int")]
    i = F.col("image")
    text = lambda n: (i + n).cast("string")
    r = a.images(spark, d).select(
        "image", "split", pick(_SAID, i).alias("u"), pick(_ROUTE, F.floor(i / 5)).alias("f"), pick(_DECIDED, F.floor(i / 20)).alias("x"),
        F.concat(text(0), F.lit("| "), text(1), F.lit("|"), text(0), F.lit("| |"), text(2)).alias("variants"),
    )
    r = r.withColumns({c: F.translate(F.lower(F.trim(c)), "- ", "__") for c in ("u", "f", "x")})
    u, f, x = (F.col(c) for c in ("u", "f", "x"))
    known = f.isin(USES)
    silent = (u == "") & (f == "") & (x == "")
    reason = (
        F.when(silent, None).when((u != "") & ~u.isin(USES), "invalid_usable_as").when(known & (u != "") & (f != u), "conflicting_usable_as_and_final_route")
        .when((u == "") & ~known, "missing_usable_as").when(~x.isin(ACCEPTED), "review_decision_not_accepted")
    )
    r = r.withColumn("reason", reason)
    return r.select("image", "split", "variants", "reason", F.when(~silent & F.col("reason").isNull(), F.when(u != "", u).otherwise(f)).alias("bucket"))


@query("c21_review_routing", f"{_REVIEWS} SELECT image, bucket, reason FROM rt")
def c21_review_routing(spark: SparkSession, d: str) -> DataFrame:
    """The bucket that a review sends a cluster to, or why it goes to none."""
    return _routed(spark, d).select("image", "bucket", "reason")


@query(
    "c22_split_policy",
    f"""{_REVIEWS}, vs AS (SELECT image, bucket, list_filter(list_transform(string_split(variants, '|'), lambda x: trim(x)), lambda x: x <> '') AS v FROM rt WHERE bucket IS NOT NULL),
vu AS (SELECT DISTINCT image, bucket, unnest(v)::BIGINT AS chosen FROM vs)
SELECT image, bucket, chosen, CASE WHEN chosen = image THEN 'representative' ELSE 'train_variant' END AS role FROM vu WHERE bucket IN {_in(TRAIN_BUCKETS)} AND CASE WHEN chosen % 10 < 8 THEN 'train' WHEN chosen % 10 = 8 THEN 'val' ELSE 'test' END = 'train'
UNION ALL SELECT image, bucket, image, 'representative' FROM rt WHERE bucket NOT IN {_in(TRAIN_BUCKETS)}""",
)
def c22_split_policy(spark: SparkSession, d: str) -> DataFrame:
    """The images that a cluster gives to its bucket: all variants of the training split to training buckets, else the representative alone."""
    r = _routed(spark, d).where("bucket is not null")
    named = F.array_distinct(F.filter(F.transform(F.split("variants", "\\|"), lambda x: F.trim(x)), lambda x: x != ""))
    v = r.where(F.col("bucket").isin(TRAIN_BUCKETS)).select("image", "bucket", F.explode(F.transform(named, lambda x: x.cast("long"))).alias("chosen")).where("chosen % 10 < 8")
    v = v.withColumn("role", F.when(F.col("chosen") == F.col("image"), "representative").otherwise("train_variant"))
    return v.unionByName(r.where(~F.col("bucket").isin(TRAIN_BUCKETS)).select("image", "bucket", F.col("image").alias("chosen"), F.lit("representative").alias("role")))


# ---- merges ----

_FIELDS = ["review_include", "review_class", "review_notes"]


def review_key(first: Column, fallback: Column) -> Column:
    """The row's own key, or its path if that is blank, each with its kind; null if both are."""
    own, path = F.trim(F.coalesce(first, F.lit(""))), F.replace(F.trim(F.coalesce(fallback, F.lit(""))), F.lit("\\"), F.lit("/"))
    return F.when(own != "", F.concat(F.lit("crop_id:"), own)).when(path != "", F.concat(F.lit("crop_path:"), path))


def merge_reviews(source: DataFrame, export: DataFrame, fields: list[str]) -> DataFrame:
    """``source`` with the fields of the row of ``export`` that has its ``key``, and ``changed``, how many of them that alters.

    Rows without a key, or whose key isn't exported, stay as they are.  Reading it raises if a key stands twice in the export.
    """
    keyed = export.where("key is not null").groupBy("key").agg(F.count("*").alias("_n"), *[F.first(f).alias(f"_{f}") for f in fields])
    sound = keyed.withColumn("_ok", F.assert_true(F.col("_n") == 1, F.concat(F.lit("Export has duplicate keys: "), "key"))).where("_ok is null")
    joined = source.join(sound, "key", "left")
    known = F.col("_n").isNotNull()
    new = {f: F.when(known, F.coalesce(f"_{f}", F.lit(""))).otherwise(F.col(f)) for f in fields}
    changed = sum(F.when(known & ~F.col(f).eqNullSafe(F.coalesce(f"_{f}", F.lit(""))), 1).otherwise(0) for f in fields)
    return joined.select(*[new[c].alias(c) if c in fields else F.col(c) for c in source.columns], changed.cast("long").alias("changed"))


@query(
    "r9_review_merge",
    """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'c' || doc_id END AS id, CASE WHEN doc_id % 35 = 0 THEN '' ELSE 'crops\\' || doc_id END AS path, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END AS i, coalesce(lang, '') AS c, '' AS n FROM documents),
k AS (SELECT *, CASE WHEN trim(id) <> '' THEN 'crop_id:' || trim(id) WHEN path <> '' THEN 'crop_path:' || replace(path, '\\', '/') END AS key FROM s),
e AS (SELECT key, 'x' AS i, CASE WHEN doc_id % 8 = 0 THEN upper(c) ELSE c END AS c, CASE WHEN doc_id % 12 = 0 THEN 'seen' ELSE '' END AS n FROM k WHERE doc_id % 4 = 0 AND key IS NOT NULL)
SELECT doc_id, coalesce(e.i, k.i) AS review_include, coalesce(e.c, k.c) AS review_class, coalesce(e.n, k.n) AS review_notes, (coalesce(e.i <> k.i, FALSE)::INT + coalesce(e.c <> k.c, FALSE)::INT + coalesce(e.n <> k.n, FALSE)::INT)::BIGINT AS changed FROM k LEFT JOIN e USING (key)""",
)
def r9_review_merge(spark: SparkSession, d: str) -> DataFrame:
    """A manifest with the fields of an export of its reviews, by id or else by path."""
    i = F.col("doc_id")
    own, path = F.when(i % 5 == 0, " ").otherwise(F.concat(F.lit("c"), i.cast("string"))), F.when(i % 35 == 0, "").otherwise(F.concat(F.lit("crops\\"), i.cast("string")))
    source = a.table(spark, d, "documents").select("doc_id", review_key(own, path).alias("key"), F.when(i % 3 == 0, "x").otherwise("").alias("review_include"), F.coalesce("lang", F.lit("")).alias("review_class"), F.lit("").alias("review_notes"))
    export = source.where("doc_id % 4 = 0").select("key", F.lit("x").alias("review_include"), F.when(i % 8 == 0, F.upper("review_class")).otherwise(F.col("review_class")).alias("review_class"), F.when(i % 12 == 0, "seen").otherwise("").alias("review_notes"))
    return merge_reviews(source, export, _FIELDS).drop("key")


# ---- boxes that change in place ----

_SUPPORTED = (3, 7, 11)


@query(
    "e22_supported_relabel",
    f"""{_BASE}, rs AS (SELECT image, list({{'i': pred_index, 'c': class_id, 'f': confidence, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'o': class_id}} ORDER BY pred_index) AS rows FROM preds GROUP BY 1),
dn AS (SELECT image, list_reduce(list_transform(range(len(rows)), lambda k: {{'k': k, 'rows': rows[1:0]}}), lambda a, e: {{'k': e.k, 'rows': list_transform(a.rows, lambda x, n: CASE WHEN n <> e.k + 1 OR x.c IN {_SUPPORTED} OR len(list_filter(a.rows, lambda y: y.i <> x.i AND y.c IN {_SUPPORTED} AND {sql_iou('x', 'y')} >= 0.3)) = 0 THEN x
 ELSE {{'i': x.i, 'c': list_sort(list_transform(list_filter(a.rows, lambda y: y.i <> x.i AND y.c IN {_SUPPORTED} AND {sql_iou('x', 'y')} >= 0.3), lambda y: {{'f': -y.f, 'i': y.i, 'c': y.c}}))[1].c, 'f': -list_sort(list_transform(list_filter(a.rows, lambda y: y.i <> x.i AND y.c IN {_SUPPORTED} AND {sql_iou('x', 'y')} >= 0.3), lambda y: {{'f': -y.f, 'i': y.i, 'c': y.c}}))[1].f, 'x1': x.x1, 'y1': x.y1, 'x2': x.x2, 'y2': x.y2, 'o': x.o}} END)}}, {{'k': -1::BIGINT, 'rows': rows}}).rows AS rows FROM rs)
SELECT image, r.i AS pred_index, r.c AS class_id, r.f AS confidence, r.c <> r.o AS relabelled FROM (SELECT image, unnest(rows) AS r FROM dn)""",
)
def e22_supported_relabel(spark: SparkSession, d: str) -> DataFrame:
    """Box by box, one of another class takes class and score of the surest box of a supported class that overlaps it; later boxes see the change."""
    own = F.struct(F.col("pred_index").alias("i"), F.col("class_id").alias("c"), F.col("confidence").alias("f"), "x1", "y1", "x2", "y2", F.col("class_id").alias("o"))
    rows = a.pred_boxes(spark, d).groupBy("image").agg(F.array_sort(F.collect_list(own)).alias("rows"))

    def turn(held: Column, k: Column) -> Column:
        def changed(x: Column) -> Column:
            fits = F.filter(held, lambda y: (y["i"] != x["i"]) & y["c"].isin(*_SUPPORTED) & (g.iou(g.box_in(x), g.box_in(y)) >= 0.3))
            best = F.array_min(F.transform(fits, lambda y: F.struct((-y["f"]).alias("f"), y["i"].alias("i"), y["c"].alias("c"))))
            new = x.withField("c", best["c"]).withField("f", -best["f"])
            return F.when(x["c"].isin(*_SUPPORTED) | best.isNull(), x).otherwise(new)

        return F.transform(held, lambda x, n: F.when(n == k, changed(x)).otherwise(x))

    done = F.aggregate(F.sequence(F.lit(0), F.size("rows") - 1), F.col("rows"), turn)
    return rows.select("image", F.explode(done).alias("r")).select("image", F.col("r.i").alias("pred_index"), F.col("r.c").alias("class_id"), F.col("r.f").alias("confidence"), (F.col("r.c") != F.col("r.o")).alias("relabelled"))


# ---- comparisons ----


def _value_sql(rel: str, where: str) -> str:
    return f"SELECT image, sum(CASE WHEN currency = 'USD' THEN face_value ELSE 0 END) AS usd, sum(CASE WHEN currency = 'KHR' THEN face_value ELSE 0 END) AS khr FROM {rel} JOIN classes USING (class_id) WHERE {where} GROUP BY 1"


@query(
    "e12_wins_and_losses",
    f"""{_BASE}, t AS ({_value_sql('gt', 'TRUE')}), b AS ({_value_sql('preds', 'confidence >= 0.3')}), c AS ({_value_sql('preds', 'confidence >= 0.6')}),
v AS (SELECT i.image, source_group, abs(coalesce(b.usd, 0) - coalesce(t.usd, 0)) + abs(coalesce(b.khr, 0) - coalesce(t.khr, 0)) / 4000 AS wb, abs(coalesce(c.usd, 0) - coalesce(t.usd, 0)) + abs(coalesce(c.khr, 0) - coalesce(t.khr, 0)) / 4000 AS wc,
 coalesce(b.usd, 0) = coalesce(t.usd, 0) AND coalesce(b.khr, 0) = coalesce(t.khr, 0) AS xb, coalesce(c.usd, 0) = coalesce(t.usd, 0) AND coalesce(c.khr, 0) = coalesce(t.khr, 0) AS xc FROM images i LEFT JOIN t USING (image) LEFT JOIN b USING (image) LEFT JOIN c USING (image))
SELECT image, source_group, round(wb, 6) AS baseline_weighted_error, round(wc, 6) AS candidate_weighted_error, concat_ws(';', CASE WHEN NOT xb AND xc THEN 'candidate_exact_win' WHEN xb AND NOT xc THEN 'candidate_exact_loss' END, CASE WHEN wc < wb THEN 'candidate_weighted_better' WHEN wc > wb THEN 'candidate_weighted_worse' END) AS direction FROM v WHERE xb <> xc OR wb <> wc""",
)
def e12_wins_and_losses(spark: SparkSession, d: str) -> DataFrame:
    """Images on which two sets of predictions differ in value: which is exact, and which is nearer, 4,000 of one currency weighing as one of the other."""
    money = lambda currency, name, when: F.sum(F.when(when & (F.col("currency") == currency), F.col("face_value")).otherwise(0.0)).alias(name)
    priced = lambda boxes: boxes.join(a.classes(spark), "class_id").groupBy("image")
    t = priced(a.gt_boxes(spark, d)).agg(money("USD", "tu", F.lit(True)), money("KHR", "tk", F.lit(True)))
    low, high = F.col("confidence") >= 0.3, F.col("confidence") >= 0.6
    p = priced(a.pred_boxes(spark, d)).agg(money("USD", "bu", low), money("KHR", "bk", low), money("USD", "cu", high), money("KHR", "ck", high))
    v = a.images(spark, d).select("image", "source_group").join(t, "image", "left").join(p, "image", "left").fillna(0.0)
    far = lambda x: F.abs(F.col(f"{x}u") - F.col("tu")) + F.abs(F.col(f"{x}k") - F.col("tk")) / 4000
    exact = lambda x: (F.col(f"{x}u") == F.col("tu")) & (F.col(f"{x}k") == F.col("tk"))
    v = v.select("image", "source_group", far("b").alias("wb"), far("c").alias("wc"), exact("b").alias("xb"), exact("c").alias("xc")).where("xb <> xc or wb <> wc")
    direction = F.concat_ws(";", F.expr("case when not xb and xc then 'candidate_exact_win' when xb and not xc then 'candidate_exact_loss' end"), F.expr("case when wc < wb then 'candidate_weighted_better' when wc > wb then 'candidate_weighted_worse' end"))
    return v.select("image", "source_group", F.round("wb", 6).alias("baseline_weighted_error"), F.round("wc", 6).alias("candidate_weighted_error"), direction.alias("direction"))


# ---- requirements and registrations ----

_NEEDS = [("a", "lang", "en", "100", "yes", "1"), ("b", "source", "src3", "", "", ""), ("c", "lang", "xx", "4", "Optional", "high"), ("d", "source", "src5", "1000000", " no ", "3"), ("e", "lang", "fr", "10", "yes", "2"), ("f", "lang", "yy", "2", "", "4")]


@query(
    "r22_requirement_rows",
    "WITH q(requirement_id, match_column, match_value, min_images, required, priority) AS (VALUES " + ", ".join(str(n) for n in _NEEDS) + """), u AS (SELECT 'lang' AS match_column, lang AS match_value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL),
r AS (SELECT requirement_id, match_column, match_value, coalesce(try_cast(coalesce(nullif(priority, ''), '5') AS INT), 5)::BIGINT AS priority, coalesce(nullif(min_images, ''), '0')::BIGINT AS minimum, coalesce(n, 0) AS count, lower(trim(required)) NOT IN ('0', 'false', 'no', 'optional') AS required FROM q LEFT JOIN u USING (match_column, match_value))
SELECT *, greatest(0, minimum - count) AS missing, CASE WHEN count >= minimum THEN 'ok' WHEN required THEN 'missing' ELSE 'optional_missing' END AS status FROM r""",
)
def r22_requirement_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each requirement with what there is, what is missing, and its state; blank and malformed numbers have defaults."""
    q = spark.createDataFrame(_NEEDS, "requirement_id string, match_column string, match_value string, min_images string, required string, priority string").coalesce(1)
    counts = a.table(spark, d, "documents").select("lang", "source").unpivot([], ["lang", "source"], "match_column", "match_value").groupBy("match_column", "match_value").agg(F.count("*").alias("count"))
    number = lambda name, other: F.coalesce(F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(str(other))).try_cast("int"), F.lit(other)).cast("long")
    r = F.broadcast(q).join(counts, ["match_column", "match_value"], "left").fillna(0, ["count"])
    r = r.select("requirement_id", "match_column", "match_value", number("priority", 5).alias("priority"), number("min_images", 0).alias("minimum"), "count", (~F.lower(F.trim("required")).isin("0", "false", "no", "optional")).alias("required"))
    return r.select("*", F.greatest(F.lit(0), F.col("minimum") - F.col("count")).alias("missing"), F.when(F.col("count") >= F.col("minimum"), "ok").when(F.col("required"), "missing").otherwise("optional_missing").alias("status"))


_SHARES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


@query(
    "r29_metadata_quantiles",
    "WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, " + ", ".join(f"max(value) FILTER (k = least(n - 1, greatest(0, round_even((n - 1) * {s}::DOUBLE, 0)::BIGINT))) AS {n}" for n, s in _SHARES.items()) + " FROM v GROUP BY 1",
)
def r29_metadata_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Values at five places of each group's sorted values, the place rounded."""
    return quantiles(a.table(spark, d, "events").select("event_type", "value"), ["event_type"], "value", _SHARES, linear=False)


@query(
    "m18_capture_registration",
    """WITH f AS (SELECT doc_id, 'inbox/' || doc_id || '.jpg' AS path, trim(regexp_replace(lower(coalesce(source, '') || ' ' || coalesce(lang, '')), '[^a-z0-9]+', '_', 'g'), '_') AS base, CASE WHEN lang IN ('en', 'de') THEN 'single_note' ELSE 'mixed_notes' END AS scene FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END, doc_id) AS n FROM f) SELECT doc_id, path AS local_path, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS image_id, scene AS scene_type FROM k WHERE doc_id % 3 <> 0""",
)
def m18_capture_registration(spark: SparkSession, d: str) -> DataFrame:
    """Rows for pictures that the inventory (every third one) doesn't have yet, with ids that go on after those it has given out."""
    doc = a.table(spark, d, "documents")
    base = F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    f = doc.select("doc_id", F.concat(F.lit("inbox/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("local_path"), base.alias("base"), F.when(F.col("lang").isin("en", "de"), "single_note").otherwise("mixed_notes").alias("scene_type"), (F.col("doc_id") % 3 != 0).alias("fresh"))
    # a base may have very many rows: numbered by ranges, those of the inventory first
    k = sel.number_in_groups(f, ["base"], [F.col("fresh"), F.col("doc_id")], "n", "size").where("fresh")
    return k.select("doc_id", "local_path", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat("base", F.lit("_"), (F.col("n") + 1).cast("string"))).alias("image_id"), "scene_type")


# ---- stored tables ----


@query("l18_label_views", "WITH s AS (SELECT source, lang, sum(n_chars)::BIGINT AS n FROM documents GROUP BY ALL), r AS (SELECT source, lang, sum(length(text))::BIGINT AS n FROM documents GROUP BY ALL) SELECT source, lang, s.n AS stored, r.n AS counted FROM s FULL JOIN r USING (source, lang) WHERE s.n IS DISTINCT FROM r.n")
def l18_label_views(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose stored number of characters isn't that of their texts."""
    doc = a.table(spark, d, "documents")
    stored, counted = doc.groupBy("source", "lang").agg(F.sum("n_chars").alias("n")), doc.groupBy("source", "lang").agg(F.sum(F.length("text")).alias("n"))
    return contracts.view_differences(stored, counted, ["source", "lang"], "n")


@query(
    "l23_freshness",
    "WITH r AS (SELECT doc_id::VARCHAR AS path, quality IS NOT NULL AS required, n_chars > 20 AS existed, CASE WHEN n_chars % 41 = 0 THEN '' ELSE sha256(n_chars::VARCHAR) END AS stored, doc_id FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT doc_id, sha256(length(rtrim(text, '.'))::VARCHAR) AS now FROM documents WHERE lang IS NOT NULL AND length(text) > 20), j AS (SELECT r.*, now, n.doc_id IS NOT NULL AS here FROM r LEFT JOIN n USING (doc_id)) SELECT path, 'was missing when the report was generated' AS failure FROM j WHERE required AND NOT existed UNION ALL SELECT path, 'path is missing' FROM j WHERE NOT here AND (existed OR required) UNION ALL SELECT path, 'is missing sha256' FROM j WHERE here AND stored = '' UNION ALL SELECT path, 'fingerprint is stale' FROM j WHERE here AND stored <> '' AND stored <> now",
)
def l23_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose stored size isn't that of what is there without its last points, which are missing, or which were never recorded."""
    doc = a.table(spark, d, "documents").join(a.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    digest = lambda n: F.sha2(n.cast("string"), 256)
    path = F.col("doc_id").cast("string").alias("path")
    report = doc.select(path, F.col("quality").isNotNull().alias("required"), (F.col("n_chars") > 20).alias("existed"), F.when(F.col("n_chars") % 41 == 0, "").otherwise(digest(F.col("n_chars"))).alias("sha256"))
    present = doc.where(F.col("lang").isNotNull() & (F.length("text") > 20)).select(path, digest(F.length(F.regexp_replace("text", "\\.+$", ""))).alias("sha256"))
    return contracts.stale_rows(report, present)
