"""Ledgers of what a run obliges one to do, and checks of reviewed quality rows against draft labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from boxquarry.functions import text as tx
from boxquarry.operators import metrics
from boxquarry.plans import adapters as a
from boxquarry.plans.adapters import with_ctes
from boxquarry.plans.registry import query
from boxquarry.plans.reports import _DELTA_SQL, _METRIC_SQL, _STAGED, BOX_LIMITS, GATE_SHARE, _deltas, _measured, _outcomes, _stages, _view
from boxquarry.sources.scratch import cut

_BASE = with_ctes("classes", "images", "gt", "preds")
_MISSES = ("no_box", "wrong_class", "same_class_conflict")


def _run(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of the gated stage, counted finely: (split, source_group, class_id, kind, other, bare, image_rows, n); bare tells images without labels."""
    images = a.images(spark, d).select("image", "split", "source_group")
    staged = metrics.staged_outcomes(images, a.pred_boxes(spark, d), _view(spark, d), {"gated": _stages()["gated"]}, more=("gate_class", "gate_conf"), best=())
    # an image without labels is counted once, by its first extra prediction
    first = F.transform("outcomes", lambda x, k: x.withField("bare", F.size("_l") == 0).withField("first", (k == 0) & (F.size("_l") == 0)))
    rows = _outcomes(staged.withColumn("outcomes", first))
    return rows.groupBy("split", "source_group", "class_id", "kind", "other", "bare").agg(F.count("*").alias("n"), F.count_if("first").alias("bare_images"))


_RUN = f"""{_STAGED}, bare AS (SELECT image FROM images ANTI JOIN vg USING (image)), rn AS MATERIALIZED (SELECT split, source_group, class_id, kind, other, b.image IS NOT NULL AS bare, r.image
 FROM (SELECT image, class_id, kind, other FROM lo WHERE stage = 'gated' UNION ALL SELECT image, class_id, 'fp', NULL FROM xp WHERE stage = 'gated') r JOIN images USING (image) LEFT JOIN bare b ON b.image = r.image)"""


def _tally(run: DataFrame, *by: str) -> DataFrame:
    n = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))
    out = run.groupBy(*by).agg(n("tp", *_MISSES).alias("gt"), n("tp").alias("tp"), n(*_MISSES).alias("fn"), n("no_box").alias("missed"), n("fp").alias("fp"), F.sum("bare_images").alias("bare_with_fp"), F.coalesce(F.sum(F.when(F.col("bare"), F.col("n"))), F.lit(0)).alias("bare_fp"))
    return out.withColumns({"recall": metrics.ratio(F.col("tp"), F.col("gt")), "precision": metrics.ratio(F.col("tp"), F.col("tp") + F.col("fp"))})


_TALLY = """count(*) FILTER (kind <> 'fp') AS gt, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind NOT IN ('tp', 'fp')) AS fn, count(*) FILTER (kind = 'no_box') AS missed, count(*) FILTER (kind = 'fp') AS fp, count(DISTINCT image) FILTER (bare) AS bare_with_fp, count(*) FILTER (bare) AS bare_fp,
 count(*) FILTER (kind = 'tp') / nullif(count(*) FILTER (kind <> 'fp'), 0) AS recall, count(*) FILTER (kind = 'tp') / nullif(count(*) FILTER (kind IN ('tp', 'fp')), 0) AS precision"""


@query(
    "m6_obligations",
    f"""{_RUN}, c AS (SELECT class_id, {_TALLY}, string_agg(DISTINCT source_group, ';' ORDER BY source_group) FILTER (kind NOT IN ('tp', 'fp')) AS sources FROM rn GROUP BY 1), s AS (SELECT source_group, {_TALLY} FROM rn GROUP BY 1)
 SELECT 'positive' AS kind, class_id::VARCHAR AS name, fn AS weight, coalesce(sources, '') AS sources FROM c WHERE fn >= 40 OR coalesce(recall, 1) <= 0.05
 UNION ALL SELECT 'negative', source_group, CASE WHEN bare_with_fp >= 50 THEN bare_with_fp ELSE fp END, source_group FROM s WHERE bare_with_fp >= 50 OR (fp >= 100 AND coalesce(precision, 1) <= 0.5)""",
)
def m6_obligations(spark: SparkSession, d: str) -> DataFrame:
    """Classes that miss too often, with the sources where they do, and sources with extras on empty images or with low precision."""
    run = cut(_run(spark, d), "run-outcomes")
    missing = F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind").isin(*_MISSES), F.col("source_group")))), ";").alias("sources")
    c = _tally(run, "class_id").join(run.groupBy("class_id").agg(missing), "class_id").where("fn >= 40 or coalesce(recall, 1) <= 0.05")
    s = _tally(run, "source_group").where("bare_with_fp >= 50 or (fp >= 100 and coalesce(precision, 1) <= 0.5)")
    positive = c.select(F.lit("positive").alias("kind"), F.col("class_id").cast("string").alias("name"), F.col("fn").alias("weight"), "sources")
    return positive.unionByName(s.select(F.lit("negative").alias("kind"), F.col("source_group").alias("name"), F.when(F.col("bare_with_fp") >= 50, F.col("bare_with_fp")).otherwise(F.col("fp")).alias("weight"), F.col("source_group").alias("sources")))


_P0, _P1 = ("1-URGENT", "2-HIGH"), ("3-MEDIUM",)
#: Kinds of evidence in the order in which they enter: the first obligation of an id stays.
_KINDS = ["scorecard", "split recall", "class recall", "wrong class", "background fp", "class transfer", "class fp", "source recall", "source fp", "crop geometry"]
_SLUG = lambda key: f"trim(regexp_replace(lower({key}), '[^a-z0-9]+', '_', 'g'), '_')"
_TRANSFER = "CASE WHEN precision <= 0.5 AND NOT coalesce(recall <= 0.2, false) THEN 'near_negative_discrimination' WHEN recall <= 0.2 THEN 'class_identity_recall' ELSE 'class_transfer' END"
_EVIDENCE = f"""SELECT 0 AS kind, 'scorecard ' || source_group AS key, CASE WHEN source_group IN {_P0} THEN 0 WHEN source_group = '{_P1[0]}' THEN 1 ELSE 2 END AS priority, 'scorecard_blocker' AS category, fn AS n FROM s WHERE recall < 0.5
 UNION ALL SELECT 1, 'split recall ' || split, 0, 'positive_recall', missed FROM p WHERE gt > 0 AND missed / gt >= 0.3
 UNION ALL SELECT 2, 'class recall ' || split || ' ' || class_id, 0, 'class_identity_recall', fn FROM pc WHERE gt >= 20 AND recall <= 0.05
 UNION ALL SELECT 3, 'wrong class ' || split || ' ' || class_id || ' ' || other, 1, 'class_confusion', count(*) FROM rn WHERE kind = 'wrong_class' GROUP BY split, class_id, other HAVING count(*) >= 10
 UNION ALL SELECT 4, 'background fp ' || source_group, 0, 'near_negative_discrimination', bare_fp FROM s WHERE bare_with_fp >= 5 OR bare_fp >= 5
 UNION ALL SELECT 5, 'class transfer ' || class_id, 0, {_TRANSFER}, fn + fp FROM c WHERE recall <= 0.2 OR precision <= 0.5
 UNION ALL SELECT 6, 'class fp ' || class_id, 0, 'near_negative_discrimination', fp FROM c WHERE fp >= 50 OR (precision <= 0.5 AND fp > 0)
 UNION ALL SELECT 7, 'source recall ' || source_group, 1, 'source_domain_transfer', fn FROM s WHERE gt >= 20 AND recall <= 0.3
 UNION ALL SELECT 8, 'source fp ' || source_group, 1, 'near_negative_discrimination', fp FROM s WHERE fp >= 50 AND coalesce(precision, 0) <= 0.5
 UNION ALL SELECT 9, 'crop geometry ' || metric, 0, 'geometry_transfer', synthetic_boxes FROM w WHERE abs(synthetic - real) >= CASE metric {" ".join(f"WHEN '{m}' THEN {round(v * GATE_SHARE, 6)}" for m, v in BOX_LIMITS.items())} END"""


@query(
    "m9_obligation_ledger",
    f"""{_RUN}, mb AS (SELECT image, class_id, source_group, source_family, {', '.join(f'{e} AS {n}' for n, e in _METRIC_SQL.items())} FROM gt JOIN images USING (image)), w AS ({_DELTA_SQL("")}),
 s AS (SELECT source_group, {_TALLY} FROM rn GROUP BY 1), p AS (SELECT split, {_TALLY} FROM rn GROUP BY 1), c AS (SELECT class_id, {_TALLY} FROM rn GROUP BY 1), pc AS (SELECT split, class_id, {_TALLY} FROM rn GROUP BY 1, 2), ev AS ({_EVIDENCE}),
 ids AS (SELECT CASE WHEN length({_SLUG("key")}) <= 40 THEN {_SLUG("key")} ELSE {_SLUG("key")}[1:31] || '_' || sha1({_SLUG("key")})[1:8] END AS id, * FROM ev)
 SELECT id, key, priority, category, n FROM ids QUALIFY row_number() OVER (PARTITION BY id ORDER BY kind, key) = 1""",
)
def m9_obligation_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Obligations of ten kinds of evidence in one ledger: scorecard axes, recall by split, class and source, confusions, extras, transfer, geometry; one row an id."""
    run = cut(_run(spark, d), "run-outcomes")
    s, p, c, pc = (_tally(run, *by) for by in (["source_group"], ["split"], ["class_id"], ["split", "class_id"]))
    pairs = run.where("kind = 'wrong_class'").groupBy("split", "class_id", "other").agg(F.sum("n").alias("count"))
    limit = F.coalesce(*[F.when(F.col("metric") == m, F.lit(round(v * GATE_SHARE, 6))) for m, v in BOX_LIMITS.items()])
    rank = F.when(F.col("source_group").isin(*_P0), 0).when(F.col("source_group").isin(*_P1), 1).otherwise(2)
    low_recall, low_precision = F.coalesce(F.col("recall") <= 0.2, F.lit(False)), F.coalesce(F.col("precision") <= 0.5, F.lit(False))
    transfer = F.when(low_precision & ~low_recall, "near_negative_discrimination").when(low_recall, "class_identity_recall").otherwise("class_transfer")

    def row(kind: str, *names: str, priority: Column | int, category: Column | str, n: Column) -> Column:
        key = F.concat_ws(" ", F.lit(kind), *[F.col(x).cast("string") for x in names])
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(F.lit(_KINDS.index(kind)).alias("kind"), key.alias("key"), lit(priority).alias("priority"), lit(category).alias("category"), n.cast("long").alias("n"))

    def rows(frame: DataFrame, *rules: tuple[Column | str, Column]) -> DataFrame:
        return frame.select(F.inline(F.array_compact(F.array(*[F.when(F.expr(t) if isinstance(t, str) else t, r) for t, r in rules]))))

    made = rows(
        s,
        ("recall < 0.5", row("scorecard", "source_group", priority=rank, category="scorecard_blocker", n=F.col("fn"))),
        ("bare_with_fp >= 5 or bare_fp >= 5", row("background fp", "source_group", priority=0, category="near_negative_discrimination", n=F.col("bare_fp"))),
        ("gt >= 20 and recall <= 0.3", row("source recall", "source_group", priority=1, category="source_domain_transfer", n=F.col("fn"))),
        ("fp >= 50 and coalesce(precision, 0) <= 0.5", row("source fp", "source_group", priority=1, category="near_negative_discrimination", n=F.col("fp"))),
    )
    more = [
        rows(p, ("gt > 0 and missed / gt >= 0.3", row("split recall", "split", priority=0, category="positive_recall", n=F.col("missed")))),
        rows(pc, ("gt >= 20 and recall <= 0.05", row("class recall", "split", "class_id", priority=0, category="class_identity_recall", n=F.col("fn")))),
        rows(pairs, ("count >= 10", row("wrong class", "split", "class_id", "other", priority=1, category="class_confusion", n=F.col("count")))),
        rows(
            c,
            (low_recall | low_precision, row("class transfer", "class_id", priority=0, category=transfer, n=F.col("fn") + F.col("fp"))),
            ("fp >= 50 or (precision <= 0.5 and fp > 0)", row("class fp", "class_id", priority=0, category="near_negative_discrimination", n=F.col("fp"))),
        ),
        rows(_deltas(_measured(spark, d), []), (F.abs("delta") >= limit, row("crop geometry", "metric", priority=0, category="geometry_transfer", n=F.col("synthetic_boxes")))),
    ]
    for one in more:
        made = made.unionByName(one)
    first = made.withColumn("id", tx.slug(F.col("key"))).groupBy("id").agg(F.min_by(F.struct("key", "priority", "category", "n"), F.struct("kind", "key")).alias("o"))
    return first.select("id", "o.*")


# ---- reviewed quality rows ----

# Qualities, and the spellings of whether a row counts for the score.
SCOREABLE, OTHER = ("clear", "partial_clear"), ("reject", "needs_review")
YES, REVIEW, NO = ("1", "true", "yes", "y", "score", "keep"), ("review", "needs_review"), ("0", "false", "no", "n", "reject", "drop", "")
_REVIEWED = f"""{_BASE}, dl AS (SELECT image, count(*) AS drafts FROM gt GROUP BY 1), q AS (SELECT l_orderkey AS image, (l_linenumber - 1)::BIGINT AS idx, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE class_name END AS class_name, CASE WHEN l_tax = 0.08 THEN 'blurry' WHEN l_discount = 0.1 THEN 'needs_review' WHEN l_returnflag = 'A' THEN 'clear' WHEN l_returnflag = 'N' THEN 'partial_clear' ELSE 'reject' END AS quality,
 CASE WHEN l_linestatus = 'O' THEN ' Yes ' WHEN l_quantity % 4 = 0 THEN 'review' WHEN l_quantity % 4 = 1 THEN 'drop' WHEN l_quantity % 4 = 2 THEN 'maybe' ELSE 'score' END AS says, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS seen FROM lineitem JOIN classes ON class_id = l_suppkey % 13),
 st AS (SELECT q.*, drafts, g.class_id, c.class_name AS expected, CASE WHEN lower(trim(says)) IN {YES} THEN 'score' WHEN lower(trim(says)) IN {REVIEW} THEN 'review' WHEN lower(trim(says)) IN {NO} THEN 'drop' ELSE 'invalid' END AS state FROM q LEFT JOIN dl USING (image) LEFT JOIN gt g ON g.image = q.image AND g.label_index = q.idx LEFT JOIN classes c ON c.class_id = g.class_id),
 ev AS (SELECT *, CASE WHEN seen > 1 THEN ['duplicate'] WHEN class_id IS NULL THEN ['index_outside'] ELSE list_filter([CASE WHEN class_name <> '' AND class_name <> expected THEN 'class_differs' END, CASE WHEN quality NOT IN {SCOREABLE + OTHER} THEN 'invalid_quality' END, CASE WHEN quality IN {SCOREABLE + OTHER} AND state = 'invalid' THEN 'invalid_count' END,
 CASE WHEN quality IN {SCOREABLE} AND state <> 'score' THEN 'scoreable_must_count' END, CASE WHEN quality = 'reject' AND state = 'score' THEN 'reject_counts' END], lambda x: x IS NOT NULL) END AS errors, seen = 1 AND class_id IS NOT NULL AND quality IN {SCOREABLE + OTHER} AS judged FROM st)"""


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Quality rows with the draft label that they name, their errors, and whether they are judged."""
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    names = a.classes(spark).select(F.col("class_id").alias("k"), F.col("class_name").alias("name"))
    quality = F.when(F.col("l_tax") == 0.08, "blurry").when(F.col("l_discount") == 0.1, "needs_review").when(F.col("l_returnflag") == "A", "clear").when(F.col("l_returnflag") == "N", "partial_clear").otherwise("reject")
    rest = F.col("l_quantity") % 4
    says = F.when(F.col("l_linestatus") == "O", " Yes ").when(rest == 0, "review").when(rest == 1, "drop").when(rest == 2, "maybe").otherwise("score")
    rows = a.table(spark, d, "lineitem").withColumn("k", F.col("l_suppkey") % 13).join(names, "k").select(
        F.col("l_orderkey").alias("image"), (F.col("l_linenumber") - 1).cast("long").alias("label_index"), F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(F.col("name")).alias("class_name"), quality.alias("quality"),
        says.alias("says"), F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy(*order)).alias("seen"),
    )
    drafts = a.gt_boxes(spark, d).select("image", "label_index", "class_id").join(a.classes(spark).select("class_id", F.col("class_name").alias("expected")), "class_id")
    plain = F.lower(F.trim("says"))
    state = F.when(plain.isin(*YES), "score").when(plain.isin(*REVIEW), "review").when(plain.isin(*NO), "drop").otherwise("invalid")
    r = rows.join(drafts, ["image", "label_index"], "left").withColumn("state", state)
    known, scoreable = F.col("quality").isin(*SCOREABLE, *OTHER), F.col("quality").isin(*SCOREABLE)
    found = [("class_differs", (F.col("class_name") != "") & (F.col("class_name") != F.col("expected"))), ("invalid_quality", ~known), ("invalid_count", known & (F.col("state") == "invalid")), ("scoreable_must_count", scoreable & (F.col("state") != "score")), ("reject_counts", (F.col("quality") == "reject") & (F.col("state") == "score"))]
    errors = F.when(F.col("seen") > 1, F.array(F.lit("duplicate"))).when(F.col("class_id").isNull(), F.array(F.lit("index_outside"))).otherwise(F.array_compact(F.array(*[F.when(t, n) for n, t in found])))
    return r.withColumns({"errors": errors, "judged": (F.col("seen") == 1) & F.col("class_id").isNotNull() & known})


@query("e20_draft_checks", f"{_REVIEWED}, m AS (SELECT image, label_index FROM gt ANTI JOIN (SELECT image, idx AS label_index FROM q) k USING (image, label_index)) SELECT error, count(*) AS rows FROM (SELECT unnest(errors) AS error FROM ev UNION ALL SELECT 'missing_row' FROM m) GROUP BY 1")
def e20_draft_checks(spark: SparkSession, d: str) -> DataFrame:
    """Errors of quality rows against the drafts: repeated rows, indexes outside, other classes, bad values, contradictions; and drafts without a row."""
    r = _reviewed(spark, d)
    missing = a.gt_boxes(spark, d).select("image", "label_index").join(r.select("image", "label_index"), ["image", "label_index"], "left_anti").select(F.lit("missing_row").alias("error"))
    return r.select(F.explode("errors").alias("error")).unionByName(missing).groupBy("error").agg(F.count("*").alias("rows"))


@query(
    "e20_draft_status",
    f"""{_REVIEWED}, r AS (SELECT image, count(DISTINCT idx) FILTER (class_id IS NOT NULL) AS seen_rows, bool_or(judged AND (quality = 'needs_review' OR state = 'review')) AS undecided, count(*) FILTER (judged AND quality IN {SCOREABLE} AND state = 'score') AS scoreable FROM ev GROUP BY 1),
 k AS (SELECT source_group AS role, coalesce(drafts, 0) AS drafts, coalesce(scoreable, 0) AS scoreable, coalesce(undecided, false) OR coalesce(seen_rows, 0) < coalesce(drafts, 0) AS open FROM images LEFT JOIN dl USING (image) LEFT JOIN r USING (image))
 SELECT role, CASE WHEN drafts > 0 AND NOT open THEN CASE WHEN scoreable > 0 THEN 'ready_scoreable' ELSE 'decided_rejected_only' END WHEN open THEN 'needs_review' ELSE 'invalid_or_empty' END AS status, count(*) AS images, sum(drafts)::BIGINT AS draft_boxes, sum(scoreable)::BIGINT AS scoreable_boxes FROM k GROUP BY ALL""",
)
def e20_draft_status(spark: SparkSession, d: str) -> DataFrame:
    """How far each image's drafts are reviewed, by role: an image is decided if every draft has a row and none is left to review."""
    judged = lambda t: F.col("judged") & t
    r = _reviewed(spark, d).groupBy("image").agg(
        F.count_if((F.col("seen") == 1) & F.col("class_id").isNotNull()).alias("seen_rows"), F.bool_or(judged((F.col("quality") == "needs_review") | (F.col("state") == "review"))).alias("undecided"),
        F.count_if(judged(F.col("quality").isin(*SCOREABLE) & (F.col("state") == "score"))).alias("scoreable"),
    )
    drafts = a.gt_boxes(spark, d).groupBy("image").agg(F.count("*").alias("drafts"))
    k = a.images(spark, d).join(drafts, "image", "left").join(r, "image", "left").fillna(0, ["drafts", "seen_rows", "scoreable"]).fillna(False, ["undecided"])
    is_open = F.col("undecided") | (F.col("seen_rows") < F.col("drafts"))
    status = F.when((F.col("drafts") > 0) & ~is_open, F.when(F.col("scoreable") > 0, "ready_scoreable").otherwise("decided_rejected_only")).when(is_open, "needs_review").otherwise("invalid_or_empty")
    return k.groupBy(F.col("source_group").alias("role"), status.alias("status")).agg(F.count("*").alias("images"), F.sum("drafts").alias("draft_boxes"), F.sum("scoreable").alias("scoreable_boxes"))
