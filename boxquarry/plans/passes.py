"""Selections that a sequential pass defines: covers, caps on several keys at a time, and packets of buckets.

The SQL states the pass itself, as a fold over the rows in their order; the plans get the same rows from ranks, or from bounded heads of
sorted rows (``operators.greedy``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquarry.functions import geometry as g
from boxquarry.operators import selection as sel
from boxquarry.operators.greedy import CappedPass, greedy_cover
from boxquarry.plans import adapters as a
from boxquarry.plans.adapters import sql_intersection, sql_iou, with_ctes
from boxquarry.plans.queues import _ROLL, _roll
from boxquarry.plans.registry import query
from boxquarry.sources.scratch import cut

_BASE = with_ctes("classes", "images", "gt", "preds")

#: Images with their sorted classes, none where they have no labels.
_KINDS = f"""{_BASE}, kinds AS (SELECT i.*, coalesce(c, []) AS classes FROM images i LEFT JOIN (SELECT image, list_sort(list(DISTINCT class_id)) AS c FROM gt GROUP BY 1) USING (image))"""


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    c = a.gt_boxes(spark, d).groupBy("image").agg(F.sort_array(F.collect_set("class_id")).alias("c"))
    return a.images(spark, d).join(c, "image", "left").withColumn("classes", F.coalesce("c", F.array().cast("array<bigint>"))).drop("c")


def _hash(seed: str) -> Column:
    return sel.hash_order(seed, "image")


def _prefixed(kind: str, values: Column) -> Column:
    return F.transform(values, lambda c: F.concat(F.lit(f"{kind}:"), c.cast("string")))


def _fold(elements: str, takes: str) -> str:
    """SQL of a pass over ``elements`` (pos, bucket, item, once, keys, counted), of which ``takes`` says when e is taken after a.

    a.have has the keys counted so far, a.n the number taken since the last element without an item, which forgets the keys.
    """
    e = lambda **x: "{" + ", ".join(f"'{k}': {x.get(k, v)}" for k, v in (("bucket", "e.bucket"), ("item", "e.item"), ("once", "e.once"), ("keys", "e.keys"), ("counted", "e.counted"), ("have", "a.have"), ("n", "a.n"), ("seen", "a.seen"), ("taken", "a.taken"))) + "}"
    empty = {"have": "[]::VARCHAR[]", "n": "0::BIGINT", "seen": "[]::BIGINT[]", "taken": "[]::STRUCT(bucket VARCHAR, item BIGINT)[]"}
    row = e(**{k: k for k in ("bucket", "item", "once", "keys", "counted")}, **empty)
    start = e(bucket="''", item="NULL::BIGINT", once="NULL::BIGINT", keys="[]::VARCHAR[]", counted="[]::VARCHAR[]", **empty)
    take = e(have="list_concat(a.have, e.counted)", n="a.n + 1", seen="list_append(a.seen, e.once)", taken="list_append(a.taken, {'bucket': e.bucket, 'item': e.item})")
    reset = e(have="[]::VARCHAR[]", n="0::BIGINT")
    return f"""f AS (SELECT list_reduce(list({row} ORDER BY pos), lambda a, e: CASE WHEN e.item IS NULL THEN {reset} WHEN NOT list_contains(a.seen, e.once) AND {takes} THEN {take} ELSE a END, {start}).taken AS t FROM ({elements}))
SELECT k AS step, t[k].bucket AS bucket, t[k].item AS image FROM (SELECT t, unnest(range(1, len(t) + 1)) AS k FROM f)"""


def _count(key: str) -> str:
    return f"len(list_filter(a.have, lambda y: y = {key}))"


# ---- covers ----


def _cover_sql(counts: str, target: int, seed: str) -> str:
    """The greedy loop, a step a round: every row left is scored against what is lacking."""
    return f"""{_BASE}, cnt AS ({counts}), ks AS (SELECT list(DISTINCT key ORDER BY key) AS ks FROM cnt),
vec AS (SELECT image, sha256('{seed}:' || image) AS h, map_from_entries(list((key, n))) AS m FROM cnt GROUP BY 1), dense AS (SELECT image, h, list_transform(ks, lambda k: coalesce(m[k], 0)) AS v FROM vec, ks),
r AS (SELECT 0::BIGINT AS step, NULL::BIGINT AS image, 0::HUGEINT AS gain, list_transform(ks, lambda k: {target}::BIGINT) AS lack, []::BIGINT[] AS taken FROM ks
 UNION ALL SELECT step, image, gain, list_transform(list_zip(lack, v), lambda x: greatest(x[1] - x[2], 0)), list_append(taken, image) FROM (
  SELECT r.step + 1 AS step, d.image, d.h, d.v, r.lack, r.taken, list_sum(list_transform(list_zip(r.lack, d.v), lambda x: least(x[1], x[2]) * ({target} + x[1]))) AS gain FROM r, dense d WHERE NOT list_contains(r.taken, d.image)) WHERE gain > 0 QUALIFY row_number() OVER (ORDER BY gain DESC, h) = 1)
SELECT step, image, gain::BIGINT AS gain FROM r WHERE step > 0""".replace("WITH ", "WITH RECURSIVE ", 1)


@query("i34_greedy_cover", _cover_sql("SELECT image, class_id::VARCHAR AS key, count(*) AS n FROM gt GROUP BY ALL", 25, "i34"))
def i34_greedy_cover(spark: SparkSession, d: str) -> DataFrame:
    """Images that bring each class 25 boxes, always the one that brings most of what is lacking most."""
    counts = a.gt_boxes(spark, d).groupBy("image", F.col("class_id").cast("string").alias("key")).agg(F.count("*").alias("n"))
    return greedy_cover(counts, "image", "key", 25, seed="i34")


@query("r20_greedy_group_cover", _cover_sql("SELECT image, source_group || '|' || class_id AS key, count(*) AS n FROM gt JOIN images USING (image) GROUP BY ALL", 4, "r20"))
def r20_greedy_group_cover(spark: SparkSession, d: str) -> DataFrame:
    """The same with four boxes for each class in each source."""
    b = a.gt_boxes(spark, d).join(a.images(spark, d).select("image", "source_group"), "image")
    key = F.concat_ws("|", "source_group", F.col("class_id").cast("string"))
    return greedy_cover(b.groupBy("image", key.alias("key")).agg(F.count("*").alias("n")), "image", "key", 4, seed="r20")


# ---- balanced subsets ----


@query(
    "i1_balanced_subset",
    f"{_KINDS}, "
    + _fold(
        """SELECT row_number() OVER (ORDER BY sha256('i1:' || image), image) AS pos, CASE WHEN source_group = '1-URGENT' THEN 'always' WHEN source_group LIKE '5%' THEN 'excluded' WHEN len(classes) = 0 THEN 'background' ELSE 'class' END AS bucket,
 image AS item, image AS once, []::VARCHAR[] AS keys, CASE WHEN len(classes) = 0 THEN ['background'] ELSE list_transform(classes, lambda c: CASE WHEN source_group = '1-URGENT' THEN 'always:' ELSE 'class:' END || c) END AS counted FROM kinds""",
        f"""CASE e.bucket WHEN 'always' THEN e.counted = ['background'] OR len(list_filter(e.counted, lambda x: {_count('x')} >= 20)) = 0 WHEN 'background' THEN len(list_filter(a.taken, lambda y: y.bucket = 'background')) < 25
 WHEN 'class' THEN len(list_filter(e.counted, lambda x: {_count('x')} < 30)) > 0 ELSE FALSE END""",
    ).replace("SELECT k AS step, t[k].bucket AS bucket, t[k].item AS image", "SELECT t[k].bucket AS why, t[k].item AS image"),
)
def i1_balanced_subset(spark: SparkSession, d: str) -> DataFrame:
    """In hash order: images of one group unless one of their classes has 20 such; others while one of their classes has under 30; 25 without labels.

    While a class has room every image with it is taken, so an image is taken exactly if it is among the first 30 of one of its classes.
    """
    k = _kinds(spark, d)
    urgent, bare = F.col("source_group") == "1-URGENT", F.size("classes") == 0
    open_rows = k.where(~urgent & ~F.col("source_group").startswith("5"))
    ranked = sel.top_per_group(open_rows.select("image", F.explode("classes").alias("class_id")), ["class_id"], [_hash("i1"), F.col("image")], 30)
    backgrounds = open_rows.where(bare).orderBy(_hash("i1"), "image").limit(25)
    always = cut(k.where(urgent).select("image", "classes"), "always")
    run = CappedPass()
    run.run(always.where(~bare), "image", [_hash("i1"), F.col("image")], {"always": 20}, _prefixed("always", F.col("classes")))
    parts = [(run.result(always, "image"), "always"), (always.where(bare), "always"), (ranked.distinct(), "class"), (backgrounds, "background")]
    chosen = [rows.select(F.lit(why).alias("why"), "image") for rows, why in parts]
    return chosen[0].unionByName(chosen[1]).unionByName(chosen[2].distinct()).unionByName(chosen[3])


_LEAST = 2500


@query(
    "i2_oversample",
    f"""{_KINDS}, pool AS (SELECT c AS class_id, image, classes, row_number() OVER (PARTITION BY c ORDER BY image) - 1 AS k, count(*) OVER (PARTITION BY c) AS n FROM (SELECT image, classes, unnest(classes) AS c FROM kinds)),
r AS (SELECT 0::BIGINT AS c, list(coalesce(n, 0)::HUGEINT ORDER BY i) AS have FROM range(13) t(i) LEFT JOIN (SELECT class_id, count(*) AS n FROM pool GROUP BY 1) ON class_id = i
 UNION ALL SELECT c + 1, list(h + added ORDER BY i) FROM (SELECT r.c, i, any_value(r.have[i + 1]) AS h, sum(CASE WHEN list_contains(classes, i) THEN greatest(0, ({_LEAST} - r.have[r.c + 1] - k + n - 1) // n) ELSE 0 END) AS added
  FROM r CROSS JOIN range(13) t(i) LEFT JOIN pool ON pool.class_id = r.c WHERE r.c < 13 GROUP BY r.c, i) GROUP BY c)
SELECT image, (1 + coalesce(sum(greatest(0, ({_LEAST} - r.have[r.c + 1] - k + n - 1) // n)), 0))::BIGINT AS exposures FROM images LEFT JOIN pool USING (image) LEFT JOIN r ON r.c = pool.class_id GROUP BY 1""".replace("WITH ", "WITH RECURSIVE ", 1),
)
def i2_oversample(spark: SparkSession, d: str) -> DataFrame:
    """Class by class, images with it are added in turn until 2,500 have it; each added image counts for all of its classes.

    An addition counts once for its own class, so how many a class needs is known at its turn, and how often each image of its pool is taken
    follows from the image's place: one aggregate of thirteen numbers a class.
    """
    images = cut(_kinds(spark, d).select("image", "classes"), "listed")
    pool = sel.number_in_groups(images.select("image", "classes", F.explode("classes").alias("class_id")), ["class_id"], [F.col("image")], "k", "n")
    pool = cut(pool, "pool")
    have = {r["class_id"]: r["n"] for r in pool.groupBy("class_id").agg(F.max("n").alias("n")).collect()}
    missing: dict[int, int] = {}
    times = lambda lack: F.greatest(F.lit(0), F.floor((lack - F.col("k") + F.col("n") - 1) / F.col("n"))).cast("long")
    for c in range(len(a.CLASSES)):
        missing[c] = max(0, _LEAST - have.get(c, 0))
        if missing[c] and have.get(c):
            added = pool.where(F.col("class_id") == c).select(F.explode("classes").alias("c"), times(F.lit(missing[c])).alias("t")).groupBy("c").agg(F.sum("t").alias("t"))
            for r in added.collect():
                have[r["c"]] = have.get(r["c"], 0) + r["t"]
    lack = F.create_map(*[F.lit(x).cast("long") for pair in missing.items() for x in pair])[F.col("class_id")]
    more = pool.groupBy("image").agg(F.sum(times(lack)).alias("more"))
    return images.join(more, "image", "left").select("image", (1 + F.coalesce("more", F.lit(0))).alias("exposures"))


@query(
    "i3_class_and_empty_cap",
    f"{_KINDS}, "
    + _fold(
        "SELECT row_number() OVER (ORDER BY sha256('i3:' || image), image) AS pos, CASE WHEN len(classes) = 0 THEN 'empty' ELSE 'labelled' END AS bucket, image AS item, image AS once, []::VARCHAR[] AS keys, CASE WHEN len(classes) = 0 THEN ['empty'] ELSE list_transform(classes, lambda c: c::VARCHAR) END AS counted FROM kinds",
        f"CASE e.bucket WHEN 'empty' THEN {_count(chr(39) + 'empty' + chr(39))} < 12 ELSE len(list_filter(e.counted, lambda x: {_count('x')} >= 18)) = 0 END",
    ).replace("SELECT k AS step, t[k].bucket", "SELECT t[k].bucket"),
)
def i3_class_and_empty_cap(spark: SparkSession, d: str) -> DataFrame:
    """In hash order, an image unless one of its classes has 18 already, and twelve without labels."""
    k = cut(_kinds(spark, d).select("image", "classes"), "listed")
    run = CappedPass()
    order = [_hash("i3"), F.col("image")]
    run.run(k.where(F.size("classes") > 0), "image", order, {"class": 18}, _prefixed("class", F.col("classes")), bucket="labelled")
    run.run(k.where(F.size("classes") == 0), "image", order, {}, F.array().cast("array<string>"), bucket="empty", most=12)
    return run.result(k, "image").select("bucket", "image")


@query(
    "i9_rare_first_with_source_cap",
    f"""{_KINDS}, pool AS (SELECT image, classes, source_group, c, sha256('i9-' || c || ':' || image) AS h, count(*) OVER (PARTITION BY c) AS size FROM (SELECT *, unnest(classes) AS c FROM kinds)), """
    + _fold(
        "SELECT row_number() OVER (ORDER BY p, size, c, h, image) AS pos, CASE p WHEN 1 THEN 'capped' ELSE 'override' END AS bucket, image AS item, image AS once, [source_group, c::VARCHAR] AS keys, list_prepend(source_group, list_transform(classes, lambda x: x::VARCHAR)) AS counted FROM pool, range(1, 3) t(p)",
        f"{_count('e.keys[2]')} < 20 AND (e.bucket = 'override' OR {_count('e.keys[1]')} < 36)",
    ),
)
def i9_rare_first_with_source_cap(spark: SparkSession, d: str) -> DataFrame:
    """Classes with fewer images first: images in hash order until twenty have the class, at most 36 of a source over all; then without the source's cap."""
    k = cut(_kinds(spark, d).where(F.size("classes") > 0).select("image", "classes", "source_group"), "listed")
    sizes = k.select(F.explode("classes").alias("c")).groupBy("c").agg(F.count("*").alias("n")).orderBy("n", "c").collect()
    source, classes = F.array(F.concat(F.lit("source:"), "source_group")), _prefixed("class", F.col("classes"))
    run = CappedPass()
    for bucket, cap in (("capped", 36), ("override", 1 << 62)):
        for c in (r["c"] for r in sizes):
            run.run(k.where(F.array_contains("classes", c)), "image", [_hash(f"i9-{c}"), F.col("image")], {"source": cap}, source, F.concat(source, classes), bucket=bucket, until=(f"class:{c}", 20), head=256)
    return run.result(k, "image")


@query(
    "i11_balanced_eval_subset",
    f"{_KINDS}, "
    + _fold(
        "SELECT row_number() OVER (ORDER BY sha256('i11:' || image), image) AS pos, CASE WHEN len(classes) = 0 THEN 'background' ELSE 'class' END AS bucket, image AS item, image AS once, []::VARCHAR[] AS keys, list_transform(classes, lambda c: c::VARCHAR) AS counted FROM kinds WHERE split = 'train'",
        f"CASE e.bucket WHEN 'background' THEN len(list_filter(a.taken, lambda y: y.bucket = 'background')) < 10 ELSE len(list_filter(e.counted, lambda x: {_count('x')} < 16)) > 0 END",
    ).replace("SELECT k AS step, t[k].bucket", "SELECT t[k].bucket"),
)
def i11_balanced_eval_subset(spark: SparkSession, d: str) -> DataFrame:
    """In hash order, images while one of their classes has under 16, and ten without labels; an error names the classes that stay under."""
    k = cut(_kinds(spark, d).where("split = 'train'").select("image", "classes"), "listed")
    names = sorted(r[0] for r in a.gt_boxes(spark, d).select("class_id").distinct().collect())
    return balanced_eval(k, names, 16, 10, "i11")


def balanced_eval(k: DataFrame, names: list[int], per_class: int, backgrounds: int, seed: str) -> DataFrame:
    """(bucket, image) of ``k`` (image, classes); reading it raises where one of the classes ``names`` has fewer than ``per_class`` images."""
    ranked = sel.top_per_group(k.select("image", F.explode("classes").alias("class_id")), ["class_id"], [_hash(seed), F.col("image")], per_class)
    counts = ranked.groupBy("class_id").agg(F.count("*").alias("n"))
    every = k.sparkSession.createDataFrame([(c,) for c in names], "class_id long")
    short = every.join(F.broadcast(counts), "class_id", "left").where(F.coalesce("n", F.lit(0)) < per_class).agg(F.array_join(F.array_sort(F.collect_list("class_id")), ", ").alias("names"))
    # thirteen rows at most: the error comes when the subset is read
    enough = short.select(F.assert_true(F.col("names") == "", F.concat(F.lit("subset underfilled class ids: "), "names")).alias("_ok"))
    bare = k.where(F.size("classes") == 0).orderBy(_hash(seed), "image").limit(backgrounds)
    chosen = ranked.select("image").distinct().select(F.lit("class").alias("bucket"), "image").unionByName(bare.select(F.lit("background").alias("bucket"), "image"))
    return chosen.crossJoin(F.broadcast(enough)).where("_ok is null").drop("_ok")


# ---- packets ----

_BUCKETS = [("large_error", "error >= 3", 12), ("missed_all", "labels > 0 AND preds = 0", 10), ("crowded", "labels >= 4", 14), ("mixed", "kinds >= 3", 10), ("unsure", "surest < 0.4", 10), ("remaining", "error > 0", 64)]
_PACKET = 64


@query(
    "h6_bucketed_packet",
    f"{_ROLL}, b(no, bucket, cap) AS (VALUES "
    + ", ".join(f"({k}, '{n}', {c})" for k, (n, _, c) in enumerate(_BUCKETS))
    + "), "
    + _fold(
        "SELECT row_number() OVER (ORDER BY no, item IS NOT NULL, error DESC, item) AS pos, bucket, item, item AS once, [s] AS keys, [s] AS counted FROM (SELECT no, bucket, image AS item, source_group AS s, error FROM roll, b WHERE CASE no "
        + " ".join(f"WHEN {k} THEN {c}" for k, (_, c, _) in enumerate(_BUCKETS))
        + " END UNION ALL SELECT no, bucket, NULL, '', 0 FROM b)",
        "len(a.taken) < " + str(_PACKET) + " AND a.n < CASE e.bucket " + " ".join(f"WHEN '{n}' THEN {c}" for n, _, c in _BUCKETS) + f" END AND {_count('e.keys[1]')} < CASE e.bucket " + " ".join(f"WHEN '{n}' THEN {max(3, (c + 1) // 2)}" for n, _, c in _BUCKETS) + " END",
    ),
)
def h6_bucketed_packet(spark: SparkSession, d: str) -> DataFrame:
    """Bucket after bucket over rows that no earlier one took, by error: a cap on each bucket, on each source in it (half of that), and on all."""
    rows = cut(_roll(spark, d).select("image", "source_group", "error", "labels", "preds", "kinds", "surest"), "rolled")
    run = CappedPass(most=_PACKET)
    source = F.array(F.concat(F.lit("source:"), "source_group"))
    for name, fits, cap in _BUCKETS:
        run.run(rows.where(fits), "image", [-F.col("error"), F.col("image")], {"source": max(3, (cap + 1) // 2)}, source, bucket=name, most=cap, fresh=True, head=256)
    return run.result(rows, "image")


@query(
    "h7_class_ordered_queue",
    f"{_ROLL}, q AS (SELECT image, source_group, error, first_class, CASE WHEN first_class IN (3, 7, 11) THEN 0 ELSE 1 END AS late FROM roll WHERE error > 0 AND first_class IS NOT NULL), "
    + _fold(
        "SELECT row_number() OVER (ORDER BY fill, late, c, image IS NOT NULL, error DESC, image) AS pos, bucket, image AS item, image AS once, [source_group] AS keys, [source_group, bucket] AS counted FROM (SELECT 0 AS fill, late, first_class AS c, first_class::VARCHAR AS bucket, image, source_group, error FROM q UNION ALL SELECT 1, 0, 0, 'remainder', image, source_group, error FROM q)",
        f"len(a.taken) < 90 AND {_count('e.keys[1]')} < 21 AND (e.bucket = 'remainder' OR {_count('e.bucket')} < 5)",
    ),
)
def h7_class_ordered_queue(spark: SparkSession, d: str) -> DataFrame:
    """Five of each class by error, weak classes first, then what is left by error; 21 of a source over all, 90 in all."""
    rows = cut(_roll(spark, d).where("error > 0 and first_class is not null").select("image", "source_group", "error", "first_class"), "rolled")
    run = CappedPass(most=90)
    source, order = F.array(F.concat(F.lit("source:"), "source_group")), [-F.col("error"), F.col("image")]
    found = {r["first_class"] for r in rows.select("first_class").distinct().collect()}
    for c in sorted(found, key=lambda c: (c not in (3, 7, 11), c)):
        run.run(rows.where(F.col("first_class") == c), "image", order, {"source": 21}, source, bucket=str(c), most=5, head=64)
    run.run(rows, "image", order, {"source": 21}, source, bucket="remainder")
    return run.result(rows, "image")


#: Buckets of the visible-evidence packet: name, cap, rows, cap of a source, cap of a class.
_EVIDENCE = [
    ("heldout_overlap_counting_eval_review", 24, "split <> 'train' AND source_group NOT LIKE '5%' AND (bbox_overlap OR tight_pair OR multi_note)", 8, 8),
    ("heldout_protected_khr_partial_eval_review", 16, "split <> 'train' AND source_group NOT LIKE '5%' AND protected_riel AND partial_edge", 10, 12),
    ("heldout_partial_visible_eval_review", 20, "split <> 'train' AND source_group NOT LIKE '5%' AND partial_edge", 10, 7),
    ("train_overlap_anchor_review", 24, "split = 'train' AND source_group NOT LIKE '5%' AND (bbox_overlap OR tight_pair OR multi_note)", 8, 8),
    ("train_partial_visible_anchor_review", 20, "split = 'train' AND source_group NOT LIKE '5%' AND partial_edge", 8, 6),
    ("source_policy_review", 20, "source_group LIKE '5%' AND (bbox_overlap OR tight_pair OR multi_note OR protected_riel OR partial_edge)", 10, 10),
]


def _by_evidence(at: int) -> str:
    return "CASE e.bucket " + " ".join(f"WHEN '{b[0]}' THEN {b[at]}" for b in _EVIDENCE) + " END"


_EVIDENCE_SQL = f"""{_BASE}, pr AS (SELECT x.image, max({sql_iou('x', 'y')}) AS iou, round(max({sql_intersection('x', 'y')} / least((x.x2 - x.x1) * (x.y2 - x.y1), (y.x2 - y.x1) * (y.y2 - y.y1))::DOUBLE), 9) AS small,
 round(min(sqrt(pow(greatest(x.x1 - y.x2, y.x1 - x.x2, 0), 2) + pow(greatest(x.y1 - y.y2, y.y1 - x.y2, 0), 2))), 6) AS gap FROM gt x JOIN gt y ON x.image = y.image AND x.label_index < y.label_index GROUP BY 1),
bx AS (SELECT image, count(*) AS boxes, list_sort(list(DISTINCT class_id)) AS classes, bool_or(class_id IN (11, 12)) AS protected_riel, bool_or(x1 <= 2 OR y1 <= 2 OR x2 >= width - 2 OR y2 >= height - 2) AS partial_edge FROM gt JOIN images USING (image) GROUP BY 1),
ev AS (SELECT i.image, i.split, i.source_group, i.image // 3 AS canonical, boxes, classes, protected_riel, partial_edge, coalesce(iou >= 0.02, FALSE) AS bbox_overlap, coalesce(gap <= 12, FALSE) AS tight_pair, boxes >= 2 AS multi_note, coalesce(small, 0) AS small, coalesce(gap, 999) AS gap,
 boxes * 2 + CASE WHEN protected_riel THEN 5 ELSE 0 END + CASE WHEN partial_edge THEN 3 ELSE 0 END AS priority FROM images i JOIN bx USING (image) LEFT JOIN pr USING (image))"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Images with labels, and what makes them worth a look: crowding, edges, protected classes."""
    labels = a.gt_boxes(spark, d).join(a.images(spark, d), "image")
    boxes = labels.groupBy("image", "split", "source_group").agg(
        F.array_sort(F.collect_list(F.struct("label_index", "x1", "y1", "x2", "y2"))).alias("b"),
        F.count("*").alias("boxes"),
        F.sort_array(F.collect_set("class_id")).alias("classes"),
        F.bool_or(F.col("class_id").isin(11, 12)).alias("protected_riel"),
        F.bool_or(g.touches_edge(g.box(), F.col("width"), F.col("height"), 2)).alias("partial_edge"),
    )
    # pairs within the few boxes of one image
    pairs = F.flatten(F.transform("b", lambda x, i: F.transform(F.slice("b", i + 2, F.size("b")), lambda y: F.struct(g.iou(g.box_in(x), g.box_in(y)).alias("iou"), g.overlap_of_smaller(g.box_in(x), g.box_in(y)).alias("small"), g.gap(g.box_in(x), g.box_in(y)).alias("gap")))))
    p = boxes.withColumn("p", pairs)
    most = lambda name: F.array_max(F.transform("p", lambda x: x[name]))
    gap = F.round(F.array_min(F.transform("p", lambda x: x["gap"])), 6)
    priority = F.col("boxes") * 2 + F.when(F.col("protected_riel"), 5).otherwise(0) + F.when(F.col("partial_edge"), 3).otherwise(0)
    return p.select(
        "image", "split", "source_group", F.expr("image div 3").alias("canonical"), "boxes", "classes", "protected_riel", "partial_edge",
        F.coalesce(most("iou") >= 0.02, F.lit(False)).alias("bbox_overlap"), F.coalesce(gap <= 12, F.lit(False)).alias("tight_pair"), (F.col("boxes") >= 2).alias("multi_note"),
        F.coalesce(F.round(most("small"), 9), F.lit(0.0)).alias("small"), F.coalesce(gap, F.lit(999.0)).alias("gap"), priority.alias("priority"),
    )


@query(
    "m15_visible_evidence_packet",
    f"{_EVIDENCE_SQL}, b(no, bucket) AS (VALUES "
    + ", ".join(f"({k}, '{b[0]}')" for k, b in enumerate(_EVIDENCE))
    + "), "
    + _fold(
        "SELECT row_number() OVER (ORDER BY no, item IS NOT NULL, priority DESC, small DESC, boxes DESC, gap, item) AS pos, bucket, item, canonical AS once, keys, keys AS counted FROM (SELECT no, bucket, image AS item, canonical, list_prepend(source_group, list_transform(classes, lambda c: c::VARCHAR)) AS keys, priority, small, boxes, gap FROM ev, b WHERE CASE no "
        + " ".join(f"WHEN {k} THEN {b[2]}" for k, b in enumerate(_EVIDENCE))
        + " END UNION ALL SELECT no, bucket, NULL, NULL, [], 0, 0, 0, 0 FROM b)",
        f"a.n < {_by_evidence(1)} AND {_count('e.keys[1]')} < {_by_evidence(3)} AND len(list_filter(e.keys[2:], lambda x: {_count('x')} >= {_by_evidence(4)})) = 0",
    ),
)
def m15_visible_evidence_packet(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of images for review, most evidence first: caps on each bucket, and in it on each source and each class; no two variants of one image."""
    rows = cut(_evidence(spark, d), "evidence")
    run = CappedPass()
    keys = F.concat(F.array(F.concat(F.lit("source:"), "source_group")), _prefixed("class", F.col("classes")))
    for name, cap, fits, of_source, of_class in _EVIDENCE:
        run.run(rows.where(fits), "image", [-F.col("priority"), -F.col("small"), -F.col("boxes"), F.col("gap"), F.col("image")], {"source": of_source, "class": of_class}, keys, once="canonical", bucket=name, most=cap, fresh=True, head=256)
    return run.result(rows, "image")
