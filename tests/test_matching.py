"""Folds against plain Python, and the traps of ties, equality and empty groups."""

import random

import pytest
from pyspark.sql import functions as F

from boxquarry.operators import matching, metrics

PRED = "image long, pred_index long, class_id long, confidence double, x1 long, y1 long, x2 long, y2 long"
GT = "image long, label_index long, class_id long, x1 long, y1 long, x2 long, y2 long"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def boxes(seed, images=40):
    rnd = random.Random(seed)
    preds, labels = [], []
    for image in range(images):
        for k in range(rnd.randint(0, 6)):
            x, y = rnd.randint(0, 40), rnd.randint(0, 40)
            labels.append((image, k, rnd.randint(0, 2), x, y, x + rnd.randint(5, 30), y + rnd.randint(5, 30)))
        for k in range(rnd.randint(0, 8)):
            x, y = rnd.randint(0, 40), rnd.randint(0, 40)
            preds.append((image, k, rnd.randint(0, 2), rnd.randint(0, 4) / 4, x, y, x + rnd.randint(5, 30), y + rnd.randint(5, 30)))
    return preds, labels


@pytest.mark.parametrize("by_class", [True, False])
def test_greedy_match(spark, by_class):
    preds, labels = boxes(1)
    want = set()
    for image in {p[0] for p in preds}:
        used = set()
        for p in sorted((p for p in preds if p[0] == image), key=lambda p: -p[3]):
            best, at = 0.0, None
            for q in (q for q in labels if q[0] == image and q[1] not in used and (q[2] == p[2] or not by_class)):
                if (v := iou(p[4:], q[3:])) > best:
                    best, at = v, q[1]
            if at is not None and best >= 0.3:
                used.add(at)
                want.add((image, p[1], at))
    got = matching.match_predictions(spark.createDataFrame(preds, PRED), spark.createDataFrame(labels, GT), 0.3, by_class)
    assert {(r.image, r.pred_index, r.label_index) for r in got.collect()} == want


def test_suppression(spark):
    preds, _ = boxes(2)
    want = set()
    for image in {p[0] for p in preds}:
        kept = []
        for p in sorted((p for p in preds if p[0] == image), key=lambda p: (-p[3], p[1])):
            if all(iou(p[4:], k[4:]) < 0.4 for k in kept):
                kept.append(p)
        want |= {(image, k[1]) for k in kept}
    frame = spark.createDataFrame(preds, PRED)
    order = [-F.col("confidence"), F.col("pred_index")]
    kept = matching.suppress(frame, 0.4, order)
    assert {(r.image, r.pred_index) for r in kept.collect()} == want
    assert kept.columns == frame.columns
    assert matching.suppress(kept, 0.4, order).count() == len(want)


def test_equality_suppresses_and_zero_overlap_never_matches(spark):
    p = spark.createDataFrame([(1, 0, 0, 0.9, 0, 0, 10, 10), (1, 1, 0, 0.8, 0, 0, 10, 20), (2, 0, 0, 0.5, 0, 0, 10, 10)], PRED)
    assert {(r.image, r.pred_index) for r in matching.suppress(p, 0.5, [-F.col("confidence")]).collect()} == {(1, 0), (2, 0)}
    q = spark.createDataFrame([(2, 0, 0, 50, 50, 60, 60)], GT)
    assert matching.match_predictions(p, q, 0.0).count() == 0


def test_chained_suppression(spark):
    p = spark.createDataFrame([(1, 0, 0, 0.9, 0, 0, 10, 10), (1, 1, 0, 0.8, 4, 0, 14, 10), (1, 2, 0, 0.7, 8, 0, 18, 10)], PRED)
    assert {r.pred_index for r in matching.suppress(p, 0.4, [-F.col("confidence")]).collect()} == {0, 2}


def test_outcomes_add_up(spark):
    preds, labels = boxes(3)
    out = metrics.tally(metrics.outcomes(spark.createDataFrame(preds, PRED), spark.createDataFrame(labels, GT)), ["class_id"]).collect()
    assert sum(r.gt for r in out) == len(labels) and sum(r.tp + r.fp for r in out) == len(preds)
    assert all(r.tp + r.fn == r.gt for r in out)


def test_ratios_of_nothing(spark):
    none = spark.createDataFrame([], PRED)
    only = metrics.tally(metrics.outcomes(none, spark.createDataFrame([(1, 0, 4, 0, 0, 5, 5)], GT)), ["class_id"]).first()
    assert only.recall == 0.0 and only.precision is None
    extra = metrics.tally(metrics.outcomes(spark.createDataFrame([(1, 0, 4, 0.5, 0, 0, 5, 5)], PRED), spark.createDataFrame([], GT)), ["class_id"], empty=1.0).first()
    assert extra.recall == 1.0 and extra.precision == 0.0


def test_values_that_cancel_are_exact(spark):
    images = spark.createDataFrame([(1,), (2,)], "image long")
    classes = spark.createDataFrame([(0, "a", "USD", 5.0), (1, "b", "USD", 10.0)], "class_id long, class_name string, currency string, face_value double")
    labels = spark.createDataFrame([(1, 0, 1, 0, 0, 5, 5)], GT)
    preds = spark.createDataFrame([(1, 0, 0, 0.5, 0, 0, 5, 5), (1, 1, 0, 0.5, 9, 9, 15, 15)], PRED)
    got = {r.image: r for r in metrics.per_image_values(images, preds, labels, classes).collect()}
    assert got[1].exact_value and not got[1].exact_count and got[1].count_error == 1
    assert got[2].exact_value and got[2].exact_count


def test_rounding_against_sql(spark):
    """Ratios whose tenth decimal is a last 5, which Spark's own round takes up where a product of doubles falls short."""
    import duckdb

    from boxquarry.functions.geometry import rounded

    rows = [(k, n, (-1) ** k * k / n) for n in (5120, 10240, 25600, 7) for k in range(1, n, 3)] + [(0, 1, 0.0), (1, 1, 1.0)]
    got = [r["v"] for r in spark.createDataFrame(rows, "k long, n long, x double").select(rounded(F.col("x"), 9).alias("v")).collect()]
    db = duckdb.connect()
    want = [db.execute("SELECT list_transform(?::DOUBLE[], lambda v: round(v, 9))", [[x for _, _, x in rows]]).fetchall()[0][0]][0]
    assert got == want
    assert spark.range(1).select(rounded(F.lit(None).cast("double"), 9).alias("v")).collect()[0]["v"] is None
