"""Staged metrics against a plain loop over images, and the gate of crops on tables where something is missing."""

import random

from pyspark.sql import functions as F

from boxquarry.operators import metrics
from boxquarry.plans import reports

BOX = "x1 long, y1 long, x2 long, y2 long"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return both / (area(a) + area(b) - both) if both else 0.0


def matched(preds, labels, same):
    """{label: prediction} of a pass over predictions by falling confidence."""
    taken = {}
    for p in sorted(preds, key=lambda p: (-p["confidence"], p["at"])):
        best, of = 0.0, None
        for x in labels:
            if x["at"] not in taken and (not same or x["class_id"] == p["class_id"]) and iou(p["box"], x["box"]) > best:
                best, of = iou(p["box"], x["box"]), x["at"]
        if of is not None and best >= 0.5:
            taken[of] = p
    return taken


def plain(preds, labels):
    hits, near = matched(preds, labels, True), matched(preds, labels, False)
    out = []
    for x in labels:
        other = near[x["at"]]["class_id"] if x["at"] in near else None
        kind = "tp" if x["at"] in hits else "no_box" if other is None else "same_class_conflict" if other == x["class_id"] else "wrong_class"
        out.append((x["at"], x["class_id"], kind, other))
    used = {p["at"] for p in hits.values()}
    return sorted(map(str, out + [(p["at"], p["class_id"], "fp", None) for p in preds if p["at"] not in used]))


def test_staged_outcomes_against_a_loop(spark):
    draw = random.Random(5)
    box = lambda: (x := draw.randrange(0, 12), y := draw.randrange(0, 12), x + draw.randrange(6, 16), y + draw.randrange(6, 16))
    preds, labels = [], []
    for image in range(120):
        labels += [(image, k, draw.randrange(2), *box()) for k in range(draw.randrange(0, 4))]
        # confidences tie often
        preds += [(image, k, draw.randrange(2), draw.randrange(4) / 4, *box()) for k in range(draw.randrange(0, 5))]
    # a prediction of another class pushes one of the right class to the second label, which the match within classes leaves
    labels += [(120, 0, 0, 0, 0, 20, 20), (120, 1, 0, 0, 6, 20, 26)]
    preds += [(120, 0, 1, 0.9, 0, 0, 20, 20), (120, 1, 0, 0.5, 0, 1, 20, 21)]
    images = spark.range(130).select(F.col("id").alias("image"))
    got = metrics.staged_outcomes(
        images,
        spark.createDataFrame(preds, f"image long, pred_index long, class_id long, confidence double, {BOX}"),
        spark.createDataFrame(labels, f"image long, label_index long, class_id long, {BOX}"),
        {"all": lambda p: F.filter(p, lambda x: F.lit(True)), "sure": lambda p: F.filter(p, lambda x: x["confidence"] >= 0.5)},
    ).collect()
    assert len(got) == 260
    for r in got:
        own = [{"at": p[1], "class_id": p[2], "confidence": p[3], "box": p[4:]} for p in preds if p[0] == r.image and (r.stage == "all" or p[3] >= 0.5)]
        all_ = [p[4:] for p in preds if p[0] == r.image]
        mine = [{"at": x[1], "class_id": x[2], "box": x[3:]} for x in labels if x[0] == r.image]
        assert sorted(str((o["at"], o["class_id"], o["kind"], o["other"])) for o in r.outcomes) == plain(own, mine), r
        for o in r.outcomes:
            if o["kind"] != "fp":
                x = next(x["box"] for x in mine if x["at"] == o["at"])
                best = max((iou(p, x) for p in all_), default=None)
                assert (o["best_reference"] is None) == (best is None) and abs((best or 0) - (o["best_reference"] or 0)) < 1e-12
    assert {o["kind"] for r in got for o in r.outcomes} == {"tp", "fp", "no_box", "wrong_class", "same_class_conflict"}


MEASURED = "image long, class_id long, source_group string, source_family string, box_area double, box_width double, box_height double, box_aspect double"


def test_crop_gate_where_something_is_missing(spark):
    classes = spark.createDataFrame([(0,), (1,)], "class_id long")
    rows = [(1, 0, "g", "real", 0.1, 0.2, 0.3, 1.0), (2, 0, "g", "synthetic", 0.5, 0.2, 0.3, 1.0), (3, 1, "g", "real", 0.1, 0.2, 0.3, 1.0)]
    gate = lambda some: {(r.scope, r.class_id, r.metric): r.failure for r in reports.crop_gate(spark.createDataFrame(some, MEASURED), classes, reports.BOX_LIMITS, reports.CLASS_LIMITS, 2).collect()}
    found = gate(rows)
    assert found["crop", None, "box_area"] == "exceeds" and found["crop", None, "box_width"] is None
    assert found["class", 0, "box_area"] == "exceeds" and found["class", 0, "box_aspect"] is None and found["class", 1, "box_area"] == "unavailable"
    assert found["family", None, "real"] is None and found["family", None, "synthetic"] == "below_minimum"
    nothing = gate([])
    assert len(nothing) == 4 + 8 + 2 and nothing["family", None, "real"] == "missing" and nothing["crop", None, "box_area"] == "unavailable"


def test_folds_are_not_run_twice(spark):
    """No inferred filter below a generator repeats the fold of an image's boxes."""
    for name in ("g5_staged_by_class", "g3_recall_by_class", "e4_global_match"):
        import __spark_entry__ as entry

        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("aggregate(") <= 2, name
