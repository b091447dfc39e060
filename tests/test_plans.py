"""What plans of queries over boxes must not do twice, and the operators that they share against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from boxquarry.operators import matching
from test_matching import GT, PRED, boxes, iou

SMALL = entry.SMALL


def plan(spark, name):
    adaptive, broadcast = (spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def joins(lines):
    return [x for x in lines if "Join [" in x]


def test_labels_and_predictions_share_one_shuffle(spark):
    lines = plan(spark, "d3_iou")
    assert len([x for x in lines if "Exchange hashpartitioning" in x and "ReusedExchange" not in x]) == 1
    assert "CASE" not in joins(lines)[0]  # an IoU written out in the condition makes a method that is never compiled


@pytest.mark.parametrize("name", ["r15_polygon_stats", "a10_segments_to_boxes", "r16_segment_repair"])
def test_outlines_are_written_and_read_once(spark, name):
    assert sum(x.count("concat_ws( , cast(class_id") for x in plan(spark, name) if "Generate" not in x) == 0


def test_sweep_sorts_pairs_once(spark):
    assert not [x for x in plan(spark, "l1_gate_sweep") if "Generate" in x and "array_sort" in x]


@pytest.mark.parametrize("name", ["e3_label_assignment", "g7_confusion_pairs", "d20_fp_kinds", "d21_proposal_labels"])
def test_one_join(spark, name):
    assert len(joins(plan(spark, name))) == 1


def test_best_per_prediction(spark):
    preds, labels = boxes(5)
    got = matching.best_per_prediction(spark.createDataFrame(preds, PRED), spark.createDataFrame(labels, GT), more=["confidence"]).collect()
    assert len(got) == len(preds)
    by_key = {(r.image, r.pred_index): r for r in got}
    for p in preds:
        own = [q for q in labels if q[0] == p[0]]
        r, same = by_key[p[0], p[1]], [iou(p[4:], q[3:]) for q in own if q[2] == p[2]]
        assert r.near == (max(iou(p[4:], q[3:]) for q in own) if own else None)
        assert r.same == (max(same) if same else None) and r.confidence == p[3]


@pytest.mark.parametrize("by_class", [True, False])
def test_label_matches(spark, by_class):
    preds, labels = boxes(6)
    p, q = spark.createDataFrame(preds, PRED), spark.createDataFrame(labels, GT)
    want = {(r.image, r.label_index): r.pred_index for r in matching.match_predictions(p, q, 0.3, by_class).collect()}
    got = matching.label_matches(p, q, 0.3, by_class).collect()
    classes = {(r[0], r[1]): r[2] for r in preds}
    assert len(got) == len(labels)
    for r in got:
        assert r.pred_index == want.get((r.image, r.label_index)) and r.pred_class == classes.get((r.image, r.pred_index))


@pytest.mark.parametrize("name", ["r31_hard_negative_swap", "i12_equal_domains"])
def test_tasks_sort_no_more_lines_of_a_larger_table(spark, monkeypatch, name):
    """Lines are dealt by their number, still once for labels and predictions, with the same rows in the end."""
    from boxquarry.plans import adapters

    want = sorted(map(tuple, entry.queries()[name](spark, SMALL).collect()))
    monkeypatch.setattr(adapters, "TASK_LINES", 500)
    for made in (adapters.gt_boxes(spark, SMALL), adapters.pred_boxes(spark, SMALL)):
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 10 and max(sizes) < 1000
    assert len([x for x in plan(spark, "d3_iou") if "Exchange hashpartitioning" in x and "ReusedExchange" not in x]) == 1
    assert sorted(map(tuple, entry.queries()[name](spark, SMALL).collect())) == want


def test_equal_domains_stay_in_the_tasks_of_their_lines(spark, monkeypatch):
    """Nothing after the lines is dealt to Spark's own number of tasks but counts and the first rows of each task."""
    from boxquarry.plans import adapters

    monkeypatch.setattr(adapters, "TASK_LINES", 500)
    lines = [x.lstrip(" :+-") for x in plan(spark, "i12_equal_domains")]
    dealt = [(re.search(r"hashpartitioning\((.*), (\d+)\)", x), below) for x, below in zip(lines, lines[1:]) if x.startswith("Exchange")]
    keys = {re.sub(r"#\d+L?", "", m[1]): (int(m[2]), below) for m, below in dealt}
    assert {k for k, (n, _) in keys.items() if n >= 10} == {"l_orderkey", "image"}
    assert {k for k, (n, _) in keys.items() if n < 10} == {"class_id", "class_id, source_family"}
    assert keys["class_id, source_family"][1].startswith("WindowGroupLimit") and keys["class_id, source_family"][1].endswith("Partial")
