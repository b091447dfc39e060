"""Merging of reviews: keys, fields that change, and the error on keys that stand twice."""

import pytest


def test_review_merge(spark):
    from pyspark.sql import functions as F

    from boxquarry.plans.decisions import merge_reviews, review_key

    rows = [("a", "x\\1", "", "k"), (" ", "crops\\2", "", "k"), (None, " ", "y", "k"), ("b", "x/3", "y", None)]
    source = spark.createDataFrame(rows, "id string, path string, include string, kind string").select(review_key(F.col("id"), F.col("path")).alias("key"), "path", "include", "kind")
    assert [r["key"] for r in source.collect()] == ["crop_id:a", "crop_path:crops/2", None, "crop_id:b"]
    export = spark.createDataFrame([("crop_id:a", "x", "k"), ("crop_path:crops/2", None, "m"), ("crop_id:b", "y", None), (None, "z", "z")], "key string, include string, kind string")
    got = {r["path"]: (r["include"], r["kind"], r["changed"]) for r in merge_reviews(source, export, ["include", "kind"]).collect()}
    assert got == {"x\\1": ("x", "k", 1), "crops\\2": ("", "m", 1), " ": ("y", "k", 0), "x/3": ("y", "", 1)}
    with pytest.raises(Exception, match="duplicate keys: crop_id:a"):
        merge_reviews(source, export.unionByName(export.limit(1)), ["include", "kind"]).collect()


def test_global_match_and_sweep_of_few_boxes(spark):
    from boxquarry.operators import matching

    box = "class_id long, x1 long, y1 long, x2 long, y2 long"
    labels = spark.createDataFrame([(1, 0, 3, 0, 0, 10, 10), (1, 1, 4, 20, 0, 30, 10), (2, 0, 3, 0, 0, 10, 10)], f"image long, label_index long, {box}")
    preds = spark.createDataFrame(
        [(1, 0, 0.9, 4, 0, 0, 10, 10, 11, 0.5), (1, 1, 0.4, 3, 0, 0, 10, 9, 0, 0.5), (1, 2, 0.8, 3, 20, 0, 30, 10, 4, 0.9), (3, 0, 0.7, 3, 0, 0, 5, 5, 0, 0.1)],
        "image long, pred_index long, confidence double, class_id long, x1 long, y1 long, x2 long, y2 long, gate_class long, gate_conf double",
    )
    # within classes first, though the other class overlaps more
    got = sorted((r["image"], r["pred_index"], r["label_index"], r["kind"]) for r in matching.match_globally(preds, labels).collect())
    assert got == [(1, 1, 0, "matched"), (1, 2, 1, "wrong_class")]
    points = [{"least": 0.5}, {"least": 0.0}, {"least": 2.0}]
    swept = matching.sweep(preds, labels, points, lambda p, g: p["confidence"] >= g["least"]).collect()
    assert {r["least"]: (r["predictions"], r["tp"], r["gt"]) for r in swept} == {0.5: (3, 0, 3), 0.0: (4, 1, 3), 2.0: (0, 0, 3)}
    renamed = matching.sweep(preds, labels, points, lambda p, g: p["confidence"] >= g["least"], lambda p, g: p["gate_class"]).collect()
    assert {r["least"]: r["tp"] for r in renamed} == {0.5: 1, 0.0: 1, 2.0: 0}
    empty = matching.sweep(preds.limit(0), labels.limit(0), points, lambda p, g: p["confidence"] >= g["least"]).collect()
    assert [(r["predictions"], r["tp"], r["gt"]) for r in empty] == [(0, 0, 0)] * 3
