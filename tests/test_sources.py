"""Readers and writers on small files, and text, sampling and statistics functions on small tables."""

import pytest
from pyspark.sql import functions as F

from boxquarry.functions import geometry as g
from boxquarry.functions import text as tx
from boxquarry.operators import selection as sel
from boxquarry.operators import statistics as st
from boxquarry.sources import readers, writers


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("o")).first().o


def test_label_lines_and_problems(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 0.5 0.5 0.1 0.1\n\n1.0 0.5 0.5 0.1 0.1\n1 0.5 0.5 0.1\n1 0.5 x 0.1 0.1\n99 0.5 0.5 0.1 0.1\n1 0.5 1.5 0.1 0.1\n")
    lines = readers.label_files(spark, str(tmp_path / "*.txt"))
    got = {r.line_no: r.problem for r in readers.parse_labels(lines, 13).collect()}
    assert got == {0: None, 2: "class_is_no_number", 3: "wrong_number_of_fields", 4: "value_is_no_number", 5: "class_out_of_range", 6: "value_out_of_range"}
    assert readers.parse_labels(lines, 13, whole_float_class=True).where("line_no = 2 and problem is null").count() == 1
    assert readers.parse_labels(lines, 13, mode="lenient").count() == 1
    with pytest.raises(Exception, match="wrong_number_of_fields|class_is_no_number|value"):
        readers.parse_labels(lines, 13, mode="strict").collect()


def test_lists_keep_repeats(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# head\na/1.jpg\n\n b/2.jpg \na/1.jpg\n")
    got = readers.image_list(spark, str(tmp_path / "l.txt")).orderBy("ord").collect()
    assert [r.image for r in got] == ["a/1.jpg", "b/2.jpg", "a/1.jpg"]
    out = str(tmp_path / "out")
    writers.write_list(readers.image_list(spark, str(tmp_path / "l.txt")), out, unique=True)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["a/1.jpg", "b/2.jpg"]


def test_manifests_reports_and_settings(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.createDataFrame([("1", 'a "b", c\nd'), ("2", None)], "id string, note string")
    writers.write_manifest(rows, path)
    assert {(r.id, r.note) for r in readers.manifest(spark, path, ["id"]).collect()} == {("1", 'a "b", c\nd'), ("2", None)}
    with pytest.raises(ValueError, match="absent"):
        readers.manifest(spark, path, ["absent"])
    writers.append_new(spark.createDataFrame([("2", "x"), ("3", "y")], "id string, note string"), rows, ["id"], path)
    assert readers.manifest(spark, path).count() == 3
    doc = tmp_path / "p.json"
    doc.write_text('{"schema": "s1", "names": {"0": "a"}, "match_iou": 0.5, "rows": [{"image": "i", "source_group": "g", "labels": [{"class_id": 1, "xyxy": [0, 1, 2, 3]}], "predictions": []}]}')
    labels, preds = readers.proposals(spark, str(doc), "s1")
    assert labels.first().y2 == 3.0 and preds.count() == 0
    with pytest.raises(Exception, match="another schema"):
        readers.proposals(spark, str(doc), "s2")[0].collect()
    assert readers.optional(spark, lambda: spark.read.json(str(tmp_path / "none")), "a int").count() == 0
    assert readers.dataset_config("names: [a, b]\ntrain: x\nval: [y, z]")["names"] == {0: "a", 1: "b"}
    (tmp_path / "bad.json").write_text('{"a": 1}\n[1, 2]\n')
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "bad.json"), "a int").collect()
    assert writers.markdown_table(rows.select("id").orderBy("id")).splitlines()[2] == "| 1 |"


def test_label_files_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([(1, 0, "0 0.1 0.1 0.1 0.1"), (1, 1, "2 0.2 0.2 0.1 0.1"), (2, 0, "1 0.3 0.3 0.1 0.1")], "image long, line_no int, line string")
    writers.write_label_lines(lines, str(tmp_path / "o"))
    back = readers.parse_labels(readers.label_files(spark, str(tmp_path / "o/*/*.txt")), 13)
    assert sorted((r.line_no, r.class_id) for r in back.collect()) == [(0, 0), (0, 1), (1, 2)]


def test_text_functions(spark):
    assert one(spark, "images/x/images/a.jpg", tx.labels_path) == "labels/x/images/a.txt"
    assert one(spark, "images/x/images/a.jpg", lambda c: tx.labels_path(c, "last")) == "images/x/labels/a.txt"
    assert one(spark, "d/IMG_1.rf.0af9.JPG", tx.canonical_base) == "img_1"
    assert one(spark, " a;; b ;", lambda c: F.array_join(tx.split_values(c), "|")) == "a|b"
    assert one(spark, "khmer_scan_3", lambda c: tx.source_group(c, [("khmer_scan_", "khmer")])) == "khmer"
    assert one(spark, "x_khmer_scan_3", lambda c: tx.source_group(c, [("khmer_scan_", "khmer")])) == "x"
    assert one(spark, "x_khmer_scan_3", lambda c: tx.source_group(c, [("khmer_scan_", "khmer")], inside=True)) == "khmer"
    assert one(spark, " Yes ", tx.truthy) is True and one(spark, None, tx.truthy) is False


def test_geometry(spark):
    row = spark.createDataFrame([(0, 0, 10, 10, 5, 5, 15, 15)], "ax1 long, ay1 long, ax2 long, ay2 long, bx1 long, by1 long, bx2 long, by2 long")
    a, b = g.box("a"), g.box("b")
    got = row.select(g.iou(a, b).alias("iou"), g.coverage(a, b).alias("c"), g.gap(a, b).alias("gap"), g.crop_box(a, F.lit(0), F.lit(0), 0.5).alias("none"), g.label_line(F.lit(3), a, F.lit(100), F.lit(100)).alias("line")).first()
    assert got.iou == pytest.approx(25 / 175) and got.c == 0.25 and got.gap == 0 and got.none is None
    assert got.line == "3 0.050000 0.050000 0.100000 0.100000"
    empty = spark.range(1).select(g.iou(g.Box(*[F.lit(0)] * 4), g.Box(*[F.lit(0)] * 4)).alias("v"))
    assert empty.first().v == 0.0


def test_selection(spark):
    rows = spark.createDataFrame([("a", k) for k in range(10)] + [("b", 1)], "g string, k int")
    got = {(r.g, r.k) for r in sel.spread(rows, ["g"], [F.col("k")], 4).collect()}
    assert got == {("a", 0), ("a", 3), ("a", 6), ("a", 9), ("b", 1)}
    assert {r.k for r in sel.top_per_group(rows, ["g"], [F.desc("k")], 2).collect()} == {9, 8, 1}
    numbered = sel.number_rows(spark.range(100).repartition(7), [F.col("id")], "n")
    assert all(r.id == r.n for r in numbered.collect())
    joined = sel.cycle_join(spark.range(5), spark.createDataFrame([("x",), ("y",)], "v string"), [F.col("id")], [F.col("v")])
    assert {(r.id, r.v) for r in joined.collect()} == {(0, "x"), (1, "y"), (2, "x"), (3, "y"), (4, "x")}
    seats = sel.apportion(spark.createDataFrame([("a", 60), ("b", 30), ("c", 10)], "k string, w int"), 10, "k", "w")
    assert {r.k: r.seats for r in seats.collect()} == {"a": 6, "b": 3, "c": 1}


def test_statistics(spark):
    one_row = spark.createDataFrame([("x", 2.0)], "g string, v double")
    got = st.numeric_summary(one_row, ["g"], ["v"]).first()
    assert got.stdev is None and got.p50 == 2.0
    vals = spark.createDataFrame([("x", float(k)) for k in (5, 1, 4, 2)], "g string, v double")
    assert vals.groupBy("g").agg(st.nearest_rank("v", 0.5).alias("q")).first().q == 4.0  # place 1.5 goes to 2
    zero = spark.range(1).select(st.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("d")).first()
    assert zero.d == 0.0
