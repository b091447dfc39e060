"""Contracts of stored tables: kept by true ones, broken by each kind of change."""


def summary_of(targets):
    from pyspark.sql import functions as F

    by_class = targets.groupBy("kind", "class_id").agg(F.sum("n").alias("n"))
    totals = by_class.groupBy("kind").agg(F.sum("n").alias("total"))
    return by_class.join(totals, "kind").select("kind", "class_id", "n", "total")


def failed(checks):
    return sorted(r["name"] for r in checks.collect() if not r["passed"])


def test_count_contract(spark):
    from pyspark.sql import functions as F

    from boxquarry.operators.contracts import KINDS, count_contract, count_targets

    visible = spark.createDataFrame([(1, 3), (1, 3), (1, 5), (2, 5)], "image long, class_id long")
    pieces = [(1, 3, 0, True), (1, 3, 0, False), (1, 3, 1, True), (1, 3, 1, True), (1, 5, 2, False), (2, 5, 0, True)]
    targets = count_targets(visible, spark.createDataFrame(pieces, "image long, class_id long, parent long, kept boolean"))
    counts = {(r["image"], r["kind"], r["class_id"]): r["n"] for r in targets.collect()}
    assert counts[1, "kept_fragments", 3] == 3 and counts[1, "parent_fused_kept_fragments", 3] == 2 and counts[1, "parent_fused_all_fragments", 3] == 2 and counts[1, "ignored_fragments", 5] == 1
    summary = summary_of(targets)
    assert failed(count_contract(summary, targets, 2)) == []
    assert failed(count_contract(summary, targets, 3)) == ["target_images"]
    assert failed(count_contract(summary.where(F.col("kind") != "kept_fragments"), targets, 2)) == [f"kept_fragments.{n}" for n in ("matches_targets", "non_negative", "present", "total_is_sum")]
    more = summary.withColumn("n", F.when((F.col("kind") == KINDS[0]) & (F.col("class_id") == 3), F.col("n") + 1).otherwise(F.col("n")))
    assert failed(count_contract(more, targets, 2)) == [f"{KINDS[0]}.matches_targets", f"{KINDS[0]}.total_is_sum"]
    total = summary.withColumn("total", F.when(F.col("kind") == KINDS[4], F.col("total") + 2).otherwise(F.col("total")))
    assert failed(count_contract(total, targets, 2)) == ["parent_fused_all_fragments.total_is_sum", "parent_fused_all_matches_physical"]
    below = summary.withColumn("n", F.when(F.col("kind") == "ignored_fragments", F.lit(-1)).otherwise(F.col("n")))
    assert "ignored_fragments.non_negative" in failed(count_contract(below, targets, 2))


def test_view_differences(spark):
    from boxquarry.operators.contracts import view_differences

    a = spark.createDataFrame([(1, 2), (2, 3), (3, None)], "image long, n long")
    b = spark.createDataFrame([(1, 2), (2, 4), (3, None), (4, 1)], "image long, n long")
    assert sorted(tuple(r) for r in view_differences(a, b, ["image"], "n").collect()) == [(2, 3, 4), (4, None, 1)]
    assert view_differences(a, a, ["image"], "n").collect() == []


def test_stale_rows(spark):
    from boxquarry.operators.contracts import stale_rows

    report = [("same", True, True, "x"), ("other", True, True, "x"), ("gone", True, True, "x"), ("optional", False, False, ""), ("late", True, False, ""), ("blank", True, True, None), ("was", False, True, "x")]
    frame = spark.createDataFrame(report, "path string, required boolean, existed boolean, sha256 string")
    present = spark.createDataFrame([("same", "x"), ("other", "y"), ("blank", "z")], "path string, sha256 string")
    got = sorted(tuple(r) for r in stale_rows(frame, present).collect())
    assert got == [("blank", "is missing sha256"), ("gone", "path is missing"), ("late", "path is missing"), ("late", "was missing when the report was generated"), ("other", "fingerprint is stale"), ("was", "path is missing")]
