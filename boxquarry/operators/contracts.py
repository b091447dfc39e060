"""Stored tables against what they were made from: counts, label views, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of counts that a summary holds, by class.
KINDS = ["physical_visible_instances", "kept_fragments", "ignored_fragments", "parent_fused_kept_fragments", "parent_fused_all_fragments"]


def count_targets(visible: DataFrame, fragments: DataFrame) -> DataFrame:
    """(image, kind, class_id, n): the counts of each image that a renderer writes beside it.

    ``visible``: (image, class_id), a row for each visible thing; ``fragments``: (image, class_id, parent, kept), a row for each piece of one.
    """
    kind = lambda rows, name, *by: rows.groupBy("image", "class_id", *by).agg(F.count("*").alias("n")).groupBy("image", "class_id").agg((F.count("*") if by else F.sum("n")).alias("n")).select("image", F.lit(name).alias("kind"), "class_id", "n")
    parts = [kind(visible, KINDS[0]), kind(fragments.where("kept"), KINDS[1]), kind(fragments.where("not kept"), KINDS[2]), kind(fragments.where("kept"), KINDS[3], "parent"), kind(fragments, KINDS[4], "parent")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def count_contract(summary: DataFrame, targets: DataFrame, images: int) -> DataFrame:
    """(name, passed, actual, expected): whether a stored summary (kind, class_id, n, total) keeps its contract with the targets of ``images`` images.

    Each kind is there, has no negative count, its total is the sum of its classes, and equals the targets' sum; what is fused by parent over
    all fragments equals what is visible; and as many images have targets as there are.
    """
    own = summary.groupBy("kind").agg(F.sum("n").alias("sum"), F.max("total").alias("total"), F.min("total").alias("least"), F.min("n").alias("smallest"))
    now = targets.groupBy("kind").agg(F.sum("n").alias("counted"))
    every = summary.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    k = every.join(own, "kind", "left").join(now, "kind", "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    check = lambda name, passed, actual, expected: F.struct(F.concat(F.col("kind"), F.lit(f".{name}")).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), actual.cast("long").alias("actual"), expected.cast("long").alias("expected"))
    c = F.col
    rules = [
        check("present", c("sum").isNotNull(), c("sum"), c("counted")),
        check("non_negative", c("smallest") >= 0, c("smallest"), F.lit(0)),
        check("total_is_sum", (c("total") == c("sum")) & (c("least") == c("sum")), c("total"), c("sum")),
        check("matches_targets", c("sum") == c("counted"), c("sum"), c("counted")),
    ]
    blocks = k.select(F.inline(F.array(*rules)))
    # one row from five
    whole = k.agg(F.max(F.when(c("kind") == KINDS[0], c("total"))).alias("seen"), F.max(F.when(c("kind") == KINDS[4], c("total"))).alias("fused"))
    fused = whole.select(F.lit("parent_fused_all_matches_physical").alias("name"), F.coalesce(c("seen") == c("fused"), F.lit(False)).alias("passed"), c("fused").cast("long").alias("actual"), c("seen").cast("long").alias("expected"))
    n = targets.select("image").distinct().agg(F.count("*").alias("n"))
    rows = n.select(F.lit("target_images").alias("name"), (c("n") == images).alias("passed"), c("n").alias("actual"), F.lit(images).cast("long").alias("expected"))
    return blocks.unionByName(fused).unionByName(rows)


def view_differences(stored: DataFrame, counted: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, stored, counted): where a stored view and a recount differ, rows that only one of them has included."""
    s, n = stored.select(*keys, F.col(value).alias("stored")), counted.select(*keys, F.col(value).alias("counted"))
    return s.join(n, list(keys), "full_outer").where(~F.col("stored").eqNullSafe(F.col("counted")))


def stale_rows(report: DataFrame, present: DataFrame) -> DataFrame:
    """(path, failure) of a report's files (path, required, existed, sha256) that aren't as they were, against those there are (path, sha256).

    A file that the report was made without fails if it is required; one that is gone fails if it existed or is required; one without a
    fingerprint has to be reported anew; one with another fingerprint is stale.
    """
    now = present.select("path", F.col("sha256").alias("_now"), F.lit(True).alias("_here"))
    r = report.join(now, "path", "left")
    here, existed, required = F.col("_here").isNotNull(), F.coalesce("existed", F.lit(False)), F.coalesce("required", F.lit(True))
    blank = F.trim(F.coalesce("sha256", F.lit(""))) == ""
    failures = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("path", F.lit(""))) == "", "fingerprint row is missing path"),
        F.when(required & ~existed, "was missing when the report was generated"),
        F.when(~here & (existed | required), "path is missing"),
        F.when(here & blank, "is missing sha256"),
        F.when(here & ~blank & (F.col("sha256") != F.col("_now")), "fingerprint is stale"),
    ))
    return r.select("path", F.explode(failures).alias("failure"))
