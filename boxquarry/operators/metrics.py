"""Recall, precision, confusion and count or value errors of predictions against labels."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxquarry.functions.geometry import area, box_in, intersection, iou_of_areas
from boxquarry.operators.matching import by_image, match_in_arrays, one_by_one, pairs_in_arrays, take_pairs


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    """part / whole; ``empty`` (null unless given) where whole is 0."""
    out = F.try_divide(part.cast("double"), whole.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def class_floor(preds: DataFrame, floors: dict[int, float]) -> DataFrame:
    """Predictions with at least the confidence that their class needs; classes without a floor need none."""
    need = F.lit(0.0)
    for class_id, floor in sorted(floors.items()):
        need = F.when(F.col("class_id") == class_id, floor).otherwise(need)
    return preds.where(F.col("confidence") >= need)


def gate_reject(preds: DataFrame, reject_class: int, threshold: Column | float, most_confidence: Column | float = 1.0) -> DataFrame:
    """``preds`` with ``rejected``: the gate's class is ``reject_class``, surely enough, and the detector isn't too sure."""
    t, c = (x if isinstance(x, Column) else F.lit(x) for x in (threshold, most_confidence))
    return preds.withColumn("rejected", (F.col("gate_class") == reject_class) & (F.col("gate_conf") >= t) & (F.col("confidence") <= c))


def reclassify(preds: DataFrame, least: float, blocked: Sequence[int] = ()) -> DataFrame:
    """``preds`` whose class is the gate's where it is sure enough and not blocked; ``reclassified`` tells which changed."""
    take = (F.col("gate_conf") >= least) & ~F.col("gate_class").isin(*blocked) if blocked else F.col("gate_conf") >= least
    changed = take & (F.col("gate_class") != F.col("class_id"))
    return preds.withColumn("reclassified", changed).withColumn("class_id", F.when(take, F.col("gate_class")).otherwise(F.col("class_id")))


def outcomes(preds: DataFrame, labels: DataFrame, threshold: float = 0.5, match_classes: bool = True, keys: Sequence[str] = ("image",)) -> DataFrame:
    """One row for each label and for each prediction without one: (keys, class_id, kind), kind being tp, fn or fp.

    Labels and predictions of an image meet once, and the match and its outcome are one fold: a shuffle of each side by its image at most.
    """
    both = by_image(preds, labels, keys).withColumn("_m", match_in_arrays(F.col("_p"), F.col("_l"), threshold, match_classes))
    has = lambda name, x: F.exists("_m", lambda m: m[name] == x[name])
    row = lambda x, kind: F.struct(x["class_id"].alias("class_id"), kind.alias("kind"))
    of_labels = F.transform("_l", lambda x: row(x, F.when(has("label_index", x), F.lit("tp")).otherwise(F.lit("fn"))))
    extra = F.transform(F.filter("_p", lambda x: ~has("pred_index", x)), lambda x: row(x, F.lit("fp")))
    return both.select(*keys, one_by_one(F.concat(of_labels, extra)))


def staged_outcomes(images: DataFrame, preds: DataFrame, labels: DataFrame, stages: Mapping[str, Callable[[Column], Column]], threshold: float = 0.5, more: Sequence[str] = (), best: Sequence[str] = ("best_stage", "best_reference")) -> DataFrame:
    """One row for each image and stage: the columns of ``images``, stage, ``_s`` (its predictions), ``_l`` (the labels) and ``outcomes``.

    A stage makes its predictions of an image's array of all; each is matched on its own.  ``outcomes`` has (at, class_id, kind, other, best_stage, best_reference)
    of each label, and of each prediction without one (kind fp); ``at`` is its index.  A label that isn't hit is no_box if no free prediction of any class takes it,
    same_class_conflict if one of its class would, wrong_class if another would; ``other`` is that prediction's class, set for hits too.  The best
    IoUs are those with the stage's and with all predictions, null without any; those that ``best`` doesn't name are null, and cost nothing.  Images without boxes stay.  Labels and predictions meet once for all stages.
    """
    both = images.join(by_image(preds, labels, more=more), "image", "left").withColumns({"_p": F.coalesce("_p", F.array()), "_l": F.coalesce("_l", F.array())})
    made = F.array(*[F.struct(F.lit(name).alias("stage"), keep(F.col("_p")).alias("_s")) for name, keep in stages.items()])
    staged = both.select(*images.columns, "_p", "_l", one_by_one(made))
    # pairs are sought once for both matches
    staged = staged.withColumn("_c", pairs_in_arrays(F.col("_s"), F.col("_l"), threshold))
    staged = staged.withColumns({"_m": take_pairs(F.filter("_c", lambda c: c["k"] == c["p"]["class_id"])), "_n": take_pairs(F.col("_c"))})

    none = F.lit(None).cast("double")

    def best_of(name: str, of: str, x: Column) -> Column:
        if name not in best:
            return none.alias(name)
        shared = F.transform(of, lambda p: F.struct(intersection(box_in(p), box_in(x)).alias("both"), area(box_in(p)).alias("own")))
        return F.array_max(F.transform(shared, lambda c: iou_of_areas(c["both"], c["own"], area(box_in(x))).cast("double"))).alias(name)

    def found(x: Column) -> Column:
        other = F.get(F.filter("_n", lambda m: m["label_index"] == x["label_index"]), F.lit(0))["pred_class"]
        return F.struct(x.alias("x"), F.exists("_m", lambda m: m["label_index"] == x["label_index"]).alias("hit"), other.alias("other"))

    def of_label(f: Column) -> Column:
        x, other = f["x"], f["other"]
        kind = F.when(f["hit"], "tp").when(other.isNull(), "no_box").when(other == x["class_id"], "same_class_conflict").otherwise("wrong_class")
        return F.struct(x["label_index"].alias("at"), x["class_id"].alias("class_id"), kind.alias("kind"), other.alias("other"), best_of("best_stage", "_s", x), best_of("best_reference", "_p", x))

    def of_extra(p: Column) -> Column:
        return F.struct(p["pred_index"].alias("at"), p["class_id"].alias("class_id"), F.lit("fp").alias("kind"), F.lit(None).cast("long").alias("other"), none.alias("best_stage"), none.alias("best_reference"))

    extra = F.filter("_s", lambda p: ~F.exists("_m", lambda m: m["pred_index"] == p["pred_index"]))
    return staged.select(*images.columns, "stage", "_s", "_l", F.concat(F.transform(F.transform("_l", found), of_label), F.transform(extra, of_extra)).alias("outcomes"))


def tally(rows: DataFrame, by: Sequence[str], empty: float | None = None) -> DataFrame:
    """Counts of labels, hits, misses and extras, recall and precision of ``outcomes`` by these columns."""
    tp, fn, fp = (F.count_if(F.col("kind") == k) for k in ("tp", "fn", "fp"))
    out = rows.groupBy(*by).agg((tp + fn).alias("gt"), tp.alias("tp"), fn.alias("fn"), fp.alias("fp"))
    return out.withColumns({"recall": ratio(F.col("tp"), F.col("gt"), empty), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"), empty)})


def per_image_values(images: DataFrame, preds: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """One row for each image: numbers of boxes and sums of face values by currency, labelled and predicted.

    ``exact_value`` compares the sums of both currencies only, so wrong values that cancel count as exact.
    """

    def totals(boxes: DataFrame, name: str) -> DataFrame:
        money = lambda c: F.sum(F.when(F.col("currency") == c, F.col("face_value")).otherwise(0.0))
        return boxes.join(classes, "class_id", "left").groupBy("image").agg(F.count("*").alias(f"{name}_count"), money("USD").alias(f"{name}_usd"), money("KHR").alias(f"{name}_khr"))

    both = images.join(totals(labels, "gt"), "image", "left").join(totals(preds, "pred"), "image", "left")
    names = [f"{a}_{b}" for a in ("gt", "pred") for b in ("count", "usd", "khr")]
    both = both.fillna(0, names)
    errors = {f"{b}_error": F.col(f"pred_{b}") - F.col(f"gt_{b}") for b in ("count", "usd", "khr")}
    return both.withColumns(errors).withColumns({"exact_count": F.col("count_error") == 0, "exact_value": (F.col("usd_error") == 0) & (F.col("khr_error") == 0)})


def failure_kind() -> Column:
    """Why an image failed, from its columns gt, tp, fn, fp, pred_count."""
    gt, preds, fn, fp = (F.col(c) for c in ("gt", "pred_count", "fn", "fp"))
    return (
        F.when((gt == 0) & (preds > 0), "false_positive_on_empty")
        .when((gt > 0) & (preds == 0), "missed_all")
        .when((fn > 0) & (fp > 0), "miss_plus_extra_or_wrong")
        .when(fn > 0, "missed_value")
        .when(fp > 0, "extra_value")
        .otherwise("value_mismatch")
    )
