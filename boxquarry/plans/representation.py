"""Queries that compare real and synthetic rows by their features: embeddings, and the geometry of boxes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquarry.functions import geometry as g
from boxquarry.operators import representation as rep
from boxquarry.plans import adapters as a
from boxquarry.plans.registry import query
from boxquarry.sources.scratch import cut

#: Embeddings standardised over all, with a domain: 0 is real, 1 synthetic.
_SQL = """WITH e AS (SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS domain, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings),
st AS (SELECT k, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY 1), zs AS (SELECT vec_id, label, domain, k, (v - m) / s AS v FROM e JOIN st USING (k)),
z AS (SELECT vec_id, label, domain, list(v ORDER BY k) AS x FROM zs GROUP BY ALL)"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """(id, domain, label, x) of the embeddings, standardised."""
    e = a.table(spark, d, "embeddings").where("embedding is not null")
    rows = e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0).cast("long").alias("domain"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return cut(rep.standardise(rows), "standardised")


@query(
    "k4_representation_gap",
    f"""{_SQL}, c AS (SELECT domain, k, avg(v) AS m FROM zs GROUP BY ALL), cx AS (SELECT domain, list(m ORDER BY k) AS c FROM c GROUP BY 1), w AS (SELECT domain, avg(list_distance(x, c)) AS w FROM z JOIN cx USING (domain) GROUP BY 1)
SELECT round(list_distance(r.c, s.c), 6) AS centroid_l2, round(list_distance(r.c, s.c) / ((wr.w + ws.w) / 2), 6) AS over_within, round(1 - list_cosine_similarity(r.c, s.c), 6) AS centroid_cosine, round(wr.w, 6) AS within_real, round(ws.w, 6) AS within_synthetic
FROM cx r, cx s, w wr, w ws WHERE r.domain = 0 AND s.domain = 1 AND wr.domain = 0 AND ws.domain = 1""",
)
def k4_representation_gap(spark: SparkSession, d: str) -> DataFrame:
    """Distance of the domains' centroids, as it is and over the mean distance within a domain."""
    x = rep.centroid_gap(_rows(spark, d))
    return spark.createDataFrame([tuple(round(v, 6) for v in (x.l2, x.over_within, x.cosine, *x.within))], "centroid_l2 double, over_within double, centroid_cosine double, within_real double, within_synthetic double")


@query(
    "k6_kernel_distance",
    f"""{_SQL}, p AS (SELECT x.domain AS a, y.domain AS b, pow(list_distance(x.x, y.x), 2) AS d FROM z x JOIN z y ON x.vec_id < y.vec_id), m AS (SELECT 1 / greatest(2 * median(d) FILTER (d > 0), 1e-12) AS gamma FROM p),
n AS (SELECT count(*) FILTER (domain = 0) AS r, count(*) FILTER (domain = 1) AS s FROM z),
k AS (SELECT sum(exp(-gamma * d)) FILTER (a = 0 AND b = 0) AS rr, sum(exp(-gamma * d)) FILTER (a = 1 AND b = 1) AS ss, sum(exp(-gamma * d)) FILTER (a <> b) AS rs FROM p, m)
SELECT round((2 * rr + r) / (r * r) + (2 * ss + s) / (s * s) - 2 * rs / (r * s), 6) AS mmd2, round(gamma, 6) AS gamma FROM k, m, n""",
)
def k6_kernel_distance(spark: SparkSession, d: str) -> DataFrame:
    """The domains' distance under a Gaussian kernel as wide as the median distance of all pairs."""
    found = rep.kernel_distance(_rows(spark, d))
    return spark.createDataFrame([tuple(round(v, 6) for v in found)] if found else [], "mmd2 double, gamma double")


@query(
    "k7_coral_distance",
    f"""{_SQL}, cov AS (SELECT x.domain, x.k AS i, y.k AS j, covar_samp(x.v, y.v) AS c FROM zs x JOIN zs y ON x.vec_id = y.vec_id GROUP BY ALL)
SELECT round(sum(pow(r.c - s.c, 2)) / (4.0 * count(*)), 9) AS coral FROM cov r JOIN cov s ON r.i = s.i AND r.j = s.j WHERE r.domain = 0 AND s.domain = 1""",
)
def k7_coral_distance(spark: SparkSession, d: str) -> DataFrame:
    """How far the domains' covariances are apart."""
    found = rep.coral_distance(_rows(spark, d))
    return spark.createDataFrame([(None if found is None else round(found, 9),)], "coral double")


@query(
    "e25_nearest_of_other_domain",
    f"""{_SQL}, p AS (SELECT x.vec_id, x.domain, x.label, y.vec_id AS nearest, y.label AS nearest_label, list_distance(x.x, y.x) AS d FROM z x JOIN z y ON x.domain <> y.domain)
SELECT vec_id, domain, label, nearest, nearest_label, round(d, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, nearest) = 1""",
)
def e25_nearest_of_other_domain(spark: SparkSession, d: str) -> DataFrame:
    """Each real row's nearest synthetic one, and each synthetic row's nearest real one."""
    rows = _rows(spark, d)
    found = rep.nearest(rows).join(rows.select("id", "label"), "id")
    other = rows.select(F.col("id").alias("nearest"), F.col("label").alias("nearest_label"))
    return found.join(other, "nearest").select(F.col("id").alias("vec_id"), "domain", "label", "nearest", "nearest_label", F.round("distance", 6).alias("distance"))


@query(
    "k9_per_class_gaps",
    f"""{_SQL}, c AS (SELECT label, domain, list(m ORDER BY k) AS c FROM (SELECT label, domain, k, avg(v) AS m FROM zs GROUP BY ALL) GROUP BY ALL), n AS (SELECT label, count(*) FILTER (domain = 0) AS reals, count(*) FILTER (domain = 1) AS synthetics FROM z GROUP BY 1),
p AS (SELECT x.vec_id, x.domain, x.label, min(list_distance(x.x, y.x)) AS d FROM z x JOIN z y ON x.label = y.label AND x.domain <> y.domain GROUP BY ALL),
q AS (SELECT label, avg(d) FILTER (domain = 0) AS rm, max(d) FILTER (domain = 0) AS rx, avg(d) FILTER (domain = 1) AS sm FROM p GROUP BY 1)
SELECT label, reals, synthetics, round(list_distance(r.c, s.c), 6) AS centroid_l2, round(1 - list_cosine_similarity(r.c, s.c), 6) AS centroid_cosine, round(rm, 6) AS real_nearest_mean, round(rx, 6) AS real_nearest_max, round(sm, 6) AS synthetic_nearest_mean
FROM n JOIN q USING (label) JOIN c r USING (label) JOIN c s USING (label) WHERE r.domain = 0 AND s.domain = 1 AND reals >= 2 AND synthetics >= 2""",
)
def k9_per_class_gaps(spark: SparkSession, d: str) -> DataFrame:
    """For each class with two rows of both domains: centroids, and how far rows are from the nearest of the other domain."""
    rows = _rows(spark, d)
    real, made = F.col("domain") == 0, F.col("domain") == 1
    near = rep.nearest(rows, ["label"]).groupBy("label").agg(
        F.avg(F.when(real, F.col("distance"))).alias("rm"), F.max(F.when(real, F.col("distance"))).alias("rx"), F.avg(F.when(made, F.col("distance"))).alias("sm")
    )
    n = rows.groupBy("label").agg(F.count_if(real).alias("reals"), F.count_if(made).alias("synthetics")).where("reals >= 2 and synthetics >= 2")
    means = rows.select("label", "domain", F.posexplode("x").alias("k", "v")).groupBy("label", "k").agg(F.avg(F.when(real, F.col("v"))).alias("r"), F.avg(F.when(made, F.col("v"))).alias("s"))
    norms = F.sqrt(F.sum(F.col("r") * F.col("r"))) * F.sqrt(F.sum(F.col("s") * F.col("s")))
    centres = means.groupBy("label").agg(F.sqrt(F.sum(F.pow(F.col("r") - F.col("s"), 2))).alias("l2"), F.coalesce(1 - F.sum(F.col("r") * F.col("s")) / F.nullif(norms, F.lit(0.0)), F.lit(0.0)).alias("cosine"))
    r = lambda c, name: F.round(c, 6).alias(name)
    return n.join(near, "label").join(centres, "label").select("label", "reals", "synthetics", r("l2", "centroid_l2"), r("cosine", "centroid_cosine"), r("rm", "real_nearest_mean"), r("rx", "real_nearest_max"), r("sm", "synthetic_nearest_mean"))


FEATURES = ["width_share", "height_share", "area_share", "aspect", "cx", "cy"]


@query("k1_domain_separator")
def k1_domain_separator(spark: SparkSession, d: str) -> DataFrame:
    """Can boxes of synthetic images be told by their geometry?  One row for each feature, largest weight first, with the out-of-fold figures of all."""
    b = a.gt_boxes(spark, d).join(a.images(spark, d), "image")
    w, h = (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")
    values = [w / F.col("width"), h / F.col("height"), g.area_ratio(g.box(), F.col("width"), F.col("height")), w / h, (F.col("x1") + F.col("x2")) / 2 / F.col("width"), (F.col("y1") + F.col("y2")) / 2 / F.col("height")]
    rows = b.select((F.col("image") * 64 + F.col("label_index")).alias("id"), F.when(F.col("source_family") == "synthetic", 1).otherwise(0).cast("long").alias("domain"), F.array(*[v.cast("double") for v in values]).alias("x"))
    found = rep.separate(rows)
    p = cut(found.predictions, "predictions")
    hit = lambda domain: F.sum(F.when((F.col("domain") == domain) & ((F.col("p") >= 0.5) == (F.col("domain") == 1)), 1).otherwise(0)) / F.count_if(F.col("domain") == domain)
    r = p.agg(F.avg(((F.col("p") >= 0.5) == (F.col("domain") == 1)).cast("double")).alias("accuracy"), ((hit(0) + hit(1)) / 2).alias("balanced")).first()
    area = rep.auc(p, "p", "domain")
    out = [(name, round(float(x), 6), round(abs(float(x)), 6), None if area is None else round(area, 6), round(r["accuracy"], 6), round(r["balanced"], 6)) for name, x in sorted(zip(FEATURES, found.weights, strict=False), key=lambda t: -abs(t[1]))]
    return spark.createDataFrame(out, "feature string, coefficient double, abs_coefficient double, roc_auc double, accuracy double, balanced_accuracy double")


@query("k8_domain_accuracy")
def k8_domain_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Mean and spread over five folds of how often a separator tells an embedding's domain, and the distance that this stands for."""
    found = rep.separate(_rows(spark, d), penalise_constant=False, scaled=False).predictions
    scores = found.groupBy("fold").agg(F.avg(((F.col("p") >= 0.5) == (F.col("domain") == 1)).cast("double")).alias("s")).toPandas()["s"].to_numpy()
    mean = float(np.mean(scores))
    return spark.createDataFrame([(len(scores), round(mean, 6), round(float(np.std(scores)), 6), round(max(0.0, min(2.0, 4 * mean - 2)), 6))], "folds long, mean double, std double, proxy_a_distance double")
