"""Distances of domains against numpy on whole arrays, with blocks of several sizes."""

import math

import numpy as np
import pytest


def data(seed=1, n=90, d=4):
    rnd = np.random.default_rng(seed)
    rows = [(k, int(k % 3 == 0), int(k % 2), [float(v) for v in rnd.normal(size=d) * (1 + np.arange(d)) + (k % 3 == 0) * 0.8 + 50]) for k in range(n)]
    return [*rows, (n, 0, 1, rows[3][3]), (n + 1, 1, 1, rows[3][3])]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(data(), "id long, domain long, label long, x array<double>").repartition(3)


def arrays():
    x, y = np.array([r[3] for r in data()]), np.array([r[1] for r in data()])
    return (x - x.mean(axis=0)) / x.std(axis=0), y


def test_coral_and_centroids(frame):
    from boxquarry.operators.representation import centroid_gap, coral_distance, standardise

    x, y = arrays()
    got = coral_distance(standardise(frame))
    assert math.isclose(got, ((np.cov(x[y == 0].T) - np.cov(x[y == 1].T)) ** 2).sum() / (4 * 16), rel_tol=1e-9)
    raw = np.array([r[3] for r in data()])
    assert math.isclose(coral_distance(frame), ((np.cov(raw[y == 0].T) - np.cov(raw[y == 1].T)) ** 2).sum() / (4 * 16), rel_tol=1e-9)
    gap = centroid_gap(standardise(frame))
    a, b = x[y == 0].mean(axis=0), x[y == 1].mean(axis=0)
    within = [np.linalg.norm(x[y == k] - m, axis=1).mean() for k, m in ((0, a), (1, b))]
    assert np.allclose([gap.l2, gap.over_within, gap.cosine, *gap.within], [np.linalg.norm(a - b), np.linalg.norm(a - b) / np.mean(within), 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), *within])
    assert coral_distance(frame.where("id = 0")) is None and coral_distance(frame.limit(0)) is None


@pytest.mark.parametrize("block", [2048, 13])
def test_kernel_distance(frame, block):
    from boxquarry.operators.representation import kernel_distance, median_square

    x, y = np.array([r[3] for r in data()]), arrays()[1]
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    upper = d[np.triu_indices(len(x), 1)]
    middle = np.median(upper[upper > 0])
    assert math.isclose(median_square(frame, block), middle, rel_tol=1e-12)
    mmd2, gamma = kernel_distance(frame, block)
    k = np.exp(-d / (2 * middle))
    want = k[np.ix_(y == 0, y == 0)].mean() + k[np.ix_(y == 1, y == 1)].mean() - 2 * k[np.ix_(y == 0, y == 1)].mean()
    assert math.isclose(gamma, 1 / (2 * middle), rel_tol=1e-12) and math.isclose(mmd2, want, rel_tol=1e-9)


def test_medians_of_few_pairs(spark):
    from boxquarry.operators.representation import kernel_distance, median_square

    make = lambda values: spark.createDataFrame([(k, k % 2, [float(v)]) for k, v in enumerate(values)], "id long, domain long, x array<double>")
    assert median_square(make([1, 1, 1])) == 1.0
    assert median_square(make([0, 1, 3])) == 4.0
    assert median_square(make([0, 0, 1, 3])) == np.median([1, 9, 1, 9, 4])
    assert kernel_distance(make([1, 2])) is None


def test_pairs_are_worked_out_twice(frame, monkeypatch):
    """All pairs are the whole cost: one pass bounds the median, another gives it and the kernel's sums."""
    from boxquarry.operators import representation as rep

    passes, meet = [], rep._pair_meetings
    monkeypatch.setattr(rep, "_pair_meetings", lambda *of: passes.append(of) or meet(*of))
    rep.kernel_distance(frame)
    assert len(passes) == 2


@pytest.mark.parametrize("case", ["copies", "far", "equal", "halves"])
def test_kernel_distance_of_hard_rows(spark, case):
    """Copies, rows so far from the others that products of matrices lose all digits, distances that are all one, and two middle ones far apart."""
    from boxquarry.operators.representation import kernel_distance

    rnd = np.random.default_rng(7)
    x = {
        "copies": np.repeat(rnd.normal(size=(12, 3)), 8, axis=0),
        "far": rnd.normal(size=(80, 3)) + np.where(np.arange(80) % 40 == 0, 1e7, 0.0)[:, None] + 3e4,
        "equal": np.eye(40),
        "halves": np.array([[0.0], [0.0], [1.0], [1.0], [1000.0]]),
    }[case]
    y = np.arange(len(x)) % 2
    found = kernel_distance(spark.createDataFrame([(k, int(v), [float(w) for w in r]) for k, (r, v) in enumerate(zip(x, y, strict=True))], "id long, domain long, x array<double>"), 17)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    upper = d[np.triu_indices(len(x), 1)]
    k = np.exp(-d / (2 * np.median(upper[upper > 0])))
    want = k[np.ix_(y == 0, y == 0)].mean() + k[np.ix_(y == 1, y == 1)].mean() - 2 * k[np.ix_(y == 0, y == 1)].mean()
    assert math.isclose(found[1], 1 / (2 * np.median(upper[upper > 0])), rel_tol=1e-12) and math.isclose(found[0], want, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize(("block", "by"), [(4096, ()), (7, ()), (7, ("label",))])
def test_nearest(frame, block, by):
    from boxquarry.operators.representation import nearest

    rows = data()
    got = {(r["id"], r["domain"]): r for r in nearest(frame, by, pivots=6, block=block).collect()}
    assert len(got) == len(rows)
    pairs = 0
    for i, dom, label, x in rows:
        others = [(((np.array(x) - np.array(v)) ** 2).sum(), j) for j, e, k, v in rows if e != dom and (not by or k == label)]
        want = min(others)
        assert got[i, dom]["nearest"] == want[1] and math.isclose(got[i, dom]["distance"], math.sqrt(want[0]), rel_tol=1e-12, abs_tol=1e-12)
        assert got[i, dom]["compared"] <= len(others)
        pairs += got[i, dom]["compared"]
    assert block == 4096 or pairs < sum(1 for r in rows for s in rows if r[1] != s[1] and (not by or r[2] == s[2]))


def test_nearest_prunes_far_clusters(spark):
    from boxquarry.operators.representation import nearest

    rnd = np.random.default_rng(5)
    rows = [(k, k % 2, [float(v) for v in rnd.normal(size=2) + 100 * (k % 8 // 2)]) for k in range(400)]
    got = nearest(spark.createDataFrame(rows, "id long, domain long, x array<double>"), pivots=16, block=64).collect()
    assert sum(r["compared"] for r in got) < 0.4 * 2 * 200 * 200


def newton(z, y, weight, penalty):
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (p - y)) + penalty * w)
    return w


def test_separator_against_a_direct_fit(frame):
    from boxquarry.operators.representation import auc, separate

    model = separate(frame, folds=4)
    rows = {r["id"]: r for r in model.predictions.collect()}
    x, y = np.array([r[3] for r in data()]), np.array([r[1] for r in data()])
    fold = np.array([rows[r[0]]["fold"] for r in data()])
    for k in (0, 1):
        assert np.ptp(np.bincount(fold[y == k], minlength=4)) <= 1
    for m in (*range(4), None):
        use = fold != m if m is not None else np.ones(len(y), dtype=bool)
        z = np.c_[(x - x[use].mean(axis=0)) / x[use].std(axis=0), np.ones(len(x))]
        weight = np.where(y == 1, use.sum() / (2 * y[use].sum()), use.sum() / (2 * (1 - y[use]).sum()))
        w = newton(z[use], y[use], weight[use], np.ones(5))
        if m is None:
            assert np.allclose(model.weights, w, atol=1e-6)
        else:
            assert np.allclose([rows[r[0]]["p"] for r, f in zip(data(), fold, strict=True) if f == m], 1 / (1 + np.exp(-z[fold == m] @ w)), atol=1e-6)
    p = np.array([rows[r[0]]["p"] for r in data()])
    want = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert math.isclose(auc(model.predictions, "p", "domain"), want, rel_tol=1e-12)
    assert auc(model.predictions.where("domain = 1"), "p", "domain") is None


def test_two_large_groups_are_not_dealt_by_group(spark):
    """Numbering by a key of two values joins the starts by a broadcast, though broadcasts by size are off."""
    from pyspark.sql import functions as F

    from boxquarry.operators.selection import number_in_groups

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = number_in_groups(spark.range(1000).withColumn("domain", F.col("id") % 2), ["domain"], [-F.col("id")], "k", "n")
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r["id"], r["k"], r["n"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == {(v, (999 - v) // 2, 500) for v in range(1000)}
    assert "SortMergeJoin" not in plan and "hashpartitioning(domain" not in plan
