"""Exact quantiles by sorted ranges, against numpy."""

import numpy as np

from boxquarry.operators import statistics as st

SHARES = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}


def test_quantiles_of_groups(spark):
    rng = np.random.default_rng(5)
    groups = {"many": rng.integers(0, 40, 900) / 4, "one": np.array([3.5]), "equal": np.full(300, 2.0), None: rng.normal(size=77)}
    rows = [(k, float(v)) for k, held in groups.items() for v in held] + [("many", None), ("empty", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(7)
    found = {r["k"]: r for r in st.quantiles(frame, ["k"], "v", SHARES).collect()}
    assert set(found) == set(groups)
    for k, held in groups.items():
        assert np.allclose([found[k][n] for n in SHARES], np.quantile(held, list(SHARES.values())))
    ranks = {r["k"]: r for r in st.quantiles(frame, ["k"], "v", SHARES, linear=False).collect()}
    for k, held in groups.items():
        assert [ranks[k][n] for n in SHARES] == [float(np.sort(held)[round((len(held) - 1) * q)]) for q in SHARES.values()]


def test_quantiles_without_groups_or_rows(spark):
    frame = spark.createDataFrame([(1.0,), (4.0,), (None,)], "v double")
    assert [tuple(r) for r in st.quantiles(frame, [], "v", {"q": 0.5}).collect()] == [(2.5,)]
    none = frame.where("v is null")
    assert [tuple(r) for r in st.quantiles(none, [], "v", {"q": 0.5}).collect()] == [(None,)]


def test_summary_keeps_groups_without_values(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 5.0)], "k string, v double")
    got = {r["k"]: (r["n"], r["p50"]) for r in st.numeric_summary(frame, ["k"], ["v"]).collect()}
    assert got == {"a": (2, 1.5), "b": (0, None), None: (1, 5.0)}
