"""Least squares on nearly and exactly collinear columns, and the further parts of the profiling and split operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import linear as L
from riskframe.operators import prep as P
from riskframe.operators import profile as PR
from riskframe.operators import quality as Q
from riskframe.operators import scoring as SC


@pytest.fixture(scope="module")
def near(spark):
    """Two columns whose difference is 1e-10 of their length (condition number 1e10), beside one in the millions."""
    rng = np.random.default_rng(12)
    n = 600
    a, d, big = rng.normal(size=n), rng.normal(size=n), rng.normal(3e6, 5e5, n)
    b = a + 1e-10 * d
    y = 2.0 * a + 1e-6 * big + 3.0 * (b - a) * 1e10
    x = np.column_stack([a, b, big])
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, big double, y double").repartition(7)
    return x, y, df


def test_coefficients_survive_a_condition_number_of_1e10(near):
    x, y, df = near
    G = L.gram(df, ["a", "b", "big", "y"])
    xc, yc = x - x.mean(axis=0), y - y.mean()
    scale = np.linalg.norm(xc, axis=0)
    want = np.linalg.lstsq(xc / scale, yc, rcond=None)[0] / scale
    got = L.ols(G, "y", ["a", "b", "big"])
    # the slope along the difference is 3e10; the data itself fixes it to about 1e-6
    np.testing.assert_allclose(got.coef, want, rtol=1e-5)
    np.testing.assert_allclose(got.coef[:2], [2.0 - 3e10, 3e10], rtol=1e-4)
    S = xc.T @ xc
    by_products = np.linalg.pinv(S) @ (xc.T @ yc)
    assert abs(by_products[1] / 3e10 - 1) > 0.5, "cross products lose the difference"
    assert np.sqrt(got.rss) < 1e-4 * np.linalg.norm(yc)


def test_vif_tells_near_from_exact_collinearity(spark, near):
    _, _, df = near
    df = df.withColumn("twice", 2 * F.col("big"))
    v = dict(L.vif_table(L.gram(df, ["a", "b", "big", "twice"]), ["a", "b", "big", "twice"]))
    assert 1e18 < v["a"] < 1e22 and 1e18 < v["b"] < 1e22
    assert v["big"] > 1e24 and v["twice"] > 1e24
    assert L.remove_high_vif(L.gram(df, ["a", "b", "big", "twice"]), ["a", "b", "big", "twice"]) in (["b", "twice"], ["a", "twice"], ["b", "big"], ["a", "big"])


def test_factor_does_not_depend_on_the_deal(near):
    x, _, df = near
    xc = x - x.mean(axis=0)
    for parts in (1, 3, 90):
        G = L.gram(df.repartition(parts), ["a", "b", "big"])
        np.testing.assert_allclose(G.sub(["a", "b", "big"], ["a", "b", "big"]), xc.T @ xc, rtol=1e-9, atol=1e-3)
        assert G.n == len(x)


def test_code_impact_test_without_coded_rows(spark):
    code = -9999998.0
    df = spark.createDataFrame([(code if i % 3 == 0 else None if i % 3 == 1 else 1.0, 2.0, float(i % 10) + (5 if i % 3 == 0 else 0)) for i in range(90)], "x3 double, x4 double, target double")
    got = {r.variable: r for r in Q.sentinel_impact_test(df).collect()}
    a, b = ([float(i % 10) + (5 if i % 3 == 0 else 0) for i in range(90) if i % 3 == k] for k in (0, 2))
    want = max(abs(np.mean(np.array(a) <= v) - np.mean(np.array(b) <= v)) for v in a + b)
    assert got["x3"].ks_stat == pytest.approx(want, abs=1e-6) and 0 <= got["x3"].p_value < 0.05 and got["x3"].n_sentinel == 30
    assert "x4" not in got, "a column without a coded row is not listed"


def test_imputation_strategies(spark):
    rows = [(float(v) if v is not None else None, float(i)) for i, v in enumerate([5, 5, 7, 7, 9, None, 100, None, 3, 8])]
    df = spark.createDataFrame(rows, "x1 double, TARGET double")
    for strategy, want in (("mean", 18.0), ("most_frequent", 5.0), ("median", 7.0)):
        m = P.RiskPreprocessor(labelCol="TARGET", imputeStrategy=strategy, numericCols=["x1"], outlierFactor=1e9).fit(df)
        filled = [r.x1 for r in m.transform(df).where("TARGET in (5, 7)").collect()]
        assert filled == [want, want], strategy


def test_request_codes_and_line(spark):
    df = spark.createDataFrame([(-9999998.0, -9999998.0, " ab "), (1.0, None, "")], "x3 double, x4 double, x9 string")
    assert [tuple(r) for r in SC.normalise_requests(df, null_codes={"x3": -9999998.0}).collect()] == [(None, -9999998.0, "AB"), (1.0, None, None)]
    grid = spark.createDataFrame([(float(t), 2.0 + 3.0 * t) for t in range(5)], "theoretical double, sample double")
    assert tuple(PR.qq_line(grid).first()) == (3.0, 2.0, 1.0)


def test_portable_splits(spark):
    ids = list(range(-50, 5000)) + [2**40 + 3, None]
    df = spark.createDataFrame([(i,) for i in ids], "ID long").repartition(4)
    key = lambda i, seed: ((i % 2**31) * 2654435761 + seed * 40503) % 2**32
    got = {r.ID: (r.h, r.f) for r in df.select("ID", P.portable_holdout("ID").alias("h"), P.portable_fold("ID").alias("f")).collect()}
    assert got == {i: (key(i, 42) * 100 < 20 * 2**32, key(i, 43) * 5 >> 32) if i is not None else (False, None) for i in ids}
    assert 0.15 < np.mean([h for h, _ in got.values()]) < 0.25 and {f for _, f in got.values()} == {0, 1, 2, 3, 4, None}
    known = df.where("ID is not null")
    assert [r.ID for r in P.portable_sample(known, 7, "ID").collect()] == sorted([i for i in ids if i is not None], key=lambda i: (key(i, 42), i))[:7]
