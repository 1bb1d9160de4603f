"""Distributed running totals and exact quantiles against pandas/NumPy."""

import numpy as np
import pandas as pd
import pytest

from riskframe.operators.prefix import exact_quantiles, qcut_bucket, running_totals
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 3000), "v": np.round(rng.normal(size=3000), 1)})
    return pdf, spark.createDataFrame(pdf)


def test_quantiles_match_pandas(frame):
    pdf, df = frame
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, "v", probs, within=["g"]).toPandas().set_index("g").sort_index()
    exp = pdf.groupby("g")["v"].quantile(probs).unstack()
    for i, p in enumerate(probs):
        np.testing.assert_allclose(got[f"q{i}"].to_numpy(), exp[p].to_numpy(), rtol=0, atol=1e-12)
    assert list(got["n"]) == list(pdf.groupby("g").size())


def test_running_totals_descending_ties_grouped(frame):
    pdf, df = frame
    counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    got = running_totals(counts, ["v"], ["c"], descending=True).toPandas().sort_values("v", ascending=False)
    exp = pdf.groupby("v").size().sort_index(ascending=False).cumsum()
    assert got["_cum_c"].tolist() == exp.tolist()
    assert set(got["_tot_c"]) == {len(pdf)}


def test_partition_count_does_not_change_results(spark, frame):
    pdf, df = frame
    a = exact_quantiles(df.repartition(1), "v", [0.1, 0.9]).first()
    b = exact_quantiles(df.repartition(13), "v", [0.1, 0.9]).first()
    assert a == b


def test_qcut_bucket_matches_pandas(spark):
    # heavy ties: equal scores never split; counts follow pandas qcut, not ntile
    vals = np.repeat(np.arange(20, dtype=float), [50] * 10 + [1] * 10)
    pdf = pd.DataFrame({"x": vals})
    exp = pd.qcut(pdf["x"], 10, labels=False, duplicates="drop") + 1
    df = spark.createDataFrame(pdf)
    edges = exact_quantiles(df, "x", [i / 10 for i in range(11)], names=[f"e{i}" for i in range(11)])
    e = edges.select(F.array_sort(F.array_distinct(F.array(*[f"e{i}" for i in range(11)]))).alias("edges"))
    got = df.crossJoin(e).select("x", qcut_bucket(F.col("x"), F.col("edges")).alias("b")).toPandas()
    assert got.sort_values("x")["b"].tolist() == exp.loc[pdf.sort_values("x").index].tolist()


@pytest.mark.parametrize("kind", ["string", "bigint", "double"])
@pytest.mark.parametrize("partitions", [1, 7])
def test_null_groups_are_groups(spark, kind, partitions):
    keys = {"string": ["a", "b", None], "bigint": [2**60 + 1, 2**60 + 2, None], "double": [1.5, float("nan"), None]}[kind]
    rows = [(keys[i % 3], float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, f"g {kind}, v double")
    got = running_totals(df.withColumn("c", F.lit(1)), ["v"], ["c"], within=["g"], num_partitions=partitions).collect()
    assert len(got) == 90
    by = {}
    for r in sorted(got, key=lambda r: r.v):
        by.setdefault(str(r.g), []).append(r["_cum_c"])
    assert sorted(by) == sorted(map(str, keys)) and all(c == list(range(1, 31)) for c in by.values())
    q = {str(r.g): (r.q0, r.n) for r in exact_quantiles(df, "v", [0.5], within=["g"]).collect()}
    assert q == {str(keys[i]): (43.5 + i, 30) for i in range(3)}


@pytest.mark.parametrize("ranked,fan", [(10**9, 1024), (700, 8), (60, 4), (3, 32)])
def test_narrowing_never_changes_a_quantile(spark, ranked, fan):
    """The same values with no narrowing, one, and several; NULL groups, hot values, missing values and weights among them."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "tiny", ""], 4000, p=[0.5, 0.4, 0.001, 0.099]), "v": np.where(rng.random(4000) < 0.35, 7.25, np.round(rng.normal(0, 50, 4000), 2))})
    pdf.loc[pdf["g"] == "b", "v"] = 1.5
    rows = [(None if g == "" else g, float(v), i % 3) for i, (g, v) in enumerate(zip(pdf["g"], pdf["v"]))] + [("a", None, 1), ("a", float("nan"), 1), ("void", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(5)
    probs = [0.0, 0.003, 0.25, 0.5, 0.9, 1.0]
    got = {r.g or "": r for r in exact_quantiles(df, "v", probs, within=["g"], ranked=ranked, fan=fan).collect()}
    assert sorted(got) == sorted(pdf["g"].unique())
    for g, own in pdf.groupby("g")["v"]:
        assert got[g].n == len(own)
        np.testing.assert_allclose([got[g][f"q{i}"] for i in range(6)], own.quantile(probs), rtol=0, atol=1e-12)
    whole = exact_quantiles(df, "v", [0.3], weight="w", ranked=ranked, fan=fan).first()
    every = np.repeat([v for _, v, _ in rows[:-3]], [w for _, _, w in rows[:-3]])
    assert whole.n == len(every) and whole.q0 == pytest.approx(np.quantile(every, 0.3), abs=1e-12)


def test_quantiles_write_and_sort_nothing(frame):
    _, df = frame
    plan = exact_quantiles(df, "v", [0.5], within=["g"], ranked=100)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "FileScan" not in plan
