"""What a job reads, writes and holds as its input grows: passes over the data, cells, generated code, state."""

import numpy as np
from pyspark.sql import functions as F

from riskframe import session
from riskframe.operators import boost as B
from riskframe.operators import linear as L
from riskframe.operators import prefix as X
from riskframe.plans import catalog_io, catalog_metrics, catalog_scoring
from riskframe.streaming import stateful as SS

SF = "/root/testdata/sf0.001"


def counted(spark, rows, schema):
    """The rows as a frame, and how often one of them was made."""
    seen = spark.sparkContext.accumulator(0)

    def made(r):
        seen.add(1)
        return r

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(made), schema), seen


def test_wide_projections_are_compiled(spark):
    """The default limit becomes one that the JVM compiles; a deployment's own stays."""
    key = "spark.sql.codegen.hugeMethodLimit"
    try:
        for given, then in (("65535", "8000"), ("20000", "20000")):
            spark.conf.set(key, given)
            session.ensure_checkpoint_dir(spark)
            assert spark.conf.get(key) == then
    finally:
        spark.conf.set(key, "8000")


def test_first_cut_is_beside_the_wanted_ranks(spark):
    """A few edges for a few ranks; exact where the sketch's cells hold ties, gaps and both ends."""
    assert len(X._around([0.25, 0.5, 0.75], 1024)) == 6 and X._around([0.0, 1.0], 4) == [0.0, 0.125, 0.875, 1.0]
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(900, 3.0), rng.lognormal(0, 3, 3000), rng.integers(0, 5, 600).astype(float)])
    df = spark.createDataFrame([(g, float(v)) for g, part in (("a", values), ("b", values[:7]), (None, values[900:2000])) for v in part], "g string, v double")
    probs = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = {r.g: r for r in X.exact_quantiles(df, "v", probs, within=["g"], ranked=50, fan=64).collect()}
    for g, part in (("a", values), ("b", values[:7]), (None, values[900:2000])):
        np.testing.assert_allclose([got[g][f"q{i}"] for i in range(5)], np.quantile(part, probs), rtol=1e-12)


def test_linear_model_reads_its_rows_once(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b) + 1e6, float(2 * a - b + e)) for a, b, e in rng.normal(size=(400, 3))]
    df, seen = counted(spark, rows, "a double, b double, y double")
    G = L.gram(df, ["a", "b", "y"])
    assert seen.value == 400
    centred = np.array(rows) - np.mean(rows, axis=0)
    np.testing.assert_allclose(G.R.T @ G.R, centred.T @ centred, rtol=1e-8, atol=1e-6)
    np.testing.assert_allclose(G.means, np.mean(rows, axis=0), rtol=1e-12)
    df, seen = counted(spark, [(a, b, float(np.exp(y))) for a, b, y in rows], "a double, b double, y double")
    m = L.LogLinearModel().fit(df, ["a", "b"], "y")
    assert seen.value == 400 and m.result.n == 400
    bp = L.breusch_pagan(df.withColumn("e", F.log("y") - F.col("a")), "e", ["a", "b"])
    assert seen.value == 800 and 0 <= bp["p_value"] <= 1


def test_glm_iterations_read_kept_rows(spark):
    rng = np.random.default_rng(2)
    df, seen = counted(spark, [(float(x), float(np.exp(1 + 0.3 * x))) for x in rng.normal(size=300)], "x double, target double")
    glm = B.tweedie_glm(df, ["x"], label="target").stages[-1]
    assert abs(glm.coefficients[0] - 0.3) < 1e-4 and seen.value == 300


def test_fit_reads_written_applicants(spark, monkeypatch):
    """Neither the saved model's query nor the rules on scores repeat the line-item aggregation."""
    assert "lineitem.parquet" not in catalog_io.q_model_persistence(spark, SF)._jdf.queryExecution().executedPlan().toString()
    calls = []
    base = catalog_scoring.base
    for module in (catalog_scoring, catalog_metrics):
        monkeypatch.setattr(module, "base", lambda *a: calls.append(1) or base(*a))
    assert catalog_scoring.q_score_rules(spark, SF).count() and len(calls) == 1


def test_state_grows_by_partitions_on_disk(spark):
    """A stream's state is cut by the size of its tables and held by RocksDB; the session's settings come back."""
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    least = session.shuffle_partitions(spark)
    assert SS.partitions_by_bytes(orders) == least and SS.partitions_by_bytes(orders, bytes_each=100) > 10 * least
    keys = ["spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass"]
    before = [spark.conf.get(k) for k in keys]

    class Writer:
        def start(self):
            return [spark.conf.get(k) for k in keys]

    got = SS._started(spark, Writer(), 77)
    assert got[0] == "77" and got[1].endswith("RocksDBStateStoreProvider")
    assert [spark.conf.get(k) for k in keys] == before
