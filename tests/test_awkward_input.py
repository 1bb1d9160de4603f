"""Ordinary dirty input: NULL groups, missing features, bad records, constant columns, half-saved models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators.metrics import decile_table, evaluate, gini
from riskframe.operators.prep import RiskPreprocessorModel
from riskframe.operators.profile import histogram
from riskframe.operators.quality import null_impact
from riskframe.operators.stability import psi_by_feature, psi_by_period
from riskframe.sources.tables import load_raw_csv, read_requests, rejected_csv, rejected_requests


def test_metrics_keep_the_null_group(spark):
    rng = np.random.default_rng(1)
    rows = [(["a", "b", None][i % 3], float(rng.normal()), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "split string, y double, p double")
    groups = {"a", "b", None}
    for out in (evaluate(df, "y", "p", ["split"]), gini(df, "y", "p", ["split"]), decile_table(df, "y", "p", ["split"])):
        assert {r.split for r in out.collect()} == groups
    whole = evaluate(df.where("split IS NULL"), "y", "p").first()
    mine = next(r for r in evaluate(df, "y", "p", ["split"]).collect() if r.split is None)
    assert (mine.gini, mine.ks, mine.rmse) == pytest.approx((whole.gini, whole.ks, whole.rmse))


def test_psi_of_a_missing_feature_is_an_alert(spark):
    ref = spark.createDataFrame([(float(i), float(i % 7)) for i in range(200)], "f double, g double")
    cur = spark.createDataFrame([(None, float(i % 7)) for i in range(200)], "f double, g double")
    got = {r.feature: r for r in psi_by_feature(ref, cur, ["f", "g"]).collect()}
    assert set(got) == {"f", "g"}
    share = np.log(1e-4 / 0.1) * (1e-4 - 0.1) * 10
    assert got["f"].psi == pytest.approx(share, rel=0.02) and got["f"].status == "ALERTA" and got["f"].n_bins_used == 10
    assert got["g"].psi == 0


def test_psi_of_a_null_period(spark):
    rows = [(float(i), "2020", True) for i in range(200)] + [(float(i) + 5000, None, False) for i in range(50)]
    df = spark.createDataFrame(rows, "x double, m string, ref boolean")
    got = {r.period: r for r in psi_by_period(df, "x", F.col("m"), F.col("ref")).collect()}
    assert got["2020"].psi == 0 and got[None].psi > 1 and got[None].status == "REENTRENAR" and got[None].n_bins_used == 10


def test_requests(spark, tmp_path):
    lines = ['{"x6": 1, "x10": 200}', '{"X6": 1, "X10": 200, "X9": "north"}', "{}", '{"x6": "text", "x10": 3}', "{broken", "[1, 2]", "", '{"x6": null}']
    (tmp_path / "r.json").write_text("\n".join(lines))
    got = [(r.x6, r.x10, r.x9) for r in read_requests(spark, str(tmp_path / "r.json")).collect()]
    assert got == [(1.0, 200.0, None), (1.0, 200.0, "north"), (None, None, None), (None, 3.0, None), (None, None, None)]
    assert [r.value for r in rejected_requests(spark, str(tmp_path / "r.json")).collect()] == ["{broken", "[1, 2]"]


def test_csv(spark, tmp_path):
    head = "ID,BASE,TARGET," + ",".join(f"X{i}" for i in range(1, 13))
    good = "1,TRAIN,10.5,1,2,3,4,5,6,7,8,north,10,11,12"
    bad = "2,TRAIN,text,1,2,3,4,5,6,7,8,north,10,11,12"
    (tmp_path / "a.csv").write_text("\n".join([head, good, bad]))
    assert [(r.id, r.target) for r in load_raw_csv(spark, str(tmp_path / "a.csv")).collect()] == [(1, 10.5)]
    assert [r["_corrupt_record"] for r in rejected_csv(spark, str(tmp_path / "a.csv")).collect()] == [bad]
    (tmp_path / "b.csv").write_text("\n".join([head.replace("X1,X2", "X2,X1"), good]))
    with pytest.raises(Exception, match="(?i)header"):
        load_raw_csv(spark, str(tmp_path / "b.csv")).collect()


def test_constant_column_and_zero_mean(spark):
    df = spark.createDataFrame([(5.0, None, 0.0), (5.0, 1.0, 0.0)], "x double, x1 double, target double")
    n, edges = np.histogram([5.0, 5.0], bins=4)
    got = histogram(df, "x", 4).orderBy("bin").collect()
    assert [r.n for r in got] == n.tolist() and [r.lower for r in got] == edges[:-1].tolist()
    assert null_impact(df, "target", ["x1"]).first().diff_pct is None


def test_half_saved_model_fails(spark, tmp_path):
    enc = spark.createDataFrame([("a", 1.0)], "x9 string, enc double")
    RiskPreprocessorModel(state={"bounds": {}}, encoding_df=enc).save(str(tmp_path / "m"))
    assert RiskPreprocessorModel.load(str(tmp_path / "m")).encoding_df.count() == 1
    (tmp_path / "m" / "encoding").rename(tmp_path / "gone")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        RiskPreprocessorModel.load(str(tmp_path / "m"))
