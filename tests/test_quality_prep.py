"""Sentinels, missing summary, IQR mask and the preprocessing estimator on tiny frames."""

import pytest
from pyspark.sql import functions as F

from riskframe import config as C
from riskframe.operators import prep as P
from riskframe.operators import quality as Q

S = C.SENTINEL
SCHEMA = ", ".join([f"x{i} double" for i in range(1, 13) if i != 9] + ["x9 string", "target double", "id long"])


def sample(spark):
    rows = [
        # x1,    x2,   x3,  x4,   x5,   x6, x7,   x8,  x10,   x11,          x12,          x9,         target, id
        (207137.0, 6427.0, S, 1500.0, 3222.0, 1.0, 633.0, 1.0, 30170.0, 146.0, 47.0, "SURCO", 9000.0, 1),
        (None, 5000.0, 2500.0, S, None, 2.0, 850.0, 2.0, 20000.0, C.X11_SENTINEL, C.X12_SENTINEL, None, 7000.0, 2),
        (120000.0, None, 800.0, 900.0, None, 3.0, None, 5.4, 15000.0, 10.0, 20.0, "LIMA", 12000.0, 3),
        (0.0, 4000.0, S, 0.0, 100.0, 4.0, 600.0, 6.0, 0.0, 5.0, 9.0, "CUSCO", 5000.0, 4),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_replace_sentinels_no_mutation(spark):
    df = sample(spark)
    out = Q.replace_sentinels(df)
    assert out.where(F.col("x3").isNull()).count() == 2
    assert out.where(F.col("x11").isNull()).count() == 1
    assert df.where(F.col("x3") == S).count() == 2  # input unchanged


def test_missing_summary_only_missing_columns(spark):
    m = {r["variable"]: (r["n_missing"], r["pct_missing"]) for r in Q.missing_summary(sample(spark)).collect()}
    assert m["x5"] == (2, 50.0) and m["x1"] == (1, 25.0) and "x6" not in m


def test_outlier_mask(spark):
    big = spark.createDataFrame([(v,) for v in [10.0, 12.0, 11.0, 13.0, 1000000.0]], "v double")
    assert [r["is_outlier"] for r in Q.outlier_mask(big, "v").orderBy("v").collect()] == [False, False, False, False, True]
    small = spark.createDataFrame([(v,) for v in [10.0, 12.0, 11.0, 13.0, 12.5]], "v double")
    assert not any(r["is_outlier"] for r in Q.outlier_mask(small, "v").collect())


@pytest.fixture(scope="module")
def fitted(spark):
    df = sample(spark)
    return df, P.RiskPreprocessor().fit(df)


def test_transform_has_no_nulls_no_codes(fitted):
    df, m = fitted
    out = m.transform(df)
    num = Q.numeric_columns(out)
    row = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in num]).first()
    assert sum(row) == 0
    codes = [S, C.X11_SENTINEL, C.X12_SENTINEL]
    assert out.where(F.greatest(*[F.col(c).isin(codes).cast("int") for c in num]) == 1).count() == 0


def test_flag_counts_equal_raw_codes(fitted):
    df, m = fitted
    out = m.transform(df).agg(F.sum("x3_sin_registro"), F.sum("x4_sin_registro"), F.sum("x11_sin_registro")).first()
    assert tuple(out) == (2, 1, 1)


def test_feature_count_and_layout(fitted):
    df, m = fitted
    names = m.feature_names(df)
    # the ordinal layout holds the levels present in the fit rows: 1, 2, 5 (5.4 rounds to 5) and 'otro' (6)
    assert [n for n in names if n.startswith("x8_cat_")] == ["x8_cat_1", "x8_cat_2", "x8_cat_5", "x8_cat_otro"]
    assert len(names) == 42 + 4
    assert [n for n in names if n in P.X7_LABELS] == sorted(P.X7_LABELS)


def test_fit_on_subset_transform_other(spark):
    df = sample(spark)
    m = P.RiskPreprocessor().fit(df.where(F.col("id") <= 3))
    out = m.transform(df.where(F.col("id") == 4)).first()
    # unseen category -> global TRAIN mean of the target
    assert out["x9_target_enc"] == pytest.approx((9000.0 + 7000.0 + 12000.0) / 3)
    assert 0.0 <= out["x3_share"] <= 1.0


def test_zero_denominators(spark):
    df = sample(spark)
    m = P.RiskPreprocessor().fit(df)
    r = m.transform(df).where(F.col("id") == 4).first()
    assert r["ratio_x2_x1"] is not None  # x1 = 0 -> TRAIN median denominator


def test_topn_fallback_layout(spark):
    df = sample(spark)
    m = P.RiskPreprocessor(labelCol="", topN=2).fit(df)
    cols = [c for c in m.transform(df).columns if c.startswith("x9_")]
    assert cols == sorted(cols) and "x9_OTROS" in cols and len(cols) == 3


def test_model_roundtrip(spark, tmp_path, fitted):
    df, m = fitted
    path = str(tmp_path / "prep")
    m.save(path)
    back = P.RiskPreprocessorModel.load(path)
    a = m.transform(df).orderBy("id").collect()
    b = back.transform(df).orderBy("id").collect()
    assert a == b


def test_sentinel_flag_null_is_zero(spark):
    df = spark.createDataFrame([(None,), (S,), (1.0,)], "x3 double")
    out = Q.sentinel_flags(df, {"x3": S}).select("x3_sin_registro").collect()
    assert [r[0] for r in out] == [0, 1, 0]
