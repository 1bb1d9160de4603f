"""Bucketed tables join without an exchange; new categories are counted in one aggregate."""

import pytest
from pyspark.sql import functions as F

from riskframe.operators.quality import new_levels
from riskframe.sources.tables import write_bucketed


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_exchange(spark):
    a = spark.range(1000).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"))
    b = spark.range(200).select(F.col("id").alias("j"), (F.col("id") * 2).alias("w"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = write_bucketed(a, "left", "k", 4), write_bucketed(b, "right", "j", 4)
        joined = left.join(right, left.k == right.j)
        assert "Exchange" not in _plan(joined)
        assert "Exchange" not in _plan(left.groupBy("k").agg(F.sum("v")))
        plain = a.join(b, a.k == b.j)
        assert "Exchange" in _plan(plain)
        assert sorted(joined.collect()) == sorted(plain.collect())
        assert len(left.inputFiles()) <= 4, "one file per bucket"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_table_with_hot_null_and_no_rows(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (7, 3), (7, 3)], "k int, v int")
    assert sorted(write_bucketed(rows, "t", "k", 3).collect(), key=str) == sorted(rows.collect(), key=str)
    assert write_bucketed(rows.where("v > 9"), "t", "k", 3).count() == 0


@pytest.mark.parametrize("rows,want", [
    ([("a", "R"), ("a", "C"), ("b", "C"), ("b", "C"), (None, "C"), ("c", None), ("c", "C")], (4, 5, 80.0)),
    ([(None, "R"), (None, "C")], (0, 1, 0.0)),
    ([("a", "R")], (0, 0, None)),
    ([], (0, 0, None)),
])
def test_new_levels(spark, rows, want):
    df = spark.createDataFrame(rows, "x string, s string")
    got = new_levels(df, F.col("x"), F.col("s") == "C", F.col("s") == "R").first()
    assert tuple(got) == want
