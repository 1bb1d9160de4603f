"""Streams: a second run resumes, late rows follow the watermark, windows don't depend on the time zone."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskframe.streaming.jobs import stream_drift

EDGES = [0.0, 5.0, 10.0]
REF = {"n_ref": 100, "ref_counts": {0: 50, 1: 50}}


def _write(spark, folder, rows):
    df = spark.createDataFrame([(dt.datetime.fromisoformat(t), float(v)) for t, v in rows], "t timestamp, value double")
    df.select(F.col("t").cast("timestamp_ntz").alias("ts"), "value").coalesce(1).write.mode("append").parquet(folder)


def _drift(spark, folder, run):
    events = spark.readStream.schema("ts timestamp_ntz, value double").parquet(folder)
    out = stream_drift(spark, "", EDGES, window="1 day", watermark="1 day", events=events, run_dir=run, **REF)
    return {r.window_start: (r.n_cur, r.psi) for r in out.collect()}


def test_drift_resumes_and_drops_late_rows(spark, tmp_path):
    src, run = str(tmp_path / "in"), str(tmp_path / "run")
    _write(spark, src, [("2024-01-01 01:00:00", 1), ("2024-01-01 23:59:59.5", 7), ("2024-01-10 12:00:00", 1)])
    first = _drift(spark, src, run)
    assert first["2024-01-01"] == (2, 0.0) and first["2024-01-10"][0] == 1 and first["2024-01-10"][1] > 1
    # the watermark is 2024-01-09 12:00: the first day is closed, the tenth is open
    _write(spark, src, [("2024-01-01 05:00:00", 1), ("2024-01-10 13:00:00", 7)])
    second = _drift(spark, src, run)
    assert second["2024-01-01"] == (2, 0.0), "a row of a closed window is dropped"
    assert second["2024-01-10"] == (2, 0.0), "counts go on from the first run's state"
    assert _drift(spark, src, run) == second, "nothing new: nothing read again"


def test_drift_without_events(spark, tmp_path):
    src = str(tmp_path / "in")
    _write(spark, src, [])
    assert _drift(spark, src, str(tmp_path / "run")) == {}


@pytest.mark.parametrize("zone", ["America/Lima", "Asia/Tokyo"])
def test_windows_are_cut_on_the_wall_clock(spark, tmp_path, zone):
    src = str(tmp_path / "in")
    _write(spark, src, [("2024-03-01 00:00:00", 1), ("2024-03-01 23:30:00", 7)])
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert _drift(spark, src, str(tmp_path / "run")) == {"2024-03-01": (2, 0.0)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
