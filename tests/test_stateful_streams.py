"""Stateful streams: two-stream scoring closes orders by the watermark and resumes; the trigger does not depend on arrival order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskframe.operators.stability import retrain_trigger
from riskframe.streaming.stateful import closed_orders, stream_trigger

ORDER = "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz"
LINE = "l_orderkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz"


def _day(n, second=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, seconds=second)


def _orders(spark, folder, rows):
    data = [(k, 1, 10.0, None if d is None else _day(d)) for k, d in rows]
    spark.createDataFrame(data, ORDER).coalesce(1).write.mode("append").parquet(folder)


def _lines(spark, folder, rows):
    data = [(k, q, 100.0, 0.1, 0.0, "R", None if d is None else _day(*d) if isinstance(d, tuple) else _day(d)) for k, q, d in rows]
    spark.createDataFrame(data, LINE).coalesce(1).write.mode("append").parquet(folder)


def _drain(spark, tmp_path, lag=10, delay=2):
    """What the sink holds after the query drained its sources: order -> (lines, quantity)."""
    src = {n: spark.readStream.schema(s).parquet(str(tmp_path / n)) for n, s in (("o", ORDER), ("l", LINE))}
    out = closed_orders(src["o"], src["l"], lag, delay).select("o_orderkey", "n_lines", "qty")
    path = str(tmp_path / "out")
    q = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "ckpt")).option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(out.schema).parquet(path).collect()
    assert len(rows) == len({r.o_orderkey for r in rows}), "an order is closed once"
    return {r.o_orderkey: (r.n_lines, r.qty) for r in rows}


def test_orders_close_with_the_lines_that_came_in_time(spark, tmp_path):
    o, li = str(tmp_path / "o"), str(tmp_path / "l")
    # watermark after the first run: day 40 - 2 = 38, orders up to day 28 (minus a lag of 10) are closed
    _orders(spark, o, [(1, 0), (2, 0), (3, 27), (4, 29), (5, 40), (6, None), (None, 5)])
    _lines(spark, li, [(1, 1.0, 0), (1, 2.0, 10), (1, 4.0, (10, 1)), (1, 8.0, -1), (2, 1.0, 50), (3, 1.0, 28), (4, 1.0, 30), (6, 1.0, 5), (None, 1.0, 5), (1, 1.0, None), (9, 1.0, 40)])
    first = _drain(spark, tmp_path)
    assert first == {1: (2, 3.0), 3: (1, 1.0)}, "lines before the order, a second past the lag and without a time stay out"
    assert _drain(spark, tmp_path) == first, "nothing new: nothing closes"
    # a second line of order 4 arrives later, in time; one of order 3 is behind the watermark
    _lines(spark, li, [(4, 2.0, 39), (3, 2.0, 30), (5, 3.0, 41)])
    _orders(spark, o, [(7, 60), (8, 20)])
    _lines(spark, li, [(7, 5.0, 61)])
    second = _drain(spark, tmp_path)
    assert second == first | {4: (2, 3.0), 5: (1, 3.0)}, "state of the first run goes on; late rows are dropped; order 7 is open"


@pytest.mark.parametrize("day,closed", [(27, True), (28, False), (29, False)])
def test_an_order_closes_when_the_watermark_is_past_its_lag(spark, tmp_path, day, closed):
    _orders(spark, str(tmp_path / "o"), [(1, day), (2, 40)])
    _lines(spark, str(tmp_path / "l"), [(1, 1.0, day), (2, 1.0, 40)])
    assert (1 in _drain(spark, tmp_path)) == closed


@pytest.mark.parametrize("zone", ["America/New_York"])
def test_spans_do_not_follow_the_session_time_zone(spark, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:  # a span over the change to summer time: the line at exactly ten days counts
        _orders(spark, str(tmp_path / "o"), [(1, 60), (2, 200)])
        _lines(spark, str(tmp_path / "l"), [(1, 1.0, 70), (1, 1.0, (70, 1)), (2, 1.0, 200)])
        assert _drain(spark, tmp_path) == {1: (1, 1.0)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


PSI = "feature string, period timestamp, psi double"


def _psi(spark, folder, rows):
    data = [(f, None if p is None else _day(p), v) for f, p, v in rows]
    spark.createDataFrame(data, PSI).coalesce(1).write.mode("append").parquet(folder)


def _trigger(spark, tmp_path, **more):
    rows = spark.readStream.schema(PSI).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "psi"))
    out = stream_trigger(spark, rows, delay="3 days", run_dir=str(tmp_path / "run"), **more).collect()
    assert len(out) == len({(r.feature, r.period) for r in out}), "a period closes once"
    return {(r.feature, (r.period - _day(0)).days): (r.psi, r.prev_psi, r.retrain) for r in out}


def test_trigger_closes_periods_in_order_and_resumes(spark, tmp_path):
    src = str(tmp_path / "psi")
    _psi(spark, src, [("a", 2, 0.3), ("a", 1, 0.4), ("b", 1, 0.1), (None, 1, 0.9), ("a", None, 0.5), ("a", 1, 0.2), ("b", 2, None), ("b", 2, float("nan"))])
    _psi(spark, src, [("a", 5, 0.9)])  # watermark: day 2
    first = _trigger(spark, tmp_path)
    assert first == {("a", 1): (0.4, None, False), ("b", 1): (0.1, None, False), (None, 1): (0.9, None, False)}
    _psi(spark, src, [("a", 4, 0.26), ("a", 0, 9.0), ("b", 3, 0.5)])  # out of order; one behind the watermark
    _psi(spark, src, [("b", 10, 0.5)])  # watermark: day 7; a's periods close by its timer
    second = _trigger(spark, tmp_path)
    assert second == first | {
        ("a", 2): (0.3, 0.4, True), ("a", 4): (0.26, 0.3, True), ("a", 5): (0.9, 0.26, True), ("b", 3): (0.5, 0.1, False),
    }
    assert _trigger(spark, tmp_path) == second


def test_trigger_equals_the_batch_trigger(spark, tmp_path):
    psi = [0.1, 0.3, 0.25, 0.26, 0.4, 0.5, 0.0, 0.3, 0.3, 0.3, 0.1]
    for files in (psi[::2], psi[1::2]):
        at = 0 if files == psi[::2] else 1
        _psi(spark, str(tmp_path / "psi"), [("x", at + 2 * i, v) for i, v in enumerate(files)])
    rows = spark.readStream.schema(PSI).parquet(str(tmp_path / "psi"))  # one batch
    got = stream_trigger(spark, rows, run=3, delay="0 days", run_dir=str(tmp_path / "run")).drop("feature")
    table = spark.createDataFrame([(_day(i), v) for i, v in enumerate(psi)], "period timestamp, psi double")
    want = retrain_trigger(table, run=3).where(F.col("period") < F.lit(_day(len(psi) - 1))).select("period", "psi", "prev_psi", "retrain")
    assert sorted(got.collect()) == sorted(want.collect())


def test_trigger_without_rows(spark, tmp_path):
    _psi(spark, str(tmp_path / "psi"), [])
    assert _trigger(spark, tmp_path) == {}
