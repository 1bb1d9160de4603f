"""Stateful streaming jobs: scoring from two streams (O3) and the retrain trigger.

``score_two_streams``: orders and their line items both arrive as streams. A
line belongs to an order's application when it ships within ``lag`` of the order;
both streams carry a watermark, so the join keeps an order only until no line can
reach it any more and a line only until no order can. The lines of an order are
summed by a second stateful operator, which closes the order at the joined
watermark: an order is scored once, with every line that came in time. A line or
an order that arrives behind the watermark is dropped. State is what arrived
within ``lag`` + ``delay`` of event time.

``stream_trigger``: PSI rows (feature, period, psi) arrive in any order. Each
feature's state holds its open periods, its streak and its last closed period;
an event-time timer closes a period when the watermark has passed it, in order of
time, so the flags do not depend on the order of arrival. The state of a feature
is bounded by the periods within ``delay``.

Event times are wall-clock readings in whole seconds, carried as UTC; spans are
compared in seconds. Both are independent of the session time zone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..sources.applicants import line_item_aggregates, with_customers
from ..session import shuffle_partitions
from ..sources.tables import read_table
from .jobs import _run_dir, stream_table, wall_clock_utc

#: state on the executors' disks instead of their heaps
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # (a lookup for each write)
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_LINE_COLS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]


def _seconds(ts: str) -> Column:
    return F.timestamp_micros(F.floor(F.unix_micros(wall_clock_utc(F.col(ts))) / 1_000_000).cast("long") * 1_000_000)


def closed_orders(orders: DataFrame, lines: DataFrame, lag_days: int, delay_days: int) -> DataFrame:
    """Streaming (order columns, order_ts, line-item summary): one row per order that has a line, when the watermark closes it.

    Rows without a key or a time can't meet and are left out.
    """
    delay = f"{delay_days} days"
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice", _seconds("o_orderdate").alias("order_ts"))
    li = lines.select(*_LINE_COLS, _seconds("l_shipdate").alias("line_ts"))
    o = o.where(F.col("order_ts").isNotNull()).withWatermark("order_ts", delay)
    li = li.where(F.col("line_ts").isNotNull()).withWatermark("line_ts", delay)
    in_time = (F.col("line_ts") >= F.col("order_ts")) & (F.col("line_ts").cast("long") <= F.col("order_ts").cast("long") + F.lit(lag_days * 86_400))
    met = o.join(li, (F.col("o_orderkey") == F.col("l_orderkey")) & in_time)
    return met.groupBy("o_orderkey", "o_custkey", "o_totalprice", "order_ts").agg(*line_item_aggregates())


def partitions_by_bytes(*tables: DataFrame, bytes_each: int = 4 << 20) -> int:
    """The session's shuffle partitions, or more: one for each ``bytes_each`` bytes of the tables' files."""
    size = sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
    return max(shuffle_partitions(tables[0].sparkSession), -(-size // bytes_each))


def _started(spark: SparkSession, writer, state_partitions: int | None):
    """The started query; a stream takes the session's settings as they are at its start."""
    wanted = dict(_ROCKS)
    if state_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def score_two_streams(spark: SparkSession, sf_dir: str, prep_model, predictor: Column, digits: int = 2, lag_days: int = 120, delay_days: int = 7,
                      orders: DataFrame | None = None, lines: DataFrame | None = None, run_dir: str | None = None, state_partitions: int | None = None) -> DataFrame:
    """O3: score orders from a stream of orders and a stream of line items; returns the sink contents (id, prediction).

    ``orders`` and ``lines`` are streaming DataFrames (default: the driver's tables
    as streams). Orders that are still open stay in the state of ``run_dir`` for the
    next call. An order without a line in time, or without a customer, is not scored.

    The state is cut into ``state_partitions`` (default: what the session shuffles into, and
    one for each 4 MB of the two tables): a run keeps the number that it began with.
    """
    if state_partitions is None and orders is None and lines is None:
        state_partitions = partitions_by_bytes(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem"))
    run = _run_dir(spark, "score2", run_dir)
    orders = stream_table(spark, sf_dir, "orders") if orders is None else orders
    lines = stream_table(spark, sf_dir, "lineitem") if lines is None else lines
    closed = closed_orders(orders, lines, lag_days, delay_days)
    scored = prep_model.transform(with_customers(spark, sf_dir, closed)).select(C.ID, F.round(predictor, digits).alias("prediction"))
    writer = (
        scored.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{run}/_checkpoint").option("path", f"{run}/out")
        .trigger(availableNow=True)
    )
    q = _started(spark, writer, state_partitions)
    q.awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{run}/out")


_TRIGGER_ROWS = "feature string, period timestamp, psi double, prev_psi double, retrain boolean"
_TRIGGER_STATE = "open array<long>, psis array<double>, last double, streak int"


def _closer(threshold: float, run: int):
    """The state function: takes in a feature's rows, closes the periods that the watermark has passed."""

    def close(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        opened, psis, last, streak = state.get if state.exists else ([], [], None, 0)
        pending = dict(zip(opened, psis))
        if not state.hasTimedOut:
            for rows in batches:
                micros = rows["period"].astype("datetime64[us]").astype("int64")
                for p, v in zip(micros.tolist(), rows["psi"].tolist()):
                    # of several rows for one open period the largest counts, whatever their order
                    pending[p] = max(v, pending.get(p, v))
        now = state.getCurrentWatermarkMs() * 1000
        out = []
        for p in sorted(x for x in pending if x < now):
            v = pending.pop(p)
            streak = streak + 1 if v > threshold else 0
            out.append((key[0], p, v, last, streak >= run))
            last = v
        left = sorted(pending)
        state.update((left, [pending[p] for p in left], last, streak))
        if left:
            state.setTimeoutTimestamp(left[0] // 1000)
        frame = pd.DataFrame(out, columns=["feature", "period", "psi", "prev_psi", "retrain"])
        frame["period"] = pd.to_datetime(frame["period"], unit="us")
        yield frame.astype({"psi": "float64", "prev_psi": "float64", "retrain": "bool"})

    return close


def stream_trigger(spark: SparkSession, psi_rows: DataFrame, threshold: float = C.PSI_ALERT, run: int = 2, delay: str = "31 days", run_dir: str | None = None) -> DataFrame:
    """O7/W5 on a stream of (feature, period timestamp, psi): one row per closed period, flagged when it ends ``run`` periods above ``threshold``.

    Equals ``retrain_trigger`` for each feature on the periods before the
    watermark; later ones stay open in ``run_dir`` for the next call. Rows at or
    behind the watermark are dropped. Rows without a period or PSI are left out, a
    feature without a name is one feature.
    """
    path = _run_dir(spark, "trigger", run_dir)
    rows = psi_rows.select("feature", "period", F.col("psi").cast("double")).where(F.col("period").isNotNull() & F.col("psi").isNotNull() & ~F.isnan("psi"))
    flagged = rows.withWatermark("period", delay).groupBy("feature").applyInPandasWithState(
        _closer(float(threshold), run), _TRIGGER_ROWS, _TRIGGER_STATE, "append", "EventTimeTimeout"
    )
    q = (
        flagged.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{path}/_checkpoint").option("path", f"{path}/out")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(_TRIGGER_ROWS).parquet(f"{path}/out")
