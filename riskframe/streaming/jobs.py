"""Structured Streaming jobs.

O3: orders arrive as a file stream; each micro-batch becomes applicants by
stream-static joins (aggregated line items, customers, nations), is scored
by the fitted preprocessing model and a predictor column (stateless), and is
appended to a Parquet sink. ``availableNow`` drains what is there and stops.

O8: events arrive as a file stream. Event time is carried as a TIMESTAMP that
holds the wall-clock value as UTC (independent of the session time zone); it
has the watermark and the windows are cut on it, so a row that arrives more
than ``watermark`` after its window closed is dropped and the state of closed
windows is evicted. Update mode hands each micro-batch only the windows that
changed; their PSI rows are written under the batch's epoch (a replayed batch
overwrites its own rows) and readers take the latest epoch of each window.

Sinks and checkpoints live in ``run_dir``. A caller that passes the same
folder again resumes from its offsets and state; without one, each call gets a
fresh folder under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators.stability import histogram_bin
from ..session import ensure_checkpoint_dir, materialize
from ..sources.applicants import applicants, line_item_summary
from ..sources.tables import read_table

_DRIFT_ROWS = "window_start string, n_cur long, psi double, n_bins_used int"


def _run_dir(spark: SparkSession, name: str, given: str | None) -> str:
    base = ensure_checkpoint_dir(spark)
    return given.rstrip("/") if given else f"{base.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_bytes: str | None = None) -> DataFrame:
    """A driver table read as a file stream (schema from the batch table, no inference).

    ``max_bytes`` bounds a micro-batch by size; without it, one batch takes what is there.
    """
    reader = spark.readStream.schema(read_table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet")
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(sf_dir)


def stream_score(spark: SparkSession, sf_dir: str, prep_model, predictor: Column, digits: int = 2,
                 orders: DataFrame | None = None, run_dir: str | None = None) -> DataFrame:
    """O3: score applicants arriving as an orders stream; returns the sink contents.

    ``orders`` is a streaming DataFrame (default: the driver's table as a stream).
    """
    run = _run_dir(spark, "score", run_dir)
    # the static side of a stream-static join is re-evaluated every micro-batch:
    # write the line-item summary once and join each batch against the written table
    summary = materialize(line_item_summary(spark, sf_dir), "line_item_summary")
    source = stream_table(spark, sf_dir, "orders") if orders is None else orders
    apps = applicants(spark, sf_dir, orders=source, per_order=summary)
    scored = prep_model.transform(apps).select(C.ID, F.round(predictor, digits).alias("prediction"))
    q = (
        scored.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{run}/_checkpoint").option("path", f"{run}/out")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{run}/out")


def wall_clock_utc(ts: Column) -> Column:
    """TIMESTAMP_NTZ -> TIMESTAMP of the same wall-clock reading in UTC, whatever the session time zone."""
    seconds = F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return F.timestamp_micros(seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long"))


def stream_drift(spark: SparkSession, sf_dir: str, edges: list[float], value: str = "value", ts: str = "ts",
                 window: str = "7 days", watermark: str = "1 day", n_ref: int | None = None, ref_counts: dict | None = None,
                 events: DataFrame | None = None, run_dir: str | None = None) -> DataFrame:
    """PSI of every event-time window against reference edges, kept current per micro-batch.

    ``edges`` are the reference percentile edges (sorted, distinct: at most
    n_bins + 1 numbers); ``ref_counts`` maps bin -> reference count and
    ``n_ref`` is the reference size. ``events`` is a streaming DataFrame
    (default: the driver's table as a stream). Windows are whole days.
    """
    run = _run_dir(spark, "drift", run_dir)
    ev = stream_table(spark, sf_dir, "events") if events is None else events
    e = F.array(*[F.lit(float(x)) for x in edges])
    timed = ev.select(wall_clock_utc(F.col(ts)).alias("_ts"), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counts = (
        timed.withWatermark("_ts", watermark)
        .groupBy(F.window("_ts", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_cur"), *[F.count_if(histogram_bin(F.col("_v"), e) == F.lit(b)).alias(f"c{b}") for b in range(len(edges) - 1)])
    )
    m = len(edges) - 1
    psi = F.lit(0.0)
    for b in range(m):
        ref = F.lit((ref_counts.get(b, 0) / n_ref) if ref_counts.get(b, 0) else C.PSI_EPS)
        cur = F.when(F.col(f"c{b}") == 0, F.lit(C.PSI_EPS)).otherwise(F.col(f"c{b}") / F.col("n_cur"))
        psi = psi + (cur - ref) * F.log(cur / ref)
    start = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros("w.start") / 86_400_000_000).cast("int"))

    def publish(batch: DataFrame, epoch: int) -> None:
        out = batch.select(start.cast("string").alias("window_start"), "n_cur", F.round(psi, 4).alias("psi"), F.lit(m).alias("n_bins_used"))
        out.write.mode("overwrite").parquet(f"{run}/psi/epoch={epoch}")

    # the folder exists, with its schema, also when no event has arrived yet
    spark.createDataFrame([], _DRIFT_ROWS).write.mode("ignore").parquet(f"{run}/psi/epoch=-1")
    q = (
        counts.writeStream.outputMode("update").foreachBatch(publish)
        .option("checkpointLocation", f"{run}/_checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    rows = spark.read.schema(f"{_DRIFT_ROWS}, epoch long").parquet(f"{run}/psi")
    latest = F.max_by(F.struct("n_cur", "psi", "n_bins_used"), "epoch").alias("s")
    return rows.groupBy("window_start").agg(latest).select("window_start", "s.*")
