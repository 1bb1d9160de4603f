"""Population stability.

PSI for every feature (and every period) is one set of jobs, not a loop:
values are unpivoted to (feature, value) rows, the reference edges are exact
percentiles per feature, each value finds its bin by comparing with at most
n_bins + 1 edges (one row per feature, written once; Spark sizes that join), and both samples are counted per
(feature, group, bin) in one aggregate, written once too. What follows works on those counts alone.

NumPy ``histogram`` rules are kept: bins are left-closed with the last one
closed, values outside the reference range are dropped from the bins but stay
in the denominator, duplicate edges collapse (a constant feature has zero bins
and PSI 0), and an empty bin counts as a 1e-4 share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from ..session import materialize
from .prefix import exact_quantiles, join_on, unpivot


def reference_edges(ref_long: DataFrame, n_bins: int = 10, key: str = "feature") -> DataFrame:
    """Exact percentile edges 0, 1/n, ..., 1 of the reference values, duplicates dropped."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    names = [f"_e{i}" for i in range(n_bins + 1)]
    q = exact_quantiles(ref_long, "value", probs, within=[key], names=names)
    return q.select(key, F.col("n").alias("n_ref"), F.array_sort(F.array_distinct(F.array(*names))).alias("edges"))


def histogram_bin(x: Column, edges: Column) -> Column:
    """NumPy histogram bin of x for sorted edges: left-closed, last bin closed, NULL when outside."""
    m = F.size(edges)
    j = F.size(F.filter(edges, lambda e: e <= x)) - F.lit(1)
    j = F.when(x == F.element_at(edges, -1), m - F.lit(2)).otherwise(j)
    return F.when((m >= 2) & (j >= 0) & (j <= m - F.lit(2)), j)


def psi_long(ref_long: DataFrame, cur_long: DataFrame, n_bins: int = 10, key: str = "feature", by: Sequence[str] = ()) -> DataFrame:
    """PSI of ``cur`` against ``ref`` per ``key`` (and per ``by`` group of ``cur``).

    ``ref_long``: (key, value); ``cur_long``: (key, *by, value); NULL values are dropped.
    Returns key, by..., psi (4 dp), status, n_bins_used.
    """
    by = list(by)
    # the edges and the counts are a few rows per key and group; written once, so the samples are read twice in all
    edges = materialize(reference_edges(ref_long.where(F.col("value").isNotNull()), n_bins, key), "psi_edges")
    no_group = [F.lit(None).cast(cur_long.schema[c].dataType).alias(c) for c in by]
    ref_rows = ref_long.select(key, *no_group, "value", F.lit(True).alias("_ref"))
    rows = ref_rows.unionAll(cur_long.select(key, *by, "value", F.lit(False).alias("_ref")))
    binned = join_on(rows, edges.select(key, "edges"), [key], "left")
    # one aggregate for bins and totals: values outside every bin are counted under a NULL bin, NULL values not at all
    # (their group stays, with a count of 0: every key and group of the current sample reports)
    counts = binned.groupBy("_ref", key, *by, histogram_bin(F.col("value"), F.col("edges")).alias("bin")).agg(F.count("value").alias("c"))
    counts = materialize(counts, "psi_counts")
    ref_counts = counts.where(F.col("_ref") & F.col("bin").isNotNull()).select(key, "bin", F.col("c").alias("c_ref"))
    cur_counts = counts.where(~F.col("_ref")).select(key, *by, "bin", F.col("c").alias("c_cur"))
    groups = cur_counts.groupBy(key, *by).agg(F.sum("c_cur").alias("n_cur"))

    heads = join_on(groups, edges, [key], "left")
    grid = heads.where(F.size("edges") >= 2).select(
        key, *by, "n_ref", "n_cur", F.explode(F.sequence(F.lit(0), F.size("edges") - F.lit(2))).alias("bin")
    )
    cells = join_on(join_on(grid, ref_counts, [key, "bin"], "left"), cur_counts, [key, *by, "bin"], "left")
    c_ref = F.coalesce(F.col("c_ref"), F.lit(0))
    c_cur = F.coalesce(F.col("c_cur"), F.lit(0))
    e = F.when(c_ref == 0, F.lit(C.PSI_EPS)).otherwise(c_ref / F.col("n_ref"))
    a = F.when(c_cur == 0, F.lit(C.PSI_EPS)).otherwise(c_cur / F.col("n_cur"))
    term = (a - e) * F.log(a / e)
    sums = cells.groupBy(key, *by).agg(F.sum(term).alias("_psi"), F.count(F.lit(1)).alias("n_bins_used"))
    out = join_on(heads.select(key, *by), sums, [key, *by], "left")
    # 0.0 only where the reference has fewer than two edges
    psi = F.round(F.coalesce(F.col("_psi"), F.lit(0.0)), 4)
    return out.select(key, *by, psi.alias("psi"), X.psi_status(psi).alias("status"), F.coalesce("n_bins_used", F.lit(0)).alias("n_bins_used"))


def psi(ref: DataFrame, cur: DataFrame, column: str, n_bins: int = 10) -> DataFrame:
    """M9: PSI of one column, cur vs ref (one row)."""
    r = ref.select(F.lit(column).alias("feature"), F.col(column).cast("double").alias("value"))
    c = cur.select(F.lit(column).alias("feature"), F.col(column).cast("double").alias("value"))
    return psi_long(r, c, n_bins).drop("feature")


def psi_by_feature(ref: DataFrame, cur: DataFrame, features: Sequence[str], n_bins: int = 10) -> DataFrame:
    """PSI per shared feature (NULL dropped per feature), highest first."""
    feats = [f for f in features if f in ref.columns and f in cur.columns]
    return psi_long(unpivot(ref, feats), unpivot(cur, feats), n_bins).orderBy(F.col("psi").desc(), F.col("feature"))


def psi_by_period(
    df: DataFrame, value: str, period: Column, reference: Column, n_bins: int = 10, retrain_at: float = C.PSI_ALERT
) -> DataFrame:
    """PSI of every period against the reference rows, with OK / ADVERTENCIA / REENTRENAR.

    ``period`` is a column expression (e.g. ``date_trunc('month', ts)``),
    ``reference`` a boolean expression selecting the reference rows.
    """
    base = df.select(F.lit(value).alias("feature"), F.col(value).cast("double").alias("value"), period.alias("period"), reference.alias("_ref"))
    ref_long = base.where(F.col("_ref")).select("feature", "value")
    cur_long = base.select("feature", "period", "value")
    out = psi_long(ref_long, cur_long, n_bins, by=["period"])
    status = (
        F.when(F.col("psi") < F.lit(C.PSI_WARN), F.lit(C.PSI_OK_LABEL))
        .when(F.col("psi") < F.lit(retrain_at), F.lit(C.PSI_WARN_LABEL))
        .otherwise(F.lit(C.PSI_RETRAIN_LABEL))
    )
    return out.select("period", "psi", status.alias("status"), "n_bins_used")


def retrain_trigger(psi_periods: DataFrame, threshold: float = C.PSI_ALERT, run: int = 2, order: str = "period") -> DataFrame:
    """Flag periods that close ``run`` consecutive periods with PSI above ``threshold``.

    The window runs over the per-period table (one row per period: its size is
    the number of periods, not the data).
    """
    w = Window.orderBy(order)
    above = (F.col("psi") > F.lit(threshold)).cast("int")
    streak = F.sum(above).over(w.rowsBetween(-(run - 1), 0))
    full = F.count(F.lit(1)).over(w.rowsBetween(-(run - 1), 0))
    return psi_periods.select(
        order, "psi", ((streak == F.lit(run)) & (full == F.lit(run))).alias("retrain"),
        F.lag("psi").over(w).alias("prev_psi"),
    )


def rule_rows(wide: DataFrame, rules: Sequence[tuple[str, Column, float]]) -> DataFrame:
    """One (rule, value, threshold, triggered) row per rule over a one-row table; triggered when value > threshold."""
    rows = [F.struct(F.lit(n).alias("rule"), v.cast("double").alias("value"), F.lit(float(t)).alias("threshold")) for n, v, t in rules]
    out = wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    return out.select("rule", F.round("value", 4).alias("value"), "threshold", (F.col("value") > F.col("threshold")).alias("triggered"))
