"""Profiling operators.

Pairwise statistics are one aggregate with one expression per pair (Spark's
``corr`` skips rows where either side is NULL: pairwise-complete, like pandas).
Order statistics go through the distributed exact quantiles; cumulative
shares go through the distributed running totals.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from .prefix import _cum_name, _tot_name, exact_quantiles, running_totals, unpivot

DESCRIBE_PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    """A5: category frequency and share (% of all rows, 2 dp), most frequent first."""
    base = df.where(F.col(column).isNotNull()) if dropna else df
    counts = base.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select(
        column, "n", X.pct(F.col("n"), F.col("_all")).alias("pct")
    ).orderBy(F.col("n").desc(), F.col(column))


def describe(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = DESCRIBE_PROBS, digits: int = 6) -> DataFrame:
    """Count, mean, sd, min, percentiles, max per column (long format, one row per column)."""
    long = unpivot(df, columns).where(F.col("value").isNotNull())
    names = [f"p{int(round(p * 100)):02d}" for p in probs]
    q = exact_quantiles(long, "value", probs, within=["feature"], names=names)
    m = long.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    out = q.join(m, "feature")
    return out.select(
        F.col("feature").alias("variable"),
        F.col("n").alias("count"),
        *[F.round(c, digits).alias(c) for c in ["mean", "std", "min", *names, "max"]],
    )


def bias_corrected_moments(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Sample skewness G1 and excess kurtosis G2 (pandas ``skew``/``kurt``).

    Spark's ``skewness``/``kurtosis`` are the population forms g1, g2:
    G1 = g1 * sqrt(n (n-1)) / (n-2), G2 = (n-1) / ((n-2)(n-3)) * ((n+1) g2 + 6).
    """
    long = unpivot(df, columns).where(F.col("value").isNotNull())
    m = long.groupBy("feature").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2")
    )
    n = F.col("n")
    g1 = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    return m.select(F.col("feature").alias("variable"), F.round(g1, digits).alias("skew"), F.round(g2, digits).alias("kurt"))


def histogram(df: DataFrame, column: str, bins: int = 50, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width histogram over [min, max] (or given range), last bin closed; count and density.

    Every bin appears, empty ones with 0.
    """
    x = F.col(column)
    base = df.where(x.isNotNull())
    rng = base.agg(
        (F.lit(float(lo)) if lo is not None else F.min(x)).alias("_lo"), (F.lit(float(hi)) if hi is not None else F.max(x)).alias("_hi"),
        F.count(F.lit(1)).alias("_n"),
    )
    flat = F.col("_lo") == F.col("_hi")  # a constant column: the range is widened by one half on both sides
    rng = rng.select(F.when(flat, F.col("_lo") - F.lit(0.5)).otherwise(F.col("_lo")).alias("_lo"), F.when(flat, F.col("_hi") + F.lit(0.5)).otherwise(F.col("_hi")).alias("_hi"), "_n")
    k = F.lit(int(bins))
    b = F.least(k - 1, F.floor((x - F.col("_lo")) * k / (F.col("_hi") - F.col("_lo"))).cast("int"))
    in_range = (x >= F.col("_lo")) & (x <= F.col("_hi"))
    counts = base.crossJoin(F.broadcast(rng)).where(in_range).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = rng.select(F.explode(F.sequence(F.lit(0), k - 1)).alias("bin"), "_lo", "_hi", "_n")
    w = (F.col("_hi") - F.col("_lo")) / k
    return grid.join(counts, "bin", "left").select(
        "bin",
        F.round(F.col("_lo") + F.col("bin") * w, 6).alias("lower"),
        F.round(F.col("_lo") + (F.col("bin") + 1) * w, 6).alias("upper"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
        F.round(F.try_divide(F.coalesce(F.col("n"), F.lit(0)), F.col("_n") * w), 12).alias("density"),
    )


class PairwiseMoments:
    """Pairwise-complete sums of centred columns: for every pair (a, b), over the rows
    where both are non-NULL: n, sum a, sum a^2, sum a*b (shifted by the column means)."""

    def __init__(self, cols, mu, n, sa, saa, sab):
        self.cols, self.mu, self.n, self.sa, self.saa, self.sab = cols, mu, n, sa, saa, sab
        self.ix = {c: i for i, c in enumerate(cols)}

    def corr(self, a: str, b: str) -> float | None:
        i, j = self.ix[a], self.ix[b]
        n, sa, sb = self.n[i, j], self.sa[i, j], self.sa[j, i]
        num = n * self.sab[i, j] - sa * sb
        den = (n * self.saa[i, j] - sa * sa) * (n * self.saa[j, i] - sb * sb)
        if n < 2:
            return None
        return float(num / np.sqrt(den)) if den > 0 else float("nan")

    def slope_intercept(self, y: str, x: str) -> tuple[float | None, float | None]:
        """Least-squares y = a + b x over rows where both are present."""
        i, j = self.ix[y], self.ix[x]
        n, sy, sx = self.n[i, j], self.sa[i, j], self.sa[j, i]
        sxx, sxy = self.saa[j, i], self.sab[i, j]
        den = n * sxx - sx * sx
        if n < 2 or den <= 0:
            return None, None
        b = (n * sxy - sx * sy) / den
        a = (sy - b * sx) / n + self.mu[i] - b * self.mu[j]
        return float(b), float(a)


def _pairwise_partials(cols: list[str], mu: np.ndarray):
    p = len(cols)

    def run(batches):
        import pandas as pd

        acc = np.zeros((4, p, p))
        for pdf in batches:
            if not len(pdf):
                continue
            x = pdf[cols].to_numpy(dtype=float) - mu
            m = (~np.isnan(x)).astype(float)
            x0 = np.where(m > 0, x, 0.0)
            acc[0] += m.T @ m
            acc[1] += x0.T @ m
            acc[2] += (x0 * x0).T @ m
            acc[3] += x0.T @ x0
        yield pd.DataFrame({"k": np.arange(4 * p * p, dtype=np.int64), "v": acc.ravel()})

    return run


def pairwise_moments(df: DataFrame, cols: Sequence[str]) -> PairwiseMoments:
    """One aggregate for the column means, one Arrow pass for the pairwise sums.

    Every task reduces its rows to 4 p x p blocks with NumPy; a ``groupBy`` sums
    the blocks, so 4 p^2 numbers reach the driver whatever the row count.
    Centring by the column means keeps the sums well conditioned.
    """
    from pyspark.sql import types as T

    cols = list(cols)
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    row = data.agg(*[F.avg(c).alias(c) for c in cols]).first()
    mu = np.array([row[c] if row[c] is not None else 0.0 for c in cols])
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType())])
    sums = data.mapInPandas(_pairwise_partials(cols, mu), schema).groupBy("k").agg(F.sum("v").alias("v")).collect()
    p = len(cols)
    flat = np.zeros(4 * p * p)
    for r in sums:
        flat[r["k"]] = r["v"]
    blocks = flat.reshape(4, p, p)
    return PairwiseMoments(cols, mu, blocks[0], blocks[1], blocks[2], blocks[3])


def _pairs(cols: Sequence[str]):
    cols = list(cols)
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def _pair_table(wide: DataFrame, pairs, name: str) -> DataFrame:
    parts = [F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(f"{a}__{b}").alias(name)) for a, b in pairs]
    return wide.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def missing_correlation(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson correlation of the 0/1 NULL indicators, every pair, one pass."""
    ind = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in columns])
    pm = pairwise_moments(ind, columns)
    rows = [(a, b, pm.corr(a, b)) for a, b in _pairs(columns)]
    return df.sparkSession.createDataFrame(rows, "var_a string, var_b string, corr double").select(
        "var_a", "var_b", F.round("corr", digits).alias("corr")
    )


def co_missing_rate(df: DataFrame, a: str, b: str) -> DataFrame:
    """A10: share of rows where both columns agree on being NULL."""
    same = (F.col(a).isNull() == F.col(b).isNull()).cast("double")
    return df.agg(F.round(F.avg(same), 6).alias("agreement"), F.count(F.lit(1)).alias("n"))


def target_by_category(df: DataFrame, category: str, target: str = C.TARGET, top: int = 20) -> DataFrame:
    """Mean, exact median and count of the target per category (NULL category left out),
    highest mean first, top ``top`` (a top-k report)."""
    base = df.where(F.col(category).isNotNull())
    med = exact_quantiles(base, target, [0.5], within=[category], names=["median"])
    means = base.groupBy(category).agg(F.avg(target).alias("mean"))
    return (
        means.join(med, category)
        .select(category, F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.col("n").alias("count"))
        .orderBy(F.col("mean").desc(), F.col(category))
        .limit(top)
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Pairwise-complete Pearson correlation for every pair of columns (upper triangle)."""
    pm = pairwise_moments(df, columns)
    rows = [(a, b, pm.corr(a, b)) for a, b in _pairs(columns)]
    return df.sparkSession.createDataFrame(rows, "var_a string, var_b string, corr double").select(
        "var_a", "var_b", F.round("corr", digits).alias("corr")
    )


def correlation_with_target(df: DataFrame, columns: Sequence[str], target: str = C.TARGET, top: int | None = None, log_target: bool = False, digits: int = 6) -> DataFrame:
    """r(x, y) per feature (and r(x, log y)), strongest first; ``top`` keeps a top-k."""
    cols = list(columns)
    data = df.select(*cols, F.col(target).alias("_y"), *([F.log(F.col(target)).alias("_ly")] if log_target else []))
    pm = pairwise_moments(data, [*cols, "_y", *(["_ly"] if log_target else [])])
    rows = [(c, pm.corr(c, "_y"), pm.corr(c, "_ly") if log_target else None) for c in cols]
    out = df.sparkSession.createDataFrame(rows, "feature string, r_target double, r_log_target double")
    sel = [F.col("feature"), F.round("r_target", digits).alias("r_target")]
    if log_target:
        sel.append(F.round("r_log_target", digits).alias("r_log_target"))
    out = out.select(*sel).orderBy(F.abs(F.col("r_target")).desc(), F.col("feature"))
    return out.limit(top) if top else out


def linear_trend(df: DataFrame, columns: Sequence[str], target: str = C.TARGET, digits: int = 6) -> DataFrame:
    """Degree-1 least-squares fit of the target on each feature (rows complete in both)."""
    cols = list(columns)
    pm = pairwise_moments(df.select(*cols, F.col(target).alias("_y")), [*cols, "_y"])
    rows = [(c, *pm.slope_intercept("_y", c)) for c in cols]
    out = df.sparkSession.createDataFrame(rows, "feature string, slope double, intercept double")
    return out.select("feature", F.round("slope", digits).alias("slope"), F.round("intercept", digits).alias("intercept"))


def split_medians(df: DataFrame, columns: Sequence[str], split: str = C.SPLIT, a: str = C.TRAIN, b: str = C.TEST) -> DataFrame:
    """Exact median per split and column; |a - b| / (|a| + 1e-6) * 100."""
    long = unpivot(df, columns, ids=[split])
    med = exact_quantiles(long, "value", [0.5], within=["feature", split], names=["median"])
    piv = med.groupBy("feature").agg(
        F.max(F.when(F.col(split) == a, F.col("median"))).alias("ma"), F.max(F.when(F.col(split) == b, F.col("median"))).alias("mb")
    )
    diff = F.abs(F.col("ma") - F.col("mb")) / (F.abs(F.col("ma")) + F.lit(1e-6)) * F.lit(100.0)
    return piv.select(
        F.col("feature").alias("variable"),
        F.round("ma", 6).alias("median_train"),
        F.round("mb", 6).alias("median_test"),
        F.round(diff, 6).alias("diff_pct"),
    )


def pareto(df: DataFrame, category: str, levels: Sequence[float] = (80.0, 95.0)) -> DataFrame:
    """Categories by frequency (NULL left out): how many are needed to pass each coverage level.

    The k-th running total of counts sorted descending is the sum of the k
    largest counts, so tie order does not matter.
    """
    counts = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, ["n", category], ["n"], descending=True)
    cum_pct = F.col(_cum_name("n")) / F.col(_tot_name("n")) * F.lit(100.0)
    return ranked.agg(
        F.count(F.lit(1)).alias("n_categories"),
        *[(F.count_if(cum_pct <= F.lit(float(lv))) + F.lit(1)).alias(f"n_for_{int(lv)}") for lv in levels],
    )


def kolmogorov_sf(z: Column, terms: int = 100) -> Column:
    """Kolmogorov distribution tail 2 * sum_k (-1)^(k-1) exp(-2 k^2 z^2), clamped to [0, 1]."""
    s = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * z * z),
    )
    return F.when(z <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * s)))


def ks_two_sample(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """D = max |F_a(x) - F_b(x)| over pooled values, with the asymptotic two-sided p.

    Values are grouped first so ties move together; cumulative shares come
    from the distributed running totals.
    """
    v = df.where(F.col(value).isNotNull() & F.col(group).isin(a, b))
    counts = v.groupBy(value).agg(
        F.count_if(F.col(group) == F.lit(a)).alias("ca"), F.count_if(F.col(group) == F.lit(b)).alias("cb")
    )
    ranked = running_totals(counts, [value], ["ca", "cb"])
    gap = F.abs(F.col(_cum_name("ca")) / F.col(_tot_name("ca")) - F.col(_cum_name("cb")) / F.col(_tot_name("cb")))
    d = ranked.agg(F.max(gap).alias("d"), F.max(_tot_name("ca")).alias("n_a"), F.max(_tot_name("cb")).alias("n_b"))
    en = F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))
    return d.select(
        "n_a", "n_b", F.round("d", 6).alias("ks_stat"), F.round(kolmogorov_sf(F.sqrt(en) * F.col("d")), 6).alias("p_value")
    )


def residual_summary(df: DataFrame, actual: str, predicted: str, bins: int = 50) -> tuple[DataFrame, DataFrame]:
    """Mean error and the histogram of y - y_hat."""
    e = df.select((F.col(actual) - F.col(predicted)).alias("error"))
    mean = e.agg(F.round(F.avg("error"), 6).alias("mean_error"), F.round(F.stddev_samp("error"), 6).alias("sd_error"))
    return mean, histogram(e, "error", bins)


def qq_line(grid: DataFrame, theoretical: str = "theoretical", sample: str = "sample") -> DataFrame:
    """Least-squares line through the points of a Q-Q grid, and their correlation (the plot's straight line)."""
    y, x = F.col(sample), F.col(theoretical)
    return grid.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.corr(y, x), 6).alias("r"))
