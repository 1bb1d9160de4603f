"""Evaluation metrics (M1-M8, M12, M13, W1, W2) over (actual, predicted) columns.

Every metric takes ``by`` grouping columns (e.g. model and split), so a long
table of predictions for many models and splits is evaluated in one set of
jobs, not a Python loop. Group counts are small by contract (models x
splits); per-group scalars such as the median are joined back null-safely.

Rank metrics (Gini, KS) group by score first so tied scores move together,
then take cumulative class counts with the distributed running totals; no
single task ever holds all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import materialize
from .prefix import _cum_name, _tot_name, exact_quantiles, join_on, qcut_bucket, running_totals


def _attach(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join a one-row-per-group table to every row, NULL groups included (AQE sizes the join at run time)."""
    return join_on(df, small, by)


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), guard_zero: bool = True) -> DataFrame:
    """M1: RMSE, MAE, R2 = 1 - mean(e^2)/var_pop(y), MAPE % (zero target -> divisor 1), unrounded."""
    e = F.col(y) - F.col(yhat)
    den = F.when(F.col(y) == 0, F.lit(1.0)).otherwise(F.col(y)) if guard_zero else F.col(y)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
        (F.avg(F.abs(F.try_divide(e, den))) * F.lit(100.0)).alias("mape"),
    )


def _medians(df: DataFrame, y: str, by: Sequence[str]) -> DataFrame:
    """A row per group, written: Gini and KS both read it."""
    return materialize(exact_quantiles(df, y, [0.5], within=list(by), names=["_med"]).drop("n"), "medians")


def gini(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), medians: DataFrame | None = None) -> DataFrame:
    """M2: label = y > median(y) (strict); 2 AUC - 1 with ties counted half; one class -> 0.

    ``medians`` (by..., _med) may be passed when already computed for the same groups.
    """
    by = list(by)
    lab = _attach(df.select(*by, y, yhat), medians if medians is not None else _medians(df, y, by), by)
    pos = (F.col(y) > F.col("_med")).cast("long")
    g = lab.groupBy(*by, yhat).agg(F.sum(pos).alias("_pos"), F.sum(F.lit(1) - pos).alias("_neg"))
    r = running_totals(g, [yhat], ["_neg"], within=by)
    a = r.groupBy(*by).agg(
        F.sum(F.col("_pos") * (F.col(_cum_name("_neg")) - F.col("_neg") / F.lit(2.0))).alias("_s"),
        F.sum("_pos").alias("_P"),
        F.sum("_neg").alias("_N"),
    )
    val = F.lit(2.0) * F.col("_s") / (F.col("_P") * F.col("_N")) - F.lit(1.0)
    return a.select(*by, F.when((F.col("_P") == 0) | (F.col("_N") == 0), F.lit(0.0)).otherwise(val).alias("gini"))


def ks(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), strict: bool = False, medians: DataFrame | None = None) -> DataFrame:
    """M3/M4: max |cum good share - cum bad share| by descending score.

    good = y >= median (``strict``: y > median). An empty class gives 0.
    """
    by = list(by)
    lab = _attach(df.select(*by, y, yhat), medians if medians is not None else _medians(df, y, by), by)
    good = ((F.col(y) > F.col("_med")) if strict else (F.col(y) >= F.col("_med"))).cast("long")
    g = lab.groupBy(*by, yhat).agg(F.sum(good).alias("_gd"), F.sum(F.lit(1) - good).alias("_bd"))
    r = running_totals(g, [yhat], ["_gd", "_bd"], within=by, descending=True)
    gap = F.abs(F.try_divide(F.col(_cum_name("_gd")), F.col(_tot_name("_gd"))) - F.try_divide(F.col(_cum_name("_bd")), F.col(_tot_name("_bd"))))
    a = r.groupBy(*by).agg(F.max(gap).alias("_ks"), F.max(_tot_name("_gd")).alias("_g"), F.max(_tot_name("_bd")).alias("_b"))
    return a.select(*by, F.when((F.col("_g") == 0) | (F.col("_b") == 0), F.lit(0.0)).otherwise(F.col("_ks")).alias("ks"))


def decile_edges(df: DataFrame, yhat: str, by: Sequence[str] = (), q: int = 10) -> DataFrame:
    """Exact percentile edges 0, 1/q, ..., 1 of the score per group, duplicates dropped."""
    names = [f"_e{i}" for i in range(q + 1)]
    e = exact_quantiles(df, yhat, [i / q for i in range(q + 1)], within=list(by), names=names)
    return e.select(*by, F.array_sort(F.array_distinct(F.array(*names))).alias("_edges"))


def with_decile(df: DataFrame, yhat: str, by: Sequence[str] = (), q: int = 10, name: str = "decile") -> DataFrame:
    """Pandas ``qcut(q, duplicates='drop') + 1`` bucket; equal scores never split."""
    by = list(by)
    out = _attach(df, decile_edges(df, yhat, by, q), by)
    return out.withColumn(name, qcut_bucket(F.col(yhat), F.col("_edges"))).drop("_edges")


def decile_table(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """M5: per decile n, mean_pred, mean_actual (2 dp), min/max pred, error % from the rounded means."""
    by = list(by)
    d = with_decile(df.select(*by, y, yhat), yhat, by)
    t = d.groupBy(*by, "decile").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(yhat), 2).alias("mean_pred"),
        F.round(F.avg(y), 2).alias("mean_actual"),
        F.round(F.min(yhat), 6).alias("min_pred"),
        F.round(F.max(yhat), 6).alias("max_pred"),
    )
    err = (F.col("mean_pred") - F.col("mean_actual")) / F.col("mean_actual") * F.lit(100.0)
    return t.withColumn("error_pct", F.round(err, 2))


def decile_bias(df: DataFrame, y: str, yhat: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """M6: per decile n, actual mean, predicted mean, bias rounded to units, model label."""
    by = list(by)
    d = with_decile(df.select(*by, y, yhat), yhat, by, name="decil")
    t = d.groupBy(*by, "decil").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("actual_mean"), F.avg(yhat).alias("pred_mean"))
    return t.select(
        *by, "decil", "n", F.round("actual_mean", 6).alias("actual_mean"), F.round("pred_mean", 6).alias("pred_mean"),
        F.round(F.col("pred_mean") - F.col("actual_mean"), 0).alias("sesgo"), F.lit(label).alias("modelo"),
    )


def evaluate(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), ks_strict: bool = False) -> DataFrame:
    """M1 + M2 + M3 per group, unrounded."""
    by = list(by)
    med = _medians(df, y, by)  # one exact-median pass shared by Gini and KS
    reg = regression_metrics(df, y, yhat, by)
    g = gini(df, y, yhat, by, medians=med)
    k = ks(df, y, yhat, by, strict=ks_strict, medians=med)
    return join_on(join_on(reg, g, by), k, by)


def metrics_report(preds: DataFrame, y: str = C.TARGET, yhat: str = "pred", model: str = "model", split: str = C.SPLIT,
                   train: str = C.TRAIN, test: str = C.TEST) -> DataFrame:
    """M7 + M12: one row per model with train_/test_ RMSE, MAE (2 dp), R2 (4 dp), MAPE (2 dp), Gini, KS (4 dp),
    the R2 gap and the overfit diagnosis (< 0.03 stable, < 0.08 mild, else overfit)."""
    m = evaluate(preds, y, yhat, [model, split])
    rnd = {"rmse": 2, "mae": 2, "r2": 4, "mape": 2, "gini": 4, "ks": 4}
    aggs = []
    for pfx, s in (("train", train), ("test", test)):
        for k, d in rnd.items():
            aggs.append(F.round(F.max(F.when(F.col(split) == s, F.col(k))), d).alias(f"{pfx}_{k}"))
    wide = m.groupBy(model).agg(*aggs)
    gap = F.col("train_r2") - F.col("test_r2")
    diag = F.when(gap < F.lit(C.OVERFIT_STABLE), F.lit("estable")).when(gap < F.lit(C.OVERFIT_MILD), F.lit("leve")).otherwise(F.lit("sobreajuste"))
    return wide.select("*", F.round(gap, 4).alias("r2_gap"), diag.alias("diagnosis"))


def compute_metrics(df: DataFrame, y: str, yhat: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """M8: R2 (4 dp), RMSE and MAE (0 dp), MAPE without zero guard (2 dp), KS with y > median, Gini (4 dp)."""
    by = list(by)
    reg = regression_metrics(df, y, yhat, by, guard_zero=False)
    med = _medians(df, y, by)
    g, k = gini(df, y, yhat, by, medians=med), ks(df, y, yhat, by, strict=True, medians=med)
    out = join_on(join_on(reg, g, by), k, by)
    return out.select(
        *by, F.lit(label).alias("modelo"), F.round("r2", 4).alias("r2"), F.round("rmse", 0).alias("rmse"),
        F.round("mae", 0).alias("mae"), F.round("mape", 2).alias("mape"), F.round("ks", 4).alias("ks"), F.round("gini", 4).alias("gini"),
    )


def rank_models(report: DataFrame, metric: str = "test_r2", model: str = "model") -> DataFrame:
    """Rank by a metric, best first (the report has one row per model)."""
    from pyspark.sql import Window

    w = Window.orderBy(F.col(metric).desc(), F.col(model))
    return report.select(F.rank().over(w).cast("bigint").alias("rank"), model, metric)


def overfit_gap(train_value, test_value, kind: str = "r2"):
    """M12 variants on two columns: R2 gap status, or RMSE gap % (< 10 stable)."""
    if kind == "r2":
        gap = train_value - test_value
        return F.when(F.abs(gap) < F.lit(0.05), F.lit("estable")).otherwise(F.lit("sobreajuste"))
    gap = (test_value - train_value) / train_value * F.lit(100.0)
    return F.when(gap < F.lit(10.0), F.lit("estable")).otherwise(F.lit("sobreajuste"))
