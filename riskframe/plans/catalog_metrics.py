"""Registered evaluation queries (M1-M13, W1, W2) and their SQL twins.

Predictions come from closed-form scorers on the applicants table, so the
SQL twin needs no fitted model; both engines score every applicant.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import metrics as M
from ..sources.applicants import applicants
from . import sqlparts as S
from .catalog import base, register

# closed-form scorers: name -> (Spark expression, SQL expression)
SCORERS = {
    "lin_a": (lambda: F.lit(2.0) * F.col("x10") + F.lit(0.5) * F.coalesce(F.col("x1"), F.lit(0.0)), "2.0e0 * x10 + 0.5e0 * coalesce(x1, 0.0e0)"),
    "lin_b": (lambda: F.lit(3.0) * F.col("x10"), "3.0e0 * x10"),
}


def predictions(spark, sf, models=("lin_a",), one_pass=False, written=None):
    """Long table (model, base, target, pred) for the chosen scorers; ``one_pass``: read once, so nothing is written first; ``written``: the applicants that the caller has written."""
    a = written if written is not None else applicants(spark, sf) if one_pass else base(spark, sf)
    parts = [a.select(F.lit(m).alias("model"), C.SPLIT, C.TARGET, SCORERS[m][0]().alias("pred")) for m in models]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pr_cte(models=("lin_a",)):
    parts = [f"SELECT '{m}' AS model, base, target AS y, {SCORERS[m][1]} AS p FROM applicants" for m in models]
    return f"pr AS ({S.union_all(parts)})"


def _metric_ctes(by="model, base"):
    jb = " AND ".join(f"pr.{b.strip()} = med.{b.strip()}" for b in by.split(","))
    prb = ", ".join(f"pr.{b.strip()}" for b in by.split(","))
    return [
        f"med AS (SELECT {by}, quantile_cont(y, 0.5e0) AS med FROM pr GROUP BY {by})",
        f"""reg AS (SELECT {by}, count(*) AS n, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae,
              1.0e0 - avg((y - p) * (y - p)) / var_pop(y) AS r2,
              avg(abs((y - p) / CASE WHEN y = 0 THEN 1.0e0 ELSE y END)) * 100.0e0 AS mape,
              avg(abs((y - p) / y)) * 100.0e0 AS mape_raw FROM pr GROUP BY {by})""",
        f"""gg AS (SELECT {prb}, p, sum(CAST(y > med AS BIGINT)) AS pos, sum(1 - CAST(y > med AS BIGINT)) AS neg
              FROM pr JOIN med ON {jb} GROUP BY {prb}, p)""",
        f"gc AS (SELECT {by}, pos, neg, sum(neg) OVER (PARTITION BY {by} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM gg)",
        f"""gini AS (SELECT {by}, CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.0e0
              ELSE 2.0e0 * sum(pos * (cn - neg / 2.0e0)) / (sum(pos) * sum(neg)) - 1.0e0 END AS gini FROM gc GROUP BY {by})""",
        *[
            f"""kg{sfx} AS (SELECT {prb}, p, sum(CAST(y {op} med AS BIGINT)) AS gd, sum(1 - CAST(y {op} med AS BIGINT)) AS bd
              FROM pr JOIN med ON {jb} GROUP BY {prb}, p),
            kc{sfx} AS (SELECT {by}, sum(gd) OVER w / sum(gd) OVER (PARTITION BY {by}) AS fg, sum(bd) OVER w / sum(bd) OVER (PARTITION BY {by}) AS fb,
              sum(gd) OVER (PARTITION BY {by}) AS tg, sum(bd) OVER (PARTITION BY {by}) AS tb
              FROM kg{sfx} WINDOW w AS (PARTITION BY {by} ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
            ks{sfx} AS (SELECT {by}, CASE WHEN max(tg) = 0 OR max(tb) = 0 THEN 0.0e0 ELSE max(abs(fg - fb)) END AS ks FROM kc{sfx} GROUP BY {by})"""
            for sfx, op in (("", ">="), ("_strict", ">"))
        ],
    ]


@register(
    "regression_metrics",
    S.with_(_pr_cte(), *_metric_ctes())
    + "SELECT base, n, round(rmse, 2) AS rmse, round(mae, 2) AS mae, round(r2, 4) AS r2, round(mape, 2) AS mape FROM reg",
)
def q_regression_metrics(spark, sf):
    r = M.regression_metrics(predictions(spark, sf, one_pass=True), C.TARGET, "pred", [C.SPLIT])
    return r.select(C.SPLIT, "n", F.round("rmse", 2).alias("rmse"), F.round("mae", 2).alias("mae"), F.round("r2", 4).alias("r2"), F.round("mape", 2).alias("mape"))


@register("gini", S.with_(_pr_cte(), *_metric_ctes()) + "SELECT base, round(gini, 4) AS gini FROM gini")
def q_gini(spark, sf):
    return M.gini(predictions(spark, sf), C.TARGET, "pred", [C.SPLIT]).select(C.SPLIT, F.round("gini", 4).alias("gini"))


@register("ks", S.with_(_pr_cte(), *_metric_ctes()) + "SELECT base, round(ks, 4) AS ks FROM ks")
def q_ks(spark, sf):
    return M.ks(predictions(spark, sf), C.TARGET, "pred", [C.SPLIT]).select(C.SPLIT, F.round("ks", 4).alias("ks"))


@register("ks_strict", S.with_(_pr_cte(), *_metric_ctes()) + "SELECT base, round(ks, 4) AS ks FROM ks_strict")
def q_ks_strict(spark, sf):
    return M.ks(predictions(spark, sf), C.TARGET, "pred", [C.SPLIT], strict=True).select(C.SPLIT, F.round("ks", 4).alias("ks"))


_Q = ", ".join(S.lit(i / 10) for i in range(11))
_DEC_CTES = [
    f"e AS (SELECT base, list_sort(list_distinct(quantile_cont(p, [{_Q}]))) AS edges FROM pr GROUP BY base)",
    f"d AS (SELECT pr.base, y, p, {S.qcut_bucket('p', 'e.edges')} AS decile FROM pr JOIN e ON pr.base = e.base)",
]


@register(
    "decile_table",
    S.with_(_pr_cte(), *_DEC_CTES)
    + """SELECT base, decile, count(*) AS n, round(avg(p), 2) AS mean_pred, round(avg(y), 2) AS mean_actual,
         round(min(p), 6) AS min_pred, round(max(p), 6) AS max_pred,
         round((round(avg(p), 2) - round(avg(y), 2)) / round(avg(y), 2) * 100.0e0, 2) AS error_pct FROM d GROUP BY base, decile""",
)
def q_decile_table(spark, sf):
    return M.decile_table(predictions(spark, sf), C.TARGET, "pred", [C.SPLIT])


@register(
    "decile_bias",
    S.with_(_pr_cte(), *_DEC_CTES)
    + """SELECT base, decile AS decil, count(*) AS n, round(avg(y), 6) AS actual_mean, round(avg(p), 6) AS pred_mean,
         round(avg(p) - avg(y), 0) AS sesgo, 'lin_a' AS modelo FROM d GROUP BY base, decile""",
)
def q_decile_bias(spark, sf):
    return M.decile_bias(predictions(spark, sf), C.TARGET, "pred", "lin_a", [C.SPLIT])


def _report_sql():
    cols = []
    rnd = {"rmse": 2, "mae": 2, "r2": 4, "mape": 2, "gini": 4, "ks": 4}
    for pfx, s in (("train", "TRAIN"), ("test", "TEST")):
        for k, d in rnd.items():
            cols.append(f"round(max(CASE WHEN base = '{s}' THEN {k} END), {d}) AS {pfx}_{k}")
    return (
        S.with_(
            _pr_cte(("lin_a", "lin_b")),
            *_metric_ctes(),
            "allm AS (SELECT reg.model, reg.base, rmse, mae, r2, mape, gini, ks FROM reg JOIN gini USING (model, base) JOIN ks USING (model, base))",
            f"wide AS (SELECT model, {', '.join(cols)} FROM allm GROUP BY model)",
        )
        + """SELECT *, round(train_r2 - test_r2, 4) AS r2_gap,
             CASE WHEN train_r2 - test_r2 < 0.03e0 THEN 'estable' WHEN train_r2 - test_r2 < 0.08e0 THEN 'leve' ELSE 'sobreajuste' END AS diagnosis
             FROM wide"""
    )


@register("metrics_report", _report_sql())
def q_metrics_report(spark, sf):
    return M.metrics_report(predictions(spark, sf, ("lin_a", "lin_b")))


@register(
    "compute_metrics",
    S.with_(_pr_cte(), *_metric_ctes())
    + """SELECT reg.base, 'lin_a' AS modelo, round(r2, 4) AS r2, round(rmse, 0) AS rmse, round(mae, 0) AS mae, round(mape_raw, 2) AS mape,
         round(ks, 4) AS ks, round(gini, 4) AS gini FROM reg JOIN gini ON reg.base = gini.base JOIN ks_strict k ON reg.base = k.base""",
)
def q_compute_metrics(spark, sf):
    return M.compute_metrics(predictions(spark, sf), C.TARGET, "pred", "lin_a", [C.SPLIT])


@register(
    "model_ranking",
    S.with_(_pr_cte(("lin_a", "lin_b")), "r AS (SELECT model, round(1.0e0 - avg((y - p) * (y - p)) / var_pop(y), 4) AS test_r2 FROM pr WHERE base = 'TEST' GROUP BY model)")
    + "SELECT rank() OVER (ORDER BY test_r2 DESC, model) AS rank, model, test_r2 FROM r",
)
def q_model_ranking(spark, sf):
    return M.rank_models(M.metrics_report(predictions(spark, sf, ("lin_a", "lin_b"))))


# Stability of the scores themselves, TRAIN -> TEST, for every scorer at once
_sp_ctes, _sp_tab = S.psi_ctes(
    S.union_all([f"SELECT '{m}' AS feature, {SCORERS[m][1]} AS value FROM applicants WHERE base = 'TRAIN'" for m in ("lin_a", "lin_b")]),
    S.union_all([f"SELECT '{m}' AS feature, {SCORERS[m][1]} AS value FROM applicants WHERE base = 'TEST'" for m in ("lin_a", "lin_b")]),
    prefix="sp",
)


@register("score_psi", S.with_(*_sp_ctes) + f"SELECT feature, psi, {S.psi_status()} AS status, n_bins_used FROM {_sp_tab}")
def q_score_psi(spark, sf):
    from ..operators import stability as ST

    a = base(spark, sf).select(C.SPLIT, *[SCORERS[m][0]().alias(m) for m in ("lin_a", "lin_b")])
    return ST.psi_by_feature(a.where(F.col(C.SPLIT) == C.TRAIN), a.where(F.col(C.SPLIT) == C.TEST), ["lin_a", "lin_b"])


@register("report_csv", _report_sql())
def q_report_csv(spark, sf):
    """The model report written as one CSV file and read back with its schema."""
    from ..session import scratch_path
    from ..sources.tables import write_report

    rep = M.metrics_report(predictions(spark, sf, ("lin_a", "lin_b")))
    path = scratch_path(spark, "report")
    write_report(rep, path)
    return spark.read.schema(rep.schema).option("header", True).csv(path)


# a NULL group is a group: every fifth applicant has no split label
_NULL_PR = f"pr AS (SELECT 'lin_a' AS model, CASE WHEN id % 5 = 0 THEN 'none' ELSE base END AS base, target AS y, {SCORERS['lin_a'][1]} AS p FROM applicants)"


@register(
    "metrics_null_group",
    S.with_(_NULL_PR, *_metric_ctes())
    + """SELECT nullif(base, 'none') AS grp, n, round(rmse, 2) AS rmse, round(gini, 4) AS gini, round(ks, 4) AS ks
         FROM reg JOIN gini USING (model, base) JOIN ks USING (model, base)""",
)
def q_metrics_null_group(spark, sf):
    """M1-M3 per group where one group's label is NULL."""
    a = base(spark, sf).select(F.when(F.col(C.ID) % 5 != 0, F.col(C.SPLIT)).alias("grp"), C.TARGET, SCORERS["lin_a"][0]().alias("pred"))
    m = M.evaluate(a, C.TARGET, "pred", ["grp"])
    return m.select("grp", "n", F.round("rmse", 2).alias("rmse"), F.round("gini", 4).alias("gini"), F.round("ks", 4).alias("ks"))


@register(
    "deciles_null_group",
    S.with_(_NULL_PR, *_DEC_CTES)
    + "SELECT nullif(base, 'none') AS grp, decile, count(*) AS n, round(avg(p), 2) AS mean_pred, round(avg(y), 2) AS mean_actual FROM d GROUP BY base, decile",
)
def q_deciles_null_group(spark, sf):
    """M5 where one group's label is NULL."""
    a = base(spark, sf).select(F.when(F.col(C.ID) % 5 != 0, F.col(C.SPLIT)).alias("grp"), C.TARGET, SCORERS["lin_a"][0]().alias("pred"))
    return M.decile_table(a, C.TARGET, "pred", ["grp"]).select("grp", "decile", "n", "mean_pred", "mean_actual")


@register(
    "overfit_variants",
    f"""SELECT model, CASE WHEN abs(train_r2 - test_r2) < 0.05e0 THEN 'estable' ELSE 'sobreajuste' END AS r2_status,
        CASE WHEN (test_rmse - train_rmse) / train_rmse * 100.0e0 < 10.0e0 THEN 'estable' ELSE 'sobreajuste' END AS rmse_status
        FROM ({_report_sql()})""",
)
def q_overfit_variants(spark, sf):
    """The two other overfit diagnoses (absolute R2 gap, relative RMSE gap)."""
    r = M.metrics_report(predictions(spark, sf, ("lin_a", "lin_b")))
    return r.select(
        "model", M.overfit_gap(F.col("train_r2"), F.col("test_r2")).alias("r2_status"),
        M.overfit_gap(F.col("train_rmse"), F.col("test_rmse"), "rmse").alias("rmse_status"),
    )


# a feature that is missing from every current row: each bin's current share is the floor
_mf_ctes, _mf_tab = S.psi_ctes(
    S.unpivot_sql("applicants", ["x1", "x10"], where="base = 'TRAIN'"), S.unpivot_sql("applicants", ["x1"], where="base = 'TEST'"), prefix="mf"
)
_MF_LOST = [
    "mf_g AS (SELECT feature, n_ref, unnest(range(0, len(edges) - 1)) AS bin FROM mf_edges WHERE feature = 'x10')",
    "mf_e AS (SELECT CASE WHEN coalesce(c_ref, 0) = 0 THEN 1.0e-4 ELSE c_ref / n_ref END AS e FROM mf_g LEFT JOIN mf_refc USING (feature, bin))",
    f"mf_all AS (SELECT feature, psi, n_bins_used FROM {_mf_tab} UNION ALL SELECT 'x10', round(sum((1.0e-4 - e) * ln(1.0e-4 / e)), 4), count(*) FROM mf_e)",
]


@register("psi_missing_feature", S.with_(*_mf_ctes, *_MF_LOST) + f"SELECT feature, psi, {S.psi_status()} AS status, n_bins_used FROM mf_all")
def q_psi_missing_feature(spark, sf):
    """x10 is NULL in every current row and must report an alert; x1 is as it is."""
    from ..operators import stability as ST

    a = base(spark, sf).select(C.SPLIT, "x1", "x10")
    cur = a.where(F.col(C.SPLIT) == C.TEST).withColumn("x10", F.lit(None).cast("double"))
    return ST.psi_by_feature(a.where(F.col(C.SPLIT) == C.TRAIN), cur, ["x1", "x10"])
