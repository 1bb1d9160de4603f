"""Registered model queries: linear model and diagnostics (T1-T10), blending (E1-E2),
explanation (E3-E4, B7-B8). Fitted-model outputs have no SQL twin (rows-only
check); statistics of closed-form scorers have one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import blend as BL
from ..operators import explain as EX
from ..functions import columns as X
from ..operators import linear as L
from ..operators.quality import replace_sentinels
from ..sources.applicants import applicants
from . import sqlparts as S
from .catalog import base, register
from .catalog_metrics import SCORERS
from .catalog_prep import fitted


def residuals(a):
    """Log-scale residuals of the closed-form scorer lin_a, every applicant."""
    return a.select(C.ID, C.TARGET, SCORERS["lin_a"][0]().alias("pred")).select(
        C.ID, C.TARGET, "pred", (F.log(F.col(C.TARGET)) - F.log(F.col("pred"))).alias("resid")
    )


_RES = f"res AS (SELECT id, target, {SCORERS['lin_a'][1]} AS pred, ln(target) - ln({SCORERS['lin_a'][1]}) AS resid FROM applicants)"


@register(
    "jarque_bera",
    S.with_(
        _RES,
        "mo AS (SELECT count(*) AS n, avg(resid) AS mu FROM res)",
        "cm AS (SELECT max(n) AS n, avg(power(resid - mu, 2)) AS m2, avg(power(resid - mu, 3)) AS m3, avg(power(resid - mu, 4)) AS m4 FROM res, mo)",
        "sk AS (SELECT n, m3 / power(m2, 1.5e0) AS s, m4 / (m2 * m2) - 3.0e0 AS k FROM cm)",
    )
    + """SELECT n, round(n / 6.0e0 * (s * s + k * k / 4.0e0), 4) AS statistic, round(exp(-(n / 6.0e0 * (s * s + k * k / 4.0e0)) / 2.0e0), 6) AS p_value,
         round(s, 6) AS skewness, round(k, 6) AS kurtosis, exp(-(n / 6.0e0 * (s * s + k * k / 4.0e0)) / 2.0e0) > 0.05e0 AS cumple_supuesto FROM sk""",
)
def q_jarque_bera(spark, sf):
    return L.jarque_bera(residuals(applicants(spark, sf)), "resid")


@register(
    "durbin_watson",
    S.with_(_RES, "l AS (SELECT resid, lag(resid) OVER (ORDER BY id) AS prev FROM res)")
    + """SELECT round(sum((resid - prev) * (resid - prev)) / (SELECT sum(resid * resid) FROM res), 6) AS statistic,
         sum((resid - prev) * (resid - prev)) / (SELECT sum(resid * resid) FROM res) BETWEEN 1.5e0 AND 2.5e0 AS cumple_supuesto FROM l""",
)
def q_durbin_watson(spark, sf):
    return L.durbin_watson(residuals(base(spark, sf)), "resid", C.ID)


@register(
    "vif_pair",
    S.with_(S.clean_cte()) + "SELECT round(1.0e0 / (1.0e0 - corr(x1, x10) * corr(x1, x10)), 6) AS vif, round(corr(x1, x10), 6) AS corr FROM clean",
)
def q_vif_pair(spark, sf):
    return L.vif_pair(replace_sentinels(applicants(spark, sf)), "x1", "x10")


@register(
    "ols_single",
    S.with_("d AS (SELECT x10 AS x, ln(target) AS y FROM applicants)")
    + """SELECT CAST(regr_count(y, x) AS BIGINT) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2,
         round(sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (regr_count(y, x) - 2) / regr_sxx(y, x)), 6) AS se_slope,
         round(regr_slope(y, x) / sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (regr_count(y, x) - 2) / regr_sxx(y, x)), 4) AS t_slope
         FROM d""",
)
def q_ols_single(spark, sf):
    a = applicants(spark, sf).select(F.col("x10").alias("x"), F.log(C.TARGET).alias("y"))
    return L.ols_single(a, "x", "y")


@register(
    "residual_diagnostics",
    S.with_("r AS (SELECT id, target, " + SCORERS["lin_a"][1] + " AS pred FROM applicants)", "sd AS (SELECT stddev_samp(target - pred) AS sd FROM r)")
    + """SELECT id, round(pred, 6) AS fitted, round(target - pred, 6) AS residual, round(sqrt(abs((target - pred) / sd)), 6) AS sqrt_abs_std_resid FROM r, sd""",
)
def q_residual_diagnostics(spark, sf):
    a = base(spark, sf).select(C.ID, C.TARGET, SCORERS["lin_a"][0]().alias("pred"))
    r = L.residual_frame(a, C.TARGET, "pred")
    return r.select(C.ID, F.round("pred", 6).alias("fitted"), F.round("residual", 6).alias("residual"), F.round("sqrt_abs_std_resid", 6).alias("sqrt_abs_std_resid"))


_CONTRIB = {"x10": 2.0, "x1c": 0.5}


@register(
    "linear_contributions",
    S.with_(
        "d AS (SELECT x10, coalesce(x1, 0.0e0) AS x1c FROM applicants)",
        "m AS (SELECT avg(x10) AS m10, avg(x1c) AS m1 FROM d)",
        "c AS (SELECT avg(abs(2.0e0 * (x10 - m10))) AS x10, avg(abs(0.5e0 * (x1c - m1))) AS x1c FROM d, m)",
        "l AS (SELECT 'x10' AS feature, x10 AS v FROM c UNION ALL SELECT 'x1c', x1c FROM c)",
    )
    + """SELECT feature, round(v, 6) AS importance, round(v / sum(v) OVER () * 100.0e0, 2) AS pct,
         round(sum(v) OVER (ORDER BY v DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(v) OVER () * 100.0e0, 2) AS cum_pct,
         row_number() OVER (ORDER BY v DESC, feature) AS rank FROM l""",
)
def q_linear_contributions(spark, sf):
    a = base(spark, sf).select("x10", F.coalesce(F.col("x1"), F.lit(0.0)).alias("x1c"))
    return EX.mean_abs_contribution(EX.linear_contributions(a, _CONTRIB), list(_CONTRIB))


@register(
    "top_explanation",
    S.with_(
        "d AS (SELECT id, x10, coalesce(x1, 0.0e0) AS x1c, 2.0e0 * x10 + 0.5e0 * coalesce(x1, 0.0e0) AS pred FROM applicants)",
        "m AS (SELECT avg(x10) AS m10, avg(x1c) AS m1 FROM d)",
        "t AS (SELECT * FROM d ORDER BY pred DESC, id LIMIT 1)",
    )
    + """SELECT id, round(pred, 6) AS pred, 'x10' AS feature, round(2.0e0 * (x10 - m10), 6) AS contribution FROM t, m
         UNION ALL SELECT id, round(pred, 6), 'x1c', round(0.5e0 * (x1c - m1), 6) FROM t, m""",
)
def q_top_explanation(spark, sf):
    """The additive breakdown of the highest score."""
    a = base(spark, sf).select(C.ID, "x10", F.coalesce(F.col("x1"), F.lit(0.0)).alias("x1c"), SCORERS["lin_a"][0]().alias("pred"))
    top = EX.top_explanation(EX.linear_contributions(a, _CONTRIB), "pred", list(_CONTRIB), C.ID)
    return top.select(C.ID, F.round("pred", 6).alias("pred"), "feature", F.round("contribution", 6).alias("contribution"))


@register(
    "level_concentration",
    S.with_(
        "l AS (SELECT coalesce(x9, 'DESCONOCIDO') AS f, CAST(count(*) AS DOUBLE) AS v FROM applicants GROUP BY 1)",
        "c AS (SELECT row_number() OVER (ORDER BY v DESC, f) AS rank, sum(v) OVER (ORDER BY v DESC, f ROWS UNBOUNDED PRECEDING) / sum(v) OVER () * 100.0e0 AS cum FROM l)",
    )
    + "SELECT round(max(cum) FILTER (WHERE rank = 5), 2) AS top5_pct, round(max(cum) FILTER (WHERE rank = 10), 2) AS top10_pct FROM c",
)
def q_level_concentration(spark, sf):
    """B8 over any (name, value) table: share of the applicants in the 5 and 10 largest districts."""
    a = applicants(spark, sf).groupBy(F.coalesce(F.col("x9"), F.lit(C.UNKNOWN_CATEGORY)).alias("f")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return EX.concentration(EX.importance_table(a, "f", "v"))


@register(
    "breusch_pagan_single",
    S.with_(_RES) + "SELECT round(count(*) * power(corr(resid * resid, x10), 2), 4) AS statistic FROM res JOIN (SELECT id, x10 FROM applicants) USING (id)",
)
def q_breusch_pagan_single(spark, sf):
    """T8 with one regressor: n times the squared correlation of e^2 and x."""
    a = base(spark, sf)
    r = a.select("x10", (F.log(F.col(C.TARGET)) - F.log(SCORERS["lin_a"][0]())).alias("resid"))
    return spark.createDataFrame([(L.breusch_pagan(r, "resid", ["x10"])["statistic"],)], "statistic double")


def _wide_preds(spark, sf):
    a = base(spark, sf)
    return a.select(C.ID, C.SPLIT, C.TARGET, *[SCORERS[m][0]().alias(m) for m in ("lin_a", "lin_b")])


@register(
    "blend_moments",
    S.with_(f"d AS (SELECT target, {SCORERS['lin_a'][1]} AS lin_a, {SCORERS['lin_b'][1]} AS lin_b FROM applicants)")
    + f"""SELECT a, b, {S.sig_round('value')} AS value FROM (
         SELECT 'lin_a' AS a, 'lin_a' AS b, avg(lin_a * lin_a) AS value FROM d UNION ALL
         SELECT 'lin_a', 'lin_b', avg(lin_a * lin_b) FROM d UNION ALL
         SELECT 'lin_a', 'target', avg(lin_a * target) FROM d UNION ALL
         SELECT 'lin_b', 'lin_b', avg(lin_b * lin_b) FROM d UNION ALL
         SELECT 'lin_b', 'target', avg(lin_b * target) FROM d UNION ALL
         SELECT 'target', 'target', avg(target * target) FROM d)""",
)
def q_blend_moments(spark, sf):
    m = BL.blend_moments(_wide_preds(spark, sf), C.TARGET, ["lin_a", "lin_b"])
    return m.select("a", "b", X.sig_round("value").alias("value"))


# with two models the best weight is a ratio of moments, cut to [0, 1]
_BLEND = [
    f"bd AS (SELECT id, base, target, {SCORERS['lin_a'][1]} AS lin_a, {SCORERS['lin_b'][1]} AS lin_b FROM applicants)",
    """bw AS (SELECT greatest(0.0e0, least(1.0e0, avg((target - lin_b) * (lin_a - lin_b)) / avg((lin_a - lin_b) * (lin_a - lin_b)))) AS w
       FROM bd WHERE base = 'TRAIN')""",
    "br AS (SELECT round(sqrt(avg(power(target - w * lin_a - (1.0e0 - w) * lin_b, 2))), 4) AS rmse FROM bd, bw WHERE base = 'TRAIN')",
]


@register(
    "blend_weights",
    S.with_(*_BLEND) + "SELECT 'lin_a' AS modelo, round(w, 4) AS peso, rmse FROM bw, br UNION ALL SELECT 'lin_b', round(1.0e0 - w, 4), rmse FROM bw, br",
)
def q_blend_weights(spark, sf):
    """E1 on the TRAIN rows of two closed-form scorers; weights and RMSE rounded to 4 dp."""
    d = _wide_preds(spark, sf).where(F.col(C.SPLIT) == C.TRAIN)
    w, rmse = BL.optimize_weights(d, C.TARGET, ["lin_a", "lin_b"])
    rows = spark.createDataFrame([(k, float(v), float(rmse)) for k, v in w.items()], "modelo string, peso double, rmse double")
    return rows.select("modelo", "peso", F.round("rmse", 4).alias("rmse"))


@register("blend_scores", S.with_(*_BLEND) + "SELECT id, round(round(w, 4) * lin_a + round(1.0e0 - w, 4) * lin_b, 6) AS blend FROM bd, bw")
def q_blend_scores(spark, sf):
    """Blended score of every applicant with the E1 weights."""
    d = _wide_preds(spark, sf)
    w, _ = BL.optimize_weights(d.where(F.col(C.SPLIT) == C.TRAIN), C.TARGET, ["lin_a", "lin_b"])
    return d.select(C.ID, F.round(BL.blend_column(w), 6).alias("blend"))


def _loglinear(spark, sf):
    a, prep = fitted(spark, sf)
    train = prep.transform(a.where(F.col(C.SPLIT) == C.TRAIN))
    feats = [c for c in train.columns if c not in (C.ID, C.SPLIT, C.TARGET)]
    model = L.LogLinearModel().fit(train, feats, C.TARGET)
    return a, prep, model, feats


@register("ols_coefficients")
def q_ols_coefficients(spark, sf):
    """VIF removal, backward elimination and the coefficient table of the log-linear model."""
    _, _, model, _ = _loglinear(spark, sf)
    return model.coefficients(spark)


@register("vif_table")
def q_vif_table(spark, sf):
    """VIF of every preprocessed feature on the TRAIN rows (one Gram pass)."""
    a, prep = fitted(spark, sf)
    train = prep.transform(a.where(F.col(C.SPLIT) == C.TRAIN))
    feats = [c for c in train.columns if c not in (C.ID, C.SPLIT, C.TARGET)]
    G = L.gram(train, feats)
    rows = [(f, v if v != float("inf") else None) for f, v in L.vif_table(G, feats)]
    return spark.createDataFrame(rows, "feature string, vif double").select("feature", F.round("vif", 2).alias("vif"))


@register("effects")
def q_effects(spark, sf):
    """Top-15 percent effects of the log-linear model."""
    _, _, model, _ = _loglinear(spark, sf)
    return model.effects(spark)


@register("breusch_pagan")
def q_breusch_pagan(spark, sf):
    """T8 on the log-linear model's TRAIN residuals."""
    a, prep, model, _ = _loglinear(spark, sf)
    train = prep.transform(a.where(F.col(C.SPLIT) == C.TRAIN))
    r = train.select(*model.features, (F.log(C.TARGET) - model.predict_log_column()).alias("resid"))
    bp = L.breusch_pagan(r, "resid", model.features)
    return spark.createDataFrame([(bp["statistic"], bp["p_value"], bp["cumple_supuesto"])], "statistic double, p_value double, cumple_supuesto boolean")


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    """E4 for the closed-form scorer lin_a over every applicant."""
    a = base(spark, sf).select(C.ID, C.TARGET, "x10", "x1")
    return EX.permutation_importance(a, C.TARGET, lambda d: SCORERS["lin_a"][0](), ["x10", "x1"], C.ID)
