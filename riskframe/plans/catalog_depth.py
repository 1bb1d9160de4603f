"""Registered queries for the further parts of A16, A22, W6, P22, F3, F9, F11, F12 and J7, each with its SQL twin."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from .. import config as C
from ..operators import linear as L
from ..operators import prep as P
from ..operators import profile as PR
from ..operators import quality as Q
from ..operators import scoring as SC
from ..session import scratch_path
from ..sources.applicants import applicants
from . import sqlparts as S
from .catalog import SQL, base, register
from .catalog_io import _QQ_M, _QQ_P, _QQ_T, _REQ, q_qq_grid
from .catalog_metrics import SCORERS
from .catalog_prep import FLAGS, IMPUTED, INTER, LOGS, X7_COLS, X8_LEVELS, _prep_ctes, _rounded, fitted

_KS_P = """round(CASE WHEN z <= 0 THEN 1.0e0 ELSE least(1.0e0, greatest(0.0e0, 2.0e0 * list_sum(list_transform(range(1, 101),
       lambda k: pow(-1.0e0, k - 1) * exp(-2.0e0 * k * k * z * z))))) END, 6)"""


@register(
    "sentinel_impact_test",
    S.with_(
        "l AS ("
        + S.union_all([f"SELECT '{c}' AS variable, target, {c} = {S.lit(S.SENT)} AS coded FROM applicants WHERE {c} IS NOT NULL AND target IS NOT NULL" for c in ("x3", "x4")])
        + ")",
        "v AS (SELECT variable, target, count_if(coded) AS ca, count_if(NOT coded) AS cb FROM l GROUP BY 1, 2)",
        "f AS (SELECT variable, sum(ca) OVER w / sum(ca) OVER p AS fa, sum(cb) OVER w / sum(cb) OVER p AS fb, sum(ca) OVER p AS a, sum(cb) OVER p AS b FROM v WINDOW w AS (PARTITION BY variable ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY variable))",
        "d AS (SELECT variable, max(abs(fa - fb)) AS d, sqrt(max(a) * max(b) / (max(a) + max(b))) * max(abs(fa - fb)) AS z FROM f GROUP BY 1)",
        "i AS (SELECT variable, count_if(coded) AS n_sentinel, avg(target) FILTER (WHERE coded) AS a, avg(target) FILTER (WHERE NOT coded) AS b FROM l GROUP BY 1)",
    )
    + f"""SELECT variable, n_sentinel, round(a, 6) AS target_mean_sentinel, round(b, 6) AS target_mean_real, round((a - b) / b * 100, 4) AS diff_pct,
       round(d, 6) AS ks_stat, {_KS_P} AS p_value FROM i JOIN d USING (variable) WHERE n_sentinel > 0""",
)
def q_sentinel_impact_test(spark, sf):
    """Impact of the codes on the target with the two-sample KS p per column."""
    return Q.sentinel_impact_test(base(spark, sf))


@register(
    "residual_mean",
    S.with_() + f"SELECT round(avg(target - ({SCORERS['lin_a'][1]})), 6) AS mean_error, round(stddev_samp(target - ({SCORERS['lin_a'][1]})), 6) AS sd_error FROM applicants",
)
def q_residual_mean(spark, sf):
    """Mean and standard deviation of y - y_hat for the closed-form scorer."""
    scored = applicants(spark, sf).select(C.TARGET, SCORERS["lin_a"][0]().alias("pred"))
    return PR.residual_summary(scored, C.TARGET, "pred")[0]


@register(
    "qq_line",
    S.with_(
        f"q AS (SELECT quantile_cont(ln(target), [{', '.join(S.lit(p) for p in _QQ_P)}]) AS qs FROM applicants)",
        f"t AS (SELECT unnest(range(1, {_QQ_M + 1})) AS i, unnest([{', '.join(S.lit(t) for t in _QQ_T)}]) AS t)",
        "g AS (SELECT round(t, 6) AS x, round(qs[i], 6) AS y FROM q, t)",
    )
    + "SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(y, x), 6) AS r FROM g",
)
def q_qq_line(spark, sf):
    """Straight line through the Q-Q grid of log(target)."""
    return PR.qq_line(q_qq_grid(spark, sf))


_CODED = {"x3": C.SENTINEL, "x4": C.SENTINEL}


@register(
    "request_codes_to_null",
    S.with_() + "SELECT " + ", ".join(f"nullif({c}, {S.lit(_CODED[c])}) AS {c}" if c in _CODED else "upper(nullif(trim(x9), '')) AS x9" if c == "x9" else c for c in _REQ) + " FROM applicants",
)
def q_request_codes_to_null(spark, sf):
    """P22 + P24: request records with the generic code of X3 and X4 as NULL and the text trimmed and upper-cased."""
    return SC.normalise_requests(applicants(spark, sf).select(*_REQ), null_codes=_CODED)


def _imputed_sql(fills: list[str], cte: str) -> str:
    clip = "coalesce(CASE WHEN c.{c} IS NOT NULL THEN least(greatest(c.{c}, fit.lo_{c}), fit.hi_{c}) END, m.{c})"
    return S.with_(*_prep_ctes()[:4], cte) + "SELECT c.id, " + ", ".join(f"round({clip.format(c=c)}, 6) AS {c}" for c in fills) + " FROM clean c, fit, m"


def _imputed(spark, sf, strategy):
    a, m = fitted(spark, sf, imputeStrategy=strategy)
    return _rounded(m.transform(a).select(C.ID, *IMPUTED))


@register("impute_mean", _imputed_sql(IMPUTED, "m AS (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in IMPUTED) + " FROM tr)"))
def q_impute_mean(spark, sf):
    """missing values become the TRAIN mean of the unclipped column."""
    return _imputed(spark, sf, "mean")


_MODE = "(SELECT {c} FROM tr WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}"


@register("impute_most_frequent", _imputed_sql(IMPUTED, "m AS (SELECT " + ", ".join(_MODE.format(c=c) for c in IMPUTED) + ")"))
def q_impute_most_frequent(spark, sf):
    """missing values become the column's most frequent TRAIN value (the smallest on ties)."""
    return _imputed(spark, sf, "most_frequent")


@register("prepare_train_test", SQL["prep_full"])
def q_prepare_train_test(spark, sf):
    """fit on TRAIN, transform TRAIN and TEST apart, both with their split and target."""
    train, test, _ = P.prepare_train_test(base(spark, sf))
    names = [C.ID, C.SPLIT, C.TARGET, *IMPUTED, *FLAGS, *LOGS, *INTER, *X7_COLS, *[f"x8_cat_{lv}" for lv in X8_LEVELS], "x9_target_enc"]
    return _rounded(train.select(*names).unionByName(test.select(*names)))


def _key_sql(seed: int) -> str:
    return f"((id % 2147483648) * 2654435761 + {seed * 40503}) % 4294967296"


@register("portable_holdout", S.with_() + f"SELECT ({_key_sql(42)}) * 100 < 20 * 4294967296 AS is_validation, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM applicants WHERE base = 'TRAIN' GROUP BY 1")
def q_portable_holdout(spark, sf):
    """the 80/20 hold-out of TRAIN by a key that other engines can restate."""
    a = applicants(spark, sf).where(F.col(C.SPLIT) == C.TRAIN)
    return a.groupBy(P.portable_holdout().alias("is_validation")).agg(F.count(F.lit(1)).alias("n"), F.min(C.ID).alias("first_id"), F.max(C.ID).alias("last_id"))


@register("portable_folds", S.with_() + f"SELECT (({_key_sql(43)}) * 5 // 4294967296)::INTEGER AS fold, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM applicants WHERE base = 'TRAIN' GROUP BY 1")
def q_portable_folds(spark, sf):
    """five folds of TRAIN by the same kind of key."""
    a = applicants(spark, sf).where(F.col(C.SPLIT) == C.TRAIN)
    return a.groupBy(P.portable_fold().alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.min(C.ID).alias("first_id"), F.max(C.ID).alias("last_id"))


@register("portable_sample", S.with_() + f"SELECT id, target FROM applicants ORDER BY {_key_sql(42)}, id LIMIT 2000")
def q_portable_sample(spark, sf):
    """2,000 applicants (the size of the reference's sample) in the order of the key."""
    return P.portable_sample(applicants(spark, sf), 2000).select(C.ID, C.TARGET)


@register("pipeline_persistence")
def q_pipeline_persistence(spark, sf):
    """T6 + S5 + O1: preprocessor and log-linear model fitted on TRAIN as one ``Pipeline``, saved, loaded and applied to every applicant."""
    a = base(spark, sf)
    path = scratch_path(spark, "pipeline_model")
    Pipeline(stages=[P.RiskPreprocessor(), L.LogLinearRegression()]).fit(a.where(F.col(C.SPLIT) == C.TRAIN)).write().save(path)
    return PipelineModel.load(path).transform(a).select(C.ID, C.SPLIT, F.round("prediction", 2).alias("prediction"))
