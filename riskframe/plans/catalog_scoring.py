"""Registered scoring, monitoring and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import scoring as SC
from ..operators import stability as ST
from ..operators.prefix import unpivot
from ..sources.applicants import applicants
from ..sources.tables import read_table
from ..streaming import jobs as STR
from . import sqlparts as S
from .catalog import NUM, base, clean, register
from .catalog_metrics import SCORERS, _metric_ctes, _pr_cte, _sp_ctes, _sp_tab, predictions
from .catalog_prep import PREP, fitted

# a fixed log-linear scorer over preprocessed features (so the SQL twin needs no fitted model)
FIXED_INTERCEPT = 8.0
FIXED_COEFS = {"x1_log": 0.05, "x10_log": 0.1, "x7": 0.0002, "x3_sin_registro": -0.1, "x9_target_enc": 0.000001}


def _fixed_sql():
    out = S.lit(FIXED_INTERCEPT)
    for f, b in FIXED_COEFS.items():
        out = f"({out} + {S.lit(b)} * CAST({f} AS DOUBLE))"
    return f"exp({out})"


SCORE_SQL = PREP + f"SELECT id, round({_fixed_sql()}, 2) AS prediction FROM feat"


def _scored(spark, sf):
    a, prep = fitted(spark, sf)
    return SC.score(a, prep, SC.linear_log_predictor(FIXED_COEFS, FIXED_INTERCEPT))


@register("score_batch", SCORE_SQL)
def q_score_batch(spark, sf):
    return _scored(spark, sf)


def _fixed_sql_float32():
    out = S.lit(FIXED_INTERCEPT)
    for f, b in FIXED_COEFS.items():
        out = f"({out} + {S.lit(b)} * CAST(CAST({f} AS FLOAT) AS DOUBLE))"
    return f"exp({out})"


@register("score_float32", PREP + f"SELECT id, round({_fixed_sql_float32()}, 2) AS prediction FROM feat")
def q_score_float32(spark, sf):
    """P20: features narrowed to 32-bit floats before the scorer (as the serving path did)."""
    a, prep = fitted(spark, sf)
    return SC.score(a, prep, SC.linear_log_predictor(FIXED_COEFS, FIXED_INTERCEPT), float32=True)


@register("stream_score", SCORE_SQL)
def q_stream_score(spark, sf):
    """O3: the same scores produced by a streaming query over the orders file."""
    a, prep = fitted(spark, sf)
    return STR.stream_score(spark, sf, prep, SC.linear_log_predictor(FIXED_COEFS, FIXED_INTERCEPT))


@register(
    "score_bands",
    PREP
    + f"""SELECT band, count(*) AS n FROM (SELECT CASE WHEN p < 5000.0e0 THEN 'ALTO' WHEN p < 11000.0e0 THEN 'MODERADO'
          WHEN p IS NOT NULL THEN 'BAJO' END AS band FROM (SELECT round({_fixed_sql()}, 2) AS p FROM feat)) GROUP BY band""",
)
def q_score_bands(spark, sf):
    return SC.band_counts(_scored(spark, sf))


@register("score_single")
def q_score_single(spark, sf):
    """O2: every scored record with its own request id."""
    return SC.score_with_request_id(_scored(spark, sf))


@register("model_metadata")
def q_model_metadata(spark, sf):
    """Readiness row of the fitted scorer."""
    a, prep = fitted(spark, sf)
    feats = prep.feature_names(a)
    return SC.model_metadata(spark, "fixed_loglinear", feats, "0.1.0")


@register(
    "request_normalise",
    S.with_() + "SELECT id, nullif(upper(trim(x9)), '') AS x9 FROM applicants",
)
def q_request_normalise(spark, sf):
    a = applicants(spark, sf).select(C.ID, "x9")
    return SC.normalise_requests(a)


# ---------------------------------------------------------------------------
# monitoring by period (orders.o_totalprice by month, reference = 1995)
# ---------------------------------------------------------------------------

_M_REF = "o_orderdate < TIMESTAMP '1996-01-01 00:00:00'"
_m_ctes, _m_tab = S.psi_ctes(
    f"SELECT 'o_totalprice' AS feature, o_totalprice AS value FROM orders WHERE {_M_REF}",
    "SELECT 'o_totalprice' AS feature, strftime(o_orderdate, '%Y-%m') AS period, o_totalprice AS value FROM orders",
    by=["period"],
)
_M_STATUS = "CASE WHEN psi < 0.1e0 THEN 'OK' WHEN psi < 0.25e0 THEN 'ADVERTENCIA' ELSE 'REENTRENAR' END"


def _monthly(spark, sf):
    o = read_table(spark, sf, "orders")
    return ST.psi_by_period(
        o, "o_totalprice", F.date_format("o_orderdate", "yyyy-MM"), F.col("o_orderdate") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    )


@register("psi_monthly", S.with_(*_m_ctes) + f"SELECT period, psi, {_M_STATUS} AS status, n_bins_used FROM {_m_tab}")
def q_psi_monthly(spark, sf):
    return _monthly(spark, sf)


@register(
    "retrain_trigger",
    S.with_(*_m_ctes)
    + f"""SELECT period, psi,
          (sum(CAST(psi > 0.25e0 AS INTEGER)) OVER w = 2 AND count(*) OVER w = 2) AS retrain,
          lag(psi) OVER (ORDER BY period) AS prev_psi
          FROM {_m_tab} WINDOW w AS (ORDER BY period ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""",
)
def q_retrain_trigger(spark, sf):
    return ST.retrain_trigger(_monthly(spark, sf))


# ---------------------------------------------------------------------------
# drift rules TRAIN -> TEST
# ---------------------------------------------------------------------------

_d_ctes, _d_tab = S.psi_ctes(
    S.unpivot_sql("clean", NUM, where="base = 'TRAIN'"), S.unpivot_sql("clean", NUM, where="base = 'TEST'"), prefix="d"
)


def _drift_sql():
    nulls = S.union_all(
        [
            f"SELECT '{c}' AS v, 100.0e0 * count_if({c} IS NULL AND base = 'TEST') / count_if(base = 'TEST') - 100.0e0 * count_if({c} IS NULL AND base = 'TRAIN') / count_if(base = 'TRAIN') AS d FROM clean"
            for c in NUM
        ]
    )
    lin = SCORERS["lin_a"][1]
    return S.with_(
        S.clean_cte(),
        *_d_ctes,
        f"nr AS ({nulls})",
        "trl AS (SELECT DISTINCT coalesce(x9, 'DESCONOCIDO') AS level FROM applicants WHERE base = 'TRAIN')",
        f"pr AS (SELECT base, target AS y, {lin} AS p FROM applicants)",
        "rm AS (SELECT base, sqrt(avg((y - p) * (y - p))) AS rmse FROM pr GROUP BY base)",
        "med AS (SELECT base, quantile_cont(y, 0.5e0) AS med FROM pr GROUP BY base)",
        "gg AS (SELECT pr.base, p, sum(CAST(y > med AS BIGINT)) AS pos, sum(1 - CAST(y > med AS BIGINT)) AS neg FROM pr JOIN med ON pr.base = med.base GROUP BY pr.base, p)",
        "gc AS (SELECT base, pos, neg, sum(neg) OVER (PARTITION BY base ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM gg)",
        "gini AS (SELECT base, CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.0e0 ELSE 2.0e0 * sum(pos * (cn - neg / 2.0e0)) / (sum(pos) * sum(neg)) - 1.0e0 END AS gini FROM gc GROUP BY base)",
        "rules AS ("
        + S.union_all(
            [
                f"SELECT 'features_psi_above_010' AS rule, CAST(count_if(psi > 0.1e0) AS DOUBLE) AS value, 2.0e0 AS threshold FROM {_d_tab}",
                f"SELECT 'max_feature_psi', max(psi), 0.1e0 FROM {_d_tab}",
                "SELECT 'null_rate_increase_pts', max(d), 5.0e0 FROM nr",
                "SELECT 'new_category_share_pct', 100.0e0 * count_if(coalesce(a.x9, 'DESCONOCIDO') NOT IN (SELECT level FROM trl)) / count(*), 1.0e0 FROM applicants a WHERE base = 'TEST'",
                "SELECT 'target_mean_shift_pct', 100.0e0 * abs(avg(target) FILTER (WHERE base = 'TEST') - avg(target) FILTER (WHERE base = 'TRAIN')) / avg(target) FILTER (WHERE base = 'TRAIN'), 10.0e0 FROM applicants",
                "SELECT 'rmse_increase_pct', 100.0e0 * (max(rmse) FILTER (WHERE base = 'TEST') - max(rmse) FILTER (WHERE base = 'TRAIN')) / max(rmse) FILTER (WHERE base = 'TRAIN'), 10.0e0 FROM rm",
                "SELECT 'gini_drop_pts', 100.0e0 * (max(gini) FILTER (WHERE base = 'TRAIN') - max(gini) FILTER (WHERE base = 'TEST')), 5.0e0 FROM gini",
            ]
        )
        + ")",
    ) + "SELECT rule, round(value, 4) AS value, threshold, CASE WHEN rule = 'features_psi_above_010' THEN value >= threshold ELSE value > threshold END AS triggered FROM rules"


@register("drift_rules", _drift_sql())
def q_drift_rules(spark, sf):
    """Documented monitoring rules, TRAIN -> TEST, as (rule, value, threshold, triggered) rows."""
    c = clean(spark, sf)
    is_te, is_tr = F.col(C.SPLIT) == C.TEST, F.col(C.SPLIT) == C.TRAIN
    psi = ST.psi_by_feature(c.where(is_tr), c.where(is_te), NUM)
    p = psi.agg(F.count_if(F.col("psi") > 0.1).cast("double").alias("above"), F.max("psi").alias("mx"))
    r12 = p.select(F.explode(F.array(
        F.struct(F.lit("features_psi_above_010").alias("rule"), F.col("above").alias("value"), F.lit(2.0).alias("threshold")),
        F.struct(F.lit("max_feature_psi").alias("rule"), F.col("mx").alias("value"), F.lit(0.1).alias("threshold")),
    )).alias("s")).select("s.*")
    # one pass for the null-rate, target-shift and error rules (conditional aggregates per split)
    e2 = F.pow(F.col(C.TARGET) - SCORERS["lin_a"][0](), 2)
    one = c.agg(
        *[(F.lit(100.0) * F.count_if(F.col(x).isNull() & is_te) / F.count_if(is_te) - F.lit(100.0) * F.count_if(F.col(x).isNull() & is_tr) / F.count_if(is_tr)).alias(x)
          for x in NUM],
        F.avg(F.when(is_te, F.col(C.TARGET))).alias("t_te"), F.avg(F.when(is_tr, F.col(C.TARGET))).alias("t_tr"),
        F.sqrt(F.avg(F.when(is_te, e2))).alias("r_te"), F.sqrt(F.avg(F.when(is_tr, e2))).alias("r_tr"),
    )
    r356 = one.select(F.explode(F.array(
        F.struct(F.lit("null_rate_increase_pts").alias("rule"), F.greatest(*[F.col(x) for x in NUM]).alias("value"), F.lit(5.0).alias("threshold")),
        F.struct(F.lit("target_mean_shift_pct").alias("rule"), (F.lit(100.0) * F.abs(F.col("t_te") - F.col("t_tr")) / F.col("t_tr")).alias("value"), F.lit(10.0).alias("threshold")),
        F.struct(F.lit("rmse_increase_pct").alias("rule"), (F.lit(100.0) * (F.col("r_te") - F.col("r_tr")) / F.col("r_tr")).alias("value"), F.lit(10.0).alias("threshold")),
    )).alias("s")).select("s.*")
    lvl = F.coalesce(F.col("x9"), F.lit(C.UNKNOWN_CATEGORY))
    new = Q.new_levels(c, lvl, is_te, is_tr)
    r4 = new.select(F.lit("new_category_share_pct").alias("rule"), F.col("new_share_pct").alias("value"), F.lit(1.0).alias("threshold"))
    pr = c.select(C.SPLIT, C.TARGET, SCORERS["lin_a"][0]().alias("pred"))
    gi = M.gini(pr, C.TARGET, "pred", [C.SPLIT]).agg(
        F.max(F.when(F.col(C.SPLIT) == C.TRAIN, F.col("gini"))).alias("tr"), F.max(F.when(F.col(C.SPLIT) == C.TEST, F.col("gini"))).alias("te")
    )
    r7 = gi.select(F.lit("gini_drop_pts").alias("rule"), (F.lit(100.0) * (F.col("tr") - F.col("te"))).alias("value"), F.lit(5.0).alias("threshold"))
    rules = r12.unionByName(r356).unionByName(r4).unionByName(r7)
    trig = F.when(F.col("rule") == "features_psi_above_010", F.col("value") >= F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    return rules.select("rule", F.round("value", 4).alias("value"), "threshold", trig.alias("triggered"))


# ---------------------------------------------------------------------------
# rules on the scores themselves, TRAIN -> TEST (O6, O7): lin_a is the champion, lin_b the challenger
# ---------------------------------------------------------------------------

#: rule -> threshold (fixed values of the monitoring table)
SCORE_RULES = {
    "score_psi": 0.10, "ks_drop_pts": 5.0, "r2_degradation_pct": 5.0, "gini_degradation_pct": 5.0,
    "new_segment_share_pct": 5.0, "gini_drop_retrain_pts": 10.0, "challenger_rmse_gain": 0.0,
}


def _score_rules_sql():
    pick = ", ".join(
        f"max({k}) FILTER (WHERE model = '{m}' AND base = '{b}') AS {k}_{m[-1]}_{b.lower()}"
        for k in ("rmse", "r2", "gini", "ks") for m in ("lin_a", "lin_b") for b in ("TRAIN", "TEST")
    )
    values = {
        "score_psi": f"(SELECT psi FROM {_sp_tab} WHERE feature = 'lin_a')",
        "ks_drop_pts": "100.0e0 * (ks_a_train - ks_a_test)",
        "r2_degradation_pct": "100.0e0 * (r2_a_train - r2_a_test) / abs(r2_a_train)",
        "gini_degradation_pct": "100.0e0 * (gini_a_train - gini_a_test) / abs(gini_a_train)",
        "new_segment_share_pct": """(SELECT 100.0e0 * count_if(x6 NOT IN (SELECT x6 FROM applicants WHERE base = 'TRAIN' AND x6 IS NOT NULL)) / count(*)
                                     FROM applicants WHERE base = 'TEST')""",
        "gini_drop_retrain_pts": "100.0e0 * (gini_a_train - gini_a_test)",
        "challenger_rmse_gain": "rmse_a_test - rmse_b_test",
    }
    rows = S.union_all([f"SELECT '{r}' AS rule, CAST({v} AS DOUBLE) AS value, {S.lit(SCORE_RULES[r])} AS threshold FROM wide" for r, v in values.items()])
    return S.with_(
        _pr_cte(("lin_a", "lin_b")), *_metric_ctes(), *_sp_ctes,
        "allm AS (SELECT model, base, rmse, r2, gini, ks FROM reg JOIN gini USING (model, base) JOIN ks USING (model, base))",
        f"wide AS (SELECT {pick} FROM allm)",
        f"rules AS ({rows})",
    ) + "SELECT rule, round(value, 4) AS value, threshold, value > threshold AS triggered FROM rules"


@register("score_rules", _score_rules_sql())
def q_score_rules(spark, sf):
    """O6/O7 on scores: PSI, KS and Gini falls, R2 and Gini degradation, new segments, challenger against champion."""
    a = base(spark, sf)
    is_te, is_tr = F.col(C.SPLIT) == C.TEST, F.col(C.SPLIT) == C.TRAIN
    m = M.evaluate(predictions(spark, sf, ("lin_a", "lin_b"), written=a), C.TARGET, "pred", ["model", C.SPLIT])
    pick = [
        F.max(F.when((F.col("model") == n) & (F.col(C.SPLIT) == b), F.col(k))).alias(f"{k}_{n[-1]}_{b.lower()}")
        for k in ("rmse", "r2", "gini", "ks") for n in ("lin_a", "lin_b") for b in (C.TRAIN, C.TEST)
    ]
    score = a.select(C.SPLIT, SCORERS["lin_a"][0]().alias("lin_a"))
    psi = ST.psi_by_feature(score.where(is_tr), score.where(is_te), ["lin_a"]).agg(F.max("psi").alias("psi"))
    seen = a.where(is_tr & F.col("x6").isNotNull()).select("x6").distinct().withColumn("_seen", F.lit(True))
    test = a.where(is_te).join(seen, "x6", "left")
    segment = test.agg((F.try_divide(F.count_if(F.col("_seen").isNull() & F.col("x6").isNotNull()), F.count(F.lit(1))) * 100.0).alias("seg"))
    wide = m.agg(*pick).crossJoin(psi).crossJoin(segment)  # three one-row tables
    c = F.col
    values = {
        "score_psi": c("psi"),
        "ks_drop_pts": (c("ks_a_train") - c("ks_a_test")) * 100.0,
        "r2_degradation_pct": F.try_divide(c("r2_a_train") - c("r2_a_test"), F.abs("r2_a_train")) * 100.0,
        "gini_degradation_pct": F.try_divide(c("gini_a_train") - c("gini_a_test"), F.abs("gini_a_train")) * 100.0,
        "new_segment_share_pct": c("seg"),
        "gini_drop_retrain_pts": (c("gini_a_train") - c("gini_a_test")) * 100.0,
        "challenger_rmse_gain": c("rmse_a_test") - c("rmse_b_test"),
    }
    return ST.rule_rows(wide, [(r, v, SCORE_RULES[r]) for r, v in values.items()])


# ---------------------------------------------------------------------------
# streaming drift (O8): PSI per 7-day window of events.value vs all events
# ---------------------------------------------------------------------------

_s_ctes, _s_tab = S.psi_ctes(
    "SELECT 'value' AS feature, value FROM events",
    "SELECT 'value' AS feature, strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01 00:00:00'), '%Y-%m-%d') AS window_start, value FROM events",
    by=["window_start"],
    prefix="s",
)


@register("stream_drift", S.with_(*_s_ctes) + f"SELECT window_start, n_cur, psi, n_bins_used FROM {_s_tab} JOIN (SELECT window_start, n_cur FROM s_curt) USING (window_start)")
def q_stream_drift(spark, sf):
    ev = read_table(spark, sf, "events")
    ref = unpivot(ev, ["value"]).where(F.col("value").isNotNull())
    edges_row = ST.reference_edges(ref, 10).first()  # at most 11 numbers
    edges = list(edges_row["edges"])
    n_ref = int(edges_row["n_ref"])
    e = F.array(*[F.lit(float(x)) for x in edges])
    counts = {r["bin"]: r["n"] for r in ref.select(ST.histogram_bin(F.col("value"), e).alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    return STR.stream_drift(spark, sf, edges, n_ref=n_ref, ref_counts=counts)
