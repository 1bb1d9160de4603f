"""Registered queries: Spark callables ``(spark, sf_dir) -> DataFrame`` and their SQL twins.

Every query reads the whole driver tables through the applicants derivation
(or the orders/events tables directly); none works on a subset.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import profile as PR
from ..operators import quality as Q
from ..operators import stability as ST
from ..session import materialize
from ..sources.applicants import applicants
from . import sqlparts as S

NUM = list(C.NUMERIC)

QUERIES: dict = {}
SQL: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


def base(spark, sf):
    """The applicants table written once (Parquet, shared checkpoint folder) for
    queries that read it in several passes: every pass scans the written table
    instead of recomputing the line-item aggregation and the joins."""
    return materialize(applicants(spark, sf), "applicants")


def clean(spark, sf):
    return Q.replace_sentinels(base(spark, sf))


# ---------------------------------------------------------------------------
# quality
# ---------------------------------------------------------------------------

def _count_sql(table, conds, n_name, pct_name):
    parts = [f"SELECT '{c}' AS variable, CAST(count_if({cond}) AS BIGINT) AS {n_name}, count(*) AS _n FROM {table}" for c, cond in conds.items()]
    return (
        f"SELECT variable, {n_name}, round(100.0e0 * {n_name} / _n, 2) AS {pct_name} FROM ({S.union_all(parts)}) WHERE {n_name} > 0"
    )


@register(
    "sentinel_summary",
    S.with_() + _count_sql("applicants", {c: f"{c} = -9999998.0e0" for c in ["id", "target", *NUM]}, "n_centinela", "pct_centinela"),
)
def q_sentinel_summary(spark, sf):
    return Q.sentinel_summary(applicants(spark, sf))


@register(
    "missing_summary",
    S.with_(S.clean_cte())
    + _count_sql("clean", {c: f"{c} IS NULL" for c in ["id", "base", "target", *NUM, "x9"]}, "n_missing", "pct_missing"),
)
def q_missing_summary(spark, sf):
    return Q.missing_summary(clean(spark, sf))


@register(
    "sentinel_flags",
    S.with_()
    + "SELECT id, "
    + ", ".join(
        f"CAST(coalesce({c} = {S.lit(s)}, false) AS INTEGER) AS {c}_sin_registro" for c, s in C.SENTINEL_COLS.items()
    )
    + " FROM applicants",
)
def q_sentinel_flags(spark, sf):
    a = applicants(spark, sf)
    return Q.sentinel_flags(a).select(C.ID, *[f"{c}{C.SENTINEL_FLAG_SUFFIX}" for c in C.SENTINEL_COLS])


@register(
    "null_flags",
    S.with_(S.clean_cte())
    + "SELECT id, " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}_sin_dato" for c in C.NULL_FLAG_COLS) + " FROM clean",
)
def q_null_flags(spark, sf):
    return Q.null_flags(clean(spark, sf)).select(C.ID, *[f"{c}{C.NULL_FLAG_SUFFIX}" for c in C.NULL_FLAG_COLS])


_OUTLIER_SQL = S.with_(
    S.clean_cte(),
    f"lng AS ({S.unpivot_sql('clean', NUM)})",
    "q AS (SELECT feature, quantile_cont(value, [0.01e0, 0.25e0, 0.75e0, 0.99e0]) AS qs, max(value) AS mx FROM lng WHERE value IS NOT NULL GROUP BY feature)",
) + """
SELECT l.feature AS variable,
  CAST(count_if(l.value < q.qs[2] - 3.0e0 * (q.qs[3] - q.qs[2]) OR l.value > q.qs[3] + 3.0e0 * (q.qs[3] - q.qs[2])) AS BIGINT) AS n_outliers,
  round(100.0e0 * count_if(l.value < q.qs[2] - 3.0e0 * (q.qs[3] - q.qs[2]) OR l.value > q.qs[3] + 3.0e0 * (q.qs[3] - q.qs[2])) / count(*), 2) AS pct_outliers,
  round(max(q.qs[1]), 6) AS p1, round(max(q.qs[4]), 6) AS p99, round(max(q.mx), 6) AS max
FROM lng l JOIN q ON l.feature = q.feature WHERE l.value IS NOT NULL GROUP BY l.feature
"""


@register(
    "outlier_mask",
    S.with_(
        S.clean_cte(),
        "q AS (SELECT quantile_cont(x10, [0.25e0, 0.75e0]) AS qs FROM clean)",
    )
    + """SELECT id, x10 < qs[1] - 3.0e0 * (qs[2] - qs[1]) OR x10 > qs[2] + 3.0e0 * (qs[2] - qs[1]) AS is_outlier FROM clean, q""",
)
def q_outlier_mask(spark, sf):
    """A3: row-level IQR x 3 outlier flag of one column (NULL stays NULL)."""
    return Q.outlier_mask(clean(spark, sf).select(C.ID, "x10"), "x10").select(C.ID, "is_outlier")


@register("outlier_summary", _OUTLIER_SQL)
def q_outlier_summary(spark, sf):
    return Q.outlier_summary(clean(spark, sf), NUM, 3.0)


@register(
    "capping_impact",
    S.with_(
        S.clean_cte(),
        f"lng AS ({S.unpivot_sql('clean', NUM, where="base = 'TRAIN'")})",
        "q AS (SELECT feature, quantile_cont(value, [0.25e0, 0.75e0]) AS qs FROM lng WHERE value IS NOT NULL GROUP BY feature)",
        "b AS (SELECT feature, qs[1] - 3.0e0 * (qs[2] - qs[1]) AS lower, qs[2] + 3.0e0 * (qs[2] - qs[1]) AS upper FROM q)",
    )
    + """
SELECT l.feature AS variable, count(*) AS n, CAST(count_if(l.value < b.lower OR l.value > b.upper) AS BIGINT) AS n_affected,
  round(100.0e0 * count_if(l.value < b.lower OR l.value > b.upper) / count(*), 2) AS pct_affected,
  round(max(b.lower), 6) AS lower, round(max(b.upper), 6) AS upper
FROM lng l JOIN b ON l.feature = b.feature WHERE l.value IS NOT NULL GROUP BY l.feature
""",
)
def q_capping_impact(spark, sf):
    train = clean(spark, sf).where(F.col(C.SPLIT) == C.TRAIN)
    return Q.capping_impact(train, NUM, 3.0)


def _impact_sql(masks, n_label, a_label):
    parts = [
        f"""SELECT '{c}' AS variable, CAST(count_if({mf}) AS BIGINT) AS {n_label}, avg(CASE WHEN {mf} THEN target END) AS a,
                avg(CASE WHEN {mr} THEN target END) AS b FROM applicants"""
        for c, (mf, mr) in masks.items()
    ]
    return (
        S.with_()
        + f"""SELECT variable, {n_label}, round(a, 6) AS target_mean_{a_label}, round(b, 6) AS target_mean_real,
        round((a - b) / b * 100.0e0, 4) AS diff_pct FROM ({S.union_all(parts)}) WHERE {n_label} > 0"""
    )


@register(
    "sentinel_impact",
    _impact_sql({c: (f"{c} = -9999998.0e0", f"{c} <> -9999998.0e0 AND {c} IS NOT NULL") for c in ["x3", "x4"]}, "n_sentinel", "sentinel"),
)
def q_sentinel_impact(spark, sf):
    return Q.sentinel_impact(base(spark, sf))


@register(
    "null_impact",
    _impact_sql({c: (f"{c} IS NULL", f"{c} IS NOT NULL AND {c} <> -9999998.0e0") for c in C.NULL_FLAG_COLS}, "n_null", "null"),
)
def q_null_impact(spark, sf):
    return Q.null_impact(base(spark, sf))


@register(
    "segment_table",
    S.with_(
        "f AS (SELECT CAST(coalesce(x3 = -9999998.0e0, false) AS INTEGER) AS x3_flag, CAST(coalesce(x4 = -9999998.0e0, false) AS INTEGER) AS x4_flag, target FROM applicants)"
    )
    + """SELECT x3_flag, x4_flag, count(*) AS n, round(100.0e0 * count(*) / (SELECT count(*) FROM f), 1) AS pct,
       round(quantile_cont(target, 0.5e0), 6) AS median_target FROM f GROUP BY x3_flag, x4_flag""",
)
def q_segment_table(spark, sf):
    return Q.segment_table(base(spark, sf))


@register(
    "positivity",
    S.with_()
    + S.union_all(
        [
            f"""SELECT '{c}' AS variable, min(v) AS min, max(v) AS max, round(100.0e0 * count_if(v > 0) / count(v), 1) AS pct_positive,
                round(100.0e0 * count_if(v = 0) / count(v), 1) AS pct_zero FROM (SELECT CASE WHEN {c} <> -9999998.0e0 THEN {c} END AS v FROM applicants)"""
            for c in ["x3", "x4"]
        ]
    ),
)
def q_positivity(spark, sf):
    return Q.positivity(applicants(spark, sf))


@register(
    "real_nulls",
    S.with_() + S.union_all([f"SELECT '{c}' AS variable, CAST(count_if({c} IS NULL) AS BIGINT) AS n_real_null FROM applicants" for c in ["x3", "x4"]]),
)
def q_real_nulls(spark, sf):
    return Q.real_nulls(applicants(spark, sf))


# ---------------------------------------------------------------------------
# profiling
# ---------------------------------------------------------------------------

@register(
    "split_counts",
    S.with_() + "SELECT base, count(*) AS n, round(100.0e0 * count(*) / (SELECT count(*) FROM applicants), 2) AS pct FROM applicants GROUP BY base",
)
def q_split_counts(spark, sf):
    return PR.value_counts(base(spark, sf), C.SPLIT)


@register(
    "value_counts_x9",
    S.with_() + "SELECT x9, count(*) AS n, round(100.0e0 * count(*) / (SELECT count(*) FROM applicants), 2) AS pct FROM applicants WHERE x9 IS NOT NULL GROUP BY x9",
)
def q_value_counts_x9(spark, sf):
    return PR.value_counts(base(spark, sf), "x9")


def _describe_sql(table, cols):
    probs = PR.DESCRIBE_PROBS
    names = [f"p{int(round(p * 100)):02d}" for p in probs]
    plist = ", ".join(S.lit(p) for p in probs)
    return (
        f"lng AS ({S.unpivot_sql(table, cols)})",
        f"""SELECT feature AS variable, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
        round(min(value), 6) AS min, {', '.join(f'round(quantile_cont(value, [{plist}])[{i + 1}], 6) AS {n}' for i, n in enumerate(names))},
        round(max(value), 6) AS max FROM lng WHERE value IS NOT NULL GROUP BY feature""",
    )


_d = _describe_sql("clean", ["target"])
SQL_DESCRIBE_TARGET = S.with_(S.clean_cte(), _d[0]) + _d[1]
_d2 = _describe_sql("clean", NUM)
SQL_DESCRIBE_NUMERIC = S.with_(S.clean_cte(), _d2[0]) + _d2[1]


@register("describe_target", SQL_DESCRIBE_TARGET)
def q_describe_target(spark, sf):
    return PR.describe(clean(spark, sf), [C.TARGET])


@register("describe_numeric", SQL_DESCRIBE_NUMERIC)
def q_describe_numeric(spark, sf):
    return PR.describe(clean(spark, sf), NUM)


@register(
    "moments",
    S.with_(S.clean_cte(), f"lng AS ({S.unpivot_sql('clean', ['target', *NUM])})")
    + "SELECT feature AS variable, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurt FROM lng WHERE value IS NOT NULL GROUP BY feature",
)
def q_moments(spark, sf):
    return PR.bias_corrected_moments(clean(spark, sf), [C.TARGET, *NUM])


@register(
    "histogram",
    S.with_(
        "rng AS (SELECT min(target) AS lo, max(target) AS hi, count(*) AS n FROM applicants WHERE target IS NOT NULL)",
        "bins AS (SELECT least(49, CAST(floor((target - lo) * 50 / (hi - lo)) AS INTEGER)) AS bin FROM applicants, rng WHERE target >= lo AND target <= hi)",
        "cnt AS (SELECT bin, count(*) AS n FROM bins GROUP BY bin)",
        "grid AS (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS bin, lo, hi, n AS total FROM rng)",
    )
    + """SELECT g.bin, round(lo + g.bin * ((hi - lo) / 50), 6) AS lower, round(lo + (g.bin + 1) * ((hi - lo) / 50), 6) AS upper,
       coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (total * ((hi - lo) / 50)), 12) AS density
       FROM grid g LEFT JOIN cnt c ON g.bin = c.bin""",
)
def q_histogram(spark, sf):
    return PR.histogram(base(spark, sf), C.TARGET, 50)


_MISS = ["x3", "x4", "x5", "x11", "x12"]


def _pair_sql(table, cols, expr):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}' AS var_a, '{b}' AS var_b, round({expr(a, b)}, 6) AS corr FROM {table}")
    return S.union_all(parts)


@register(
    "missing_corr",
    S.with_(S.clean_cte())
    + _pair_sql("clean", _MISS, lambda a, b: f"corr(CAST({a} IS NULL AS DOUBLE), CAST({b} IS NULL AS DOUBLE))"),
)
def q_missing_corr(spark, sf):
    return PR.missing_correlation(clean(spark, sf), _MISS)


@register(
    "co_missing_rate",
    S.with_(S.clean_cte())
    + "SELECT round(avg(CAST((x11 IS NULL) = (x12 IS NULL) AS DOUBLE)), 6) AS agreement, count(*) AS n FROM clean",
)
def q_co_missing_rate(spark, sf):
    return PR.co_missing_rate(clean(spark, sf), "x11", "x12")


@register(
    "target_by_category",
    S.with_(S.clean_cte())
    + """SELECT x9, round(avg(target), 6) AS mean, round(quantile_cont(target, 0.5e0), 6) AS median, count(*) AS count
       FROM clean WHERE x9 IS NOT NULL GROUP BY x9 ORDER BY mean DESC, x9 LIMIT 20""",
)
def q_target_by_category(spark, sf):
    return PR.target_by_category(clean(spark, sf), "x9")


@register(
    "corr_matrix",
    S.with_(S.clean_cte()) + _pair_sql("clean", [*NUM, "target"], lambda a, b: f"corr({a}, {b})"),
)
def q_corr_matrix(spark, sf):
    return PR.correlation_matrix(clean(spark, sf), [*NUM, C.TARGET])


@register(
    "corr_with_target",
    S.with_(S.clean_cte())
    + "SELECT feature, r_target FROM ("
    + S.union_all([f"SELECT '{c}' AS feature, round(corr({c}, target), 6) AS r_target FROM clean" for c in NUM])
    + ") ORDER BY abs(r_target) DESC, feature LIMIT 6",
)
def q_corr_with_target(spark, sf):
    return PR.correlation_with_target(clean(spark, sf), NUM, top=6)


@register(
    "log_corr",
    S.with_(S.clean_cte())
    + S.union_all(
        [
            f"SELECT '{c}' AS feature, round(corr({c}, target), 6) AS r_target, round(corr({c}, ln(target)), 6) AS r_log_target FROM clean"
            for c in NUM
        ]
    ),
)
def q_log_corr(spark, sf):
    return PR.correlation_with_target(clean(spark, sf), NUM, log_target=True)


@register(
    "linear_trend",
    S.with_(S.clean_cte())
    + S.union_all(
        [
            f"SELECT '{c}' AS feature, round(regr_slope(target, {c}), 6) AS slope, round(regr_intercept(target, {c}), 6) AS intercept FROM clean"
            for c in NUM
        ]
    ),
)
def q_linear_trend(spark, sf):
    return PR.linear_trend(clean(spark, sf), NUM)


_MED_COLS = ["x1", "x2", "x3", "x4", "x5", "x7", "x11", "x12"]


@register(
    "split_medians",
    S.with_(S.clean_cte())
    + "SELECT variable, round(ma, 6) AS median_train, round(mb, 6) AS median_test, round(abs(ma - mb) / (abs(ma) + 1.0e-6) * 100.0e0, 6) AS diff_pct FROM ("
    + S.union_all(
        [
            f"SELECT '{c}' AS variable, quantile_cont({c}, 0.5e0) FILTER (WHERE base = 'TRAIN') AS ma, quantile_cont({c}, 0.5e0) FILTER (WHERE base = 'TEST') AS mb FROM clean"
            for c in _MED_COLS
        ]
    )
    + ")",
)
def q_split_medians(spark, sf):
    return PR.split_medians(clean(spark, sf), _MED_COLS)


@register(
    "pareto",
    S.with_(
        "vc AS (SELECT x9, count(*) AS n FROM applicants WHERE x9 IS NOT NULL GROUP BY x9)",
        "cum AS (SELECT n, 100.0e0 * sum(n) OVER (ORDER BY n DESC, x9 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(n) OVER () AS cp FROM vc)",
    )
    + "SELECT count(*) AS n_categories, CAST(count_if(cp <= 80.0e0) + 1 AS BIGINT) AS n_for_80, CAST(count_if(cp <= 95.0e0) + 1 AS BIGINT) AS n_for_95 FROM cum",
)
def q_pareto(spark, sf):
    return PR.pareto(base(spark, sf), "x9")


@register(
    "ks_two_sample",
    S.with_(
        "v AS (SELECT target, count_if(base = 'TRAIN') AS ca, count_if(base = 'TEST') AS cb FROM applicants WHERE target IS NOT NULL GROUP BY target)",
        "c AS (SELECT sum(ca) OVER w / sum(ca) OVER () AS fa, sum(cb) OVER w / sum(cb) OVER () AS fb, sum(ca) OVER () AS n_a, sum(cb) OVER () AS n_b FROM v WINDOW w AS (ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
        "d AS (SELECT CAST(max(n_a) AS BIGINT) AS n_a, CAST(max(n_b) AS BIGINT) AS n_b, max(abs(fa - fb)) AS d FROM c)",
    )
    + """SELECT n_a, n_b, round(d, 6) AS ks_stat,
       round(CASE WHEN sqrt(n_a * n_b / (n_a + n_b)) * d <= 0 THEN 1.0e0 ELSE least(1.0e0, greatest(0.0e0, 2.0e0 *
         list_sum(list_transform(range(1, 101), lambda k: pow(-1.0e0, k - 1) * exp(-2.0e0 * k * k * (sqrt(n_a * n_b / (n_a + n_b)) * d) * (sqrt(n_a * n_b / (n_a + n_b)) * d)))))) END, 6) AS p_value
       FROM d""",
)
def q_ks_two_sample(spark, sf):
    return PR.ks_two_sample(base(spark, sf), C.TARGET, C.SPLIT, C.TRAIN, C.TEST)


# ---------------------------------------------------------------------------
# stability
# ---------------------------------------------------------------------------

_psi_ctes, _psi_tab = S.psi_ctes(
    S.unpivot_sql("clean", NUM, where="base = 'TRAIN'"), S.unpivot_sql("clean", NUM, where="base = 'TEST'")
)


@register(
    "psi_features",
    S.with_(S.clean_cte(), *_psi_ctes) + f"SELECT feature, psi, {S.psi_status()} AS status, n_bins_used FROM {_psi_tab}",
)
def q_psi_features(spark, sf):
    c = clean(spark, sf)
    return ST.psi_by_feature(c.where(F.col(C.SPLIT) == C.TRAIN), c.where(F.col(C.SPLIT) == C.TEST), NUM)
