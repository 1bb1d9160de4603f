"""Registered preprocessing queries (F2-F10, P4-P19) and their SQL twins.

Each Spark query fits ``RiskPreprocessor`` on the TRAIN rows and transforms
every applicant; the SQL twin restates the fit statistics and the transform.
Feature values are rounded to 6 decimals at report level only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import prep as P
from ..operators import quality as Q
from ..sources.applicants import applicants
from . import sqlparts as S
from .catalog import NUM, base, register

R = 6  # report rounding


def fitted(spark, sf, **params):
    a = base(spark, sf)
    model = P.RiskPreprocessor(**params).fit(a.where(F.col(C.SPLIT) == C.TRAIN))
    return a, model


def _rounded(df, keep=(C.ID,)):
    out = []
    for n, t in df.dtypes:
        if n in keep:
            out.append(F.col(n))
        elif t in ("double", "float"):
            out.append(F.round(F.col(n), R).alias(n))
        else:
            out.append(F.col(n))
    return df.select(*out)


# ---------------------------------------------------------------------------
# SQL twin of fit + transform
# ---------------------------------------------------------------------------

def _prep_ctes(target_encode: bool = True, top_n: int = 10) -> list[str]:
    q = ", ".join(f"quantile_cont({c}, [0.25e0, 0.5e0, 0.75e0]) AS q_{c}" for c in NUM)
    ctes = [
        S.clean_cte(),
        "tr AS (SELECT * FROM clean WHERE base = 'TRAIN')",
        f"st AS (SELECT {q} FROM tr)",
    ]
    # fences, fill
    fs = []
    for c in NUM:
        fs += [
            f"q_{c}[1] - 3.0e0 * (q_{c}[3] - q_{c}[1]) AS lo_{c}",
            f"q_{c}[3] + 3.0e0 * (q_{c}[3] - q_{c}[1]) AS hi_{c}",
            f"q_{c}[2] AS med_{c}",
        ]
    ctes.append(f"fit AS (SELECT {', '.join(fs)} FROM st)")
    ctes.append(
        "cap AS (SELECT quantile_cont(coalesce(tr.x2, fit.med_x2) / greatest(coalesce(nullif(coalesce(tr.x1, fit.med_x1), 0.0e0), fit.med_x1), 1.0e0), 0.99e0) AS cap FROM tr, fit)"
    )
    if target_encode:
        ctes.append("gm AS (SELECT avg(target) AS g FROM applicants WHERE base = 'TRAIN')")
        ctes.append(
            "enc AS (SELECT level, (n * mean + 10.0e0 * g) / (n + 10.0e0) AS encoding FROM (SELECT coalesce(x9, 'DESCONOCIDO') AS level, count(*) AS n, avg(target) AS mean FROM applicants WHERE base = 'TRAIN' GROUP BY 1), gm)"
        )
    else:
        ctes.append(
            f"topl AS (SELECT level FROM (SELECT coalesce(x9, 'DESCONOCIDO') AS level, count(*) AS n FROM applicants WHERE base = 'TRAIN' GROUP BY 1) ORDER BY n DESC, level LIMIT {top_n})"
        )
    # base values: flags on raw, codes nulled, clipped, imputed
    flags = [f"CAST(coalesce(a.{c} = {S.lit(s)}, false) AS INTEGER) AS {c}_sin_registro" for c, s in C.SENTINEL_COLS.items()]
    nulls = [f"CAST(c.{c} IS NULL AS INTEGER) AS {c}_sin_dato" for c in C.NULL_FLAG_COLS]
    vals = [f"coalesce(CASE WHEN c.{c} IS NOT NULL THEN least(greatest(c.{c}, fit.lo_{c}), fit.hi_{c}) END, fit.med_{c}) AS {c}" for c in NUM]
    ctes.append(
        f"""b AS (SELECT a.id, a.base, a.target, a.x9, {', '.join(flags)}, {', '.join(nulls)}, {', '.join(vals)}, fit.med_x1 AS den_fill, cap.cap
            FROM applicants a JOIN clean c ON a.id = c.id, fit, cap)"""
    )
    lg = lambda e: f"ln(1 + greatest({e}, 0.0e0))"
    x7lab = (
        "CASE WHEN x7c >= 0.0e0 AND x7c < 600.0e0 THEN 'x7_lt600' WHEN x7c >= 600.0e0 AND x7c < 700.0e0 THEN 'x7_600_700' "
        "WHEN x7c >= 700.0e0 AND x7c < 750.0e0 THEN 'x7_700_750' WHEN x7c >= 750.0e0 AND x7c < 800.0e0 THEN 'x7_750_800' "
        "WHEN x7c >= 800.0e0 AND x7c < 850.0e0 THEN 'x7_800_850' WHEN x7c >= 850.0e0 AND x7c < 1001.0e0 THEN 'x7_gt850' ELSE 'x7_lt600' END"
    )
    x8lv = "CASE WHEN CAST(round_even(x8, 0) AS BIGINT) IN (1, 2, 3, 4, 5) THEN CAST(CAST(round_even(x8, 0) AS BIGINT) AS VARCHAR) ELSE 'otro' END"
    feats = [
        *[f"{lg(c)} AS {c}_log" for c in C.LOG_COLS],
        "x3_sin_registro + x4_sin_registro AS n_productos_sin_registro",
        f"{lg('x3 + x4')} AS total_balance_log",
        "coalesce(x3 / nullif(x3 + x4, 0.0e0), 0.5e0) AS x3_share",
        f"{lg('x7')} * {lg('x1')} AS score_x_ingreso",
        f"{lg('x1')} * {lg('x10')} AS x1_x_x10_log",
        "least(x2 / greatest(coalesce(nullif(x1, 0.0e0), den_fill), 1.0e0), cap) AS ratio_x2_x1",
        "x11 + x12 AS x11_x12_sum",
        "x1_sin_dato * x2_sin_dato AS co_missing_x1_x2",
        f"x6 * {lg('x1')} AS x6_x_x1_log",
        "x6 * x7 AS x6_x_x7",
        f"x6 * ({lg('x7')} * {lg('x1')}) AS x6_x_score_ingreso",
        f"{x7lab} AS x7_label",
        f"{x8lv} AS x8_level",
    ]
    ctes.append(f"f0 AS (SELECT *, least(greatest(x7, 0.0e0), 1000.0e0) AS x7c FROM b)")
    ctes.append(f"f1 AS (SELECT *, {', '.join(feats)} FROM f0)")
    if target_encode:
        ctes.append("feat AS (SELECT f1.*, coalesce(enc.encoding, (SELECT g FROM gm)) AS x9_target_enc FROM f1 LEFT JOIN enc ON coalesce(f1.x9, 'DESCONOCIDO') = enc.level)")
    else:
        ctes.append(
            "feat AS (SELECT f1.*, CASE WHEN coalesce(f1.x9, 'DESCONOCIDO') IN (SELECT level FROM topl) THEN coalesce(f1.x9, 'DESCONOCIDO') ELSE 'OTROS' END AS x9_level FROM f1)"
        )
    return ctes


X7_COLS = sorted(P.X7_LABELS)
X8_LEVELS = ["1", "2", "3", "4", "5", "otro"]
LOGS = [f"{c}_log" for c in C.LOG_COLS]
INTER = [
    "n_productos_sin_registro", "total_balance_log", "x3_share", "score_x_ingreso", "x1_x_x10_log", "ratio_x2_x1",
    "x11_x12_sum", "co_missing_x1_x2", "x6_x_x1_log", "x6_x_x7", "x6_x_score_ingreso",
]
FLAGS = [f"{c}_sin_registro" for c in C.SENTINEL_COLS] + [f"{c}_sin_dato" for c in C.NULL_FLAG_COLS]
IMPUTED = [c for c in NUM if c != "x8"]


def _r(c):
    return f"round({c}, {R}) AS {c}"


def _dum(label_col, level, name):
    return f"CAST({label_col} = '{level}' AS INTEGER) AS {name}"


PREP = S.with_(*_prep_ctes())


@register(
    "clip_bounds",
    S.with_(*_prep_ctes()[:4])
    + "SELECT variable, round(lower, 6) AS lower, round(upper, 6) AS upper, round(median, 6) AS median FROM ("
    + S.union_all([f"SELECT '{c}' AS variable, lo_{c} AS lower, hi_{c} AS upper, med_{c} AS median FROM fit" for c in NUM])
    + ")",
)
def q_clip_bounds(spark, sf):
    _, m = fitted(spark, sf)
    s = m.state
    rows = [(c, s["bounds"][c][0], s["bounds"][c][1], s["fill"][c]) for c in s["numeric"]]
    df = spark.createDataFrame(rows, "variable string, lower double, upper double, median double")
    return df.select("variable", *[F.round(c, 6).alias(c) for c in ("lower", "upper", "median")])


@register(
    "ratio_cap",
    S.with_(*_prep_ctes()[:5]) + "SELECT round(cap, 6) AS ratio_cap, round((SELECT med_x1 FROM fit), 6) AS den_fill FROM cap",
)
def q_ratio_cap(spark, sf):
    _, m = fitted(spark, sf)
    return spark.createDataFrame([(m.state["ratio_cap"], m.state["den_fill"])], "ratio_cap double, den_fill double").select(
        F.round("ratio_cap", 6).alias("ratio_cap"), F.round("den_fill", 6).alias("den_fill")
    )


@register("impute_median", PREP + f"SELECT id, {', '.join(_r(c) for c in IMPUTED)} FROM feat")
def q_impute_median(spark, sf):
    a, m = fitted(spark, sf)
    return _rounded(m.transform(a).select(C.ID, *IMPUTED))


@register("log_features", PREP + f"SELECT id, {', '.join(_r(c) for c in LOGS)} FROM feat")
def q_log_features(spark, sf):
    a, m = fitted(spark, sf)
    return _rounded(m.transform(a).select(C.ID, *LOGS))


@register("ratio_capped", PREP + f"SELECT id, {_r('ratio_x2_x1')} FROM feat")
def q_ratio_capped(spark, sf):
    a, m = fitted(spark, sf)
    return _rounded(m.transform(a).select(C.ID, "ratio_x2_x1"))


@register("interactions", PREP + f"SELECT id, {', '.join(_r(c) for c in INTER)} FROM feat")
def q_interactions(spark, sf):
    a, m = fitted(spark, sf)
    return _rounded(m.transform(a).select(C.ID, *INTER))


@register("x7_buckets", PREP + f"SELECT id, {', '.join(_dum('x7_label', c, c) for c in X7_COLS)} FROM feat")
def q_x7_buckets(spark, sf):
    a, m = fitted(spark, sf)
    return m.transform(a).select(C.ID, *X7_COLS)


@register("x8_onehot", PREP + f"SELECT id, {', '.join(_dum('x8_level', lv, f'x8_cat_{lv}') for lv in X8_LEVELS)} FROM feat")
def q_x8_onehot(spark, sf):
    a, m = fitted(spark, sf)
    return m.transform(a).select(C.ID, *[f"x8_cat_{lv}" for lv in m.state["x8_levels"]])


@register(
    "target_encoding",
    S.with_("gm AS (SELECT avg(target) AS g FROM applicants WHERE base = 'TRAIN')")
    + """SELECT level, n, round(mean, 6) AS mean, round((n * mean + 10.0e0 * g) / (n + 10.0e0), 6) AS encoding
       FROM (SELECT coalesce(x9, 'DESCONOCIDO') AS level, count(*) AS n, avg(target) AS mean FROM applicants WHERE base = 'TRAIN' GROUP BY 1), gm""",
)
def q_target_encoding(spark, sf):
    train = base(spark, sf).where(F.col(C.SPLIT) == C.TRAIN)
    t = P.target_encoding_table(train, "x9", C.TARGET, 10.0)
    return t.select("level", "n", F.round("mean", 6).alias("mean"), F.round("encoding", 6).alias("encoding"))


_TOPN = 10
_TOP_CTES = _prep_ctes(target_encode=False, top_n=_TOPN)


def _topn_sql():
    # layout: the top levels plus OTROS, sorted; computed by the engine from the same data
    return (
        S.with_(*_TOP_CTES)
        + "SELECT id, x9_level FROM feat"
    )


@register("topn_onehot")
def q_topn_onehot(spark, sf):
    a, m = fitted(spark, sf, labelCol="", topN=_TOPN)
    cols = [f"x9_{lv}" for lv in m.state["top_levels"]["layout"]]
    t = m.transform(a).select(C.ID, *cols)
    # one row per applicant with the level whose dummy is set (long form keeps the schema fixed)
    level = F.coalesce(*[F.when(F.col(c) == 1, F.lit(c[3:])) for c in cols])
    return t.select(C.ID, level.alias("x9_level"))


SQL_TOPN = _topn_sql()


@register(
    "prep_full",
    PREP
    + "SELECT id, base, round(target, 6) AS target, "
    + ", ".join(
        [_r(c) for c in IMPUTED]
        + FLAGS
        + [_r(c) for c in LOGS]
        + [_r(c) for c in INTER]
        + [_dum("x7_label", c, c) for c in X7_COLS]
        + [_dum("x8_level", lv, f"x8_cat_{lv}") for lv in X8_LEVELS]
        + [_r("x9_target_enc")]
    )
    + " FROM feat",
)
def q_prep_full(spark, sf):
    a, m = fitted(spark, sf)
    return _rounded(m.transform(a))


_CHECK_COLS = IMPUTED + LOGS + INTER + ["x9_target_enc"]
_FLAG_MATCH = " AND ".join(
    f"(SELECT sum({c}_sin_registro) FROM feat) = (SELECT count_if({c} = {S.lit(s)}) FROM applicants)" for c, s in C.SENTINEL_COLS.items()
)
_NULLS = " + ".join(f"count_if({c} IS NULL)" for c in _CHECK_COLS)
_CODES = " + ".join(f"count_if({c} IN (-9999998.0e0, -99000720.0e0, -99000792.0e0))" for c in _CHECK_COLS)


@register(
    "prep_checks",
    PREP
    + f"""SELECT null_cells, sentinel_cells, flags_match_codes, null_cells = 0 AND sentinel_cells = 0 AND flags_match_codes AS passed
        FROM (SELECT CAST({_NULLS} AS BIGINT) AS null_cells, CAST({_CODES} AS BIGINT) AS sentinel_cells, ({_FLAG_MATCH}) AS flags_match_codes FROM feat)""",
)
def q_prep_checks(spark, sf):
    a, m = fitted(spark, sf)
    return Q.post_conditions(a, m.transform(a))


# the top-N twin is registered after its query (same name)
from .catalog import SQL as _SQL  # noqa: E402

_SQL["topn_onehot"] = SQL_TOPN
