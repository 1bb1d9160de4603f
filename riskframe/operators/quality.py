"""Data-quality operators.

Every summary is one wide aggregate over the table (one scan, partial
aggregation in each task, a single-row result) followed by an unpivot of that
one row; quantile-based ones use the distributed exact quantiles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from .prefix import _cum_name, _tot_name, exact_quantiles, running_totals, unpivot
from .profile import kolmogorov_sf


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns, decided at plan time from the schema."""
    num = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [n for n, t in df.dtypes if (t in num or t.startswith("decimal")) and n not in exclude]


def replace_sentinels(
    df: DataFrame,
    sentinel: float = C.SENTINEL,
    per_column: Mapping[str, float] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The generic code becomes NULL in every numeric column, per-column codes in their column.

    Returns a new DataFrame; the input is untouched (DataFrames are immutable).
    """
    per_column = dict(C.SENTINEL_COLS if per_column is None else per_column)
    cols = set(columns if columns is not None else numeric_columns(df))
    out = []
    for name in df.columns:
        if name in cols:
            codes = [sentinel]
            if name in per_column and per_column[name] != sentinel:
                codes.append(per_column[name])
            out.append(X.null_if_sentinel(name, codes).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def sentinel_flags(df: DataFrame, codes: Mapping[str, float] | None = None) -> DataFrame:
    """``{c}_sin_registro`` = 1 where the raw value equals its code (taken before P3)."""
    codes = dict(C.SENTINEL_COLS if codes is None else codes)
    return df.select(
        "*", *[X.sentinel_flag(c, s).alias(f"{c}{C.SENTINEL_FLAG_SUFFIX}") for c, s in codes.items() if c in df.columns]
    )


def null_flags(df: DataFrame, cols: Sequence[str] = C.NULL_FLAG_COLS) -> DataFrame:
    """P5: ``{c}_sin_dato`` = 1 where NULL (taken after P3)."""
    return df.select("*", *[X.null_flag(c).alias(f"{c}{C.NULL_FLAG_SUFFIX}") for c in cols if c in df.columns])


def _count_table(df: DataFrame, conds: Mapping[str, object], n_name: str, pct_name: str, key: str = "variable") -> DataFrame:
    """One aggregate of conditional counts -> (key, n, pct) rows with n > 0, sorted by pct desc."""
    names = list(conds)
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(conds[c]).alias(c) for c in names])
    long = wide.unpivot(["_n"], names, key, n_name)
    return (
        long.where(F.col(n_name) > 0)
        .select(key, F.col(n_name), X.pct(F.col(n_name), F.col("_n")).alias(pct_name))
        .orderBy(F.col(pct_name).desc(), F.col(key))
    )


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A1: per column NULL count and percent (2 dp), only columns with any NULL."""
    cols = list(columns or df.columns)
    return _count_table(df, {c: F.col(c).isNull() for c in cols}, "n_missing", "pct_missing")


def sentinel_summary(df: DataFrame, sentinel: float = C.SENTINEL, columns: Sequence[str] | None = None) -> DataFrame:
    """A2: per numeric column count of cells equal to the code, only columns that have it."""
    cols = list(columns or numeric_columns(df))
    return _count_table(df, {c: F.col(c) == F.lit(float(sentinel)) for c in cols}, "n_centinela", "pct_centinela")


def iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float = 3.0, within: Sequence[str] = ()) -> DataFrame:
    """Per column (feature, q1, q3, lower, upper) with [q1 - f*iqr, q3 + f*iqr] on non-null values."""
    long = unpivot(df, columns, ids=list(within))
    q = exact_quantiles(long, "value", [0.25, 0.75], within=[*within, "feature"], names=["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        *within, "feature", "n", "q1", "q3",
        (F.col("q1") - F.lit(float(factor)) * iqr).alias("lower"),
        (F.col("q3") + F.lit(float(factor)) * iqr).alias("upper"),
    )


def outlier_mask(df: DataFrame, column: str, factor: float = 3.0, name: str = "is_outlier") -> DataFrame:
    """A3: boolean column, strictly outside the IQR fence; NULL stays NULL.

    The fence is a one-row table joined to every row (broadcast: one row by construction).
    """
    b = iqr_bounds(df, [column], factor).select("lower", "upper")
    x = F.col(column)
    return df.crossJoin(F.broadcast(b)).select(
        *[F.col(c) for c in df.columns], ((x < F.col("lower")) | (x > F.col("upper"))).alias(name)
    )


def outlier_summary(df: DataFrame, columns: Sequence[str], factor: float = 3.0) -> DataFrame:
    """A4: per column n outliers, % (2 dp), p1, p99, max (1 dp) on non-null values."""
    long = unpivot(df, columns).where(F.col("value").isNotNull())
    q = exact_quantiles(long, "value", [0.01, 0.25, 0.75, 0.99], within=["feature"], names=["p1", "q1", "q3", "p99"])
    iqr = F.col("q3") - F.col("q1")
    fences = q.select(
        "feature", "p1", "p99",
        (F.col("q1") - F.lit(float(factor)) * iqr).alias("lo"),
        (F.col("q3") + F.lit(float(factor)) * iqr).alias("hi"),
    )
    v = F.col("value")
    counted = (
        long.join(F.broadcast(fences), "feature")
        .groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if((v < F.col("lo")) | (v > F.col("hi"))).alias("n_outliers"),
            F.max("p1").alias("p1"),
            F.max("p99").alias("p99"),
            F.max(v).alias("max"),
        )
    )
    return counted.select(
        F.col("feature").alias("variable"),
        "n_outliers",
        X.pct(F.col("n_outliers"), F.col("n")).alias("pct_outliers"),
        F.round("p1", 6).alias("p1"),
        F.round("p99", 6).alias("p99"),
        F.round("max", 6).alias("max"),
    )


def capping_impact(df: DataFrame, columns: Sequence[str], factor: float = 3.0) -> DataFrame:
    """Rows changed by the IQR clip, per column, with the fence."""
    long = unpivot(df, columns).where(F.col("value").isNotNull())
    b = iqr_bounds(df, columns, factor).select("feature", "lower", "upper")
    v = F.col("value")
    agg = (
        long.join(F.broadcast(b), "feature")
        .groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if((v < F.col("lower")) | (v > F.col("upper"))).alias("n_affected"),
            F.max("lower").alias("lower"),
            F.max("upper").alias("upper"),
        )
    )
    return agg.select(
        F.col("feature").alias("variable"), "n", "n_affected", X.pct(F.col("n_affected"), F.col("n")).alias("pct_affected"),
        F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"),
    )


def _impact(df: DataFrame, target: str, masks: Mapping[str, tuple], n_label: str, a_label: str) -> DataFrame:
    """Conditional target means for (flagged, real) masks per column in one aggregate."""
    t = F.col(target)
    aggs = []
    for c, (m_flag, m_real) in masks.items():
        aggs += [
            F.count_if(m_flag).alias(f"{c}__n"),
            F.avg(F.when(m_flag, t)).alias(f"{c}__a"),
            F.avg(F.when(m_real, t)).alias(f"{c}__b"),
        ]
    wide = df.agg(*aggs)
    parts = [
        F.struct(F.lit(c).alias("variable"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__a").alias("a"), F.col(f"{c}__b").alias("b"))
        for c in masks
    ]
    long = wide.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
    return long.where(F.col("n") > 0).select(
        "variable",
        F.col("n").alias(n_label),
        F.round("a", 6).alias(f"target_mean_{a_label}"),
        F.round("b", 6).alias("target_mean_real"),
        F.round(F.try_divide(F.col("a") - F.col("b"), F.col("b")) * F.lit(100.0), 4).alias("diff_pct"),
    )


def sentinel_impact(df: DataFrame, target: str = C.TARGET, codes: Mapping[str, float] | None = None) -> DataFrame:
    """Per column n with the code, mean target with code vs with a real value, % difference."""
    codes = dict({"x3": C.SENTINEL, "x4": C.SENTINEL} if codes is None else codes)
    masks = {c: (F.col(c) == F.lit(s), (F.col(c) != F.lit(s)) & F.col(c).isNotNull()) for c, s in codes.items()}
    return _impact(df, target, masks, "n_sentinel", "sentinel")


def sentinel_impact_test(df: DataFrame, target: str = C.TARGET, codes: Mapping[str, float] | None = None) -> DataFrame:
    """A16 with its test: ``sentinel_impact`` and, per column, the two-sample KS distance and p of the target of coded against real rows.

    All columns share one range-ordered scan of the (column, target) counts. A column
    without a coded or without a real row has no distance.
    """
    codes = dict({"x3": C.SENTINEL, "x4": C.SENTINEL} if codes is None else codes)
    marks = F.array(*[F.struct(F.lit(c).alias("variable"), (F.col(c) == F.lit(s)).alias("coded")) for c, s in codes.items()])
    rows = df.where(F.col(target).isNotNull()).select(F.col(target).alias("_y"), F.explode(marks).alias("m")).select("m.variable", "_y", "m.coded").where(F.col("coded").isNotNull())
    counts = rows.groupBy("variable", "_y").agg(F.count_if("coded").alias("ca"), F.count_if(~F.col("coded")).alias("cb"))
    ranked = running_totals(counts, ["_y"], ["ca", "cb"], within=["variable"])
    share = {c: F.try_divide(F.col(_cum_name(c)), F.col(_tot_name(c))) for c in ("ca", "cb")}
    d = ranked.groupBy("variable").agg(F.max(F.abs(share["ca"] - share["cb"])).alias("d"), F.max(_tot_name("ca")).alias("a"), F.max(_tot_name("cb")).alias("b"))
    size = F.try_divide(F.col("a") * F.col("b"), F.col("a") + F.col("b"))
    tests = d.select(F.col("variable").alias("_variable"), F.round("d", 6).alias("ks_stat"), F.when(F.col("d").isNotNull(), F.round(kolmogorov_sf(F.sqrt(size) * F.col("d")), 6)).alias("p_value"))
    impact = sentinel_impact(df, target, codes)
    return impact.join(tests, F.col("variable") == F.col("_variable"), "left").drop("_variable")


def null_impact(df: DataFrame, target: str = C.TARGET, cols: Sequence[str] = C.NULL_FLAG_COLS, sentinel: float = C.SENTINEL) -> DataFrame:
    """Per column n NULL, mean target when NULL vs real (non-code) value, % difference."""
    masks = {c: (F.col(c).isNull(), F.col(c).isNotNull() & (F.col(c) != F.lit(sentinel))) for c in cols}
    return _impact(df, target, masks, "n_null", "null")


def segment_table(df: DataFrame, a: str = "x3", b: str = "x4", sentinel: float = C.SENTINEL, target: str = C.TARGET) -> DataFrame:
    """Four segments by two code flags: n, % of rows, median target (exact)."""
    flagged = df.select(
        X.sentinel_flag(a, sentinel).alias(f"{a}_flag"), X.sentinel_flag(b, sentinel).alias(f"{b}_flag"), F.col(target)
    )
    keys = [f"{a}_flag", f"{b}_flag"]
    med = exact_quantiles(flagged, target, [0.5], within=keys, names=["median_target"])
    total = flagged.agg(F.count(F.lit(1)).alias("_n_all"))
    return med.crossJoin(F.broadcast(total)).select(
        *keys, "n", X.pct(F.col("n"), F.col("_n_all"), 1).alias("pct"), F.round("median_target", 6).alias("median_target")
    )


def positivity(df: DataFrame, cols: Sequence[str] = ("x3", "x4"), sentinel: float = C.SENTINEL) -> DataFrame:
    """Real values (not code, not NULL): min, max, % > 0, % = 0."""
    aggs = []
    for c in cols:
        v = F.when(F.col(c) != F.lit(sentinel), F.col(c))
        aggs += [
            F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max"),
            F.count(v).alias(f"{c}__n"), F.count_if(v > 0).alias(f"{c}__pos"), F.count_if(v == 0).alias(f"{c}__zero"),
        ]
    wide = df.agg(*aggs)
    parts = [
        F.struct(
            F.lit(c).alias("variable"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"),
            X.pct(F.col(f"{c}__pos"), F.col(f"{c}__n"), 1).alias("pct_positive"),
            X.pct(F.col(f"{c}__zero"), F.col(f"{c}__n"), 1).alias("pct_zero"),
        )
        for c in cols
    ]
    return wide.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def real_nulls(df: DataFrame, cols: Sequence[str] = ("x3", "x4"), sentinel: float = C.SENTINEL) -> DataFrame:
    """NULL cells among rows without the code, per column."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "variable", "n_real_null")


def new_levels(df: DataFrame, level: Column, current: Column, reference: Column) -> DataFrame:
    """One row: n_new (current rows whose level no reference row has), n (current rows), new_share_pct.

    One aggregate over the rows, then one over the levels: what moves is a row per
    level and task, at any number of levels and for a level that holds a third of
    all rows. NULL is a level. Rows that are neither current nor reference don't count.
    """
    rows = df.select(level.alias("_level"), F.coalesce(current, F.lit(False)).alias("_cur"), F.coalesce(reference, F.lit(False)).alias("_ref"))
    levels = rows.groupBy("_level").agg(F.count_if("_cur").alias("k"), F.max("_ref").alias("known"))
    new = F.coalesce(F.sum(F.when(~F.col("known"), F.col("k"))), F.lit(0)).alias("n_new")
    out = levels.agg(new, F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    return out.select("n_new", "n", F.try_divide(F.lit(100.0) * F.col("n_new"), F.col("n")).alias("new_share_pct"))


def post_conditions(raw: DataFrame, prepped: DataFrame, codes: Mapping[str, float] | None = None) -> DataFrame:
    """after transform no NULL and no code is left, and every flag count equals the raw code count.

    ``raw`` and ``prepped`` are the same rows before and after the transform.
    One aggregate on each side; one row out.
    """
    codes = dict(C.SENTINEL_COLS if codes is None else codes)
    num = numeric_columns(prepped)
    p = prepped.agg(
        sum(F.count_if(F.col(c).isNull()) for c in num).alias("null_cells"),
        sum(F.count_if(F.col(c).isin([float(s) for s in set(codes.values())])) for c in num).alias("sentinel_cells"),
        *[F.sum(f"{c}{C.SENTINEL_FLAG_SUFFIX}").alias(f"{c}__flags") for c in codes if f"{c}{C.SENTINEL_FLAG_SUFFIX}" in prepped.columns],
    )
    r = raw.agg(*[F.count_if(F.col(c) == F.lit(float(s))).alias(f"{c}__codes") for c, s in codes.items() if c in raw.columns])
    flag_ok = [F.col(f"{c}__flags") == F.col(f"{c}__codes") for c in codes if f"{c}{C.SENTINEL_FLAG_SUFFIX}" in prepped.columns]
    ok = flag_ok[0]
    for f in flag_ok[1:]:
        ok = ok & f
    return p.crossJoin(r).select(
        "null_cells", "sentinel_cells", ok.alias("flags_match_codes"),
        ((F.col("null_cells") == 0) & (F.col("sentinel_cells") == 0) & ok).alias("passed"),
    )
