"""Column expressions (P3-P25): pure JVM-side expressions, no UDF.

SQL null rules differ from pandas in three places handled here:
``NULL = s`` is NULL (pandas: False), ``greatest/least`` skip NULL (pandas
``clip`` keeps NaN) and ANSI division by zero raises (use ``nullif``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """Spark keeps NaN and NULL apart; pandas has only NaN. Normalise at ingest."""
    c = col_(c)
    return F.when(~F.isnan(c), c)


def null_if_sentinel(c: str | Column, sentinels: Sequence[float]) -> Column:
    """Sentinel codes become NULL."""
    c = col_(c)
    out = c
    for s in sentinels:
        out = F.when(out != F.lit(float(s)), out) if s is not None else out
    return out


def sentinel_flag(c: str | Column, sentinel: float) -> Column:
    """1 where the raw value equals the code, 0 otherwise (also for NULL)."""
    return F.coalesce((col_(c) == F.lit(float(sentinel))).cast("int"), F.lit(0))


def null_flag(c: str | Column) -> Column:
    """P5: 1 where NULL."""
    return col_(c).isNull().cast("int")


def clip(c: str | Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Cap to [lower, upper]; NULL stays NULL."""
    c = col_(c)
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    return F.when(c.isNotNull(), out)


def log1p_pos(c: str | Column) -> Column:
    """log1p(max(c, 0)), NULL stays NULL."""
    return F.log1p(clip(c, lower=0.0))


def safe_share(a: str | Column, b: str | Column, default: float = 0.5) -> Column:
    """A / (a + b), zero total -> default."""
    a, b = col_(a), col_(b)
    return F.coalesce(a / F.nullif(a + b, F.lit(0.0)), F.lit(float(default)))


def capped_ratio(num: str | Column, den: str | Column, den_fill: float, cap: float) -> Column:
    """Num / max(den or fill when zero, 1), capped above at ``cap``."""
    den_c = F.coalesce(F.nullif(col_(den), F.lit(0.0)), F.lit(float(den_fill)))
    return clip(col_(num) / F.greatest(den_c, F.lit(1.0)), upper=cap)


def bucket_label(x: str | Column, edges: Sequence[float], labels: Sequence[str], default: str) -> Column:
    """Left-closed bins [e_i, e_{i+1}); outside or NULL -> ``default``."""
    x = col_(x)
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x >= F.lit(float(lo))) & (x < F.lit(float(hi)))
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out.otherwise(F.lit(default))


def ordinal_level(x: str | Column, levels: Sequence[int], other: str = C.OTHER_LEVEL) -> Column:
    """Round half-even, keep listed integer levels, else ``other``."""
    r = F.rint(col_(x)).cast("bigint")
    return F.when(r.isin([int(v) for v in levels]), r.cast("string")).otherwise(F.lit(other))


def dummy(c: str | Column, level: str) -> Column:
    return (col_(c) == F.lit(level)).cast("int")


def score_band(score: str | Column) -> Column:
    """<5000 high risk, <11000 moderate, else low."""
    s = col_(score)
    return (
        F.when(s < F.lit(C.BAND_HIGH_MAX), F.lit(C.BAND_LABELS[0]))
        .when(s < F.lit(C.BAND_MODERATE_MAX), F.lit(C.BAND_LABELS[1]))
        .when(s.isNotNull(), F.lit(C.BAND_LABELS[2]))
    )


def normalise_text(c: str | Column, upper: bool = False) -> Column:
    """Trim, empty -> NULL, optional upper-case."""
    t = F.trim(col_(c))
    if upper:
        t = F.upper(t)
    return F.nullif(t, F.lit(""))


def psi_status(psi: str | Column) -> Column:
    p = col_(psi)
    return (
        F.when(p < F.lit(C.PSI_WARN), F.lit(C.PSI_OK_LABEL))
        .when(p < F.lit(C.PSI_ALERT), F.lit(C.PSI_WARN_LABEL))
        .otherwise(F.lit(C.PSI_ALERT_LABEL))
    )


def pct(num: Column, den: Column, digits: int = 2) -> Column:
    return F.round(F.lit(100.0) * num / den, digits)


def sig_round(c: str | Column, digits: int = 10) -> Column:
    """Round to ``digits`` significant digits (for large sums whose last bits depend on order)."""
    c = col_(c)
    e = F.floor(F.log10(F.abs(c)))
    scale = F.pow(F.lit(10.0), e)
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c / scale, digits - 1) * scale)
