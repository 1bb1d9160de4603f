"""Registered source/sink round trips (S1-S7) and sampling/split/plot-data queries
(F11, F12, J7, W6, A22). Files go to fresh folders under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import dist
from ..operators import prep as P
from ..operators import profile as PR
from ..operators.prefix import exact_quantiles
from ..session import scratch_path
from ..sources import tables as IO
from ..sources.applicants import applicants
from . import sqlparts as S
from .catalog import base, register
from .catalog_metrics import SCORERS
from .catalog_prep import PREP, FLAGS, IMPUTED, INTER, LOGS, X7_COLS, X8_LEVELS, _dum, _r, _rounded

RAW = ["id", "base", "target", *[f"x{i}" for i in range(1, 13)]]


@register("csv_roundtrip", S.with_() + f"SELECT {', '.join(RAW)} FROM applicants")
def q_csv_roundtrip(spark, sf):
    """S1 + S4: applicants written as a latin-1 CSV with the raw upper-case header, read back with the explicit schema."""
    path = scratch_path(spark, "raw_csv")
    a = applicants(spark, sf)
    a.select(*[F.col(c).alias(c.upper()) for c in RAW]).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return IO.load_raw_csv(spark, path)


@register("parquet_roundtrip", S.with_() + f"SELECT {', '.join(RAW)} FROM applicants WHERE base = 'TEST'")
def q_parquet_roundtrip(spark, sf):
    """S2 + S3: applicants written partitioned by split; reading TEST prunes the TRAIN folder."""
    path = scratch_path(spark, "processed")
    IO.write_parquet(applicants(spark, sf), path, partition_by=[C.SPLIT])
    return spark.read.parquet(path).where(F.col(C.SPLIT) == C.TEST).select(*RAW)


@register(
    "model_persistence",
    PREP
    + "SELECT id, base, round(target, 6) AS target, "
    + ", ".join(
        [_r(c) for c in IMPUTED] + FLAGS + [_r(c) for c in LOGS] + [_r(c) for c in INTER]
        + [_dum("x7_label", c, c) for c in X7_COLS] + [_dum("x8_level", lv, f"x8_cat_{lv}") for lv in X8_LEVELS] + [_r("x9_target_enc")]
    )
    + " FROM feat",
)
def q_model_persistence(spark, sf):
    """The fitted preprocessor saved, loaded back and applied; equals the in-memory transform."""
    a = base(spark, sf)  # (read by every pass of the fit)
    m = P.RiskPreprocessor().fit(a.where(F.col(C.SPLIT) == C.TRAIN))
    path = scratch_path(spark, "prep_model")
    m.save(path)
    return _rounded(P.RiskPreprocessorModel.load(path).transform(a))


_REQ = ["id", *[f"x{i}" for i in range(1, 13)]]


@register("request_ingest", S.with_() + f"SELECT {', '.join(_REQ)} FROM applicants")
def q_request_ingest(spark, sf):
    """Records as JSON lines (NULL fields are left out of each record) read back with every field optional."""
    path = scratch_path(spark, "requests")
    applicants(spark, sf).select(*_REQ).write.json(path)
    schema = T.StructType([T.StructField("id", T.LongType())] + list(IO.REQUEST_SCHEMA.fields))
    return IO.read_requests(spark, path, schema).select(*_REQ)


@register("shape", S.with_() + "SELECT count(*) AS n_rows, 15 AS n_cols FROM applicants")
def q_shape(spark, sf):
    return IO.shape(applicants(spark, sf))


@register("head", S.with_() + f"SELECT {', '.join(RAW)} FROM applicants ORDER BY id LIMIT 5")
def q_head(spark, sf):
    return IO.head(applicants(spark, sf), 5, C.ID)


@register("dtypes")
def q_dtypes(spark, sf):
    return IO.dtypes(applicants(spark, sf))


@register("holdout_split")
def q_holdout_split(spark, sf):
    """80/20 hash hold-out inside TRAIN: row counts per part."""
    a = applicants(spark, sf).where(F.col(C.SPLIT) == C.TRAIN)
    return a.groupBy(P.holdout_flag().alias("is_validation")).agg(F.count(F.lit(1)).alias("n"))


@register("fold_sizes")
def q_fold_sizes(spark, sf):
    """hash folds (k = 3) over TRAIN: row counts per fold."""
    a = applicants(spark, sf).where(F.col(C.SPLIT) == C.TRAIN)
    return a.groupBy(P.fold_column(k=3).alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@register("seeded_sample")
def q_seeded_sample(spark, sf):
    """Exactly n rows in a seeded hash order (deterministic, partition-independent)."""
    a = applicants(spark, sf)
    return a.orderBy(F.xxhash64(F.col(C.ID), F.lit(42)), F.col(C.ID)).limit(2000).select(C.ID, C.TARGET)


_QQ_M = 99
_QQ_P = [(i - 0.5) / _QQ_M for i in range(1, _QQ_M + 1)]
_QQ_T = [dist.norm_ppf(p) for p in _QQ_P]


_QQ_SQL = (
    S.with_(
        f"q AS (SELECT quantile_cont(ln(target), [{', '.join(S.lit(p) for p in _QQ_P)}]) AS qs FROM applicants)",
        f"t AS (SELECT unnest(range(1, {_QQ_M + 1})) AS i, unnest([{', '.join(S.lit(t) for t in _QQ_T)}]) AS t)",
    )
    + "SELECT i, round(t, 6) AS theoretical, round(qs[i], 6) AS sample FROM q, t"
)


@register("qq_grid", _QQ_SQL)
def q_qq_grid(spark, sf):
    """Sample quantiles of log(target) against normal quantiles on a 99-point grid."""
    a = applicants(spark, sf).select(F.log(C.TARGET).alias("ly"))
    names = [f"q{i}" for i in range(1, _QQ_M + 1)]
    q = exact_quantiles(a, "ly", _QQ_P, names=names)
    parts = [F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(float(t)).alias("theoretical"), F.col(n).alias("sample")) for i, (t, n) in enumerate(zip(_QQ_T, names), 1)]
    long = q.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
    return long.select("i", F.round("theoretical", 6).alias("theoretical"), F.round("sample", 6).alias("sample"))


@register(
    "residual_histogram",
    S.with_(
        f"e AS (SELECT target - ({SCORERS['lin_a'][1]}) AS err FROM applicants)",
        "rng AS (SELECT min(err) AS lo, max(err) AS hi, count(*) AS n FROM e WHERE err IS NOT NULL)",
        "bins AS (SELECT least(49, CAST(floor((err - lo) * 50 / (hi - lo)) AS INTEGER)) AS bin FROM e, rng WHERE err >= lo AND err <= hi)",
        "cnt AS (SELECT bin, count(*) AS n FROM bins GROUP BY bin)",
        "grid AS (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS bin, lo, hi, n AS total FROM rng)",
    )
    + """SELECT g.bin, round(lo + g.bin * ((hi - lo) / 50), 6) AS lower, round(lo + (g.bin + 1) * ((hi - lo) / 50), 6) AS upper,
       coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (total * ((hi - lo) / 50)), 12) AS density FROM grid g LEFT JOIN cnt c ON g.bin = c.bin""",
)
def q_residual_histogram(spark, sf):
    """Histogram of y - y_hat for the closed-form scorer (50 bins)."""
    a = applicants(spark, sf).select(C.TARGET, SCORERS["lin_a"][0]().alias("pred"))
    _, hist = PR.residual_summary(a, C.TARGET, "pred", 50)
    return hist
