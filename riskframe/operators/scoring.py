"""Batch and single scoring, request normalisation and model metadata.

A scorer is the fitted preprocessing model plus a prediction column
expression; scoring is one projection over the request table, so a batch of
any size is scored by the executors with no per-request limit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X


def normalise_requests(df: DataFrame, text_cols: Sequence[str] = ("x9",), null_codes: Mapping[str, float] | None = None) -> DataFrame:
    """P24 (trim, empty -> NULL, upper-case text) and optionally P22 (request-level codes -> NULL).

    P22 is off by default: nulling X3/X4 codes before the preprocessor would
    hide them from the code flags (the train/serve skew of the reference).
    """
    out = []
    for c in df.columns:
        if c in text_cols:
            out.append(X.normalise_text(c, upper=True).alias(c))
        elif null_codes and c in null_codes:
            out.append(X.null_if_sentinel(c, [null_codes[c]]).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def linear_log_predictor(coefs: Mapping[str, float], intercept: float) -> Column:
    """exp(b0 + sum b_j x_j): a log-linear scorer over preprocessed features (P25)."""
    lin = F.lit(float(intercept))
    for f, b in coefs.items():
        lin = lin + F.lit(float(b)) * F.col(f).cast("double")
    return F.exp(lin)


def score(df: DataFrame, prep_model, predictor: Column, keep: Sequence[str] = (C.ID,), digits: int = 2, float32: bool = False) -> DataFrame:
    """O1: preprocess -> predict -> round; ``float32`` narrows features first (P20)."""
    feats = prep_model.transform(df)
    if float32:
        feats = feats.select(*[F.col(c).cast("float").alias(c) if t == "double" and c not in keep else F.col(c) for c, t in feats.dtypes])
    return feats.select(*keep, F.round(predictor, digits).alias("prediction"))


def score_with_request_id(scored: DataFrame) -> DataFrame:
    """O2: each scored record gets a random request id (UUID)."""
    return scored.withColumn("request_id", F.expr("uuid()"))


def band_counts(scored: DataFrame, col: str = "prediction") -> DataFrame:
    """Risk band of every score, and rows per band."""
    return scored.groupBy(X.score_band(col).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def model_metadata(spark, name: str, features: Sequence[str], version: str) -> DataFrame:
    """One-row readiness table of the fitted scorer."""
    return spark.createDataFrame(
        [(name, len(features), list(features), version, True)],
        "model_name string, n_features int, features array<string>, version string, ready boolean",
    )
