"""Scans of the driver tables and the reference's own file formats."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, shuffle_partitions

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; filters and projections push into the reader."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# raw modelling file: ID, BASE, TARGET, X1..X12 (X9 text), latin-1 CSV with header
RAW_SCHEMA = T.StructType(
    [T.StructField("ID", T.LongType()), T.StructField("BASE", T.StringType()), T.StructField("TARGET", T.DoubleType())]
    + [T.StructField(f"X{i}", T.StringType() if i == 9 else T.DoubleType()) for i in range(1, 13)]
    + [T.StructField("_corrupt_record", T.StringType())]
)


def load_raw_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """CSV scan with an explicit schema (no inference pass), latin-1.

    The header must name the schema's columns in their order (an exchanged or
    missing column is an error). Rows that do not fit the schema are left out here
    and returned by ``rejected_csv``. Column names are lower-cased so the result
    has the applicants layout. NaN read from text is normalised to NULL (Spark
    keeps both, pandas only one).
    """
    df = _scan_csv(spark, path, encoding, schema).where(F.col("_corrupt_record").isNull())
    cols = []
    for f in schema.fields:
        if f.name == "_corrupt_record":
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(f.name.lower()))
    return df.select(*cols)


def rejected_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """The rows that ``load_raw_csv`` leaves out: their text, with the columns that could be read."""
    return _scan_csv(spark, path, encoding, schema).where(F.col("_corrupt_record").isNotNull())


def _scan_csv(spark: SparkSession, path: str, encoding: str, schema: T.StructType) -> DataFrame:
    if "_corrupt_record" not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("encoding", encoding)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("nanValue", "NaN")
        .csv(path)
    )


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """S3: processed splits. Partitioning by split lets readers prune a whole split."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """S3: ``df`` as a table in hash buckets of ``key``, one sorted file per bucket, and the table read back.

    Two tables written with the same number of buckets join on their keys, or
    group by them, without an exchange. The default is the session's shuffle
    partitions, which a cluster sizes for its data. The files lie in the shared
    folder; the table's name is new in each call and known to this session's catalog.
    """
    spark = df.sparkSession
    n = buckets or shuffle_partitions(spark)
    path = scratch_path(spark, f"bucketed_{name}")
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def write_report(df: DataFrame, path: str) -> None:
    """Small report tables (one row per model / decile / feature) as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


REQUEST_SCHEMA = T.StructType(
    [T.StructField(f"x{i}", T.StringType() if i == 9 else T.DoubleType()) for i in range(1, 13) if i != 9]
    + [T.StructField("x9", T.StringType())]
)


def read_requests(spark: SparkSession, path: str, schema: T.StructType = REQUEST_SCHEMA) -> DataFrame:
    """Score requests as JSON lines; every field optional, an absent key becomes NULL.

    Field names are matched whatever their case (X1 or x1); a key given in both
    cases takes the lower-case one. A line that is not a JSON object is not a
    request: it is left out here and returned by ``rejected_requests``.
    """
    m = F.col("m")
    cols = [F.coalesce(m[f.name], m[f.name.upper()]).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    return _request_lines(spark, path).where(m.isNotNull()).select(*cols)


def rejected_requests(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``read_requests`` leaves out, as they are (column value)."""
    return _request_lines(spark, path).where(F.col("m").isNull()).select("value")


def _request_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select("value", F.from_json("value", "map<string,string>").alias("m"))


def shape(df: DataFrame) -> DataFrame:
    """One-row table of row and column counts."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def dtypes(df: DataFrame) -> DataFrame:
    """Column name and type as a table (plan-time metadata, no job)."""
    spark = df.sparkSession
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(df.dtypes)], "position int, column string, dtype string")


def head(df: DataFrame, n: int, order_by: str) -> DataFrame:
    """First n rows in a total order (TakeOrderedAndProject, no global sort)."""
    return df.orderBy(order_by).limit(n)


def save_params(spark: SparkSession, path: str, params: dict) -> None:
    """S5 helper: small fitted parameters as one JSON text row, written through
    Spark so the path may be on any shared file system."""
    text = json.dumps(params, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "/params")


def load_params(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path.rstrip("/") + "/params").take(1)
    return json.loads(rows[0][0])
