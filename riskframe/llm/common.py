"""Helpers shared by the operators: reading tables, numbers of partitions, bounded Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, remove_folder, scratch_path, ship_package, shuffle_partitions  # noqa: F401  (re-exported for the operators)

ID, TEXT = "doc_id", "text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder, read by Spark (any store it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """Only the id and the text (NULL text: empty). Other columns, whatever their names, are not read."""
    ship_package(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias(ID), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(TEXT))


def slices(batches: Iterator[pa.RecordBatch], max_rows: int = 256, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``max_rows`` rows and, unless one row is larger, ``max_bytes`` bytes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(max_rows, int(n * max_bytes / max(batch.nbytes, 1))))
        for i in range(0, n, step):
            yield batch.slice(i, step)


def crc_part(id_col: str, mod: int):
    """crc32(id as text) mod ``mod``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def row_id(id_col: str = ID, text_col: str = TEXT):
    """Name of a row by its id and a hash of its text (NULL text: empty)."""
    return F.concat_ws(":", F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))


def drop_rows(docs: DataFrame, verdicts: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``docs`` without the rows that ``verdicts`` (column rid, see ``row_id``) names; all columns stay as they are.

    Each row meets the verdict of its own text: of two texts under one doc_id one
    may go and the other stay. A row without an id goes by the verdict of its text.
    """
    key = "_drop"
    while key in docs.columns:  # a name that the documents do not have
        key += "_"
    gone = verdicts.select(F.col("rid").alias(key)).distinct()
    return docs.join(gone, row_id(id_col, text_col) == F.col(key), "left_anti")
