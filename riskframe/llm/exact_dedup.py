"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups, keep the smallest id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, drop_rows, materialize, row_id, texts
from .text import SPACE_CLASS


def md5_128(c: Column) -> Column:
    return F.unhex(F.md5(c.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, content_hash: Callable[[Column], Column] = md5_128, with_rid: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of white space became
    one space. The grouping key is (hash, text): the hash decides where a row
    goes, the text itself is compared byte by byte, so two texts with one hash
    stay apart. Copies meet already in the task that reads them (map-side
    combine), hence a group with a third of all rows sends one row per task.

    Edge cases: NULL text is the empty text; all empty texts are one group. A
    NULL doc_id is kept only where its group has no other id. Rows that repeat a
    doc_id with the same text are the same document and share one verdict.
    Other columns are ignored. An empty table gives an empty result.
    """
    norm = F.regexp_replace(F.col(TEXT), SPACE_CLASS, " ")
    more = ["rid"] if with_rid else []
    base = texts(docs, id_col, text_col).withColumn("rid", row_id()).select(ID, "rid", norm.alias("t")).select(ID, "rid", "t", content_hash(F.col("t")).alias("h"))
    groups = base.groupBy("h", "t").agg(F.min(ID).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups.select("h", F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size"), "exact_groups")
    # several texts under one hash: those rows also need the text's digest to find their group
    collides = bool(groups.groupBy("h").count().where("count > 1").take(1))
    if collides:
        rows = base.select(ID, *more, "h", F.sha2("t", 256).alias("text_sha256")).join(groups, ["h", "text_sha256"])
    else:
        rows = base.select(ID, *more, "h").join(groups, "h")
    return rows.select(ID, "keep_id", "group_size", F.col(ID).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *more)


def keep_first_copies(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``docs`` (all columns) without the rows that ``exact_dedup`` drops."""
    gone = exact_dedup(docs, id_col, text_col, with_rid=True).where(~F.col("kept"))
    return drop_rows(docs, gone, id_col, text_col)
