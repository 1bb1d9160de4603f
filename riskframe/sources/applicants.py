"""The applicants table: the reference's modelling layout derived from the driver tables.

One row per order that has line items: ``orders ⋈ customer ⋈ nation ⋈
(lineitem grouped by order)``. Amounts are summed as integer cents, so the
doubles are identical in any engine. Every rule is deterministic arithmetic;
the modulus rules place informative nulls and sentinel codes and assign the
TRAIN/TEST split, they never remove rows.

Plan shape: lineitem is aggregated with a map-side partial aggregate, the
shuffle on ``l_orderkey`` is shared with the join to ``orders`` (sort-merge on
the same key), customer joins on its key (AQE picks broadcast or sort-merge from
the runtime size) and nation is a 25-row dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from .tables import read_table


def _cents(c):
    return F.round(c * F.lit(100.0)).cast("bigint")


def line_item_aggregates() -> list[Column]:
    """The columns of an order's line-item summary."""
    ext_c = _cents(F.col("l_extendedprice"))
    return [
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(ext_c * _cents(F.lit(1.0) - F.col("l_discount"))).alias("tgt_c"),
        F.sum("l_quantity").alias("qty"),
        F.sum(F.when(F.col("l_returnflag") == "R", ext_c)).alias("r_c"),
        F.sum(F.when(F.col("l_returnflag") == "A", ext_c)).alias("a_c"),
        F.sum(ext_c * _cents(F.col("l_tax"))).alias("tax_c"),
        F.max("l_extendedprice").alias("max_ext"),
        F.min("l_quantity").alias("min_q"),
        F.max("l_quantity").alias("max_q"),
    ]


def line_item_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order aggregate of the line items (partial aggregation before the shuffle on the order key)."""
    return read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*line_item_aggregates())


def applicants(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None, per_order: DataFrame | None = None) -> DataFrame:
    """Batch applicants; pass a streaming ``orders`` frame to get them as a stream
    (stream-static joins against the aggregated line items and the customers).
    ``per_order`` lets a caller pass an already written line-item summary."""
    orders = (orders if orders is not None else read_table(spark, sf_dir, "orders")).select("o_orderkey", "o_custkey", "o_totalprice")
    per_order = per_order if per_order is not None else line_item_summary(spark, sf_dir)
    return with_customers(spark, sf_dir, orders.join(per_order, orders.o_orderkey == per_order.l_orderkey))


def with_customers(spark: SparkSession, sf_dir: str, summed: DataFrame) -> DataFrame:
    """The applicants layout of orders that carry their line-item summary (batch or stream)."""
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (
        summed.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    k = F.col("o_orderkey")
    ck = F.col("o_custkey")
    dbl = lambda c: c.cast("double")
    return j.select(
        k.alias(C.ID),
        F.when(k % 3 == 2, F.lit(C.TEST)).otherwise(F.lit(C.TRAIN)).alias(C.SPLIT),
        (dbl(F.col("tgt_c")) / F.lit(10000.0)).alias(C.TARGET),
        F.when(k % 13 != 0, F.col("qty") * F.lit(1000.0)).alias("x1"),
        F.when((k % 17 != 0) & (k % 26 != 0), dbl(_cents(F.col("o_totalprice"))) / F.lit(5000.0)).alias("x2"),
        F.coalesce(dbl(F.col("r_c")) / F.lit(100.0), F.lit(C.SENTINEL)).alias("x3"),
        F.coalesce(dbl(F.col("a_c")) / F.lit(100.0), F.lit(C.SENTINEL)).alias("x4"),
        F.when(k % 3 != 0, dbl(F.col("tax_c")) / F.lit(10000.0)).alias("x5"),
        dbl(ck % 4 + 1).alias("x6"),
        F.when(
            k % 29 != 0,
            dbl(F.least(F.lit(995.0), F.greatest(F.lit(0.0), F.floor((F.col("c_acctbal") + F.lit(1000.0)) / F.lit(11.0))))),
        ).alias("x7"),
        dbl(F.least(F.col("n_lines"), F.lit(6))).alias("x8"),
        F.when(ck % 50 != 0, F.col("n_name")).alias("x9"),
        F.col("max_ext").alias("x10"),
        F.when(k % 12 == 0, F.lit(C.X11_SENTINEL)).otherwise(F.col("min_q")).alias("x11"),
        F.when(k % 12 == 0, F.lit(C.X12_SENTINEL)).otherwise(F.col("max_q")).alias("x12"),
    )


# The same table in SQL, as the leading CTE of every oracle query.
APPLICANTS_SQL = """
applicants AS (
  SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 3 = 2 THEN 'TEST' ELSE 'TRAIN' END AS base,
    CAST(tgt_c AS DOUBLE) / 10000.0e0 AS target,
    CASE WHEN o_orderkey % 13 <> 0 THEN qty * 1000.0e0 END AS x1,
    CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 26 <> 0
         THEN CAST(CAST(round(o_totalprice * 100.0e0) AS BIGINT) AS DOUBLE) / 5000.0e0 END AS x2,
    coalesce(CAST(r_c AS DOUBLE) / 100.0e0, -9999998.0e0) AS x3,
    coalesce(CAST(a_c AS DOUBLE) / 100.0e0, -9999998.0e0) AS x4,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(tax_c AS DOUBLE) / 10000.0e0 END AS x5,
    CAST(o_custkey % 4 + 1 AS DOUBLE) AS x6,
    CASE WHEN o_orderkey % 29 <> 0
         THEN CAST(least(995.0e0, greatest(0.0e0, floor((c_acctbal + 1000.0e0) / 11.0e0))) AS DOUBLE) END AS x7,
    CAST(least(n_lines, 6) AS DOUBLE) AS x8,
    CASE WHEN o_custkey % 50 <> 0 THEN n_name END AS x9,
    max_ext AS x10,
    CASE WHEN o_orderkey % 12 = 0 THEN -99000720.0e0 ELSE min_q END AS x11,
    CASE WHEN o_orderkey % 12 = 0 THEN -99000792.0e0 ELSE max_q END AS x12
  FROM orders
  JOIN (
    SELECT l_orderkey,
      count(*) AS n_lines,
      sum(CAST(round(l_extendedprice * 100.0e0) AS BIGINT) * CAST(round((1.0e0 - l_discount) * 100.0e0) AS BIGINT)) AS tgt_c,
      sum(l_quantity) AS qty,
      sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * 100.0e0) AS BIGINT) END) AS r_c,
      sum(CASE WHEN l_returnflag = 'A' THEN CAST(round(l_extendedprice * 100.0e0) AS BIGINT) END) AS a_c,
      sum(CAST(round(l_extendedprice * 100.0e0) AS BIGINT) * CAST(round(l_tax * 100.0e0) AS BIGINT)) AS tax_c,
      max(l_extendedprice) AS max_ext, min(l_quantity) AS min_q, max(l_quantity) AS max_q
    FROM lineitem GROUP BY l_orderkey
  ) li ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
)"""
