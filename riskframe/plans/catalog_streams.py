"""Registered queries of the stateful streams (O3 on two streams, O7/W5 on a stream) and of bucketed tables (S3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as SC
from ..operators import stability as ST
from ..operators.prefix import unpivot
from ..session import scratch_path
from ..sources.applicants import APPLICANTS_SQL, line_item_summary
from ..sources.tables import read_table, write_bucketed
from ..streaming import stateful as SS
from ..streaming.jobs import wall_clock_utc
from . import sqlparts as S
from .catalog import register
from .catalog_prep import _prep_ctes, fitted
from .catalog_scoring import FIXED_COEFS, FIXED_INTERCEPT, _fixed_sql

LAG_DAYS, DELAY_DAYS = 120, 7

# the applicants of the orders that the watermark has closed, with the lines that shipped in time
_CLOSED = APPLICANTS_SQL.replace("applicants AS (", "closed AS (").replace(
    "FROM lineitem GROUP BY l_orderkey",
    f"""FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL {LAG_DAYS} DAY
      AND o_orderdate + INTERVAL {LAG_DAYS + DELAY_DAYS} DAY < least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem))
    GROUP BY l_orderkey""",
)
_CLOSED_CLEAN = S.clean_cte().replace("clean AS", "closed_clean AS").replace("FROM applicants", "FROM closed")
_PREP_CLOSED = S.with_(_CLOSED, _CLOSED_CLEAN, *(c.replace("FROM applicants a JOIN clean c", "FROM closed a JOIN closed_clean c") for c in _prep_ctes()))


@register("stream_score_two_streams", _PREP_CLOSED + f"SELECT id, round({_fixed_sql()}, 2) AS prediction FROM feat")
def q_stream_score_two_streams(spark, sf):
    """O3: orders and line items both arrive; an order is scored when the watermark closes it, with the lines of its first 120 days."""
    _, prep = fitted(spark, sf)
    return SS.score_two_streams(spark, sf, prep, SC.linear_log_predictor(FIXED_COEFS, FIXED_INTERCEPT), lag_days=LAG_DAYS, delay_days=DELAY_DAYS)


_LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]
_MONTH = "strftime(l_shipdate, '%Y-%m')"
_lm_ctes, _lm_tab = S.psi_ctes(
    S.unpivot_sql("lineitem", _LINE_FEATURES, where="l_shipdate < TIMESTAMP '1996-01-01 00:00:00'"),
    S.union_all([f"SELECT '{c}' AS feature, {_MONTH} AS period, CAST({c} AS DOUBLE) AS value FROM lineitem" for c in _LINE_FEATURES]),
    by=["period"],
    prefix="lm",
)


@register(
    "stream_retrain_trigger",
    "WITH " + ",\n".join(_lm_ctes) + f"""
    SELECT * FROM (
      SELECT feature, period, psi, lag(psi) OVER (PARTITION BY feature ORDER BY period) AS prev_psi,
        (sum(CAST(psi > 0.25e0 AS INTEGER)) OVER w = 2 AND count(*) OVER w = 2) AS retrain
      FROM {_lm_tab} WINDOW w AS (PARTITION BY feature ORDER BY period ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
    WHERE strptime(period || '-01', '%Y-%m-%d') < (SELECT max(strptime(period || '-01', '%Y-%m-%d')) - INTERVAL 31 DAY FROM {_lm_tab})""",
)
def q_stream_retrain_trigger(spark, sf):
    """O7/W5 on a stream: monthly PSI of three line-item features, flagged after two months above the alert in a row."""
    li = read_table(spark, sf, "lineitem").withColumn("period", wall_clock_utc(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz")))
    ref = unpivot(li.where(F.col("l_shipdate") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")), _LINE_FEATURES)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in _LINE_FEATURES])
    cur = li.select("period", F.explode(cells).alias("c")).select("c.feature", "period", "c.value")
    monthly, path = ST.psi_long(ref, cur, by=["period"]).select("feature", "period", "psi"), scratch_path(spark, "psi_monthly")
    monthly.write.parquet(path)
    out = SS.stream_trigger(spark, spark.readStream.schema(monthly.schema).parquet(path))
    month = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros("period") / 86_400_000_000).cast("int"))
    return out.select("feature", F.date_format(month, "yyyy-MM").alias("period"), "psi", "prev_psi", "retrain")


@register(
    "bucketed_join",
    """SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n_orders, CAST(sum(n_lines) AS BIGINT) AS n_lines, CAST(sum(c) AS BIGINT) AS revenue_cents
       FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(CAST(round(l_extendedprice * 100.0e0) AS BIGINT) * CAST(round((1.0e0 - l_discount) * 100.0e0) AS BIGINT)) AS c
                         FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey GROUP BY 1""",
)
def q_bucketed_join(spark, sf):
    """S3: orders and their line-item summary written in the same buckets of the order key, joined without an exchange of either."""
    orders = write_bucketed(read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "orders", "o_orderkey")
    lines = write_bucketed(line_item_summary(spark, sf).select("l_orderkey", "n_lines", "tgt_c"), "line_items", "l_orderkey")
    period = F.date_format("o_orderdate", "yyyy-MM").alias("period")
    sums = [F.count(F.lit(1)).alias("n_orders"), F.sum("n_lines").alias("n_lines"), F.sum("tgt_c").alias("revenue_cents")]
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy(period).agg(*sums)
