"""Ordered running totals and exact order statistics at any size.

A ``Window.orderBy(...)`` without ``partitionBy`` moves every row to one task.
Here the ordered scan is split across tasks instead:

1. the caller pre-aggregates to one row per (group, order key), so a hot key
   (a value holding a third of all rows) is one row, not a third of the data;
2. ``repartitionByRange`` on (group, key) cuts the key space into balanced
   ranges (sampled bounds, as a distributed sort does) and every range is sorted
   inside its task;
3. a per-partition Arrow scan adds in-partition running sums and the partition
   id; the result is written as Parquet to the shared checkpoint folder so
   partition ids stay fixed even if an executor is lost and a stage is
   recomputed;
4. per-(partition, group) totals (a table with partitions x groups rows) give
   every partition its offset; offsets are joined back null-safely, so a NULL
   group is a group like any other (AQE broadcasts the table when its runtime
   size is below the broadcast threshold).

There is one path for every size; no group is ever collected into one task.

``exact_quantiles`` needs single ranks only, not an order of everything: a quantile
sketch cuts the values into cells, the cells are counted, and only those that hold a
wanted rank are ranked value by value. Quantiles with linear interpolation (pandas,
NumPy and DuckDB ``quantile_cont``) come out exact without a sort of the column and
without holding a group's values in one task, unlike Spark's ``percentile`` aggregate
whose buffer keeps every distinct value of the group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, materialize, shuffle_partitions

PID = "_pid"


def _cum_name(s: str) -> str:
    return f"_cum_{s}"


def _tot_name(s: str) -> str:
    return f"_tot_{s}"


def join_on(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the ``by`` columns with NULL equal to NULL; one copy of each key column. No keys: a one-row side."""
    by = list(by)
    if not by:
        return left.crossJoin(right)
    named = right.select(*[F.col(c).alias(f"_on_{c}") for c in by], *[c for c in right.columns if c not in by])
    cond = [left[c].eqNullSafe(named[f"_on_{c}"]) for c in by]
    return left.join(named, cond, how).drop(*[f"_on_{c}" for c in by])


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Row by row: equal, both NULL, or both NaN."""
    equal = pc.fill_null(pc.equal(a, b), False)
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    if pa.types.is_floating(a.type):
        both = pc.or_(both, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return pc.or_(equal, both).to_numpy(zero_copy_only=False)


def _partition_scan(within: Sequence[str], sums: Sequence[str]):
    """In-partition running sums of ``sums`` per ``within`` group, rows already sorted."""

    def scan(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        carry: list = []  # running sums at the end of the previous batch
        last = None  # its last row's group
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            change = np.zeros(n, dtype=bool)
            for c in within:
                change[1:] |= ~_same(col[c].slice(1), col[c].slice(0, n - 1))
            continues = last is not None and all(_same(last[c], col[c].slice(0, 1))[0] for c in within)
            last = {c: col[c].slice(n - 1, 1) for c in within}
            change[0] = True
            start = np.maximum.accumulate(np.where(change, np.arange(n), 0))
            out, carried = [], []
            for j, s in enumerate(sums):
                whole = pa.types.is_integer(col[s].type)
                v = col[s].cast(pa.int64() if whole else pa.float64()).to_numpy(zero_copy_only=False)
                cs = np.cumsum(v)
                total = cs - (cs[start] - v[start])
                if continues:
                    total[start == 0] += carry[j]
                carried.append(total[-1])
                out.append(pa.array(total))
            carry = carried
            arrays = [*batch.columns, pa.array(np.full(n, pid, dtype=np.int32)), *out]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, PID, *[_cum_name(s) for s in sums]])

    return scan


def running_totals(
    df: DataFrame,
    order_by: Sequence[str],
    sums: Sequence[str],
    within: Sequence[str] = (),
    descending: bool = False,
    num_partitions: int | None = None,
) -> DataFrame:
    """Inclusive running sums of ``sums`` in ``order_by`` order inside each ``within`` group.

    ``df`` must hold one row per (within, order_by); pre-aggregate ties first so
    tied keys move together. Adds ``_cum_<s>`` (running sum) and ``_tot_<s>``
    (group total) for every ``s`` in ``sums``. Sum columns must be non-null.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    within, order_by, sums = list(within), list(order_by), list(sums)
    n_parts = num_partitions or shuffle_partitions(spark)
    order_cols = [F.col(c).desc() if descending else F.col(c).asc() for c in order_by]
    keys = [F.col(c).asc() for c in within] + order_cols

    ranged = df.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
    fields = list(df.schema.fields) + [T.StructField(PID, T.IntegerType(), False)]
    for s in sums:
        dt = df.schema[s].dataType
        out_t = T.LongType() if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) else T.DoubleType()
        fields.append(T.StructField(_cum_name(s), out_t, False))
    # written once: partition ids and in-partition sums stay fixed for both passes below
    scanned = materialize(ranged.mapInArrow(_partition_scan(within, sums), T.StructType(fields)), "running_totals")

    part_tot = scanned.groupBy(PID, *within).agg(*[F.sum(s).alias(f"_pt_{s}") for s in sums])
    w_prev = Window.partitionBy(*within).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*within)
    offsets = part_tot.select(
        PID,
        *within,
        *[F.coalesce(F.sum(f"_pt_{s}").over(w_prev), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_pt_{s}").over(w_all).alias(_tot_name(s)) for s in sums],
    )
    joined = join_on(scanned, offsets, [PID, *within])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(_cum_name(s)) + F.col(f"_off_{s}")).alias(_cum_name(s)) for s in sums],
        *[F.col(_tot_name(s)) for s in sums],
    )


#: values that one task may rank (they are sorted and streamed, with spilling), and cells per narrowing
RANKED, FAN = 1 << 22, 1024


def _cell(x: str, edges: str, fan: int, df: DataFrame) -> DataFrame:
    """``df`` with ``_sub``: the number of sorted ``edges`` below ``x``, by binary search (a projection per halving, all generated code)."""
    df, step = df.withColumn("_sub", F.lit(0)), 1 << (fan - 1).bit_length()
    while step := step >> 1:
        probe = F.get(F.col(edges), F.col("_sub") + F.lit(step - 1))
        df = df.withColumn("_sub", F.when(probe < F.col(x), F.col("_sub") + F.lit(step)).otherwise(F.col("_sub")))
    return df


def _edges(grid: Sequence[float], fan: int) -> Column:
    """Sketched quantiles of ``_v`` at the ``grid``, each within a quarter of 1/``fan`` of its rank."""
    return F.percentile_approx("_v", list(grid), 4 * fan).alias("_edges")


def _around(probs: Sequence[float], fan: int) -> list[float]:
    """Ends of a stretch of 1/``fan`` around each wanted rank (twice the sketch's error on either side)."""
    return sorted({min(1.0, max(0.0, float(p) + d / (2 * fan))) for p in probs for d in (-1, 1)})


def _narrowed(rows: DataFrame, ranks: DataFrame, key: list[str], fan: int, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One narrowing of ``rows`` (key, _v, _w) and of the ``ranks`` (key, _k, _below) looked for in each cell.

    A mergeable quantile sketch (partial aggregate) cuts each cell into at most ``fan``
    parts (or at the ``edges`` given for each key, fewer than ``fan``), the parts are counted,
    and only the parts that hold a rank go on. Exactness does not rest on the sketch: it
    decides how even the parts are, the counts which part holds a rank.
    """
    if edges is None:
        edges = rows.groupBy(*key).agg(_edges([i / fan for i in range(1, fan)], fan))
    cut = _cell("_v", "_edges", fan, join_on(rows, edges, key)).drop("_edges")
    counts = cut.groupBy(*key, "_sub").agg(F.sum("_w").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*key, "_sub", "_n", before.alias("_before"))
    found = join_on(ranks, counts, key).withColumn("_low", F.col("_below") + F.col("_before")).where((F.col("_low") <= F.col("_k")) & (F.col("_k") < F.col("_low") + F.col("_n")))
    found = found.select(*key[:-1], (F.col("_c") * F.lit(fan) + F.col("_sub")).alias("_c"), "_k", F.col("_low").alias("_below"))
    cut = cut.select(*key[:-1], (F.col("_c") * F.lit(fan) + F.col("_sub")).alias("_c"), "_v", "_w")
    return join_on(cut, found.select(*key).distinct(), key), found


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    within: Sequence[str] = (),
    names: Sequence[str] | None = None,
    weight: str | None = None,
    ranked: int = RANKED,
    fan: int = FAN,
) -> DataFrame:
    """Exact linear-interpolated quantiles of the non-null ``value`` per group.

    Position h = (n - 1) * p; result = v[floor h] + (h - floor h) * (v[ceil h] - v[floor h]).
    Returns one row per group with one column per probability (``names`` or
    ``q0, q1, ...``) and ``n`` (non-null count). ``weight`` (an integer count
    column) lets a caller pass rows that are already (value, count) pairs.

    Equal values are counted first, so a hot value is one row. Tables of more than
    ``ranked`` rows are narrowed to the cells that hold the wanted ranks, by a factor of
    about ``fan`` each time, until no task has more than ``ranked`` values to rank: no
    narrowing up to 4 million rows, one up to 4 billion, two up to 4 trillion. Nothing is
    written, and the full column is never sorted or shuffled.
    """
    within = list(within)
    names = list(names) if names is not None else [f"q{i}" for i in range(len(probs))]
    present = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    rows = present.select(*within, F.lit(0).cast("long").alias("_c"), F.col(value).alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    key, left = [*within, "_c"], df.count()
    if left <= ranked:
        ordered = Window.partitionBy(*key).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        counts = rows.groupBy(*key, "_v").agg(F.sum("_w").alias("_w"))
        spread = counts.select(*within, "_v", "_w", F.sum("_w").over(ordered).alias("_cum"), F.sum("_w").over(Window.partitionBy(*key)).alias("_n"))
    else:
        # the first cut is made beside the wanted ranks only: a stretch of 1/fan around each, found by a few edges per value
        grid = _around(probs, fan)
        totals = rows.groupBy(*key).agg(F.sum("_w").alias("_n"))
        ends = [f((F.col("_n") - F.lit(1)).cast("double") * F.lit(float(p))) for p in probs for f in (F.floor, F.ceil)]
        ranks = totals.select(*key, F.explode(F.array_distinct(F.array(*[e.cast("long") for e in ends]))).alias("_k"), F.lit(0).cast("long").alias("_below"))
        # (a sketch of weighted rows knows nothing of their weights: they are cut evenly)
        parts, edges = (fan, None) if weight else (len(grid) + 1, rows.groupBy(*key).agg(_edges(grid, fan)))
        while left > ranked:
            rows, ranks = _narrowed(rows, ranks, key, parts, edges)
            left, parts, edges = -(-left // fan), fan, None
        ordered = Window.partitionBy(*key).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        counts = rows.groupBy(*key, "_v").agg(F.sum("_w").alias("_w"))
        placed = join_on(counts.select(*key, "_v", "_w", F.sum("_w").over(ordered).alias("_in")), ranks.select(*key, "_below").distinct(), key)
        spread = join_on(placed.select(*within, "_v", "_w", (F.col("_below") + F.col("_in")).alias("_cum")), totals.drop("_c"), within)

    n, cum = F.col("_n"), F.col("_cum")
    first_rank = cum - F.col("_w")  # 0-based rank of the first copy of this value
    aggs = []
    for i, p in enumerate(probs):
        h = (n - F.lit(1)).cast("double") * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        aggs += [
            F.max(F.when((first_rank <= lo) & (lo < cum), F.col("_v"))).alias(f"_lo{i}"),
            F.max(F.when((first_rank <= hi) & (hi < cum), F.col("_v"))).alias(f"_hi{i}"),
            F.max(h - lo).alias(f"_d{i}"),
        ]
    picked = spread.groupBy(*within).agg(F.max(n).alias("n"), *aggs)
    return picked.select(
        *within,
        "n",
        *[
            (F.col(f"_lo{i}") + F.col(f"_d{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(nm)
            for i, nm in enumerate(names)
        ],
    )


def unpivot(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (), var: str = "feature", val: str = "value") -> DataFrame:
    """Wide numeric columns to (ids..., feature, value) rows, one job for all features."""
    cols = list(columns)
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(ids), cols, var, val)


def qcut_bucket(x: Column, edges: Column) -> Column:
    """pandas ``qcut(..., duplicates='drop')`` bucket, 1-based.

    Bins are right-closed ``(e_j, e_{j+1}]`` with the first one also holding
    the lowest value: bucket = 1 + number of interior edges strictly below x.
    """
    interior = F.slice(edges, 2, F.greatest(F.size(edges) - F.lit(2), F.lit(0)))
    return F.greatest(F.lit(1), F.size(F.filter(interior, lambda e: e < x)) + F.lit(1)).cast("bigint")
