"""SimHash near-dedup: pigeonhole blocks, join on blocks, verify the Hamming distance, components.

A pair that differs in at most d of 64 bits agrees on at least m - d of m blocks.
Every choice of m - d blocks is one join key, so no close pair is missed. m grows
with the number of distinct fingerprints (log2 of it bits per key), which keeps
the expected bucket small at any size; every m finds the same pairs. Exact copies
are one fingerprint before the join. A bucket over ``hot_bucket`` fingerprints
(many near copies of one text) is not paired: its members meet at their <= d/2-bit
neighbours instead, which links the same fingerprints in linear work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ID, TEXT, drop_rows, materialize, row_id, slices, texts
from .components import connected_components
from .text import word_bytes

SEED = 42
BITS = 64


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash over word shingles (repeats included); a text without words has 0."""
    found = word_bytes(text)
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    n = len(found) - shingle + 1
    if n <= 1:
        hashes = [digest(joined, SEED)]
    else:
        at = np.zeros(len(found) + 1, dtype=np.int64)
        np.cumsum([len(w) + 1 for w in found], out=at[1:])
        at = at.tolist()
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(at[:n], at[shingle:])]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 16384):
        ones += np.unpackbits(h[i : i + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) for each row of (doc_id, text), with rid if ``docs`` has it third; fp is the fingerprint as a signed long."""
    more = ["rid"] if "rid" in docs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp), *(part.column(2) for _ in more)], ["doc_id", "fp", *more])

    return docs.mapInArrow(run, "doc_id long, fp long" + (", rid string" if more else ""))


def block_masks(n_fingerprints: int, distance: int) -> list[int]:
    """Bit masks (signed) of all choices of m - distance blocks; m is the least number whose keys have log2(n) bits."""
    need = min(math.log2(max(n_fingerprints, 2)), BITS * 0.55)
    m = distance + 2
    while BITS * (m - distance) / m < need:
        m += 1
    edges = [round(BITS * i / m) for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, m - distance)]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in masks]


def _neighbours(fps: DataFrame, flips: int) -> DataFrame:
    """(near, fp): every value within ``flips`` bits of each fingerprint."""
    masks = np.array([sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(BITS), k)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_rows=64):
            fp = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            near = (fp[:, None] ^ masks[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(near.view(np.int64)), pa.array(np.repeat(fp, len(masks)).view(np.int64))], ["near", "fp"])

    return fps.mapInArrow(run, "near long, fp long")


def close_links(fps: DataFrame, distance: int = 4, hot_bucket: int = 1024) -> DataFrame:
    """(a, b) links that connect the same distinct fingerprints as all pairs within ``distance`` bits.

    ``fps`` has one distinct long per row (column fp). ``distance`` is even.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    masks = block_masks(fps.count(), distance)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.i", "k.key")
    hot = materialize(keyed.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_bucket).select("i", "key"), "hot_blocks")
    any_hot = bool(hot.take(1))
    cold = keyed.join(hot, ["i", "key"], "left_anti") if any_hot else keyed
    a, b = cold.alias("a"), cold.alias("b")
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    links = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & close)
    links = links.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if any_hot:
        crowd = keyed.join(hot, ["i", "key"], "left_semi").select("fp").distinct()
        # two fingerprints are within 2k bits exactly when they have a common value within k bits of both;
        # at most 2,081 distinct fingerprints (k = 2) can meet at one value, so these windows are bounded
        met = _neighbours(crowd, distance // 2).select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("near")).alias("b"))
        links = links.unionByName(met.where("a <> b"))
    return links.distinct()


def simhash_groups(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = ID, text_col: str = TEXT, hot_bucket: int = 1024, with_rid: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, group_size.

    component_id is the smallest doc_id reachable over links of at most
    ``distance`` differing bits, the document itself included.

    Edge cases: NULL and word-less texts have fingerprint zero and link like any
    other. Texts of fewer words than a shingle have one shingle. A NULL doc_id
    takes part but never names a component unless it holds no other id (then
    component_id is NULL). Repeated rows share a component. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)
    fps = materialize(fingerprints(rows.withColumn("rid", row_id()) if with_rid else rows, shingle), "simhash_fp")
    reps = materialize(fps.groupBy("fp").agg(F.min(ID).alias("rep"), F.count(F.lit(1)).alias("n")), "simhash_reps")
    roots = connected_components(close_links(reps.select("fp"), distance, hot_bucket))
    named = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "simhash_roots")
    heads = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("n").alias("group_size"))
    of_fp = named.select("fp", "root").join(heads, "root").select("fp", "component_id", "group_size")
    return fps.join(of_fp, "fp").select(ID, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size", *(["rid"] if with_rid else []))


def keep_one_per_group(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``docs`` (all columns) with one document of each near-duplicate group: the one with the smallest id."""
    gone = simhash_groups(docs, shingle, distance, id_col, text_col, with_rid=True).where(~F.col(ID).eqNullSafe(F.col("component_id")))
    return drop_rows(docs, gone, id_col, text_col)
