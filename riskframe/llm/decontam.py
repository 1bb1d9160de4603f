"""Benchmark decontamination with DataFrame functions only.

The distinct test windows (13 words, or a whole shorter item) form a hash set;
a document's windows are hashed and looked up where two words of theirs begin one, hits
are verified word by word, and the covered words are counted. The set is broadcast only while its
counted size is under a bound; beyond it the same join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, drop_rows, materialize, row_id, texts

WINDOW = 13
#: fixed values: the bytes between words, once the text is lower-cased (A-Z only)
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: windows (of items) that may be broadcast: about 60 bytes each, 60 MB at most
BROADCAST_WINDOWS = 1_000_000


def norm_words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased: runs of 0-9, a-z and all non-ASCII characters."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def benchmark_windows(bench: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = TEXT) -> DataFrame:
    """(k, h, gram, item_id): each distinct window of each item; k is its number of words."""
    items = bench.select(F.col(f"`{id_col}`").alias("item_id"), norm_words(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("w")).where(F.size("w") > 0)
    k = F.least(F.lit(window), F.size("w"))
    runs = items.select("item_id", k.alias("k"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - k + F.lit(1)), lambda i: F.slice(F.col("w"), i, k))).alias("gram"))
    return runs.select("k", F.xxhash64("gram").alias("h"), "gram", "item_id").distinct()


def find_hits(docs: DataFrame, grams: DataFrame, lengths: list[int], broadcast: bool) -> DataFrame:
    """(rid, pos, k, h): verified occurrences of the distinct windows ``grams`` (k, h, gram) in ``docs`` (rid, w).

    One scan serves all lengths. With a broadcast set, a position is looked at only when its
    word and the next one begin some window; its window is built and hashed there alone.
    Beyond the bound every position's windows are hashed and joined by a shuffle, without
    the documents' words, which the hits meet again by ``rid``.
    """
    # (outer: else Spark splits each text once more to drop the empty ones first)
    scan = docs.select("rid", "w", F.posexplode_outer("w").alias("pos", "word"))
    run = F.slice(F.col("w"), F.col("pos") + 1, F.col("k"))
    fits = F.size("w") >= F.col("pos") + F.col("k")
    if not broadcast:
        at = scan.select("rid", "w", "pos", F.explode(F.array(*[F.lit(k) for k in lengths])).alias("k")).where(fits)
        found = at.select("rid", "pos", "k", F.xxhash64(run).alias("h")).join(grams.select("k", "h", "gram"), ["k", "h"])
        found = found.join(docs, "rid")
    else:
        starts = grams.select("k", F.get("gram", F.lit(0)).alias("word"), F.get("gram", F.lit(1)).alias("next")).distinct()
        parts = []
        if max(lengths) > 1:
            parts.append(scan.withColumn("next", F.get("w", F.col("pos") + 1)).join(F.broadcast(starts.where("k > 1")), ["word", "next"]))
        if 1 in lengths:
            parts.append(scan.join(F.broadcast(starts.where("k = 1").drop("next")), "word"))
        found = None
        for at in parts:
            one = at.where(fits).select("rid", "w", "pos", "k", F.xxhash64(run).alias("h")).join(F.broadcast(grams.select("k", "h", "gram")), ["k", "h"])
            found = one if found is None else found.unionByName(one)
    return found.where(run == F.col("gram")).select("rid", "pos", "k", "h")


def covered(spans: Column) -> Column:
    """Number of positions inside the union of sorted (pos, k) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(acc: Column, s: Column) -> Column:
        stop = (s["pos"] + s["k"]).cast("long")
        fresh = F.greatest(stop - F.greatest(acc["end"], s["pos"].cast("long")), F.lit(0).cast("long"))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["end"], stop).alias("end"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, one_in: int = 20, id_col: str = ID, text_col: str = TEXT, item_col: str = "item_id", item_text: str = TEXT, broadcast_windows: int = BROADCAST_WINDOWS, with_rid: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A word is hit when it lies in an occurrence of a window. ``spans`` has the
    (pos, k) word runs that were found, for removing passages instead of
    documents. A document is contaminated when n_hit > 0 and one_in * n_hit >= n_words.

    Edge cases: a NULL or word-less text has no words, no hits and is not
    contaminated; an item without words has no window; items with equal windows
    all count; repeated rows each get the same verdict; a NULL doc_id
    stays a row of its own text.
    Other columns are ignored. An empty table on either side gives no hits.
    """
    all_grams = materialize(benchmark_windows(bench, window, item_col, item_text), "bench_windows")
    size = all_grams.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `window` rows
    # counted with their items, so the table of items is bounded too
    lengths, broadcast = sorted(r["k"] for r in size), sum(r["n"] for r in size) <= broadcast_windows
    # a row is known by its id and a hash of its text: both scans below then agree, however the rows are dealt
    rid, more = row_id(), ["rid"] if with_rid else []
    rows = texts(docs, id_col, text_col).select(rid.alias("rid"), ID, norm_words(F.col(TEXT)).alias("w"))
    counts = rows.select("rid", ID, F.size("w").cast("long").alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    if not lengths:
        return counts.select(ID, "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"), F.array().cast("array<struct<pos:int,k:int>>").alias("spans"), *more)
    hits = materialize(find_hits(rows.select("rid", "w"), all_grams.select("k", "h", "gram").distinct(), lengths, broadcast), "bench_hits")
    per_doc = hits.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("pos", "k"))).alias("spans"))
    items = all_grams.select("k", "h", "item_id").distinct()
    seen = hits.select("rid", "k", "h").distinct().join(F.broadcast(items) if broadcast else items, ["k", "h"]).groupBy("rid")
    seen = seen.agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"), F.max(F.col("item_id").isNull().cast("int")).alias("unnamed"))
    out = counts.join(per_doc.join(seen, "rid"), "rid", "left")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("long"))
    n_items = F.coalesce(F.size("items") + F.col("unnamed"), F.lit(0)).cast("long")
    out = out.select(ID, "n_words", *more, n_hit.alias("n_hit"), n_items.alias("n_items"), F.coalesce(F.sha2(F.array_join("items", ","), 256), none).alias("items_sha256"), F.coalesce("spans", F.array().cast("array<struct<pos:int,k:int>>")).alias("spans"))
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") * F.lit(one_in) >= F.col("n_words"))
    return out.select(ID, "n_words", "n_hit", "n_items", "items_sha256", bad.alias("contaminated"), "spans", *more)


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``docs`` (all columns) without the contaminated documents."""
    bad = decontaminate(docs, bench, id_col=id_col, text_col=text_col, with_rid=True).where("contaminated")
    return drop_rows(docs, bad, id_col, text_col)
