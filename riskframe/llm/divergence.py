"""Source divergence audit: how far the word use of two sources of one language lies apart.

Term counts are summed inside the tasks that read the texts, then per (lang, source,
term). The kept terms of a language are dealt into blocks of about ``BLOCK`` terms and
numbered inside their block, so a source is a few sorted (term id, count) arrays of
bounded length, whatever the vocabulary. A pair task co-groups the two sources' arrays
of one block, intersects them by galloping and prices overlaps and one-sided terms;
the terms that both lack have one price and are only counted. All arithmetic is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT, materialize, ship_package, slices

#: a term is kept in a language when at least so many of its documents have it
MIN_DOCS = 10
#: ranks of the part ``term``
TOP_TERMS = 10
#: terms of a block: bounds the arrays that meet in a pair task
BLOCK = 1 << 14
#: distinct (source, term) entries that a task holds before it passes them on
HELD_TERMS = 200_000
#: keys of the shorter array that are looked up at once while galloping
STRIDE = 512
#: fixed values: bytes of terms, A-Z lower-cased, all others become a space
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text bytes) -> (lang, source, term, n, docs) as counted in this task, in bounded memory."""
    seen: dict[tuple, tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (n, docs) in seen.items():
            terms = list(n)
            for i in range(0, len(terms), 1 << 14):
                part = terms[i : i + (1 << 14)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

    for batch in slices(batches):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
            terms = text.translate(TERM_BYTES).split()
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in seen.values()) > HELD_TERMS:
            yield from rows()
            seen.clear()
    yield from rows()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)) in longs, three decimal digits at a time (no product over 1000 * (total + 2 * terms))."""
    whole = total + F.lit(2) * terms
    rest, q = count + F.lit(2), F.lit(0).cast("long")
    for _ in range(3):
        up = rest * F.lit(1000)
        q, rest = q * F.lit(1000) + _div(up, whole), up % whole
    return q + F.lit(1)


def _div(a: Column, b: Column) -> Column:
    """Whole-number quotient of two longs."""
    return F.call_function("div", a, b)


def price(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))"""
    return _div((p - q) * (p - q), p + q)


def np_share(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``share`` of many counts."""
    whole = total + 2 * terms
    rest, q = count + 2, np.zeros_like(count)
    for _ in range(3):
        up = rest * 1000
        q, rest = q * 1000 + up // whole, up % whole
    return q + 1


def np_price(p, q) -> int:
    """Sum of ``price`` over two arrays, or an array and a number."""
    return int(((p - q) ** 2 // (p + q)).sum())


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common values of two ascending arrays of distinct numbers.

    A stride of the shorter array is looked up in a stretch of the longer one, which
    starts where the last look-up ended and doubles until it reaches the stride's end.
    """
    at_short, at_long, low = [], [], 0
    for s in range(0, len(short), STRIDE):
        part, width = short[s : s + STRIDE], STRIDE
        while low + width < len(long) and long[low + width - 1] < part[-1]:
            width *= 2
        stretch = long[low : low + width]
        at = np.searchsorted(stretch, part)
        hit = at < len(stretch)
        hit[hit] = stretch[at[hit]] == part[hit]
        at_short.append(s + np.flatnonzero(hit))
        at_long.append(low + at[hit])
        low += int(at[-1])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *at_short]).astype(np.int64), np.concatenate([none, *at_long]).astype(np.int64)


def _array(side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    if not side.num_rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    flat = side.column(side.num_columns - 1).combine_chunks().flatten()
    return tuple(flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))


def price_pair(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """One block of one pair of sources: the summed price of all terms that either has, and their number."""
    (ids_a, n_a), (ids_b, n_b) = _array(left), _array(right)
    known = left if left.num_rows else right
    sizes = {name[2:]: known[name][0].as_py() for name in known.column_names if name[2:] in ("n_a", "n_b", "kept")}
    p = [np_share(n, sizes[c], sizes["kept"]) for n, c in ((n_a, "n_a"), (n_b, "n_b"))]
    none = [np_share(np.zeros(1, dtype=np.int64), sizes[c], sizes["kept"])[0] for c in ("n_a", "n_b")]
    i, j = gallop(ids_a, ids_b) if len(ids_a) <= len(ids_b) else gallop(ids_b, ids_a)[::-1]
    value = np_price(p[0][i], p[1][j]) + np_price(np.delete(p[0], i), none[1]) + np_price(np.delete(p[1], j), none[0])
    return pa.table({"lang": [key[0].as_py()], "a": [key[1].as_py()], "b": [key[2].as_py()], "value": [value], "priced": [len(ids_a) + len(ids_b) - len(i)]})


def audit_sources(docs: DataFrame, text_col: str = TEXT, lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group of ``docs``.

    Part ``pair``: every other source of the language with the divergence of the two,
    summed over the language's kept terms. Part ``term``: the ``top_terms`` terms that
    the source uses more than its language does, by their share of that divergence.

    Edge cases: NULL text, lang and source are ''. Repeated rows are documents of their
    own. A group without terms has no part ``term`` and stands in part ``pair`` with
    count 0 for each term; a language without kept terms gives value 0. Equal values
    are ranked by the item's UTF-8 bytes. A text is read whole, at one row's memory.
    Other columns are ignored. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    counted = docs.select(*named[:2], named[2].cast("binary").alias("text")).mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    counts = materialize(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term_counts")

    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= min_docs).drop("docs")
    kept = materialize(kept, "kept_terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_lang").alias("in_lang"))
    blocks = F.ceil(F.col("kept") / F.lit(block)).cast("long")
    numbered = kept.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), blocks))
    numbered = numbered.repartition("lang", "block")  # else the window takes the join's deal, a task for each language
    numbered = numbered.withColumn("id", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")))
    uses = materialize(counts.select("lang", "source", "term", "n").join(numbered, ["lang", "term"]), "kept_counts")

    groups = docs.select(*named[:2]).distinct().join(langs, "lang", "left").join(uses.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    groups = materialize(groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("kept", "n")]), "source_groups")

    # part term
    sized = uses.withColumnRenamed("n", "count").join(groups.select("lang", "source", "n"), ["lang", "source"])
    p, q = share(F.col("count"), F.col("n"), F.col("kept")), share(F.col("n_lang"), F.col("in_lang"), F.col("kept"))
    terms = sized.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", price(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)

    # part pair: each unordered pair once, block by block
    a, b = (groups.select("lang", F.col("source").alias(s), F.col("n").alias(f"n_{s}"), F.col("kept")) for s in "ab")
    pairs = materialize(a.join(b.drop("kept"), "lang").where("a < b"), "source_pairs")
    arrays = materialize(uses.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("terms")), "source_arrays")
    key = ["lang", "a", "b", "block"]
    met = [arrays.withColumnRenamed("source", s).join(pairs, ["lang", s]) for s in "ab"]
    sides = [m.select(*[F.col(c).alias(f"{s}_{c}") for c in key], *[F.col(c).alias(f"{s}_{c}") for c in ("n_a", "n_b", "kept", "terms")]).groupBy(*[f"{s}_{c}" for c in key]) for s, m in zip("ab", met)]
    priced = sides[0].cogroup(sides[1]).applyInArrow(price_pair, "lang string, a string, b string, value long, priced long")
    priced = priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("priced").alias("priced"))
    zero = F.lit(0).cast("long")
    absent = price(*(share(zero, F.col(n), F.nullif(F.col("kept"), zero)) for n in ("n_a", "n_b")))
    value = F.coalesce("value", zero) + (F.col("kept") - F.coalesce("priced", zero)) * F.coalesce(absent, zero)
    ways = pairs.join(priced, ["lang", "a", "b"], "left").select("lang", value.alias("value"), F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way"))
    both = ways.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value").withColumn("rank", F.row_number().over(by_value))
    return both.unionByName(terms)
