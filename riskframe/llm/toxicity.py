"""Toxicity: a classifier chain of linear models, linked by out-of-fold predictions.

The categories are predicted in a fixed order; each model sees the text's features
and the probabilities of the categories before it. In training those are
out-of-fold predictions, so a later model meets the same kind of input as it will
when scoring. The features are whole words and word beginnings that stand out
in labelled toxic texts; the last category is the label itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, crc_part, slices, texts
from .text import words

#: fixed values: seed words of the first two categories (the last one is labelled)
SEEDS = {
    "insult": ("idiot", "moron", "clown", "scum", "loser", "trash"),
    "contempt": ("pathetic", "worthless", "disgusting", "stupid"),
}
CATEGORIES = (*SEEDS, "toxic")
#: labelled rows per class that are fitted (documented bound)
MAX_PER_CLASS = 4000
#: features that the models may use (documented bound)
MAX_FEATURES = 512
BEGINNINGS = (4, 5, 6, 7, 8)
FOLDS = 4
_STRIP = ".,;:!?\"'()[]{}<>#$%&*|-_=+/\\"


def word_features(word: str) -> list[str]:
    """The word itself (marked =) and its beginnings, without signs at its ends."""
    w = word.strip(_STRIP)
    return [f"={w}", *(w[:k] for k in BEGINNINGS if len(w) > k)] if len(w) > 2 else []


@dataclass
class Chain:
    """vocabulary: feature -> column; one weight row (features, earlier categories, intercept) per category."""

    vocabulary: dict[str, int]
    weights: list[np.ndarray]

    def columns(self, word: str) -> tuple[int, ...]:
        return tuple(self.vocabulary[f] for f in word_features(word) if f in self.vocabulary)

    def matrix(self, found: list[set[int]]) -> np.ndarray:
        x = np.zeros((len(found), len(self.vocabulary)), dtype=np.float32)
        for i, cols in enumerate(found):
            if cols:
                x[i, list(cols)] = 1
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(rows, categories) probabilities, each fed to the later models."""
        p = np.zeros((len(x), 0))
        for w in self.weights:
            p = np.column_stack([p, _proba(np.column_stack([x, p]), w)])
        return p


def _proba(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.3, rounds: int = 150) -> np.ndarray:
    """Logistic regression by AdaGrad over the whole (bounded) sample."""
    w, seen = np.zeros(x.shape[1] + 1), np.full(x.shape[1] + 1, 1e-6)
    total = weight.sum()
    mean = float(np.clip((weight * y).sum() / total, 1e-4, 1 - 1e-4))
    w[-1] = np.log(mean / (1 - mean))
    for _ in range(rounds):
        err = weight * (_proba(x, w) - y)
        grad = np.append((err @ x + l2 * w[:-1]) / total, err.sum() / total)
        seen += grad * grad
        w -= 0.4 * grad / np.sqrt(seen)
    return w


def fit_chain(rows: list[tuple[int, int, list[int], list[int]]], vocabulary: dict[str, int], shares: tuple[float, float]) -> Chain:
    """``rows``: (fold, label, feature columns, seed flags); ``shares``: rows that a fitted row of label 0 and 1 stands for."""
    rows = sorted(rows)
    chain = Chain(vocabulary, [])
    x = chain.matrix([set(r[2]) for r in rows])
    fold, label = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    weight = np.where(label == 1, shares[1], shares[0]).astype(np.float64)
    weight /= weight.mean()
    seeds = np.array([r[3] for r in rows], dtype=np.int64).reshape(len(rows), len(SEEDS))
    earlier = np.zeros((len(rows), 0))
    for c in range(len(CATEGORIES)):
        y = (label if c == len(SEEDS) else label * seeds[:, c]).astype(np.float64)
        mine = np.column_stack([x, earlier])
        out_of_fold = np.zeros(len(rows))
        for f in range(FOLDS):
            test = fold == f
            if test.any() and not test.all():
                out_of_fold[test] = _proba(mine[test], _fit_linear(mine[~test], y[~test], weight[~test]))
        chain.weights.append(_fit_linear(mine, y, weight))
        earlier = np.column_stack([earlier, out_of_fold])
    return chain


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, max_features: int = MAX_FEATURES, id_col: str = ID, text_col: str = TEXT) -> Chain | None:
    """Fit on at most ``max_per_class`` labelled rows of each class whose crc32(doc_id) mod 4 is not 2 (hash order).

    Feature counts come from an aggregate over those rows; the features kept are the
    ``max_features`` with the highest pointwise evidence for the label. None without rows of both classes.
    """
    ok = labels.where(F.col("toxic").isin(0, 1) & F.col(ID).isNotNull() & (crc_part(ID, 4) != 2))
    one = ok.groupBy(F.col(ID).cast("long").alias("lid")).agg(F.max("toxic").cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return None
    taken = [one.where(F.col("y") == y).orderBy(F.xxhash64("lid"), "lid").limit(max_per_class) for y in (0, 1)]
    sample = texts(docs, id_col, text_col).join(F.broadcast(taken[0].unionByName(taken[1])), F.col(ID) == F.col("lid"))
    sample = sample.select("lid", "y", TEXT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for part in slices(batches):
            for y, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                seen[y].update({f for w in set(words(t)) for f in word_features(w)})
        names = list(seen[1])  # a feature that no toxic text has can't speak for the label
        for i in range(0, len(names), 20_000):
            part = names[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([0] * len(part), pa.int64()), pa.array([seen[1][f] for f in part], pa.int64())], ["f", "n0", "n1"])
        names = list(seen[0])
        for i in range(0, len(names), 20_000):
            part = names[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[0][f] for f in part], pa.int64()), pa.array([0] * len(part), pa.int64())], ["f", "n0", "n1"])

    counts = sample.mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n0, n1 = min(totals[0], max_per_class), min(totals[1], max_per_class)
    # log-odds of the label given the feature, times the share of toxic texts that have it
    odds = F.log((F.col("n1") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("n0") + 0.5) / F.lit(n0 + 1.0))
    best = counts.where("n1 >= 3").select("f", "n1", odds.alias("odds")).where("odds > 1.5").orderBy((F.col("odds") * F.col("n1")).desc(), "f").limit(max_features)
    vocabulary = {r["f"]: i for i, r in enumerate(best.collect())}
    if not vocabulary:
        return None
    chain = Chain(vocabulary, [])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [set(words(t)) for t in part.column(2).to_pylist()]
            cols = [sorted({c for w in ws for c in chain.columns(w)}) for ws in found]
            plain = [{w.strip(_STRIP) for w in ws} for ws in found]
            seeds = [[int(not p.isdisjoint(s)) for s in SEEDS.values()] for p in plain]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cols, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))], ["lid", "y", "cols", "seeds"])

    got = sample.mapInArrow(rows, "lid long, y int, cols array<long>, seeds array<long>")
    # a row for each label id: of several texts under one id the one with the smallest columns
    got = got.groupBy("lid").agg(F.first("y").alias("y"), F.min(F.struct("cols", "seeds")).alias("m"))
    got = got.select("lid", (F.abs(F.xxhash64("lid")) % FOLDS).alias("fold"), "y", "m.cols", "m.seeds").collect()
    data = [(r["fold"], r["y"], list(r["cols"]), list(r["seeds"])) for r in sorted(got, key=lambda r: r["lid"])]
    if not data:
        return None
    return fit_chain(data, vocabulary, (totals[0] / n0, totals[1] / n1))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, p_insult, p_contempt, score, toxic.

    Edge cases: NULL, empty and word-less texts have no features and score the
    models' intercepts (not toxic); without labels of both classes every score is
    0. Labels other than 0 and 1 are ignored, a doc_id labelled twice counts as
    its larger label. Repeated rows score alike; a NULL doc_id is scored and never
    held out. Other columns are ignored; an empty table gives an empty result.
    """
    chain = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = chain.value, {}
        for part in slices(batches):
            if model is None:
                p = np.zeros((part.num_rows, len(CATEGORIES)))
            else:
                found = []
                for t in part.column(1).to_pylist():
                    cols: set[int] = set()
                    for w in set(words(t)):
                        c = cache.get(w)
                        if c is None:
                            c = model.columns(w)
                            if len(cache) >= 200_000:
                                cache.clear()
                            cache[w] = c
                        if c:
                            cols.update(c)
                    found.append(cols)
                p = model.predict(model.matrix(found))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(p.shape[1]))], ["doc_id", "p_insult", "p_contempt", "score"])

    out = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, p_insult double, p_contempt double, score double")
    held = F.col(ID).isNotNull() & (crc_part(ID, 4) == 2)
    return out.select(ID, held.alias("held_out"), "p_insult", "p_contempt", "score", (F.col("score") >= threshold).alias("toxic"))
