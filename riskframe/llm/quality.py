"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text is the log-weighted counts of its hashed character trigrams, white space
runs as one space and case kept (junk shows in signs, case and repetition as much
as in words), plus hashed adjacent-word repeats. A truncated SVD of a bounded sample of labelled texts
gives the latent space. The sample's vectors are broadcast; each document's
cosine with all of them is one block product, and the nearest ones vote with
their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, crc_part, drop_rows, row_id, slices, texts

DIM = 4096
#: labelled rows that are fitted and broadcast (documented bound): 6,000 x 64 floats = 1.5 MB
MAX_LABELLED = 6000
RANK = 64
NEIGHBOURS = 25
TIE = 1e-6  # cosines closer than this are equal (the order of float32 sums may differ between batches)
THRESHOLD = 0.7


def features(text: str | None, dim: int = DIM) -> np.ndarray:
    """Unit-length row of log counts of hashed byte trigrams (zero for a text without words)."""
    parts = (text or "").encode("utf-8", "replace").split()
    out = np.zeros(dim, dtype=np.float32)
    if not parts:
        return out
    raw = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
    half = dim // 2
    counts = np.zeros(dim, dtype=np.float64)
    for i in range(0, len(raw) - 2, 1 << 20):  # bounded memory for very long texts
        r = raw[i : i + (1 << 20) + 2].astype(np.uint32)
        code = (r[:-2] << 16) | (r[1:-1] << 8) | r[2:]
        code = (code * np.uint32(2654435761)) >> np.uint32(16)
        counts[: dim - 8] += np.bincount(code % np.uint32(dim - 8), minlength=dim - 8)
    n = len(parts)
    same = sum(a == b for a, b in zip(parts, parts[1:]))
    counts[dim - 8] = half * same / n  # repeated words stand out at any length
    row = np.log1p(counts * (half / max(len(raw), half)))
    norm = np.sqrt(row @ row)
    return (row / norm).astype(np.float32) if norm else out


def _unit(z: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    return np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)


@dataclass
class LatentNeighbours:
    """Broadcast model: projection, labelled vectors (unit length), their labels, the share of label 1."""

    weight: np.ndarray
    mean: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    k: int

    def project(self, rows: np.ndarray) -> np.ndarray:
        return _unit((rows * self.weight - self.mean) @ self.basis)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the k nearest labelled vectors, in [0, 1]; all that tie with the k-th vote."""
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        cos = self.project(rows) @ self.vectors.T
        k = min(self.k, cos.shape[1])
        last = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k]
        row, near = np.nonzero(cos >= (last - TIE)[:, None])
        w = np.clip(cos[row, near], 0, None).astype(np.float64) ** 4
        total = np.bincount(row, weights=w, minlength=len(rows))
        vote = np.bincount(row, weights=w * self.labels[near], minlength=len(rows))
        empty = ~rows.any(axis=1)
        score = np.divide(vote, total, out=np.full(len(rows), self.prior), where=(total > 1e-9) & ~empty)
        return np.clip(score, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rank: int = RANK, k: int = NEIGHBOURS, id_col: str = ID, text_col: str = TEXT) -> LatentNeighbours:
    """Fit on at most ``max_labelled`` labelled rows whose crc32(doc_id) mod 4 is not 2, taken in hash order of the id.

    Only ids and labels are sampled (a top-k over two columns); their texts become
    ``DIM`` floats inside the tasks, and at most ``max_labelled`` rows reach the driver.
    """
    ok = labels.where(F.col("quality").isin(0, 1) & F.col(ID).isNotNull() & (crc_part(ID, 4) != 2))
    one = ok.groupBy(F.col(ID).cast("long").alias("lid")).agg(F.max("quality").cast("int").alias("y"))
    one = one.orderBy(F.xxhash64("lid"), "lid").limit(max_labelled)
    chosen = texts(docs, id_col, text_col).join(F.broadcast(one), F.col(ID) == F.col("lid")).select("lid", "y", TEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [features(t) for t in part.column(2).to_pylist()]
            at = [np.flatnonzero(r).astype(np.uint16) for r in rows]
            packed = [i.tobytes() + r[i].astype(np.float16).tobytes() for i, r in zip(at, rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, type=pa.binary())], ["lid", "y", "row"])

    # a row for each label id: of several texts under one id the one with the smallest features
    got = chosen.mapInArrow(run, "lid long, y int, row binary").groupBy("lid").agg(F.first("y").alias("y"), F.min("row").alias("row")).collect()
    got = sorted((bytes(r["row"]), r["y"]) for r in got)  # the order of arrival must not matter
    y = np.array([v for _, v in got], dtype=np.float64)
    prior = float(y.mean()) if len(y) else 0.5
    a = np.zeros((len(got), DIM), dtype=np.float32)  # the one large array; all that follows works in place
    for line, (r, _) in zip(a, got):
        n = len(r) // 4
        line[np.frombuffer(r, dtype=np.uint16, count=n)] = np.frombuffer(r, dtype=np.float16, offset=2 * n)
    del got
    df = np.array([np.count_nonzero(c) for c in a.T])
    if not df.any():
        return LatentNeighbours(np.ones(DIM, np.float32), np.zeros(DIM, np.float32), np.zeros((DIM, 1), np.float32), np.zeros((0, 1), np.float32), y[:0], prior, k)
    weight = (np.log((1 + len(a)) / (1 + df)) + 1).astype(np.float32)
    a *= weight
    mean = a.mean(axis=0)
    a -= mean
    rng = np.random.default_rng(7)
    r = min(rank, *a.shape)
    q = np.linalg.qr(a @ rng.standard_normal((a.shape[1], min(r + 10, *a.shape))).astype(np.float32))[0]
    for _ in range(3):  # subspace iteration of the truncated SVD
        q = np.linalg.qr(a @ np.linalg.qr(a.T @ q)[0])[0]
    basis = np.ascontiguousarray(np.linalg.svd(q.T @ a, full_matrices=False)[2][:r].T)
    return LatentNeighbours(weight, mean, basis, _unit(a @ basis), y, prior, k)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED, id_col: str = ID, text_col: str = TEXT, with_rid: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Edge cases: NULL, empty and word-less texts score the share of label 1 among
    the fitted rows; without usable labels every score is 0.5. Labels other than 0
    and 1 are ignored; a doc_id labelled twice counts as its larger label. Repeated
    rows score alike; all neighbours as near as the k-th (within ``TIE``) vote; a NULL doc_id is scored and is never held out. Other columns
    are ignored; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled, id_col=id_col, text_col=text_col))

    more = ["rid"] if with_rid else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            score = model.value.score(np.stack([features(t) for t in part.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score.astype(np.float64)), *(part.column(2) for _ in more)], ["doc_id", "score", *more])

    rows = texts(docs, id_col, text_col)
    scored = (rows.withColumn("rid", row_id()) if with_rid else rows).mapInArrow(run, "doc_id long, score double" + (", rid string" if with_rid else ""))
    return scored.select(ID, (F.col(ID).isNotNull() & (crc_part(ID, 4) == 2)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``docs`` (all columns) without the documents that the classifier rejects."""
    bad = score_quality(docs, labels, id_col=id_col, text_col=text_col, with_rid=True).where("predicted = 0")
    return drop_rows(docs, bad, id_col, text_col)
