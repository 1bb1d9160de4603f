"""Vector codes: codebooks per part of the vectors, learned exactly with anchors-hierarchy metric trees.

Vectors become whole numbers and are dealt into chunks. Per chunk and part, a metric
tree is built once ("middle out": anchors first, then balls above them by merging and
below them by anchors again) and written to the shared folder; each ball caches the
number and the sum of its points. A round sends the codebooks (``entries`` numbers per
component, bounded by the parameters) to every task. A walk carries the list of
entries that can still be nearest to some point of a ball; it shrinks from ball to
ball, and a ball with one entry left is owned whole: its cached sums are added without
looking at a point. Distances and sums are exact whole numbers, ties go to the lower
entry. Rows that cannot be computed in 64 bits take the same steps in Python's integers.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: vectors of a chunk at most, and numbers of a chunk at most
CHUNK, CHUNK_NUMBERS = 4096, 1 << 20
#: points of a ball that is not divided further
LEAF = 128
#: scaled components below this stay exact in 64 bits (distances of parts up to 512 wide)
SMALL = 1 << 26
LONG = 1 << 63


# ---------------------------------------------------------------------------
# trees
# ---------------------------------------------------------------------------


def _distances(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - center) ** 2).sum(axis=1))


def anchors(points: np.ndarray, k: int) -> list[np.ndarray]:
    """At most ``k`` groups of row numbers; each group's first row is its anchor, the rest is no nearer to another anchor.

    Every new anchor is the point farthest from its own one. Only points farther from
    their anchor than half the way to the new anchor can be nearer to that, so no
    others are looked at.
    """
    rows = [0]
    dist, owner = _distances(points, points[0]), np.zeros(len(points), dtype=np.int64)
    while len(rows) < k:
        new = int(dist.argmax())
        if dist[new] <= 0:
            break
        half = _distances(points[rows], points[new]) / 2
        near = np.flatnonzero(dist > half[owner])
        d = _distances(points[near], points[new])
        won = d < dist[near]
        near, d = near[won], d[won]
        dist[near], owner[near] = d, len(rows)
        rows.append(new)
    groups = []
    for a, row in enumerate(rows):
        own = np.flatnonzero(owner == a)
        groups.append(np.concatenate([[row], own[own != row]]))
    return groups


class Tree:
    """Balls over the rows of ``points``: children (-1: none), span in ``order``, center, radius, count and sum."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.children, self.members, self.centers, self.radii, self.counts, self.sums = [], [], [], [], [], []
        self.floats = points.astype(np.float64)
        root = self._grow(np.arange(len(points)))
        self.order, self.spans = np.zeros(len(points), dtype=np.int32), np.zeros((len(self.children), 2), dtype=np.int32)
        self._place(root)

    def _ball(self, children: tuple[int, int], members: np.ndarray | None, center: np.ndarray, radius: float, count: int, total: np.ndarray) -> int:
        for held, x in zip((self.children, self.members, self.centers, self.radii, self.counts, self.sums), (children, members, center, radius, count, total)):
            held.append(x)
        return len(self.children) - 1

    def _grow(self, rows: np.ndarray) -> int:
        groups = anchors(self.floats[rows], max(2, math.isqrt(len(rows)))) if len(rows) > self.leaf else [np.arange(len(rows))]
        if len(groups) == 1:
            at = self.floats[rows[0]]
            return self._ball((-1, -1), rows, at, float(_distances(self.floats[rows], at).max()), len(rows), self.points[rows].sum(axis=0, dtype=np.int64))
        return self._merge([self._grow(rows[g]) for g in groups])

    def _merge(self, balls: list[int]) -> int:
        """One ball over ``balls``, joining the two with the smallest common ball again and again."""
        balls, open_ = list(balls), np.ones(len(balls), dtype=bool)
        centers, radii = np.array([self.centers[b] for b in balls]), np.array([self.radii[b] for b in balls])
        cost = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2)) + radii[:, None] + radii[None]
        np.fill_diagonal(cost, np.inf)
        i = 0
        for _ in range(len(balls) - 1):
            i, j = divmod(int(cost.argmin()), len(balls))
            a, b = balls[i], balls[j]
            count = self.counts[a] + self.counts[b]
            center = (self.centers[a] * self.counts[a] + self.centers[b] * self.counts[b]) / count
            radius = max(math.dist(center, self.centers[c]) + self.radii[c] for c in (a, b))
            balls[i] = self._ball((a, b), None, center, radius, count, self.sums[a] + self.sums[b])
            centers[i], radii[i], open_[j] = center, radius, False
            line = np.where(open_, _distances(centers, center) + radii + radius, np.inf)
            line[i] = np.inf
            cost[i], cost[:, i], cost[j], cost[:, j] = line, line, np.inf, np.inf
        return balls[i]

    def _place(self, root: int) -> None:
        at, todo = 0, [(root, False)]
        while todo:
            ball, done = todo.pop()
            if done:
                self.spans[ball, 1] = at
                continue
            self.spans[ball, 0] = at
            if self.members[ball] is not None:
                self.order[at : at + self.counts[ball]] = self.members[ball]
                at += self.counts[ball]
                self.spans[ball, 1] = at
            else:
                todo += [(ball, True), (self.children[ball][1], False), (self.children[ball][0], False)]

    def arrays(self) -> dict[str, np.ndarray]:
        """The tree without its points. The last ball is the root."""
        return {"order": self.order, "spans": self.spans, "children": np.array(self.children, dtype=np.int32), "centers": np.array(self.centers), "radii": np.array(self.radii), "sums": np.array(self.sums)}


def nearest(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Place of the nearest row of ``entries`` for each point (exact; the lower one of equally near ones)."""
    return np.array([((points - e) ** 2).sum(axis=1) for e in entries]).argmin(axis=0)


def walk(tree: dict[str, np.ndarray], points: np.ndarray, entries: np.ndarray, whole: Callable[[int, int], None], each: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Deal all points to their nearest entries: ``whole(ball, entry)`` for an owned ball, ``each(rows, entries)`` elsewhere."""
    floats = entries.astype(np.float64)
    apart = np.sqrt(((floats[:, None] - floats[None]) ** 2).sum(axis=2))
    _, first = np.unique(entries.astype(str) if entries.dtype == object else entries, axis=0, return_index=True)
    todo = [(len(tree["radii"]) - 1, np.sort(first))]
    while todo:
        ball, left = todo.pop()
        if len(left) > 1:
            d = ((floats[left] - tree["centers"][ball]) ** 2).sum(axis=1)
            best = int(d.argmin())
            # an entry can go when the ball lies on the nearer side of the plane between the two; the margin covers the floats' rounding
            more = d - d[best]
            left = left[more <= 2 * tree["radii"][ball] * apart[left, left[best]] + 1e-9 * (d + d[best] + 1)]
        if len(left) == 1:
            whole(ball, int(left[0]))
        elif tree["children"][ball, 0] < 0:
            rows = tree["order"][slice(*tree["spans"][ball])]
            each(rows, left[nearest(points[rows], entries[left])])
        else:
            todo += [(int(c), left) for c in tree["children"][ball]]


# ---------------------------------------------------------------------------
# chunks
# ---------------------------------------------------------------------------


def scaled(flat: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): int32 where all results are small, else Python integers."""
    x = flat.astype(np.float64)
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not len(y) or np.abs(y).max() < SMALL:
        return y.astype(np.int32)
    return np.array([int(v) * scale if abs(v) > 2.0**53 else math.floor(v * scale) for v in x.tolist()], dtype=object)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled vectors filled up with zeros to ``width`` numbers: a matrix, and which rows need Python's integers."""
    lengths = np.asarray(column.value_lengths())
    at = np.concatenate([np.arange(n) for n in lengths]) if len(set(lengths.tolist())) > 1 else np.tile(np.arange(lengths[0]), len(lengths))
    flat, row = scaled(column.flatten().to_numpy(zero_copy_only=False)), np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros((len(lengths), width), dtype=flat.dtype)
    out[row, at] = flat
    large = (np.abs(out) >= SMALL).any(axis=1) if out.dtype == object else np.zeros(len(lengths), dtype=bool)
    return out, large


def _cut(matrix: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, width of a part)"""
    return matrix.reshape(len(matrix), parts, -1)


def build_chunks(id_type: pa.DataType, label_type: pa.DataType, width: int, parts: int, leaf: int = LEAF):
    """(vec_id, label, vector) -> one row per chunk: its ids and labels, its whole numbers and its trees."""
    rows = max(1, min(CHUNK, CHUNK_NUMBERS // max(width, 1)))

    def pack(ids: list[pa.Array], labels: list[pa.Array], points: np.ndarray, trees: bool) -> pa.RecordBatch:
        held, kind = {}, "trees" if trees else "texts"
        if trees:
            held["points"] = points
            for p in range(parts):
                held |= {f"{k}{p}": v for k, v in Tree(_cut(points, parts)[:, p].astype(np.int64), leaf).arrays().items()}
        else:
            held["points"] = points.astype(str)
        np.savez(blob := io.BytesIO(), **held)
        columns = [pa.array([x.to_pylist()], pa.list_(t)) for x, t in ((pa.concat_arrays(ids), id_type), (pa.concat_arrays(labels), label_type))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([kind]), pa.array([blob.getvalue()], pa.binary())], names=["ids", "labels", "kind", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, points, n = [], [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                matrix, large = _matrix(part.column(2), width)
                for mask, trees in ((~large, True), (large, False)):
                    if not mask.any():
                        continue
                    keep = pa.array(mask)
                    own = [part.column(0).filter(keep)], [part.column(1).filter(keep)], matrix[mask]
                    if not trees:
                        yield pack(*own, False)
                        continue
                    if n + len(own[2]) > rows:
                        yield pack(ids, labels, np.concatenate(points), True)
                        ids, labels, points, n = [], [], [], 0
                    ids, labels, points, n = ids + own[0], labels + own[1], [*points, own[2].astype(np.int32)], n + len(own[2])
        if n:
            yield pack(ids, labels, np.concatenate(points), True)

    return run


class Chunk:
    """A written chunk: its points by part and, unless it holds numbers too large for 64 bits, its trees."""

    def __init__(self, kind: str, body: bytes, parts: int):
        with np.load(io.BytesIO(body)) as held:
            self.has_trees = kind == "trees"
            raw = held["points"]
            self.points = _cut(raw.astype(np.int64) if self.has_trees else np.array([[int(v) for v in r] for r in raw], dtype=object).reshape(raw.shape), parts)
            self.trees = [{k: held[f"{k}{p}"] for k in ("order", "spans", "children", "centers", "radii", "sums")} for p in range(parts)] if self.has_trees else None

    def deal(self, p: int, entries: np.ndarray, whole: Callable, each: Callable) -> None:
        """``walk`` over the tree of part ``p``; without a tree, or with large entries, point by point."""
        if self.trees and entries.dtype != object:
            walk(self.trees[p], self.points[:, p], entries, whole, each)
        else:
            rows = np.arange(len(self.points))
            each(rows, nearest(self.points[:, p].astype(object), entries))


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """``value`` as (place, long) with value = sum of long * 2^(40 * place): one number unless it is over 62 bits."""
    if abs(value) < 1 << 62:
        yield 0, value
        return
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield place, sign * (value & ((1 << 40) - 1))
        value, place = value >> 40, place + 1


def sum_parts(books: list[np.ndarray], parts: int):
    """Per task: number and sums of the points that each entry of each part is nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [[0] * len(b) for b in books]
        sums = [[np.zeros(b.shape[1], dtype=object) for _ in b] for b in books]
        for batch in batches:
            for kind, body in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                chunk = Chunk(kind, body, parts)
                for p, entries in enumerate(books):

                    def whole(ball: int, e: int, p=p, tree=chunk.trees and chunk.trees[p]) -> None:
                        counts[p][e] += int(tree["spans"][ball, 1] - tree["spans"][ball, 0])
                        sums[p][e] = sums[p][e] + tree["sums"][ball].astype(object)

                    def each(rows: np.ndarray, nearest_to: np.ndarray, p=p, chunk=chunk) -> None:
                        for e in np.unique(nearest_to):
                            own = chunk.points[rows[nearest_to == e], p]
                            counts[p][e] += len(own)
                            sums[p][e] = sums[p][e] + own.sum(axis=0).astype(object)

                    chunk.deal(p, entries, whole, each)
        out = []
        for p, entries in enumerate(books):
            for e in range(len(entries)):
                if counts[p][e]:
                    out += [(p, e, -1, 0, counts[p][e])]
                    out += [(p, e, i, place, v) for i, x in enumerate(sums[p][e]) for place, v in _limbs(int(x))]
        for i in range(0, len(out), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + (1 << 14)]), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["part", "entry", "pos", "place", "v"])

    return run


def encode(books: list[np.ndarray], parts: int):
    """Per vector: code (two hex digits per part) and summed squared distance (null beyond a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                chunk = Chunk(one.column(2)[0].as_py(), one.column(3)[0].as_py(), parts)
                n = len(chunk.points)
                codes, error = np.zeros((n, parts), dtype=np.uint8), np.zeros(n, dtype=chunk.points.dtype)
                for p, entries in enumerate(books):

                    def whole(ball: int, e: int, p=p, tree=chunk.trees and chunk.trees[p]) -> None:
                        codes[tree["order"][slice(*tree["spans"][ball])], p] = e

                    def each(rows: np.ndarray, nearest_to: np.ndarray, p=p) -> None:
                        codes[rows, p] = nearest_to

                    chunk.deal(p, entries, whole, each)
                    error = error + ((chunk.points[:, p] - entries[codes[:, p]]) ** 2).sum(axis=1)
                text = [bytes(c).hex() for c in codes]
                errors = [int(e) if e < LONG else None for e in error]
                yield pa.RecordBatch.from_arrays([one.column(0).flatten(), one.column(1).flatten(), pa.array(text, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def _books(vectors: list[list[int]], parts: int) -> list[np.ndarray]:
    """Codebooks by part; Python integers where a component is too large for 64-bit distances."""
    kind = object if any(abs(v) >= SMALL for row in vectors for v in row) else np.int64
    return list(np.array(vectors, dtype=kind).reshape(len(vectors), parts, -1).transpose(1, 0, 2))


def _moved(books: list[np.ndarray], sums: list) -> list[np.ndarray]:
    """Codebooks after a round: floor(sum / count) per component, unused entries stay."""
    total: dict[tuple, int] = {}
    for r in sums:
        key = (r["part"], r["entry"], r["pos"])
        total[key] = total.get(key, 0) + (int(r["v"]) << (40 * r["place"]))
    new = [[[total[p, e, i] // total[p, e, -1] if (p, e, -1) in total else int(v) for i, v in enumerate(entry)] for e, entry in enumerate(book)] for p, book in enumerate(books)]
    return _books([[v for book in new for v in book[e]] for e in range(len(books[0]))], len(books))


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row of ``vectors``.

    Rows whose vector is NULL or holds a NULL, NaN or infinite component are left out.
    The codebooks start with the ``entries`` smallest kept ids and are moved ``rounds``
    times over all kept vectors.

    Edge cases: fewer kept rows than ``entries`` give as many entries; of equal ids the
    smaller vector starts first, NULL ids come last. Vectors of unequal length, or of a
    length that ``parts`` does not divide, are filled up with zeros. Equal entries: the
    first one is used. Rows with equal labels, NULL labels among them, share one
    label_error. A sum of errors beyond a long is NULL. Repeated rows count each. Other
    columns are ignored. A table without a kept row gives an empty result.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits per part: 1 to 256 entries")
    vector = F.col(f"`{vector_col}`")
    if not isinstance(vectors.schema[vector_col].dataType.elementType, (T.FloatType, T.DoubleType)):
        vector = vector.cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), vector.alias("vector"))
    # NULL (some component is), or a value that is not finite: no such row passes
    for bad in ("NaN", "Infinity", "-Infinity"):
        rows = rows.where(~F.array_contains("vector", F.lit(float(bad)).cast(rows.schema["vector"].dataType.elementType)))
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    result = T.StructType([rows.schema["vec_id"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())])
    if longest is None:
        return rows.limit(0).select("vec_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in result.fields[1:]])
    width = max(1, -(-longest // parts)) * parts

    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()  # `entries` rows
    filled = [[int(v) for v in scaled(np.array(r["vector"] or [], dtype=np.float64))] for r in start]
    books = _books([v + [0] * (width - len(v)) for v in filled], parts)

    arrow = {f.name: f.type for f in pa.schema(_arrow_fields(rows.select("vec_id", "label")))}
    chunk_type = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["vec_id"].dataType)), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)), T.StructField("kind", T.StringType()), T.StructField("body", T.BinaryType())])
    chunks = materialize(rows.mapInArrow(build_chunks(arrow["vec_id"], arrow["label"], width, parts), chunk_type), "vector_chunks")
    for _ in range(rounds):
        sums = chunks.select("kind", "body").mapInArrow(sum_parts(books, parts), "part int, entry int, pos int, place int, v long")
        # at most entries x components numbers (and their carries)
        books = _moved(books, sums.groupBy("part", "entry", "pos", "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())

    code_type = T.StructType([rows.schema["vec_id"], rows.schema["label"], *result.fields[1:3]])
    coded = materialize(chunks.mapInArrow(encode(books, parts), code_type), "vector_codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = coded.groupBy("label").agg(total.alias("total"), F.count_if(F.col("error").isNull()).alias("beyond"))
    by_label = by_label.select(F.col("label").alias("_label"), F.when(F.col("beyond") == 0, F.col("total").try_cast("long")).alias("label_error"))
    digest = hashlib.sha256(",".join(str(int(v)) for book in books for entry in book for v in entry).encode()).hexdigest()
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _arrow_fields(df: DataFrame) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(df.schema))
