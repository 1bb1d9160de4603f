"""Language-model scoring: a deleted-interpolation bigram model over words.

P(w | v) = a0 / (V+1) + a1 c(w) / N + a2 c(v w) / c(v), with one weight triple for
each bucket of the context frequency c(v). The weights are learned by expectation
maximisation on held-out counts: one seventh of the training texts is scored with
the counts of the rest. The final counts are those of all training texts.

The counts cover the whole corpus and are never collected. Texts are cut into
blocks of about a million tokens, written once as word numbers and word hashes.
From those a block takes its distinct words and bigrams with their counts and
sends them, packed as sorted arrays, to the tasks that own their hash ranges;
those add up the blocks and answer with the totals of exactly the keys that each
block asked about. A block then meets its answers and looks up its tokens. The
keys themselves are only shuffled, never written: a block derives them again
from its numbers. Both shuffles carry a few bytes per distinct key of a block,
hot words are one key per block, and a task holds one hash range or one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, crc_part, materialize, scratch_path, slices, texts
from .text import word_bytes

FOLDS, HELD_OUT, DEV = 7, 2, 3
BLOCK_TOKENS = 1 << 20
RANGE_BYTES = 12 << 20  # bytes of text that one hash range of keys answers for
BUCKETS = 24
KEY_BITS = 62  # of a bigram hash: two distinct bigrams do not meet at any real number of them
STEPS = 4  # quantisation of log2 ratios in the held-out table, per octave
ABSENT = -(1 << 20)

_BLOCK = "kind string, block long, part long, n long, a binary, b binary, c binary"


def _pack(x: np.ndarray) -> bytes:
    """Byte planes of an integer array, compressed."""
    x = np.ascontiguousarray(x)
    return pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(buf: bytes, n: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype=dtype)
    raw = np.frombuffer(pa.decompress(buf, decompressed_size=n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).ravel()


def _pack_keys(keys: np.ndarray, bits: int) -> bytes:
    """Sorted keys of one range: which ones are bigrams, then the gaps of the words and of the bigrams (without the dropped bits)."""
    pair = (keys & np.uint64(1)) == 1
    drop = np.uint64(63 - min(bits, 62))
    words, pairs = keys[~pair], keys[pair] >> drop
    flags, *parts = np.packbits(pair).tobytes(), *(_pack(np.diff(k, prepend=np.uint64(0))) for k in (words, pairs))
    return b"".join([len(parts[0]).to_bytes(8, "little"), flags, *parts])


def _unpack_keys(buf: bytes, n: int, bits: int) -> np.ndarray:
    size, n_flags = int.from_bytes(buf[:8], "little"), (n + 7) // 8
    pair = np.unpackbits(np.frombuffer(buf, dtype=np.uint8, count=n_flags, offset=8), count=n).astype(bool)
    drop, at = np.uint64(63 - min(bits, 62)), 8 + n_flags
    keys, n_pairs = np.empty(n, dtype=np.uint64), int(pair.sum())
    keys[~pair] = np.cumsum(_unpack(buf[at : at + size], n - n_pairs, "<u8"), dtype=np.uint64)
    keys[pair] = np.cumsum(_unpack(buf[at + size :], n_pairs, "<u8"), dtype=np.uint64) << drop | np.uint64(1)
    return keys


def _sorted_keys(tokens: np.ndarray, starts: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, key position of each word, key position of each token's bigram, context of each token).

    Keys are the 63-bit word hashes (lowest bit 0) and the bigram hashes, of which
    the highest ``bits`` bits are kept (lowest bit 1). The context of a text's
    first token is the end token, local word 0.
    """
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[starts] = 0
    pair, which = np.unique(context.astype(np.int64) * len(hashes) + tokens, return_inverse=True)
    first, second = hashes[pair // len(hashes)], hashes[pair % len(hashes)]
    with np.errstate(over="ignore"):
        mixed = (first * np.uint64(0x9E3779B97F4A7C15) ^ (second + np.uint64(0xD1B54A32D192ED03))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(32)
    drop = np.uint64(63 - min(bits, 62))
    keys, place = np.unique(np.concatenate([hashes & ~np.uint64(1), mixed >> drop << drop | np.uint64(1)]), return_inverse=True)
    return keys, place[: len(hashes)], place[len(hashes) :][which], context


class _Block:
    def __init__(self) -> None:
        self.words: dict[bytes, int] = {b"": 0}  # local word 0: the end token (no word is empty)
        self.docs: list[tuple[int | None, int, np.ndarray]] = []
        self.tokens = 0

    def add(self, doc: int | None, fold: int, text: str) -> None:
        words = self.words
        ids = [words.setdefault(w, len(words)) for w in word_bytes(text)]
        ids.append(0)
        self.docs.append((doc, fold, np.array(ids, dtype=np.uint32)))
        self.tokens += len(ids)

    def rows(self, block: int, bits: int) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([t for _, _, t in self.docs])
        sizes = np.array([len(t) for _, _, t in self.docs], dtype=np.int64)
        folds = np.array([f for _, f, _ in self.docs], dtype=np.uint8)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.words], dtype=np.uint64)
        ids = np.array([-1 if d is None else d for d, _, _ in self.docs], dtype=np.int64)
        null = np.array([d is None for d, _, _ in self.docs], dtype=np.uint8)
        head = np.array([len(ids), len(tokens), len(hashes)], dtype=np.int64).tobytes()
        docs = head + ids.tobytes() + null.tobytes() + folds.tobytes() + sizes.tobytes()
        yield _rows([("texts", block, -1, len(tokens), docs, _pack(tokens), _pack(hashes))])
        mine = np.repeat(folds, sizes) == DEV  # the held-out tokens by the places of their keys, for the mixture weights
        if mine.any():
            _, of_word, of_pair, context = _sorted_keys(tokens, np.cumsum(sizes) - sizes, hashes, bits)
            places = (of_word[tokens[mine]], of_word[context[mine]], of_pair[mine])
            yield _rows([("dev", block, -1, int(mine.sum()), *(_pack(p.astype(np.uint32)) for p in places))])


class _Texts:
    """The texts of a block as they were written."""

    def __init__(self, head: bytes, tokens: bytes, hashes: bytes) -> None:
        n_docs, n_tokens, n_local = np.frombuffer(head, dtype=np.int64, count=3).tolist()
        self.ids = np.frombuffer(head, dtype=np.int64, count=n_docs, offset=24)
        self.null = np.frombuffer(head, dtype=np.uint8, count=n_docs, offset=24 + 8 * n_docs).astype(bool)
        self.folds = np.frombuffer(head, dtype=np.uint8, count=n_docs, offset=24 + 9 * n_docs)
        self.sizes = np.frombuffer(head, dtype=np.int64, count=n_docs, offset=24 + 10 * n_docs)
        self.tokens, self.starts = _unpack(tokens, n_tokens, "<u4"), np.cumsum(self.sizes) - self.sizes
        self.hashes = _unpack(hashes, n_local, "<u8")

    def sorted_keys(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return _sorted_keys(self.tokens, self.starts, self.hashes, bits)


def _block_keys(blocks: DataFrame, ranges: int, bits: int) -> DataFrame:
    """Written texts -> (kind, block, part, n, a, b, c): the block's keys of each hash range, with their counts in the training and in the held-out texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, *packed = (batch.column(c)[i].as_py() for c in ("block", "a", "b", "c"))
                t = _Texts(*packed)
                keys, of_word, of_pair, _ = t.sorted_keys(bits)
                fold, counts = np.repeat(t.folds, t.sizes), []
                for use in (fold != HELD_OUT, fold == DEV):
                    c = np.bincount(of_pair[use], minlength=len(keys))
                    c += np.bincount(of_word[t.tokens[use]], minlength=len(keys))
                    counts.append(c.astype(np.uint32))
                cuts = np.concatenate([[0], np.searchsorted(keys, _borders(ranges)), [len(keys)]])
                parts = [(p, a, b) for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a]
                yield _rows([("keys", block, p, b - a, _pack_keys(keys[a:b], bits), _pack(counts[0][a:b]), _pack(counts[1][a:b])) for p, a, b in parts])

    return blocks.where("kind = 'texts'").mapInArrow(run, _BLOCK)


def _count_blocks(docs: DataFrame, ranges: int, block_tokens: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(written blocks, their keys with counts) of (doc_id, text, fold)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "lm_blocks")
    _text_blocks(docs, block_tokens, bits).write.partitionBy("kind").parquet(path)
    blocks = spark.read.schema(_BLOCK).parquet(path).select(*_NAMES)
    return blocks, _block_keys(blocks, ranges, bits)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


_NAMES = ["kind", "block", "part", "n", "a", "b", "c"]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _borders(ranges: int) -> np.ndarray:
    return np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)


def _text_blocks(docs: DataFrame, block_tokens: int, bits: int) -> DataFrame:
    """(kind, block, part, n, a, b, c): packed texts, and the places of held-out tokens, of each block of (doc_id, text, fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        block = _Block()
        for part in slices(batches):
            for doc, text, fold in zip(*(c.to_pylist() for c in part.columns)):
                block.add(doc, fold, text)
                if block.tokens >= block_tokens:
                    yield from block.rows(number, bits)
                    number, block = number + 1, _Block()
        if block.docs:
            yield from block.rows(number, bits)

    return docs.mapInArrow(run, _BLOCK)


def _answer(bits: int):
    """Totals of one hash range, for each block in the order of its own keys; one row of range sums."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        keys = [_unpack_keys(r["a"], r["n"], bits) for r in rows]
        whole, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = []
        for c in ("b", "c"):
            sums, at = np.zeros(len(whole), dtype=np.int64), 0
            for r in rows:  # a block has a key once
                sums[back[at : at + r["n"]]] += _unpack(r[c], r["n"], "<u4")
                at += r["n"]
            total.append(sums)
        word = (whole & np.uint64(1)) == 0
        sums = np.array([total[0][word].sum(), total[1][word].sum(), (total[0][word] > 0).sum()], dtype=np.int64)
        out, at = [], 0
        for r in rows:
            mine = back[at : at + r["n"]]
            at += r["n"]
            out.append(["totals", r["block"], r["part"], r["n"], None, _pack(total[0][mine]), _pack(total[1][mine])])
        out.append(["sums", -1, rows[0]["part"], 0, sums.tobytes(), None, None])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)

    return run


def _bucket(context: np.ndarray) -> np.ndarray:
    """Bucket of a context frequency: 0 for none, then by powers of two."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _steps(ratio: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.rint(STEPS * np.log2(np.maximum(ratio, 1e-300))), ABSENT).astype(np.int64)


def _totals(rows: list[dict], column: str) -> np.ndarray:
    """The totals of a block's keys, in key order."""
    answers = sorted((r for r in rows if r["kind"] == "totals"), key=lambda r: r["part"])
    return np.concatenate([_unpack(r[column], r["n"], "<i8") for r in answers])


def _held_out_table(n_train: int, n_dev: int, n_words: int):
    """A block's held-out tokens with its answers -> rows (bucket, two, one, n), by the counts of the other training texts."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        dev = next((r for r in rows if r["kind"] == "dev"), None)
        cells, count = np.zeros((3, 0), dtype=np.int64), np.zeros(0, dtype=np.int64)
        if dev:
            rest = _totals(rows, "b") - _totals(rows, "c")
            w, v, p = (rest[_unpack(dev[c], dev["n"], "<u4")] for c in "abc")
            floor = 1.0 / (n_words + 1)
            two = np.divide(p, v, out=np.zeros(len(p)), where=v > 0) / floor
            one = w / max(n_train - n_dev, 1) / floor
            cells, count = np.unique(np.stack([_bucket(v), _steps(two), _steps(one)]), axis=1, return_counts=True)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (*cells, count)], names=["bucket", "two", "one", "n"])

    return run


_SCORES = "doc_id long, fold int, n_tokens long, n_known long, base_score double, score double"


def _score_block(n_train: int, n_words: int, weights: np.ndarray, bits: int):
    """A block's texts with its answers -> a row per text."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        text = next(r for r in rows if r["kind"] == "texts")
        t = _Texts(text["a"], text["b"], text["c"])
        _, of_word, of_pair, context = t.sorted_keys(bits)
        train, tokens, starts = _totals(rows, "b"), t.tokens, t.starts
        word, pair, before = train[of_word][tokens], train[of_pair], train[of_word][context]
        base = np.log10((word + 1) / (n_train + (n_words + 1)))
        mix = weights[_bucket(before)]
        two = np.divide(pair, before, out=np.zeros(len(tokens)), where=before > 0)
        mixed = np.log10(mix[:, 0] / (n_words + 1) + mix[:, 1] * word / max(n_train, 1) + mix[:, 2] * two)
        known, base, score = (np.add.reduceat(x, starts) for x in ((word > 0).astype(np.int64), base, mixed))
        return pa.Table.from_arrays(
            [pa.array(t.ids, pa.int64(), mask=t.null), pa.array(t.folds.astype(np.int32)), pa.array(t.sizes), pa.array(known), pa.array(base), pa.array(score)],
            names=["doc_id", "fold", "n_tokens", "n_known", "base_score", "score"],
        )

    return run


def learn_weights(cells: list[tuple[int, int, int, int]], rounds: int = 200) -> np.ndarray:
    """(bucket, quantised bigram ratio, quantised word ratio, count) -> BUCKETS x 3 mixture weights, by EM.

    A bucket without held-out tokens takes the weights of all buckets together; a
    context that was never seen (bucket 0) has no bigram estimate to weigh.
    """
    weights = np.zeros((BUCKETS + 1, 3))
    t = np.array(cells, dtype=np.float64).reshape(-1, 4)
    ratio = np.column_stack([np.ones(len(t)), *(np.where(t[:, c] <= ABSENT, 0.0, np.exp2(np.maximum(t[:, c], -2000) / STEPS)) for c in (2, 1))])
    for b in range(BUCKETS + 1):
        mine = (t[:, 0] == b) if b < BUCKETS else np.ones(len(t), dtype=bool)
        w = np.array([0.2, 0.8, 0.0]) if b == 0 else np.array([0.1, 0.4, 0.5])
        r, n = ratio[mine], t[mine, 3]
        for _ in range(rounds if len(r) else 0):
            post = r * w
            post *= (n / post.sum(axis=1))[:, None]
            new = post.sum(axis=0) / n.sum()
            done = np.abs(new - w).max() < 1e-9
            w = new
            if done:
                break
        w = np.maximum(w, [1e-6, 1e-6, 0])
        weights[b] = w / w.sum()
    for b in range(1, BUCKETS):
        if not (t[:, 0] == b).any():
            weights[b] = weights[BUCKETS]
    return weights[:BUCKETS]


def score_texts(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, block_tokens: int = BLOCK_TOKENS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the add-one word model, score the interpolated bigram model,
    both log10. Held-out rows (crc32(doc_id) mod 7 = 2) are scored and never counted.

    Edge cases: a NULL, empty or word-less text is one end token; a NULL doc_id
    counts as the empty text (crc32 0, a training row) and stays NULL; repeated
    rows are counted and scored each; without training rows all counts are 0.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col).select(ID, TEXT, crc_part(ID, FOLDS).cast("int").alias("fold"))
    size = rows.agg(F.sum(F.octet_length(TEXT))).first()[0] or 0
    ranges, bits = max(8, math.ceil(size / range_bytes)), KEY_BITS
    blocks, keys = _count_blocks(rows, ranges, block_tokens, bits)
    answers = materialize(keys.groupBy("part").applyInArrow(_answer(bits), _BLOCK), "lm_totals")
    totals = answers.where("kind = 'totals'")
    sums = [np.frombuffer(r["a"], dtype=np.int64) for r in answers.where("kind = 'sums'").select("a").toLocalIterator()]
    n_train, n_dev, n_words = (int(x) for x in (np.sum(sums, axis=0) if sums else (0, 0, 0)))
    held_out = blocks.where("kind = 'dev'").unionByName(totals).groupBy("block").applyInArrow(_held_out_table(n_train, n_dev, n_words), "bucket long, two long, one long, n long")
    cells = held_out.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect()  # bounded: buckets x quantised ratios
    weights = learn_weights(sorted((r["bucket"], r["two"], r["one"], r["n"]) for r in cells))
    train = totals.withColumn("c", F.lit(None).cast("binary"))  # the scores need the training counts only
    out = blocks.where("kind = 'texts'").unionByName(train).groupBy("block").applyInArrow(_score_block(n_train, n_words, weights, bits), _SCORES)
    return out.select(ID, (F.col("fold") == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
