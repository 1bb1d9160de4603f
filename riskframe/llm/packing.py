"""Packing: concatenate and cut.

Pass one tokenises each document and writes its ids with a running offset inside
its partition; pass two adds the prefix sum of the partition totals, which gives
every document its place in one global row of tokens, and cuts that row into fixed
windows. A document that crosses a window border gives one boundary record per
window. Only the partition totals (one number per partition) meet in one place.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .common import ID, TEXT, materialize, slices, texts
from .text import WORD

SEQUENCE = 4096
END_ID = 2


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


def plain_split(pattern: str) -> re.Pattern:
    """``pattern`` for parts of plain letters, digits and signs only: its classes are spelled out, so that the standard library's faster matcher takes it."""
    plain = {form for c in map(chr, range(0x21, 0x250)) if not c.isspace() for form in c + c.lower()}
    spelled = {kind: "".join(re.escape(c) for c in sorted(plain) if unicodedata.category(c)[0] == kind) for kind in "LN"}
    return re.compile(pattern.replace(r"\p{L}", spelled["L"]).replace(r"\p{N}", spelled["N"]))


class Seen(dict):
    """Ids by word; ``find`` is asked for any other word, which is kept unless it is long or ``most`` words are there."""

    def __init__(self, find: Callable[[str], bytes], most: int):
        self.find, self.most = find, most

    def __missing__(self, part: str) -> bytes:
        ids = self.find(part)
        if len(part) <= 64 and len(self) < self.most:
            self[part] = ids
        return ids


class WordTokenizer:
    """Ids of a word-level BPE tokenizer file, with the ids of seen words kept.

    White space separates words in these vocabularies and is dropped, so a text's
    ids are those of its space-separated parts, one after the other. Parts of plain
    Latin letters, digits and signs go straight to the BPE model after the file's
    own normalisation and split; any other part, and every part of a file whose
    normalisation or split is another one, goes through the whole tokenizer.
    """

    #: fixed value: the split that the fast way knows, as the vocabulary file states it
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN = re.compile("[\x21-\x7e\xa1-įı-ɏ]+")
    KEEP, KEEP_PIECES = 450_000, 200_000
    ODD_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

    def __init__(self, json_text: str):
        import json

        self.full = Tokenizer.from_str(json_text)
        spec = json.loads(json_text)
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        kinds = [n.get("type") for n in norm.get("normalizers", [])]
        splits = pre.get("pretokenizers", [])
        self.fast = (
            spec["model"]["type"] == "BPE"
            and kinds == ["NFC", "Replace", "Lowercase"]
            and len(splits) == 2
            and splits[0].get("pattern") == {"Regex": self.SPLIT}
            and splits[1].get("type") == "ByteLevel"
        )
        marks = [t["content"] for t in spec.get("added_tokens", [])]
        self.marks = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        if self.fast:
            self.model, self.split = Tokenizer.from_str(json_text).model, plain_split(self.SPLIT)
            alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
            printable = [b for b in range(256) if chr(b) in set(alphabet)]
            shifted = iter(c for c in alphabet if ord(c) > 255)
            names = {b: chr(b) for b in printable}
            self.names = "".join(names[b] if b in names else next(shifted) for b in range(256))
        # two generations of seen words: a full young one becomes the old one, so frequent words stay
        self.seen = Seen(self._find, self.KEEP)
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _ids(self, part: str) -> bytes:
        if self.fast and part.isascii() and part.isalpha():
            return self._piece(part.lower())
        if self.fast and self.PLAIN.fullmatch(part) and not (self.marks and self.marks.search(part)):
            low = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).lower()
            return b"".join(map(self._piece, self.split.findall(low)))
        return packed(self.full.encode(part, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the split: signs, digits and common letters go with many words."""
        found = self.pieces.get(piece)
        if found is None:
            name = piece if piece.isascii() else charmap_decode(piece.encode(), "strict", self.names)[0]
            found = packed([t.id for t in self.model.tokenize(name)])
            if len(piece) <= 16:
                if len(self.pieces) >= self.KEEP_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def _find(self, part: str) -> bytes:
        ids = self.old.get(part)
        return self._ids(part) if ids is None else ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        # str.split() knows more kinds of white space than the words' definition
        parts = WORD.findall(text) if any(map(text.__contains__, self.ODD_SPACE)) else text.split()
        found = b"".join(map(self.seen.__getitem__, parts))
        if len(self.seen) >= self.KEEP:
            self.seen, self.old = Seen(self._find, self.KEEP), self.seen
        return found


_TOKENIZERS: dict[int, WordTokenizer] = {}


def tokenize(docs: DataFrame, tokenizer_json: str, end_id: int = END_ID) -> DataFrame:
    """(part, before, doc_id, ids, doc_tokens) for each row of (doc_id, text).

    ids are little-endian unsigned 32-bit, the end id included; ``before`` counts
    the tokens of the rows before it in its partition ``part``. The vocabulary
    file's text travels with the job: executors need no file of their own.
    """
    end, shared = np.array([end_id], dtype="<u4").tobytes(), docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = hash(shared.value)
        tok = _TOKENIZERS.get(key)
        if tok is None:
            _TOKENIZERS.clear()
            tok = _TOKENIZERS[key] = WordTokenizer(shared.value)
        part, total = TaskContext.get().partitionId(), 0
        for rows in slices(batches):
            ids = [tok.encode(t) + end for t in rows.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(before), rows.column(0), pa.array(ids, type=pa.binary()), pa.array(n)],
                ["part", "before", "doc_id", "ids", "doc_tokens"],
            )

    return docs.mapInArrow(run, "part int, before long, doc_id long, ids binary, doc_tokens long")


def pack(docs: DataFrame, tokenizer_json: str, sequence: int = SEQUENCE, end_id: int = END_ID, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    All sequences are full except the last, so the padding is under one sequence
    in all. A document's pieces follow each other in consecutive sequences.

    Edge cases: a NULL or empty text is one end id; a document longer than a
    sequence has several pieces; repeated rows and rows with a NULL doc_id are
    packed each on its own. Other columns are ignored; an empty table gives an
    empty result.
    """
    rows = materialize(tokenize(texts(docs, id_col, text_col), tokenizer_json, end_id), "token_ids")
    totals = rows.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    # one row per partition of the first pass: the only rows that one task sees together
    first = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    size = F.lit(sequence).cast("long")
    at = rows.join(F.broadcast(first), "part").withColumn("at", F.col("first") + F.col("before"))
    last = F.col("at") + F.col("doc_tokens") - F.lit(1)

    def cut(s):
        begin = F.greatest(s * size - F.col("at"), F.lit(0).cast("long"))
        stop = F.least((s + F.lit(1)) * size - F.col("at"), F.col("doc_tokens"))
        piece = F.substring(F.col("ids"), (begin * 4 + 1).cast("int"), ((stop - begin) * 4).cast("int"))
        return F.struct(begin.alias("start"), (stop - begin).alias("length"), piece.alias("ids"), s.alias("sequence_id"), (F.col("at") + begin - s * size).alias("offset"))

    pieces = F.transform(F.sequence(F.floor(F.col("at") / size), F.floor(last / size)), cut)
    return at.select(ID, "doc_tokens", F.explode(pieces).alias("p")).select(ID, "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def with_crc(pieces: DataFrame) -> DataFrame:
    """The digest columns of the packed pieces."""
    return pieces.select(ID, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
