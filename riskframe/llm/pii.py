"""Personal data: fixed base patterns plus a linear-chain conditional random field.

The base spans follow four fixed patterns. The field adds spans that the patterns
miss, such as spelled-out addresses ("kim at mail dot org") or numbers in other
groupings. It labels the words of a text with a kind or O, from word-shape
features of a word and its neighbours, is trained by maximum likelihood on a small
labelled table, and is decoded by Viterbi over numpy batches. An added span never
overlaps a base span; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, slices, texts

KINDS = ("email", "ip", "card", "phone")
DIGITS = frozenset("0123456789")

# fixed values: the base patterns of the four kinds
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        m = EMAIL.match(text, begin) if begin < at else None
        if m:
            out.append(m.span())
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start. Leftmost, non-overlapping within a kind."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(_octet(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in DIGITS for c in m.group()) <= 15]
    return out


# ---- the field -------------------------------------------------------------

LABELS = ("O", *KINDS)
TOKEN = re.compile(r"[A-Za-zÀ-\U0010ffff]+|[0-9]+|[^\sA-Za-z0-9À-\U0010ffff]")
#: words that carry the structure of a spelled-out address (a fixed, short list)
CUES = {w: i for i, w in enumerate(("at", "dot", "mail", "email", "phone", "tel", "call", "card", "ip", "host", "com", "org", "net"))}

#: the labelled table: (text, [(kind, exact part of the text)]). Small by design; the bound is its length.
TRAINING: list[tuple[str, list[tuple[str, str]]]] = [
    ("write to kim at mail dot org today", [("email", "kim at mail dot org")]),
    ("send it to lee . wong at example dot com , please", [("email", "lee . wong at example dot com")]),
    ("reach anna [at] site [dot] net for more", [("email", "anna [at] site [dot] net")]),
    ("contact bob (at) host (dot) org soon", [("email", "bob (at) host (dot) org")]),
    ("my address is max34 at mail7 dot example dot com thanks", [("email", "max34 at mail7 dot example dot com")]),
    ("ask 34@mail7.example.com about it", [("email", "34@mail7.example.com")]),
    ("from joe.doe@mail.example.org we heard", [("email", "joe.doe@mail.example.org")]),
    ("the host 10.20.30.40 was down", [("ip", "10.20.30.40")]),
    ("seen at 83.229.25.121 and again", [("ip", "83.229.25.121")]),
    ("server 161 . 17 . 88 . 162 answered", [("ip", "161 . 17 . 88 . 162")]),
    ("address 10[.]20[.]30[.]40 was blocked", [("ip", "10[.]20[.]30[.]40")]),
    ("paid with 4845 1681 1440 7329 on monday", [("card", "4845 1681 1440 7329")]),
    ("the card 4845168114407329 was used", [("card", "4845168114407329")]),
    ("number 4417.7442.8035.1547 is on file", [("card", "4417.7442.8035.1547")]),
    ("number 4417_7442_8035_1547 is on file", [("card", "4417_7442_8035_1547")]),
    ("call +1 (974) 555-3436 now", [("phone", "+1 (974) 555-3436")]),
    ("call (974) 555-3436 now", [("phone", "(974) 555-3436")]),
    ("phone 974-555-3436 after noon", [("phone", "974-555-3436")]),
    ("tel 0049 30 555 3436 in berlin", [("phone", "0049 30 555 3436")]),
    ("my number is 974.555.3436 thanks", [("phone", "974.555.3436")]),
    ("they met at the dot of noon and left", []),
    ("look at the mail and the host at home", []),
    ("at 10 we left and at 12 we were home", []),
    ("in 2021 the team had 34 people and 1200 cards", []),
    ("pages 10 - 20 and 30 - 40 of the book", []),
    ("version 1.2.3 of the tool came in 2019", []),
    ("the price was 12.50 or 1,200 in all", []),
    ("on 2021-03-04 at 10:30 the call began", []),
    ("a token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" was found", []),
    ("see section 4.2 (page 17) for more", []),
    ("he said : no , never . then he left", []),
    ("the score was 3 - 2 after 90 minutes", []),
    ("it is 1 + 2 = 3 as ever", []),
    ("\"yes\" ; \"no\" ! what ? (well) ...", []),
    ("# # # $ $ $ % % % & & & * * * word | word | word", []),
    ("the end at last", []),
    ("call me at noon or mail the host", []),
    ("licensed under the apache license , version 2.0 .", []),
    ("room 12 , floor 3 , house 155", []),
    ("one two three four five six seven", []),
]


def shape(token: str) -> int:
    """Shape number of a token: cue word, short or long word, number by its length, or sign."""
    c = token[0]
    if c in DIGITS:
        return min(len(token), 20)  # 1..20
    if c.isalpha():
        cue = CUES.get(token.lower())
        return 21 + cue if cue is not None else 21 + len(CUES) + (c.isupper()) + 2 * (len(token) > 3)
    base = 25 + len(CUES)
    return base + {".": 1, "-": 2, "(": 3, ")": 4, "[": 5, "]": 6, "+": 7, "@": 8, "_": 9, ",": 10, ":": 11, "/": 12, "=": 13, '"': 14, "|": 15}.get(c, 0)


N_SHAPES = 25 + len(CUES) + 16
EDGE = N_SHAPES  # before the first and after the last word
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
WINDOW = 1 << 14  # words whose emission scores are held at a time


@dataclass
class ChainField:
    """emit[o, s, y]: weight of shape s at offset OFFSETS[o] for label y; move[y, z]; first[y]."""

    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def scores(self, shapes: np.ndarray, a: int = 0, b: int | None = None) -> np.ndarray:
        """(batch, time) shapes, padded with EDGE -> (batch, b - a, label) emission scores of the words a to b."""
        pad, t = max(abs(o) for o in OFFSETS), shapes.shape[1]
        b = t if b is None else b
        wide = np.full((shapes.shape[0], b - a + 2 * pad), EDGE, dtype=shapes.dtype)
        first, last = max(a - pad, 0), min(b + pad, t)
        wide[:, first - a + pad : last - a + pad] = shapes[:, first:last]
        out = np.zeros((shapes.shape[0], b - a, len(LABELS)), dtype=np.float32)
        for k, o in enumerate(OFFSETS):
            out += self.emit[k].astype(np.float32)[wide[:, pad + o : pad + o + b - a]]
        return out

    def decode(self, shapes: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """Viterbi labels (batch, time) of padded shape rows; entries past a row's length are 0.

        Emission scores are held for ``window`` words at a time; the best score of every
        label is carried from one window to the next, so the labels are those of one piece.
        """
        n, t = shapes.shape
        e = self.scores(shapes, 0, min(window, t))
        back = np.zeros((n, t, len(LABELS)), dtype=np.int8)
        best = self.first.astype(np.float32) + e[:, 0]
        final = best.copy()
        move = self.move.astype(np.float32)
        for i in range(1, t):
            if i % window == 0:
                e = self.scores(shapes, i, min(i + window, t))
            all_ways = best[:, :, None] + move
            back[:, i] = all_ways.argmax(axis=1)
            best = all_ways.max(axis=1) + e[:, i % window]
            final = np.where((lengths > i)[:, None], best, final)
        out = np.zeros((n, t), dtype=np.int8)
        state = final.argmax(axis=1)
        rows = np.arange(n)
        for i in range(t - 1, -1, -1):
            live = lengths > i
            out[live, i] = state[live]
            if i:
                state = np.where(live, back[rows, i, state], state)
        return out


def _encode(text: str) -> tuple[list[re.Match], np.ndarray]:
    found = list(TOKEN.finditer(text))
    return found, np.array([shape(m.group()) for m in found], dtype=np.int64)


def _labels(text: str, spans: Sequence[tuple[str, str]], found: list[re.Match]) -> np.ndarray:
    y = np.zeros(len(found), dtype=np.int64)
    for kind, part in spans:
        a = text.index(part)
        for i, m in enumerate(found):
            if a <= m.start() and m.end() <= a + len(part):
                y[i] = LABELS.index(kind)
    return y


def train(table: Sequence[tuple[str, list[tuple[str, str]]]] = tuple(TRAINING), l2: float = 0.02, rounds: int = 400, rate: float = 0.5) -> ChainField:
    """Maximum likelihood by gradient ascent (AdaGrad) with forward-backward in log space."""
    rows = []
    for text, spans in table:
        found, s = _encode(text)
        rows.append((s, _labels(text, spans, found)))
    t, n, k = max(len(s) for s, _ in rows), len(rows), len(LABELS)
    shapes, gold, lengths = np.full((n, t), EDGE), np.zeros((n, t), dtype=np.int64), np.array([len(s) for s, _ in rows])
    for i, (s, y) in enumerate(rows):
        shapes[i, : len(s)], gold[i, : len(s)] = s, y
    live = np.arange(t)[None, :] < lengths[:, None]
    pad = max(abs(o) for o in OFFSETS)
    wide = np.full((n, t + 2 * pad), EDGE)
    wide[:, pad:-pad] = shapes
    model = ChainField(np.zeros((len(OFFSETS), N_SHAPES + 1, k)), np.zeros((k, k)), np.zeros(k))
    params = [model.emit, model.move, model.first]
    seen = [np.full_like(p, 1e-6) for p in params]

    def lse(x, axis):
        m = x.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    one = np.eye(k)
    for _ in range(rounds):
        e = np.zeros((n, t, k))
        for j, o in enumerate(OFFSETS):
            e += model.emit[j][wide[:, pad + o : pad + o + t]]
        fwd = np.zeros((n, t, k))
        fwd[:, 0] = model.first + e[:, 0]
        for i in range(1, t):
            step = lse(fwd[:, i - 1][:, :, None] + model.move, 1) + e[:, i]
            fwd[:, i] = np.where(live[:, i][:, None], step, fwd[:, i - 1])
        z = lse(fwd[:, -1], 1)
        bwd = np.zeros((n, t, k))
        for i in range(t - 2, -1, -1):
            step = lse(model.move + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
            bwd[:, i] = np.where(live[:, i + 1][:, None], step, 0)
        node = np.exp(fwd + bwd - z[:, None, None]) * live[:, :, None]
        diff = (one[gold] - node) * live[:, :, None]
        grad = [np.zeros_like(p) for p in params]
        for j, o in enumerate(OFFSETS):
            np.add.at(grad[0][j], wide[:, pad + o : pad + o + t], diff)
        for i in range(1, t):
            w = live[:, i]
            pair = np.exp(fwd[:, i - 1][:, :, None] + model.move + (e[:, i] + bwd[:, i])[:, None, :] - z[:, None, None])
            grad[1] += ((one[gold[:, i - 1]][:, :, None] * one[gold[:, i]][:, None, :]) - pair)[w].sum(axis=0)
        grad[2] += diff[:, 0].sum(axis=0)
        for p, g, s in zip(params, grad, seen):
            g = g / n - l2 / n * p
            s += g * g
            p += rate * g / np.sqrt(s)
    return model


#: what every added span holds (see _valid): a digit, an @, or the word "dot" of a spelled-out address
_LIVELY = re.compile(r"[0-9@]|\b[dD][oO][tT]\b")
CELLS = 1 << 20  # words of a padded batch, unless one sequence is longer
REACH = 64  # words on either side of a lively word that are decoded with it


def _valid(kind: str, part: str) -> bool:
    """What an added span must hold: enough digits for the numbers, an "at" and a "dot" for an address."""
    digits = [c for c in part if c in DIGITS]
    low = part.lower()
    if kind == "email":
        signs = [m.group() for m in TOKEN.finditer(low)]
        host = signs[signs.index("at") + 1 :] if "at" in signs else signs[signs.index("@") + 1 :] if "@" in signs else []
        return bool(signs) and signs[0] not in ("at", "@") and ("dot" in host or ("@" in signs and "." in host)) and signs[-1].isalnum() and signs[-1] not in ("at", "dot")
    if kind == "ip":
        parts = re.findall("[0-9]+", part)
        return len(parts) == 4 and all(_octet(p) for p in parts)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn("".join(digits))
    return 8 <= len(digits) <= 15


def _stretches(text: str) -> list[list[int]]:
    """Merged [start, end) stretches of whole words around the lively words."""
    wide, cuts = REACH * 8, []
    for found in _LIVELY.finditer(text):
        m = found.start()
        a, b = max(0, m - wide), min(len(text), m + wide)
        if cuts and a <= cuts[-1][1]:
            cuts[-1][1] = b
        else:
            cuts.append([a, b])
    for cut in cuts:
        while cut[0] > 0 and not text[cut[0] - 1].isspace():
            cut[0] -= 1
        while cut[1] < len(text) and not text[cut[1]].isspace():
            cut[1] += 1
    return cuts


def _encode_stretch(text: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, shapes) of the words of a stretch, 24 bytes a word."""
    starts, ends, shapes = array("q"), array("q"), array("q")
    for m in TOKEN.finditer(text, a, b):
        starts.append(m.start())
        ends.append(m.end())
        shapes.append(shape(m.group()))
    return tuple(np.frombuffer(x, dtype=np.int64) if x else np.zeros(0, np.int64) for x in (starts, ends, shapes))


class Covered:
    """The union of some spans; ``touched`` tells for each of many stretches whether it meets the union, by binary search."""

    def __init__(self, spans: Sequence[tuple[str, int, int]]):
        ordered = sorted((s, e) for _, s, e in spans)
        self.starts = np.array([s for s, _ in ordered], dtype=np.int64)
        # the furthest end so far: of the spans that start before a stretch ends, one reaches into it if the furthest does
        self.ends = np.maximum.accumulate(np.array([e for _, e in ordered], dtype=np.int64)) if ordered else self.starts

    def touched(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(len(starts), dtype=bool)
        before = np.searchsorted(self.starts, ends, side="left")
        return (before > 0) & (self.ends[np.maximum(before - 1, 0)] > starts)


def added_spans(batch: Sequence[str], bases: Sequence[list[tuple[str, int, int]]], model: ChainField, rows: int = 256) -> list[list[tuple[str, int, int]]]:
    """The field's spans of each text that touch no base span.

    A word whose surroundings (``REACH`` words each way) hold no digit, @ or "dot"
    can only be O: ``_valid`` asks every kind for one. Such words are not decoded; the
    rest of the text is, in padded batches of word sequences. A sequence is never
    cut: a long one without such gaps is decoded window by window with carried
    state. Work and memory grow with the length of the text, whatever its spans.
    """
    work: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    for i, text in enumerate(batch):
        work += [(i, *_encode_stretch(text, a, b)) for a, b in _stretches(text)]
    covered = {i: Covered(bases[i]) for i in {w[0] for w in work}}
    out: list[list[tuple[str, int, int]]] = [[] for _ in batch]
    work.sort(key=lambda w: len(w[3]))
    j = 0
    while j < len(work):
        size = 1  # as many rows as fit in a padded batch of CELLS words, one at least
        while size < rows and j + size < len(work) and (size + 1) * len(work[j + size][3]) <= CELLS:
            size += 1
        group = work[j : j + size]
        j += size
        lengths = np.array([len(w[3]) for w in group])
        shapes = np.full((len(group), max(int(lengths.max()), 1)), EDGE)
        for k, w in enumerate(group):
            shapes[k, : len(w[3])] = w[3]
        for (i, starts, ends, _), y in zip(group, model.decode(shapes, lengths)):
            y, text = y[: len(starts)].copy(), batch[i]
            y[covered[i].touched(starts, ends)] = 0  # base spans stand by themselves
            for t in np.flatnonzero(y > 1):  # and numbers have no letters
                if text[starts[t]].isalpha():
                    y[t] = 0
            change = np.flatnonzero(np.diff(np.concatenate([[0], y, [0]])))
            runs = [(a, b) for a, b in zip(change, change[1:]) if y[a]]
            if not runs:
                continue
            low, high = (np.array(x) for x in zip(*runs))
            free = ~covered[i].touched(starts[low], ends[high - 1])
            for a, b in zip(low[free], high[free]):
                start, end, kind = int(starts[a]), int(ends[b - 1]), LABELS[y[a]]
                if _valid(kind, text[start:end]):
                    out[i].append((kind, start, end))
    return out


def digest(spans: Sequence[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def find_personal_data(docs: DataFrame, model: ChainField | None = None, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and ``base_sha256`` are of the base spans; ``spans`` lists the base
    and the added ones. Offsets are code points, ends exclusive.

    Edge cases: a NULL or empty text has no spans (the digest is of the empty
    string); spans of different kinds may overlap, as the patterns are separate;
    repeated rows and rows with a NULL doc_id are each searched; other columns are
    ignored; an empty table gives an empty result.
    """
    field = docs.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            batch = part.column(1).to_pylist()
            bases = [base_spans(t) for t in batch]
            extra = added_spans(batch, bases, field.value)
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b in bases], pa.int64()) for kind in KINDS]
            sha = [hashlib.sha256(digest(b).encode()).hexdigest() for b in bases]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *counts, pa.array(sha), pa.array([digest(b + x) for b, x in zip(bases, extra)])],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    out = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return texts(docs, id_col, text_col).mapInArrow(run, out)


def redact(text: str, spans: str, mark: str = "[{}]") -> str:
    """The text with each span of a ``spans`` string replaced by its kind; overlapping spans become one mark."""
    parts = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, b, k in parts:
        if a >= at:
            out += [text[at:a], mark.format(k)]
        at = max(at, b)
    return "".join(out) + text[at:]
