"""Exact dedup, SimHash, line dedup and decontamination against brute force on small tables with awkward rows."""

import collections
import hashlib
import itertools
import os
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from riskframe.llm import decontam, exact_dedup, line_dedup, simhash
from riskframe.llm.components import connected_components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, kept string, fingerprint int, h double, lang string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "en", "er", "on", "é", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [prose(rng, rng.randint(1, 60)) for _ in range(25)]
    out = [(i, base[i % 25]) for i in range(60)]
    out += [(100 + i, base[i].replace(" ", "  \t", 1) + " ") for i in range(10)]
    out += [(200 + i, base[i].upper()) for i in range(5)]
    near = prose(rng, 400).split()
    for i in range(20):
        w = list(near)
        w[rng.randrange(400)] = "zz%d" % i
        out.append((300 + i, " ".join(w)))
    out += [(400, None), (401, ""), (402, " \n "), (403, None), (3, base[3]), (None, base[4]), (None, "lonely text"), (500, "x " * 20000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "k", 1, 0.5, None) for d, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


def test_exact_dedup(spark, docs, rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    want = sorted(
        (str(d), str(low(groups[norm(t)])), len(groups[norm(t)]), d == low(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows
    )
    for h in (exact_dedup.md5_128, lambda c: F.substring(F.md5(c.cast("binary")), 1, 1)):  # the second one collides all the time
        got = exact_dedup.exact_dedup(docs, content_hash=h).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {low(g) for g in groups.values()}


def test_each_text_of_a_repeated_id_meets_its_own_verdict(spark):
    """Under id 5, a copy or contaminated text goes and the other text stays; so it is with rows without an id."""
    rng = random.Random(8)
    one, two, item = prose(rng, 60), prose(rng, 60), prose(rng, 30)
    df = spark.createDataFrame([(1, one), (5, one), (5, two), (None, one), (None, item)], "doc_id long, text string")
    ids = lambda kept: sorted((r.doc_id or 0, r.text) for r in kept.collect())
    want = sorted([(0, item), (1, one), (5, two)])
    assert ids(exact_dedup.keep_first_copies(df)) == want
    assert ids(simhash.keep_one_per_group(df)) == want
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(5, item), (5, two), (6, None), (None, item), (None, one)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in decontam.drop_contaminated(df, bench).collect() if r.text) == [(0, one), (5, two)]


def brute_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0


@pytest.mark.parametrize("hot", [1024, 2])
def test_simhash(spark, docs, rows, hot):
    fps = [brute_fingerprint(t) for _, t in rows]
    near = {f: f for f in fps}

    def root(f):
        while near[f] != f:
            f = near[f]
        return f

    for a, b in itertools.combinations(sorted(near), 2):
        if (a ^ b).bit_count() <= 4:
            near[root(b)] = root(a)
    members = collections.defaultdict(list)
    for (d, _), f in zip(rows, fps):
        members[root(f)].append(d)
    want = sorted((str(d), f"{f:016x}", str(low(members[root(f)])), len(members[root(f)])) for (d, _), f in zip(rows, fps))
    got = simhash.simhash_groups(docs, hot_bucket=hot).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id), r.group_size) for r in got) == want
    assert any(len(set(m)) > 5 for m in members.values())


def test_simhash_links_random_fingerprints(spark):
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centre for _ in range(30)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = {(r.a, r.b) for r in simhash.close_links(df).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(signed), 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    assert links == want
    for n in (2, 10**6, 10**9, 10**12):
        masks = simhash.block_masks(n, 4)
        for _ in range(200):  # every set of four differing bits leaves one mask untouched
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not diff & m for m in masks)


def test_simhash_empty(spark):
    assert simhash.simhash_groups(empty(spark)).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {200: 200, 201: 200}


def test_within_is_edit_distance():
    rng = random.Random(1)

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    for _ in range(5000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        for k in range(4):
            assert line_dedup.within(a, b, k) == (distance(a, b) <= k)


@pytest.mark.parametrize(("k", "hot"), [(1, 10000), (1, 2), (2, 256)])
def test_line_classes(spark, k, hot):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdef ") for _ in range(30)).strip() for _ in range(15)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(3):
            c = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                i = rng.randrange(len(c))
                c[i : i + rng.randint(0, 1)] = rng.choice(("x", "y", "zé"[rng.randint(0, 1)]))
            lines.append("".join(c))
        rows.append((d, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "short\nshort"), (503, "  \n"), (None, base[0]), (504, base[1].replace(" ", "\t "))]
    spots = collections.defaultdict(list)
    for d, t in rows:
        for no, raw in enumerate((t or "").split("\n")):
            line = re.sub("[\x20\x09-\x0d]+", " ", raw).strip(" ")
            if line:
                spots[line].append((d is None, d or 0, no))
    near = {x: x for x in spots}

    def root(x):
        while near[x] != x:
            x = near[x]
        return x

    for a, b in itertools.combinations(near, 2):
        if min(len(a), len(b)) >= 16 and line_dedup.within(a, b, k):
            near[root(a)] = root(b)
    classes = collections.defaultdict(list)
    for x, s in spots.items():
        classes[root(x)] += s
    want = {s: (min(c), len(c)) for c in classes.values() for s in c}
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kept int")
    got = line_dedup.line_classes(df, k=k, hot_bucket=hot).collect()
    assert {(r.doc_id is None, r.doc_id or 0, r.line_no): ((r.first_doc is None, r.first_doc or 0, r.first_line), r.class_lines) for r in got} == want


def test_line_dedup_rows(spark):
    df = spark.createDataFrame([(1, "a line of some length here\nother"), (2, "a line of some length herE\nother"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_kept, r.kept_lines) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (2, 2, "0,1"), 2: (2, 0, ""), 3: (0, 0, "")}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_classes_of_long_lines(spark):
    """The threshold grows with the line; lines of one long word (no word runs) link as well."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(n)) for n in (14, 30, 60, 60, 150)] + ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (90, 200)]
    passage = " ".join(word() for _ in range(25))
    base += [passage + " " + " ".join(word() for _ in range(25)) for _ in range(3)]
    lines = []
    for x in base:
        for _ in range(9):
            c = list(x)
            for _ in range(rng.randint(0, len(x) // 40 + 2)):
                i = rng.randrange(len(c))
                c[i : i + rng.randint(0, 1)] = rng.choice(("x", "é", ""))
            lines.append(line_dedup.norm_line("".join(c)))
    near = {x: x for x in lines}

    def root(x):
        while near[x] != x:
            x = near[x]
        return x

    linked = 0
    for a, b in itertools.combinations(near, 2):
        if line_dedup.within(a, b, max(1, min(len(a), len(b)) // 40)):
            linked += not line_dedup.within(a, b, 1)
            near[root(a)] = root(b)
    first = {}
    for d, x in enumerate(lines):
        first.setdefault(root(x), d)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id: r.first_doc for r in line_dedup.line_classes(df).collect()} == {d: first[root(x)] for d, x in enumerate(lines)}
    assert linked > 50


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_near_long_lines_keep_a_run_in_common():
    rng = random.Random(5)
    for n in (80, 119, 120, 161, 400, 1300):
        for _ in range(40):
            a = "".join(rng.choice("abc ") for _ in range(n))
            c = list(a)
            for i in sorted(rng.sample(range(n), n // 40), reverse=True):
                c[i : i + 1] = rng.choice(("", "x", "xy"))
            b = "".join(c)
            e = min(len(a), len(b)) // 40
            if e < 2 or not line_dedup.within(a, b, e):
                continue
            shared = set()
            for band in set(line_dedup.bands(len(a), 1, 40)) & set(line_dedup.bands(len(b), 1, 40)):
                key, ref, size, pos = line_dedup._line_keys([a, b], [0, 1], band, 1, 40)
                shared |= {k for k in key[ref == 0] if k in set(key[ref == 1])}
                x, y, _ = line_dedup._meet(key, ref, size, pos, 40, 256)
                shared |= {"pair"} if len(x) else set()
            assert "pair" in shared and len(shared) > 1


def test_crowds_of_long_lines(spark):
    """Lines of crowded runs (near copies, a passage that all have) link like all pairs; what is written stays below the texts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    copied, passage, lines = text(60), text(40), []
    for _ in range(40):
        c = list(copied)
        for _ in range(rng.randint(0, 9)):
            c[rng.randrange(len(c))] = rng.choice("xyz")
        lines += ["".join(c), text(rng.randint(1, 9)) + " " + passage]
    near = {x: x for x in lines}

    def root(x):
        while near[x] != x:
            x = near[x]
        return x

    for a, b in itertools.combinations(near, 2):
        if line_dedup.within(a, b, max(1, min(len(a), len(b)) // 40)):
            near[root(a)] = root(b)
    lines += [text(60) for _ in range(1500)]
    near |= {x: x for x in lines[80:]}
    first = {}
    for d, x in enumerate(lines):
        first.setdefault(root(x), d)
    assert 2 < len({root(x) for x in lines[:80]}) < 70
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").coalesce(2)
    scratch = line_dedup.materialize(df, "probe").inputFiles()[0].removeprefix("file://").split("/scratch/")[0] + "/scratch"
    before = set(os.listdir(scratch))
    got = {r.doc_id: r.first_doc for r in line_dedup.line_classes(df, hot_bucket=4).collect()}
    assert got == {d: first[root(x)] for d, x in enumerate(lines)}
    runs = [f for f in os.listdir(scratch) if f not in before and not f.startswith("long_texts")]
    written = sum(os.path.getsize(os.path.join(scratch, f, p)) for f in runs for p in os.listdir(os.path.join(scratch, f)) if p.endswith(".parquet"))
    assert written < sum(map(len, lines)), "no list of a line's runs is written"


def test_decontamination(spark):
    rng = random.Random(4)
    long_items = [" ".join(prose(rng, 1) + str(rng.randint(0, 9)) for _ in range(n)) for n in (13, 20, 40)]
    bench = [(1, long_items[0]), (20, long_items[1]), (3, long_items[2]), (4, "Short, ITEM here"), (5, None), (6, "..."), (7, long_items[0] + " tail"), (None, long_items[1])]
    rows = [
        (1, "start " + long_items[0].upper() + " end"), (2, long_items[1].replace(" ", ", ")), (3, " ".join(["pad"] * 600) + " " + long_items[0]),
        (4, "a short item here and short item here"), (5, None), (6, ""), (7, "--"), (8, " ".join(long_items[2].split()[:12])), (9, long_items[2] + " x " + long_items[2]),
        (None, long_items[0]), (9, long_items[2] + " x " + long_items[2]), (10, "été " + long_items[1] + "É"),
    ]
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = WORD.findall((t or "").translate(LOW))
        k = min(13, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[p : p + k])].add(i)
    want = []
    for d, t in rows:
        w, hit, items = WORD.findall((t or "").translate(LOW)), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    items |= windows[tuple(w[p : p + k])]
        named = ",".join(sorted(str(i) for i in items if i is not None))
        want.append((str(d), len(w), len(hit), len(items), hashlib.sha256(named.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    docs = spark.createDataFrame([(d, t, "w", 2) for d, t in rows], "doc_id long, text string, gram string, n_hit int")
    items = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, h int")
    for most in (1_000_000, 0):  # the broadcast and the shuffled join
        got = decontam.decontaminate(docs, items, broadcast_windows=most).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)
    assert decontam.decontaminate(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in decontam.decontaminate(docs, items.limit(0)).collect()} == {0}
    clean = decontam.drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {int(d) for d, *_, bad in want if not bad}  # the row without an id holds an item
