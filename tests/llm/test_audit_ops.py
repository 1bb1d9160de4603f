"""Source divergence, vector codes and license scans against brute force on small tables with awkward rows."""

import collections
import fractions
import hashlib
import math
import random
import re

import numpy as np
import pytest

from riskframe.llm import divergence, licenses, vector_codes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------------------
# source divergence
# ---------------------------------------------------------------------------

DOCS = "text string, lang string, source string, part int, item string, value double, n_a string, terms int, doc_id long"


def doc_rows(rows):
    return [(t, lang, s, 1, "x", 0.5, None, 7, i) for i, (t, lang, s) in enumerate(rows)]


def brute_audit(rows, min_docs=10, top=10):
    terms = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    rows = [(terms(t), lang or "", s or "") for t, lang, s in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        seen = collections.Counter(w for t, k, _ in rows if k == lang for w in set(t))
        kept = sorted((w for w, n in seen.items() if n >= min_docs), key=str.encode)
        sources = sorted({s for _, k, s in rows if k == lang}, key=str.encode)
        count = {s: collections.Counter(w for t, k, x in rows if (k, x) == (lang, s) for w in t if w in set(kept)) for s in sources}
        whole = sum(count.values(), collections.Counter())

        def p(c):
            return {w: 1 + math.floor(fractions.Fraction(10**9 * (c[w] + 2), sum(c.values()) + 2 * len(kept))) for w in kept}

        f = lambda x, y: (x - y) ** 2 // (x + y)
        shares, q = {s: p(count[s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(x, sum(f(shares[s][w], shares[x][w]) for w in kept)) for x in sources if x != s]
            words = [(w, f(shares[s][w], q[w])) for w in kept if count[s][w] and shares[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", words, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, i, v, r) for r, (i, v) in enumerate(ranked, 1)}
    return out


@pytest.fixture(scope="module")
def audit_rows():
    rng = random.Random(5)
    vocabulary = ["Tag", "nacht", "été", "sol", "a", "über", "don't", "x1y", "日本", "Ünder"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = [(" ".join(rng.choices(vocabulary, weights=[1 / (1 + (i + k) % 70) for i in range(len(vocabulary))], k=rng.randint(0, 60))), lang, s) for k, s in enumerate(["s1", "s2", "s3", "é", "Z"]) for lang in ("en", "de", None) for _ in range(25)]
    rows += [(None, "en", "silent"), ("", "en", None), ("hapax", "xx", "alone"), (None, "yy", "p"), ("one two", "yy", "q"), (rows[0][0], "en", "s1"), ("sol " * 30000, "en", "long")]
    rows += [("same words here", "tie", s) for s in "abc" for _ in range(10)]
    return rows + [("Copy of the hot text", "en", "hot")] * 150


@pytest.mark.parametrize("block", [divergence.BLOCK, 7])
def test_audit_equals_brute_force(spark, audit_rows, block):
    got = divergence.audit_sources(spark.createDataFrame(doc_rows(audit_rows), DOCS).repartition(6), block=block).collect()
    assert {tuple(r) for r in got} == brute_audit(audit_rows)
    assert len(got) == len({tuple(r) for r in got})


def test_audit_counts_survive_small_memory(spark, audit_rows, monkeypatch):
    """Counts passed on early add up; a document is counted once for each of its terms."""
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    rows = [(lang or "", s or "", (t or "").encode()) for t, lang, s in audit_rows]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 9])], names=["lang", "source", "text"]) for i in range(0, len(rows), 9)]
    n, docs = collections.Counter(), collections.Counter()
    for b in divergence.count_terms(iter(batches)):
        for lang, s, w, k, d in zip(*(c.to_pylist() for c in b.columns)):
            n[lang, s, w] += k
            docs[lang, s, w] += d
    assert n["en", "long", "sol"] == 30000 and docs["en", "long", "sol"] == 1 and docs["en", "hot", "copy"] == 150


def test_audit_empty_table(spark):
    assert divergence.audit_sources(spark.createDataFrame([], DOCS)).collect() == []


def test_gallop_and_shares():
    rng = np.random.default_rng(2)
    for n, m in ((0, 5), (5, 0), (3, 9000), (9000, 9000), (1500, 100_000), (1, 1)):
        a, b = (np.sort(rng.choice(200_000, k, replace=False)) for k in (n, m))
        i, j = divergence.gallop(a, b)
        assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()
    for total, terms in ((0, 1), (10**12, 10**8), (9 * 10**14, 3)):
        counts = np.array([0, min(1, total), total // 3, total])
        assert divergence.np_share(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 2 * terms) for c in counts]


# ---------------------------------------------------------------------------
# vector codes
# ---------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, part int, ids string"


def vec_rows(rows):
    return [(i, v, lab, "c", 1, 2, "k") for i, v, lab in rows]


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * fractions.Fraction(float(np.float32(x)))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    cut = lambda v: [tuple((v + [0] * (width * parts - len(v)))[p * width : (p + 1) * width]) for p in range(parts)]
    points = [cut(v) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0], kept[r][1]) if kept[r][0] is not None else (True, 0, kept[r][1]))[:entries]
    books = [[points[r][p] for r in first] for p in range(parts)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((d(x[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for x in points]
    for _ in range(rounds):
        now = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [x[p] for x, a in zip(points, now) if a[p][1] == k]
                if own:
                    books[p][k] = tuple(sum(c) // len(own) for c in zip(*own))
    now = assign()
    errors = [sum(a[0] for a in x) for x in now]
    by_label = collections.Counter()
    for e, (_, _, lab) in zip(errors, kept):
        by_label[lab] += e
    short = lambda x: x if x < 1 << 63 else None
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{a[1]:02x}" for a in x), str(short(e)), str(short(by_label[lab])), digest) for (i, _, lab), x, e in zip(kept, now, errors))


def codes(df, **more):
    return sorted((str(r.vec_id), r.code, str(r.error), str(r.label_error), r.codebooks_sha256) for r in vector_codes.compress_vectors(df, **more).collect())


def some_vectors(n, seed, width=32):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (9, width))
    rows = [(1000 + i, [float(np.float32(x)) for x in centers[i % 9] + rng.normal(0, 0.2, width)], [0, 1, 2, None][i % 4]) for i in range(n)]
    hot = rows[5][1]
    rows += [(5000 + i, hot, 7) for i in range(n // 2)]
    bad = [None, [], [None] + hot[1:], [float("nan")] + hot[1:], hot[:-1] + [float("inf")], hot[:-1] + [float("-inf")]]
    rows += [(9000 + i, v, 1) for i, v in enumerate(bad) if v != []]
    return rows + [rows[3], (1003, rows[4][1], 2), (None, rows[6][1], 1), (1, hot, 3), (2, hot, 3)]


@pytest.mark.parametrize("n,leaf", [(400, 128), (400, 6)])
def test_codes_equal_brute_force(spark, monkeypatch, n, leaf):
    monkeypatch.setattr(vector_codes, "LEAF", leaf)
    rows = some_vectors(n, n + leaf)
    assert codes(spark.createDataFrame(vec_rows(rows), VECTORS).repartition(3)) == brute_codes(rows)


def test_codes_of_odd_tables(spark):
    few = [(3, [0.5] * 20, None), (2, [], None), (9, [-0.001], 4), (4, [1.0] * 7, 4)]
    assert codes(spark.createDataFrame(vec_rows(few), VECTORS)) == brute_codes(few)
    same = [(i, [0.25] * 16, 1) for i in range(200)]
    assert codes(spark.createDataFrame(vec_rows(same), VECTORS)) == brute_codes(same)
    large = few + [(1, [3.0e38] * 16, 1), (5, [-3.0e38, 1.0], 1), (6, [2.0e6, 1.0], 1), (7, [2.0e6, 2.0], 1)]
    assert codes(spark.createDataFrame(vec_rows(large), VECTORS), entries=3) == brute_codes(large, entries=3)
    for none in ([], [(1, None, 1), (2, [float("nan")], 1)]):
        got = vector_codes.compress_vectors(spark.createDataFrame(vec_rows(none), VECTORS))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.collect() == []


def test_balls_hold_their_points_and_sums():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(0, 60, (1500, 4)), np.zeros((700, 4)), rng.normal(900, 3, (300, 4))]).astype(np.int64)
    tree = vector_codes.Tree(points, leaf=16).arrays()
    assert sorted(tree["order"].tolist()) == list(range(len(points)))
    for b, (lo, hi) in enumerate(tree["spans"]):
        own = points[tree["order"][lo:hi]]
        assert np.sqrt(((own - tree["centers"][b]) ** 2).sum(axis=1)).max() <= tree["radii"][b] * (1 + 1e-12) + 1e-9
        assert own.sum(axis=0).tolist() == tree["sums"][b].tolist()
    owned = []
    got = np.full(len(points), -1)
    entries = points[[0, 10, 10, 1600, 2300, 2400]]

    def whole(ball, e):
        rows = tree["order"][slice(*tree["spans"][ball])]
        got[rows] = e
        owned.append(len(rows))

    vector_codes.walk(tree, points, entries, whole, lambda rows, e: got.__setitem__(rows, e))
    assert got.tolist() == vector_codes.nearest(points, entries).tolist()
    assert sum(owned) > len(points) / 3  # the balls around one entry are dealt without a look at their points


# ---------------------------------------------------------------------------
# license scans
# ---------------------------------------------------------------------------

FILES = "doc_id long, text string, w string, rid long, start int, label string, template int"


def brute_scan(rows):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    files = [words(t) for _, t in rows]
    docs = collections.Counter(w for f in files for w in set(f))
    out = []
    for (d, _), f in zip(rows, files):
        places = []
        for t in [*licenses.BASE, *licenses.NOTICES]:
            rarest = sorted(range(len(t.words)), key=lambda i: (docs[t.words[i]], i))[: 1 if t.base else licenses.RAREST]
            for start in range(-len(t.words), len(f)):
                same = [0 <= start + i < len(f) and f[start + i] == w for i, w in enumerate(t.words)]
                if all(same[i] for i in t.must) and sum(same[i] for i in rarest) >= (1 if t.base else math.ceil(len(rarest) / 2)):
                    places.append((start, t.label, t.base, sum(same) / len(same)))
        based = [p for p in places if p[2]]
        lists = lambda ps: ",".join(sorted({p[1] for p in ps}))
        out.append((str(d), len(f), len(based), min((p[0] for p in based), default=None), max((p[0] for p in based), default=None), lists(based), lists(places), max((p[3] for p in places), default=0.0)))
    return sorted(out, key=str)


def scan(df):
    return sorted(((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan_licenses(df).collect()), key=str)


@pytest.fixture(scope="module")
def license_rows():
    rng = random.Random(9)
    notice = {t.label: " ".join(t.words) for t in licenses.NOTICES}
    rows = [(i, " ".join(rng.choices(["the", "gnu", "license", "public", "mit", "of", "cc", "by", "software", "0", "permission", "is"], k=rng.randint(0, 40)))) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choices(["le", "été", "sol"], k=20)) + ". " + n.title().replace(" ", rng.choice([" ", "\n * ", "; "])) + " fin") for i, n in enumerate(notice.values())]
    rows += [(200, notice["mit-notice"].replace("any person", "every person")), (201, notice["mit-notice"].replace("free of charge", "free of cost")), (202, " ".join(notice["bsd"].split()[3:])), (203, "granted, " + notice["isc"][11:])]
    rows += [(300, None), (301, ""), (302, " \n."), (303, "cc by cc by"), (303, "cc by cc by"), (None, "MIT License"), (None, None), (304, "gnu général public license"), (305, "MIT LICENSE " * 3000), (306, "mit-license apache_license GNU General Public License, version 3.")]
    return rows + [(1000 + i, "Released under the MIT license.") for i in range(80)]


def test_scan_equals_brute_force(spark, license_rows):
    df = spark.createDataFrame([(d, t, "w", 5, 1, "l", 2) for d, t in license_rows], FILES).repartition(5)
    got = scan(df)
    assert got == brute_scan(license_rows)
    assert {"gpl-3.0", "mit-notice", "bsd", "isc"} <= {x for r in got for x in r[6].split(",")}


def test_scan_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], FILES)).collect() == []


def test_scan_runs_without_python(spark, license_rows):
    """No Python, pandas or Arrow node in the plan of the result."""
    df = spark.createDataFrame([(d, t, "w", 5, 1, "l", 2) for d, t in license_rows], FILES)
    plan = licenses.scan_licenses(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------------------
# filters
# ---------------------------------------------------------------------------


def test_filters_keep_columns_of_any_name(spark):
    from riskframe.llm.exact_dedup import keep_first_copies

    df = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "y", 2), (3, "b", None, 3)], "doc_id long, text string, _drop string, rid int")
    got = keep_first_copies(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, "a", "x", 1), (3, "b", None, 3)]
