"""Packing, language model, quality, toxicity, personal data and HTML extraction against brute force and held-out rows."""

import collections
import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
import regex
import xxhash

from riskframe.llm import html_extract, lm, packing, pii, quality, toxicity
from riskframe.llm.common import table
from riskframe.llm.queries import tokenizer_json

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
AWKWARD = [
    (1, "The cat's mat, it's 12 o'clock!! ÉTÉ été Straße ñandú"), (2, None), (3, ""), (4, " \t\n"), (5, "<|endoftext|> inside <|startoftext|>x"),
    (6, "a b c\u0085d \x1cq\x1e"), (7, "été İstanbul ΟΔΥΣΣΕΥΣ 中文字 🙂🙂"), (8, "word " * 9000), (1, "repeated id"), (None, "no id"), (None, None), (9, "ﬁ ½ ² ٣"),
]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, ids string, score int")


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    rows = AWKWARD + [(100 + i, " ".join("".join(rng.choice("aeinorst'.") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 300)))) for i in range(60)]
    tok = Tokenizer.from_str(tokenizer_json())
    want = collections.Counter()
    for d, t in rows:
        want[d, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])] += 1
    got = [(r.doc_id, r.start, np.frombuffer(bytes(r.ids), "<u4"), r.length, r.doc_tokens, r.sequence_id, r.offset) for r in packing.pack(frame(spark, rows), tokenizer_json()).collect()]
    row, docs, at = [], collections.Counter(), 0
    for d, start, ids, n, total, seq, off in sorted(got, key=lambda g: (g[5], g[6])):
        assert seq * 4096 + off == at and n == len(ids) and off + n <= 4096
        at += n
        assert start == len(row)
        row += ids.tolist()
        if len(row) == total:
            docs[d, tuple(row)] += 1
            row = []
    assert docs == want and not row
    crc = packing.with_crc(packing.pack(frame(spark, [(1, "one two")]), tokenizer_json())).first()
    assert crc.ids_crc32 == zlib.crc32(np.array(tok.encode("one two", add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert packing.pack(frame(spark, rows).limit(0), tokenizer_json()).count() == 0


def test_plain_split_equals_the_files_split():
    rng, plain = random.Random(5), [c for c in map(chr, range(0x21, 0x250)) if packing.WordTokenizer.PLAIN.fullmatch(c)]
    parts = plain + ["".join(rng.choices(plain, k=rng.randint(2, 8))) + rng.choice(["", "'s", "'LL9", "''"]) for _ in range(3000)]
    whole, mine = regex.compile(packing.WordTokenizer.SPLIT), packing.plain_split(packing.WordTokenizer.SPLIT)
    for low in map(str.lower, parts):
        assert mine.findall(low) == whole.findall(low), low


def test_seen_words_stay_bounded_and_right(monkeypatch):
    monkeypatch.setattr(packing.WordTokenizer, "KEEP", 20)
    mine = packing.WordTokenizer(tokenizer_json())
    texts, asked = [" ".join(f"word{i}\u00e9x{j}" for j in range(30)) + " the" for i in range(4)], []
    whole = mine.full
    find, mine._ids = mine._ids, lambda part: asked.append(part) or find(part)
    for text in texts:
        assert list(np.frombuffer(mine.encode(text), "<u4")) == whole.encode(text, add_special_tokens=False).ids
        assert len(mine.seen) <= 20 and len(mine.old) <= 20
    mine.seen.clear(), mine.old.clear(), asked.clear()
    mine.encode("a b a " * 3)
    assert asked == ["a", "b"], "a word is asked for once, in its own text too"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_tokenizer_equals_the_file(name):
    from tokenizers import Tokenizer

    text = tokenizer_json(name)
    mine, full = packing.WordTokenizer(text), Tokenizer.from_str(text)
    assert mine.fast == (name == "word_bpe_49k.json")
    mine.KEEP = 3
    if mine.fast:
        for _, t in AWKWARD:
            assert np.frombuffer(mine.encode(t or ""), "<u4").tolist() == full.encode(t or "", add_special_tokens=False).ids


def corpus(n=150):
    rng = random.Random(8)
    words = ["".join(rng.choice(["th", "en", "er", "on", "ing"]) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    out, w = [], 0
    for i in range(n):
        t = []
        for _ in range(rng.randint(1, 80)):
            w = (w * 7 + rng.randint(0, 3)) % 60
            t.append(words[w])
        out.append((i, " ".join(t).title()))
    return out


def test_language_model(spark):
    rows = corpus() + [(1000, None), (1001, ""), (1002, "Never seen words"), (None, "no id"), (None, "no id"), (5, "again")]
    toks = [re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW)) + [None] for _, t in rows]
    fold = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 for d, _ in rows]
    uni, bi, dev1, dev2 = (collections.Counter() for _ in range(4))
    for w, f in zip(toks, fold):
        if f != 2:
            uni.update(w)
            bi.update(zip([None, *w[:-1]], w))
        if f == 3:
            dev1.update(w)
            dev2.update(zip([None, *w[:-1]], w))
    n, v = sum(uni.values()), len(uni)
    n_rest = n - sum(dev1.values())
    # EM without quantisation, bucket by bucket
    events = collections.defaultdict(list)
    for w, f in zip(toks, fold):
        if f == 3:
            for a, b in zip([None, *w[:-1]], w):
                c = uni[a] - dev1[a]
                two = (bi[a, b] - dev2[a, b]) / c if c else 0
                events[min(math.frexp(c)[1], 23)].append((1 / (v + 1), (uni[b] - dev1[b]) / n_rest, two))
    pooled = np.array([e for b in events.values() for e in b])

    def em(r, w):
        for _ in range(400):
            post = r * w
            w = (post / post.sum(axis=1)[:, None]).mean(axis=0)
        w = np.maximum(w, [1e-6, 1e-6, 0])
        return w / w.sum()

    mix = {b: em(np.array(r), np.array([0.2, 0.8, 0] if b == 0 else [0.1, 0.4, 0.5])) for b, r in events.items()}
    rest = em(pooled, np.array([0.1, 0.4, 0.5]))
    want = []
    for (d, _), w, f in zip(rows, toks, fold):
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, b in zip([None, *w[:-1]], w):
            c = uni[a]
            m = mix.get(min(math.frexp(c)[1], 23), rest if c else np.array([0.2, 0.8, 0]))
            score += math.log10(m[0] / (v + 1) + m[1] * uni[b] / n + m[2] * (bi[a, b] / c if c else 0))
        want.append((str(d), f == 2, len(w), sum(uni[x] > 0 for x in w), n, round(base, 6), score))
    for block in (1 << 20, 300):  # one block, and many
        got = lm.score_texts(frame(spark, rows), block_tokens=block, range_bytes=1 << 10).collect()
        got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in got)
        assert [g[:6] for g in got] == [w[:6] for w in sorted(want)]
        assert [g[6] for g in got] == pytest.approx([w[6] for w in sorted(want)], rel=0.02)
        held = [g for g in got if g[1]]
        assert sum(g[6] for g in held) > sum(g[5] for g in held)
    assert lm.score_texts(frame(spark, rows).limit(0)).count() == 0


def test_mixture_weights_form_a_distribution():
    w = lm.learn_weights([(3, 10, 4, 50), (3, lm.ABSENT, 2, 50), (0, lm.ABSENT, 3, 10), (7, 12, lm.ABSENT, 5)])
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all() and w[0, 2] == 0


SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.score_quality(docs, labels).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count()
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert held and sum(g.predicted == q for g, q in held) / len(held) > 0.93
    assert all(g.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= g.score <= 1 and g.predicted == (g.score >= 0.7) for d, g in got.items())


def test_quality_edges(spark):
    docs = frame(spark, AWKWARD)
    some = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, 1, 1), (8, None, None), (None, 1, 1), (9, 7, 7)], "doc_id long, quality int, toxic int")
    for labels in (some, some.limit(0)):
        assert quality.score_quality(docs, labels).where("score between 0 and 1").count() == len(AWKWARD)
        assert toxicity.score_toxicity(docs, labels).where("score between 0 and 1").count() == len(AWKWARD)
    assert quality.score_quality(docs.limit(0), some).count() == toxicity.score_toxicity(docs.limit(0), some).count() == 0
    assert quality.drop_rejected(docs, some).columns == docs.columns
    whole = "some very plain text " * 3000
    assert not np.allclose(quality.features(whole), quality.features(whole + "### $$$ " * 3000))  # not a prefix


def test_quality_votes_are_exact_nearest_neighbours():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    model = quality.LatentNeighbours(np.ones(8, np.float32), np.zeros(8, np.float32), np.eye(8, dtype=np.float32), v, rng.integers(0, 2, 50).astype(float), 0.5, 5)
    rows = rng.normal(size=(20, 8)).astype(np.float32)
    for row, s in zip(rows, model.score(rows)):
        cos = v @ (row / np.linalg.norm(row))
        near = np.argsort(-cos)[:5]
        w = np.clip(cos[near], 0, None).astype(float) ** 4
        assert s == pytest.approx((w * model.labels[near]).sum() / w.sum(), abs=1e-4)


def test_quality_ties_all_vote():
    """Eight labelled copies are equally near: their labels count alike, whatever the batch or their order."""
    rng = np.random.default_rng(2)
    v = np.concatenate([np.tile(np.eye(8, dtype=np.float32)[0], (8, 1)), np.eye(8, dtype=np.float32)[1:]])
    y = np.array([1.0, 0, 1, 1, 0, 1, 1, 1] + [0.0] * 7)
    row = np.array([[1, 0.2, 0, 0, 0, 0, 0, 0]], dtype=np.float32)
    for _ in range(5):
        p = rng.permutation(len(v))
        model = quality.LatentNeighbours(np.ones(8, np.float32), np.zeros(8, np.float32), np.eye(8, dtype=np.float32), v[p], y[p], 0.5, 3)
        assert model.score(row)[0] == pytest.approx(6 / 8)
        assert model.score(np.repeat(row, 50, axis=0)).tolist() == [model.score(row)[0]] * 50


def test_toxicity_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [(got[r.doc_id].toxic, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    caught = sum(t for t, y in held if y) / sum(y for _, y in held)
    false = sum(t for t, y in held if not y) / sum(1 - y for _, y in held)
    assert caught > 0.7 and false < 0.01, (caught, false)  # about one label in six has no toxic word at all


def test_chain_uses_earlier_categories():
    rng = random.Random(6)
    rows = []
    for _ in range(400):
        a, b = rng.random() < 0.3, rng.random() < 0.3
        rows.append((rng.randrange(4), int(a or b), [c for c, on in ((0, a), (1, b), (2, rng.random() < 0.5)) if on], [int(a), int(b)]))
    chain = toxicity.fit_chain(rows, {"a": 0, "b": 1, "c": 2}, (1.0, 1.0))
    assert [len(w) for w in chain.weights] == [4, 5, 6]
    p = chain.predict(chain.matrix([{0}, {1}, {2}, set()]))
    assert p.shape == (4, 3) and p[0, 0] > 0.5 > p[1, 0] and p[1, 1] > 0.5 > p[0, 1] and (p[:2, 2] > 0.5).all() and (p[2:, 2] < 0.5).all()


def brute_spans(t):
    t = t or ""
    ok = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(s[::-1])) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and ok(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]


def test_base_spans_random():
    rng = random.Random(12)
    bits = ["a", "@", ".", "@b.c", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "-", " ", "+", "(", ")", "555", "12", "é", "%", "a@b@c.d-e", "+1 (974) 555-3436", "²", "\n"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_personal_data(spark):
    rows = AWKWARD + [(20, "é mail x@y.example.com, call +1 (974) 555-3436 or (212) 555-0199"), (21, "write to jane at corp dot org now"), (22, "9" * 5000 + ".1.1.1"), (23, "lorem ipsum at noon, 3 of 12")]
    got = pii.find_personal_data(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for d, t in rows:
        if d in (None, 1):
            continue
        if d != 22:
            base = brute_spans(t)
            assert by[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
            assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(by[d].spans.split(",")) | {""}
    assert "email" in by[21].spans and by[23].spans == "" and by[8].spans == ""
    assert by[20].spans.count("phone") == 2
    assert pii.redact("call +1 (974) 555-3436 now", "phone:5:22") == "call [phone] now"
    assert pii.find_personal_data(frame(spark, rows).limit(0)).count() == 0


def test_viterbi_is_the_best_path():
    import itertools

    field = pii.train(rounds=30)
    _, s = pii._encode("call 974-555 at 9")
    best = field.decode(s[None, :], np.array([len(s)]))[0]
    e = field.scores(s[None, :])[0]

    def value(path):
        return field.first[path[0]] + sum(e[i, y] for i, y in enumerate(path)) + sum(field.move[a, b] for a, b in zip(path, path[1:]))

    assert value(best) == pytest.approx(max(value(p) for p in itertools.product(range(5), repeat=len(s))), abs=1e-3)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head &amp; tail</h1><p>by someone</p></header><p>One  <b>two</b>
three<br>four &eacute;<p>Second &lt;b&gt;<ul><li>item 1<li>item 2</ul><div class="ad">Buy</div><form><input name=q>Find</form><!-- no --><blockquote>Quote</blockquote></article>
<section id="comments"><article><p>First!</p></article></section><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_html_blocks(spark):
    main, other, settled = html_extract.blocks(PAGE)
    assert settled and main == ["Head & tail", "One two three four é", "Second <b>", "item 1", "item 2", "Quote"]
    assert other == []
    rows = [(1, "http://a.org/x/1", PAGE), (2, None, None), (3, "http://a.org/x/2", ""), (4, "http://b.org/n/1?q=1", "<p>Menu line<p>Own text one<p>Shared tail"), (5, "http://b.org/n/2#top", "<p>Menu line<p>Other words<p>Shared tail"),
            (6, "http://c.org/lone", "<p>alone"), (7, "http://c.net", "<p>cut &am"), (4, "http://b.org/n/1?q=1", "<p>Menu line<p>Own text one<p>Shared tail"), (None, "http://d.org", PAGE), (8, "x", "<article><p>half<script>if (a<b)")]
    df = spark.createDataFrame([(a, b, c, "z") for a, b, c in rows], "page_id long, url string, html string, text string")
    got = html_extract.extract_text(df).collect()
    text = "\n".join(main)
    want = [(1, text), (2, ""), (3, ""), (4, "Own text one"), (4, "Own text one"), (5, "Other words"), (6, "alone"), (7, "cut &am"), (8, "half"), (None, text)]
    assert sorted(((r.page_id or 99, r.text, r.n_chars) for r in got)) == sorted((p or 99, t, len(t)) for p, t in want)
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_html_hints_spare_the_article():
    """Class names that only contain a hint, hints on an article and hints around it lose nothing; whole names still drop."""
    body = "<article class='%s'><h1>Title</h1><p>Text</article>"
    plain = body % "post"
    for page in (
        f"<div class='content no-sidebar'>{plain}</div>", f"<div id='page' class='has-header'>{plain}</div>", body % "post tag-social", body % "social",
        f"<div class='sidebar'><div class='widget'>{plain}</div></div>", "<div class='widget'><main role='main'><h1>Title</h1><p>Text</main></div>",
        f"<section class='comment-list'><article class='comment'><p>First!</article></section>{plain}", f"{plain}<div class='ad'>Buy</div>",
        f"<div class='site-header'>Menu</div><ul id='sidebarLeft'><li>Side</ul>{plain}<div class='related-posts'><article><p>Card</article></div>",
        f"<div class='overlay'><main>{plain}</main></div><section id='comments'><article><p>First!</article></section>",
    ):
        assert html_extract.blocks(page) == (["Title", "Text"], [], True), page


def test_html_copies_without_an_article(spark):
    """Copies under other URLs and a paragraph that one neighbour shares stay; the template goes."""
    page = lambda *own: "<p>Menu line<p>" + "<p>".join(own) + "<p>Shared tail"
    one, two = ("Text of its own " * 9).strip(), ("Other words here " * 9).strip()
    rows = [(1, "http://a.org/x?ref=a", page(one)), (2, "http://a.org/x?ref=b", page(one)), (3, "http://a.org/mirror", page(one)), (4, "http://a.org/y", page(two)),
            (5, "http://b.org/only?ref=a", page(one)), (6, "http://b.org/only?ref=b", page(one)), (7, "http://c.org/1", page(one, "Views: 10")), (8, "http://c.org/2", page(one, "Views: 7")),
            (11, "http://d.org/1", page("Alpha " * 9, "Both")), (12, "http://d.org/2", page("Beta " * 9, "Both")), (13, "http://d.org/3", page("Gamma " * 9)), (14, "http://d.org/4", "")]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = f"Menu line\n{one}\nShared tail"
    assert got == {
        1: one, 2: one, 3: one, 4: two, 5: whole, 6: whole, 7: f"Menu line\n{one}\nViews: 10\nShared tail", 8: f"Menu line\n{one}\nViews: 7\nShared tail",
        11: ("Alpha " * 9).strip() + "\nBoth", 12: ("Beta " * 9).strip() + "\nBoth", 13: ("Gamma " * 9).strip(), 14: "",
    }


def test_html_differencing_of_articles(spark):
    """Articles are differenced too: a line that all neighbours have goes, a shared article or paragraph and a lone page stay."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    page = lambda *own: "<nav>Menu</nav><article><p>" + "<p>".join([*own, "Join our list"]) + "</article>"
    own = [f"{w} " * 20 for w in words]
    rows = [(i, f"http://a.org/{i}", page(x)) for i, x in enumerate(own[:6])]
    rows += [(10 + i, f"http://b.org/{i}", f"<article><p>{x}<p>Told twice</article>" if i < 3 else f"<article><p>{x}</article>") for i, x in enumerate(own)]
    rows += [(20 + i, f"http://c.org/{i}", page(own[0])) for i in range(5)] + [(30, "http://d.org/", page(own[0]))]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(1, 5)] == [x.strip() for x in own[1:5]]
    assert [got[10 + i] for i in range(8)] == [x.strip() + ("\nTold twice" if i < 3 else "") for i, x in enumerate(own)]
    assert all(got[i] == own[0].strip() + "\nJoin our list" for i in (*range(20, 25), 30))


def test_long_stretch_is_decoded_whole():
    """An added span is found wherever it lies in a stretch of more than 4,096 words."""
    model, phrase = pii.train(), "reach me at john dot smith at example dot com today"
    short = pii.added_spans([phrase], [[]], model)[0]
    assert short
    for words in range(4076, 4100, 2):
        lead = "line 5 " * (words // 2) + ". "
        text = lead + phrase + " line 5" * 50
        got = pii.added_spans([text], [pii.base_spans(text)], model)[0]
        assert {(k, a - len(lead), b - len(lead)) for k, a, b in got} >= set(short), words


def test_windowed_decoding_equals_one_piece():
    """The labels do not depend on how many words' emission scores are held at a time."""
    rng, model = np.random.default_rng(3), pii.train(rounds=30)
    shapes, lengths = rng.integers(0, pii.N_SHAPES, (4, 300)), np.array([300, 211, 64, 1])
    whole = model.decode(shapes, lengths, window=300)
    assert whole.any()
    for window in (1, 7, 64, 299):
        assert (model.decode(shapes, lengths, window=window) == whole).all(), window


def test_covered_is_any_overlap():
    rng = random.Random(21)
    for _ in range(300):
        spans = [("x", a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(6)))]
        asked = [(a, a + rng.randint(1, 5)) for a in range(60)]
        got = pii.Covered(spans).touched(*(np.array(x) for x in zip(*asked)))
        assert got.tolist() == [any(s < b and a < e for _, s, e in spans) for a, b in asked]


def test_long_text_of_many_spans():
    """Spelled-out addresses among thousands of base spans in one text: each is found, and none touches a base span."""
    phrase = "reach me at john dot smith at example dot com today"
    text = " ".join(f"user{i}@example.com wrote . . . {phrase}" for i in range(1500))
    base = pii.base_spans(text)
    assert len(base) == 1500
    found = pii.added_spans([text], [base], pii.train())[0]
    assert len({a // (len(text) // 1500 + 1) for _, a, _ in found}) > 1400
    taken = pii.Covered(base)
    assert not taken.touched(*(np.array(x) for x in zip(*((a, b) for _, a, b in found)))).any()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_repeated_label_ids_fit_the_same_model(spark, module):
    """Many texts under one labelled id are one fitted row, whatever the order they arrive in."""
    rows = [(d, f"{'vile awful idiot' if d % 2 else 'calm and clear prose'} number {d} text {r}", d % 2) for d in range(60) for r in range(6)]
    labels = spark.createDataFrame([(d, d % 2, d % 2) for d in range(60)], "doc_id long, quality int, toxic int")
    seen = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(d, t) for d, t, _ in order], "doc_id long, text string").repartition(5)
        model = module.fit(docs, labels)
        seen.append(model.labels.tolist() if module is quality else [w.round(9).tolist() for w in model.weights])
    assert seen[0] == seen[1]
    if module is quality:
        assert len(seen[0]) == sum(zlib.crc32(str(d).encode()) % 4 != 2 for d in range(60))


def test_bigram_hashes_are_kept_whole(spark, monkeypatch):
    seen = []
    real = lm._count_blocks
    monkeypatch.setattr(lm, "_count_blocks", lambda rows, ranges, block, bits: seen.append(bits) or real(rows, ranges, block, bits))
    lm.score_texts(spark.createDataFrame([(i, "one two three four") for i in range(20)], "doc_id long, text string")).collect()
    assert seen == [62]


def test_bigrams_with_one_shortened_hash_are_counted_apart(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randint(0, 59)}" for _ in range(150))) for i in range(40)]
    numbers = [[int(w[1:]) + 1 for w in t.split()] + [0] for _, t in rows]
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in ["", *(f"w{i}" for i in range(60))]], dtype=np.uint64)
    sizes = np.array([len(x) for x in numbers])
    flat = np.array(sum(numbers, []), dtype=np.uint32)
    bigrams = len({pair for x in numbers for pair in zip([0, *x], x)})
    keys = {bits: len(lm._sorted_keys(flat, np.cumsum(sizes) - sizes, hashes, bits)[0]) for bits in (10, 62)}
    assert keys[62] == 61 + bigrams > keys[10], "at ten bits some bigrams meet, at 62 none does"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {}
    for bits in (62, 50, 10):
        monkeypatch.setattr(lm, "KEY_BITS", bits)
        scores[bits] = [r.score for r in lm.score_texts(docs, block_tokens=1000).orderBy("doc_id").collect()]
    assert scores[62] == scores[50] != scores[10]


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (["".join(rng.choice("abcd")) for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = sorted(html_extract.common_lines(a, b))
        assert len(got) == best[-1][-1]
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_html_pages_of_the_table(spark):
    pages = table(spark, SF, "pages")
    got = {r.page_id: r.text for r in html_extract.extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*?)(</article>|$)", r.html, re.DOTALL).group(1)
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split("</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_pipeline_stages(spark):
    import corpus_pipeline as C
    from riskframe.llm import decontam, exact_dedup, simhash

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    labels, bench = (table(spark, "/root/testdata/sf0.001", t) for t in ("labels", "benchmark"))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert [n for n, _ in C.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    good = {r.doc_id for r in quality.score_quality(docs, labels).collect() if r.predicted == 1}
    a = C.quality_filter(spark, docs, "/root/testdata/sf0.001")
    assert a.columns == docs.columns and ids(a) == good
    b = C.exact_copies(spark, a, "/root/testdata/sf0.001")
    assert ids(b) == {r.keep_id for r in exact_dedup.exact_dedup(a).collect()}
    c = C.near_copies(spark, b, "/root/testdata/sf0.001")
    assert ids(c) == {r.component_id for r in simhash.simhash_groups(b).collect()}
    d = C.benchmark_free(spark, c, "/root/testdata/sf0.001")
    assert ids(d) == {r.doc_id for r in decontam.decontaminate(c, bench).collect() if not r.contaminated}
    assert ids(C.run(spark, "/root/testdata/sf0.001")) == ids(d)
