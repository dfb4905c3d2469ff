"""Pieces of the operators that need no Spark, against plain versions."""

import random
import re
import string
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonaframe.llm import covertree, decontam, knlm, licenses, neardup, packing, pages, passages, quality
from sonaframe.llm.words import WordHashes, shingles, words_of


def hashes(text, words=WordHashes()):
    return words.of(words_of(text))


def test_word_hashes_survive_a_full_memory():
    small = WordHashes(most=3)
    names = ["a", "b", "c", "d", "e", "a", "b"] * 3
    assert small.of(names).tolist() == WordHashes().of(names).tolist()
    assert small.of(["x", "a"]).tolist() == WordHashes().of(["x", "a"]).tolist()


def test_shingles_of_short_texts():
    assert len(shingles(hashes(""))) == 0
    assert len(shingles(hashes("one two"))) == 1
    assert len(shingles(hashes("a b c d e f"))) == 2
    assert shingles(hashes("a b c d e f"))[1] == shingles(hashes("b c d e f"))[0]


# near duplicates

def test_consistent_weighted_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(3)
    s = np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    a = rng.random(300).astype(np.float32) + np.float32(0.1)
    b = a.copy()
    b[:90] *= 3
    true = neardup.weighted_jaccard((s, a), (s, b))
    n = 3000
    same = np.mean(neardup.samples_of(s, a, n, 1) == neardup.samples_of(s, b, n, 1))
    assert abs(same - true) < 0.04


def test_weighted_jaccard_counts_terms():
    idf = np.ones(1 << 16, np.float32)
    x = neardup.weighted_shingles(hashes("a b c d e a b c d e"), idf)
    assert x[1].sum() == pytest.approx(6)
    assert neardup.weighted_jaccard(x, x) == pytest.approx(1.0)
    empty = neardup.weighted_shingles(hashes(""), idf)
    assert neardup.weighted_jaccard(empty, empty) == 0.0


# passages

def brute_runs(x, y, least):
    """Words of x that lie in a run of at least `least` equal words of y."""
    mark = set()
    where = {}
    for j in range(len(y) - least + 1):
        where.setdefault(tuple(y[j: j + least]), j)
    for i in range(len(x) - least + 1):
        if tuple(x[i: i + least]) in where:
            mark.update(range(i, i + least))
    return mark


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_repeats_cover_every_long_common_run(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(r.choice([3, 30, 3000]))]
    x = [r.choice(vocab) for _ in range(r.randrange(0, 160))]
    y = [r.choice(vocab) for _ in range(r.randrange(0, 160))]
    if x and r.random() < 0.8:
        a = r.randrange(len(x))
        y[r.randrange(len(y) + 1):0] = x[a: a + r.randrange(70)]
    hx, hy = hashes(" ".join(x)), hashes(" ".join(y))
    got = set()
    for a, e in passages.repeats(hx, hy, 20, 0.8):
        got.update(range(a, e))
    assert brute_runs(x, y, 20) <= got


def brute_near_copies(x, y, least, threshold):
    """Words of x in some stretch of at least `least` words whose 5-word shingles are similar to a stretch of y; both stretches begin and end alike."""
    def grams(w):
        return {tuple(w[i: i + 5]) for i in range(len(w) - 4)}

    gx, gy = [tuple(x[i: i + 5]) for i in range(len(x) - 4)], {tuple(y[i: i + 5]): i for i in range(len(y) - 4)}
    at = [(i, gy[g]) for i, g in enumerate(gx) if g in gy]  # the words of a text differ
    mark = set()
    for i, c in at:
        for j, f in at:
            if j + 5 - i >= least and f >= c:
                a, b = grams(x[i: j + 5]), grams(y[c: f + 5])
                if len(a & b) >= threshold * len(a | b):
                    mark.update(range(i, j + 5))
    return mark


def edited(r, words, rate):
    out = []
    for w in words:
        kind = r.random()
        if kind < rate / 3:
            out += [w, *(f"n{r.randrange(10 ** 12)}" for _ in range(r.randrange(1, 9)))]
        elif kind < rate:
            out += [f"n{r.randrange(10 ** 12)}"] * (kind < rate * 2 / 3)
        else:
            out.append(w)
    return out


def test_a_near_copy_next_to_edited_text_is_found():
    y = [f"w{i}" for i in range(140)]
    x = list(y)
    x[30] = "changed"
    for i in range(60, 140, 8):
        x[i] = f"edit{i}"
    assert passages.repeats(hashes(" ".join(x)), hashes(" ".join(y)), 50, 0.8)[0][0] == 0
    assert passages.repeats(hashes(" ".join(x)), hashes(" ".join(y)), 50, 0.8)[0][1] >= 60


def test_an_insertion_in_a_near_copy_is_bridged():
    y = [f"w{i}" for i in range(90)]
    x = y[:45] + [f"new{i}" for i in range(6)] + y[45:]
    assert passages.repeats(hashes(" ".join(x)), hashes(" ".join(y)), 50, 0.8) == [(0, 96)]
    assert passages.repeats(hashes(" ".join(y)), hashes(" ".join(x)), 50, 0.8) == [(0, 90)]
    # a part that repeats words which the other text has not
    assert passages.repeats(hashes("a b c d e " + "z " * 100), hashes("a b c d e f"), 50, 0.8) == []


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_repeats_are_all_near_copies(seed):
    r = random.Random(seed)
    y = [f"w{i}" for i in range(r.randrange(20, 110))]
    x = [f"a{i}" for i in range(r.randrange(30))]
    for i in range(0, len(y), 37):
        x += edited(r, y[i: i + 37], r.choice([0.01, 0.03, 0.1]))
    got = set()
    for a, e in passages.repeats(hashes(" ".join(x)), hashes(" ".join(y)), 20, 0.8):
        got.update(range(a, e))
    assert got == brute_near_copies(x, y, 20, 0.8)


def test_bands_are_the_same_wherever_a_passage_stands():
    r = random.Random(5)
    p = [f"p{i}" for i in range(50)]
    a = [f"a{r.random()}" for _ in range(80)] + p + [f"b{r.random()}" for _ in range(30)]
    b = [f"c{r.random()}" for _ in range(17)] + p
    va, vb = passages.bands(shingles(hashes(" ".join(a))))[0], passages.bands(shingles(hashes(" ".join(b))))[0]
    assert set(va.tolist()) & set(vb.tolist())


def test_without_spans_closes_up():
    text, n = passages.without_spans("One two, three four! Five six.", [(2, 3)])
    assert (text, n) == ("One two, Five six.", 2)
    assert passages.without_spans("One two.", [(0, 1)]) == ("", 2)
    assert passages.without_spans("a b c d", [(0, 1), (1, 2)]) == ("d", 3)
    assert passages.without_spans("İ b c", [(1, 1)])[0] in ("İ c",)


# decontamination

def test_windows_hold_every_item_that_stands_in_a_text():
    r = random.Random(1)
    for n in [5, 6, 9, 10, 17, 18, 33, 40, 65, 90, 200]:
        item = " ".join(f"i{n}x{j}" for j in range(n))
        s = np.unique(shingles(hashes(item)))
        for at in (0, 1, 2, 3, 57):
            doc = " ".join(f"d{r.random()}" for _ in range(at)) + " " + item + " " + " ".join(f"e{r.random()}" for _ in range(300))
            v = decontam.window_values(shingles(hashes(doc)), [decontam.window_of(len(s))], 16)
            assert set(decontam.item_values(s, 16).tolist()) & set(v.tolist()), (n, at)


# packing

def test_encoder_libraries_agree():
    enc = packing.encoder(packing.default_tokenizer())
    texts = ["Hello, wörld!  \n\n 123 don't", "日本語 текст  x", "", " ", "a<|endoftext|>b", string.printable]
    for t in texts:
        assert enc.ids(t).tolist() == enc.full.encode(t, add_special_tokens=False).ids


def plain_cost(places, costs, window):
    best = [0] + [10 ** 9] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            size = int(places[j] - places[i])
            if size <= window:
                pad = 0 if size & (size - 1) == 0 else window - size
                best[j] = min(best[j], best[i] + pad + packing.SEQUENCE_COST + int(costs[j]))
    return best[-1]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_best_cuts_cost_as_little_as_trying_all(seed):
    r = random.Random(seed)
    places = np.cumsum([0] + [r.randrange(1, 20) for _ in range(r.randrange(1, 60))])
    costs = np.array([0] + [r.choice([0, 4, 48]) for _ in places[1:]])
    cuts = packing.best_cuts(places, costs, 32)
    got = 0
    where = {int(p): int(c) for p, c in zip(places, costs)}
    for a, e in zip(cuts, cuts[1:]):
        size = e - a
        assert 0 < size <= 32
        got += (0 if size & (size - 1) == 0 else 32 - size) + packing.SEQUENCE_COST + where[e]
    assert cuts[0] == 0 and cuts[-1] == places[-1]
    assert got == plain_cost(places, costs, 32)


def test_a_text_without_sentence_ends_can_be_cut():
    enc = packing.encoder(packing.default_tokenizer())
    ids = np.append(enc.ids("word " * 9000), np.uint32(1))
    places, costs = packing.cut_places(ids, np.array([len(ids)]), enc, 2048)
    cuts = packing.best_cuts(places, costs, 2048)
    assert max(np.diff(cuts)) <= 2048 and cuts[-1] == len(ids)


# language model

def test_pressed_arrays_round_trip():
    for a in (np.zeros(0, np.uint32), np.arange(5, dtype=np.uint64), np.array([7, 7, 1 << 40], np.uint64)):
        assert knlm._opened(knlm._pressed(a), a.dtype).tolist() == a.tolist()
        assert knlm._sorted_opened(knlm._sorted_pressed(a.astype(np.uint64))).tolist() == a.tolist()


# licences

def test_grams_fit_their_packing():
    words, rows = licenses.template_grams()
    assert max(words.values()) < 1 << 20
    assert all(r[3] >= 2 for r in rows)


# classifier

def test_scores_vote_for_the_nearest_labels():
    good, bad = "The cat sat on the mat. It was warm.", "BUY!! NOW!! $$$ ### CHEAP!!"
    slots = quality.TokenSlots()
    x = np.stack([slots.counts(good + f" {i}") for i in range(8)] + [slots.counts(bad + f" {i}") for i in range(8)])
    idf = np.ones(quality.SLOTS, np.float32)
    w = quality.weighted(x.copy(), idf)
    axes = quality._axes(w, 8, 1)
    z = w @ axes
    z /= np.sqrt((z * z).sum(1, keepdims=True))
    m = quality.QualityModel(idf, axes, z, np.array([1.0] * 8 + [0.0] * 8), 5, 4.0, 0.5)
    s = m.scores(np.stack([slots.counts("The dog sat on the rug. It was cold."), slots.counts("SELL!! ### $$$ NOW!!"), slots.counts(""), slots.counts(None)]))
    assert s[0] > 0.9 and s[1] < 0.1 and s[2] == s[3] == 0.5


# vectors

def brute_top(q, r, k):
    out = []
    for row, x in zip(q.rows, q.x):
        s = sorted((-int(x @ y), int(i)) for rr, i, y in zip(r.rows, r.ids, r.x) if rr != row)
        out.append([(i, -v) for v, i in s[:k]])
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000))
def test_dual_search_equals_brute_force(seed):
    g = np.random.default_rng(seed)
    n, dim, k = int(g.integers(1, 120)), int(g.integers(1, 6)), int(g.integers(1, 8))
    x = g.integers(-6, 7, (n, dim))
    if g.random() < 0.5:
        x[g.integers(0, n, n // 2)] = x[0]
    ids = g.permutation(n)
    r = covertree.build_tree(np.arange(n), ids, x, leaf=4)
    some = np.flatnonzero(g.random(n) < 0.4)
    q = covertree.build_tree(some, ids[some], x[some], leaf=3)
    where, score, real = covertree.dual_search(q, r, k, np.full(len(q.x), np.iinfo(np.int64).min + 1))
    got = [[(int(r.ids[w]), int(s)) for w, s, f in zip(where[i], score[i], real[i]) if f] for i in range(len(q.x))]
    assert got == brute_top(q, r, k)


def test_cover_tree_covers():
    g = np.random.default_rng(2)
    x = g.integers(-50, 50, (400, 5))
    t = covertree.build_tree(np.arange(400), np.arange(400), x, leaf=8)

    def points(node):
        return list(range(t.start[node], t.end[node])) if not t.children[node] else [p for c in t.children[node] for p in points(c)]

    assert sorted(points(0)) == list(range(400))
    for node in range(len(t.radius)):
        d = np.sqrt(((t.x[points(node)] - t.centre[node]) ** 2).sum(1))
        assert d.max() <= t.radius[node]


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no";</script></head>
<body class="page"><header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies</div><form><label>Search</label><input value="x"></form>
<article><header><h1>Title &amp; more</h1></header><p>First&nbsp;  line<br>goes
on <b>bold</b>&#33;<p>Second &lt;b&gt; line.</p><ul><li>item</li></ul>
<section class="comments"><article class="comment"><p>Reader says</p></article></section></article>
<aside>Side</aside><div id="sidebar">Bar</div><footer>&copy; me</footer></body></html>"""


def test_page_lines():
    assert pages.kept_lines(pages.page_lines(PAGE), set()) == ["Title & more", "First line goes on bold!", "Second <b> line.", "item"]
    assert pages.page_lines(None) == [] and pages.page_lines("") == []
    assert [x[0] for x in pages.page_lines("plain text")] == ["plain text"]
    assert pages.kept_lines(pages.page_lines("<div>one</div><p>two"), set()) == ["one", "two"]
    assert pages.kept_lines(pages.page_lines("<p>a</p><script>never closed <p>b"), set()) == ["a"]
    assert pages.kept_lines(pages.page_lines('<form id="aspnetForm"><div><article><p>text</p></article></div></form>'), set()) == ["text"]


def test_page_lines_on_broken_markup_are_linear():
    assert pages.page_lines("<a b='" * 20_000) is not None
    assert pages.page_lines("<" * 50_000) is not None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25))
def test_common_lines_is_a_longest_common_subsequence(x, y):
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    got = pages.common_lines(x, y)
    assert len(got) == table[-1][-1]
    assert all(x[i] == y[j] for i, j in got)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))


def test_held_out_is_the_checksum_of_the_id():
    assert knlm.held_out(None, 7, 2) is False
    assert [knlm.held_out(i, 7, 2) for i in range(50)] == [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(50)]
    assert re.fullmatch(r"[^\x20\x09-\x0D]+", "x")


def test_hashes_of_a_text_are_those_of_its_words():
    r = random.Random(9)
    w = WordHashes()
    pools = ["abcXYZ 019_ .-", "éÀÿßµª²¼ AB,\xa0\x85", "漢字кирΣς 𝒳‍_é́ x", "İı ſK1"]
    for n in (0, 1, 2, 7, 300, 70_000):
        for pool in pools:
            t = "".join(r.choice(pool) for _ in range(n))
            assert (w.text(t) == w.of(words_of(t))).all() and len(w.text(t)) == len(words_of(t))
    long = "x" * 100_000 + " y " + "é" * 40_000 + "z漢" * 50_000
    assert (w.text(long) == w.of(words_of(long))).all() and (w.text(long[:140_003]) == w.of(words_of(long[:140_003]))).all()
    many = [f"w{i}" for i in range(200_000)]
    assert len(np.unique(w.text(" ".join(many)))) == len(many) and w.text(None).tolist() == []


def test_letters_whose_lower_case_is_longer_shift_nothing():
    html = "<p>İstanbul İzmir İİİİ</p><SCRIPT>var x = '<p>no</p>';</Script><p>End İ</p><style>p { }</STYLE><p>Last</p>"
    assert [x[0] for x in pages.page_lines(html)] == ["İstanbul İzmir İİİİ", "End İ", "Last"]
