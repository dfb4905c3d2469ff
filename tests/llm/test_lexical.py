"""Ranked lexical search against brute force, with edge rows."""

import collections
import math
import random
import re

import numpy as np

from sonaframe.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, term string, shard int, rank int, score double, item long"
ITEMS = "item_id long, text string, doc_id long, rank int, score double"


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text)) if text else []


def brute(docs, items, k):
    bags = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs if i is not None and terms(t)]
    n_docs, tokens = len(bags), sum(b[2] for b in bags)
    df = collections.Counter(t for b in bags for t in b[1])
    out = []
    for item, text in items:
        scored = []
        for i, bag, n in bags:
            m = 10 + (90 * n * n_docs) // tokens
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if t in bag)
            if s > 0:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_terms_are_the_same_in_bytes_and_characters():
    for text in ("Ab1 ÀÉ x_y-z", "tab\tÀb\x7f\x80c", "漢字 ﬁ 𝒳y", "", None, "İ K ſ"):
        assert [t.decode() for t in lexical.terms_of(text)] == terms(text)
        assert lexical.count_terms((text or "").encode()) == len(terms(text))


def test_lists_round_trip():
    r = np.random.default_rng(1)
    key = np.unique(np.concatenate([r.integers(0, 40 * 100_000, 20_000), np.arange(3_000_000, 3_000_700)]))
    term, doc = np.divmod(key, 100_000)
    impact = r.integers(0, 1 << r.integers(1, 20, len(key)))
    names, size, first, head, start, payload = lexical.build_lists(term, doc, impact)
    assert size.sum() == len(key)
    for i, t in enumerate(names):
        one = lexical.PostingList(head[first[i]: first[i + 1]].tobytes(), payload[start[i]: start[i + 1]].tobytes(), 3)
        d, s = one.span(0, 100_000)
        mine = term == t
        assert (d == doc[mine]).all() and (s == 3 * impact[mine]).all() and one.bound == 3 * impact[mine].max()
        d, _ = one.span(500, 70_000)
        assert (d == doc[mine & (doc >= 500) & (doc < 70_000)]).all()


def test_search_rejects_blocks_and_stays_exact(monkeypatch):
    r = np.random.default_rng(2)
    opened, held = 0, 0
    for _ in range(12):
        n, lists, full = 5000, [], np.zeros(5000, np.int64)
        for share, weight in ((0.9, 1), (0.5, 2), (0.1, 9), (0.01, 40), (0.002, 70)):
            doc = np.flatnonzero(r.random(n) < share)
            impact = r.integers(1, 50, len(doc)) * np.where(doc % 512 < 64, 4, 1)
            _, _, first, head, start, payload = lexical.build_lists(np.zeros(len(doc), np.int64), doc, impact)
            lists.append(lexical.PostingList(head.tobytes(), payload.tobytes(), weight))
            full[doc] += impact * weight
        d, s = lexical.search(lists, n, 10, span=256)
        want = np.lexsort((np.arange(n), -full))[:10]
        assert (d == want).all() and (s == full[want]).all()
        opened += sum(len(x.cache) for x in lists)
        held += sum(len(x.head) for x in lists)
    assert opened < 0.8 * held


def test_ranked_documents_equal_brute_force(spark):
    r = random.Random(7)
    word = lambda: r.choice("ABcdéf漢") + str(int(r.expovariate(0.2)))
    docs = [(i, " ".join(word() for _ in range(r.choice((1, 5, 30, 200))))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "!? -"), (None, "A1 A2"), (403, "rare " * 50_000), docs[5], docs[5], (5, "other A1 text"), (404, "Rare-only_one")]
    items = [(i, " ".join(word() for _ in range(r.randrange(1, 25)))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "nowhere"), (33, "rare A1 a1"), (None, "A2 c3"), items[0]]
    d = spark.createDataFrame([(i, t, "x", "y", 1, 2, 0.5, 3) for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, 1, 2, 0.5) for i, t in items], ITEMS)
    plain = lambda rows: sorted(rows, key=lambda x: tuple((v is None, v) for v in x))
    want = [x for i in items for x in brute(docs, [i], 10)]
    for sizes in ({}, {"shard_tokens": 700, "chunk_items": 3}):
        got = lexical.ranked_documents(d, b, **sizes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert plain(map(tuple, got.collect())) == plain(want)


def test_ranked_documents_of_empty_tables(spark):
    none, nobody = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    d = spark.createDataFrame([(1, "a b", "x", "y", 1, 2, 0.5, 3)], DOCS)
    b = spark.createDataFrame([(1, "a", 1, 2, 0.5)], ITEMS)
    assert lexical.ranked_documents(none, b).collect() == [] and lexical.ranked_documents(d, nobody).collect() == []
    assert lexical.ranked_documents(none, nobody).collect() == []
    assert [tuple(x) for x in lexical.ranked_documents(d, b).collect()] == brute([(1, "a b")], [(1, "a")], 10)
