"""Suffix-array deduplication against brute force, with edge rows."""

import hashlib
import random

import numpy as np
import pytest

from sonaframe.llm import suffixes

DOCS = "doc_id long, text string, lang string, slab long, bucket int, n int, bytes long"


def brute(rows, length=100):
    """rows in order; (id, bytes, removed, spans, sha) of each."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        b = (rows[i][1] or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            w = b[s: s + length]
            if w in seen:
                gone[s: s + length] = True
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if b else 0
        out.append((rows[i][0], len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(r, n):
    word = lambda: "".join(r.choice("abcdeéñ漢") for _ in range(r.randrange(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    parts = [prose(r.choice((10, 25, 40, 90))) for _ in range(12)]
    line = "x" * 40 + prose(4)  # a phrase shorter than a string, between other words everywhere
    rows = []
    for i in range(n):
        t = " ".join(r.choice((r.choice(parts), prose(r.randrange(1, 60)), line)) for _ in range(r.randrange(1, 8)))
        if r.random() < 0.3 and rows:
            w = list(rows[r.randrange(len(rows))][1] or "")
            for _ in range(r.randrange(4)):
                if w:
                    w[r.randrange(len(w))] = r.choice("zqé")
            t = "".join(w)
        rows.append((i * 3, t))
    rows += [(1, None), (2, ""), (4, "short"), (5, "a" * 99), (7, "a" * 100), (8, "a" * 5000), (10, "ab" * 700 + "a" * 150), (11, "éa" * 120),
             (13, "The same line again, and again, once more.\n" * 400), rows[3], rows[3], (None, rows[4][1]), (None, None), (3, rows[5][1] + prose(40)), (14, "a" * 100)]
    return rows


def test_refinement_names_equal_strings_alike():
    r = np.random.default_rng(4)
    for alphabet in (1, 2, 4):
        text = r.integers(97, 97 + alphabet, 4000).astype(np.uint8)
        text[2500:3200] = text[300:1000]
        start = np.sort(r.choice(3900, 1500, replace=False))
        for depth in (100, 64, 9, 33):
            got = suffixes.refine(text.copy(), start, depth)
            want = {}
            same = [want.setdefault(text[s: s + depth].tobytes(), len(want)) for s in start]
            assert len(set(zip(got.tolist(), same))) == len(set(got.tolist())) == len(want)


@pytest.mark.parametrize("sizes", [{}, {"slab_bytes": 3000, "bucket_pieces": 40, "bucket_bytes": 2000}, {"slab_bytes": 3000, "hot_pieces": 4, "bucket_bytes": 500}])
def test_remove_repeats_equals_brute_force(spark, sizes):
    rows = corpus(random.Random(11), 120)
    docs = spark.createDataFrame([(i, t, "en", 1, 2, 3, 4) for i, t in rows], DOCS).coalesce(1 if not sizes else 3)
    got = suffixes.remove_repeats(docs, **sizes).collect()
    assert all(hashlib.sha256(g["kept"]).hexdigest() == g["kept_sha256"] for g in got)
    want = brute(rows)
    assert sorted((tuple(g)[:5] for g in got), key=str) == want
    assert sum(w[2] for w in want) > 20_000


def test_stretches_do_not_part_equal_strings(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "STRETCH", 150)
    rows = corpus(random.Random(12), 60)
    text = [(t or "").encode() for _, t in rows]
    a = suffixes.Slab(b"".join(text), np.array([len(t) for t in text]), 100)
    assert (a.end - a.first).sum() == sum(max(0, len(t) - 99) for t in text) and (a.end - a.first).max() <= 69


def test_hot_grams_are_found(spark):
    r = random.Random(2)
    line = "one common phrase of about ninety bytes, which is shorter than a string, in every document"
    rows = [(i, "".join(r.choice("abcdefgh") for _ in range(200)) + line + "".join(r.choice("abcdefgh") for _ in range(200))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    slabs = suffixes.written(suffixes._slabs(docs, 4000))
    assert len(suffixes._hot_grams(slabs, 100, 100)) >= 1 and len(suffixes._hot_grams(slabs, 100, 1000)) == 0
    assert [x["n_removed"] for x in suffixes.remove_repeats(docs, slab_bytes=4000, hot_pieces=100).collect()] == [0] * 200


def test_remove_repeats_of_empty_tables(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
    one = suffixes.remove_repeats(spark.createDataFrame([(None, None, "", 1, 2, 3, 4)], DOCS), with_kept=False).collect()
    assert [tuple(x) for x in one] == [(None, 0, 0, 0, hashlib.sha256(b"").hexdigest())]
