"""The operators on Spark: edge cases and brute-force versions on small tables."""

import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sonaframe.llm import covertree, decontam, kdshards, knlm, licenses, neardup, packing, pages, passages, quality
from sonaframe.llm import queries as Q
from sonaframe.llm.words import words_of

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, band long, node long, size long"


def prose(r, n, tag=""):
    return " ".join(f"{r.choice('abcdefgh')}{tag}{r.randrange(4000)}" + ("." if r.random() < 0.12 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Null and empty texts, marks only, one word, copies, near copies, shared passages, a long text, a null and a repeated id."""
    r = random.Random(4)
    base, passage = prose(r, 200), prose(r, 60, "p")
    near = base.split()
    near[50] = "changed"
    out = [(1, None), (2, ""), (3, "!!! ???"), (4, "word"), (5, base), (6, base), (7, " ".join(near)), (8, base.upper()),
           (9, prose(r, 90) + " " + passage + " " + prose(r, 40)), (10, prose(r, 30) + " " + passage), (11, prose(r, 150)),
           (12, prose(r, 6000)), (None, base), (13, prose(r, 100)), (13, None), (14, ""), (15, "tab\tline\nCC BY all rights reserved cc by"),
           (16, prose(r, 120, "q") + " " + passage + ".")]
    out.append(out[10])
    return [(i, t, "en", "src0", len(t or ""), 0.5, "k", 1, 2, 3) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates(docs, rows):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    of = collections.defaultdict(set)
    for g in got:
        of[g["doc_id"]].add(g["class_id"])
    assert of[5] == of[6] == of[7] == of[8] == {5}
    assert of[1] == of[2] == of[14] == {1} or of[2] == of[14]  # equal texts, null read as empty
    assert of[None] == {None} and of[9] == {9} and of[10] == {10} and of[3] == {3} and of[4] == {4} and of[11] == {11}
    kept = neardup.keep_one(docs, neardup.near_duplicates(docs))
    ids = collections.Counter(x["doc_id"] for x in kept.select("doc_id").collect())
    assert ids[5] == 1 and not {6, 7, 8} & set(ids) and ids[None] == 1 and max(ids.values()) == 1
    assert kept.columns == docs.columns


def test_near_duplicate_chain_in_one_bucket(spark):
    """Of a chain whose ends are unlike each other every link is found, also where the smallest id is no neighbour."""
    r = random.Random(9)
    text = prose(r, 300).split()
    out = []
    for i in range(40):
        out.append((i, " ".join(text)))
        for _ in range(4):
            text[r.randrange(300)] = f"x{r.random()}"
    docs = spark.createDataFrame(r.sample(out, 40), "doc_id long, text string")
    idf = neardup.word_frequencies(docs)
    from sonaframe.llm.words import WordHashes
    w = WordHashes()
    sets = {i: neardup.weighted_shingles(w.of(words_of(t)), idf) for i, t in out}
    parent = {i: i for i, _ in out}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and neardup.weighted_jaccard(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {x["doc_id"]: x["class_id"] for x in neardup.near_duplicates(docs, small=2, block=5).collect()}
    assert got == {i: find(i) for i in sets}


def test_passages(docs, rows):
    got = passages.cut_passages(docs)
    assert set(docs.columns) < set(got.columns)
    got = got.collect()
    assert len(got) == len(rows)
    by = {g["doc_id"]: g for g in got if g["doc_id"] is not None}
    assert by[9]["n_removed"] == 0 and by[10]["n_removed"] == 60 and by[16]["n_removed"] == 60
    assert by[10]["partners"] == [9] and by[16]["cluster"] == 9
    assert by[6]["text"] == "" and by[5]["n_removed"] == 0 and by[11]["n_removed"] == 0
    assert [g["text"] for g in got if g["doc_id"] is None] == [rows[4][1]]


def test_contaminated(spark, docs, rows):
    text = {i: t for i, t, *_ in rows}
    words = text[12].split()
    broken = text[11].split()[20:60]
    broken[3] = "no"
    items = [(1, " ".join(words[3000:3031])), (2, " ".join(text[11].split()[20:28])), (3, " ".join(broken)), (4, ""), (5, None), (6, "word"),
             (7, "nowhere " * 30), (None, text[5]), (8, " ".join(words[3000:3031]))]
    items = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    got = {(g["doc_id"], g["item_id"]): g["containment"] for g in decontam.contaminated(docs, items).collect()}
    assert set(got) == {(12, 1), (12, 8), (11, 2), (11, 3), (4, 6)}
    assert got[12, 1] == 1.0 and 0.8 <= got[11, 3] < 1
    left = [x["doc_id"] for x in decontam.without_contaminated(docs, items).select("doc_id").collect()]
    assert len(left) == len(rows) - 4 and None in left


def test_packing(docs, rows):
    got = packing.pack(docs, window=256, part_tokens=3000).collect()
    enc = packing.encoder(packing.default_tokenizer())
    want = collections.Counter((i, zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in [*enc.ids(t or ""), 1]))) for i, t, *_ in rows)
    total = sum(len(enc.ids(t or "")) + 1 for _, t, *_ in rows)
    assert sum(g["length"] for g in got) == total
    seqs = collections.defaultdict(list)
    for g in got:
        seqs[g["sequence_id"]].append(g)
    for s in seqs.values():
        s.sort(key=lambda g: g["offset"])
        assert [g["offset"] for g in s] == [sum(x["length"] for x in s[:i]) for i in range(len(s))]
        assert sum(g["length"] for g in s) == s[0]["sequence_tokens"] <= 256
    whole = collections.Counter((g["doc_id"], g["ids_crc32"]) for g in got if g["length"] == g["doc_tokens"])
    assert not whole - want
    pieces = collections.defaultdict(list)
    for g in got:
        if g["doc_id"] == 12:
            pieces[g["start"]].append(g)
    ids, at = [*enc.ids(rows[11][1]), 1], 0
    while at < len(ids):
        g = pieces[at][0]
        assert g["ids_crc32"] == zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids[at: at + g["length"]]))
        at += g["length"]
    assert at == len(ids)


def test_licenses(docs, rows):
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(rows)
    g = next(g for g in got if g["doc_id"] == 15)
    assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"], g["labels"]) == (9, 3, 2, 7, "cc-by,reserved", "cc-by,reserved")
    assert all(0 <= x["score"] <= 1 for x in got)
    one = [x for x in got if x["doc_id"] == 4][0]
    assert (one["n_words"], one["n_base"], one["first_word"], one["labels"], one["score"]) == (1, 0, None, "", 0.0)


def test_license_templates_match_in_part(spark):
    mit = [p for p, lab in licenses.TEMPLATES if lab == "mit" and len(p.split()) > 10][0].split()
    texts = ["x " * 7 + " ".join(mit), " ".join(mit[:12] + ["inserted", "words"] + mit[12:]), " ".join(mit[: len(mit) // 3]), "cc by nc sa 4 0 cc by"]
    got = {g["doc_id"]: g for g in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]["labels"] == "mit" and got[0]["score"] == 1.0
    assert got[1]["labels"] == "mit" and got[2]["labels"] == "" and 0 < got[2]["score"] < 0.5
    assert got[3]["labels"] == "cc-by,cc-by-nc,cc-by-nc-sa" and got[3]["n_base"] == 2


def test_license_scan_equals_plain_search(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {g["doc_id"]: g for g in Q.QUERIES["op3_license_scan"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or ""))
        at = [i for p in licenses.BASE for i in range(len(w)) if w[i: i + len(p.split())] == p.split()]
        g = got[d["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))


def test_kd_shards(docs, rows, spark):
    got = kdshards.kd_shards(docs, shards=4).collect()
    assert len(got) == len(rows)
    r = random.Random(2)
    many = spark.createDataFrame([(i, prose(r, r.randrange(1, 60)) if i % 3 else "the same text in a third of all rows", "en" if i % 5 else "de")
                                  for i in range(900)], "doc_id long, text string, lang string")
    got = kdshards.kd_shards(many, shards=8).collect()
    size = collections.Counter()
    slots = collections.defaultdict(list)
    of = collections.defaultdict(set)
    for g in got:
        size[g["shard"]] += g["size"]
        slots[g["shard"]].append(g["slot"])
        of[g["text_crc32"]].add(g["shard"])
    assert sorted(size) == list(range(8)) and max(size.values()) <= 1.05 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(g["text_crc32"] == zlib.crc32((t or "").encode()) and g["size"] == len((t or "").encode()) + 1
               for g, t in zip(sorted(got, key=lambda g: g["doc_id"]), [x["text"] for x in many.orderBy("doc_id").collect()]))
    assert sum(len(s) > 1 for s in of.values()) <= 1
    three = kdshards.kd_shards(many, shards=3).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(three) == 3 and max(x["n"] for x in three) <= 1.05 * min(x["n"] for x in three)
    by_bytes = kdshards.kd_shards(many, shards=None, target_bytes=20_000)
    assert by_bytes.groupBy("shard").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] <= 21_500


def kneser_ney(train, order):
    """p(context, word) of an interpolated modified Kneser-Ney model, by dictionaries of tuples."""
    counts = {order: collections.Counter()}
    for t in train:
        padded = ["^"] * (order - 1) + t
        counts[order].update(tuple(padded[i: i + order]) for i in range(len(t)))
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    discount = {n: knlm.discounts(*([sum(y == i for y in x.values()) for i in (1, 2, 3, 4)])) for n, x in counts.items()}
    behind = {n: collections.Counter() for n in counts}
    kept = {n: collections.Counter() for n in counts}
    for n, x in counts.items():
        for g, m in x.items():
            behind[n][g[:-1]] += m
            kept[n][g[:-1]] += discount[n][min(m, 3)]
    v = len({g[-1] for g in counts[1]})

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (v + 1)
        below = p(gram[1:])
        total = behind[n][gram[:-1]]
        if not total:
            return below
        m = counts[n][gram]
        return max(m - discount[n][min(m, 3)], 0) / total + kept[n][gram[:-1]] / total * below

    return p


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(docs, rows, order):
    got = sorted(knlm.score_texts(docs, chunk_tokens=500, bucket_tokens=700, order=order).collect(), key=repr)
    assert len(got) == len(rows)
    once = sorted(knlm.score_texts(docs, order=order).collect(), key=repr)  # one chunk a partition, one bucket
    assert [(g["doc_id"], g["n_known"], round(g["base_score"], 6), round(g["score"], 6)) for g in got] == \
        [(g["doc_id"], g["n_known"], round(g["base_score"], 6), round(g["score"], 6)) for g in once]
    tokens = [(i, [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split(), None]) for i, t, *_ in rows]
    train = [t for i, t in tokens if not knlm.held_out(i, 7, 2)]
    c = collections.Counter(x for t in train for x in t)
    n, v = sum(c.values()), len(c)
    p = kneser_ney(train, order)
    start = ("^",) * (order - 1)
    for context in (start, tuple(train[0][: order - 1]) if len(train[0]) >= order else start):
        assert sum(p((*context, w)) for w in c) + p((*context, "never seen")) == pytest.approx(1)
    want = sorted((str(i), len(t), sum(c[x] > 0 for x in t), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 6),
                   round(sum(math.log10(p((*start, *t)[j: j + order])) for j in range(len(t))), 6)) for i, t in tokens)
    assert sorted((str(g["doc_id"]), g["n_tokens"], g["n_known"], round(g["base_score"], 6), round(g["score"], 6)) for g in got) == want
    assert all(g["train_tokens"] == n and g["held_out"] == knlm.held_out(g["doc_id"], 7, 2) for g in got)


def test_language_model_without_training_rows_and_of_order_one(docs, spark):
    held = next(i for i in range(100) if knlm.held_out(i, 7, 2))
    alone = spark.createDataFrame([(held, "a b a")], "doc_id long, text string")
    assert [(g["score"], g["n_known"]) for g in knlm.score_texts(alone).collect()] == [(0.0, 0)]
    with pytest.raises(ValueError):
        knlm.score_texts(docs, order=1)


def test_quality(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2, None) for i in (5, 6, 7, 9, 10, 11, 12)] + [(8, None, 1), (None, 1, 1), (5, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model)
    assert sorted(got.columns) == sorted({*docs.columns, "predicted"})
    got = got.collect()
    assert len(got) == len(rows) and all(0 <= g["score"] <= 1 for g in got)
    none = quality.fit_quality(docs, labels.limit(0))
    assert {g["score"] for g in quality.score_quality(docs, none).collect()} == {1.0}


def test_quality_learns_from_a_very_long_text(spark):
    r = random.Random(8)
    rows = [(i, prose(r, 100)) for i in range(12)] + [(12, "word and other " * 33_334)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert len(model.labels) == 13 and all(abs(x) < 2 for x in model.vectors.ravel())
    # the text itself is its own nearest neighbour, so that its vector is the one that is scored
    z = model.latent(quality.TokenSlots().counts(rows[12][1])[None])
    assert max((model.vectors @ z[0]).tolist()) > 0.9999
    assert all(0 <= g["score"] <= 1 for g in quality.score_quality(docs, model).collect())


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.QUERIES["op10_quality_votes"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 40
    assert sum(g["predicted"] == g["quality"] for g in got) >= 0.95 * len(got)


def test_vectors(spark):
    r = random.Random(1)
    rows = [(i, [float(r.randrange(-3, 4)) / 8 for _ in range(4)]) for i in range(120)] + [(7, [0.5] * 4), (None, [1.0] * 4), (121, None),
            (122, [1.0, float("nan"), 0.0, 0.0]), (123, [1.0, None, 0.0, 0.0]), (124, [float("inf")] * 4), (140, [1.0, 1.0]), (160, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = covertree.top_inner_products(df, F.col("id") % 20 == 0, k=5, block_rows=40, query_rows=3, sample_rows=16).collect()
    points = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows)
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, i, v in points:
        if i % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, j, w in points if m != n and len(w) == len(v))[:5]
            want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s)]
    assert sorted(tuple(g) for g in got) == sorted(want)


def test_pages(spark):
    side = "<div><p>Menu of the site</p></div>"
    page = lambda body: f"<html><body>{side}<div><p>{body}</p></div><p>About us</p></body></html>"
    rows = [(1, "http://h.example/a/1", page("One story.")), (2, "http://h.example/a/2.html", page("Another story.")), (3, "http://alone.example/", page("Third.")),
            (4, None, page("No url.")), (5, "http://h.example/b", None), (6, "http://h.example/b/1", ""), (7, "http://h.example/a/1", page("One story.")),
            (7, "http://h.example/a/1", page("One story.")), (None, "http://[broken", "<p>x")]
    got = pages.extract_pages(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string"))
    got = [(g["page_id"], g["text"], g["n_chars"]) for g in got.collect()]
    assert len(got) == len(rows)
    by = dict((g[0], g[1]) for g in got)
    assert by[2] == "Another story."            # what it shares with its neighbour is gone
    assert by[3] == by[4].replace("No url.", "Third.") == "Menu of the site\nThird.\nAbout us"
    assert by[5] == by[6] == "" and by[None] == "x"
    assert all(n == len(t) for _, t, n in got)


def test_empty_tables(spark, empty, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert neardup.near_duplicates(empty).count() == 0
    assert passages.cut_passages(empty).count() == 0
    assert decontam.contaminated(empty, items).count() == 0
    assert decontam.contaminated(docs, items).count() == 0
    assert decontam.contaminated(empty, spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")).count() == 0
    assert packing.pack(empty).count() == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert kdshards.kd_shards(empty).count() == 0
    assert knlm.score_texts(empty).count() == 0
    assert quality.score_quality(empty, quality.fit_quality(empty, labels)).count() == 0
    assert covertree.top_inner_products(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).count() == 0
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_near_copies_of_every_text_of_one_id(spark):
    """An id that stands with two texts has the near copies of both; all are one class."""
    r = random.Random(21)
    one, two = prose(r, 120), prose(r, 120, "z")

    def edited(t):
        w = t.split()
        w[60] = "changed"
        return " ".join(w)

    rows = [(9, one), (9, two), (5, edited(one)), (7, edited(two)), (8, prose(r, 120, "k")), (11, two), (9, one)]
    for order in (rows, rows[::-1]):
        got = {g["doc_id"]: g["class_id"] for g in neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()}
        assert got == {9: 5, 5: 5, 7: 5, 8: 8, 11: 5}


def test_no_window_of_a_smaller_id_stays(spark):
    """Brute force over the whole operator: of what stays together, no 50 words stand in a document with a smaller id."""
    r = random.Random(31)
    rows, at = [], 0
    for held in (45, 47, 49, 50, 55):
        for _ in range(8):
            passage = prose(r, r.choice((50, 51, 60)), f"p{at}x").split()
            first = r.randrange(0, len(passage) - min(held, len(passage)) + 1)
            part = passage[first: first + held]
            for words in (part, passage, passage):
                rows.append((at, " ".join([prose(r, r.randrange(0, 40), f"a{at}x"), *words, prose(r, r.randrange(0, 40), f"b{at}x")])))
                at += 1
    line = prose(r, 12, "line")
    rows += [(at, (line + "\n") * 30), (at + 1, prose(r, 30) + "\n" + (line + "\n") * 20), (at + 2, (line + " x\n") * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = {}
    for x in passages.repeated_passages(docs).collect():
        spans.setdefault(x["doc_id"], []).append((x["first"], x["last"]))
    seen, cut = set(), 0
    for i, t in rows:
        w = words_of(t)
        gone = [any(a <= p <= z for a, z in spans.get(i, ())) for p in range(len(w))]
        own = [tuple(w[p: p + 50]) for p in range(len(w) - 49)]
        assert not any(x in seen for p, x in enumerate(own) if not any(gone[p: p + 50])), i
        assert not any(gone) or any(x in seen for x in own) or len(spans[i])
        cut += sum(gone)
        seen |= set(own)
    assert cut > 40 * 50


def test_edited_passages_are_caught(spark):
    """Near copies whose shingles keep a similarity of 0.8: at least nine in ten are cut."""
    r = random.Random(41)
    rows, planted = [], []
    for n in range(60):
        passage = prose(r, r.randrange(60, 160), f"e{n}x").split()
        copy = list(passage)
        for _ in range(max(1, len(copy) // 60)):
            copy[r.randrange(5, len(copy) - 5)] = f"edit{n}"
        a, b = ({tuple(w[p: p + 5]) for p in range(len(w) - 4)} for w in (passage, copy))
        if len(a & b) < 0.8 * len(a | b):
            continue
        rows += [(2 * n, " ".join([prose(r, 30, f"u{n}x"), *passage, prose(r, 30, f"v{n}x")])), (2 * n + 1, " ".join([prose(r, 50, f"w{n}x"), *copy, prose(r, 20, f"q{n}x")]))]
        planted.append((2 * n + 1, len(copy)))
    got = {g["doc_id"]: g["n_removed"] for g in passages.cut_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(got[i] >= 0.9 * n for i, n in planted) / len(planted)
    assert len(planted) > 40 and caught >= 0.9, caught


def test_repeated_lines_do_not_stall():
    """A line over and over, with an edit here and there, against itself without."""
    import time
    r = random.Random(51)
    line = [f"l{i}" for i in range(12)]
    y = line * 4000
    x = list(y)
    for p in range(20, len(x), 40):
        x[p] = f"e{p}"
    w = passages.WordHashes()
    began = time.time()
    assert passages.repeats(w.of(x), w.of(y), 50, 0.8) is not None
    assert time.time() - began < 20


def test_components_of_a_long_chain_and_a_hub(spark):
    """Many rounds: a chain of 3,000 links in a scattered order, and a hub with 2,000 leaves."""
    from sonaframe.llm.components import connected_components
    r = random.Random(61)
    ids = r.sample(range(10_000, 50_000), 3001)
    links = list(zip(ids, ids[1:])) + [(5, 60_000 + i) for i in range(2000)] + [(7, None), (8, 8)]
    r.shuffle(links)
    got = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert {got[i] for i in ids} == {min(ids)} and {got[60_000 + i] for i in range(2000)} == {5} and 8 not in got and 7 not in got
