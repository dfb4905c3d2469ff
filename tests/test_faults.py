"""Inputs that once gave wrong answers, with the results that they must give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonaframe.functions import text as TX
from sonaframe.operators import filters as FL
from sonaframe.operators import joins as J
from sonaframe.operators import signal as S
from sonaframe.operators import vq as V
from sonaframe.sources import labels, tables


def test_last_line_wins_in_the_order_of_the_paths(spark, tmp_path):
    small, large = str(tmp_path / "a.txt"), str(tmp_path / "b.txt")
    with open(small, "w") as f:
        f.write("n\tfrom a\t[1]\tx\n")
    with open(large, "w") as f:
        f.write("".join(f"m{i}\tp\t[1]\tx\n" for i in range(2000)) + "n\tfrom b\t[1]\tx\n")
    for order, last in (([small, large], "from b"), ([large, small], "from a")):
        got = tables.read_phoneme_tsv(spark, order).where("name = 'n'").first()
        assert " ".join(got["phones"]) == last
    lines = labels.read_lines(spark, large).orderBy("line_no").select("line").collect()
    assert [r["line"].split("\t")[0] for r in lines] == [f"m{i}" for i in range(2000)] + ["n"]


def test_word2ph_survives_a_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", ["p", "q"], [3, 1, 2], "tab\there"), ("b", ["r"], None, None)],
                               "name string, phones array<string>, word2ph array<int>, norm_text string")
    tables.write_tsv(df, str(tmp_path / "t"))
    got = {r["name"]: r for r in tables.read_phoneme_tsv(spark, str(tmp_path / "t")).collect()}
    assert got["a"]["word2ph"] == [3, 1, 2] and got["a"]["norm_text"] == "tab here" and got["a"]["phones"] == ["p", "q"]
    assert got["b"]["word2ph"] is None and got["b"]["norm_text"] == ""


def test_label_lines_keep_null_fields_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([("a.wav", None, "en", "two\nlines"), ("b.wav", "s", "en", "bar | inside"), ("c.wav", "s", None, "x")],
                               "path string, speaker string, lang string, text string")
    refused = labels.write_label_list(df, str(tmp_path / "l"))
    assert [(r["path"], r["reject_reason"]) for r in refused.collect()] == [("b.wav", "field_count")]
    got = {r["path"]: r for r in labels.read_label_list(spark, str(tmp_path / "l")).collect()}
    assert sorted(got) == ["a.wav", "c.wav"] and all(r["reject_reason"] is None for r in got.values())
    assert (got["a.wav"]["speaker"], got["a.wav"]["text"], got["c.wav"]["lang"]) == ("", "two lines", "")


@pytest.mark.parametrize("line,want", [("hello world again", "hello world again"), ("你好　世界", "你好 世界"), (" x\x1f", "x")])
def test_unicode_blanks_part_words(spark, line, want):
    df = spark.createDataFrame([(line,), ("　 ",)], "line string")
    assert [r["text"] for r in FL.clean_lines(df).collect()] == [want]
    assert df.limit(1).select(F.array_join(TX.whitespace_tokens("line"), " ")).first()[0] == want


def test_accented_letters_beyond_latin_b(spark):
    got = spark.createDataFrame([("Việt Nam café",)], "t string").select(TX.normalize_en("t")).first()[0]
    assert got == "Viet Nam cafe"


def test_a_silent_signal_is_a_reason_and_no_error(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (2, 0, 0.5), (2, 1, -1.0)], "signal_id long, pos long, v double")
    assert {r["signal_id"]: r["reject_reason"] for r in S.peak_gate(df).collect()} == {1: "silent", 2: None}
    assert {r["signal_id"] for r in S.peak_blend(df).collect()} == {2}
    assert {(r["signal_id"], r["i16"]) for r in S.slice_blend(df).collect() if r["signal_id"] == 1} == {(1, 0)}


def test_kmeans_has_k_codes_with_fewer_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(3)] + [(9, None)], "id long, v array<double>")
    got = V.kmeans_fit(df, "id", "v", k=5, iters=2).collect()
    assert sorted(r["code"] for r in got) == [0, 1, 2, 3, 4] and sum(r["n"] for r in got) == 3
    assert V.kmeans_fit(df.limit(0), "id", "v", k=5).count() == 0


@pytest.mark.parametrize("size", [10, 300, 20_000])
def test_one_way_for_vocabularies_of_every_size(spark, size):
    r = random.Random(size)
    vocab = {f"s{i}": i for i in range(size)} | {"UNK": size}
    rows = [(k, [f"s{r.randrange(size + 3)}" for _ in range(r.randrange(0, 6))]) for k in ["x.wav", "x.wav", None, None, "y", "y"]]
    rows += [("x.wav", ["s0", "s1"]), ("x.wav", ["s1", "s1", "s0"]), ("z", None), ("z", [None, "s1"])]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "i int, name string, toks array<string>")
    v = spark.createDataFrame(list(vocab.items()), "symbol string, id int")

    def loop(policy, t):
        ids = None if t is None else [vocab.get(x) for x in t]
        if ids is None:
            return None
        if policy == "reject":
            return None if None in ids else ids
        return [size if x is None else x for x in ids] if policy == "unk" else [x for x in ids if x is not None]

    for policy in ("reject", "unk", "drop"):
        got = {g["i"]: g["ids"] for g in J.vocab_encode(df, "toks", v, policy=policy).collect()}
        assert got == {i: loop(policy, t) for i, (_, t) in enumerate(rows)}
    enc = J.vocab_encode(df, "toks", v, policy="drop")
    dec = {g["i"]: g["symbols"] for g in J.vocab_decode(enc, "ids", v).collect()}
    assert dec == {i: None if t is None else [x for x in t if x in vocab] for i, (_, t) in enumerate(rows)}


def test_large_codebooks_meet_vectors_in_blocks(spark, monkeypatch):
    g = np.random.default_rng(1)
    book = [(i, g.integers(-3, 4, 4).astype(float).tolist()) for i in range(50)]
    rows = [(i, g.integers(-3, 4, 4).astype(float).tolist()) for i in range(40)] + [(40, None), (41, [1.0]), (42, [1.0, None, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    cb = spark.createDataFrame(book, "code int, vec array<double>")
    want = {i: None if v is None or len(v) != 4 or None in v else
            min((sum((a - b) ** 2 for a, b in zip(v, w)), c) for c, w in book)[1] for i, v in rows}
    assert {r["id"]: r["code"] for r in V.nearest_code(df, cb).collect()} == want
    small = {r["id"]: tuple(r) for r in V.rvq_encode(df, [cb, cb.withColumn("code", F.col("code") + 7)]).collect()}
    books = [cb, cb.withColumn("code", F.col("code") + 7)]
    back = {r["id"]: r["decoded"] for r in V.rvq_decode(V.rvq_encode(df, books), books).collect()}
    monkeypatch.setattr(V, "MAX_CODEBOOK_BYTES", 0)
    monkeypatch.setattr(V, "BLOCK_CODES", 7)
    monkeypatch.setattr(V, "BLOCK_VECTORS", 6)
    assert {r["id"]: r["code"] for r in V.nearest_code(df, cb).collect()} == want
    large = {r["id"]: tuple(r) for r in V.rvq_encode(df, books).collect()}
    assert large == small and small[41][2:] == (None, None, None)
    enc = spark.createDataFrame([(i, r[3]) for i, r in small.items()] + [(90, [1]), (91, [1, 99])], "id long, codes array<int>")
    assert {r["id"]: r["decoded"] for r in V.rvq_decode(enc, books).collect()} == back | {90: None, 91: None}


def test_half_a_million_codes_in_bounded_tiles(monkeypatch):
    import tracemalloc
    g = np.random.default_rng(2)
    m = np.round(g.normal(size=(500_000, 6)) * g.uniform(0.2, 5, (500_000, 1)), 1)  # many equal distances
    x = np.round(g.normal(size=(60, 6)) * 2, 1)
    codes = g.permutation(500_000).astype(np.int32)
    book = V.Codes(codes, m)
    tracemalloc.start()
    at, dist = V.nearest(x, book)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20
    for i in range(len(x)):
        exact = V.exact_distances(np.broadcast_to(x[i], m.shape), m)
        best = np.flatnonzero(exact == exact.min())
        assert book.codes[at[i]] == codes[best].min() and dist[i] == exact.min()
    met = []
    in_tile = V._in_tile
    monkeypatch.setattr(V, "_in_tile", lambda x, *a: met.append(len(x)) or in_tile(x, *a))
    V.nearest(x, book)
    assert sum(met) < 0.9 * len(x) * len(book.tiles)  # norms rule tiles out


def test_code_blocks_are_ruled_out_by_their_norms(spark, monkeypatch):
    g = np.random.default_rng(3)
    scale = g.choice((0.1, 1.0, 20.0), 600)[:, None]
    book = g.normal(size=(600, 5)) * scale
    vecs = g.normal(size=(300, 5)) * g.choice((0.1, 1.0, 20.0), 300)[:, None]
    cb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(book)], "code int, vec array<double>")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>")
    want = {i: int(((book - v) ** 2).sum(1).argmin()) for i, v in enumerate(vecs)}
    for name, value in (("MAX_CODEBOOK_BYTES", 0), ("BLOCK_CODES", 32), ("BLOCK_VECTORS", 16)):
        monkeypatch.setattr(V, name, value)
    assert {r["id"]: r["code"] for r in V.nearest_code(df, cb).collect()} == want
    fit = V.kmeans_fit(df, "id", "vec", 5, iters=2)
    monkeypatch.setattr(V, "MAX_CODEBOOK_BYTES", 1 << 20)
    plain = V.kmeans_fit(df, "id", "vec", 5, iters=2)
    assert np.allclose([r["vec"] for r in fit.orderBy("code").collect()], [r["vec"] for r in plain.orderBy("code").collect()])


def test_a_partial_output_is_not_done(spark, tmp_path):
    from sonaframe.plans.one_click import finished_rows, run_step
    out = str(tmp_path / "step")
    spark.range(5).write.parquet(out)          # written, but without its marker
    assert finished_rows(spark, out) is None
    assert run_step(spark, out, lambda: spark.range(7)) == (7, False)
    assert run_step(spark, out, lambda: spark.range(9)) == (7, True)


def test_a_batch_that_is_tried_again_leaves_no_row_twice(spark, tmp_path):
    from sonaframe.streaming.jobs import _write_batch, latest_rows
    out = str(tmp_path / "o")
    for _ in range(2):
        _write_batch(spark.range(3).withColumn("n", F.lit(1)), 0, out)
    _write_batch(spark.range(1).withColumn("n", F.lit(5)), 1, out)
    assert spark.read.parquet(out).count() == 4
    assert {r["id"]: r["n"] for r in latest_rows(spark.read.parquet(out), ["id"]).collect()} == {0: 5, 1: 1, 2: 1}


def test_map_batches_whole_batch_first(spark):
    from pyspark.sql import types as T
    from sonaframe.operators.udf import map_batches
    df = spark.createDataFrame([(1, "ab"), (2, "c|d"), (3, "")], "id long, text string")

    def one(row):
        if "|" in row["text"]:
            raise ValueError("bar" * 100)
        return {"n": len(row["text"])}

    def whole(pdf):
        if pdf["text"].str.contains("|", regex=False).any():
            raise ValueError
        return pdf.assign(n=pdf["text"].str.len())

    schema = T.StructType([T.StructField("n", T.LongType())])
    for frame, bad in ((df, {2}), (df.where("id <> 2"), set())):
        got = {r["id"]: r for r in map_batches(frame, one, schema, "id", whole).collect()}
        assert {i for i, r in got.items() if r["error"]} == bad and got[1]["n"] == 2
        assert all("bar" * 100 in got[i]["error"] for i in bad)


def test_files_keep_the_order_of_the_given_folders(spark, tmp_path):
    """The last line wins, whatever the folders are called."""
    from sonaframe.sources.tables import read_phoneme_tsv

    def put(folder, value, name="part.tsv"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text(f"a.wav\tx y\tNone\t{value}\n")
        return str(tmp_path / folder)

    def winner(paths):
        return read_phoneme_tsv(spark, paths).first()["norm_text"]

    pairs = [("data", "data-old"), ("data-old", "data"), ("my dir", "a dir"), ("a+b", "a b"), ("z%20z", "z z"), ("über", "aber")]
    for k, (first, second) in enumerate(pairs):
        a, b = put(f"{k}/{first}", "first"), put(f"{k}/{second}", "second", "0.tsv")
        assert winner([a, b]) == "second" and winner([b, a]) == "first", (first, second)
    base = str(tmp_path / "0")
    assert winner([f"{base}/data-o*", f"{base}/data"]) == "first"
    assert winner([f"{base}/{{data,nothing}}", f"{base}/data-old/*.tsv"]) == "second"
    assert winner([f"file://{base}/data-old/", f"file:{base}/data/part.tsv"]) == "first"


def test_empty_files_are_listed_with_length_zero(spark, tmp_path):
    from sonaframe.operators.filters import duration_gate
    from sonaframe.sources.corpus import read_item_listing
    (tmp_path / "in ner").mkdir()
    for name, size in (("a.wav", 64_000), ("in ner/empty é.wav", 0), ("b.wav", 640_000), ("c.txt", 5), ("z.wav", 0)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {r["name"]: (r["length"], r["duration"], r["frames"]) for r in read_item_listing(spark, str(tmp_path), "*.wav").collect()}
    assert got == {"a.wav": (64_000, 1.0, 50), "b.wav": (640_000, 10.0, 500), "empty é.wav": (0, 0.0, 0), "z.wav": (0, 0.0, 0)}
    gated = duration_gate(read_item_listing(spark, str(tmp_path), "*.wav"), "duration")
    assert sorted(r["length"] for r in gated.where("reject_reason is not null").collect()) == [0, 0]


def test_numbers_of_any_length_in_names(spark):
    from sonaframe.operators import sorts
    r = random.Random(3)
    names = [f"e{r.randrange(10 ** k)}x{'0' * (k % 4)}{r.randrange(9)}" for k in (1, 5, 39, 45, 60, 60, 61)] + ["e2", "e10", "e02", "e", "12", "f0"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = [x["name"] for x in sorted(sorts.natural_sort(df, "name", "id").collect(), key=lambda x: x["rank"])]
    import re
    key = lambda n: [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", n)]
    want = sorted(names, key=lambda n: (key(n), n))
    assert got == want
    big = ["9" * 50, "1" + "0" * 50, "007"]
    files = spark.createDataFrame([(f"G_{b}.pth",) for b in big] + [("none.pth",)], "n string")
    assert sorts.newest_by_digits(files, "n").first()["newest"] == f"G_{big[1]}.pth"
    ck = spark.createDataFrame([(f"epoch={b}-step={s}.ckpt",) for b in big for s in ("1", "9" * 41)] + [(f"epoch={big[1]}-step={'0' + '9' * 41}.ckpt",)], "n string")
    assert sorts.newest_by_epoch_step(ck, "n").first()["newest"] == f"epoch={big[1]}-step=0{'9' * 41}.ckpt"


def test_cutters_are_linear_on_very_long_texts(spark):
    """200,000 sentences in one text."""
    import time

    from sonaframe.functions import text as TX
    r = random.Random(6)
    sentences = ["".join(r.choice("abcd ") for _ in range(r.randrange(1, 30))) + "," for _ in range(200_000)]
    df = spark.createDataFrame([("".join(sentences), sentences)], "t string, a array<string>")

    def fold(parts, full):
        out, cur = [], ""
        for x in parts:
            cur += x
            if full(len(cur)):
                out.append(cur)
                cur = ""
        return out, cur

    began = time.time()
    out, cur = fold(sentences, lambda n: n > 50)
    want = [*out[:-1], out[-1] + cur] if cur and len(cur) < 50 else out + [cur] * bool(cur)
    got = df.select(TX.cut_fifty("t").alias("c")).first()["c"]
    assert got == [x for x in want if x.strip("!?…,.- ")]
    out, cur = fold(sentences, lambda n: n >= 5)
    assert df.select(TX.merge_short("a").alias("c")).first()["c"] == [*out[:-1], out[-1] + cur]
    assert time.time() - began < 60
