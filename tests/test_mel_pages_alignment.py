"""Mel bands, pages from a directory of parts, and word alignment in the text table."""

import math
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonaframe.operators import signal as S
from sonaframe.operators import sorts as O
from sonaframe.operators import udf as D
from sonaframe.plans.text_table import FRONTENDS, build_text_table
from sonaframe.sources.tables import parse_phoneme_lines


# mel ------------------------------------------------------------------------------

def loop_basis(rate, n_fft, bands, low, high):
    """The filterbank entry by entry."""
    def mel(hz):
        return hz * 3 / 200 if hz < 1000 else 15 + 27 * math.log(hz / 1000) / math.log(6.4)

    def hz(m):
        return m * 200 / 3 if m < 15 else 1000 * 6.4 ** ((m - 15) / 27)

    edges = [hz(mel(low) + (mel(high) - mel(low)) * i / (bands + 1)) for i in range(bands + 2)]
    out = np.zeros((bands, n_fft // 2 + 1))
    for b in range(bands):
        left, centre, right = edges[b: b + 3]
        for k in range(n_fft // 2 + 1):
            f = k * rate / n_fft
            if left < f <= centre:
                out[b, k] = (f - left) / (centre - left)
            elif centre < f < right:
                out[b, k] = (right - f) / (right - centre)
            out[b, k] *= 2 / (right - left)
    return out


@pytest.mark.parametrize("rate, n_fft, bands, low, high", [
    (32000, 2048, 128, 0, None), (8000, 16, 5, 50, 3800), (16000, 400, 40, 20, 7600), (900, 64, 3, 0, 400)])
def test_basis_equals_the_loop(rate, n_fft, bands, low, high):
    mel = S.MelBands(rate, n_fft, bands, low, high)
    assert np.allclose(mel.basis(), loop_basis(rate, n_fft, bands, low, high or rate / 2), atol=1e-12)
    assert pickle.loads(pickle.dumps(mel)).basis() is mel.basis()       # built once in a process


def test_basis_rejects_impossible_limits():
    for bad in ((8000, 16, 0), (8000, 16, 4, 5000), (8000, 16, 4, -1), (8000, 16, 4, 300, 200)):
        with pytest.raises(ValueError):
            S.MelBands(*bad)


def test_mel_of_signals_and_of_spectra(spark):
    mel = S.MelBands(8000.0, 64, 10, 30.0, 3900.0)
    y = np.random.default_rng(3).normal(size=1000)
    rows = [(1, i, float(v)) for i, v in enumerate(y)] + [(2, i, 0.0) for i in range(200)] + [(3, 0, 1.0)]
    signals = spark.createDataFrame(rows, "signal_id long, pos long, v double").cache()
    spec = S.frame_spectrum(signals, 64, 16, 64).cache()
    want = {(r["signal_id"], r["frame"]): np.log(np.maximum(loop_basis(8000, 64, 10, 30, 3900) @ np.array(r["mag"]), 1e-5)) for r in spec.collect()}
    direct = S.mel_spectrum(signals, mel, hop=16, chunk_frames=7).collect()
    later = spec.withColumn("mag", S.mel_from_spectrum("mag", mel)).collect()
    for got in (direct, later):
        assert {(r["signal_id"], r["frame"]) for r in got} == set(want)
        assert all(np.allclose(r["mag"], want[r["signal_id"], r["frame"]]) for r in got)
    assert {k[0] for k in want} == {1, 2}                                # the third signal is too short


def test_mel_of_other_sizes_is_null(spark):
    mel = S.MelBands(8000.0, 8, 2)
    rows = spark.createDataFrame([([1.0] * 4,), (None,), ([],), ([1.0] * 5,)], "mag array<double>")
    assert [r[0] is None for r in rows.select(S.mel_from_spectrum("mag", mel)).collect()] == [True, True, True, False]
    with pytest.raises(ValueError):
        S.frame_spectrum(rows, n_fft=16, mel_basis=mel)


# pages ----------------------------------------------------------------------------

def _rows(page):
    return [tuple(r) for r in page.collect()]


def test_pages_equal_offset_and_limit(spark, tmp_path):
    rows = [(i * 7919 % 500, i if i % 50 else None, "x" * (i % 3)) for i in range(3000)] + [(3, 3, "same")] * 40
    df = spark.createDataFrame(rows, "a long, b long, c string")
    order = ["a", "b", "c"]
    paged = O.PagedTable.write(df, order, str(tmp_path / "t"), part_rows=200)
    ordered = [tuple(r) for r in df.orderBy(*order).collect()]
    assert paged.count() == len(rows)
    for index, batch in ((0, 10), (1, 1), (195, 30), (1500, 700), (3009, 31), (3030, 50), (0, 4000), (3040, 5), (9999, 5), (7, 0)):
        got = _rows(paged.page(index, batch))
        assert [r[:3] for r in got] == ordered[index: index + batch]
        assert [r[3] for r in got] == list(range(index, min(index + batch, len(rows))))[: len(got)]
    for bad in ((-1, 5), (0, -5)):
        with pytest.raises(ValueError):
            paged.page(*bad)


def test_a_deep_page_reads_the_parts_that_hold_it(spark, tmp_path):
    paged = O.PagedTable.write(spark.range(50_000), ["id"], str(tmp_path / "t"), part_rows=1000)
    assert paged.directory().count() >= 40
    parts = paged.parts_of(49_500, 50)
    assert 1 <= len(parts) <= 2
    page = paged.page(49_500, 50)
    assert [r["id"] for r in page.collect()] == list(range(49_500, 49_550))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = spark.read.parquet(f"{tmp_path}/t/rows").where(F.col("_part").isin(*parts)).count()
    assert read < 4000


def test_pages_of_an_empty_table_and_of_clashing_names(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, text string")
    paged = O.PagedTable.write(empty, ["id"], str(tmp_path / "e"))
    assert paged.count() == 0 and paged.page(0, 10).columns == ["id", "text", "row_index"] and not paged.page(0, 10).collect()
    with pytest.raises(ValueError):
        O.PagedTable.write(spark.range(3).withColumn("_PART", F.lit(1)), ["id"], str(tmp_path / "c"))


# alignment ------------------------------------------------------------------------

def _vocab(spark, symbols):
    return spark.createDataFrame(list(enumerate(symbols)), "id int, symbol string").select("symbol", "id")


def _table(spark, lines, vocab, **kw):
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    table, rejects = build_text_table(df, _vocab(spark, vocab), **kw)
    return {r["name"]: r for r in table.collect()}, {r["line"]: r["reject_reason"] for r in rejects.collect()}


def test_word2ph_is_written_and_read_back(spark):
    phones = {"你": ["n", "i3"], "好": ["h", "ao3"]}
    fronts = FRONTENDS | {"zh": D.unit_frontend(lambda c: c, D.table_units(phones))}
    table, rejects = _table(spark, ["w/a.wav|s|zh|你好,你", "w/b.wav|s|en|hi.", "w/c.wav|s|zh|你x"],
                            ["n", "i3", "h", "ao3", ",", "hi", "."], frontends=fronts)
    a, b = table["a.wav"], table["b.wav"]
    assert a["phones"] == ["n", "i3", "h", "ao3", ",", "n", "i3"] and a["word2ph"] == [2, 2, 1, 2]
    assert a["tsv"] == "a.wav\tn i3 h ao3 , n i3\t[2, 2, 1, 2]\t你好,你"
    assert b["word2ph"] is None and b["tsv"].split("\t")[2] == "None"
    assert rejects == {"c.wav": "not_in"}
    lines = spark.createDataFrame([(1, a["tsv"]), (2, b["tsv"])], "line_no long, line string")
    back = {r["name"]: r["word2ph"] for r in parse_phoneme_lines(lines).collect()}
    assert back == {"a.wav": [2, 2, 1, 2], "b.wav": None}


def test_characters_beyond_the_basic_plane_and_empty_texts(spark):
    df = spark.createDataFrame([("a𠀀b", "zh"), ("", "zh"), (None, "zh"), ("x", "en")], "text string, lang string")
    fronts = {"zh": D.unit_frontend(lambda c: c, D.table_units({"𠀀": ["p", "q", "r"]})), "en": D.Frontend(F.lower, D.characters)}
    got = [(r["phones"], r["word2ph"]) for r in D.apply_frontend(df, frontends=fronts).collect()]
    assert got == [(["a", "p", "q", "r", "b"], [1, 3, 1]), ([], []), (None, None), (["x"], None)]


def test_wrong_alignments_are_rejected(spark):
    ones = lambda c: F.transform(D.characters(c), lambda _: F.lit(1))
    short = lambda c: F.array(F.length(c))                             # noqa: E731
    letters = lambda c: F.regexp_extract_all(c, F.lit("[a-z]"), 0)     # noqa: E731
    lines = ["a|s|x|ab", "b|s|x|a1", "c|s|y|ab", "d|s|y|a"]
    fronts = {"x": D.Frontend(F.lower, letters, ones), "y": D.Frontend(F.lower, letters, short), "en": D.Frontend(F.lower, D.characters)}
    table, rejects = _table(spark, lines, ["a", "b"], frontends=fronts, mapping={"x": "x", "y": "y"})
    assert set(table) == {"a", "d"} and rejects == {"b": "word2ph_sum", "c": "word2ph_length"}
    w = spark.createDataFrame([(["a"], [None]), (["a"], [1])], "phones array<string>, word2ph array<int>")
    assert [r["reject_reason"] for r in D.check_word2ph(w).collect()] == ["word2ph_sum", None]
