"""Round trips of the file layouts, label edge cases and the layered lexicon."""

import tempfile

from pyspark.sql import functions as F

from sonaframe.operators import lexicon as L
from sonaframe.sources import labels, tables


def test_label_fields(spark):
    lines = ["a.wav|spk|en|hello", "a|b|c", "a|b|c|d|e", "x.wav|s|EN|", "x.wav|s|en|again"]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "line_no long, line string")
    out = {r["line_no"]: r for r in labels.parse_label_lines(df).collect()}
    assert out[0]["text"] == "hello" and out[0]["reject_reason"] is None
    assert out[1]["reject_reason"] == "field_count" and out[2]["reject_reason"] == "field_count"
    assert out[3]["text"] == "" and out[3]["reject_reason"] is None     # trailing empty field counts


def test_label_list_round_trip(spark):
    d = tempfile.mkdtemp(prefix="sona-test-")
    df = spark.createDataFrame([("a.wav", "s", "en", " hi "), ("b.wav", "s", "zh", "你好")],
                               "path string, speaker string, lang string, text string")
    labels.write_label_list(df, d + "/labels")
    back = labels.read_label_list(spark, d + "/labels")
    rows = sorted((r["path"], r["lang"], r["text"]) for r in back.collect())
    assert rows == [("a.wav", "EN", " hi"), ("b.wav", "ZH", "你好")]


def test_phoneme_last_line_wins_and_token_tsv(spark):
    lines = ["n1\ta b\t[1, 1]\tab", "n1\tc\tNone\tc", "bad\tline", "n2\t\t[]\t"]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "line_no long, line string")
    ph = {r["name"]: r for r in tables.parse_phoneme_lines(df).collect()}
    assert ph["n1"]["phones"] == ["c"] and ph["n1"]["word2ph"] is None
    assert ph["n2"]["word2ph"] == [] and "bad" not in ph
    d = tempfile.mkdtemp(prefix="sona-test-")
    tok = spark.createDataFrame([("x.wav", [12, 7, 7, 3])], "item_name string, ids array<int>")
    tables.write_tsv(tok, d + "/tok", header=True)
    back = tables.read_token_tsv(spark, d + "/tok").collect()
    assert back[0]["semantic_ids"] == [12, 7, 7, 3] and back[0]["bad_ids"] is False


def test_layered_lexicon(spark):
    base = spark.createDataFrame([("read", ["R", "IY1", "D"], 1), ("read", ["R", "EH1", "D"], 2),
                                  ("os", ["AA1", "S"], 3), ("cat", ["K", "AE1", "T"], 4),
                                  ("t", ["T", "IY1"], 5), ("o", ["OW1"], 6), ("p", ["P", "IY1"], 7)],
                                 "word string, phones array<string>, line_no long")
    extra = spark.createDataFrame([("read", ["X"], 1), ("dog", ["D", "AO1", "G"], 2), ("dog", ["Y"], 3)],
                                  "word string, phones array<string>, line_no long")
    hot = spark.createDataFrame([("cat", ["HOT"], 1)], "word string, phones array<string>, line_no long")
    lex = {r["word"]: r["phones"] for r in L.build_lexicon(base, extra, hot).collect()}
    assert lex["read"] == ["R", "EH1", "D"]      # base: later line wins; extra cannot override
    assert lex["dog"] == ["D", "AO1", "G"]       # extra: first line wins
    assert lex["cat"] == ["HOT"] and "os" not in lex
    names = spark.createDataFrame([("Bob", ["B", "AA1", "B"])], "word string, phones array<string>")
    toks = spark.createDataFrame([(i, w) for i, w in enumerate(["A", "Bob", "bob", "top", "cat's", "dog's",
                                                                  "zzzzzz", ",", "Tot"])],
                                 "pos long, word string")
    got = {r["word"]: (r["phones"], r["source"]) for r in
           L.lookup_words(toks, L.build_lexicon(base, extra, hot), names).collect()}
    assert got["A"] == (["EY1"], "letter")
    assert got["Bob"] == (["B", "AA1", "B"], "name")
    assert got["bob"][1] == "oov"                 # no title case, b not in letters
    assert got["top"] == (["T", "IY1", "OW1", "P", "IY1"], "spelled")
    assert got["cat's"] == (["HOT", "Z"], "possessive")
    assert got["dog's"] == (["D", "AO1", "G", "Z"], "possessive")
    assert got["zzzzzz"] == (None, "oov") and got[","] == ([","], "literal")


def test_item_listing_run_log_and_label_json_files(spark, tmp_path):
    import json
    from sonaframe.sources import corpus
    wav = tmp_path / "wav"
    wav.mkdir()
    (wav / "a.wav").write_bytes(b"\0" * 64000)       # 1 s at 32 kHz, 16-bit
    (wav / "b.wav").write_bytes(b"\0" * 44)          # header only
    (wav / "notes.txt").write_text("skip me")
    listing = {r["name"]: r for r in corpus.read_item_listing(spark, str(wav), "*.wav").collect()}
    assert set(listing) == {"a.wav", "b.wav"}
    assert listing["a.wav"]["duration"] == 1.0 and listing["a.wav"]["frames"] == 50
    assert listing["b.wav"]["frames"] == 0 and listing["b.wav"]["duration"] < 0.001

    logs = tmp_path / "logs"
    logs.mkdir()
    state = {"best_metric": 4.2493, "best_model_checkpoint": "results/checkpoint-310", "epoch": 10.0, "global_step": 310,
             "log_history": [{"epoch": 0.3, "grad_norm": 1.5, "learning_rate": 5e-5, "loss": 6.5108, "step": 10},
                             {"epoch": 0.3, "eval_loss": 4.8732, "eval_runtime": 8.07, "eval_samples_per_second": 3.2,
                              "eval_steps_per_second": 0.5, "step": 10}]}
    (logs / "trainer_state.json").write_text(json.dumps(state, indent=2))
    rows = sorted(corpus.read_run_log(spark, str(logs)).collect(), key=lambda r: r["row_no"])
    assert [r["step"] for r in rows] == [10, 10] and rows[0]["loss"] == 6.5108 and rows[1]["eval_loss"] == 4.8732
    assert rows[0]["eval_loss"] is None and rows[1]["best_metric"] == 4.2493

    jl = tmp_path / "labels.jsonl"
    jl.write_text('{"text": "你好", "wav_path": "a.wav"}\n{"text": "hi", "wav_path": "b.wav"}\nnot json\n', encoding="utf-8")
    got = sorted((r["path"], r["text"]) for r in labels.read_label_json(spark, str(jl)).collect() if r["path"])
    assert got == [("a.wav", "你好"), ("b.wav", "hi")]
    out = str(tmp_path / "json_out")
    labels.write_json(spark.createDataFrame([("a.wav", "你好")], "wav_path string, text string"), out)
    back = labels.read_label_json(spark, out).collect()
    assert back[0]["text"] == "你好" and back[0]["path"] == "a.wav"
