"""Steps whose time or memory grew with more than the rows: plans that carry, join or compute too much."""

import re

from pyspark.sql import functions as F

from sonaframe.operators import lexicon as L
from sonaframe.operators import windows as W
from sonaframe.plans.text_table import EN_TOKEN_RE, build_text_table
from sonaframe.util.rank import global_scan


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan()


def _nodes(plan):
    yield plan
    kids = plan.children()
    for i in range(kids.size()):
        yield from _nodes(kids.apply(i))


def _names(node):
    return re.findall(r"(\w+)#\d+", node.output().mkString(","))


def test_front_ends_and_symbols_are_computed_once(spark):
    texts = ["w/a.wav|s|en|hi there", "w/b.wav|s|en|hi you", "w/c.wav|s|xx|hi", "w/d.wav|en|hi", None]
    df = spark.createDataFrame(list(enumerate(texts)), "line_no long, line string")
    vocab = spark.createDataFrame([("hi", 0), ("there", 1)], "symbol string, id int")
    kw = {"mapping": {"en": "en"}}
    table, rejects = build_text_table(df, vocab, **kw)
    for out in (table, rejects):
        plan = _plan(out).toString()
        assert plan.count(EN_TOKEN_RE) == 1
        assert len(re.findall(r"ArrowEvalPython", plan)) == 1
    rows = build_text_table(df, vocab, together=True, **kw)
    assert [r["name"] for r in table.collect()] == ["a.wav"]
    assert sorted((r["name"], list(r["ids"])) for r in rows.where("reject_reason is null").collect()) == [("a.wav", [0, 1])]
    want = {("b.wav", "not_in"), ("w/c.wav|s|xx|hi", "unsupported_language"), ("w/d.wav|en|hi", "field_count")}
    got = {(r["line"], r["reject_reason"]) for r in rejects.collect()}
    assert got >= want and got == {(r["line"], r["reject_reason"]) for r in rows.where("reject_reason is not null").collect()}


def test_scan_leaves_wide_columns_out(spark):
    df = spark.range(100).select(F.col("id"), ((F.col("id") * 7) % 31).alias("v"), F.array_repeat(F.col("id"), 5).alias("payload"))
    out = global_scan(df, ["id"], F.col("v"), "min", "m", block_rows=9)
    windows = [n for n in _nodes(_plan(out)) if n.nodeName() == "Window"]
    assert windows and all("payload" not in _names(n) for n in windows)
    low = None
    for r in out.orderBy("id").collect():
        low = r["v"] if low is None else min(low, r["v"])
        assert r["m"] == low and r["payload"] == [r["id"]] * 5


def test_cut_groups_are_normalised_without_joins(spark):
    rows = [("a", i, float(x)) for i, x in enumerate([3, 3, 2, 1, 0])] + [(None, 9, 1.0), (None, 10, 0.0), ("b", 11, None), ("b", 12, 1.0)]
    df = spark.createDataFrame(rows, "g string, item int, x double")
    out = W.nucleus_filter(df, ["g"], "item", "x", top_k=3, top_p=0.6)
    assert not [n for n in _nodes(_plan(out)) if n.nodeName() == "Join"]
    got = {(r["g"], r["item"]): r["prob"] for r in out.collect()}
    # a null key has no probabilities: its first row stays, as before
    assert set(got) == {("a", 0), ("a", 1), ("b", 12), (None, 9)} and got[None, 9] is None
    assert got["a", 0] == got["a", 1] == 0.5 and got["b", 12] == 1.0


def test_words_are_replaced_in_their_texts(spark):
    lex = spark.createDataFrame([(c, [c.upper()]) for c in "bcst"] + [("cat", ["K", "AE", "T"]), ("the", ["DH", "AH"]), ("mute", [])],
                                "word string, phones array<string>")
    names = spark.createDataFrame([("rome", ["R", "OW", "M"])], "word string, phones array<string>")
    texts = [(1, ["The", "cat's", "zzzz", ",", "Rome"]), (2, ["zzzz", "cat"]), (3, []), (4, None), (5, ["mute", "the", "mute", "zzzz", "A"]),
             (6, ["mute"]), (7, ["the", "cat"]), (7, ["cat", "zzzz", "rome"]), (7, None), (None, ["bc"]), (None, ["cat"])]
    df = spark.createDataFrame(texts, "id int, words array<string>")
    tokens = df.select("id", F.posexplode("words").alias("pos", "word"))
    want = L.sentence_phones(L.lookup_words(tokens, lex, names), ["id"]).withColumn("phones", F.array_join("phones", " "))
    for rows in (df, df.where("id < 7")):
        got = L.lookup_sentences(rows, lex, names, ["id"])
        assert sorted(map(str, got.collect())) == sorted(str(r) for r in want.join(rows.select("id").distinct(), want["id"].eqNullSafe(rows["id"]), "left_semi").collect())
    plan = _plan(L.lookup_sentences(df.where("id < 7"), lex, names, ["id"]))
    assert not [n for n in _nodes(plan) if n.nodeName() in ("Join", "Generate") and "pos" in _names(n)]
