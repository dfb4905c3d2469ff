"""Property tests (hypothesis) of the stateful rules against plain loops.

Each example is a whole batch of cases evaluated in one Spark job.
"""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonaframe.functions import text as T
from sonaframe.operators import windows as W
from test_text_loops import loop_cut_fifty_clean, loop_merge_short
from test_windows_rank import loop_buckets

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.floats(min_value=0, max_value=40, allow_nan=False).map(lambda x: round(x, 2)),
                min_size=1, max_size=60))
def test_length_buckets_property(spark, secs):
    secs = sorted(secs)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(secs)], "id long, sec double")
    got = [r["bucket"] for r in W.length_buckets(df, "sec", "id", block_rows=5).orderBy("id").collect()]
    assert got == loop_buckets(secs)


PIECES = st.sampled_from(["a", "bb", "ccc ", "。", ",", ".", "!", "……", "——", "你好", "x" * 30, "\n", " "])


@SETTINGS
@given(st.lists(st.lists(PIECES, min_size=0, max_size=25).map("".join), min_size=1, max_size=20))
def test_cut_fifty_property(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r["id"]: list(r["x"]) for r in df.select("id", T.cut_fifty("t").alias("x")).collect()}
    for i, t in enumerate(texts):
        if t.strip("\n") == "":
            continue
        assert got[i] == loop_cut_fifty_clean(t), repr(t)


@SETTINGS
@given(st.lists(st.lists(st.text(alphabet="ab", max_size=7), max_size=8), min_size=1, max_size=20))
def test_merge_short_property(spark, rows):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(rows)], "id int, a array<string>")
    got = {r["id"]: list(r["x"]) for r in df.select("id", T.merge_short("a", 5).alias("x")).collect()}
    for i, a in enumerate(rows):
        assert got[i] == loop_merge_short(a, 5), a


CHARS = st.sampled_from(list("ab 1.2,;?!、，。？！：…") + ["\n", "3.14", "x.y"])


@SETTINGS
@given(st.lists(st.lists(CHARS, max_size=30).map("".join), min_size=1, max_size=25))
def test_split_and_cut_punct_property(spark, texts):
    from test_text_loops import loop_cut_punct, loop_split
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = df.select("id", T.split_sentences("t").alias("s"), T.cut_punct("t").alias("p")).collect()
    for r in rows:
        t = texts[r["id"]]
        assert list(r["s"]) == loop_split(t), repr(t)
        assert list(r["p"]) == loop_cut_punct(t), repr(t)
