"""Global numbering, scans, buckets and shards against plain loops."""

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonaframe.operators import windows as W
from sonaframe.util.rank import global_row_number, global_scan, rank_within


def loop_buckets(secs, width=2.0):
    out, cur, limit = [], 0, width
    for s in secs:
        if s >= limit:
            cur += 1
            limit += width
        out.append(cur)
    return out


def test_length_buckets_fixture(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([0.5, 0.7, 9.1, 9.2, 50.0])], "id long, sec double")
    got = [r["bucket"] for r in W.length_buckets(df, "sec", "id", block_rows=2).orderBy("id").collect()]
    assert got == [0, 0, 1, 2, 3]


def test_length_buckets_random(spark):
    rng = random.Random(5)
    for trial in range(3):
        secs = sorted(round(rng.expovariate(0.3), 2) for _ in range(120))
        df = spark.createDataFrame([(i, s) for i, s in enumerate(secs)], "id long, sec double")
        got = [r["bucket"] for r in W.length_buckets(df, "sec", "id", block_rows=7).orderBy("id").collect()]
        assert got == loop_buckets(secs)


def test_global_row_number_with_hot_key(spark):
    rows = [(i, 7 if i % 3 == 0 else i) for i in range(500)]   # a third of the rows share one key
    df = spark.createDataFrame(rows, "id long, k long")
    got = global_row_number(df, ["k", "id"], "rn", num_partitions=6)
    ref = got.withColumn("ref", F.row_number().over(Window.orderBy("k", "id")))
    assert ref.where(F.col("rn") != F.col("ref")).count() == 0
    assert sorted(r["rn"] for r in got.collect()) == list(range(1, 501))


def test_global_scan_and_rank_within(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), rng.randint(-5, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g long, v long")
    s = global_scan(df, ["id"], F.col("v"), "min", "m", block_rows=17).orderBy("id").collect()
    run = math.inf
    for r, (_, _, v) in zip(s, rows):
        run = min(run, v)
        assert r["m"] == run
    rw = rank_within(df, ["g"], [F.col("v").desc(), F.col("id")], "pos")
    ref = rw.withColumn("ref", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc(), "id")))
    assert ref.where(F.col("pos") != F.col("ref")).count() == 0


def test_bucket_pad_and_shards_invariants(spark):
    df = spark.createDataFrame([(i, (i * 37) % 900 + 10) for i in range(97)], "id long, n long")
    b = W.bounded_buckets(df, "n")
    p = W.bucket_pad(b, "bucket", "id", replicas=2, batch_size=4)
    sizes = p.groupBy("bucket").count().collect()
    assert all(r["count"] % 8 == 0 for r in sizes)             # every bucket fills whole batches
    per_rank = p.groupBy("bucket", "replica").count().collect()
    assert len({(r["bucket"], r["count"]) for r in per_rank}) == len(sizes)   # equal shard sizes
    g = W.grouped_batches(df.withColumn("bucket", F.lit(0)), "bucket", "id", 8, 3)
    sh = W.even_shards(g, "order_pos", 3)
    counts = [r["count"] for r in sh.groupBy("rank").count().collect()]
    assert len(set(counts)) == 1 and sum(counts) == 99          # ceil(97/3)*3 with head padding
    dl = W.even_shards(g, "order_pos", 3, drop_last=True)
    assert dl.count() == 96


def test_top_k_keep_ties_and_nucleus(spark):
    rows = [(1, i, float(s)) for i, s in enumerate([5, 5, 4, 4, 4, 1])]
    df = spark.createDataFrame(rows, "g long, item long, s double")
    kept = sorted(r["item"] for r in W.top_k_keep_ties(df, ["g"], "s", 3, "item").collect())
    assert kept == [0, 1, 2, 3, 4]                              # rank() <= 3 keeps all ties
    logits = spark.createDataFrame([(1, i, x) for i, x in enumerate([3.0, 2.0, 1.0, 0.0])], "g long, item long, x double")
    a = sorted(r["item"] for r in W.nucleus_filter(logits, ["g"], "item", "x", top_p=0.7, block_rows=2).collect())
    b = sorted(r["item"] for r in W.nucleus_filter(logits, ["g"], "item", "x", top_p=0.7, inclusive=True,
                                                    block_rows=2).collect())
    # softmax(3,2,1,0) ≈ .64,.24,.09,.03: shifted keeps the first above p, inclusive does not
    assert a == [0, 1] and b == [0]


def test_equal_groups_get_equal_nucleus(spark):
    """The kept rows of a group do not depend on the groups before it."""
    df = spark.range(60_000).select(F.floor(F.col("id") / 3).alias("g"), (F.col("id") % 3).alias("item"), F.lit(1.0).alias("x"))
    for k in (0, 3):
        kept = W.nucleus_filter(df, ["g"], "item", "x", top_k=k, top_p=1 / 3, block_rows=2)
        sizes = kept.groupBy("g").count().groupBy("count").count().collect()
        assert len(sizes) == 1 and sizes[0][1] == 20_000


def test_numbering_carries_no_payload(spark):
    df = spark.createDataFrame([(i, "p" * i, None if i % 4 else i) for i in range(50)], "id long, payload string, k long")
    got = global_row_number(df, ["k", "id"], "rn")
    ref = got.withColumn("ref", F.row_number().over(Window.orderBy("k", "id")))
    assert got.count() == 50 and ref.where(F.col("rn") != F.col("ref")).count() == 0
    scans = [line for line in got._jdf.queryExecution().logical().toString().splitlines() if "RDD" in line and "payload" not in line]
    assert scans  # the checkpointed frame holds the order key alone


def test_page_past_the_end(spark):
    from sonaframe.operators.sorts import page
    df = spark.range(10)
    assert [r["row_index"] for r in page(df, ["id"], 8, 5).collect()] == [8, 9]
    assert page(df, ["id"], 20, 5).count() == 0


def test_silence_runs_across_blocks(spark):
    from sonaframe.operators.signal import silence_runs
    quiet = [0, 1, 2, 3, 4, 5, 6, 9, 12, 13, 20, 21, 22, 23, 24, 25, 26, 27, 28]
    df = spark.createDataFrame([(s, f, 0.0 if f in quiet else 1.0) for s in (1, 2) for f in range(30)], "signal_id long, frame long, rms double")
    for block in (1, 2, 3, 5, 100):
        got = sorted((r["start"], r["end"], r["length"]) for r in silence_runs(df, block_frames=block).where("signal_id = 2").collect())
        assert got == [(0, 6, 7), (9, 9, 1), (12, 13, 2), (20, 28, 9)]
