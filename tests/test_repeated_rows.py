"""Numbering over rows that repeat, with null ids and ties: one row out for each row in, equal to plain loops."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sonaframe.operators import filters, sorts, windows
from sonaframe.util import rank
from sonaframe.util.rank import global_row_number, rank_within


def md5_of(*parts, seed=0):
    return hashlib.md5(":".join([*(str(p) for p in parts if p is not None), str(seed)]).encode()).hexdigest()


def first_null(v):
    return (v is not None, v if v is not None else 0)


@pytest.fixture(scope="module")
def rows():
    """(id, number, name): some rows two to nine times, null ids, equal numbers."""
    r = random.Random(8)
    out = [(i, r.choice((0.5, 1.5, 3.0, 9.0, 30.0)), f"e{r.randrange(30)}x{r.randrange(3)}") for i in range(40)]
    out += [(None, 1.5, "e7"), (None, 1.5, "e7"), (None, 9.0, None)]
    for k in (2, 5, 9):
        out += [out[k]] * (k - 1)
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame([(i, s, n, {"a": 1}) for i, s, n in rows], "id long, sec double, name string, extra map<string,int>").repartition(4).persist()


def counted(got):
    return collections.Counter(tuple(x) for x in got.collect())


def test_numbers_are_a_permutation(df, rows, monkeypatch):
    want = collections.Counter((i, s, n, k + 1) for k, (i, s, n) in enumerate(sorted(rows, key=lambda x: (first_null(x[1]), first_null(x[0]), first_null(x[2])))))
    for block in (100_000, 2):
        monkeypatch.setattr(rank, "COPY_ROWS", block)
        got = global_row_number(df, ["sec", "id"], "rn").select("id", "sec", "name", "rn")
        assert sorted(x["rn"] for x in got.collect()) == list(range(1, len(rows) + 1))
        # rows that differ only outside the order may come either way; the order itself is kept
        assert counted(got.select("id", "sec")) == collections.Counter((i, s) for i, s, _ in rows)
        by = sorted(got.collect(), key=lambda x: x["rn"])
        assert [(x["sec"], x["id"]) for x in by] == [(s, i) for i, s, n, _ in sorted(want.elements(), key=lambda x: x[3])]


def test_same_key_with_other_columns(spark):
    """Thousands of rows under one key, each different: none is lost and none gathered."""
    d = spark.range(3000).select((F.col("id") % 2).alias("k"), F.concat(F.lit("t"), F.col("id")).alias("text")).unionByName(
        spark.range(50).select(F.lit(0).cast("long").alias("k"), F.lit("t0").alias("text")))
    got = global_row_number(d, ["k"], "rn")
    assert sorted(x["rn"] for x in got.collect()) == list(range(1, 3051))
    assert counted(got.select("k", "text")) == counted(d)
    assert got.where("k = 0").agg(F.max("rn")).first()[0] == 1550


def test_shards_and_splits(df, rows):
    got = filters.shard_of(df, ["sec", "id", "name"], 3)
    order = sorted(rows, key=lambda x: (first_null(x[1]), first_null(x[0]), first_null(x[2])))
    assert counted(got.select("id", "sec", "name", "shard")) == collections.Counter((i, s, n, k % 3) for k, (i, s, n) in enumerate(order))
    assert sum(filters.shard_filter(df, ["sec", "id", "name"], k, 3).count() for k in range(3)) == len(rows)
    split = counted(filters.train_val_split(df, "id", 0.25, seed=0).select("split"))
    assert split[("val",)] == -(-len(rows) // 4) and sum(split.values()) == len(rows)


def test_length_buckets(df, rows):
    want, bucket, limit = collections.Counter(), 0, 2.0
    for i, s, _ in sorted(rows, key=lambda x: (x[1], first_null(x[0]))):
        if s >= limit:
            bucket, limit = bucket + 1, limit + 2.0
        want[(i, s, bucket)] += 1
    assert counted(windows.length_buckets(df, "sec", "id", block_rows=5).select("id", "sec", "bucket")) == want


def test_bucket_pad_and_grouped_batches(df, rows):
    d = df.withColumn("bucket", F.when(F.col("sec") > 8, F.lit(None)).otherwise(F.floor("sec")))
    key = lambda i: (md5_of(i), first_null(i))
    of = collections.defaultdict(list)
    for i, s, n in rows:
        of[None if s > 8 else int(s)].append((i, s, n))
    want = collections.Counter()
    for b, own in of.items():
        ids = sorted((x[0] for x in own), key=key)
        for p in range(-(-len(ids) // 4) * 4):
            want[(b, ids[p % len(ids)], p)] += 1
    got = windows.bucket_pad(d, "bucket", "id", replicas=2, batch_size=2)
    assert counted(got.select("bucket", "id", "padded_pos")) == want
    flat = [(b, i) for b in sorted(of, key=first_null) for i in sorted((x[0] for x in of[b]), key=key)]
    groups = collections.defaultdict(list)
    for p, x in enumerate(flat):
        groups[p // 4].append(x)
    order = sorted(groups, key=lambda g: (md5_of(g), g))
    want = collections.Counter((i, p) for p, (_, i) in enumerate(x for g in order for x in groups[g]))
    got = windows.grouped_batches(d, "bucket", "id", batch_size=2, replicas=2)
    assert counted(got.select("id", "order_pos")) == want


def test_natural_sort_and_ranks_within(df, rows):
    got = sorts.natural_sort(df.where("name is not null"), "name", "id")
    named = [x for x in rows if x[2] is not None]
    assert sorted(x["rank"] for x in got.collect()) == list(range(1, len(named) + 1))
    natural = lambda n: [int(p) if p.isdigit() else p for p in __import__("re").split(r"(\d+)", n)]
    want = sorted(named, key=lambda x: (natural(x[2]), x[2], first_null(x[0])))
    assert [(x["name"], x["id"]) for x in sorted(got.collect(), key=lambda x: x["rank"])] == [(n, i) for i, _, n in want]
    within = rank_within(df, ["name"], ["sec"], "pos")
    of = collections.defaultdict(list)
    for x in within.collect():
        of[x["name"]].append(x["pos"])
    assert sum(map(len, of.values())) == len(rows) and all(sorted(v) == list(range(1, len(v) + 1)) for v in of.values())


def test_newest_of_a_group_counts_a_repeated_row_once(spark):
    rows = [("a", 3, "m3")] * 3 + [("a", 2, "m2"), ("a", 1, "m1"), ("a", 0, "x_0.pth"), (None, 1, "n1"), (None, 1, "n1")]
    got = windows.latest_n_per_group(spark.createDataFrame(rows, "g string, t long, name string"), "g", "t", "name", n=2)
    assert counted(got.select("name", "keep")) == {("m3", True): 3, ("m2", True): 1, ("m1", False): 1, ("x_0.pth", True): 1, ("n1", True): 2}
