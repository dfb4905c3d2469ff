"""Hard negatives against brute force, with edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonaframe.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x string, anchor int, block int, row int"


def test_planes_and_tables_hold_every_component():
    r = np.random.default_rng(3)
    for dim in (1, 7, 8, 9, 64):
        for span in (1, 5, 1 << 20, 1 << 38):
            x = r.integers(-span, span + 1, (50, dim))
            planes, low = hardneg.bit_planes(x)
            assert (hardneg.rows_of_planes(planes, low, dim, np.arange(50)) == x).all()
            a = r.integers(-9, 10, (13, dim))
            assert (hardneg.Anchors(a).scores(planes, low, rows=16) == x @ a.T).all()
    with pytest.raises(ValueError):
        hardneg.Anchors(np.full((1, 8), 1 << 30)).scores(*hardneg.bit_planes(np.full((2, 8), 1 << 30)))


def brute(rows, is_anchor, k=5, scale=256):
    fine = [(i, [int(np.floor(scale * float(np.float32(v)))) for v in e], la) for i, e, la in rows
            if i is not None and e is not None and la is not None and all(v is not None and np.isfinite(v) for v in e)]
    out = []
    for n, (a, x, la) in enumerate(fine):
        if not is_anchor(a):
            continue
        mates = [(-sum(p * q for p, q in zip(x, y)), i, lb) for m, (i, y, lb) in enumerate(fine) if m != n and len(y) == len(x)]
        for ps, p, _ in sorted(m for m in mates if m[2] == la)[:k]:
            wrong = sorted(m[:2] for m in mates if m[2] != la and -80 * ps <= -100 * m[0] <= -100 * ps)[:k]
            out += [(a, p, r + 1, i, -ps, -s) for r, (s, i) in enumerate(wrong)]
    return sorted(out)


def rows_with_edges():
    r = np.random.default_rng(5)
    rows = [(i, [float(v) for v in r.normal(size=12).astype(np.float32)], int(r.integers(3))) for i in range(300)]
    rows += [(i + 300, [float(v) for v in np.round(r.normal(size=12))], int(r.integers(3))) for i in range(120)]  # many ties
    rows += [(i + 420, [1.0, 0.5], i % 3) for i in range(7)]  # another length, all equal
    rows += [(440, None, 1), (450, [1.0] * 12, None), (None, [1.0] * 12, 1), (460, [float("nan")] + [0.0] * 11, 1),
             (470, [float("inf")] + [0.0] * 11, 1), (480, [None] + [0.0] * 11, 1), (490, [], 1), (500, [0.0] * 12, 2)]
    return rows + [rows[0], rows[10], rows[10]]  # rows that repeat


def test_hard_negatives_equal_brute_force(spark):
    rows = rows_with_edges()
    df = spark.createDataFrame([(i, e, la, 1, "c", 2, 3, 4) for i, e, la in rows], SCHEMA).repartition(3)
    want = brute(rows, lambda i: i % 10 == 0)
    for sizes in ({}, {"block_rows": 16, "group_rows": 4, "cell_anchors": 8, "cell_blocks": 2}):
        got = hardneg.hard_negatives(df, F.col("id") % 10 == 0, **sizes)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, got.collect())) == want and len(want) > 300


def test_hard_negatives_of_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hardneg.hard_negatives(empty, F.col("id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1, 1, "c", 2, 3, 4)], SCHEMA)
    assert hardneg.hard_negatives(one, F.col("id") % 10 == 0).collect() == []
    assert hardneg.hard_negatives(one, F.col("id") % 10 == 1).collect() == []
