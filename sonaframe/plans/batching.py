"""Batch planning (W1 → W4 → W5 → R1, or W2 → W3 → R1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import pad_right
from ..operators.windows import bounded_buckets, bucket_pad, even_shards, grouped_batches, length_buckets


def plan_batches(items: DataFrame, id_col: str, sec_col: str, seq_col: str, batch_size: int,
                 replicas: int, seed: int = 0, epoch: int = 0, pad: int = 0,
                 drop_last: bool = False) -> DataFrame:
    """Length buckets → grouped shuffled batches → even shards → padded sequences.

    Output per (shard position): id, bucket, group, rank, local_idx and the
    sequence padded to the longest one of its group.  A group holds
    ``batch × replicas`` rows, so the window over it is small.
    """
    b = length_buckets(items, sec_col, id_col, 2.0, "exact")
    g = grouped_batches(b, "bucket", id_col, batch_size, replicas, seed, epoch)
    s = even_shards(g, "order_pos", replicas, drop_last)
    w = Window.partitionBy("group")
    s = s.withColumn("width", F.max(F.size(seq_col)).over(w))
    return s.withColumn("padded", pad_right(seq_col, F.col("width"), pad))


def plan_bounded_batches(items: DataFrame, id_col: str, len_col: str, seq_col: str, batch_size: int,
                         replicas: int, boundaries=None, seed: int = 0, pad: int = 0) -> DataFrame:
    """Bounded buckets → padded buckets → per (bucket, batch) right padding."""
    kw = {} if boundaries is None else {"boundaries": boundaries}
    b = bounded_buckets(items, len_col, **kw)
    p = bucket_pad(b, "bucket", id_col, replicas, batch_size, seed)
    w = Window.partitionBy("bucket", "batch_in_bucket", "replica")
    p = p.withColumn("width", F.max(F.size(seq_col)).over(w))
    return p.withColumn("padded", pad_right(seq_col, F.col("width"), pad))
