"""Bucketing, batch planning, sharding and distribution filters.

Everything that depends on a position in a global or per-group order goes
through ``global_row_number`` / ``global_scan`` / ``rank_within``, so no
window ever holds a whole table or a whole hot group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util.rank import (DEFAULT_BLOCK_ROWS, global_row_number, global_scan, md5_key,
                         rank_within)

# Default length boundaries of the bounded bucket sampler.
DEFAULT_BOUNDARIES = (32, 300, 400, 500, 600, 700, 800, 900, 1000,
                      1100, 1200, 1300, 1400, 1500, 1600, 1700, 1800, 1900)


# W1 ---------------------------------------------------------------------------

def length_buckets(df: DataFrame, sec_col: str, id_col: str, width: float = 2.0,
                   mode: str = "exact", out_col: str = "bucket",
                   block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Bucket ids of the sorted-length rule.

    exact: the limit starts at ``width`` and grows by ``width`` once per
    new bucket, so ``k_i = min(f_i, k_{i-1} + 1)`` with ``f = floor(sec/width)``,
    whose closed form is ``rn + least(0, min_{j<=i}(f_j - rn_j))``: a global
    numbering plus a running minimum.  floor: ``floor(sec/width)``, no order
    needed (equal to exact when no length gap is wider than ``width``).
    """
    f = F.floor(F.col(sec_col) / F.lit(width)).cast("long")
    if mode == "floor":
        return df.withColumn(out_col, f)
    return _length_buckets_exact(df.withColumn("_f", f), sec_col, id_col, out_col, block_rows)


def _length_buckets_exact(tmp: DataFrame, sec_col: str, id_col: str, out_col: str,
                          block_rows: int) -> DataFrame:
    # g = f - rn needs rn, so number first, then scan g along the same order
    ranked = global_row_number(tmp, [F.col(sec_col), F.col(id_col)], "_rn")
    g = ranked.withColumn("_g", F.col("_f") - F.col("_rn"))
    scanned = global_scan(g, [], F.col("_g"), "min", "_pm", rn_col="_rn", block_rows=block_rows)
    return (scanned.withColumn(out_col, (F.col("_rn") + F.least(F.lit(0), F.col("_pm"))).cast("long"))
                   .drop("_f", "_g", "_pm", "_rn"))


# W2 ---------------------------------------------------------------------------

def bounded_buckets(df: DataFrame, len_col: str, boundaries: Sequence[float] = DEFAULT_BOUNDARIES,
                    out_col: str = "bucket") -> DataFrame:
    """Bucket i when ``b[i] < len <= b[i+1]``; other rows dropped; empty
    buckets removed and ids closed up.

    The raw index is a CASE chain (codegen, no join); closing the ids needs
    the set of non-empty indices, at most ``len(boundaries)`` rows.
    """
    b = list(boundaries)
    x = F.col(len_col)
    raw = F.lit(None).cast("int")
    for i in range(len(b) - 2, -1, -1):
        raw = F.when((x > F.lit(b[i])) & (x <= F.lit(b[i + 1])), F.lit(i)).otherwise(raw)
    tagged = df.withColumn("_raw", raw).where(F.col("_raw").isNotNull())
    used = tagged.groupBy("_raw").agg(F.count(F.lit(1)).alias("_n"))
    # at most len(boundaries) - 1 rows: a single ordered task is bounded
    dense = used.select("_raw", (F.row_number().over(Window.orderBy("_raw")) - 1).cast("long").alias(out_col))
    return tagged.join(F.broadcast(dense), "_raw").drop("_raw")


# W3 ---------------------------------------------------------------------------

def bucket_pad(df: DataFrame, bucket_col: str, id_col: str, replicas: int, batch_size: int,
               seed: int = 0, epoch: int = 0, shuffle: bool = True) -> DataFrame:
    """Every bucket padded to a multiple of ``replicas × batch`` by
    repeating its own rows from the start, then split by replica and batch.

    Output rows: ``bucket, padded_pos, id, replica, batch_in_bucket``.  A row
    at in-bucket position r appears at r, r+len, r+2·len, ... below the
    padded size (``explode(sequence)`` in place, no self join).
    """
    order = [md5_key(id_col, seed=seed + epoch), F.col(id_col)] if shuffle else [F.col(id_col)]
    ranked = rank_within(df, [bucket_col], order, "_p")
    t = replicas * batch_size
    n = F.col("_gsize")
    target = n + F.pmod(F.lit(t) - F.pmod(n, F.lit(t)), F.lit(t))
    r = F.col("_p") - 1
    copies = F.floor((target - 1 - r) / n).cast("int")
    out = ranked.withColumn("_k", F.explode(F.sequence(F.lit(0), copies)))
    pos = r + F.col("_k") * n
    return (out.withColumn("padded_pos", pos.cast("long"))
               .withColumn("replica", F.pmod(F.col("padded_pos"), F.lit(replicas)).cast("long"))
               .withColumn("batch_in_bucket", F.floor(F.floor(F.col("padded_pos") / replicas) / batch_size).cast("long"))
               .drop("_p", "_k", "_gsize", "_grn"))


# W4 ---------------------------------------------------------------------------

def clamp_batch_size(batch_size: int | Column, n: Column, preference: bool = False) -> Column:
    """``max(min(b, n // 4), 1)``; halved first in preference-pair mode."""
    b = F.lit(batch_size) if isinstance(batch_size, int) else batch_size
    if preference:
        b = F.floor(b / 2)
    return F.greatest(F.least(b, F.floor(n / 4)), F.lit(1)).cast("long")


def grouped_batches(df: DataFrame, bucket_col: str, id_col: str, batch_size: int, replicas: int = 1,
                    seed: int = 0, epoch: int = 0, preference: bool = False) -> DataFrame:
    """Shuffle inside buckets, concatenate, cut into groups of
    ``batch × replicas``, shuffle the groups.

    Output: ``group`` and ``order_pos`` (0-based position in the final index
    list).  Shuffles are md5 orders of (id, seed+epoch) and (group, seed+epoch).
    """
    n = df.select(F.count(F.lit(1))).scalar()
    b = clamp_batch_size(batch_size, n, preference)
    s = seed + epoch
    ranked = global_row_number(df, [F.col(bucket_col), md5_key(id_col, seed=s), F.col(id_col)], "_rn")
    grouped = ranked.withColumn("group", F.floor((F.col("_rn") - 1) / (b * F.lit(replicas))).cast("long"))
    final = global_row_number(grouped, [md5_key("group", seed=s), F.col("group"), F.col("_rn")], "_fp")
    return final.withColumn("order_pos", (F.col("_fp") - 1).cast("long")).drop("_rn", "_fp")


# W5 ---------------------------------------------------------------------------

def even_shards(df: DataFrame, index_col: str, replicas: int, drop_last: bool = False) -> DataFrame:
    """Pad (from the head) or cut the index list to a multiple of the
    replica count; rank r takes positions r, r+R, ...

    ``index_col`` is the 0-based position in the index list (e.g. W4's
    ``order_pos``).  Output adds ``pos``, ``rank`` and ``local_idx``.
    """
    n = df.select(F.count(F.lit(1))).scalar()
    r = F.lit(replicas)
    if drop_last:
        num = F.when(F.pmod(n, r) != 0, F.ceil((n - r) / r)).otherwise(F.ceil(n / r))
        total = num * r
        out = df.where(F.col(index_col) < total).withColumn("pos", F.col(index_col).cast("long"))
    else:
        total = F.ceil(n / r) * r
        copies = F.floor((total - 1 - F.col(index_col)) / n).cast("int")
        out = df.withColumn("_k", F.explode(F.sequence(F.lit(0), copies))) \
                .withColumn("pos", (F.col(index_col) + F.col("_k") * n).cast("long")).drop("_k")
    return out.withColumn("rank", F.pmod(F.col("pos"), r).cast("long")) \
              .withColumn("local_idx", F.floor(F.col("pos") / r).cast("long"))


# W9 / W10 -----------------------------------------------------------------------

def _softmax_parts(df: DataFrame, group_cols: Sequence[str], x: str, name: str, order: Sequence[Column] | None = None) -> DataFrame:
    """Adds ``name`` = exp(x - max) / sum(exp(x - max)) per group (null in a group whose key holds a null).

    Groups of any size: grouped aggregates, joined back.  With ``order`` a
    group is bounded by a cut before, and both come from windows along it,
    which share one sort: a chain of joins in one stage would hold each
    side's sorted rows at once.
    """
    if order is not None:
        w = Window.partitionBy(*group_cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        known = F.lit(True)
        for c in group_cols:
            known = known & F.col(c).isNotNull()
        e = F.when(F.col(x).isNull(), F.lit(0.0)).otherwise(F.exp(F.col(x) - F.col("_mx")))
        j = df.withColumn("_mx", F.max(x).over(w)).withColumn("_e", e)
        return j.withColumn(name, F.when(known, F.col("_e") / F.sum("_e").over(w))).drop("_mx", "_e")
    mx = df.where(F.col(x).isNotNull()).groupBy(*group_cols).agg(F.max(x).alias("_mx"))
    j = df.join(mx, list(group_cols), "left")
    e = F.when(F.col(x).isNull(), F.lit(0.0)).otherwise(F.exp(F.col(x) - F.col("_mx")))
    j = j.withColumn("_e", e)
    den = j.groupBy(*group_cols).agg(F.sum("_e").alias("_den"))
    return j.join(den, list(group_cols), "left").withColumn(name, F.col("_e") / F.col("_den")) \
            .drop("_mx", "_e", "_den")


def _cum_in_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], value: str,
                  name: str, item_col: str, block_rows: int) -> DataFrame:
    """Inclusive running sum of ``value`` inside each group along ``order``, and the position ``_pos`` from 0.

    A group is summed in blocks of ``block_rows`` positions, each a window of
    its own, plus the totals of the group's blocks before (one row a block).
    No sum ever crosses groups, so equal groups give equal sums.
    """
    g = list(group_cols)
    ranked = rank_within(df, g, order, "_pos", rn_col="_grn").drop("_grn", "_gsize") \
        .withColumn("_pos", F.col("_pos") - 1).withColumn("_blk", F.floor(F.col("_pos") / F.lit(block_rows)))
    inside = Window.partitionBy(*g, "_blk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*g).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranked.groupBy(*g, "_blk").agg(F.sum(value).alias("_tot")).withColumn(
        "_carry", F.coalesce(F.sum("_tot").over(before), F.lit(0.0))).drop("_tot")
    return ranked.withColumn("_run", F.sum(value).over(inside)).join(totals, [*g, "_blk"]) \
        .withColumn(name, F.col("_carry") + F.col("_run")).drop("_run", "_carry", "_blk")


def _at_most(frame: DataFrame, group_cols: Sequence[str], x: str, k: int) -> DataFrame:
    """Rows whose ``x`` is not below the k-th largest of their group (ties kept).

    ``rank() <= k`` is a limit that Spark applies in every partition before
    the exchange, so a hot group sends k rows and ties from each.
    """
    w = Window.partitionBy(*group_cols).orderBy(F.col(x).desc())
    return frame.withColumn("_rank", F.rank().over(w)).where(F.col("_rank") <= F.lit(k)).drop("_rank")


def nucleus_filter(df: DataFrame, group_cols: Sequence[str], item_col: str, logit_col: str,
                   top_k: int = 0, top_p: float = 1.0, temperature: float = 1.0,
                   inclusive: bool = False, min_tokens_to_keep: int = 1,
                   block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Keep the rows of each distribution that survive top-k / top-p; adds ``prob``.

    inclusive=False (filtering variant): temperature → top-k → top-p where a
    row is kept when the cumulative probability *before* it is ≤ p (first
    row always; with ``min_tokens_to_keep`` m > 1 the first m+1 rows).
    inclusive=True (probability variant): top-p on the raw logits keeping
    rows whose cumulative probability *including* them is ≤ p (first row
    always), then temperature, then top-k.  Ties sort by item.
    """
    g = list(group_cols)
    x = "_x"
    d = df.withColumn(x, F.col(logit_col).cast("double"))
    down = [F.col(x).desc_nulls_last(), F.col(item_col)]

    def topk(frame: DataFrame, k: int) -> DataFrame:
        kk = k if inclusive else max(k, min_tokens_to_keep)
        return _at_most(frame.where(F.col(x).isNotNull()), g, x, kk)

    def topp(frame: DataFrame, shifted: bool, cut: bool) -> DataFrame:
        sm = _softmax_parts(frame, g, x, "_p", down if cut else None)
        if cut:  # a group is bounded by the top-k cut: one window
            w = Window.partitionBy(*g).orderBy(*down)
            cum = sm.withColumn("_cum", F.sum("_p").over(w.rowsBetween(Window.unboundedPreceding, 0))) \
                    .withColumn("_pos", F.row_number().over(w) - 1)
        else:
            cum = _cum_in_group(sm, g, down, "_p", "_cum", item_col, block_rows)
        if shifted:
            before = F.col("_cum") - F.col("_p")
            keep = (F.col("_pos") == 0) | (before <= F.lit(top_p))
            if min_tokens_to_keep > 1:
                keep = keep | (F.col("_pos") <= F.lit(min_tokens_to_keep))
        else:
            keep = (F.col("_pos") == 0) | (F.col("_cum") <= F.lit(top_p))
        return cum.withColumn(x, F.when(keep & F.col(x).isNotNull(), F.col(x))).drop("_p", "_cum", "_pos")

    if not inclusive:
        if temperature != 1.0:
            d = d.withColumn(x, F.col(x) / F.lit(temperature))
        if top_k > 0:
            d = topk(d, top_k)
        if top_p < 1.0:
            d = topp(d, shifted=True, cut=top_k > 0)
    else:
        if top_p is not None and top_p < 1.0:
            d = topp(d, shifted=False, cut=False)
        d = d.withColumn(x, F.col(x) / F.lit(max(temperature, 1e-5)))
        if top_k:
            d = topk(d, top_k)
    kept = d.where(F.col(x).isNotNull())
    return _softmax_parts(kept, g, x, "prob", down if top_k else None).drop(x)


def top_k_keep_ties(df: DataFrame, group_cols: Sequence[str], score_col: str, k: int,
                    item_col: str) -> DataFrame:
    """Rows whose score is ≥ the k-th largest of their group (ties kept)."""
    return _at_most(df.where(F.col(score_col).isNotNull()), list(group_cols), score_col, k)


# W11 --------------------------------------------------------------------------

def latest_n_per_group(df: DataFrame, group_col: str, order_col: str, name_col: str, n: int = 2,
                       protect_suffix: str = "_0.pth") -> DataFrame:
    """Keep the newest ``n`` of each group; names ending in the protected
    suffix are never deleted.  Adds ``keep`` (bool).  Rows that repeat group,
    order and name are one file: they count once and share its fate."""
    prot = F.coalesce(F.col(name_col).endswith(protect_suffix), F.lit(False))
    newest = Window.partitionBy(group_col).orderBy(F.col(order_col).desc(), F.col(name_col).desc())
    # the limit is applied in every partition before the exchange; n rows a group are left
    top = df.where(~prot).select(group_col, order_col, name_col).distinct().withColumn("_n", F.row_number().over(newest)) \
        .where(F.col("_n") <= F.lit(n)).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate((group_col, order_col, name_col))])
    same = F.lit(True)
    for i, c in enumerate((group_col, order_col, name_col)):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    marked = df.join(top.withColumn("_top", F.lit(True)), same, "left")
    return marked.withColumn("keep", prot | F.coalesce(F.col("_top"), F.lit(False))).drop("_0", "_1", "_2", "_top")
