"""Set operations on corpus tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.labels import strip_ws


# U1 ---------------------------------------------------------------------------

def merge_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """Shard outputs as one table (by column name).  Shards written under
    one folder are simply read together; this covers in-memory shards."""
    if not shards:
        raise ValueError("no shards")
    return reduce(lambda a, b: a.unionByName(b), shards)


# U2 ---------------------------------------------------------------------------

def key_diff(standard: DataFrame, used: DataFrame, key: str = "key",
             used_key: str | None = None) -> DataFrame:
    """``unused`` = standard − used, ``missing`` = used − standard (distinct keys)."""
    s = standard.select(F.col(key).alias("key")).distinct()
    u = used.select(F.col(used_key or key).alias("key")).distinct()
    unused = s.join(u, "key", "left_anti").withColumn("side", F.lit("unused"))
    missing = u.join(s, "key", "left_anti").withColumn("side", F.lit("missing"))
    return unused.unionByName(missing)


# U3 ---------------------------------------------------------------------------

def upsample_small(df: DataFrame, min_num: int = 100) -> DataFrame:
    """When the table has fewer than ``min_num`` rows repeat it
    ``max(2, int(min_num / n))`` times; an empty table stays empty.

    The row count is a scalar subquery; each row is repeated by
    ``explode(sequence)`` where it lives, so nothing is collected.
    """
    n = df.select(F.count(F.lit(1))).scalar()
    times = (F.when(n >= F.lit(min_num), F.lit(1))
              .otherwise(F.greatest(F.lit(2), F.floor(F.try_divide(F.lit(min_num), n)).cast("int"))))
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(1), times.cast("int"))))


# U4 ---------------------------------------------------------------------------

def _next_path(path_col):
    stem = F.regexp_replace(path_col, r"\.[^./]*\z", "")
    return F.concat(stem, F.lit("_00.wav"))


def apply_label_edits(labels: DataFrame, edits: DataFrame, key: str = "key",
                      order_col: str = "pos", text_col: str = "text", path_col: str = "path",
                      samples_col: str = "n_samples", sample_rate: int = 32000) -> DataFrame:
    """U4: apply an edit log to a label table.

    ``edits``: ``key, op, new_text, break_sec`` with op in update / delete /
    split.  Update sets ``strip(new_text) + ' '``; delete removes the row;
    split cuts the row's audio at ``break_sec`` when ``1 <= frame < n`` into
    the row (first part) and a new row right after it (second part, path
    ``<stem>_00.wav``, same text).  Rows without edits are kept.  Several
    edits on one key apply as delete > split > update.
    """
    e = edits.groupBy(F.col(key).alias(key)).agg(
        F.max(F.when(F.col("op") == "delete", True)).alias("_del"),
        F.max_by(F.when(F.col("op") == "update", F.col("new_text")),
                 F.when(F.col("op") == "update", F.lit(1))).alias("_upd"),
        F.max(F.when(F.col("op") == "split", F.col("break_sec"))).alias("_brk"))
    j = labels.join(e, key, "left").where(F.col("_del").isNull())
    text = F.when(F.col("_upd").isNotNull(), F.concat(strip_ws(F.col("_upd")), F.lit(" "))).otherwise(F.col(text_col))
    j = j.withColumn(text_col, text)
    frame = F.floor(F.col("_brk") * F.lit(sample_rate)).cast("long")
    ok = F.col("_brk").isNotNull() & (frame >= 1) & (frame < F.col(samples_col))
    first = j.withColumn(samples_col, F.when(ok, frame).otherwise(F.col(samples_col))) \
             .withColumn("part", F.lit(0))
    second = (j.where(ok)
                .withColumn(path_col, _next_path(F.col(path_col)))
                .withColumn(samples_col, F.col(samples_col) - frame)
                .withColumn("part", F.lit(1)))
    return first.unionByName(second).drop("_del", "_upd", "_brk")


def invert_selection(all_keys: DataFrame, selected: DataFrame, key: str = "key") -> DataFrame:
    """Complement of a selection: every key that was not selected."""
    return all_keys.join(selected.select(key), key, "left_anti")
