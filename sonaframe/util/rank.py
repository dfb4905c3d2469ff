"""Deterministic ordering and global numbering.

The reference draws its shuffles and splits from seeded generators that Spark
cannot reproduce.  Every random choice here is an order by
``md5(concat(cast(id as string), ':', seed))`` instead, which Spark and DuckDB
compute identically and which does not depend on partitioning.

``number_rows`` numbers rows 1..n in a total order without moving the table
into one task: rows are range partitioned on the full order key (ties are
split by the key's last column, so one hot value cannot pile into one task),
numbered inside each partition, and shifted by the row counts of the
partitions before them.  The offset table has one row per partition, so its
broadcast is bounded by the partition count, not by the data.
``global_row_number`` does this on the order key alone and joins the numbers
back, so that wide rows are neither sorted nor written.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# 13 hex digits = 52 bits: exact in a double, same in Spark and DuckDB.
_UNIT_HEX_DIGITS = 13
_UNIT_SCALE = float(1 << 52)


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_key(*parts: Column | str, seed: int | str = 42) -> Column:
    """``md5(concat_ws(':', parts..., seed))`` as a hex string."""
    cols = [_as_col(p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *cols, F.lit(str(seed))))


def md5_unit(*parts: Column | str, seed: int | str = 42) -> Column:
    """A uniform number in [0, 1) derived from ``md5_key``."""
    hexpart = F.substring(md5_key(*parts, seed=seed), 1, _UNIT_HEX_DIGITS)
    return F.conv(hexpart, 16, 10).cast("long") / F.lit(_UNIT_SCALE)


def md5_bucket(*parts: Column | str, seed: int | str = 42, buckets: int = 100) -> Column:
    """Stable bucket in ``[0, buckets)`` for scalable fractional splits."""
    return F.floor(md5_unit(*parts, seed=seed) * F.lit(buckets)).cast("long")


#: Rows of an order key that one range partition may hold.
PARTITION_ROWS = 2_000_000


def number_rows(df: DataFrame, order_cols: Sequence[Column | str], name: str = "rn",
                num_partitions: int | None = None) -> DataFrame:
    """``df`` with ``name`` = 1..n following ``order_cols`` (a total order, but for rows that are equal).

    Plan: one range exchange on the full order key, a sort inside each
    partition, ``monotonically_increasing_id`` (partition id in the upper
    bits, in-partition index in the lower 33 bits), then a reliable
    checkpoint into the session's checkpoint folder.  The checkpoint pins the
    partition assignment: range bounds come from sampling, and two
    recomputations of the exchange are not guaranteed to agree, while the
    counts per partition and the rows must come from the same assignment.
    All columns of ``df`` are written there, so pass narrow frames.  The
    number of partitions follows the number of rows; below the session's
    shuffle partitions adaptive execution may merge them.
    """
    from ..session import ensure_checkpoint_dir

    order = [_as_col(c) for c in order_cols]
    ensure_checkpoint_dir(df.sparkSession)
    if num_partitions is None:
        wanted = -(-df.count() // PARTITION_ROWS)
        num_partitions = wanted if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) else None
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    local = ranged.withColumn("_pid", F.shiftright(F.col("_mid"), 33)).withColumn(
        "_lrn", F.col("_mid") - F.shiftleft(F.col("_pid"), 33) + F.lit(1))
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: a single-task window over it is bounded
    offsets = counts.select(
        "_pid",
        F.coalesce(
            F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_off"),
    )
    out = local.join(F.broadcast(offsets), "_pid").withColumn(
        name, (F.col("_off") + F.col("_lrn")).cast("long"))
    return out.drop("_pid", "_lrn", "_off", "_mid")


_DIRECTION = re.compile(r" (ASC|DESC) NULLS (FIRST|LAST)'>$")


def _has_direction(c: Column | str) -> bool:
    """Whether an order column carries a sort direction and so is no value to select."""
    return not isinstance(c, str) and bool(_DIRECTION.search(str(c)))


#: Copies of one row that a task makes at a time.
COPY_ROWS = 100_000


def _equal(df: DataFrame, columns: Sequence[str], other: DataFrame) -> Column:
    """``columns`` equal to ``_k0, _k1, ...`` of the other frame, nulls too."""
    same = F.lit(True)
    for i, n in enumerate(columns):
        same = same & df[n].eqNullSafe(other[f"_k{i}"])
    return same


def _keyed(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """First number and count of each key, key columns as ``_k0, _k1, ...``."""
    return df.groupBy(*by).agg(F.min(name).alias(name), F.count(F.lit(1)).alias("_m")) \
        .select(*[F.col(n).alias(f"_k{i}") for i, n in enumerate(by)], name, "_m")


def _hashable(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    return F.to_json(F.struct(c)) if "map<" in df.schema[column].dataType.simpleString() else c


def _numbered_copies(wide: DataFrame, by: Sequence[str], starts: DataFrame, columns: Sequence[str], name: str,
                     most: int) -> DataFrame:
    """Rows whose key repeats, numbered from their key's first number on.

    Inside a key rows are ordered by a hash of all their columns.  Rows with
    the same hash are the same row: one of them is kept and written as many
    times as it stood, so no key is gathered in a task, whatever its count.
    """
    all_columns = [_hashable(wide, c) for c in columns]
    rows = wide.join(starts, _equal(wide, by, starts), "left_semi") \
        .withColumns({"_h1": F.xxhash64(*all_columns), "_h2": F.xxhash64(F.lit(1), *all_columns)})
    kind = [*by, "_h1", "_h2"]
    copies = _keyed(number_rows(rows.select(*kind), kind, "_r"), kind, "_r").withColumnRenamed("_m", "_n")
    base = copies.groupBy(*[f"_k{i}" for i in range(len(by))]).agg(F.min("_r").alias("_base")) \
        .select(*[F.col(f"_k{i}").alias(f"_b{i}") for i in range(len(by))], "_base")
    one = rows.dropDuplicates(kind)
    out = one.join(copies, _equal(one, kind, copies)).drop(*[f"_k{i}" for i in range(len(kind))])
    out = out.join(starts, _equal(out, by, starts)).drop(*[f"_k{i}" for i in range(len(by))])
    same = F.lit(True)
    for i, n in enumerate(by):
        same = same & out[n].eqNullSafe(base[f"_b{i}"])
    out = out.join(base, same).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPY_ROWS))))
    if most > COPY_ROWS:
        out = out.repartition("_h1", "_block")
    first = F.col("_block") * COPY_ROWS
    last = F.least(first + (COPY_ROWS - 1), F.col("_n") - 1)
    return out.withColumn("_j", F.explode(F.sequence(first, last))) \
        .select(*columns, (F.col(name) + F.col("_r") - F.col("_base") + F.col("_j")).cast("long").alias(name))


def global_row_number(df: DataFrame, order_cols: Sequence[Column | str], name: str = "rn",
                      num_partitions: int | None = None, key: Sequence[str] | None = None) -> DataFrame:
    """Add ``name`` = 1..n following ``order_cols``; one row out for each row in.

    Only the order columns (and ``key``, columns that identify a row, where
    they are fewer) are numbered, see ``number_rows``; the numbers are joined
    back to the rows on the key, or else on the order columns.  Rows that are
    equal in all of these get consecutive numbers, in an order that depends
    on their other columns only (``_numbered_copies``); whether there are any
    is found on the narrow keys, so tables without such rows pay one count.
    Columns with a sort direction cannot serve as a key: then, and when the
    frame has no other columns, the whole frame is numbered.
    """
    if any(_has_direction(c) for c in order_cols):
        return number_rows(df, order_cols, name, num_partitions)
    names = [c if isinstance(c, str) else f"_o{i}" for i, c in enumerate(order_cols)]
    wide = df.withColumns({n: c for n, c in zip(names, order_cols) if not isinstance(c, str)})
    full = list(dict.fromkeys([*(key or []), *names]))
    if set(df.columns) <= set(full):
        return number_rows(wide, names, name, num_partitions).select(*df.columns, name)
    numbered = number_rows(wide.select(*full), names, name, num_partitions)
    for by in ([list(key)] if key else []) + [full]:
        starts = _keyed(numbered, by, name)
        most = starts.agg(F.max("_m")).first()[0] or 0
        if most <= 1:
            return wide.join(starts, _equal(wide, by, starts)).select(*df.columns, name)
    single, repeated = starts.where("_m = 1"), starts.where("_m > 1")
    return wide.join(single, _equal(wide, full, single)).select(*df.columns, name).unionByName(
        _numbered_copies(wide, full, repeated, df.columns, name, most))


DEFAULT_BLOCK_ROWS = 1_000_000

_SCAN_OPS = {"min": F.min, "max": F.max, "sum": F.sum}


def global_scan(df: DataFrame, order_cols: Sequence[Column | str], value: Column | str,
                op: str = "sum", name: str = "scan", rn_col: str = "rn",
                block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Inclusive running ``op`` (sum/min/max) of ``value`` along a global order.

    Rows get ``rn`` (1..n) from ``global_row_number`` and fall into blocks of
    ``block_rows`` consecutive positions.  Each block runs its own window
    (blocks are equal-sized, so no task is larger than one block); block
    totals (n / block_rows rows) are scanned once and carried in by a
    broadcast whose size is bounded by that count.  Only positions and values
    are scanned, whatever else a row holds; the results are joined back on
    the position.  With no ``order_cols`` the frame must already carry its
    numbering in ``rn_col``.
    """
    agg = _SCAN_OPS[op]
    v = _as_col(value)
    if order_cols:
        ranked = global_row_number(df.withColumn("_v", v), order_cols, rn_col)
    else:
        ranked = df.withColumn("_v", v)
    wide, ranked = ranked.drop("_v"), ranked.select(F.col(rn_col).alias("_k0"), "_v")
    ranked = ranked.withColumn("_blk", F.floor((F.col("_k0") - 1) / F.lit(block_rows)).cast("long"))
    w_in = Window.partitionBy("_blk").orderBy("_k0").rowsBetween(Window.unboundedPreceding, 0)
    running = ranked.withColumn("_run", agg("_v").over(w_in))
    totals = ranked.groupBy("_blk").agg(agg("_v").alias("_tot"))
    # n / block_rows rows: one ordered task over them is bounded
    carry = totals.select(
        "_blk", agg("_tot").over(Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    out = running.join(F.broadcast(carry), "_blk", "left")
    if op == "sum":
        combined = F.coalesce(F.col("_carry"), F.lit(0)) + F.col("_run")
    elif op == "min":
        combined = F.least(F.col("_carry"), F.col("_run"))
    else:
        combined = F.greatest(F.col("_carry"), F.col("_run"))
    out = out.select("_k0", combined.alias(name))
    return wide.join(out, wide[rn_col] == out["_k0"]).drop("_k0")


def rank_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str],
                name: str = "pos", rn_col: str = "_grn") -> DataFrame:
    """1-based position inside each group without a window per group.

    One global numbering over (group, order) and the first number of each
    group (a grouped ``min``, partially aggregated) joined back.  A hot group
    is spread over many range partitions instead of one task; the join back
    is on the group key, whose skew AQE splits.
    """
    ranked = global_row_number(df, [*group_cols, *order_cols], rn_col)
    starts = _keyed(ranked, group_cols, rn_col).withColumnsRenamed({rn_col: "_start", "_m": "_gsize"})
    out = ranked.join(starts, _equal(ranked, group_cols, starts)).drop(*[f"_k{i}" for i in range(len(group_cols))])
    return out.withColumn(name, (F.col(rn_col) - F.col("_start") + 1).cast("long")).drop("_start")
