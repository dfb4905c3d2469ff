"""Sorts, pages and picks.

Global orders are range-partitioned sorts (``orderBy``) or
``global_row_number``; per-group picks are aggregates (``max_by``), never a
window over an unbounded group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..util.rank import global_row_number, md5_unit


# O1 ---------------------------------------------------------------------------

def sort_by_length(df: DataFrame, len_col: str, id_col: str) -> DataFrame:
    """O1: whole table ordered by (length, id); a range-partitioned sort."""
    return df.orderBy(F.col(len_col), F.col(id_col))


def rank_in_batch(df: DataFrame, batch_col: str, len_col: str, id_col: str,
                  out_col: str = "pos") -> DataFrame:
    """O1: position inside each batch by length descending (batches are small)."""
    w = Window.partitionBy(batch_col).orderBy(F.col(len_col).desc(), F.col(id_col))
    return df.withColumn(out_col, (F.row_number().over(w) - 1).cast("long"))


# O2 ---------------------------------------------------------------------------

def page(df: DataFrame, order_cols: Sequence[str], index: int, batch: int) -> DataFrame:
    """O2: rows ``[index, index + batch)`` of the order (0-based).

    A sort with an offset and a limit; only the page's own rows are numbered.
    For deep pages use ``keyset_page``, or write a ``PagedTable`` once.
    """
    rows = df.orderBy(*order_cols).offset(index).limit(batch)
    w = Window.orderBy(*order_cols)  # at most ``batch`` rows
    return rows.withColumn("row_index", (F.row_number().over(w) - 1 + F.lit(index)).cast("long"))


def next_index(index: int, batch: int, n: int) -> int:
    """O2: next page start; stays when it would pass the last row."""
    return index + batch if index + batch <= n - 1 else index


def previous_index(index: int, batch: int) -> int:
    """O2: previous page start, clamped to 0."""
    return index - batch if index - batch >= 0 else 0


def keyset_page(df: DataFrame, order_col: str, after: object | None, batch: int) -> DataFrame:
    """O2 for deep pages: rows after the last seen key (top-k per partition)."""
    d = df if after is None else df.where(F.col(order_col) > F.lit(after))
    return d.orderBy(order_col).limit(batch)


class PagedTable:
    """O2 for any page of a large table: a copy in range order with a directory of its parts.

    ``write`` range partitions the rows by ``order_cols`` (a total order, but
    for rows that are equal), sorts every part and stores it as a folder of
    its own; each row carries its part and its place there.  The directory, one
    row a part, is counted from the written rows, so that it and they come
    from the same assignment.  ``page`` looks up which parts hold the wanted
    rows and reads those only, whatever the page's depth: the work follows the
    page and the part size, not the table.

    An empty table has no parts and gives empty pages; an index past the end
    gives an empty page, one below 0 is an error.  Nulls sort first, as in
    ``orderBy``.  Rows that repeat each have a place.  Columns of the table
    must not be called ``_part``, ``_place`` or ``row_index``.
    """

    _OWN = ("_part", "_place", "row_index")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def write(cls, df: DataFrame, order_cols: Sequence[str], path: str, part_rows: int = 1_000_000) -> "PagedTable":
        clash = [c for c in df.columns if c.lower() in cls._OWN]
        if clash:
            raise ValueError(f"columns {clash} are the paged table's own")
        table = cls(df.sparkSession, path)
        parts = max(1, -(-df.count() // part_rows))
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        df.repartitionByRange(parts, *order_cols).sortWithinPartitions(*order_cols) \
            .withColumns({"_part": F.spark_partition_id(), "_place": place}) \
            .write.mode("overwrite").partitionBy("_part").parquet(f"{table.path}/rows")
        df.limit(0).write.mode("overwrite").parquet(f"{table.path}/columns")
        counts = table._rows().groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
        # one row a part: a window over all of them is bounded by their number
        before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        counts.select("_part", "n", F.coalesce(before, F.lit(0)).cast("long").alias("first")) \
            .coalesce(1).write.mode("overwrite").parquet(f"{table.path}/directory")
        return table

    def _rows(self) -> DataFrame:
        own = StructType([StructField("_place", LongType()), StructField("_part", IntegerType())])
        fields = self.spark.read.parquet(f"{self.path}/columns").schema.fields + own.fields
        return self.spark.read.schema(StructType(fields)).parquet(f"{self.path}/rows")

    def directory(self) -> DataFrame:
        """``_part, n, first``: rows of a part, and rows before it."""
        return self.spark.read.parquet(f"{self.path}/directory")

    def count(self) -> int:
        """Rows of the table, from the directory."""
        return self.directory().agg(F.sum("n")).first()[0] or 0

    def parts_of(self, index: int, batch: int) -> dict[int, int]:
        """The parts that hold rows ``[index, index + batch)``, each with the rows before it."""
        if index < 0 or batch < 0:
            raise ValueError("index and batch must not be negative")
        hit = self.directory().where((F.col("first") < index + batch) & (F.col("first") + F.col("n") > index))
        return {r["_part"]: r["first"] for r in hit.collect()}  # at most batch / part_rows + 2, but for parts of few rows

    def page(self, index: int, batch: int) -> DataFrame:
        """O2: rows ``[index, index + batch)`` in order, with ``row_index`` (0-based)."""
        parts = self.parts_of(index, batch)
        rows = self._rows().where(F.col("_part").isin(*parts) if parts else F.lit(False))
        row = F.col("_place")
        for part, first in parts.items():
            row = F.when(F.col("_part") == part, F.col("_place") + F.lit(first)).otherwise(row)
        rows = rows.withColumn("row_index", row.cast("long")).where((F.col("row_index") >= index) & (F.col("row_index") < index + batch))
        return rows.drop("_part", "_place").orderBy("row_index")


# O3 ---------------------------------------------------------------------------

def number_key(digits: Column) -> Column:
    """A sort key of a digit string of any length: count of digits without leading zeros, then those digits; null stays null."""
    own = F.ltrim(digits, F.lit("0"))
    return F.when(digits.isNotNull(), F.struct(F.length(own).alias("size"), own.alias("digits")))


def natural_key(c: Column | str) -> Column:
    """O3: digits compare as numbers of any length ("e2" < "e10").

    ``array<struct<t: text part, n: key of the following number>>``; arrays
    of structs compare element-wise like the reference's mixed lists.
    """
    x = F.col(c) if isinstance(c, str) else c
    texts = F.split(x, r"\d+", -1)
    nums = F.regexp_extract_all(x, F.lit(r"\d+"), 0)
    return F.transform(texts, lambda t, i: F.struct(t.alias("t"), number_key(F.get(nums, i)).alias("n")))


def natural_sort(df: DataFrame, col: str, id_col: str, out_col: str = "rank") -> DataFrame:
    ranked = global_row_number(df.withColumn("_nk", natural_key(col)), ["_nk", col, id_col], out_col, key=[id_col])
    return ranked.drop("_nk")


# O4 ---------------------------------------------------------------------------

CKPT_RE = r"^epoch=(\d+)-step=(\d+)\.ckpt"


def newest_by_epoch_step(df: DataFrame, name_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """The name with the largest (epoch, step); names not matching are ignored."""
    e = F.regexp_extract(F.col(name_col), CKPT_RE, 1)
    s = F.regexp_extract(F.col(name_col), CKPT_RE, 2)
    # ties: the smallest name (the reference keeps input order)
    m = df.where(F.col(name_col).rlike(CKPT_RE)).groupBy(*group_cols, F.struct(number_key(e), number_key(s)).alias("_at")) \
        .agg(F.min(name_col).alias("_name"))
    g = m.groupBy(*group_cols) if group_cols else m.groupBy()
    return g.agg(F.max_by("_name", "_at").alias("newest"))


def digits_key(c: Column | str) -> Column:
    """Sort key of the number that all digits of the name make (null when there are none; the reference fails)."""
    x = F.col(c) if isinstance(c, str) else c
    d = F.regexp_replace(x, r"\D", "")
    return number_key(F.when(d != "", d))


def newest_by_digits(df: DataFrame, name_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Last name when sorted by the number made of all its digits."""
    g = df.groupBy(*group_cols) if group_cols else df.groupBy()
    return g.agg(F.max_by(F.col(name_col), F.struct(digits_key(name_col), F.col(name_col))).alias("newest"))


# O5 ---------------------------------------------------------------------------

def head_sample(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """First ``n`` rows in file order (the limit is the feature)."""
    return df.orderBy(order_col).limit(n)


# O6 ---------------------------------------------------------------------------

def weighted_pick(df: DataFrame, group_cols: Sequence[str], item_col: str, prob_col: str,
                  id_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """One draw per group, argmax of ``p / Exp(1)``; ``Exp(1) = -ln(u)``, u from md5.

    A grouped ``max_by``: partial aggregation keeps a hot group cheap.
    """
    u = md5_unit(*id_cols, seed=seed)
    score = F.col(prob_col) / (-F.ln(F.greatest(u, F.lit(1e-300))))
    return df.groupBy(*group_cols).agg(
        F.max_by(F.col(item_col), F.struct(score, F.col(item_col))).alias("picked"))
