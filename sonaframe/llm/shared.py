"""Helpers shared by the operators: lineage cuts, Arrow maps, column clashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the session's shared folder (for narrow frames)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed Parquet table in the shared folder, read back.

    For frames that carry texts, which ``checkpoint()`` would store
    uncompressed.  The table lies inside the session's checkpoint folder and
    goes with it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices of a few rows, so that a task holds few texts as objects at a time, and sends small batches."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def append_columns(df: DataFrame, column: str,
                   make: Callable[[], Callable[[list], list[pa.Array]]],
                   fields: Sequence[T.StructField]) -> DataFrame:
    """``df`` with columns that a batch function computes from ``column``.

    ``make()`` runs once in each task and returns a function from a list of
    values to one Arrow array for each of ``fields``.  Columns of ``df`` that
    carry one of the new names are replaced.
    """
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *fields])
    old = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in parts(batches):
            at = {n: i for i, n in enumerate(b.schema.names)}
            new = work(b.column(at[column]).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(at[n]) for n in old] + list(new),
                                             names=old + [f.name for f in fields])

    return df.mapInArrow(run, schema)


def doc_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as a long and the text, null read as empty; nothing else of ``docs``."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bits of the map that stands for a set of ids; 2 MB whatever the size of the set.
ID_BITS = 24


def _slots(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ID_BITS)).astype(np.int64)


def id_map(ids: DataFrame, column: str) -> np.ndarray:
    """A map of ``2 ** ID_BITS`` bits that has every id of ``ids`` (and by chance others).

    It keeps rows that surely need no join out of the shuffle; its size does
    not grow with the set, a full map only lets more rows through.
    """
    def bits(batches):
        words = np.zeros(1 << (ID_BITS - 6), np.uint64)
        for b in batches:
            s = np.unique(_slots(b.column(0).to_numpy(zero_copy_only=False)))
            np.bitwise_or.at(words, s >> 6, np.uint64(1) << (s & 63).astype(np.uint64))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(words[some].view(np.int64), pa.int64())],
                                         names=["word", "bits"])

    rows = ids.select(F.col(column).cast("long")).where(f"{column} is not null").mapInArrow(bits, "word int, bits long") \
        .groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    out = np.zeros(1 << (ID_BITS - 6), np.uint64)
    for r in rows:
        out[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return out


def mapped(ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether the map has each id."""
    s = _slots(ids)
    return (words[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1


def in_map(df: DataFrame, column: str, words: np.ndarray, found: bool = True) -> DataFrame:
    """Rows of ``df`` whose id is in the map, or with ``found=False`` the others (null ids are not in it)."""
    def keep(batches):
        for b in parts(batches):
            ids = b.column(b.schema.names.index(column))
            hit = mapped(ids.fill_null(0).to_numpy(zero_copy_only=False), words)
            hit &= ids.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(hit == found))

    return df.mapInArrow(keep, df.schema)
