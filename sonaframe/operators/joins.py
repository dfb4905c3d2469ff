"""Joins between corpus stores.

Large-with-large joins are left to Catalyst (sort-merge, AQE may convert to a
broadcast at run time and splits skewed partitions).  Lookup tables are
broadcast only after a bounded size check.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..util.rank import global_row_number
from .udf import computed_once

REASON_NOT_IN = "not_in"


# J1 ---------------------------------------------------------------------------

def pair_join(tokens: DataFrame, phonemes: DataFrame, key: str = "item_name",
              phon_key: str | None = None) -> DataFrame:
    """Every token row with its phoneme row (unique per key) or ``matched`` false.

    A left join, so one pass gives the pairs and the ``not_in`` count.
    """
    pk = phon_key or key
    right = phonemes.withColumnRenamed(pk, "_pk").withColumn("_matched", F.lit(True))
    out = tokens.join(right, tokens[key] == right["_pk"], "left").drop("_pk")
    return out.withColumn("matched", F.coalesce(F.col("_matched"), F.lit(False))).drop("_matched")


# J2 / J3 / J4 --------------------------------------------------------------------

def key_intersection(phonemes: DataFrame, features: DataFrame, audio: DataFrame,
                     key: str = "name", feature_suffix_len: int = 3) -> DataFrame:
    """Keys present in all three stores; feature names lose a suffix first."""
    p = phonemes.select(F.col(key).alias("key")).distinct()
    f = features.select(F.expr(f"substring({key}, 1, length({key}) - {feature_suffix_len})").alias("key"))
    a = audio.select(F.col(key).alias("key"))
    return p.join(f, "key", "left_semi").join(a, "key", "left_semi")


def skip_done(items: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    """Items whose output does not exist yet."""
    dk = done_key or key
    return items.join(done.select(F.col(dk).alias(key)), key, "left_anti")


def step_done(output: DataFrame, min_lines: int = 2) -> bool:
    """J3 (whole step): an output table with at least ``min_lines`` rows counts as done."""
    return output.limit(min_lines).count() >= min_lines


def step_files_done(spark, path: str, min_lines: int = 2, min_bytes: int = 31) -> bool:
    """J3 for a merged text output: done when it has ``min_lines`` lines and
    ``min_bytes`` bytes (file sizes come from the listing, content unread)."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        size = files.agg(F.sum("length")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return size >= min_bytes and spark.read.text(path).limit(min_lines).count() >= min_lines


def require_upstream(items: DataFrame, upstream: DataFrame, key: str,
                     upstream_key: str | None = None) -> DataFrame:
    """Items whose upstream feature exists."""
    uk = upstream_key or key
    return items.join(upstream.select(F.col(uk).alias(key)), key, "left_semi")


# J5 ---------------------------------------------------------------------------

def optional_feature(items: DataFrame, features: DataFrame, key: str, length_col: str,
                     feature_col: str = "feature", fill: float = 0.0) -> DataFrame:
    """Attach an optional feature array of the item's length.

    Missing → ``fill`` repeated ``length`` times; present with another length →
    ``reject_reason = 'feature_length'`` (the reference raises).
    """
    f = features.select(F.col(key), F.col(feature_col).alias("_f"))
    out = items.join(f, key, "left")
    n = F.col(length_col).cast("int")
    filled = F.coalesce(F.col("_f"), F.array_repeat(F.lit(fill).cast("double"), n))
    bad = F.col("_f").isNotNull() & (F.size("_f") != n)
    return (out.withColumn(feature_col, filled)
               .withColumn("feature_missing", F.col("_f").isNull())
               .withColumn("reject_reason", F.when(bad, F.lit("feature_length")))
               .drop("_f"))


# J7 ---------------------------------------------------------------------------

#: A lookup table of at most this many bytes goes to the tasks; larger ones meet the symbols in a join.
IN_PLACE_BYTES = 32 << 20
#: Rows whose symbols are looked up together when the table is larger.
CHUNK_ROWS = 4096


def _replace(arrays: pa.Array, keys: pa.Array, values: pa.Array) -> pa.Array:
    """Arrays with every element replaced by the value of its key (null when it has none)."""
    flat = arrays.flatten()
    if flat.type != keys.type:
        keys = keys.cast(flat.type)
    found = values.take(pc.index_in(flat, value_set=keys))
    sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, found, mask=arrays.is_null() if arrays.null_count else None)


def lookup_arrays(df: DataFrame, arr_col: str, entries: DataFrame, key_col: str, value_col: str, out_col: str,
                  in_place_bytes: int = IN_PLACE_BYTES) -> DataFrame:
    """``arr_col`` with every element replaced by its value in ``entries`` (null when it has none), for tables of any size.

    ``entries`` are measured.  A table of up to ``in_place_bytes`` goes to
    the tasks as one sorted dictionary, and every Arrow batch of arrays is
    replaced where it lies: no row moves and only this column reaches Python.
    For a larger table the rows are packed into chunks, only a chunk's
    distinct elements go to the join, and its own dictionary comes back to it.
    Both give the same result.  Null arrays give null; a key that stands
    twice takes its smallest value; rows may repeat.
    """
    element = df.schema[arr_col].dataType.elementType
    table = entries.select(F.col(key_col).cast(element).alias("key"), F.col(value_col).alias("value")) \
        .where("key is not null").groupBy("key").agg(F.min("value").alias("value"))
    kind = T.ArrayType(table.schema["value"].dataType)
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("key", "value"))) + 16)).first()[0] or 0
    if size > in_place_bytes:
        return _lookup_in_chunks(df, arr_col, table, kind, out_col)
    got = table.toArrow().sort_by("key").combine_chunks()
    keys, values = (pa.concat_arrays(got.column(c).chunks) if got.num_rows else pa.array([], got.schema.field(c).type) for c in ("key", "value"))

    @F.arrow_udf(returnType=kind)
    def replaced(arrays: pa.Array) -> pa.Array:
        return _replace(arrays, keys, values)

    # a filter on the result would have the function run once more
    return computed_once(df.withColumn(out_col, replaced(F.col(arr_col))), out_col)


def _lookup_in_chunks(df: DataFrame, arr_col: str, table: DataFrame, kind: T.ArrayType, out_col: str) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    element = T.ArrayType(df.schema[arr_col].dataType.elementType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK_ROWS):
                part = pa.Table.from_batches([b.slice(lo, CHUNK_ROWS)]).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(part)
                symbols = pc.unique(pa.concat_arrays([c.flatten() for c in part.column(arr_col).chunks] or [pa.array([], part.schema.field(arr_col).type.value_type)]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([(TaskContext.get().partitionId() << 32) + seq]),
                    pa.ListArray.from_arrays(pa.array([0, len(symbols)], pa.int32()), symbols), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                    names=["chunk", "symbols", "rows"])
                seq += 1

    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("symbols", element), T.StructField("rows", T.BinaryType())])
    chunks = df.mapInArrow(pack, schema).checkpoint()  # pins the chunk numbers
    found = chunks.select("chunk", F.explode("symbols").alias("key")).join(table, "key").groupBy("chunk").agg(
        F.collect_list("key").alias("keys"), F.collect_list(F.struct("value")).alias("values"))
    names = [*[c for c in df.columns if c != out_col], out_col]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, values = b.column(1), b.column(2)
                keys = pa.concat_arrays([keys.slice(i, 1).flatten()])
                values = pc.struct_field(pa.concat_arrays([values.slice(i, 1).flatten()]), 0)
                for part in pa.ipc.open_stream(b.column(0)[i].as_buffer()):
                    old = {n: part.column(n) for n in part.schema.names}
                    yield pa.RecordBatch.from_arrays([*[old[n] for n in names[:-1]], _replace(old[arr_col], keys, values)], names=names)

    out = T.StructType([*[f for f in df.schema.fields if f.name != out_col], T.StructField(out_col, kind)])
    return chunks.join(found, "chunk", "left").select("rows", "keys", "values").mapInArrow(unpack, out)


def vocab_encode(df: DataFrame, tokens_col: str, vocab: DataFrame,
                 symbol_col: str = "symbol", id_col: str = "id", policy: str = "reject",
                 unk_symbol: str = "UNK", out_col: str = "ids", in_place_bytes: int = IN_PLACE_BYTES) -> DataFrame:
    """Symbols → ids.

    policy ``reject``: an unknown symbol rejects the row (``reject_reason``
    = 'not_in', ids null); ``unk``: unknown → id of ``unk_symbol``; ``drop``:
    unknown symbols are removed.  Null token arrays give null ids;
    vocabularies of every size give the same (``lookup_arrays``).
    """
    if policy not in ("reject", "unk", "drop"):
        raise ValueError(policy)
    out = lookup_arrays(df, tokens_col, vocab, symbol_col, id_col, "_ids", in_place_bytes)
    ids = F.col("_ids")
    if policy == "reject":
        unknown = F.exists(ids, lambda x: x.isNull())
        out = out.withColumn(out_col, F.when(~unknown, ids)).withColumn(
            "reject_reason", F.when(unknown, F.lit(REASON_NOT_IN)))
    elif policy == "unk":
        unk = vocab.where(F.col(symbol_col) == unk_symbol).select(F.max(id_col)).scalar()
        # a scalar subquery cannot sit inside a lambda
        out = out.withColumn("_unk", unk).withColumn(out_col, F.transform("_ids", lambda x: F.coalesce(x, F.col("_unk")))).drop("_unk")
    else:
        out = out.withColumn(out_col, F.filter(ids, lambda x: x.isNotNull()))
    return out.drop("_ids")


def vocab_decode(df: DataFrame, ids_col: str, vocab: DataFrame, symbol_col: str = "symbol",
                 id_col: str = "id", out_col: str = "symbols", in_place_bytes: int = IN_PLACE_BYTES) -> DataFrame:
    """J7 inverse: ids → symbols (unknown id → null)."""
    return lookup_arrays(df, ids_col, vocab, id_col, symbol_col, out_col, in_place_bytes)


def symbol_vocabulary(symbols: DataFrame, symbol_col: str = "symbol") -> DataFrame:
    """Sorted distinct symbols with id = rank from 0."""
    d = symbols.select(F.col(symbol_col).alias("symbol")).distinct()
    ranked = global_row_number(d, ["symbol"], "_rn")
    return ranked.select("symbol", (F.col("_rn") - 1).cast("int").alias("id"))


# J8 ---------------------------------------------------------------------------

def catalog_reconcile(catalog: DataFrame, standard: DataFrame, locale_col: str = "locale",
                      key_col: str = "key", value_col: str = "value") -> DataFrame:
    """Every locale gets exactly the standard keys; a missing key takes value = key.

    The distinct locales (languages) become one array, which is exploded next
    to each standard key; the catalog side is an ordinary equi join.
    """
    locales = catalog.select(F.sort_array(F.collect_set(locale_col))).scalar()
    std = standard.select(F.col(key_col).alias("key")).distinct()
    wanted = std.withColumn("_locales", locales).select("key", F.explode("_locales").alias("locale"))
    cat = catalog.select(F.col(locale_col).alias("locale"), F.col(key_col).alias("key"),
                         F.col(value_col).alias("value"))
    return wanted.join(cat, ["locale", "key"], "left").select(
        "locale", "key", F.coalesce(F.col("value"), F.col("key")).alias("value"),
        F.col("value").isNull().alias("added"))
