"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents may be long, so that the Jaccard
similarity of the two whole sets says nothing.  Items are partitioned by
their number of shingles, and for each partition windows slide over the
document in steps of ``STEP`` shingles: windows of W (16, 32, 64, ...)
shingles serve the items of at most W - 3 that are too long for the windows
half as long.  Such an item lies whole in some window, and a containment of
0.8 is a Jaccard similarity of at least 0.36 with it.  Windows and items get
``hashes`` MinHash values, each a band of its own: at 0.36, 16 of them miss
an item with a probability of 0.0008, at whole containment of 0.00002.  Items of at most five shingles are
searched by each shingle, which misses none.

1. Items are sketched in Spark; their band values mark a Bloom filter of
   fixed size, which goes to every task.
2. One pass over the documents keeps those with a window whose band value is
   marked, with these values and the document's shingle set.
3. Spark joins the values with the items' and verifies each pair by the exact
   share of the item's shingles that stand in the whole document.

Edge cases: null texts are empty; an item without words is found nowhere; an
item of under five words is one shingle, found only in a text of just these
words.  Items that repeat are reported each.  Rows with a null doc_id or
item_id take no part; rows that repeat a doc_id count as one document with
the largest share of them.  Empty tables give an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, doc_texts, parts, written
from .words import WordHashes, mixed, shingles

MAP_BITS = 24
STEP = 4
_FOLD = np.uint64(0x9E3779B97F4A7C15)
#: Shifts that take three slots of the filter from a value.
_SHIFTS = (40, 16, 0)


def window_of(n: int) -> int:
    """Length of the windows that serve an item of ``n`` shingles; 1 for single shingles."""
    if n <= 5:
        return 1
    w = 4 * STEP
    while n > w - STEP + 1:
        w *= 2
    return w


@lru_cache(maxsize=2)
def _odd(hashes: int, seed: int = 5) -> np.ndarray:
    g = np.random.default_rng(seed)
    return g.integers(1, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=64)
def _salts(hashes: int, window: int) -> np.ndarray:
    return mixed(np.arange(1, hashes + 1, dtype=np.uint64) * _FOLD + np.uint64(window))


def item_values(s: np.ndarray, hashes: int) -> np.ndarray:
    """Band values of an item's distinct shingles."""
    w = window_of(len(s))
    if w == 1:
        return mixed(s)
    return mixed((s[:, None] * _odd(hashes)).min(axis=0) ^ _salts(hashes, w))


def window_values(s: np.ndarray, windows: list[int], hashes: int, part: int = 1 << 14) -> np.ndarray:
    """Band values of all windows (of the given lengths) of a document's shingles; neighbours with equal values give one."""
    out = [mixed(s)] if 1 in windows else []
    longest = max(windows)
    if longest > 1:
        odd = _odd(hashes)
        if len(s) % STEP:
            s = np.concatenate([s, np.repeat(s[-1:], STEP - len(s) % STEP)])
        lows = []
        for i in range(0, len(s), part):  # parts of a very long text, so that memory stays small
            low = s[i: i + part: STEP, None] * odd
            for j in range(1, STEP):
                np.minimum(low, s[i + j: i + part: STEP, None] * odd, out=low)
            lows.append(low)
        low, w = np.concatenate(lows) if len(lows) > 1 else lows[0], STEP
        while w < longest:
            # windows twice as long; a text shorter than that is one window
            half = w // STEP
            low = np.minimum(low[:-half], low[half:]) if len(low) > half else low.min(axis=0, keepdims=True)
            w *= 2
            if w in windows:
                new = np.ones(low.shape, bool)
                new[1:] = low[1:] != low[:-1]
                out.append(mixed((low ^ _salts(hashes, w))[new]))
    return np.concatenate(out)


def _marked(v: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The distinct values that the filter holds."""
    for shift in _SHIFTS:
        at = ((v >> np.uint64(shift)) & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
        v = v[(marks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1]
    return np.unique(v)


def _item_sketches(items: DataFrame, hashes: int, k: int) -> DataFrame:
    def sketch(batches):
        words = WordHashes()
        for b in parts(batches):
            ids, vals, sets, wide = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = np.unique(shingles(words.text(t), k))
                if len(s):
                    ids.append(i)
                    vals.append(item_values(s, hashes).view(np.int64))
                    sets.append(s.tobytes())
                    wide.append((len(s), window_of(len(s))))
            ends = np.cumsum([0] + [len(v) for v in vals])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(vals or [np.zeros(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(sets, pa.binary()), pa.array([n for n, _ in wide], pa.int64()),
                                              pa.array([w for _, w in wide], pa.int64())], names=["item_id", "vals", "items", "n_item", "wide"])

    return items.mapInArrow(sketch, "item_id long, vals array<long>, items binary, n_item long, wide long")


def _value_map(sketches: DataFrame) -> np.ndarray:
    slots = ", ".join(f"shiftrightunsigned(v, {x}) & {(1 << MAP_BITS) - 1}" for x in _SHIFTS)
    rows = sketches.select(F.explode("vals").alias("v")).selectExpr(f"explode(array({slots})) as slot").selectExpr(
        "cast(shiftright(slot, 6) as int) as word", "shiftleft(1L, cast(slot & 63 as int)) as bit") \
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()  # 2 ** (MAP_BITS - 6) rows at most
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    for r in rows:
        out[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return out


def _marked_documents(docs: DataFrame, marks: np.ndarray, windows: list[int], hashes: int, k: int) -> DataFrame:
    def search(batches):
        words = WordHashes()
        for b in parts(batches):
            ids, vals, sets = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(words.text(t), k)
                if not len(s):
                    continue
                v = _marked(window_values(s, windows, hashes), marks)
                if len(v):
                    ids.append(i)
                    vals.append(v.view(np.int64))
                    sets.append(np.unique(s).tobytes())
            ends = np.cumsum([0] + [len(x) for x in vals])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(vals or [np.zeros(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(sets, pa.binary())], names=["doc_id", "vals", "shingles"])

    return docs.mapInArrow(search, "doc_id long, vals array<long>, shingles binary")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, k: int = 5, hashes: int = 16,
                 item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, n_item (shingles of the item), n_shared (of them in the document), containment."""
    items = doc_texts(items, item_col).select(F.col("doc_id").alias("item_id"), "text").where("item_id is not null")
    docs = doc_texts(docs).where("doc_id is not null")

    sketches = cut(_item_sketches(items, hashes, k))
    windows = [r["wide"] for r in sketches.select("wide").distinct().collect()]  # lengths double, so there are few
    if not windows:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_item long, n_shared long, containment double")
    marked = written(_marked_documents(docs, _value_map(sketches), windows, hashes, k))
    values = sketches.select("item_id", F.explode("vals").alias("v"))
    pairs = marked.select("doc_id", F.explode("vals").alias("v")).distinct().join(values, "v").select("doc_id", "item_id").distinct()
    both = pairs.join(sketches.select("item_id", "items", "n_item"), "item_id").join(marked.select("doc_id", "shingles"), "doc_id") \
        .select("doc_id", "item_id", "n_item", "items", "shingles")

    def verify(batches):
        for b in parts(batches):
            keep, shared = [], []
            for i, (x, y) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist())):
                item = np.frombuffer(x, np.uint64)
                n = len(np.intersect1d(item, np.frombuffer(y, np.uint64), assume_unique=True))
                if n >= threshold * len(item):
                    keep.append(i)
                    shared.append(n)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(i).take(at) for i in (0, 1, 2)] + [pa.array(shared, pa.int64())],
                                             names=["doc_id", "item_id", "n_item", "n_shared"])

    found = both.mapInArrow(verify, "doc_id long, item_id long, n_item long, n_shared long")
    return found.groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared")) \
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))


def without_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a test item; rows with a null id stay."""
    hit = contaminated(docs, items, **options).select("doc_id").distinct()
    return docs.join(hit.select(F.col("doc_id").alias("__hit")), F.col("doc_id") == F.col("__hit"), "left_anti")
