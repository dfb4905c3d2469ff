"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

1. Every whole text becomes hashed counts: words in one block of slots, the
   shapes of its white-space tokens (letter case, digits, marks) and pairs of
   neighbouring shapes in another.
2. Document frequencies of all slots are counted over the whole table in
   Spark; slots are few and fixed, so the result is bounded.
3. A bounded sample of labelled rows (``max_labelled``, the smallest hashes
   of doc_id) is weighted by TF-IDF and reduced to ``rank`` latent dimensions
   by a truncated singular value decomposition.
4. The labelled vectors go to every task (``max_labelled * rank`` floats);
   each block of documents is multiplied with all of them, and the ``k`` most
   similar labels vote, weighted by similarity.

Edge cases: a null or empty text has no features and gets the sample's mean
label; ties in similarity go to the neighbour with the smaller hash order; a
document that repeats gets the same score; labels that are null are ignored;
an empty table gives an empty result; without any labelled row every score
is 1.0 (nothing is rejected).  A column of the input that is called like an
output column is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import append_columns, doc_texts, parts

WORD_SLOTS = 2048
SHAPE_SLOTS = 512
PAIR_SLOTS = 512
SLOTS = WORD_SLOTS + SHAPE_SLOTS + PAIR_SLOTS
_BLOCKS = ((0, WORD_SLOTS), (WORD_SLOTS, WORD_SLOTS + SHAPE_SLOTS), (WORD_SLOTS + SHAPE_SLOTS, SLOTS))
_RUNS = re.compile(r"(.)\1+")
_NOT_WORD = re.compile(r"[\W_]+")


class _Kinds(dict):
    """Code point -> 9 for digits, X for upper case, x for other letters, else itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = self[code] = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        return kind


_KINDS = _Kinds()


def _shape(token: str) -> str:
    """Case, digits and marks of a token, each run shortened to one: ``Hello,!!`` -> ``Xx,!``."""
    return _RUNS.sub(r"\1", token.translate(_KINDS))


class TokenSlots(dict):
    """Token -> word slot * SHAPE_SLOTS + shape slot, remembered for up to ``most`` tokens."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        word = _NOT_WORD.sub("", token.lower())
        v = (xxhash.xxh32_intdigest(word) % WORD_SLOTS) * SHAPE_SLOTS + xxhash.xxh32_intdigest(_shape(token)) % SHAPE_SLOTS
        self[token] = v
        return v

    def counts(self, text: str | None) -> np.ndarray:
        """Counts of all slots for one whole text."""
        tokens = text.split() if text else []
        if not tokens:
            return np.zeros(SLOTS, np.float32)
        v = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        shape = v % SHAPE_SLOTS
        pair = (shape[:-1] * 31 + shape[1:] * 17 + 7) % PAIR_SLOTS
        out = np.bincount(v // SHAPE_SLOTS, minlength=SLOTS)
        out += np.bincount(shape + WORD_SLOTS, minlength=SLOTS)
        out += np.bincount(pair + (WORD_SLOTS + SHAPE_SLOTS), minlength=SLOTS)
        return out.astype(np.float32)


def _packed(counts: np.ndarray) -> bytes:
    """The slots that are not zero, and their counts."""
    some = np.flatnonzero(counts)
    return some.astype(np.uint16).tobytes() + counts[some].astype(np.uint32).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    n, out = len(blob) // 6, np.zeros(SLOTS, np.float32)
    out[np.frombuffer(blob, np.uint16, n)] = np.frombuffer(blob, np.uint32, n, 2 * n)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of TF-IDF weights; the three blocks of a row have length one each."""
    x = np.log1p(counts) * idf
    for a, b in _BLOCKS:
        part = x[:, a:b]
        part /= np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1e-9)
    return x


@dataclass
class QualityModel:
    idf: np.ndarray        # SLOTS
    axes: np.ndarray       # SLOTS x rank
    vectors: np.ndarray    # labelled rows x rank, of length one
    labels: np.ndarray     # 0 or 1
    k: int
    power: float
    prior: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        z = weighted(counts, self.idf) @ self.axes
        return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Score of each row of counts: the weighted share of label 1 among the ``k`` nearest labelled rows."""
        n, m = len(counts), len(self.labels)
        if m == 0:
            return np.ones(n)
        out = np.full(n, self.prior)
        some = counts.any(axis=1)
        if not some.any():
            return out
        sims = self.latent(counts[some]) @ self.vectors.T
        k = min(self.k, m)
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < m else np.tile(np.arange(m), (len(sims), 1))
        w = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(np.float64) ** self.power
        total = w.sum(1)
        votes = (w * self.labels[near]).sum(1)
        out[some] = np.where(total > 0, votes / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0.0, 1.0)


def slot_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each slot, and all documents, over the whole table.

    Every task sends at most SLOTS + 1 sums; the driver gets SLOTS + 1 rows.
    """
    def count(batches):
        slots, df, n = TokenSlots(), np.zeros(SLOTS, np.int64), 0
        for b in parts(batches):
            for t in b.column(0).to_pylist():
                df += slots.counts(t) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS + 1), pa.int32()), pa.array(np.append(df, n), pa.int64())],
                                         names=["slot", "n"])

    sums = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = {r["slot"]: r["n"] for r in sums.collect()}  # at most SLOTS + 1 rows
    return np.array([got.get(i, 0) for i in range(SLOTS)], np.float64), int(got.get(SLOTS, 0))


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column | None = None, label_col: str = "quality",
                max_labelled: int = 4096, rank: int = 64, k: int = 25, power: float = 4.0, seed: int = 7) -> QualityModel:
    """Fit on at most ``max_labelled`` labelled rows; ``train`` (on doc_id) says which labels may be learnt from."""
    docs = doc_texts(docs)
    df, n = slot_frequencies(docs)
    idf = np.log((n + 1.0) / (df + 1.0)).astype(np.float32) + np.float32(1)
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    if train is not None:
        lab = lab.where(train)
    lab = lab.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_labelled)

    def features(batches):
        slots = TokenSlots()
        for b in parts(batches):
            rows = [_packed(slots.counts(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=["doc_id", "y", "x"])

    # the labelled side has max_labelled rows at most
    found = docs.join(F.broadcast(lab), "doc_id").select("doc_id", "y", "text").mapInArrow(features, "doc_id long, y int, x binary")
    # max_labelled * SLOTS places and counts at most for distinct ids; ids that repeat in the table are cut back to the bound
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(max_labelled).collect()
    if not rows:
        return QualityModel(idf, np.zeros((SLOTS, rank), np.float32), np.zeros((0, rank), np.float32), np.zeros(0), k, power, 1.0)
    x = weighted(np.stack([_unpacked(r["x"]) for r in rows]), idf)
    y = np.array([r["y"] for r in rows], np.float64)
    model = QualityModel(idf, _axes(x, rank, seed), np.zeros((0, rank), np.float32), y, k, power, float(y.mean()))
    z = x @ model.axes
    model.vectors = (z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9)).astype(np.float32)
    return model


def _axes(x: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration; of a sign and order fixed by ``seed``."""
    wide = min(rank + 16, *x.shape)
    q = np.linalg.qr(x.T @ np.random.default_rng(seed).standard_normal((x.shape[0], wide)).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, s, vt = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ vt.T)[:, :rank]
    return np.pad(axes, ((0, 0), (0, rank - axes.shape[1]))).astype(np.float32)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, block: int = 512,
                  score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with its score and prediction (1 when the score reaches ``threshold``)."""
    def make():
        slots = TokenSlots()

        def work(texts):
            scores = np.concatenate([np.zeros(0)] + [
                model.scores(np.stack([slots.counts(t) for t in texts[i: i + block]])) for i in range(0, len(texts), block)])
            return [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())]

        return work

    return append_columns(docs, "text", make, [T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())])
