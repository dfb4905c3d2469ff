"""Substring dedup: passages that repeat across documents, found by banded MinHash of sliding paragraphs.

1. A paragraph here is every run of ``WINDOW`` shingles (five words each), so
   that a passage is found wherever it stands in a line.  The MinHash of a
   paragraph is its smallest shingle; neighbouring paragraphs mostly share
   it, so a text is the short list of its distinct minima.  A band is two
   minima in a row with their distance.  Two texts with a common run of 37 words or more
   share a band for certain, and texts with an edit every 40 words or so
   nearly always do.
2. Bands that stand in several documents tie each document to the smallest
   id among them (grouped minima, summed before the shuffle).
3. Such pairs meet both whole texts.  Every maximal stretch from the start of
   a common run of words to the end of one whose shingles have an exact
   Jaccard similarity of ``threshold`` counts as a repeat from ``min_words``
   words on, however long the edits between its runs.
4. Bands that are still outside any repeat may hide one with another partner
   than the smallest id: every window of ``min_words`` words around them is
   compared exactly, again by the smallest id, which then holds all of it.  So
   no run of ``min_words`` words that a smaller id holds stays whole.  (What a
   near copy without such a run shares only with a larger id than the smallest
   of its bands may stay; the tests measure how much is caught.)
5. Repeats are clustered by connected components of their documents.  Of a
   passage the copy in the smallest doc_id stays; it is cut from the others.

Edge cases: null texts are empty; texts of under ``min_words`` words have no
passage.  A passage that repeats only inside one document stays.  Equal
documents lose the text in all but the smallest id.  Rows with a null doc_id
take no part and stay as they are; rows that repeat a doc_id with the same
text are cut alike, with other texts each by its own repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import cut, doc_texts, id_map, in_map, parts, written
from .words import WORD, WordHashes, mixed, shingles

WINDOW = 16
_FOLD, _FOLD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _sliding(v: np.ndarray, window: int, best: np.ufunc) -> np.ndarray:
    """``best`` over every ``window`` neighbours (a power of two), by doubling."""
    w = 1
    while w < window:
        v = best(v[:-w], v[w:])
        w *= 2
    return v


def minima(s: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of all shingles that are the smallest of some window of ``s``."""
    if len(s) < window:
        return np.zeros(0, np.int64)
    v = s * _FOLD2
    low = _sliding(v, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    # no window has a minimum above any of its values: a value is one's minimum when it equals the largest of these minima
    return np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), window, np.maximum) == v)


def bands(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band values of a text, and the first and last word positions that each speaks for."""
    p = minima(s)
    if len(p) < 2:
        z = np.zeros(0, np.int64)
        return z, z, z
    a, b = p[:-1], p[1:]
    v = mixed(s[a] * _FOLD + s[b] * _FOLD2 + (b - a).astype(np.uint64))
    return v.view(np.int64), a, b + 4


class Sorted:
    """Words, their shingles and the sorted shingles, kept for the text that many others meet."""

    def __init__(self, words: np.ndarray, k: int = 5):
        self.words, self.shingles = words, shingles(words, k)
        self.order = np.argsort(self.shingles, kind="stable")
        self.sorted = self.shingles[self.order]


#: Shingles that are compared at a time where a shingle stands often.
_AHEAD = 64


def _longest(sx: np.ndarray, sy: np.ndarray, at: np.ndarray) -> tuple[int, int]:
    """Of the places ``at`` in ``sy`` (ascending) that at which ``sx`` runs longest from its start, and how long.

    Many places go on together, some shingles at a time, and drop out where
    they differ, so that a line that repeats is not compared to the end of
    the text from each of its places.
    """
    if len(at) <= 4:
        best = (0, 0)
        for j in at.tolist():
            m = min(len(sx), len(sy) - j)
            diff = np.flatnonzero(sx[:m] != sy[j: j + m])
            length = int(diff[0]) if len(diff) else m
            if length > best[0]:
                best = (length, j)
        return best
    length = 0
    while True:
        step = min(_AHEAD, len(sx) - length)
        place = at[:, None] + length + np.arange(step)
        same = (sy[np.minimum(place, len(sy) - 1)] == sx[length: length + step]) & (place < len(sy))
        run = np.where(same.all(axis=1), step, same.argmin(axis=1)) if step else np.zeros(len(at), np.int64)
        most = int(run.max())
        at = at[run == most]
        length += most
        if most < step or step < _AHEAD:
            return length, int(at[0])
        if len(at) == 1:
            j = int(at[0])
            m = min(len(sx), len(sy) - j)
            diff = np.flatnonzero(sx[length:m] != sy[j + length: j + m])
            return length + (int(diff[0]) if len(diff) else m - length), j


def common_runs(x: np.ndarray, sx: np.ndarray, y: Sorted, hits: np.ndarray, k: int = 5) -> list[tuple[int, int, int]]:
    """Runs of ``k`` or more equal words at the shingles ``hits`` of ``x``, from left to right in ``x``: (start in x, start in y, words).

    A run starts at the first shingle not yet in one, goes to the place in
    ``y`` where it is longest, and is drawn out to the left as far as words
    are equal (so that it may overlap the run before it).
    """
    sy = y.shingles
    lo = np.searchsorted(y.sorted, sx[hits], "left")
    hi = np.searchsorted(y.sorted, sx[hits], "right")
    runs, h, n = [], 0, len(sx)
    while h < len(hits):
        i = int(hits[h])
        best = _longest(sx[i:], sy, y.order[lo[h]: hi[h]])
        m = min(i, best[1])
        diff = np.flatnonzero(x[i - m: i][::-1] != y.words[best[1] - m: best[1]][::-1])
        back = int(diff[0]) if len(diff) else m
        runs.append((i - back, best[1] - back, best[0] + k - 1 + back))
        h = int(np.searchsorted(hits, i + best[0]))
    return runs


def _near(sx: np.ndarray, hit: np.ndarray, threshold: float) -> np.ndarray:
    """Edges (start, end) of the longest parts of ``sx`` in which every shingle may lie in a similar stretch.

    A stretch with c shingles that the other text has and u kinds that it has
    not is of similarity c / (c + u) at most.
    """
    score = np.where(hit, 1 - threshold, 0.0)
    lone = np.flatnonzero(~hit)
    score[lone[_firsts(sx[lone])]] = -threshold
    total = _sums(score)
    low, high = np.minimum.accumulate(total)[:-1], np.maximum.accumulate(total[::-1])[::-1][1:]
    may = np.concatenate([[False], high >= low - 1e-6, [False]])
    return np.flatnonzero(may[1:] != may[:-1]).reshape(-1, 2)


def _firsts(s: np.ndarray) -> np.ndarray:
    """Whether each shingle stands there for the first time."""
    v = np.sort(s)
    if not (v[1:] == v[:-1]).any():
        return np.ones(len(s), bool)
    out = np.zeros(len(s), bool)
    out[np.unique(s, return_index=True)[1]] = True
    return out


def _kinds(s: np.ndarray) -> np.ndarray:
    v = np.sort(s)
    return v[np.append(True, v[1:] != v[:-1])]


def _sums(v: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(v)])


def _stretches(runs: list[tuple[int, int, int]], sx: np.ndarray, hit: np.ndarray, sy: np.ndarray, min_words: int, threshold: float, k: int = 5) -> list[tuple[int, int]]:
    """Every maximal stretch [start, end) from the start of one of the ``runs`` to the end of one, of ``min_words`` or
    more words, whose shingles have an exact Jaccard similarity of ``threshold`` with those of its counterpart.
    ``hit``: whether a shingle of ``sx`` stands anywhere in ``sy``."""
    if len(runs) < 2:
        return [(i, i + n) for i, _, n in runs if n >= min_words]
    r = np.array(runs, np.int64)
    a, c, e, f = r[:, 0], r[:, 1], r[:, 0] + r[:, 2] - k + 1, r[:, 1] + r[:, 2] - k + 1  # in shingles
    if e[-1] - a[0] > min_words - k and f[-1] > c[0]:  # most often all of it is one
        ux, uy = _kinds(sx[a[0]: e[-1]]), _kinds(sy[c[0]: f[-1]])
        both = len(np.intersect1d(ux, uy, assume_unique=True))
        if both >= threshold * (len(ux) + len(uy) - both):
            return [(int(a[0]), int(e[-1]) + k - 1)]
    # no similarity is above what these counts allow: distinct shingles at least, common ones at most
    x0, y0, x1, y1 = int(a.min()), int(c.min()), int(e.max()), int(f.max())
    wx, wy = sx[x0:x1], sy[y0:y1]
    kinds_x, kinds_y = _sums(_firsts(wx)), _sums(_firsts(wy))
    hits_x, hits_y = _sums(hit[x0:x1]), _sums(np.isin(wy, wx))
    kx, ky, hx, hy = kinds_x[e - x0], kinds_y[f - y0], hits_x[e - x0], hits_y[f - y0]
    gx, gy, ix, iy = (v[:, None] for v in (kinds_x[a - x0], kinds_y[c - y0], hits_x[a - x0], hits_y[c - y0]))
    out, done = [], -1
    for i in range(len(r)):
        if i % 64 == 0:
            t = slice(i, i + 64)
            may = np.minimum(hx - ix[t], hy - iy[t]) * (1 + threshold) >= threshold * (kx - gx[t] + ky - gy[t]) - 1e-6
            may &= (e - a[t, None] > min_words - k) & (f > c[t, None])
            some = may.any(axis=1)
        if not some[i % 64]:
            continue
        j = max(i, done + 1) + np.flatnonzero(may[i % 64, max(i, done + 1):])
        if not len(j):
            continue
        ux, px = np.unique(sx[a[i]: int(e[j].max())], return_index=True)
        uy, py = np.unique(sy[c[i]: int(f[j].max())], return_index=True)
        _, at, to = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
        cx, cy = px[at], py[to]
        for n in j[::-1].tolist():
            m, o = e[n] - a[i], f[n] - c[i]
            both = np.count_nonzero((cx < m) & (cy < o))
            if both >= threshold * (np.count_nonzero(px < m) + np.count_nonzero(py < o) - both):
                out.append((int(a[i]), int(e[n]) + k - 1))
                done = n
                break
    return out


def repeats(x: np.ndarray, y: np.ndarray | Sorted, min_words: int, threshold: float, k: int = 5) -> list[tuple[int, int]]:
    """Stretches [start, end) of the words ``x`` that repeat in ``y``."""
    y = y if isinstance(y, Sorted) else Sorted(y, k)
    if len(x) < max(k, min_words) or len(y.words) < k:
        return []
    if len(x) == len(y.words) and (x == y.words).all():
        return [(0, len(x))]
    sx = shingles(x, k)
    hit = y.sorted[np.minimum(np.searchsorted(y.sorted, sx), len(y.sorted) - 1)] == sx
    if not hit.any():
        return []
    edges = _near(sx, hit, threshold)
    edges = edges[edges[:, 1] - edges[:, 0] > min_words - k]
    out = []
    for start, end in edges.tolist():
        runs = common_runs(x, sx, y, start + np.flatnonzero(hit[start:end]), k)
        out += _stretches(runs, sx, hit, y.shingles, min_words, threshold, k)
    return out


def _band_rows(texts: DataFrame) -> DataFrame:
    """(band, doc_id, first, last) of all texts."""
    def run(batches):
        words = WordHashes()
        for b in parts(batches):
            ids, vals, starts, ends = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v, a, e = bands(shingles(words.text(t)))
                ids.append(np.full(len(v), i))
                vals.append(v)
                starts.append(a)
                ends.append(e)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(vals), pa.int64()), pa.array(np.concatenate(ids).astype(np.int64), pa.int64()),
                                                  pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(ends), pa.int32())],
                                                 names=["band", "doc_id", "first", "last"])

    return texts.mapInArrow(run, "band long, doc_id long, first int, last int")


def _keepers(rows: DataFrame) -> DataFrame:
    """(band, keeper): bands in several documents, and the smallest id of these."""
    return cut(rows.groupBy("band").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("top")).where("keeper <> top").drop("top"))


def _verified(pairs: DataFrame, known: DataFrame, min_words: int, threshold: float) -> DataFrame:
    """doc_id, of (hash of its text), keeper, first, last (words, inclusive) of the repeats of each pair."""
    mine = in_map(known, "doc_id", id_map(pairs, "doc_id"))
    theirs = in_map(known, "doc_id", id_map(pairs, "keeper"))
    side = pairs.join(mine, "doc_id").withColumnRenamed("text", "x")
    both = side.join(theirs.select(F.col("doc_id").alias("keeper"), F.col("text").alias("y")), "keeper").select("doc_id", "of", "keeper", "x", "y")

    def run(batches):
        words, last, wy, ty = WordHashes(), None, None, None  # the other text comes many times in a row
        for b in parts(batches):
            out: list[tuple[int, int, int, int, int]] = []
            for d, of, k, x, y in zip(*(c.to_pylist() for c in b.columns)):
                if k != last:
                    last, wy, ty = k, Sorted(words.text(y)), y
                elif y != ty:  # the id has another text
                    wy, ty = Sorted(words.text(y)), y
                wx = wy.words if x == y else words.text(x)
                out += [(d, of, k, a, e - 1) for a, e in repeats(wx, wy, min_words, threshold)]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "of", "keeper", "first", "last"])

    return both.mapInArrow(run, "doc_id long, of long, keeper long, first long, last long")


def _window_rows(spots: DataFrame, known: DataFrame, min_words: int) -> DataFrame:
    """(band, doc_id): hashes of all windows of ``min_words`` words that hold one of the bands (first, last)."""
    at = spots.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("at"))  # of one text, so bounded by it

    def run(batches):
        words = WordHashes()
        for b in parts(batches):
            vals, ids = [], []
            for d, t, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                h = words.text(t)
                if len(h) < min_words:
                    continue
                first, last = (np.asarray(at.values.field(i), np.int64) for i in (0, 1))
                low = np.maximum(last + 1 - min_words, 0)
                some = low <= first
                mark = np.zeros(len(h) + 2, np.int64)
                np.add.at(mark, low[some], 1)
                np.add.at(mark, first[some] + 1, -1)
                p = np.flatnonzero(np.cumsum(mark)[: len(h) - min_words + 1] > 0)
                vals.append(shingles(h, min_words)[p].view(np.int64))
                ids.append(np.full(len(p), d, np.int64))
            if vals:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(vals)), pa.array(np.concatenate(ids))], names=["band", "doc_id"])

    return at.join(known, "doc_id").select("doc_id", "text", "at").mapInArrow(run, "band long, doc_id long")


def repeated_passages(docs: DataFrame, min_words: int = 50, threshold: float = 0.8) -> DataFrame:
    """Repeats (doc_id, of, keeper, first, last) that are to go; ``of`` is the hash of the text that they belong to."""
    texts = doc_texts(docs).where("doc_id is not null")
    every = written(_band_rows(texts))
    low = _keepers(every)
    # unrepeated bands are not shuffled; both sides come fresh to the join, so that Spark can split a band of very many documents
    rows = written(in_map(every, "band", id_map(low, "band")).join(low, "band").select("band", "doc_id", "keeper", "first", "last"))
    known = written(in_map(texts, "doc_id", id_map(rows, "doc_id")).withColumn("of", F.xxhash64("text")))
    pairs = cut(rows.where("doc_id <> keeper").select("doc_id", "keeper").distinct())
    found = cut(_verified(pairs, known, min_words, threshold))
    # bands outside any repeat of some document; the keeper of a band needs no other partner for it
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct(F.col("first").alias("f"), F.col("last").alias("l"))).alias("spans"))  # of one text
    inside = F.exists("spans", lambda s: (s["f"] <= F.col("first")) & (F.col("last") <= s["l"]))
    open_ = cut(rows.where("doc_id <> keeper").join(spans, "doc_id", "left").where(~F.coalesce(inside, F.lit(False))).select("band").distinct())
    spots = rows.select("band", "doc_id", "first", "last").join(open_, "band", "left_semi")
    windows = written(_window_rows(spots, in_map(known, "doc_id", id_map(spots, "doc_id")), min_words))
    more = cut(windows.join(_keepers(windows), "band").where("doc_id <> keeper").select("doc_id", "keeper").distinct()
               .join(pairs, ["doc_id", "keeper"], "left_anti"))
    if not more.isEmpty():
        found = cut(found.unionByName(_verified(more, known, min_words, threshold)).distinct())
    return found


def cut_passages(docs: DataFrame, min_words: int = 50, threshold: float = 0.8) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; n_removed (words), cluster (or null), partners (ids that keep the text).

    ``cluster`` is the smallest id of the documents tied by repeats.
    """
    found = repeated_passages(docs, min_words, threshold)
    comp = connected_components(found.select(F.col("doc_id").alias("a"), F.col("keeper").alias("b")))
    spans = found.groupBy("doc_id", "of").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("__spans"),  # of one text
                                              F.sort_array(F.collect_set("keeper")).alias("__partners")).withColumnRenamed("of", "__of")
    info = cut(comp.select(F.col("id").alias("doc_id"), F.col("component").alias("__cluster")).join(spans, "doc_id", "left").withColumnRenamed("doc_id", "__id"))
    marks = id_map(info, "__id")
    docs = docs.drop("n_removed", "cluster", "partners").withColumn("doc_id", F.col("doc_id").cast("long"))
    mine = F.col("__of").isNull() | (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__of"))
    hit = in_map(docs, "doc_id", marks).join(info, (F.col("doc_id") == F.col("__id")) & mine, "left")
    out = [*docs.columns, "n_removed", "cluster", "partners"]
    schema = T.StructType([*docs.schema.fields, T.StructField("n_removed", T.LongType()), T.StructField("cluster", T.LongType()),
                           T.StructField("partners", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in parts(batches):
            col = dict(zip(b.schema.names, b.columns))
            texts, gone = [], []
            for t, spans in zip(col["text"].to_pylist(), col["__spans"].to_pylist()):
                n = 0
                if spans:
                    t, n = without_spans(t, [(s["first"], s["last"]) for s in spans])
                texts.append(t)
                gone.append(n)
            col |= {"text": pa.array(texts, pa.string()), "n_removed": pa.array(gone, pa.int64()),
                    "cluster": col["__cluster"], "partners": col["__partners"]}
            yield pa.RecordBatch.from_arrays([col[n] for n in out], names=out)

    rest = in_map(docs, "doc_id", marks, found=False).withColumns({
        "n_removed": F.lit(0).cast("long"), "cluster": F.lit(None).cast("long"), "partners": F.lit(None).cast("array<bigint>")})
    return hit.mapInArrow(run, schema).unionByName(rest)


def without_spans(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """``text`` without the words of the sorted, inclusive ``spans`` and the marks after them, and their number.

    What is left closes up; a line break inside or at the end of a cut stays one line break.
    """
    low = text.lower()
    if len(low) != len(text):  # lower case changes the length of a few letters: find the words in the text itself
        at = []
        p = 0
        for c in text:
            at += [p] * len(c.lower())
            p += 1
        at.append(p)
    else:
        at = None
    words = [m.span() for m in WORD.finditer(low)]
    if at:
        words = [(at[a], at[e]) for a, e in words]
    merged: list[list[int]] = []
    for a, e in spans:
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([a, e])
    parts, p = [], 0
    for a, e in merged:
        start, end = words[a][0], words[e + 1][0] if e + 1 < len(words) else len(text)
        parts.append(text[p:start])
        tail = text[words[e][1]: end]
        if start and end < len(text):
            parts.append("\n" if "\n" in tail else "" if text[start - 1].isspace() else " ")
        p = end
    parts.append(text[p:])
    return "".join(parts), sum(e - a + 1 for a, e in merged)
