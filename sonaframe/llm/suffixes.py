"""Suffix-array deduplication by bucket-pointer refinement.

A byte goes when a string of ``length`` (100) bytes that covers it also starts
earlier: in a document before, or before in the same document.  So the start
of every 100-byte string must learn whether an equal string starts earlier.
This is suffix sorting to depth 100: suffixes that still share a bucket then
are equal strings, and the first of a bucket stays.

*Initial buckets.*  A string belongs to the bucket of the q-gram (32 bytes) in
it whose hash is smallest, the leftmost such.  Equal strings have equal such
q-grams at equal places, and neighbouring starts share theirs, so a run of up
to 69 starts travels as one *piece*: the bytes from its first start to the end
of its last string.  Buckets are what Spark deals out.

*First refinement.*  Inside a bucket, pieces are sorted on an identifier of
all their q-grams (two independent 64-bit hashes in all).  Equal pieces need
only their earliest member; every string of the others starts earlier.  A
bucket with one distinct piece is finished.

*Refinement to the full depth.*  The distinct pieces of the other buckets are
laid end to end in a task, and their suffixes refined: buckets of 8 bytes,
then sorted on (own bucket, bucket 8 bytes on), so buckets of 16, 32 and 64,
each round reusing the bucket numbers that the round before made, last (own
bucket, bucket 36 bytes on) for 100.  Suffixes alone in a bucket are done and
are not sorted again.

*Hot buckets.*  One q-gram may stand in a third of all documents, each time
between other bytes.  Every task sums its distinct pieces by q-gram; a q-gram
with more than ``hot_pieces`` of them anywhere is refined at once to the full
depth: each of its strings becomes a piece of its own whose q-gram hash is
that of the whole string.  Copies inside a slab of documents are reduced to
the earliest before the shuffle, so a bucket gets one row a slab at most for
the same piece.

Order: documents go by doc_id; rows that repeat a doc_id follow each other in
the order they were read, and a null doc_id goes before all others (its text
takes part).  Null texts are empty; a text under 100 bytes loses nothing; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .words import mixed

#: Bytes of a q-gram.
Q = 32
#: Positions that are hashed at once, so that the arrays stay in a core's cache.
STRETCH = 1 << 16
_C = 0x9E3779B97F4A7C15
_POWERS = [np.uint64(pow(_C, 1 << i, 1 << 64)) for i in range(5)]
_PLACE = np.uint64(0x1FFFF)
_M = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A polynomial hash of the 32 bytes from each position (by doubling)."""
    h = b.astype(np.uint64) + np.uint64(1)
    for i, p in enumerate(_POWERS):
        step = 1 << i
        h = h[:-step] * p + h[step:]
    return h


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span:]) if w > span else x


class Slab:
    """Documents laid end to end, and the pieces of their strings."""

    def __init__(self, text: bytes, sizes: np.ndarray, length: int):
        self.length, self.sizes = length, sizes
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.bytes = np.frombuffer(text, np.uint8)
        firsts, ends, grams, prints = [], [], [], []
        n, w = len(self.bytes), length - Q + 1
        live = np.zeros(n + 1, np.int32)  # 1 where a string starts that lies within its document
        long = np.flatnonzero(sizes >= length)
        live[self.start[long]] += 1
        live[self.start[long + 1] - length + 1] -= 1
        live = np.cumsum(live[:-1]) > 0
        for s in range(0, n - length + 1, STRETCH):
            e = min(s + STRETCH, n - length + 1)  # starts s..e
            own = live[s:e]
            if not own.any():
                continue
            h = gram_hashes(self.bytes[s: e + length - 1])
            rank = (mixed(h) & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
            place = (_window_min(rank, w) & _PLACE).astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]) | np.concatenate([[True], own[1:] != own[:-1]]))
            stop = np.append(edge[1:], e - s)
            keep = own[edge]
            f, t, g = edge[keep], stop[keep] - 1, place[edge[keep]]  # first and last start, and where their q-gram is
            firsts.append(f + s)
            ends.append(t + s + 1)
            grams.append(mixed(h[g]))
            prints.append(_identifier(h, f, t, g - f, length))
        none = [np.zeros(0, np.int64)]
        self.first, self.end = np.concatenate(firsts or none), np.concatenate(ends or none)
        self.gram = np.concatenate(grams or none).astype(np.uint64)
        self.print = np.concatenate(prints or none).astype(np.uint64)
        self.doc = np.searchsorted(self.start, self.first, side="right") - 1

    def refined(self, hot: np.ndarray) -> None:
        """Pieces of hot q-grams are cut into single strings."""
        if not len(hot) or not len(self.gram):
            return
        is_hot = hot[np.minimum(np.searchsorted(hot, self.gram), len(hot) - 1)] == self.gram
        if not is_hot.any():
            return
        size = (self.end - self.first)[is_hot]
        first = np.repeat(self.first[is_hot], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        grams, prints = [], []
        for s in range(0, len(first), 8192):
            f = first[s: s + 8192]
            rows = self.bytes[f[:, None] + np.arange(self.length)].astype(np.uint64) + np.uint64(1)
            a, b = np.zeros(len(f), np.uint64), np.zeros(len(f), np.uint64)
            for j in range(self.length):
                a = a * _POWERS[0] + rows[:, j]
                b = (b ^ rows[:, j]) * _M
            grams.append(mixed(a ^ _M))
            prints.append(mixed(b))
        rest = ~is_hot
        self.first, self.end = np.concatenate([self.first[rest], first]), np.concatenate([self.end[rest], first + 1])
        self.gram = np.concatenate([self.gram[rest], *grams])
        self.print = np.concatenate([self.print[rest], *prints])
        self.doc = np.concatenate([self.doc[rest], np.repeat(self.doc[is_hot], size)])


def _identifier(h: np.ndarray, f: np.ndarray, t: np.ndarray, o: np.ndarray, length: int) -> np.ndarray:
    """One number for all bytes of a piece: q-grams that cover it, its size and the place of its q-gram."""
    last = t + length - Q  # the q-gram that ends the piece
    out = (t - f).astype(np.uint64) * np.uint64(128) + o.astype(np.uint64)
    at = f
    for _ in range(-(-(2 * length - Q) // Q)):
        out = mixed(out * _M + h[np.minimum(at, last)])
        at = at + Q
    return out


def _earliest(key: list[np.ndarray]) -> np.ndarray:
    """Places in an order by the keys (last first), as ``np.lexsort``."""
    return np.lexsort(tuple(reversed(key)))


def distinct_pieces(slab: Slab, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest piece of each kind, all others); ``order`` ranks the documents."""
    by = _earliest([slab.gram, slab.print, order[slab.doc], slab.first])
    g, p = slab.gram[by], slab.print[by]
    new = np.ones(len(by), bool)
    new[1:] = (g[1:] != g[:-1]) | (p[1:] != p[:-1])
    return by[new], by[~new]


def refine(text: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """A bucket number for each suffix in ``start``: equal numbers, equal first ``depth`` (> 8) bytes.

    ``text`` holds ``depth`` bytes from each start.  Buckets of eight bytes
    are refined by sorting on the bucket of a later offset until the depth is
    reached; a suffix alone in its bucket keeps its number.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j: n + j].astype(np.uint64)
    _, bucket, count = np.unique(word, return_inverse=True, return_counts=True)
    bucket = bucket.astype(np.int64)
    used = len(count)
    needed = np.zeros(n + 1, np.int32)  # suffixes whose buckets a later round may ask for
    np.add.at(needed, start, 1)
    np.add.at(needed, start + depth - 7, -1)
    open_ = (np.cumsum(needed[:-1]) > 0) & (count[bucket] > 1)
    reach = 8
    while reach < depth:
        step = min(reach, depth - reach)
        at = np.flatnonzero(open_[: n - step])
        if len(at):
            key = bucket[at] * np.int64(used) + bucket[at + step]
            by = np.argsort(key, kind="stable")
            key = key[by]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(edge, len(key)))
            bucket[at[by]] = used + np.repeat(np.arange(len(size)), size)
            open_[at[by]] = np.repeat(size > 1, size)
            used += len(size)
        reach += step
    return bucket[start]


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unblob(data: bytes, n: int, *types) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        out.append(np.frombuffer(data, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


_U, _I, _S = np.uint64, np.int64, np.int32
#: Columns of a table of pieces: q-gram, identifier, document order (null first, id), place in the document, piece of the slab.
_PIECE = (_U, _U, np.uint8, _I, _S, _S, _S)


def _slabs(docs: DataFrame, slab_bytes: int) -> DataFrame:
    """Documents in the order they are read, laid end to end: slab, ids, whether an id is there, sizes, zstd of the bytes."""
    def pack(batches):
        codec, seq, task = pa.Codec("zstd", compression_level=1), 0, TaskContext.get().partitionId()
        ids, texts, held = [], [], 0

        def row():
            text = b"".join(texts)
            return pa.RecordBatch.from_arrays([
                pa.array([(task << 24) + seq]), pa.array([len(ids)], pa.int32()), pa.array([np.array([i or 0 for i in ids], _I).tobytes()], pa.binary()),
                pa.array([np.array([i is not None for i in ids], np.uint8).tobytes()], pa.binary()),
                pa.array([np.array([len(t) for t in texts], _I).tobytes()], pa.binary()), pa.array([len(text)], pa.int64()),
                pa.array([codec.compress(text, asbytes=True)], pa.binary())], names=names)

        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    ids.append(i)
                    texts.append(t)
                    held += len(t)
                    if held >= slab_bytes:
                        yield row()
                        seq, ids, texts, held = seq + 1, [], [], 0
        if ids:
            yield row()

    names = ["slab", "docs", "ids", "known", "sizes", "bytes", "text"]
    return docs.mapInArrow(pack, "slab long, docs int, ids binary, known binary, sizes binary, bytes long, text binary")


class _Read:
    """A slab row read back."""

    def __init__(self, r: dict, length: int, hot: np.ndarray):
        self.id = r["slab"]
        self.ids, self.known = np.frombuffer(r["ids"], _I), np.frombuffer(r["known"], np.uint8)
        text = pa.Codec("zstd").decompress(r["text"], decompressed_size=r["bytes"], asbytes=True) if r["bytes"] else b""
        self.slab = Slab(text, np.frombuffer(r["sizes"], _I), length)
        self.slab.refined(hot)
        self.order = np.empty(len(self.ids), np.int64)
        self.order[np.lexsort((np.arange(len(self.ids)), self.ids, self.known))] = np.arange(len(self.ids))
        self.kept, self.copies = distinct_pieces(self.slab, self.order)

    def table(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """The columns of ``_PIECE`` for pieces ``at``; a document's place in the slab settles equal ids."""
        s = self.slab
        doc = s.doc[at]
        return s.gram[at], s.print[at], self.known[doc], self.ids[doc], doc.astype(_S), (s.first[at] - s.start[doc]).astype(_S), at.astype(_S)


_ROWS = "slab long, docs int, ids binary, known binary, sizes binary, bytes long, text binary"


def _each_slab(length: int, hot: np.ndarray, make):
    """A map over slab rows; ``make(read, row)`` yields record batches."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                yield from make(_Read(r, length, hot), r)

    return run


def _dealt(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each of n buckets that gets keys, and their places."""
    to = (mixed(keys) % np.uint64(n)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    names, where = np.unique(to[by], return_index=True)
    return zip(names.tolist(), np.split(by, where[1:]))


def remove_repeats(documents: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", slab_bytes: int = 4 << 20,
                   bucket_pieces: int = 1_000_000, bucket_bytes: int = 2 << 20, hot_pieces: int = 20_000, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_kept``, kept (the bytes that stay) of every document.

    ``slab_bytes``, ``bucket_pieces`` and ``bucket_bytes`` bound what one task
    holds at a time; ``hot_pieces`` is where a q-gram counts as hot.
    """
    if length < 2 * Q:
        raise ValueError(f"length must be {2 * Q} or more")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slabs = written(_slabs(docs, slab_bytes))
    hot = _hot_grams(slabs, length, hot_pieces)
    total = slabs.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("slabs")).first()
    buckets = max(int(slabs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-total["bytes"] // (Q * bucket_pieces)))

    # the first refinement: equal pieces, and buckets that hold different ones
    def emit(read: _Read, _):
        for k, at in _dealt(read.slab.gram[read.kept], buckets):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([read.id]), pa.array([len(at)], pa.int32()),
                                              pa.array([_blob(*read.table(read.kept[at]))], pa.binary())], names=["bucket", "slab", "n", "pieces"])

    def compare(group: pa.Table) -> pa.Table:
        n, slab = group.column("n").to_pylist(), np.asarray(group.column("slab").combine_chunks(), _I)
        cols = [np.concatenate(c) for c in zip(*(_unblob(p.as_py(), k, *_PIECE) for p, k in zip(group.column("pieces"), n)))]
        slab = np.repeat(slab, n)
        gram, ident, known, ids, doc, place, piece = cols
        by = _earliest([gram, ident, known, ids, slab, doc, place])
        g, p = gram[by], ident[by]
        bucket = np.concatenate([[True], g[1:] != g[:-1]])
        first = bucket | np.concatenate([[True], p[1:] != p[:-1]])
        kinds = np.add.reduceat(first.astype(np.int64), np.flatnonzero(bucket))
        open_ = first & np.repeat(kinds > 1, np.diff(np.append(np.flatnonzero(bucket), len(by))))
        say = np.where(first, np.where(open_, 1, 0), 2)  # 2: every string starts earlier; 1: to be refined
        some = say > 0
        slab, piece, say = slab[by][some], piece[by][some], say[some]
        at = np.argsort(slab, kind="stable")
        names, where = np.unique(slab[at], return_index=True)
        ends = np.append(where[1:], len(at))
        return pa.table({"slab": pa.array(names, pa.int64()), "n": pa.array((ends - where).astype(_S), pa.int32()),
                         "said": pa.array([_blob(piece[at[a:z]].astype(_S), say[at[a:z]].astype(np.uint8)) for a, z in zip(where, ends)], pa.binary())})

    pieces = slabs.mapInArrow(_each_slab(length, hot, emit), "bucket int, slab long, n int, pieces binary")
    said = written(pieces.groupBy("bucket").applyInArrow(compare, "slab long, n int, said binary"))
    said = said.groupBy("slab").agg(F.collect_list(F.struct("n", "said")).alias("said"))

    def answers(r: dict) -> tuple[np.ndarray, np.ndarray]:
        got = [_unblob(x["said"], x["n"], _S, np.uint8) for x in r["said"] or ()]
        return tuple(np.concatenate([g[i] for g in got]) if got else np.zeros(0, (_S, np.uint8)[i]) for i in (0, 1))

    # the refinement of what is left, bytes in hand
    fine = max(int(slabs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-total["bytes"] // (2 * bucket_bytes)))

    def send(read: _Read, r: dict):
        piece, say = answers(r)
        mine = np.sort(piece[say == 1])
        for k, at in _dealt(read.slab.gram[mine], fine):
            own = mine[at]
            size = (read.slab.end - read.slab.first)[own] + length - 1
            text = b"".join(read.slab.bytes[f: f + z].tobytes() for f, z in zip(read.slab.first[own].tolist(), size.tolist()))
            yield pa.RecordBatch.from_arrays([
                pa.array([k], pa.int32()), pa.array([read.id]), pa.array([len(own)], pa.int32()), pa.array([_blob(*read.table(own), size.astype(_S))], pa.binary()),
                pa.array([text], pa.binary())], names=["bucket", "slab", "n", "pieces", "text"])

    def sort_strings(group: pa.Table) -> pa.Table:
        n, slab = group.column("n").to_pylist(), np.asarray(group.column("slab").combine_chunks(), _I)
        cols = [np.concatenate(c) for c in zip(*(_unblob(p.as_py(), k, *_PIECE, _S) for p, k in zip(group.column("pieces"), n)))]
        slab = np.repeat(slab, n)
        gram, _, known, ids, doc, place, piece, size = cols
        text = np.frombuffer(b"".join(group.column("text").to_pylist()), np.uint8)
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        found_slab, found_piece, found_place = [], [], []
        by = np.argsort(gram, kind="stable")
        edges = np.append(np.flatnonzero(np.concatenate([[True], gram[by][1:] != gram[by][:-1]])), len(by))
        held = np.cumsum(size[by].astype(np.int64))[edges[1:] - 1]  # bytes up to the end of each bucket
        lo = first = 0
        while lo < len(by):  # whole buckets, up to a bounded number of bytes at a time
            last = max(first, int(np.searchsorted(held, (held[first - 1] if first else 0) + bucket_bytes, side="right")) - 1)
            hi, first = int(edges[last + 1]), last + 1
            own = by[lo:hi]
            bytes_of = size[own].astype(np.int64)
            begin = np.cumsum(bytes_of) - bytes_of
            part = text[np.repeat(at[own], bytes_of) + np.arange(bytes_of.sum()) - np.repeat(begin, bytes_of)]
            starts_of = bytes_of - length + 1
            who = np.repeat(np.arange(len(own)), starts_of)
            step = np.arange(starts_of.sum()) - np.repeat(np.cumsum(starts_of) - starts_of, starts_of)
            bucket = refine(part, begin[who] + step, length)
            w = own[who]
            ranks = _earliest([bucket, known[w], ids[w], slab[w], doc[w], place[w] + step])
            again = np.concatenate([[False], bucket[ranks][1:] == bucket[ranks][:-1]])
            hit = ranks[again]
            found_slab.append(slab[w[hit]])
            found_piece.append(piece[w[hit]])
            found_place.append(step[hit])
            lo = hi
        s, p, q = (np.concatenate(x) for x in (found_slab, found_piece, found_place))
        order = np.lexsort((q, p, s))
        s, p, q = s[order], p[order], q[order]
        names, where = np.unique(s, return_index=True)
        ends = np.append(where[1:], len(s))
        return pa.table({"slab": pa.array(names, pa.int64()), "n": pa.array((ends - where).astype(_S), pa.int32()),
                         "starts": pa.array([_blob(p[a:z].astype(_S), q[a:z].astype(np.uint8)) for a, z in zip(where, ends)], pa.binary())})

    asked = slabs.join(said, "slab")
    sent = asked.mapInArrow(_each_slab(length, hot, send), "bucket int, slab long, n int, pieces binary, text binary")
    starts = sent.groupBy("bucket").applyInArrow(sort_strings, "slab long, n int, starts binary") \
        .groupBy("slab").agg(F.collect_list(F.struct("n", "starts")).alias("starts"))

    def finish(read: _Read, r: dict):
        s = read.slab
        piece, say = answers(r)
        whole = np.concatenate([read.copies, piece[say == 2]]).astype(np.int64)
        got = [_unblob(x["starts"], x["n"], _S, np.uint8) for x in r["starts"] or ()]
        single = np.concatenate([s.first[p] + q for p, q in got]) if got else np.zeros(0, np.int64)
        n = len(s.bytes)
        cover = np.zeros(n + 1, np.int32)
        np.add.at(cover, s.first[whole], 1)
        np.add.at(cover, s.end[whole] + length - 1, -1)
        np.add.at(cover, single, 1)
        np.add.at(cover, single + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        total_gone = np.concatenate([[0], np.cumsum(gone)])
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        edge = s.start[:-1][s.start[:-1] < n]
        opens[edge] = gone[edge]  # a run ends with its document
        total_open = np.concatenate([[0], np.cumsum(opens)])
        for lo in range(0, len(read.ids), 256):
            hi = min(lo + 256, len(read.ids))
            kept = [s.bytes[a:z][~gone[a:z]].tobytes() for a, z in zip(s.start[lo:hi], s.start[lo + 1: hi + 1])]
            a, z = s.start[lo:hi], s.start[lo + 1: hi + 1]
            yield pa.RecordBatch.from_arrays([
                pa.array(read.ids[lo:hi], mask=read.known[lo:hi] == 0), pa.array(z - a), pa.array(total_gone[z] - total_gone[a]), pa.array(total_open[z] - total_open[a]),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]), *([pa.array(kept, pa.binary())] if with_kept else [])], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    names = [c.split()[0] for c in schema.split(", ")]
    return slabs.join(said, "slab", "left").join(starts, "slab", "left").mapInArrow(_each_slab(length, hot, finish), schema)


def _hot_grams(slabs: DataFrame, length: int, hot_pieces: int) -> np.ndarray:
    """q-grams that head more than ``hot_pieces`` distinct pieces of slabs, sorted.

    A slab reports a q-gram only from ``hot_pieces / (2 slabs)`` pieces on (two
    at least), so what is not reported adds up to less than half of
    ``hot_pieces``; one that is reported with half counts as hot.  The table is
    as long as the corpus holds that many pieces, and at most 2 ** 18 q-grams.
    """
    n = max(1, slabs.count())
    least = max(2, hot_pieces // (2 * n))

    def count(read: _Read, _):
        gram, many = np.unique(read.slab.gram[read.kept], return_counts=True)
        some = many >= least
        yield pa.RecordBatch.from_arrays([pa.array(gram[some].view(np.int64)), pa.array(many[some])], names=["gram", "n"])

    none = np.zeros(0, np.uint64)
    found = slabs.mapInArrow(_each_slab(length, none, count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")) \
        .where(F.col("n") > hot_pieces / 2).orderBy(F.desc("n"), "gram").limit(1 << 18).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in found], np.int64).view(np.uint64)) if found else none
