"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model counted in Spark.

Tokens are the words of a text (A-Z in lower case) and one end; a token's
context are the ``order - 1`` tokens before it, starts of the text where it has
fewer.  Below the highest order a count is a continuation count (how many
kinds of words an n-gram stands behind), and below single words all words and
one unknown word are equally likely.

The model grows with the corpus, so that no worker could hold it whole.  It
is stored as sorted hash arrays in buckets by hash, and a lookup goes to the
bucket in place of the bucket coming to the text:

1. One pass over the texts writes chunks: the distinct words of a bounded
   number of tokens, the stream of word numbers, and the documents' places.
2. Every chunk sends its distinct n-grams of the highest order, sorted, with
   their training counts, to buckets.  A bucket adds up the counts, keeps
   keys and totals memory-mapped in unnamed files, and answers each chunk with
   the totals of what it asked for.  Each learnt n-gram is owned by one of the
   chunks that hold it.
3. The same for each lower order down to single words: a chunk sends what the
   n-grams that it owns say about their first and last n - 1 words (kinds
   before; counts, and contexts with one, two or more kinds behind).
4. Chunks meet their answers, score their tokens and add up documents.

Keys of all orders are 64-bit hashes mixed from the 64-bit hashes of the words:
two of m distinct n-grams share one with a chance of about m**2 / 2**65.  A
chunk sends at most as many pieces as it has n-grams, whatever the number of
buckets.

Edge cases: a null or empty text is the end token alone; rows with a null id
are learnt from and scored; rows that repeat count as often as they stand; an
empty table gives an empty result; without any training row every token has
the probability 1.
"""

from __future__ import annotations

import tempfile
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import doc_texts, written
from .words import mixed

#: The end of a text, and what stands before its first token; no word holds these bytes.
END, START = b"\n", b"\t"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def _pressed(a: np.ndarray) -> bytes:
    """An array as compressed bytes, byte planes apart."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")


def _opened(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)


def _sorted_pressed(keys: np.ndarray) -> bytes:
    return _pressed(np.diff(keys, prepend=np.uint64(0)))


def _sorted_opened(blob: bytes) -> np.ndarray:
    return np.cumsum(_opened(blob, np.uint64), dtype=np.uint64)


def _small(a: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type."""
    return a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a.astype(np.uint8)


def _mapped(a: np.ndarray) -> np.ndarray:
    """The array in an unnamed file of this worker, memory-mapped."""
    if not len(a):
        return a
    with tempfile.TemporaryFile() as f:
        a.tofile(f)
        f.flush()
        return np.memmap(f, a.dtype, "r", shape=a.shape)


def _chunks(docs: DataFrame, folds: int, fold: int, chunk_tokens: int) -> DataFrame:
    def run(batches):
        part, n = TaskContext.get().partitionId() << 32, 0
        press = zstandard.ZstdCompressor(level=3).compress
        words: dict[bytes, int] = {END: 0, START: 1}
        stream, ids, held, total = [], [], [], 0

        def flush():
            nonlocal n
            lengths = np.array([len(s) for s in stream])
            n += 1
            return pa.RecordBatch.from_arrays([
                pa.array([part + n], pa.int64()), pa.array([press(b" ".join(words))], pa.binary()), pa.array([len(words)], pa.int64()),
                pa.array([_pressed(np.concatenate(stream).astype(np.uint32))], pa.binary()), pa.array([total], pa.int64()),
                pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(held)], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int64()))],
                names=["chunk", "words", "n_words", "stream", "n_tokens", "ids", "held", "lengths"])

        number = words.setdefault
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                tokens = t.lower().split()
                tokens.append(END)
                stream.append(np.array([number(w, len(words)) for w in tokens], np.uint32))
                ids.append(d)
                held.append(held_out(d, folds, fold))
                total += len(tokens)
                if total >= chunk_tokens:
                    yield flush()
                    words.clear()
                    words |= {END: 0, START: 1}
                    stream, ids, held, total = [], [], [], 0
        if ids:
            yield flush()

    return docs.mapInArrow(run, "chunk long, words binary, n_words long, stream binary, n_tokens long, "
                                "ids array<long>, held array<boolean>, lengths array<long>")


class _Level:
    """The distinct n-grams of a chunk that end at its tokens, and at the start of a text."""

    def __init__(self, keys: np.ndarray, inverse: np.ndarray, heads: np.ndarray, tails: np.ndarray):
        self.keys, self.inverse, self.heads, self.tails = keys, inverse, heads, tails


class _Chunk:
    """A chunk's tokens and n-grams, the same in every step.

    One more place stands behind the tokens: the start of a text, in whose
    context first tokens stand.  ``levels[n]`` holds the n-grams that end at
    each place; ``heads`` and ``tails`` number, for each of them, its first and
    its last n - 1 words among those of the level below.
    """

    def __init__(self, words: bytes, stream: bytes, held: list[bool], lengths: list[int], levels: int):
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in zstandard.decompress(words).split(b" ")), np.uint64)
        stream = np.append(_opened(stream, np.uint32), 1)
        self.lengths = np.array(lengths, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.tokens = len(stream) - 1
        self.train = np.append(np.repeat(~np.array(held, bool), self.lengths), False)
        before = np.arange(-1, self.tokens, dtype=np.int32)
        before[self.first] = before[-1] = self.tokens
        keys, number = np.unique(hashes, return_inverse=True)
        none = np.zeros(len(keys), np.int32)
        self.levels = {1: _Level(keys, number.astype(np.int32)[stream], none, none)}
        here, last = hashes[stream], hashes[stream]
        for n in range(2, levels + 1):
            here = mixed(mixed(here[before]) + last)
            keys, at, number = np.unique(here, return_index=True, return_inverse=True)
            below = self.levels[n - 1].inverse
            self.levels[n] = _Level(keys, number.astype(np.int32), below[before[at]], below[at])

    def counted(self, n: int) -> np.ndarray:
        """How often each n-gram stands in texts to learn from."""
        level = self.levels[n]
        return np.bincount(level.inverse[self.train], minlength=len(level.keys))

    def said(self, n: int, counts: np.ndarray, owned: np.ndarray) -> list[np.ndarray]:
        """What the (n + 1)-grams of this chunk's own say about its n-grams: kinds before, and behind it the sum of
        the counts and the kinds with a count of 1, 2, and 3 or more."""
        above, size = self.levels[n + 1], len(self.levels[n].keys)
        counts, heads, tails = counts[owned], above.heads[owned], above.tails[owned]
        kinds = [np.bincount(heads[x], minlength=size) for x in (counts == 1, counts == 2, counts >= 3)]
        return [np.bincount(tails, minlength=size), np.bincount(heads, weights=counts, minlength=size).astype(np.int64), *kinds]


def _parts(keys: np.ndarray, buckets: int):
    """(bucket, places) of the buckets that some key goes to; places keep their order."""
    to = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(to[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    for at in np.split(order, edges[1:]) if len(order) else ():
        yield int(to[at[0]]), at


def _columns(columns: list[np.ndarray]) -> tuple[list[bytes], list[str]]:
    small = [_small(x) for x in columns]
    return [_pressed(x) for x in small], [x.dtype.str for x in small]


def _answers(rows: list[dict], keys: np.ndarray, buckets: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the answers for a chunk's sorted keys, and which of them this chunk owns."""
    facts, owned = np.zeros((columns, len(keys)), np.int64), np.zeros(len(keys), bool)
    by = {x["bucket"]: x for x in rows}
    for k, at in _parts(keys, buckets):
        for j in range(columns):
            facts[j, at] = _opened(by[k]["data"][j], by[k]["types"][j])
        owned[at] = np.unpackbits(_opened(by[k]["owned"], np.uint8), count=len(at)).astype(bool)
    return facts, owned


def _width(n: int, order: int) -> int:
    """Columns of a level: its count first; below the top what stands behind; words also have their tokens, last."""
    return 1 if n == order else 5 + (n == 1)


def _asked(chunks: DataFrame, above: DataFrame | None, n: int, order: int, buckets: dict[int, int]) -> DataFrame:
    """Each chunk's n-grams by bucket, sorted, with what the chunk adds to their columns."""
    rows = chunks.select("chunk", "words", "stream", "held", "lengths")
    highest = above is None
    if not highest:
        rows = rows.join(_by_chunk(above, "above"), "chunk")

    def ask(batches):
        for b in batches:
            for row in range(b.num_rows):
                c, words, stream, held, lengths, *answers = (x[row].as_py() for x in b.columns)
                chunk = _Chunk(words, stream, held, lengths, min(n + 1, order))
                if highest:
                    columns = [chunk.counted(n)]
                else:
                    facts, owned = _answers(answers[0], chunk.levels[n + 1].keys, buckets[n + 1], _width(n + 1, order))
                    columns = chunk.said(n, facts[0], owned) + ([chunk.counted(1)] if n == 1 else [])
                keys = chunk.levels[n].keys
                for k, at in _parts(keys, buckets[n]):
                    data, types = _columns([x[at] for x in columns])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([k], pa.int64()), pa.array([c], pa.int64()), pa.array([_sorted_pressed(keys[at])], pa.binary()),
                        pa.array([data], pa.list_(pa.binary())), pa.array([types], pa.list_(pa.string()))],
                        names=["bucket", "chunk", "keys", "data", "types"])

    return rows.mapInArrow(ask, "bucket long, chunk long, keys binary, data array<binary>, types array<string>")


def _answer(asked: pa.Table) -> pa.Table:
    """A bucket: columns added up by key, kept as sorted arrays that are memory-mapped, and looked up for each chunk.

    An n-gram that was learnt is owned by one of the chunks that asked for it;
    that chunk, which knows its words, counts it as a kind.
    """
    requests = [_sorted_opened(x) for x in asked.column("keys").to_pylist()]
    data, types = asked.column("data").to_pylist(), asked.column("types").to_pylist()
    keys, first, inverse = np.unique(np.concatenate(requests), return_index=True, return_inverse=True)
    totals = [np.bincount(inverse, weights=np.concatenate([_opened(d[j], t[j]) for d, t in zip(data, types)]), minlength=len(keys)).astype(np.int64)
              for j in range(len(data[0]))]
    learnt = np.any(totals, axis=0)
    owners = np.zeros(len(inverse), bool)
    owners[first[totals[0] > 0]] = True
    keys, totals = _mapped(keys[learnt]), [_mapped(x[learnt]) for x in totals]
    rows, start = [], 0
    for c, want in zip(asked.column("chunk").to_pylist(), requests):
        got = [np.zeros(len(want), np.int64) for _ in totals]
        if len(keys):
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            got = [np.where(keys[at] == want, x[at], 0) for x in totals]
        rows.append((c, *_columns(got), _pressed(np.packbits(owners[start: start + len(want)]))))
        start += len(want)
    count, last = totals[0], totals[-1]
    sums = [*(int((count == i).sum()) for i in (1, 2, 3, 4)), int((count > 0).sum()), int(count.sum()), int((last > 0).sum()), int(last.sum())]
    return pa.table({
        "chunk": pa.array([r[0] for r in rows], pa.int64()), "bucket": asked.column("bucket"),
        "data": pa.array([r[1] for r in rows], pa.list_(pa.binary())), "types": pa.array([r[2] for r in rows], pa.list_(pa.string())),
        "owned": pa.array([r[3] for r in rows], pa.binary()), "sums": pa.array([sums] + [None] * (len(rows) - 1), pa.list_(pa.int64()))})


def _by_chunk(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "data", "types", "owned")).alias(name))


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many kinds have the counts 1 to 4."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))])


def _summed(df: DataFrame) -> list[int]:
    row = df.where("sums is not null").agg(*[F.sum(F.element_at("sums", i + 1)) for i in range(8)]).first()
    return [x or 0 for x in row]


def score_texts(docs: DataFrame, folds: int = 7, fold: int = 2, chunk_tokens: int = 1_600_000, bucket_tokens: int = 2_500_000,
                order: int = 2) -> DataFrame:
    """One row for each row of ``docs``: see ``SCORES``.  Rows in the fold ``fold`` are not learnt from."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    chunks = written(_chunks(doc_texts(docs), folds, fold, chunk_tokens))
    n_tokens, n_words = (x or 0 for x in chunks.agg(F.sum("n_tokens"), F.sum("n_words")).first())
    buckets = {n: max(1, -(-n_tokens // bucket_tokens)) for n in range(2, order + 1)} | {1: max(1, -(-n_words // (bucket_tokens // 4)))}
    tables: dict[int, DataFrame] = {}
    for n in range(order, 0, -1):
        tables[n] = written(_asked(chunks, tables.get(n + 1), n, order, buckets).groupBy("bucket").applyInArrow(
            _answer, "chunk long, bucket long, data array<binary>, types array<string>, owned binary, sums array<long>"))
    sums = {n: _summed(t) for n, t in tables.items()}
    d = {n: discounts(*x[:4]) for n, x in sums.items()}
    n1, n2, n3, _, kinds, total, v, n = sums[1]
    rest = d[1][1] * n1 + d[1][2] * n2 + d[1][3] * (kinds - n1 - n2)
    rest, total = (rest, total) if total else (1.0, 1)

    # the answers to one chunk
    both = chunks.select("chunk", "words", "stream", "held", "lengths", "ids")
    for k in range(1, order + 1):
        both = both.join(_by_chunk(tables[k], f"answers{k}"), "chunk")
    both = both.select("words", "stream", "held", "lengths", "ids", *[f"answers{k}" for k in range(1, order + 1)])

    def score(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                blob, stream, held, lengths, ids, *answers = (x[row].as_py() for x in batch.columns)
                chunk = _Chunk(blob, stream, held, lengths, order)
                p, below, known, base = None, None, None, None
                for k, given in enumerate(answers, 1):
                    level = chunk.levels[k]
                    facts, _ = _answers(given, level.keys, buckets[k], _width(k, order))
                    count = facts[0]
                    if k == 1:
                        p = (count - d[1][np.minimum(count, 3)]) / total + rest / total / (v + 1)
                        known, base = facts[5] > 0, np.log10((facts[5] + 1) / (n + v + 1))
                    else:
                        _, behind, k1, k2, k3 = below[:5, level.heads]
                        size = np.maximum(behind, 1)
                        back = np.where(behind > 0, (d[k][1] * k1 + d[k][2] * k2 + d[k][3] * k3) / size, 1.0)
                        p = np.maximum(count - d[k][np.minimum(count, 3)], 0) / size + back * p[level.tails]
                    below = facts
                words, top = chunk.levels[1].inverse[:-1], chunk.levels[order].inverse[:-1]
                add = lambda x: np.add.reduceat(x, chunk.first)
                scores = add(np.log10(p)[top])
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(chunk.lengths), pa.array(add(known[words].astype(np.int64))),
                    pa.array(np.full(len(ids), n)), pa.array(add(base[words])), pa.array(scores),
                    pa.array(10.0 ** np.minimum(-scores / chunk.lengths, 300.0))], names=[x.split()[0] for x in SCORES.split(", ")])

    return both.mapInArrow(score, SCORES)
