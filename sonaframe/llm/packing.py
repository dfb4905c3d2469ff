"""Sequence packing: order-preserving dynamic programming over cut places.

The documents of a partition follow one another as one stream of token ids,
each with an end id.  A stream is cut into sequences of at most ``window``
tokens.  Cut places are document ends (free), sentence ends
(``SENTENCE_COST``) and, where these lie too far apart or a part ends, other
places (``WORD_COST``).  A sequence costs its padding plus ``SEQUENCE_COST``;
a sequence whose length is a power of two is not padded.  The cheapest cuts
up to a place follow from those before it: padding grows by one with each
token that is missing, so that the best predecessor among all places in the
last ``window`` tokens is the front of a monotone queue; the few predecessors
a power of two away are tried one by one.

The stream is worked off in parts of about ``part_tokens`` ids, so that
memory does not grow with a partition.  No shuffle is needed.  Ids are those
of the tokenizer file; the same vocabulary given as ranks is used where it is
at hand, as it is faster (equal ids on every code point: see the tests).

Edge cases: a null or empty text is the end id alone; rows with a null doc_id
are packed like others; rows that repeat are packed each; a text of any
length is cut as often as needed; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import doc_texts, parts

SEQUENCE_COST, SENTENCE_COST, WORD_COST = 16, 4, 48
_SENTENCE_END = (".", "!", "?", "…", "。", "！", "？", "\n")
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long, padding long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts, and which ids end a sentence or start after white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, decoders

        self.full = Tokenizer.from_file(path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        decoder = decoders.ByteLevel()
        n = self.full.get_vocab_size()
        strings = [decoder.decode([self.full.id_to_token(i) or ""]) for i in range(n)]
        self.ends = np.array([s.endswith(_SENTENCE_END) for s in strings])
        self.spaced = np.array([s[:1].isspace() for s in strings])
        self.breaks = np.array([s.endswith("\n") for s in strings])
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, enc: Encoder, window: int, spread: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Places where a part of the stream may be cut (0 and its end included), and the cost of each."""
    n = len(ids)
    end = enc.ends[ids]
    end[:-1] &= enc.spaced[ids[1:]] | enc.breaks[ids[:-1]]
    sentence = np.flatnonzero(end) + 1
    # one sentence end in each stretch of `spread` tokens
    sentence = sentence[np.append(True, sentence[1:] // spread != sentence[:-1] // spread)] if len(sentence) else sentence
    cost = np.full(n + 1, -1, np.int32)
    powers = 1 << np.arange(window.bit_length() - 1)
    tail = np.unique(np.concatenate([powers, (powers[:, None] + powers[None, :]).ravel()]))
    cost[n - tail[tail < n]] = WORD_COST
    cost[sentence] = SENTENCE_COST
    cost[0] = cost[n] = 0
    cost[doc_ends] = 0
    places = np.flatnonzero(cost >= 0)
    gaps = np.diff(places)
    step = max(1, window // 8)
    if (gaps > step).any():
        for i in np.flatnonzero(gaps > step):
            cost[places[i] + step: places[i + 1]: step] = WORD_COST
        places = np.flatnonzero(cost >= 0)
    return places, cost[places]


def best_cuts(places: np.ndarray, costs: np.ndarray, window: int) -> list[int]:
    """The cheapest places (from 0 to the end) for sequences of at most ``window`` tokens."""
    n = len(places)
    by_power: dict[int, list[int]] = {}
    for k in range(window.bit_length() - 1):
        want = places - (1 << k)
        at = np.searchsorted(places, want)
        for j in np.flatnonzero(places[np.minimum(at, n - 1)] == want).tolist():
            by_power.setdefault(j, []).append(int(at[j]))
    pos, cost = places.tolist(), costs.tolist()
    best, came, lead = [0] * n, [0] * n, [0] * n
    queue: deque[int] = deque([0])
    none: list[int] = []
    for j in range(1, n):
        p = pos[j]
        low = p - window
        while pos[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        b = lead[i] + window - p
        for m in by_power.get(j, none):
            if best[m] < b:
                b, i = best[m], m
        b += SEQUENCE_COST + cost[j]
        best[j], came[j] = b, i
        b += p
        lead[j] = b
        while queue and lead[queue[-1]] >= b:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j > 0:
        out.append(pos[j])
        j = came[j]
    return [0, *out[::-1]]


def pieces(doc_ids: list, lengths: list[int], ids: np.ndarray, cuts: list[int], first_sequence: int, window: int) -> pa.RecordBatch:
    """One row for each document's stretch in each sequence of a part."""
    ends = np.cumsum(lengths)
    starts = ends - np.array(lengths)
    cut = np.array(cuts)
    bounds = np.union1d(cut, np.append(starts, ends[-1]))
    a, e = bounds[:-1], bounds[1:]
    doc = np.searchsorted(ends, a, "right")
    seq = np.searchsorted(cut, a, "right") - 1
    size = np.diff(cut)
    pad = np.where((size & (size - 1)) == 0, 0, window - size)
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * x: 4 * y]) for x, y in zip(a.tolist(), e.tolist())]
    return pa.RecordBatch.from_arrays([
        pa.array(doc_ids, pa.int64()).take(pa.array(doc)), pa.array(a - starts[doc]), pa.array(e - a), pa.array(crc, pa.int64()),
        pa.array(np.array(lengths, np.int64)[doc]), pa.array(seq + first_sequence), pa.array(a - cut[seq]), pa.array(size[seq]), pa.array(pad[seq])],
        names=[x.split()[0] for x in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = 2048, end_id: int = 1, part_tokens: int = 1 << 20) -> DataFrame:
    """One row for each piece: see ``PIECES``.  ``tokenizer`` is a path that every worker can read."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        enc, first = encoder(path), TaskContext.get().partitionId() << 40
        doc_ids, stream, lengths, total = [], [], [], 0

        def flush():
            nonlocal first
            ids = np.concatenate(stream)
            places, costs = cut_places(ids, np.cumsum(lengths), enc, window)
            cuts = best_cuts(places, costs, window)
            out = pieces(doc_ids, lengths, ids, cuts, first, window)
            first += len(cuts) - 1
            return out

        for b in parts(batches):
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.append(enc.ids(t), np.uint32(end_id))
                doc_ids.append(d)
                stream.append(x)
                lengths.append(len(x))
                total += len(x)
                if total >= part_tokens:
                    yield flush()
                    doc_ids, stream, lengths, total = [], [], [], 0
        if doc_ids:
            yield flush()

    return doc_texts(docs).mapInArrow(run, PIECES)
