"""Ranked lexical search with Block-Max MaxScore over compressed shard indexes.

Index.  A task reads documents where they lie and closes a shard after about
``shard_tokens`` terms.  A shard holds for each of its terms a posting list:
local document numbers (gaps) and impacts, in blocks of ``BLOCK`` postings
with their first and last document, largest impact and byte widths; blocks are
unpacked one by one.  An impact is the term's exact integer score in a
document before the term's weight, so block maxima are exact.

Search.  Items are dealt into chunks; a chunk's terms fetch their lists from
every shard, and each (chunk, shard) is searched by itself with one heap an
item.  Windows of documents go in order.  The sum of the smallest global
bounds that stays below the heap's k-th score marks the non-essential lists:
a document only in those cannot enter.  Essential lists give the candidates
of the window; the others, largest bound first, reject a candidate when its
score so far, the list's block maximum at its place and the bounds of the
lists after it stay below the k-th score, and only blocks that still hold a
candidate are unpacked.  The shard heaps meet in one window function.

Scores are 64-bit integers: weight * (10^9 tf div (1000 tf + 8 m)) summed over
an item's distinct terms, with m = 10 + (90 n N) div L.

Edge cases: a null text has no term and is no document; rows with a null id
take no part; rows that repeat an id are documents of their own (equal scores
go by id, then by row); an item without terms, or whose terms no document
holds, gives no row, and item rows that repeat an id are ranked one by one;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts, written

#: Terms of a text whose A-Z are in lower case, as UTF-8 bytes: every byte of a letter beyond ASCII is 0x80 or more.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of terms, before and after folding.
_IN_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
#: The same as a Java pattern over characters, without folding (for the short texts of items).
TERM_JAVA = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK = 64
#: Documents of a shard that are searched at once.
SPAN = 1024
#: The list that every chunk fetches: a shard's document ids.  No term is empty.
DOCS = ""


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall(text.encode().lower()) if text else []


def count_terms(text: bytes) -> int:
    """The number of terms: places where a byte of a term follows none."""
    inside = _IN_TERM[np.frombuffer(text, np.uint8)]
    return int(inside[:1].sum()) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def _totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    def count(batches):
        for b in parts(batches):
            sizes = np.array([count_terms(t) for t in b.column(0).cast(pa.binary()).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())])], names=["docs", "tokens"])

    got = docs.select("text").mapInArrow(count, "docs long, tokens long").agg(
        F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    return got["docs"], got["tokens"]


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, tokens: int) -> np.ndarray:
    m = 10 + (90 * n.astype(np.int64) * docs) // tokens
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _packed(values: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian bytes of each value in its width, and where each value starts."""
    at = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
    out = np.zeros(int(at[-1]), np.uint8)
    for b in range(int(width.max(initial=0))):
        some = np.flatnonzero(width > b)
        out[at[some] + b] = (values[some] >> (8 * b)) & 255
    return out, at


def _widths(values: np.ndarray, block: np.ndarray, blocks: int) -> np.ndarray:
    """Bytes that the largest value of each block needs."""
    most = np.zeros(blocks, np.int64)
    np.maximum.at(most, block, values)
    return 1 + (most > 255).astype(np.int64) + (most > 65_535) + (most > 16_777_215)


#: A block of a list: first and last document, largest impact, postings, bytes of a gap, bytes of an impact, where its bytes start.
HEAD = 7


def build_lists(term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
    """Lists of postings that are sorted by (term, doc): for each term its number, the block heads and the bytes.

    Yields (terms, postings a list, first block of a list, heads, list payload offsets, payload).
    """
    n = len(term)
    start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(start, n))
    blocks_of = -(-size // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(blocks_of)]).astype(np.int64)
    place = np.arange(n) - np.repeat(start, size)
    block = np.repeat(first_block[:-1], size) + place // BLOCK
    opens = place % BLOCK == 0
    gap = np.where(opens, 0, doc - np.concatenate([[0], doc[:-1]]))
    blocks = int(first_block[-1])
    head = np.zeros((blocks, HEAD), np.int32)
    head[:, 0] = doc[opens]
    last = np.concatenate([opens[1:], [True]]) if n else np.zeros(0, bool)
    head[:, 1] = doc[last]
    np.maximum.at(head[:, 2], block, impact.astype(np.int32))
    head[:, 3] = np.bincount(block, minlength=blocks)
    head[:, 4], head[:, 5] = _widths(gap, block, blocks), _widths(impact, block, blocks)
    # a block's gaps, then its impacts
    bytes_of = head[:, 3].astype(np.int64) * (head[:, 4] + head[:, 5])
    ends = np.concatenate([[0], np.cumsum(bytes_of)])
    order = np.concatenate([2 * block, 2 * block + 1])
    order = np.argsort(order, kind="stable")
    values = np.concatenate([gap, impact])[order]
    width = np.concatenate([head[block, 4], head[block, 5]])[order]
    payload, _ = _packed(values, width.astype(np.int64))
    list_start = ends[first_block]
    head[:, 6] = ends[:-1] - np.repeat(list_start[:-1], blocks_of)
    return term[start], size, first_block, head, list_start, payload


class PostingList:
    """One term's list in a shard; blocks are unpacked on demand."""

    def __init__(self, head: bytes, payload: bytes, weight: int):
        self.head = np.frombuffer(head, np.int32).reshape(-1, HEAD)
        self.payload = np.frombuffer(payload, np.uint8)
        self.weight = weight
        self.first, self.last = self.head[:, 0], self.head[:, 1]
        self.block_bound = self.head[:, 2].astype(np.int64) * weight
        self.bound = int(self.block_bound.max())
        self.cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _values(self, at: int, n: int, width: int) -> np.ndarray:
        raw = self.payload[at: at + n * width].reshape(n, width)
        out = raw[:, 0].astype(np.int64)
        for b in range(1, width):
            out |= raw[:, b].astype(np.int64) << (8 * b)
        return out

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and weighted impacts of a block."""
        got = self.cache.get(b)
        if got is None:
            first, _, _, n, gw, iw, at = self.head[b].tolist()
            docs = first + np.cumsum(self._values(at, n, gw))
            got = self.cache[b] = docs, self._values(at + n * gw, n, iw) * self.weight
        return got

    def span(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the documents lo <= doc < hi."""
        a, z = np.searchsorted(self.last, lo), np.searchsorted(self.first, hi)
        if a >= z:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        got = [self.block(b) for b in range(a, z)]
        docs, score = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        i, j = np.searchsorted(docs, lo), np.searchsorted(docs, hi)
        return docs[i:j], score[i:j]


def search(lists: list[PostingList], docs: int, k: int, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of a shard (local numbers, whose order breaks ties) and their scores, best first."""
    lists = sorted(lists, key=lambda x: x.bound)
    below = np.concatenate([[0], np.cumsum([x.bound for x in lists])])  # below[i]: all lists before i at their best
    best_doc, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    worst = 1  # a score below it cannot enter
    for lo in range(0, docs, span):
        hi = min(lo + span, docs)
        essential = int(np.searchsorted(below[1:], worst))  # lists before it: together below the k-th score
        if essential == len(lists):
            break
        score = np.zeros(hi - lo, np.int64)
        for x in lists[essential:]:
            d, s = x.span(lo, hi)
            score[d - lo] += s
        open_ = np.flatnonzero(score)
        for i in range(essential - 1, -1, -1):
            open_ = open_[score[open_] + below[i + 1] >= worst]
            if not len(open_):
                break
            x = lists[i]
            at = np.searchsorted(x.last, open_ + lo)  # the block that may hold the document
            inside = at < len(x.last)
            inside[inside] = x.first[at[inside]] <= open_[inside] + lo
            most = np.zeros(len(open_), np.int64)
            most[inside] = x.block_bound[at[inside]]
            keep = score[open_] + most + below[i] >= worst
            open_, at, inside = open_[keep], at[keep], inside[keep]
            for b in np.unique(at[inside]).tolist():
                d, s = x.block(b)
                mine = open_[inside & (at == b)]
                p = np.minimum(np.searchsorted(d, mine + lo), len(d) - 1)
                hit = d[p] == mine + lo
                score[mine[hit]] += s[p[hit]]
        open_ = open_[score[open_] >= worst]
        if len(open_):
            all_doc, all_score = np.concatenate([best_doc, open_ + lo]), np.concatenate([best, score[open_]])
            first = np.lexsort((all_doc, -all_score))[:k]
            best_doc, best = all_doc[first], all_score[first]
            if len(best) == k:
                worst = int(best[-1]) + 1  # later documents have larger numbers: an equal score does not enter
    return best_doc, best


def _shards(docs: DataFrame, n_docs: int, n_tokens: int, shard_tokens: int) -> DataFrame:
    """The index: shard, term, postings, heads and payload of every list, and each shard's document ids."""
    def build(batches):
        seq, ids, rows, sizes, words, held = 0, [], [], [], [], 0
        vocab: dict[bytes, int] = defaultdict(lambda: len(vocab))
        task = TaskContext.get().partitionId()

        def close():
            n_of = np.array(sizes, np.int64)
            doc_id = np.array(ids, np.int64)
            order = np.lexsort((np.array(rows, np.int64), doc_id))  # local numbers follow (id, row)
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            token = np.concatenate(words)
            key = token * len(n_of) + np.repeat(number, n_of)
            key, tf = np.unique(key, return_counts=True)
            term, doc = np.divmod(key, len(n_of))
            names, size, first_block, head, list_start, payload = build_lists(term, doc, impacts(tf, n_of[order][doc], n_docs, n_tokens))
            by_number = list(vocab)
            n = len(names)
            text = [by_number[t] for t in names]
            for s in range(0, n, 4096):
                e = min(s + 4096, n)
                hb = first_block[s: e + 1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(e - s, (task << 24) + seq)), pa.array(text[s:e], pa.binary()).cast(pa.string()), pa.array(size[s:e].astype(np.int32)),
                    _binary(head[hb[0]: hb[-1]].tobytes(), (hb - hb[0]) * HEAD * 4),
                    _binary(payload[list_start[s]: list_start[e]].tobytes(), list_start[s: e + 1] - list_start[s])], schema=schema)
            yield pa.RecordBatch.from_arrays([
                pa.array([(task << 24) + seq]), pa.array([DOCS], pa.string()), pa.array([len(doc_id)], pa.int32()),
                pa.array([b""], pa.binary()), pa.array([doc_id[order].tobytes()], pa.binary())], schema=schema)

        for b in parts(batches):
            for i, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = terms_of(t)
                if not found:
                    continue
                ids.append(i)
                rows.append(r)
                sizes.append(len(found))
                words.append(np.fromiter(map(vocab.__getitem__, found), np.int64, len(found)))
                held += len(found)
                if held >= shard_tokens:
                    yield from close()
                    seq, ids, rows, sizes, words, held = seq + 1, [], [], [], [], 0
                    vocab.clear()
        if ids:
            yield from close()

    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("head", pa.binary()), ("payload", pa.binary())])
    return docs.mapInArrow(build, "shard long, term string, df int, head binary, payload binary")


def _binary(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])


def ranked_documents(documents: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                     item_id: str = "item_id", item_text: str = "text", shard_tokens: int = 2_000_000, chunk_items: int = 256) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of every item, of those with a score above 0."""
    docs = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    n_docs, n_tokens = _totals(docs)
    lower = F.translate(F.col(item_text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = written(items.select(F.col(item_id).alias("item_id"), F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM_JAVA), F.lit(0))).alias("terms"))
                    .where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()))
    chunks = max(1, -(-asked.count() // chunk_items))
    index = written(_shards(docs, n_docs, n_tokens, shard_tokens))
    wanted = asked.withColumn("chunk", F.pmod(F.xxhash64("item"), F.lit(chunks)).cast("int")).select(
        "chunk", "item", F.explode(F.concat("terms", F.array(F.lit(DOCS)))).alias("term")).groupBy("chunk", "term").agg(
        F.collect_list(F.when(F.col("term") != DOCS, F.col("item"))).alias("items"))
    lists = index.join(wanted.select("term").distinct(), "term", "left_semi")
    df = lists.where(F.col("term") != DOCS).groupBy("term").agg(F.sum("df").alias("holders"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (F.col("holders") * 2.0 + 1))).cast("long")
    weights = wanted.join(df.select("term", weight.alias("weight")), "term", "left").where(F.col("weight").isNotNull() | (F.col("term") == DOCS))

    def work(group: pa.Table) -> pa.Table:
        term = group.column("term").to_pylist()
        home = term.index(DOCS)
        ids = np.frombuffer(group.column("payload")[home].as_py(), np.int64)
        of: dict[int, list[PostingList]] = defaultdict(list)
        for i, t in enumerate(term):
            if i == home or group.column("weight")[i].as_py() <= 0:
                continue
            one = PostingList(group.column("head")[i].as_py(), group.column("payload")[i].as_py(), group.column("weight")[i].as_py())
            for item in group.column("items")[i].as_py():
                of[item].append(one)
        out = [[], [], [], []]
        for item, own in of.items():
            doc, score = search(own, len(ids), k)
            for o, v in zip(out, (np.full(len(doc), item, np.int64), ids[doc], score, np.arange(len(doc)))):
                o.append(v)
        return pa.table([pa.array(np.concatenate(o).astype(np.int64) if o else [], pa.int64()) for o in out], names=["item", "doc_id", "score", "place"])

    found = lists.join(weights, "term").groupBy("chunk", "shard").applyInArrow(work, "item long, doc_id long, score long, place long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(asked.select("item", "item_id"), "item") \
        .select("item_id", "rank", "doc_id", "score")
