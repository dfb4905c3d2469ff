"""MinHash near-duplicates: improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of words, hashed to ``IDF_SLOTS`` slots, are counted
   over the whole table.  A shingle (five words in a row) weighs its term
   frequency times the mean inverse document frequency of its words.  The
   frequency of whole shingles is not used: in a group of a thousand copies
   it would take the weight from exactly the text that the copies share, and
   its table would be as large as the corpus.
2. Each text is sampled ``bands * rows`` times by improved consistent
   weighted sampling (Ioffe 2010): a sample of two texts agrees with the
   probability of their weighted Jaccard similarity.
3. Texts with the same words are one node.  Nodes that agree in a band share
   a bucket.  In a bucket every node is compared with the smallest one, so a
   bucket of any size gives one pair a node.
4. Pairs meet both whole texts and are verified by weighted Jaccard
   similarity; links are clustered by connected components.
5. Buckets that still hold several components go on.  What two texts have in
   common is at most what each shares with any other open text, so that a
   text whose own edits weigh too much can have no partner.  The others meet
   across components: in small buckets as pairs, in larger ones in blocks,
   whose similarities are matrix products inside a task, which gives a star
   for each component and never the pairs.

Edge cases: null texts are read as empty.  Texts without a word are grouped
only with equal texts; texts of under five words are one shingle.  Rows that
repeat a doc_id are one document: each of its texts looks for copies, and all
that it finds is one class.  Rows with a null doc_id take no part and have a
null class.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import cut, doc_texts, id_map, in_map, parts, written
from .words import WordHashes, mixed, shingles

IDF_SLOTS = 1 << 16
_DRAW_BITS = 14
_DRAWS = 1 << _DRAW_BITS
_PART = 1024


def word_frequencies(docs: DataFrame, slots: int = IDF_SLOTS) -> np.ndarray:
    """Smoothed inverse document frequency of each word slot, over all of ``docs`` (doc_id, text).

    A task sends at most ``slots`` + 1 sums, and the driver gets as many.
    """
    def count(batches):
        words, df, n = WordHashes(), np.zeros(slots, np.int64), 0
        for b in parts(batches):
            for t in b.column(0).to_pylist():
                h = words.text(t)
                df[np.unique((h & np.uint64(slots - 1)).astype(np.int64))] += 1
                n += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, slots), pa.int32()),
                                          pa.array(np.append(df[some], n), pa.int64())], names=["slot", "n"])

    got = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(slots + 1)
    for r in got:
        df[r["slot"]] = r["n"]
    return (np.log((df[slots] + 1) / (df[:slots] + 1)) + 1).astype(np.float32)


def weighted_shingles(hashes: np.ndarray, idf: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, sorted, and their TF-IDF weights."""
    s = shingles(hashes, k)
    if not len(s):
        return s, np.zeros(0, np.float32)
    g = idf[(hashes & np.uint64(len(idf) - 1)).astype(np.int64)]
    k = min(k, len(hashes))
    w = g[: len(s)].copy()
    for j in range(1, k):
        w += g[j: len(s) + j]
    u, first, tf = np.unique(s, return_index=True, return_counts=True)
    return u, w[first] / np.float32(k) * tf.astype(np.float32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    if total == 0:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return common / (total - common)


@lru_cache(maxsize=2)
def _draws(samples: int, seed: int) -> tuple[np.ndarray, ...]:
    """Random draws of the sampler, for each sample a table by a shingle's slot: 1/r, beta, r, ln c - r + r * beta."""
    g = np.random.default_rng(seed)
    r, c = g.gamma(2.0, 1.0, (2, samples, _DRAWS))
    beta = g.random((samples, _DRAWS))
    odd = g.integers(1, 1 << 31, (samples, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    at = (np.arange(samples, dtype=np.uint32) * np.uint32(_DRAWS))[:, None]
    return (odd, at, *(x.astype(np.float32).ravel() for x in (1 / r, beta, r, np.log(c) - r + r * beta)))


def samples_of(s: np.ndarray, w: np.ndarray, samples: int, seed: int = 11) -> np.ndarray:
    """One consistent weighted sample (a hash of shingle and level) for each of ``samples``."""
    odd, at, inv, beta, r, top = _draws(samples, seed)
    best = np.full(samples, np.inf, np.float32)
    out = np.zeros(samples, np.uint64)
    rows = np.arange(samples)
    lw = np.log(w)
    slot = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(s), _PART):
        d = slot[i: i + _PART] * odd
        d >>= np.uint32(32 - _DRAW_BITS)
        d += at
        t = inv.take(d, mode="clip")
        t *= lw[i: i + _PART]
        t += beta.take(d, mode="clip")
        np.floor(t, out=t)
        a = r.take(d, mode="clip")
        a *= t
        np.subtract(top.take(d, mode="clip"), a, out=a)
        m = a.argmin(axis=1)
        low = a[rows, m]
        new = low < best
        best = np.where(new, low, best)
        level = t[rows, m].astype(np.int64).astype(np.uint64)
        out = np.where(new, mixed(s[i + m] + level * np.uint64(0x9E3779B97F4A7C15)), out)
    return out


def band_hashes(sample: np.ndarray, bands: int, rows: int) -> np.ndarray:
    v = sample.reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + v[:, j])
    return out.view(np.int64)


def signatures(docs: DataFrame, idf: np.ndarray, bands: int, rows: int, k: int) -> DataFrame:
    """doc_id, of (hash of the text), key (equal for equal words), n_words, bands (none without words), of each row of (doc_id, text)."""
    def sign(batches):
        words = WordHashes()
        for b in parts(batches):
            keys, counts, sigs = [], [], []
            for t in b.column(1).to_pylist():
                h = words.text(t)
                counts.append(len(h))
                if len(h):
                    keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                    sigs.append(band_hashes(samples_of(*weighted_shingles(h, idf, k), bands * rows), bands, rows))
                else:
                    keys.append(xxhash.xxh3_128_digest(b"\x00text" + t.encode()))
                    sigs.append(np.zeros(0, np.int64))
            ends = np.cumsum([0] + [len(x) for x in sigs])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sigs or [np.zeros(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), lists],
                                             names=["doc_id", "of", "key", "n_words", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("of")).mapInArrow(sign, "doc_id long, of long, key binary, n_words long, bands array<long>")


def verified_links(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float, k: int) -> DataFrame:
    """Of the pairs (a, b) those with a weighted Jaccard similarity of at least ``threshold``.

    ``texts`` has one row for each id.  The second join is on the centre; a
    centre with many partners is a skewed key that Spark splits by itself.
    """
    side = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = side.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def verify(batches):
        words, last, wa = WordHashes(), None, None
        for batch in parts(batches):
            keep, sims = [], []
            for i, (x, ta, tb) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)))):
                if x != last:
                    last, wa = x, weighted_shingles(words.text(ta), idf, k)
                s = weighted_jaccard(wa, weighted_shingles(words.text(tb), idf, k))
                if s >= threshold:
                    keep.append(i)
                    sims.append(s)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sims, pa.float64())],
                                             names=["a", "b", "similarity"])

    return both.mapInArrow(verify, "a long, b long, similarity double")


def _shared_weights(nodes: DataFrame, known: DataFrame, idf: np.ndarray, k: int) -> DataFrame:
    """(node, weight, shared): the weight of each text, and of its shingles that another of ``nodes`` has too."""
    def spread(batches):
        words = WordHashes()
        for b in parts(batches):
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s, w = weighted_shingles(words.text(t), idf, k)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), d)), pa.array(w.astype(np.float64))],
                                                 names=["shingle", "node", "w"])

    texts = in_map(known, "doc_id", id_map(nodes, "node")).join(nodes, F.col("doc_id") == F.col("node")).select("doc_id", "text")
    rows = texts.mapInArrow(spread, "shingle long, node long, w double")
    alone = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other"), F.sum("w").alias("w"))
    facts = alone.select("node", F.when(F.col("node") == F.col("other"), F.col("w")).otherwise(0.0).alias("own"), F.lit(0.0).alias("w")).unionByName(
        rows.groupBy("node").agg(F.sum("w").alias("w")).select("node", F.lit(0.0).alias("own"), "w"))
    return facts.groupBy("node").agg(F.sum("w").alias("weight"), (F.sum("w") - F.sum("own")).alias("shared"))


def _common_part(threshold: float) -> float:
    """A similarity of t takes a common weight of t / (1 + t) of the sum of both weights."""
    return threshold / (1 + threshold) * (1 - 1e-5)


def _open_rows(buckets: DataFrame, comp: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """(bucket, node, comp, weight, shared, n) of nodes that may have a partner in another component of their bucket."""
    rows = cut(buckets.join(weights, "node").join(comp, F.col("id") == F.col("node"), "left").select(
        "bucket", "node", "weight", "shared", F.coalesce("component", "node").alias("comp")))
    lightest = cut(rows.groupBy("bucket").agg(F.min("weight").alias("lightest")))
    rows = cut(rows.join(lightest, "bucket").where(
        F.col("shared") >= _common_part(threshold) * (F.col("weight") + F.col("lightest"))).drop("lightest"))
    size = cut(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
               .where("lo <> hi").select("bucket", "n"))
    return cut(rows.join(size, "bucket"))


def _small_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Possible pairs (a, b) between components of small buckets."""
    left = rows.select("bucket", *[F.col(c).alias(f"{c}_a") for c in ("node", "comp", "weight", "shared")])
    return rows.join(left, "bucket").where((F.col("node_a") < F.col("node")) & (F.col("comp") != F.col("comp_a")) & (
        F.least("shared", "shared_a") >= _common_part(threshold) * (F.col("weight") + F.col("weight_a")))) \
        .select(F.col("node_a").alias("a"), F.col("node").alias("b")).distinct()


def similar_stars(nodes: list[int], side: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """Of the links between nodes of side 0 and 1 (or 2, which is both) a tree for each connected part.

    ``sets`` holds for each node its shingles, their weights and their counts.
    """
    # a shingle that stands twice is two features, so that common weights are sums over equal features
    keys, weights, owner = [], [], []
    for i, (s, w, tf) in enumerate(sets):
        for j in range(1, int(tf.max(initial=0)) + 1):
            some = tf >= j
            keys.append(mixed(s[some] + np.uint64(j)) if j > 1 else s[some])
            weights.append((w[some] / tf[some]).astype(np.float32))
            owner.append(np.full(int(some.sum()), i))
    keys, weights, owner = np.concatenate(keys), np.concatenate(weights), np.concatenate(owner)
    total = np.bincount(owner, weights=weights, minlength=len(nodes))
    _, first, number, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    twice = times[number] > 1
    column = (np.cumsum(times > 1) - 1)[number[twice]]
    row, weight = owner[twice], weights[first][times > 1]
    common = np.zeros((len(nodes), len(nodes)))
    for lo in range(0, len(weight), 4096):
        m = np.zeros((len(nodes), min(4096, len(weight) - lo)), np.float32)
        here = (column >= lo) & (column < lo + 4096)
        m[row[here], column[here] - lo] = 1
        common += (m * weight[lo: lo + 4096]) @ m.T
    like = common >= (threshold - 1e-6) * (total[:, None] + total[None, :] - common)
    like &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
    np.fill_diagonal(like, False)
    label, links, seen = np.array(nodes), [], np.zeros(len(nodes), bool)
    for i in np.argsort(label):
        if seen[i]:
            continue
        seen[i], todo = True, [i]
        while todo:
            for j in np.flatnonzero(like[todo.pop()] & ~seen):
                seen[j] = True
                links.append((int(label[i]), int(label[j])))
                todo.append(j)
    return links


def _block_links(rows: DataFrame, known: DataFrame, idf: np.ndarray, threshold: float, k: int, block: int) -> DataFrame:
    """(a, b): links in large buckets; a bucket is dealt into blocks of about ``block`` nodes, and each pair of blocks is a group."""
    blocks = F.ceil(F.col("n") / block)
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int").alias("mine")
    spread = rows.select("bucket", "node", mine, F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("other")).select(
        "bucket", "node", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    some = in_map(known, "doc_id", id_map(rows.select("node").distinct(), "node"))

    def compare(group: pa.Table) -> pa.Table:
        words = WordHashes()
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        side = np.array([2 if x == y else int(m == y) for m in group.column("mine").to_pylist()])
        sets = []
        for t in group.column("text").to_pylist():
            h = words.text(t)
            sets.append((*weighted_shingles(h, idf, k), np.unique(shingles(h, k), return_counts=True)[1]))
        links = similar_stars(group.column("node").to_pylist(), side, sets, threshold)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return spread.join(some, F.col("doc_id") == F.col("node")).select("bucket", "x", "y", "mine", "node", "text") \
        .groupBy("bucket", "x", "y").applyInArrow(compare, "a long, b long")


#: Numbers of the second and further texts of one id; ids lie below.
_FURTHER = 1 << 62


def _numbered(nodes: DataFrame) -> DataFrame:
    """``node`` for each distinct text: the smallest id that has it, or where that id stands for another text already,
    a number above all ids made of the text's key."""
    nodes = cut(nodes.withColumn("node", F.col("from.doc_id")))
    clash = cut(nodes.groupBy("node").agg(F.min("key").alias("_keep"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    if clash.isEmpty():
        return nodes
    own = F.lit(_FURTHER) + F.shiftrightunsigned(F.xxhash64("key"), 3)
    return nodes.join(clash, "node", "left").withColumn(
        "node", F.when(F.col("_keep").isNull() | (F.col("_keep") == F.col("key")), F.col("node")).otherwise(own)).drop("_keep")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, bands: int = 9, rows: int = 3,
                    small: int = 24, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (the smallest id of its class), n_words.

    At a similarity of 0.8 three rows and nine bands miss a pair with a
    probability of 0.002, at 0.85 of 0.0002.
    """
    texts = doc_texts(docs, id_col, text_col)
    idf = word_frequencies(texts)
    sig = cut(signatures(texts, idf, bands, rows, k))
    nodes = cut(_numbered(sig.where("doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "of")).alias("from"), F.first("bands").alias("bands"))))
    # ids that repeat with other words tie their nodes together
    same = sig.where("doc_id is not null").join(nodes.select("key", "node"), "key").select("doc_id", "node")
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    first = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1")
    found = cut(members.join(first, "bucket"))
    pairs = cut(found.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    wanted = cut(found.select("node").distinct().join(nodes, "node").select(F.col("from.doc_id").alias("doc_id"), F.col("from.of").alias("of"), "node"))
    known = written(in_map(texts, "doc_id", id_map(wanted, "doc_id")).withColumn("of", F.xxhash64("text")).join(wanted, ["doc_id", "of"])
                    .groupBy("node").agg(F.min("text").alias("text")).select(F.col("node").alias("doc_id"), "text"))
    links = cut(verified_links(pairs, known, idf, threshold, k).select("a", "b"))
    comp = connected_components(links)
    rest = found.where("n > 2 and node <> centre").select("bucket", "node").join(comp, F.col("id") == F.col("node"), "left") \
        .select("bucket", "node", F.coalesce("component", "node").alias("comp"))
    mixed_ = rest.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    rest = cut(rest.join(mixed_, "bucket").select("bucket", "node"))
    weights = _shared_weights(rest.select("node").distinct(), known, idf, k)
    open_ = _open_rows(rest, comp, weights, threshold)
    more = cut(_small_pairs(open_.where(F.col("n") <= small), threshold).join(pairs, ["a", "b"], "left_anti"))
    some = in_map(known, "doc_id", id_map(more.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id"))
    links = links.unionByName(verified_links(more, some, idf, threshold, k).select("a", "b")) \
        .unionByName(_block_links(open_.where(F.col("n") > small), known, idf, threshold, k, block))
    tied = same.where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    comp = connected_components(links.unionByName(tied))
    return sig.join(nodes.select("key", "node"), "key", "left").join(comp, F.col("id") == F.col("node"), "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("class_id"), "n_words")


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class: that of the class id.

    Rows with a null id stay; of rows that repeat an id one stays (the one
    whose columns hash lowest).
    """
    ids = classes.where(F.col("doc_id") == F.col("class_id")).groupBy("doc_id").agg(F.count("*").alias("rows"))
    ids = ids.select(F.col("doc_id").alias("__id"), F.col("rows").alias("__rows"))
    kept = docs.join(ids, F.col(id_col) == F.col("__id"), "left").where(F.col("__id").isNotNull() | F.col(id_col).isNull())
    single = kept.where("__rows is null or __rows = 1").drop("__id", "__rows")
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(*[c for c in docs.columns]), *[F.col(c) for c in docs.columns])
    repeated = kept.where("__rows > 1").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__id", "__rows", "__n")
    return single.unionByName(repeated)
