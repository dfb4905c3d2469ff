"""Hard negatives by full exact scores: subset-sum tables of anchors looked up by bit planes of candidates.

Integer vectors are cut into groups of eight dimensions.  A candidate block
stores, for each bit of its components and each group, one byte a row: that
bit of the eight components.  An anchor has for each group a table of the 256
subset sums of its eight components, so one byte is one lookup, and a score is
the sum of the lookups of all groups, shifted and added from the highest bit
plane down.  Every anchor meets every row; scores are exact integers.

Two rounds run over cells of a bounded number of anchors and candidates: the
first keeps each anchor's best rows of its own label (the positives), the
second, for each positive, the best rows of other labels whose score lies
between ``low_percent`` and 100 percent of the positive's.  A cell returns a
bounded number of rows for each of its anchors.

Edge cases: rows whose id, label or vector is null, or whose vector holds a
null, NaN or infinite component, take no part; vectors of different lengths do
not meet; an anchor skips its own row only, so a row that repeats an id is a
row of its own (as anchor, too); ties go to the smaller id; an anchor without
positives, or a positive without eligible rows, gives no row; an empty table
gives an empty result; other columns are ignored.  Scores must stay below
2 ** 50 in magnitude, else the job stops with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts, written

GROUP = 8
_LOWEST = np.iinfo(np.int64).min
_LIMIT = float(1 << 50)


def bit_planes(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Bytes ``[bit, group, row]`` of the integer rows of ``x`` less their smallest component, and that component."""
    n, dim = x.shape
    low = int(x.min()) if x.size else 0
    v = np.zeros((n, -(-dim // GROUP) * GROUP), np.uint64)
    v[:, :dim] = (x - np.int64(low)).view(np.uint64)
    bits = max(1, int(v.max()).bit_length()) if v.size else 1
    planes = [np.packbits(((v >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).reshape(n, v.shape[1] // GROUP, GROUP), axis=2, bitorder="little")[:, :, 0].T
              for b in range(bits)]
    return np.ascontiguousarray(planes), low


def rows_of_planes(planes: np.ndarray, low: int, dim: int, at: np.ndarray) -> np.ndarray:
    """The integer rows ``at`` that the planes hold."""
    out = np.zeros((len(at), planes.shape[1] * GROUP), np.uint64)
    for b in range(planes.shape[0]):
        bits = np.unpackbits(planes[b][:, at].T[:, :, None], axis=2, bitorder="little")
        out |= bits.reshape(out.shape).astype(np.uint64) << np.uint64(b)
    return out[:, :dim].view(np.int64) + np.int64(low)


def subset_sums(x: np.ndarray, dtype=np.int64) -> np.ndarray:
    """``[group, byte, anchor]``: the sum of the anchor's components whose bit the byte has."""
    n, dim = x.shape
    padded = np.zeros((n, -(-dim // GROUP) * GROUP), dtype)
    padded[:, :dim] = x
    out = np.zeros((padded.shape[1] // GROUP, 1 << GROUP, n), dtype)
    for g in range(out.shape[0]):
        for i in range(GROUP):
            out[g, 1 << i: 2 << i] = out[g, : 1 << i] + padded[:, g * GROUP + i]
    return out


class Anchors:
    """Subset-sum tables of a group of anchors."""

    def __init__(self, x: np.ndarray):
        self.x, self.total = x, x.sum(axis=1)
        self.weight = float(np.abs(x.astype(np.float64)).sum(axis=1).max()) if len(x) else 0.0
        self.tables: dict[type, np.ndarray] = {}

    def scores(self, planes: np.ndarray, low: int, rows: int = 256) -> np.ndarray:
        """Inner products ``[candidate, anchor]``, by lookups only."""
        bits, groups, n = planes.shape
        most = self.weight * (abs(low) + 2.0 ** bits)
        if most >= _LIMIT:
            raise ValueError("inner products beyond 2 ** 50: use a smaller scale")
        dtype = np.int32 if most < 2 ** 31 - 1 else np.int64
        if dtype not in self.tables:
            self.tables[dtype] = subset_sums(self.x, dtype)
        tables = self.tables[dtype]
        out = np.zeros((n, len(self.x)), dtype)
        buf = np.empty((min(rows, n), len(self.x)), dtype)
        for s in range(0, n, rows):
            acc = out[s: s + rows]
            for b in range(bits - 1, -1, -1):
                acc <<= 1
                for g in range(groups):
                    acc += np.take(tables[g], planes[b, g, s: s + rows], axis=0, out=buf[: len(acc)], mode="clip")
        out += (self.total * low).astype(dtype)
        return out


def best_rows(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the ``k`` best allowed candidates (ties: the earlier row): row numbers, -1 where there are fewer, and scores."""
    n, anchors = scores.shape
    key = np.where(allowed, scores.astype(np.int64) * n + (n - 1 - np.arange(n))[:, None], _LOWEST).T
    top = key if n <= k else np.partition(key, n - k, axis=1)[:, n - k:]
    top = -np.sort(-np.maximum(top, _LOWEST + 1), axis=1)
    at = np.where(top > _LOWEST + 1, n - 1 - np.mod(top, n), -1)
    return at, np.where(at >= 0, np.floor_divide(top, n), _LOWEST)


def _merged(old, new, k: int):
    """The k best of two ``(score, id, row)`` triples of shape [anchor, any]; empty places have the lowest score."""
    score, ids, row = (np.concatenate([a, b], axis=1) for a, b in zip(old, new))
    first = np.lexsort((row, ids, -np.maximum(score, _LOWEST + 1)), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, first, 1) for x in (score, ids, row))


def _ints(cell) -> np.ndarray:
    return np.frombuffer(cell.as_py(), np.int64)


def _points(vectors: DataFrame, id_col: str, column: str, label: Column, scale: int, anchors: Column) -> DataFrame:
    fine = F.forall(F.col(column), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(column).isNotNull()).where(fine).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(F.col(column), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long")).alias("x"))
    return rows.where("label is not null").withColumn("asked", F.coalesce(anchors, F.lit(False)))


def _blocks(points: DataFrame, block_rows: int) -> DataFrame:
    """Rows packed where they lie into blocks of bit planes, in order of id within a block."""
    def pack(batches):
        seq = 0
        for b in parts(batches, block_rows):
            lists = b.column(b.schema.names.index("x"))
            sizes = np.asarray(pa.compute.list_value_length(lists), np.int64)
            flat, ends = np.asarray(lists.flatten(), np.int64), np.cumsum(sizes)
            ids, label, asked = (np.asarray(b.column(b.schema.names.index(c))) for c in ("id", "label", "asked"))
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                mine = mine[np.argsort(ids[mine], kind="stable")]
                x = flat[(ends[mine] - dim)[:, None] + np.arange(dim)] if dim else np.zeros((len(mine), 0), np.int64)
                planes, low = bit_planes(x)
                yield pa.RecordBatch.from_pylist([{
                    "block": (TaskContext.get().partitionId() << 24) + seq, "dim": dim, "rows": len(mine), "bits": planes.shape[0], "low": low,
                    "planes": planes.tobytes(), "ids": ids[mine].astype(np.int64).tobytes(), "labels": label[mine].astype(np.int64).tobytes(),
                    "asked": np.flatnonzero(asked[mine]).astype(np.int64).tobytes(), "n_asked": int(asked[mine].sum())}], schema=schema)
                seq += 1

    names = "block long, dim int, rows int, bits int, low long, planes binary, ids binary, labels binary, asked binary, n_asked int"
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in names.split(", "))])
    return points.mapInArrow(pack, names)


def _anchor_rows(blocks: DataFrame, block_rows: int) -> DataFrame:
    """One row an anchor: dim, row number (block * block_rows + place), id, label and integer components."""
    def unpack(batches):
        for b in parts(batches, 8):
            for r in b.to_pylist():
                at = np.frombuffer(r["asked"], np.int64)
                if not len(at):
                    continue
                planes = np.frombuffer(r["planes"], np.uint8).reshape(r["bits"], -(-r["dim"] // GROUP), r["rows"])
                x = rows_of_planes(planes, r["low"], r["dim"], at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), r["dim"], np.int32)), pa.array(r["block"] * block_rows + at), pa.array(np.frombuffer(r["ids"], np.int64)[at]),
                     pa.array(np.frombuffer(r["labels"], np.int64)[at]), pa.array([v.tobytes() for v in x], pa.binary())],
                    names=["dim", "anchor", "anchor_id", "label", "x"])

    return blocks.where("n_asked > 0").mapInArrow(unpack, "dim int, anchor long, anchor_id long, label long, x binary")


def _cell(left: pa.Table, right: pa.Table, block_rows: int, group_rows: int, visit):
    """Calls ``visit(anchors, lo, hi, own, scores, labels, ids, rows)`` for each anchor group and block of a cell."""
    dim = left.column("dim")[0].as_py()
    x = np.frombuffer(b"".join(left.column("x").to_pylist()), np.int64).reshape(left.num_rows, dim)
    row = np.asarray(left.column("anchor").combine_chunks(), np.int64)
    for lo in range(0, left.num_rows, group_rows):
        hi = min(lo + group_rows, left.num_rows)
        group = Anchors(x[lo:hi])
        for i in range(right.num_rows):
            n, bits = right.column("rows")[i].as_py(), right.column("bits")[i].as_py()
            planes = np.frombuffer(right.column("planes")[i].as_py(), np.uint8).reshape(bits, -(-dim // GROUP), n)
            rows = right.column("block")[i].as_py() * block_rows + np.arange(n)
            scores = group.scores(planes, right.column("low")[i].as_py())
            visit(lo, hi, rows[:, None] == row[None, lo:hi], scores, _ints(right.column("labels")[i]), _ints(right.column("ids")[i]), rows)


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column | str = "label", scale: int = 256, positives: int = 5, negatives: int = 5,
                   low_percent: int = 80, id_col: str = "vec_id", column: str = "embedding", block_rows: int = 2048, group_rows: int = 512,
                   cell_anchors: int = 4096, cell_blocks: int = 32) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``anchors`` is a condition on ``id``; ``label`` a column of ``vectors`` or
    an expression over them, compared as a long.
    """
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    blocks = written(_blocks(_points(vectors, id_col, column, label, scale, anchors), block_rows))
    size = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n_asked"), F.lit(0)).alias("asked")).first()
    down = max(1, -(-size["asked"] // cell_anchors))
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    across = max(1, min(size["blocks"], max(-(-size["blocks"] // cell_blocks), -(-2 * width // down))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = blocks.drop("asked", "n_asked").withColumn("across", F.pmod(F.xxhash64("block"), F.lit(across)).cast("int")).withColumn("down", every(down))
    asked = written(_anchor_rows(blocks, block_rows).withColumn("down", F.pmod(F.xxhash64("anchor"), F.lit(down)).cast("int")))
    key = ["dim", "down", "across"]

    def own_label(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        best = tuple(np.full((n, positives), v, np.int64) for v in (_LOWEST, 0, 0))
        mine = np.asarray(left.column("label").combine_chunks(), np.int64) if n else np.zeros(0, np.int64)

        def visit(lo, hi, own, scores, labels, ids, rows):
            at, s = best_rows(scores, (labels[:, None] == mine[None, lo:hi]) & ~own, positives)
            got = _merged(tuple(v[lo:hi] for v in best), (s, ids[at], rows[at]), positives)
            for v, w in zip(best, got):
                v[lo:hi] = w

        if n and right.num_rows:
            _cell(left, right, block_rows, group_rows, visit)
        i, j = np.nonzero(best[0] > _LOWEST)
        rows = np.asarray(left.column("anchor").combine_chunks(), np.int64)[i] if n else np.zeros(0, np.int64)
        return pa.table([rows, best[0][i, j], best[1][i, j], best[2][i, j]], names=["anchor", "score", "id", "row"])

    found = asked.withColumn("across", every(across)).groupBy(*key).cogroup(cells.groupBy(*key)).applyInArrow(
        own_label, "anchor long, score long, id long, row long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    chosen = written(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
                     .select("anchor", F.col("place").cast("int").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    floor = asked.join(chosen.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("limits")), "anchor") \
        .withColumn("limits", F.transform("limits", lambda s: s["positive_score"]))

    def other_labels(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        limits = left.column("limits").to_pylist() if n else []
        best = [tuple(np.full((n, negatives), v, np.int64) for v in (_LOWEST, 0, 0)) for _ in range(positives)]
        mine = np.asarray(left.column("label").combine_chunks(), np.int64) if n else np.zeros(0, np.int64)

        def visit(lo, hi, own, scores, labels, ids, rows):
            other = labels[:, None] != mine[None, lo:hi]
            hundred = 100 * scores.astype(np.int64)
            for p in range(positives):
                has = np.array([len(x) > p for x in limits[lo:hi]])
                if not has.any():
                    break
                limit = np.array([x[p] if len(x) > p else 0 for x in limits[lo:hi]], np.int64)
                at, s = best_rows(scores, other & has & (hundred <= 100 * limit) & (hundred >= low_percent * limit), negatives)
                got = _merged(tuple(v[lo:hi] for v in best[p]), (s, ids[at], rows[at]), negatives)
                for v, w in zip(best[p], got):
                    v[lo:hi] = w

        if n and right.num_rows:
            _cell(left, right, block_rows, group_rows, visit)
        rows = np.asarray(left.column("anchor").combine_chunks(), np.int64) if n else np.zeros(0, np.int64)
        out = []
        for p, b in enumerate(best):
            i, j = np.nonzero(b[0] > _LOWEST)
            out.append(pa.table([rows[i], pa.array(np.full(len(i), p + 1, np.int32)), b[0][i, j], b[1][i, j], b[2][i, j]],
                                names=["anchor", "place", "score", "id", "row"]))
        return pa.concat_tables(out)

    lower = floor.withColumn("across", every(across)).groupBy(*key).cogroup(cells.groupBy(*key)).applyInArrow(
        other_labels, "anchor long, place int, score long, id long, row long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "row")
    ranked = lower.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.join(chosen, ["anchor", "place"]).join(asked.select("anchor", "anchor_id"), "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
