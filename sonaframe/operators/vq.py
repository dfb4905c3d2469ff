"""Vector quantisation over embedding tables.

A codebook (K codes × D dims) is a model.  One of up to ``MAX_CODEBOOK_BYTES``
is sent to every task as a float64 matrix, its rows in order of their norm.
Vectors meet it in tiles of bounded size by matrix products
(``x² − 2xc + c²``); a tile of codes whose norms lie further from a vector's
norm than its best distance so far is skipped.  Codes that come within
rounding of the smallest distance are compared again by exact left-to-right
sums, so ties go to the lowest code.

A larger codebook is cut into blocks in order of norm, and the distinct
vectors into blocks in the same order.  Each block of vectors first meets the
code block of its own norm, then only those that its norms and its largest
distance cannot rule out, in cells of one vector block and one code block; so
no task's memory depends on K.  Results do not depend on the way.

Per-code sums are added up in each task before they are shuffled.  Iterative
k-means re-collects the means of a small codebook each round; a large one is
checkpointed.

Vectors that are null, hold nulls or differ in length from the codebook get a
null code and take no part in sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..util.rank import global_row_number, md5_key

#: Codebooks up to this size are sent to every task.
MAX_CODEBOOK_BYTES = 256 << 20
#: Codes of one block of a larger codebook, and vectors of one block that meets it.
BLOCK_CODES = 4096
BLOCK_VECTORS = 4096
#: A tile of distances: so many vectors by so many codes.
TILE_VECTORS = 512
TILE_CODES = 2048


def as_double_vec(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.transform(x, lambda v: v.cast("double"))


def codebook_matrix(codebook: DataFrame, code_col: str = "code", vec_col: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """Codes (ascending) and their vectors."""
    rows = codebook.select(F.col(code_col).cast("int"), as_double_vec(vec_col)).orderBy(code_col).collect()
    return np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)


def codebook_bytes(codebook: DataFrame, vec_col: str = "vec") -> int:
    return (codebook.agg(F.sum(F.size(vec_col).cast("long"))).first()[0] or 0) * 8


def exact_distances(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, summed from left to right in double."""
    d = (x - m) ** 2
    return np.cumsum(d, axis=1)[:, -1] if d.shape[1] else np.zeros(len(d))


class Codes:
    """Codes and their vectors in order of norm, in tiles with their smallest and largest norm."""

    def __init__(self, codes: np.ndarray, m: np.ndarray):
        square = (m * m).sum(1) if m.size else np.zeros(len(m))
        by = np.lexsort((codes, square))
        self.codes, self.m, self.square = codes[by], m[by], square[by]
        self.tiles = [(lo, min(lo + TILE_CODES, len(m))) for lo in range(0, len(m), TILE_CODES)]
        norm = np.sqrt(self.square)
        self.low, self.high = np.array([norm[lo] for lo, _ in self.tiles]), np.array([norm[hi - 1] for _, hi in self.tiles])


def _in_tile(x: np.ndarray, xx: np.ndarray, codes: np.ndarray, m: np.ndarray, mm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest row of one tile for each vector (of equals that with the lowest code), and its distance."""
    d = xx[:, None] - 2 * (x @ m.T) + mm[None, :]
    best = d.argmin(axis=1)
    slack = 1e-9 * (xx + mm.max()) + 1e-300
    near = d <= (d[np.arange(len(x)), best] + slack)[:, None]
    for i in np.flatnonzero(near.sum(1) > 1):
        c = np.flatnonzero(near[i])
        exact = exact_distances(np.broadcast_to(x[i], (len(c), x.shape[1])), m[c])
        best[i] = c[np.lexsort((codes[c], exact))[0]]
    return best, exact_distances(x, m[best])


def nearest(x: np.ndarray, book: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``book`` of the code nearest to each row of ``x`` (of equals the lowest code), and its squared distance."""
    where, dist = np.full(len(x), -1, np.int64), np.full(len(x), np.inf)
    for lo in range(0, len(x), TILE_VECTORS):
        part = x[lo: lo + TILE_VECTORS]
        xx = (part * part).sum(1)
        norm = np.sqrt(xx)
        w, d = where[lo: lo + len(part)], dist[lo: lo + len(part)]
        middle = np.median(norm) if len(norm) else 0.0
        for t in np.argsort(np.maximum(book.low - middle, 0) + np.maximum(middle - book.high, 0), kind="stable"):
            a, z = book.tiles[t]
            apart = np.maximum(np.maximum(book.low[t] - norm, norm - book.high[t]), 0)
            rows = np.flatnonzero(apart * apart <= d + 1e-9 * (xx + book.high[t] ** 2) + 1e-300)
            if not len(rows):
                continue
            at, exact = _in_tile(part[rows], xx[rows], book.codes[a:z], book.m[a:z], book.square[a:z])
            at += a
            better = (exact < d[rows]) | ((exact == d[rows]) & (book.codes[at] < book.codes[w[rows]]))
            w[rows[better]], d[rows[better]] = at[better], exact[better]
    return where, dist


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are vectors of ``dim`` numbers, and their values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = np.asarray(pc.fill_null(flat.cast(pa.float64()), 0.0), np.float64)
    ends = np.cumsum(np.maximum(sizes, 0))
    missing = np.concatenate([[0], np.cumsum(np.asarray(flat.is_null()))])
    ok = np.flatnonzero((sizes == dim) & (missing[ends] == missing[ends - np.maximum(sizes, 0)]))
    return ok, values[(ends[ok] - dim)[:, None] + np.arange(dim)] if dim else np.zeros((len(ok), 0))


def _column(values: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """``values`` (one or a list for each of the rows ``at``) as a column of ``n`` rows, null elsewhere."""
    if values.ndim == 1:
        full = np.zeros(n, values.dtype)
        full[at] = values
        mask = np.ones(n, bool)
        mask[at] = False
        return pa.array(full, mask=mask)
    sizes, absent = np.zeros(n, np.int64), np.ones(n, bool)
    sizes[at], absent[at] = values.shape[1], False
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                    pa.array(np.ascontiguousarray(values).ravel()), mask=pa.array(absent))


def _append(df: DataFrame, vec_col: str, dim: int, fields: Sequence[T.StructField],
            work: Callable[[np.ndarray], Sequence[np.ndarray]]) -> DataFrame:
    """``df`` with columns computed from its vectors, null where there is none."""
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _vectors(b.column(b.schema.names.index(vec_col)), dim)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index(f.name)) for f in kept] + [_column(v, at, b.num_rows) for v in work(x)],
                                             names=[f.name for f in kept] + [f.name for f in fields])

    return df.mapInArrow(run, T.StructType([*kept, *fields]))


def _with_codes(df: DataFrame, codebook: DataFrame, vec_col: str, code_col: str, cb_vec_col: str,
                out_col: str, dist_col: str | None = None) -> DataFrame:
    if codebook_bytes(codebook, cb_vec_col) > MAX_CODEBOOK_BYTES:
        return _by_blocks(df, codebook, vec_col, code_col, cb_vec_col, out_col, dist_col)
    book = Codes(*codebook_matrix(codebook, code_col, cb_vec_col))
    fields = [T.StructField(out_col, T.IntegerType())] + ([T.StructField(dist_col, T.DoubleType())] if dist_col else [])
    if not len(book.codes):
        return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields})

    def work(x):
        at, dist = nearest(x, book)
        return [book.codes[at], dist][: len(fields)]

    return _append(df, vec_col, book.m.shape[1], fields, work)


def _by_norm(rows: DataFrame, size: int, block: str) -> DataFrame:
    """Rows (key, x) with equal-sized blocks in order of their norm."""
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    return global_row_number(rows.withColumn("_n2", norm), ["_n2", "key"], "_rn").withColumn(block, F.floor((F.col("_rn") - 1) / size).cast("long")).drop("_rn")


def _packed(rows: DataFrame, block: str, dim: int) -> DataFrame:
    """One row a block: its keys, its matrix, its smallest and largest norm."""
    def pack(part: pa.Table) -> pa.Table:
        at, x = _vectors(part.column("x"), dim)
        norm = np.sqrt((x * x).sum(1))
        return pa.table({block: part.column(block)[:1], f"{block}_keys": pa.array([pc.take(part.column("key").combine_chunks(), pa.array(at)).to_pylist()],
                                                                                  pa.list_(part.schema.field("key").type)),
                         f"{block}_x": pa.array([x.tobytes()], pa.binary()), f"{block}_low": [float(norm.min())], f"{block}_high": [float(norm.max())]})

    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy(block).applyInArrow(
        pack, f"{block} long, {block}_keys array<{kind}>, {block}_x binary, {block}_low double, {block}_high double")


def _by_blocks(df: DataFrame, codebook: DataFrame, vec_col: str, code_col: str, cb_vec_col: str, out_col: str,
               dist_col: str | None = None, code_vec_col: str | None = None) -> DataFrame:
    """The same for a codebook of any size; ``code_vec_col`` gets the vector of the code."""
    ensure_checkpoint_dir(df.sparkSession)
    codes = codebook.select(F.col(code_col).cast("int").alias("key"), as_double_vec(cb_vec_col).alias("x"))
    dim = codes.select(F.size("x")).first()[0]
    book = _packed(_by_norm(codes, BLOCK_CODES, "c"), "c", dim).checkpoint()
    rows = df.withColumn("_key", F.sha2(F.to_json(F.struct(F.col(vec_col).alias("v"))), 256))
    whole = F.col("x").isNotNull() & (F.size("x") == dim) & F.forall("x", lambda v: v.isNotNull())
    distinct = rows.select(F.col("_key").alias("key"), as_double_vec(vec_col).alias("x")).where(whole).dropDuplicates(["key"])
    vectors = _packed(_by_norm(distinct, BLOCK_VECTORS, "v"), "v", dim).checkpoint()
    # one row a block on both sides: K / BLOCK_CODES norms
    ranges = book.agg(F.array_sort(F.collect_list(F.struct("c_low", "c_high", "c"))).alias("_ranges"))
    near = vectors.select("v", "v_low", "v_high").withColumn("_r", ranges.select("_ranges").scalar())
    apart = lambda r: F.greatest(r["c_low"] - F.col("v_high"), F.col("v_low") - r["c_high"], F.lit(0.0))

    def meet(cells: DataFrame) -> DataFrame:
        def work(batches):
            for b in batches:
                for r in b.to_pylist():
                    x = np.frombuffer(r["v_x"]).reshape(-1, dim)
                    own = Codes(np.array(r["c_keys"], np.int32), np.frombuffer(r["c_x"]).reshape(-1, dim))
                    at, dist = nearest(x, own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), r["v"])), pa.array(r["v_keys"]), pa.array(dist), pa.array(own.codes[at]),
                                                      _column(own.m[at], np.arange(len(x)), len(x))], names=["v", "_key", "d", "code", "m"])

        return cells.join(vectors.select("v", "v_keys", "v_x"), "v").join(book.select("c", "c_keys", "c_x"), "c") \
            .select("v", "v_keys", "v_x", "c_keys", "c_x").mapInArrow(work, "v long, _key string, d double, code int, m array<double>")

    own = near.withColumn("_own", F.array_min(F.transform("_r", lambda r: F.struct(apart(r).alias("apart"), r["c"].alias("c")))))
    start = meet(own.select("v", F.col("_own.c").alias("c"))).checkpoint()
    reach = start.groupBy("v").agg(F.sqrt(F.max("d")).alias("reach"))
    open_ = own.join(reach, "v").select("v", F.explode(F.filter("_r", lambda r: (r["c"] != F.col("_own.c")) & (
        apart(r) <= F.col("reach") + 1e-9 * (F.col("v_high") + r["c_high"]) + 1e-150))).alias("r")).select("v", F.col("r.c").alias("c"))
    best = start.unionByName(meet(open_)).groupBy("_key").agg(F.min_by(F.struct("code", "d", "m"), F.struct("d", "code")).alias("_best"))
    out = rows.join(best, "_key", "left")
    for name, field in ((out_col, "code"), (dist_col, "d"), (code_vec_col, "m")):
        out = out.withColumn(name, F.col(f"_best.{field}")) if name else out
    return out.drop("_key", "_best")


def nearest_code(vectors: DataFrame, codebook: DataFrame, vec_col: str = "vec",
                 code_col: str = "code", cb_vec_col: str = "vec", out_col: str = "code") -> DataFrame:
    """Every vector's nearest code."""
    return _with_codes(vectors, codebook, vec_col, code_col, cb_vec_col, out_col)


def sample_codebook(vectors: DataFrame, id_col: str, vec_col: str, k: int, seed: int = 0) -> DataFrame:
    """K vectors chosen by md5 order of the id (a seeded sample; the limit is the feature).

    With fewer than ``k`` vectors they are taken again in the same order, so
    that there are always ``k`` codes.
    """
    picked = vectors.where(F.col(vec_col).isNotNull()).select(id_col, as_double_vec(vec_col).alias("vec"), md5_key(id_col, seed=seed).alias("_h")) \
        .orderBy("_h", id_col).limit(k)
    rows = picked.orderBy("_h", id_col).collect()  # at most k rows of a model
    schema = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])
    return vectors.sparkSession.createDataFrame([(i, rows[i % len(rows)]["vec"]) for i in range(k)] if rows else [], schema)


def code_sums(assigned: DataFrame, dim: int, vec_col: str = "vec", code_col: str = "code") -> DataFrame:
    """Per code: count and per-dimension sums as ``sum_vec``, added up in each task first."""
    def out(sums):
        flat = np.array(list(sums.values())).reshape(len(sums), dim + 1)
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(flat[:, 0].astype(np.int64)),
                                           _column(flat[:, 1:], np.arange(len(sums)), len(sums))], names=["code", "n", "s"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            at, x = _vectors(b.column(1), dim)
            own = pc.fill_null(b.column(0), -1).to_numpy(zero_copy_only=False).astype(np.int64)[at]
            by = np.argsort(own, kind="stable")
            by = by[own[by] >= 0]
            if not len(by):
                continue
            codes, first = np.unique(own[by], return_index=True)
            n, s = np.diff(np.append(first, len(by))), np.add.reduceat(x[by], first, axis=0)
            for c, k, v in zip(codes.tolist(), n.tolist(), s):
                got = sums.get(c)
                if got is None:
                    sums[c] = np.concatenate([[k], v])
                else:
                    got[0] += k
                    got[1:] += v
            if len(sums) * (dim + 1) > 4_000_000:  # bounded, whatever the number of codes
                yield out(sums)
                sums = {}
        yield out(sums)

    parts = assigned.select(code_col, vec_col).mapInArrow(add, "code int, n long, s array<double>")
    return parts.groupBy("code").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", i)).alias(f"_s{i}") for i in range(dim)]) \
        .select("code", "n", F.array(*[F.col(f"_s{i}") for i in range(dim)]).alias("sum_vec"))


# A12 ------------------------------------------------------------------------------

def kmeans_step(vectors: DataFrame, codebook: DataFrame, dim: int, vec_col: str = "vec") -> DataFrame:
    """One Lloyd round: assign, average; an empty cluster keeps its old mean."""
    data = vectors.select(F.col(vec_col).alias("vec"))
    sums = code_sums(nearest_code(data, codebook), dim)
    old = codebook.select("code", as_double_vec("vec").alias("vec"))
    means = sums.select("code", F.transform("sum_vec", lambda s: s / F.col("n")).alias("mean"), "n")
    return old.join(means, "code", "left").select(
        "code", F.coalesce(F.col("mean"), F.col("vec")).alias("vec"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def kmeans_fit(vectors: DataFrame, id_col: str, vec_col: str, k: int, iters: int = 10, seed: int = 0) -> DataFrame:
    """Lloyd's k-means over the whole table, from md5-sampled means; always ``k`` codes."""
    data = vectors.select(id_col, as_double_vec(vec_col).alias("vec"))
    first = data.where("vec is not null").first()
    cb = sample_codebook(data, id_col, "vec", k, seed)
    if first is None:
        return cb.withColumn("n", F.lit(0).cast("long"))
    spark, dim = vectors.sparkSession, len(first["vec"])
    small = k * dim * 8 <= MAX_CODEBOOK_BYTES
    for _ in range(iters):
        step = kmeans_step(data, cb, dim)
        if not small:
            ensure_checkpoint_dir(spark)
            cb = step.checkpoint()
            continue
        # the K×D means come back as a literal table: each round's lineage stays short
        cb = spark.createDataFrame([(int(r["code"]), [float(x) for x in r["vec"]], int(r["n"])) for r in step.collect()],
                                   "code int, vec array<double>, n long")
    return cb


# A11 ------------------------------------------------------------------------------

def codebook_update(vectors: DataFrame, codebook: DataFrame, dim: int, decay: float = 0.99,
                    eps: float = 1e-5, vec_col: str = "vec") -> DataFrame:
    """One EMA step.  ``codebook``: code, vec, cluster_size, embed_avg.

    cs = d·cs + (1−d)·count; avg = d·avg + (1−d)·sum;
    smoothed = (cs + ε) / (Σcs + K·ε) · Σcs; centroid = avg / smoothed.
    """
    sums = code_sums(nearest_code(vectors.select(F.col(vec_col).alias("vec")), codebook), dim)
    d = F.lit(decay)
    j = codebook.join(sums, "code", "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    s = F.coalesce(F.col("sum_vec"), F.array_repeat(F.lit(0.0), dim))
    upd = j.select(
        "code",
        (d * F.col("cluster_size") + (1 - d) * n).alias("cluster_size"),
        F.zip_with(F.col("embed_avg"), s, lambda a, b: d * a + (1 - d) * b).alias("embed_avg"))
    k = upd.select(F.count(F.lit(1))).scalar()
    total = upd.select(F.sum("cluster_size")).scalar()
    smoothed = (F.col("cluster_size") + F.lit(eps)) / (total + k * F.lit(eps)) * total
    # scalar subqueries cannot sit inside a lambda: materialise the divisor first
    return (upd.withColumn("_sm", smoothed)
               .withColumn("vec", F.transform("embed_avg", lambda a: a / F.col("_sm"))).drop("_sm"))


# A13 ------------------------------------------------------------------------------

def expire_codes(vectors: DataFrame, codebook: DataFrame, id_col: str, vec_col: str,
                 threshold: float = 2, seed: int = 1) -> DataFrame:
    """Codes whose cluster size is below ``threshold`` take the vector at
    their own index in a seeded sample; threshold 0 disables.  ``codebook``
    has code, vec, cluster_size."""
    if threshold <= 0:
        return codebook
    sample = sample_codebook(vectors, id_col, vec_col, codebook.count(), seed).withColumnRenamed("vec", "_new")
    j = codebook.join(sample, "code", "left")
    dead = F.col("cluster_size") < F.lit(threshold)
    return j.select("code", F.when(dead & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("vec")).alias("vec"),
                    "cluster_size", dead.alias("expired"))


# A14 / R10 ----------------------------------------------------------------------------

def commit_loss(vectors: DataFrame, codebook: DataFrame, vec_col: str = "vec") -> DataFrame:
    """Mean squared difference between each vector and its code (one row)."""
    d = _with_codes(vectors.select(F.col(vec_col).alias("vec")), codebook, "vec", "code", "vec", "_code", "_d")
    return d.agg(F.avg(F.col("_d") / F.size("vec")).alias("commit_loss"))


def rvq_encode(vectors: DataFrame, codebooks: Sequence[DataFrame], vec_col: str = "vec",
               n_q: int | None = None, start: int = 0) -> DataFrame:
    """Residual VQ: per layer the nearest code of the residual, then
    subtract that code.  Adds ``quantized``, ``codes`` (array<int>) and
    ``layer_losses`` (mean squared residual error per layer).

    Codebooks that are small together go to the tasks; else each layer is
    looked up in blocks (``_by_blocks``).
    """
    used = list(codebooks)[start: (start + n_q) if n_q else None]
    if sum(codebook_bytes(cb) for cb in used) > MAX_CODEBOOK_BYTES:
        return _rvq_by_blocks(vectors, used, vec_col)
    books = [Codes(*codebook_matrix(cb)) for cb in used]
    first = vectors.where(F.col(vec_col).isNotNull()).select(F.size(vec_col)).first()
    dim = books[0].m.shape[1] if books else (first[0] if first else 0)

    def work(x):
        res, quantized = x.copy(), np.zeros_like(x)
        codes, losses = np.zeros((len(x), len(books)), np.int32), np.zeros((len(x), len(books)))
        for layer, book in enumerate(books):
            at, dist = nearest(res, book)
            codes[:, layer], losses[:, layer] = book.codes[at], dist / max(dim, 1)
            quantized += book.m[at]
            res -= book.m[at]
        return [quantized, codes, losses]

    double = T.ArrayType(T.DoubleType())
    return _append(vectors, vec_col, dim, [T.StructField("quantized", double), T.StructField("codes", T.ArrayType(T.IntegerType())),
                                           T.StructField("layer_losses", double)], work)


def _rvq_by_blocks(vectors: DataFrame, codebooks: Sequence[DataFrame], vec_col: str) -> DataFrame:
    dim = codebooks[0].select(F.size("vec")).first()[0]
    x = as_double_vec(vec_col)
    whole = x.isNotNull() & (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull())
    zero = F.array_repeat(F.lit(0.0), dim)
    out = vectors.withColumns({"_res": F.when(whole, x), "quantized": F.when(whole, zero), "codes": F.when(whole, F.array().cast("array<int>")),
                               "layer_losses": F.when(whole, F.array().cast("array<double>"))})
    for cb in codebooks:
        step = _by_blocks(out, cb, "_res", "code", "vec", "_code", "_dist", "_m")
        out = step.select(*vectors.columns, F.zip_with("_res", "_m", lambda a, b: a - b).alias("_res"),
                          F.zip_with("quantized", "_m", lambda a, b: a + b).alias("quantized"),
                          F.concat("codes", F.array("_code")).alias("codes"), F.concat("layer_losses", F.array(F.col("_dist") / dim)).alias("layer_losses")).checkpoint()
    return out.drop("_res")


def rvq_decode(df: DataFrame, codebooks: Sequence[DataFrame], codes_col: str = "codes") -> DataFrame:
    """R10 decode: the sum of every layer's code vector; null where a code is unknown."""
    if sum(codebook_bytes(cb) for cb in codebooks) > MAX_CODEBOOK_BYTES:
        out = df
        for i, cb in enumerate(codebooks):
            book = cb.select(F.col("code").alias(f"_c{i}"), as_double_vec("vec").alias(f"_m{i}"))
            out = out.join(book, F.get(F.col(codes_col), i) == F.col(f"_c{i}"), "left").drop(f"_c{i}")
        total = F.col("_m0")
        for i in range(1, len(codebooks)):
            total = F.zip_with(total, F.col(f"_m{i}"), lambda a, b: a + b)
        return out.withColumn("decoded", total).drop(*[f"_m{i}" for i in range(len(codebooks))])
    books = [codebook_matrix(cb) for cb in codebooks]
    order = [np.argsort(c, kind="stable") for c, _ in books]
    schema = T.StructType([*[f for f in df.schema.fields if f.name != "decoded"], T.StructField("decoded", T.ArrayType(T.DoubleType()))])
    names = [f.name for f in schema.fields[:-1]]
    dim = books[0][1].shape[1] if books else 0

    def run(batches):
        for b in batches:
            column = b.column(b.schema.names.index(codes_col))
            sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(column.flatten().cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
            starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
            at = np.flatnonzero(sizes >= len(books))
            total = np.zeros((len(at), dim))
            known = np.ones(len(at), bool)
            for i, (codes, m) in enumerate(books):
                own = flat[starts[at] + i] if len(at) else np.zeros(0, np.int64)
                place = order[i][np.minimum(np.searchsorted(codes[order[i]], own), max(len(codes) - 1, 0))] if len(codes) else np.zeros(len(own), np.int64)
                known &= (codes[place] == own) if len(codes) else False
                total += m[place] if len(codes) else 0.0
            yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index(n)) for n in names] + [_column(total[known], at[known], b.num_rows)],
                                             names=[*names, "decoded"])

    return df.mapInArrow(run, schema)
