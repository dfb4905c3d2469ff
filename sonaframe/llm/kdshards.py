"""K-d tree sharding: recursive splits at distributed weighted medians.

A node of the tree is split along its widest metadata dimension (its range
in the node over its range in the table), at the place that divides its bytes
in the ratio of the shards that each side is to become, until every leaf is
one shard.  Only DataFrame operations run; no text leaves its row after its
size and hashes are taken.

The weighted median is found by histograms: a job sums the bytes of
``BINS`` bins for all nodes of a level at once, the bin that holds the median
is taken apart by the next job, and so on.  The driver gets at most ``BINS``
rows a node.  Along a dimension rows are ordered by (value, hash of the text,
hash of the row).  A cut between two values, or else between two texts, is
preferred, so that equal texts share a shard; where the text at the median is
so large a group of copies that the sides would differ by more than
``tolerance`` of the node, the next widest dimension is tried, and if none
fits the group itself is cut, as a group can be larger than a shard.

Edge cases: a null text has size 1 and the checksum of an empty text; null
metadata is a value of its own (0); rows that repeat are placed each; an
empty table gives an empty result; with fewer rows than shards some shards
stay empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..util.rank import number_rows
from .shared import cut

BINS = 1024
#: Hashes are cut to 53 bits, so that they are exact as doubles.
_HASH = 1 << 53


def _unit(c: Column) -> Column:
    """A string as a number from 0 to 1, null as 0."""
    return F.coalesce(F.shiftrightunsigned(F.xxhash64(c), 11) / F.lit(float(_HASH)), F.lit(0.0)) if c is not None else F.lit(0.0)


@dataclass
class _Node:
    node: int
    shards: int
    bytes: int
    first: int                      # number of its first shard
    widths: list[float] = field(default_factory=list)
    dims: list[int] = field(default_factory=list)   # still to be tried, widest first
    dim: int = 0
    stage: int = 0                  # 0: value, 1: text hash, 2: row hash
    lo: float = 0.0
    hi: float = 0.0
    value: float = 0.0
    text: float = 0.0
    before: int = 0                 # bytes in front of the interval
    forced: bool = False            # a group may be cut
    best: tuple | None = None       # the least bad cut between texts: (error, dim, stage, value, text, at, inclusive)
    cut: tuple | None = None

    @property
    def target(self) -> float:
        return self.bytes * (self.shards // 2) / self.shards


def _points(docs: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """doc_id, size, text_crc32, t (text hash), r (row hash), d (dimensions, the same for equal texts), node."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 11).cast("double").alias("t"),
        F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(5)), 11).cast("double").alias("r"),
        *[c.cast("double").alias(f"d{i}") for i, c in enumerate(dims.values())])
    rows = cut(rows)
    names = [f"d{i}" for i in range(len(dims))]
    # copies of a text can differ in metadata: all take the smallest, to stay together
    groups = cut(rows.groupBy("t").agg(*[F.min(n).alias(n) for n in names]))
    return rows.drop(*names).join(groups, "t").withColumn("d", F.array(*names)).drop(*names).withColumn("node", F.lit(1).cast("long"))


def _values(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of literals (one row a node)."""
    names = [p.split() for p in schema.split(", ")]
    body = ", ".join("(" + ", ".join(f"cast('{v!r}' as {t})" if t == "double" else f"cast({v} as {t})" for v, (_, t) in zip(r, names)) + ")" for r in rows)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {body} AS x({', '.join(n for n, _ in names)})")


def _histogram(points: DataFrame, nodes: list[_Node]) -> dict[int, list[tuple]]:
    """For each node its bins (bytes, smallest and largest coordinate), in order."""
    spec = _values(points, [(n.node, n.dim, n.stage, n.lo, n.hi, n.value, n.text) for n in nodes],
                   "node bigint, dim int, stage int, lo double, hi double, fv double, ft double")
    v = F.element_at("d", F.col("dim") + 1)
    x = F.when(F.col("stage") == 0, v).when(F.col("stage") == 1, F.col("t")).otherwise(F.col("r"))
    inside = ((F.col("stage") == 0) | (v == F.col("fv"))) & ((F.col("stage") < 2) | (F.col("t") == F.col("ft"))) & x.between(F.col("lo"), F.col("hi"))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BINS - 1), F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))).otherwise(0)
    rows = points.join(F.broadcast(spec), "node").where(inside).select("node", bin_.cast("int").alias("bin"), x.alias("x"), "size") \
        .groupBy("node", "bin").agg(F.sum("size").alias("bytes"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    out: dict[int, list[tuple]] = {n.node: [] for n in nodes}
    for r in sorted(rows, key=lambda r: (r["node"], r["bin"])):
        out[r["node"]].append((r["bytes"], r["lo"], r["hi"]))
    return out


def _narrow(n: _Node, bins: list[tuple], tolerance: float) -> None:
    """Set the node's cut, or a smaller interval for the next histogram."""
    before = n.before
    for size, lo, hi in bins:
        if before + size >= n.target or (size, lo, hi) == bins[-1]:
            break
        before += size
    after = before + size
    left, right = n.target - before, after - n.target
    error = min(left, right)
    allowed = tolerance * n.bytes
    # a cut in front of or behind the bin, whichever is nearer; never an empty side
    behind = right <= left or before == 0
    if behind and after == n.bytes and before > 0:
        behind = False
    here = (error, n.dim, n.stage, n.value, n.text, hi if behind else lo, behind)
    if error <= allowed * 0.02 or (lo == hi and n.stage == 2):
        n.cut = here[1:]
    elif lo < hi:
        n.lo, n.hi, n.before = lo, hi, before
    elif n.stage == 0:
        n.value, n.stage, n.lo, n.hi, n.before = lo, 1, 0.0, float(_HASH), before
    elif error <= allowed:
        n.cut = here[1:]
    elif n.forced:
        n.text, n.stage, n.lo, n.hi, n.before = lo, 2, 0.0, float(_HASH), before
    else:  # a group of copies lies across the median
        if n.best is None or error < n.best[0]:
            n.best = here
        n.dims.pop(0)
        if not n.dims:
            n.forced, n.dims = True, [n.best[1]]
        n.dim, n.stage, n.before = n.dims[0], 0, 0
        n.lo, n.hi = float("-inf"), float("inf")


def _go_left(dim: str, stage: str, value: str, text: str, at: str, inclusive: str) -> Column:
    v = F.element_at("d", F.col(dim) + 1)
    below = lambda x: (x < F.col(at)) | (F.col(inclusive) & (x == F.col(at)))
    same_v = v == F.col(value)
    return F.when(F.col(stage) == 0, below(v)) \
        .when(F.col(stage) == 1, (v < F.col(value)) | (same_v & below(F.col("t")))) \
        .otherwise((v < F.col(value)) | (same_v & ((F.col("t") < F.col(text)) | ((F.col("t") == F.col(text)) & below(F.col("r"))))))


def kd_shards(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, tolerance: float = 0.005,
              dims: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null) of every row of ``docs``.

    The number of leaves is ``shards``, or else all bytes over
    ``target_bytes``.  ``dims`` are numeric metadata columns; by default the
    logarithm of the size, the language and the source where they exist.
    """
    if dims is None:
        dims = {"size": F.log2(F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1)}
        dims |= {c: _unit(F.col(c)) for c in ("lang", "source") if c in docs.columns}
    dims = {k: F.coalesce(c, F.lit(0.0)) for k, c in dims.items()}
    points = cut(_points(docs, dims))
    total = points.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    leaves: list[_Node] = []
    level = [_Node(1, shards, total, 0)] if total else []
    whole: list[float] | None = None
    while level:
        leaves += [n for n in level if n.shards == 1]
        level = [n for n in level if n.shards > 1]
        if not level:
            break
        ranges = {r["node"]: r for r in points.groupBy("node").agg(
            F.sum("size").alias("bytes"), *[f(F.element_at("d", i + 1)).alias(f"{f.__name__}{i}") for i in range(len(dims)) for f in (F.min, F.max)]).collect()}
        if whole is None:
            whole = [max(ranges[1][f"max{i}"] - ranges[1][f"min{i}"], 1e-300) for i in range(len(dims))]
        for n in list(level):
            r = ranges.get(n.node)
            if r is None:  # fewer rows than shards: an empty side
                level.remove(n)
                continue
            n.bytes = r["bytes"]
            n.widths = [(r[f"max{i}"] - r[f"min{i}"]) / whole[i] for i in range(len(dims))]
            n.dims = sorted(range(len(dims)), key=lambda i: -n.widths[i])
            n.dim, n.lo, n.hi = n.dims[0], float("-inf"), float("inf")
        while open_ := [n for n in level if n.cut is None]:
            for n in open_:  # a fresh dimension starts at the node's range
                if n.lo == float("-inf"):
                    n.lo, n.hi = ranges[n.node][f"min{n.dim}"], ranges[n.node][f"max{n.dim}"]
            bins = _histogram(points, open_)
            for n in open_:
                _narrow(n, bins[n.node], tolerance)
        cuts = _values(points, [(n.node, *n.cut) for n in level], "node bigint, dim int, stage int, fv double, ft double, at double, incl boolean")
        left = _go_left("dim", "stage", "fv", "ft", "at", "incl")
        side = F.when(F.col("dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(left, 0).otherwise(1))
        points = cut(points.join(F.broadcast(cuts), "node", "left").withColumn("node", side).select(*points.columns))
        level = [c for n in level for c in (_Node(2 * n.node, n.shards // 2, 0, n.first),
                                            _Node(2 * n.node + 1, n.shards - n.shards // 2, 0, n.first + n.shards // 2))]
    names = _values(points, [(n.node, n.first) for n in leaves] or [(1, 0)], "node bigint, shard int")
    placed = points.join(F.broadcast(names), "node").select("doc_id", "size", "text_crc32", "shard", "t", "r")
    numbered = cut(number_rows(placed, ["shard", "t", "r", "doc_id"], "n"))
    starts = numbered.groupBy("shard").agg(F.min("n").alias("start"))  # one row a shard
    return numbered.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("n") - F.col("start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
