"""Registered bucketing, batch planning and distribution filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.filters import shard_of, train_val_split
from . import sql
from .base import r6, register, table

# block size of the running scans; small here so the checked run crosses blocks
SCAN_BLOCK = 65_536


@register("length_buckets", """
WITH r AS (SELECT doc_id, CAST(floor(n_chars / 1000.0 / 2.0) AS BIGINT) AS f,
                  row_number() OVER (ORDER BY n_chars / 1000.0, doc_id) AS rn FROM documents)
SELECT doc_id, CAST(rn + least(0, min(f - rn) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS BIGINT) AS bucket
FROM r""")
def q_length_buckets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("sec"))
    return W.length_buckets(d, "sec", "doc_id", 2.0, "exact", block_rows=SCAN_BLOCK).select("doc_id", "bucket")


@register("length_buckets_floor", """
SELECT doc_id, CAST(floor(n_chars / 1000.0 / 2.0) AS BIGINT) AS bucket FROM documents""")
def q_length_buckets_floor(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("sec"))
    return W.length_buckets(d, "sec", "doc_id", 2.0, "floor").select("doc_id", "bucket")


def _raw_bucket_sql(col: str) -> str:
    b = W.DEFAULT_BOUNDARIES
    parts = " ".join(f"WHEN {col} > {b[i]} AND {col} <= {b[i + 1]} THEN {i}" for i in range(len(b) - 1))
    return f"CASE {parts} END"


BOUNDED_SQL = f"""
raw AS (SELECT doc_id, n_chars, {_raw_bucket_sql('n_chars')} AS rb FROM documents),
bb AS (SELECT doc_id, n_chars, CAST(dense_rank() OVER (ORDER BY rb) - 1 AS BIGINT) AS bucket FROM raw WHERE rb IS NOT NULL)"""


@register("bounded_buckets", f"""
WITH {BOUNDED_SQL}
SELECT doc_id, bucket FROM bb""")
def q_bounded_buckets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return W.bounded_buckets(d, "n_chars").select("doc_id", "bucket")


@register("bucket_pad", f"""
WITH {BOUNDED_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {sql.md5_key('doc_id', 0)}, doc_id) - 1 AS r,
             count(*) OVER (PARTITION BY bucket) AS n FROM bb),
t AS (SELECT *, n + ((16 - n % 16) % 16) AS target FROM r),
x AS (SELECT bucket, doc_id, r, n, unnest(generate_series(0, CAST(floor((target - 1 - r) / n) AS BIGINT))) AS k FROM t)
SELECT bucket, doc_id, CAST(r + k * n AS BIGINT) AS padded_pos, CAST((r + k * n) % 2 AS BIGINT) AS replica,
       CAST(floor(floor((r + k * n) / 2) / 8) AS BIGINT) AS batch_in_bucket
FROM x""")
def q_bucket_pad(spark, sf):
    d = W.bounded_buckets(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars")
    p = W.bucket_pad(d, "bucket", "doc_id", replicas=2, batch_size=8, seed=0, epoch=0)
    return p.select("bucket", "doc_id", "padded_pos", "replica", "batch_in_bucket")


GROUPED_SQL = f"""
g0 AS (SELECT doc_id, CAST(floor(n_chars / 1000.0 / 2.0) AS BIGINT) AS bucket FROM documents),
g1 AS (SELECT *, row_number() OVER (ORDER BY bucket, {sql.md5_key('doc_id', 0)}, doc_id) AS rn FROM g0),
g2 AS (SELECT *, CAST(floor((rn - 1) / (greatest(least(8, floor((SELECT count(*) FROM documents) / 4)), 1) * 2)) AS BIGINT) AS grp FROM g1),
g3 AS (SELECT doc_id, grp, CAST(row_number() OVER (ORDER BY {sql.md5_key('grp', 0)}, grp, rn) - 1 AS BIGINT) AS order_pos FROM g2)"""


def _grouped(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.floor(F.col("n_chars") / 1000.0 / 2.0).cast("long").alias("bucket"))
    return W.grouped_batches(d, "bucket", "doc_id", batch_size=8, replicas=2, seed=0, epoch=0)


@register("grouped_batches", f"""
WITH {GROUPED_SQL}
SELECT doc_id, grp AS "group", order_pos FROM g3""")
def q_grouped_batches(spark, sf):
    return _grouped(spark, sf).select("doc_id", "group", "order_pos")


@register("even_shards", f"""
WITH {GROUPED_SQL},
n AS (SELECT count(*) AS n FROM documents),
x AS (SELECT doc_id, order_pos, unnest(generate_series(0, CAST(floor((ceil(n / 3) * 3 - 1 - order_pos) / n) AS BIGINT))) AS k
      FROM g3, n)
SELECT doc_id, CAST(order_pos + k * (SELECT n FROM n) AS BIGINT) AS pos,
       CAST((order_pos + k * (SELECT n FROM n)) % 3 AS BIGINT) AS rank,
       CAST(floor((order_pos + k * (SELECT n FROM n)) / 3) AS BIGINT) AS local_idx
FROM x""")
def q_even_shards(spark, sf):
    return W.even_shards(_grouped(spark, sf), "order_pos", 3, drop_last=False).select("doc_id", "pos", "rank", "local_idx")


@register("even_shards_drop_last", f"""
WITH {GROUPED_SQL},
n AS (SELECT count(*) AS n FROM documents),
t AS (SELECT CASE WHEN n % 3 <> 0 THEN ceil((n - 3) / 3) ELSE ceil(n / 3) END * 3 AS total FROM n)
SELECT doc_id, order_pos AS pos, CAST(order_pos % 3 AS BIGINT) AS rank, CAST(floor(order_pos / 3) AS BIGINT) AS local_idx
FROM g3, t WHERE order_pos < total""")
def q_even_shards_drop_last(spark, sf):
    return W.even_shards(_grouped(spark, sf), "order_pos", 3, drop_last=True).select("doc_id", "pos", "rank", "local_idx")


NUCLEUS_A_SQL = f"""
WITH x0 AS (SELECT user_id, event_id, value / 10.0 / 0.6 AS x FROM events),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x DESC, event_id) AS kp,
              count(*) OVER (PARTITION BY user_id) AS gs FROM x0),
kth AS (SELECT user_id, min(x) AS kth FROM rk WHERE kp <= least(20, gs) GROUP BY user_id),
x1 AS (SELECT x0.user_id, x0.event_id, CASE WHEN x0.x >= kth.kth THEN x0.x END AS x FROM x0 LEFT JOIN kth USING (user_id)),
sm AS (SELECT *, CASE WHEN x IS NULL THEN 0.0 ELSE exp(x - max(x) OVER (PARTITION BY user_id)) END AS e FROM x1),
sm2 AS (SELECT *, e / sum(e) OVER (PARTITION BY user_id) AS p FROM sm),
cum AS (SELECT *, sum(p) OVER (PARTITION BY user_id ORDER BY x DESC NULLS LAST, event_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
               row_number() OVER (PARTITION BY user_id ORDER BY x DESC NULLS LAST, event_id) - 1 AS pos FROM sm2),
kept AS (SELECT user_id, event_id, x FROM cum WHERE x IS NOT NULL AND (pos = 0 OR c - p <= 0.6)),
fin AS (SELECT *, exp(x - max(x) OVER (PARTITION BY user_id)) AS e FROM kept)
SELECT user_id, event_id, {sql.r6('e / sum(e) OVER (PARTITION BY user_id)')} AS prob FROM fin"""


@register("nucleus_filter", NUCLEUS_A_SQL)
def q_nucleus_filter(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", (F.col("value") / 10.0).alias("logit"))
    out = W.nucleus_filter(ev, ["user_id"], "event_id", "logit", top_k=20, top_p=0.6, temperature=0.6,
                           inclusive=False, block_rows=SCAN_BLOCK)
    return out.select("user_id", "event_id", r6("prob").alias("prob"))


@register("nucleus_filter_inclusive", f"""
WITH x0 AS (SELECT user_id, event_id, value / 10.0 AS x FROM events),
sm AS (SELECT *, exp(x - max(x) OVER (PARTITION BY user_id)) AS e FROM x0),
sm2 AS (SELECT *, e / sum(e) OVER (PARTITION BY user_id) AS p FROM sm),
cum AS (SELECT *, sum(p) OVER (PARTITION BY user_id ORDER BY x DESC, event_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
               row_number() OVER (PARTITION BY user_id ORDER BY x DESC, event_id) - 1 AS pos FROM sm2),
x1 AS (SELECT user_id, event_id, CASE WHEN pos = 0 OR c <= 0.6 THEN x / 0.6 END AS x FROM cum),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x DESC, event_id) AS kp,
              count(*) OVER (PARTITION BY user_id) AS gs FROM x1 WHERE x IS NOT NULL),
kth AS (SELECT user_id, min(x) AS kth FROM rk WHERE kp <= least(20, gs) GROUP BY user_id),
kept AS (SELECT x1.user_id, x1.event_id, x1.x FROM x1 JOIN kth USING (user_id) WHERE x1.x >= kth.kth),
fin AS (SELECT *, exp(x - max(x) OVER (PARTITION BY user_id)) AS e FROM kept)
SELECT user_id, event_id, {sql.r6('e / sum(e) OVER (PARTITION BY user_id)')} AS prob FROM fin""")
def q_nucleus_filter_inclusive(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", (F.col("value") / 10.0).alias("logit"))
    out = W.nucleus_filter(ev, ["user_id"], "event_id", "logit", top_k=20, top_p=0.6, temperature=0.6,
                           inclusive=True, block_rows=SCAN_BLOCK)
    return out.select("user_id", "event_id", r6("prob").alias("prob"))


@register("top_k_keep_ties", """
SELECT user_id, event_id FROM (
  SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY floor(value) DESC) AS rk FROM events)
WHERE rk <= 3""")
def q_top_k_keep_ties(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", F.floor("value").alias("score"))
    return W.top_k_keep_ties(ev, ["user_id"], "score", 3, "event_id").select("user_id", "event_id")


@register("latest_n_per_group", """
WITH n AS (SELECT o_custkey, o_orderkey, 'G_' || o_orderkey || '.pth' AS name, o_orderdate FROM orders)
SELECT o_orderkey, CASE WHEN name LIKE '%\\_0.pth' ESCAPE '\\' THEN true
                        ELSE row_number() OVER (PARTITION BY o_custkey, name LIKE '%\\_0.pth' ESCAPE '\\'
                                                ORDER BY o_orderdate DESC, name DESC) <= 2 END AS keep
FROM n""")
def q_latest_n_per_group(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.concat(F.lit("G_"), F.col("o_orderkey").cast("string"), F.lit(".pth")).alias("name"),
        "o_orderdate")
    return W.latest_n_per_group(o, "o_custkey", "o_orderdate", "name", 2).select("o_orderkey", "keep")


# rows that repeat: no column tells them apart, and each gets a number of its own ----------------

REPEATED_SQL = """
p AS (SELECT source, lang, n_chars % 40 AS n, md5(source || lang) AS tag FROM documents)"""


def _repeated(spark, sf):
    return table(spark, sf, "documents").select("source", "lang", (F.col("n_chars") % 40).alias("n"), F.md5(F.concat("source", "lang")).alias("tag"))


@register("shard_repeated_rows", f"""
WITH {REPEATED_SQL}
SELECT source, lang, n, tag, CAST((row_number() OVER (ORDER BY n, source, lang) - 1) % 7 AS BIGINT) AS shard FROM p""")
def q_shard_repeated_rows(spark, sf):
    return shard_of(_repeated(spark, sf), ["n", "source", "lang"], 7)


@register("split_repeated_rows", f"""
WITH {REPEATED_SQL},
r AS (SELECT *, row_number() OVER (ORDER BY {sql.md5_key('tag', 42)}, tag) AS rn FROM p)
SELECT tag, CASE WHEN rn <= ceil((SELECT count(*) FROM p) * 0.1) THEN 'val' ELSE 'train' END AS split FROM r""")
def q_split_repeated_rows(spark, sf):
    return train_val_split(_repeated(spark, sf), "tag", 0.1).select("tag", "split")


@register("length_buckets_repeated_rows", f"""
WITH {REPEATED_SQL},
r AS (SELECT *, CAST(floor(n / 0.5) AS BIGINT) AS f, row_number() OVER (ORDER BY n * 1.0, tag) AS rn FROM p)
SELECT n, tag, CAST(rn + least(0, min(f - rn) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS BIGINT) AS bucket FROM r""")
def q_length_buckets_repeated_rows(spark, sf):
    d = _repeated(spark, sf).withColumn("sec", F.col("n") * F.lit(1.0))
    return W.length_buckets(d, "sec", "tag", 0.5, "exact", block_rows=SCAN_BLOCK).select("n", "tag", "bucket")


@register("batches_repeated_rows", f"""
WITH {REPEATED_SQL},
r AS (SELECT n, tag, row_number() OVER (ORDER BY n, {sql.md5_key('tag', 0)}, tag) AS rn FROM p),
g AS (SELECT n, tag, rn, CAST(floor((rn - 1) / 16) AS BIGINT) AS grp FROM r)
SELECT n, tag, grp AS "group", CAST(row_number() OVER (ORDER BY {sql.md5_key('grp', 0)}, grp, rn) - 1 AS BIGINT) AS order_pos FROM g""")
def q_batches_repeated_rows(spark, sf):
    return W.grouped_batches(_repeated(spark, sf), "n", "tag", batch_size=8, replicas=2).select("n", "tag", "group", "order_pos")
