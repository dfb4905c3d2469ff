"""Registered aggregations, orders and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggs as A
from ..operators import sets as U
from ..operators import sorts as O
from ..sources import corpus
from ..streaming.jobs import scratch_dir
from ..util.rank import global_row_number
from . import derive, sql
from .base import r6, register, table
from .filters import QUALITY_SQL, _gated


@register("dataset_profile", QUALITY_SQL + f"""
SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM labels) AS n_labels,
       count(*) AS n_kept, {sql.r6('sum(n_sem / 25.0)')} AS total_sec,
       {sql.r6('min(n_sem / 25.0)')} AS min_sec, {sql.r6('max(n_sem / 25.0)')} AS max_sec
FROM g WHERE reject_reason IS NULL""")
def q_dataset_profile(spark, sf):
    kept = _gated(spark, sf).where(F.col("reject_reason").isNull())
    prof = A.dataset_profile({"documents": table(spark, sf, "documents"), "labels": table(spark, sf, "labels")},
                             kept, "n_sem", 25)
    return prof.select("n_documents", "n_labels", "n_kept", r6("total_sec").alias("total_sec"),
                       r6("min_sec").alias("min_sec"), r6("max_sec").alias("max_sec"))


@register("batch_pad_width", """
SELECT source, CAST(max(n_chars) AS BIGINT) AS max_len, CAST(2 * (floor(max(n_chars) / 2) + 1) AS BIGINT) AS even_width,
       count(*) AS n
FROM documents GROUP BY source""")
def q_batch_pad_width(spark, sf):
    return A.batch_pad_width(table(spark, sf, "documents"), "source", "n_chars")


@register("distinct_keys", f"""
WITH k AS (SELECT source, unnest(regexp_extract_all(lower(text), '{sql.WORD_RE.replace("'", "''")}', 0)) AS key FROM documents)
SELECT source, count(key) AS n_keys, count(DISTINCT key) AS n_distinct,
       (SELECT count(DISTINCT key) FROM k) AS total_distinct
FROM k GROUP BY source""")
def q_distinct_keys(spark, sf):
    d = table(spark, sf, "documents").select(
        "source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(derive.WORD_RE), 0)).alias("key"))
    return A.distinct_keys(d, "key", "source")


@register("merge_labels", f"""
SELECT conv_id, role, min(turn) AS turn, string_agg(text, '' ORDER BY turn) AS text, count(*) AS n_merged,
       {sql.r6('sum(CAST(length(text) AS DOUBLE)) + (count(*) - 1) * 0.3')} AS length
FROM conversations GROUP BY conv_id, role""")
def q_merge_labels(spark, sf):
    c = table(spark, sf, "conversations").withColumn("length", F.length("text").cast("double"))
    m = A.merge_labels(c, ["conv_id", "role"], "turn", "text", "length", 0.3)
    return m.select("conv_id", "role", "turn", "text", "n_merged", r6("length").alias("length"))


def _log(spark, sf):
    return corpus.parse_run_log(derive.run_log_json(table(spark, sf, "events")), "value")


@register("perplexity", f"""
SELECT event_id, event_id AS step, {sql.r6('exp(value / 10.0)')} AS perplexity FROM events""")
def q_perplexity(spark, sf):
    p = A.perplexity(_log(spark, sf), "loss")
    return p.select("event_id", "step", r6("perplexity").alias("perplexity"))


@register("eval_summary", f"""
WITH j AS (SELECT user_id, event_id AS step, value / 10.0 AS loss, value / 7.0 AS eval_loss,
                  (user_id / 10.0) * 3.5 AS eval_samples FROM events)
SELECT user_id, count(*) AS n_pairs,
       arg_min(step, (eval_loss, step)) AS log_min_step, {sql.r6('min(eval_loss)')} AS log_min_eval_loss,
       arg_min(step, (eval_loss, step)) FILTER (WHERE step % 5 = 0) AS best_step,
       {sql.r6('min(eval_loss) FILTER (WHERE step % 5 = 0)')} AS best_eval_loss,
       {sql.r6('sum(eval_samples)')} AS eval_samples, {sql.r6('sum(loss)')} AS train_loss_sum
FROM j GROUP BY user_id""")
def q_eval_summary(spark, sf):
    s = A.eval_summary(_log(spark, sf), ["user_id"], "step", save_steps=5)
    return s.select("user_id", "n_pairs", "log_min_step", r6("log_min_eval_loss").alias("log_min_eval_loss"),
                    "best_step", r6("best_eval_loss").alias("best_eval_loss"),
                    r6("eval_samples").alias("eval_samples"),
                    # the sum of 3-decimal losses, not the mean: a mean of such values often lies
                    # exactly on a 6-decimal rounding boundary, where summation order decides
                    r6("train_loss_sum").alias("train_loss_sum"))


# orders ------------------------------------------------------------------------

@register("sort_by_length", """
WITH p AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS pos FROM documents)
SELECT doc_id, pos, CAST(row_number() OVER (PARTITION BY floor((pos - 1) / 64) ORDER BY n_chars DESC, doc_id) - 1 AS BIGINT) AS pos_in_batch
FROM p""")
def q_sort_by_length(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    ranked = global_row_number(d, ["n_chars", "doc_id"], "pos").withColumn("batch", F.floor((F.col("pos") - 1) / 64))
    return O.rank_in_batch(ranked, "batch", "n_chars", "doc_id", "pos_in_batch").select("doc_id", "pos", "pos_in_batch")


@register("page", """
SELECT doc_id, CAST(rn - 1 AS BIGINT) AS row_index
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE rn > 100 AND rn <= 150""")
def q_page(spark, sf):
    return O.page(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 100, 50)


@register("page_deep", """
SELECT doc_id, source, n_chars, CAST(rn - 1 AS BIGINT) AS row_index
FROM (SELECT *, row_number() OVER (ORDER BY n_chars, doc_id) AS rn, count(*) OVER () AS n FROM documents)
WHERE rn > (n * 99) // 100 - 25 AND rn <= (n * 99) // 100 + 25""")
def q_page_deep(spark, sf):
    """The 50 rows around 99 % of the documents in order of length, from a paged copy."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    paged = O.PagedTable.write(docs, ["n_chars", "doc_id"], scratch_dir(spark, "paged"))
    return paged.page(paged.count() * 99 // 100 - 25, 50)


@register("natural_sort", """
WITH p AS (SELECT p_partkey, p_name || ' ' || p_size AS name FROM part),
k AS (SELECT p_partkey, name, regexp_split_to_array(name, '\\d+') AS texts, regexp_extract_all(name, '\\d+') AS nums FROM p)
SELECT p_partkey, row_number() OVER (ORDER BY
         list_transform(generate_series(1, len(texts)),
                        lambda i: {'t': texts[i], 'n': coalesce(TRY_CAST(nums[i] AS DECIMAL(38,0)), -1)}),
         name, p_partkey) AS rank
FROM k""")
def q_natural_sort(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"))
    return O.natural_sort(p, "name", "p_partkey", "rank").select("p_partkey", "rank")


@register("newest_by_number", """
WITH n AS (SELECT o_custkey, 'epoch=' || (year(o_orderdate) - 1990) || '-step=' || o_orderkey || '.ckpt' AS ckpt,
                  'G_' || o_orderkey || '.pth' AS gname FROM orders)
SELECT o_custkey, arg_min(ckpt, (-(year_ep), -(step_no), ckpt)) AS newest, arg_max(gname, (digits, gname)) AS newest_g
FROM (SELECT *, CAST(regexp_extract(ckpt, '^epoch=(\\d+)-step=(\\d+)\\.ckpt', 1) AS DECIMAL(38,0)) AS year_ep,
             CAST(regexp_extract(ckpt, '^epoch=(\\d+)-step=(\\d+)\\.ckpt', 2) AS DECIMAL(38,0)) AS step_no,
             CAST(regexp_replace(gname, '\\D', '', 'g') AS DECIMAL(38,0)) AS digits FROM n)
GROUP BY o_custkey""")
def q_newest_by_number(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_custkey",
        F.concat(F.lit("epoch="), (F.year("o_orderdate") - 1990).cast("string"), F.lit("-step="),
                 F.col("o_orderkey").cast("string"), F.lit(".ckpt")).alias("ckpt"),
        F.concat(F.lit("G_"), F.col("o_orderkey").cast("string"), F.lit(".pth")).alias("gname"))
    a = O.newest_by_epoch_step(o, "ckpt", ["o_custkey"])
    b = O.newest_by_digits(o, "gname", ["o_custkey"]).withColumnRenamed("newest", "newest_g")
    return a.join(b, "o_custkey")


@register("head_sample", """
SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100""")
def q_head_sample(spark, sf):
    return O.head_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 100)


@register("weighted_pick", f"""
SELECT user_id, arg_max(event_type, value / (-ln(greatest({sql.md5_unit('event_id')}, 1e-300)))) AS picked
FROM events GROUP BY user_id""")
def q_weighted_pick(spark, sf):
    return O.weighted_pick(table(spark, sf, "events"), ["user_id"], "event_type", "value", ["event_id"])


# set operations ----------------------------------------------------------------

@register("merge_shards", """
SELECT doc_id, lang, n_chars FROM documents""")
def q_merge_shards(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    shards = [d.where(F.col("lang") == x) for x in ("en", "fr", "de", "es")]
    rest = d.where(~F.col("lang").isin("en", "fr", "de", "es") | F.col("lang").isNull())
    return U.merge_shards([*shards, rest])


@register("key_diff", """
SELECT key, 'unused' AS side FROM (SELECT doc_id AS key FROM documents EXCEPT SELECT vec_id * 3 FROM embeddings)
UNION ALL
SELECT key, 'missing' FROM (SELECT vec_id * 3 AS key FROM embeddings EXCEPT SELECT doc_id FROM documents)""")
def q_key_diff(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("key"))
    v = table(spark, sf, "embeddings").select((F.col("vec_id") * 3).alias("key"))
    return U.key_diff(d, v, "key")


@register("upsample_small", """
SELECT n_nationkey, CAST(unnest(generate_series(1, CASE WHEN n >= 100 THEN 1 ELSE greatest(2, CAST(floor(100 / n) AS INTEGER)) END)) AS INTEGER) AS copy_no
FROM nation, (SELECT count(*) AS n FROM nation)""")
def q_upsample_small(spark, sf):
    return U.upsample_small(table(spark, sf, "nation").select("n_nationkey"), 100)


@register("upsample_small_supplier", """
SELECT s_suppkey, CAST(unnest(generate_series(1, CASE WHEN n >= 100 THEN 1 ELSE greatest(2, CAST(floor(100 / n) AS INTEGER)) END)) AS INTEGER) AS copy_no
FROM supplier, (SELECT count(*) AS n FROM supplier)""")
def q_upsample_small_supplier(spark, sf):
    return U.upsample_small(table(spark, sf, "supplier").select("s_suppkey"), 100)


EDITS_SQL = """
lab AS (SELECT conv_id || ':' || turn AS key, 'wavs/c' || conv_id || '_' || turn || '.wav' AS path, text,
               CAST(length(text) * 320 AS BIGINT) AS n_samples, role, turn FROM conversations),
ed AS (SELECT key, CASE WHEN role = 'system' THEN 'delete' WHEN turn = 0 THEN 'update' WHEN turn = 1 THEN 'split' END AS op,
              '  ' || text || ' !  ' AS new_text, length(text) / 200.0 AS break_sec FROM lab)"""


@register("apply_label_edits", f"""
WITH {EDITS_SQL},
j AS (SELECT l.key, l.path, l.n_samples,
             CASE WHEN e.op = 'update' THEN regexp_replace(e.new_text, '^\\s+|\\s+$', '', 'g') || ' ' ELSE l.text END AS text,
             CASE WHEN e.op = 'split' THEN CAST(floor(e.break_sec * 32000) AS BIGINT) END AS frame
      FROM lab l LEFT JOIN ed e ON l.key = e.key WHERE e.op IS NULL OR e.op <> 'delete'),
k AS (SELECT *, frame IS NOT NULL AND frame >= 1 AND frame < n_samples AS ok FROM j)
SELECT key, path, text, CASE WHEN ok THEN frame ELSE n_samples END AS n_samples, 0 AS part FROM k
UNION ALL
SELECT key, regexp_replace(path, '\\.[^./]*$', '') || '_00.wav', text, n_samples - frame, 1 FROM k WHERE ok""")
def q_apply_label_edits(spark, sf):
    c = table(spark, sf, "conversations")
    lab = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"),
                   F.concat(F.lit("wavs/c"), F.col("conv_id").cast("string"), F.lit("_"),
                            F.col("turn").cast("string"), F.lit(".wav")).alias("path"),
                   "text", (F.length("text") * 320).cast("long").alias("n_samples"), "role", "turn")
    ed = lab.select("key",
                    F.when(F.col("role") == "system", "delete").when(F.col("turn") == 0, "update")
                     .when(F.col("turn") == 1, "split").alias("op"),
                    F.concat(F.lit("  "), F.col("text"), F.lit(" !  ")).alias("new_text"),
                    (F.length("text") / 200.0).alias("break_sec")).where(F.col("op").isNotNull())
    out = U.apply_label_edits(lab.select("key", "path", "text", "n_samples"), ed, "key")
    return out.select("key", "path", "text", "n_samples", "part")
