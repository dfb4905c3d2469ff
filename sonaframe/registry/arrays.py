"""Registered array functions and vector quantisation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as R
from ..operators import vq as V
from ..util.rank import global_row_number
from . import sql
from .base import r6, register, table


def _ints(arr):
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), " ")


LINE_LENS = "list_transform(string_split(text, chr(10)), lambda l: CAST(length(l) AS BIGINT))"


BATCH_SQL = """
bt AS (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY n_chars, doc_id) - 1) / 64) AS BIGINT) AS batch FROM documents)"""


def _batches(spark, sf, lens):
    """Batches of 64 documents of similar length, so a window over a batch is a small task."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    ranked = global_row_number(d, ["n_chars", "doc_id"], "_rn")
    return lens.join(ranked.select("doc_id", F.floor((F.col("_rn") - 1) / 64).alias("batch")), "doc_id")


def _line_lens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", "source",
                    F.transform(F.split("text", "\n", -1), lambda x: F.length(x).cast("long")).alias("lens"))


@register("pad_batch", f"""
WITH {BATCH_SQL},
l AS (SELECT doc_id, batch, {LINE_LENS} AS lens FROM documents JOIN bt USING (doc_id)),
w AS (SELECT *, max(len(lens)) OVER (PARTITION BY batch) AS width FROM l)
SELECT doc_id, CAST(width AS BIGINT) AS width, CAST(2 * (floor(width / 2) + 1) AS BIGINT) AS even_width,
       array_to_string(list_concat(lens, list_transform(range(greatest(width - len(lens), 0)), lambda i: 0)), ' ') AS padded
FROM w""")
def q_pad_batch(spark, sf):
    lens = _line_lens(spark, sf)
    w = _batches(spark, sf, lens).withColumn("width", F.max(F.size("lens")).over(Window.partitionBy("batch")))
    return w.select("doc_id", F.col("width").cast("long").alias("width"),
                    R.even_width(F.col("width")).cast("long").alias("even_width"),
                    _ints(R.pad_right("lens", F.col("width"), 0)).alias("padded"))


@register("length_mask", """
WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_transform(range(7), lambda i: CASE WHEN i < n THEN '1' ELSE '0' END), '') AS mask,
       array_to_string(list_transform(range(7), lambda i: CASE WHEN i >= n THEN '1' ELSE '0' END), '') AS pad_mask
FROM c""")
def q_length_mask(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    bits = lambda arr: F.array_join(F.transform(arr, lambda b: F.when(b, "1").otherwise("0")), "")
    return c.select("l_orderkey", bits(R.length_mask("n", 7)).alias("mask"),
                    bits(R.length_mask("n", 7, pad_mask=True)).alias("pad_mask"))


@register("eos_shift", f"""
WITH {BATCH_SQL},
l AS (SELECT doc_id, batch, {LINE_LENS} AS lens FROM documents JOIN bt USING (doc_id)),
w AS (SELECT *, max(len(lens)) OVER (PARTITION BY batch) AS width FROM l),
f AS (SELECT doc_id, width, list_transform(range(width + 1), lambda i: CASE WHEN i < len(lens) THEN lens[i + 1] ELSE 1024 END) AS fl FROM w)
SELECT doc_id, array_to_string(list_slice(fl, 1, width), ' ') AS y_in, array_to_string(list_slice(fl, 2, width + 1), ' ') AS target
FROM f""")
def q_eos_shift(spark, sf):
    lens = _line_lens(spark, sf)
    w = _batches(spark, sf, lens).withColumn("width", F.max(F.size("lens")).over(Window.partitionBy("batch")))
    s = R.eos_shift("lens", F.size("lens"), F.col("width"), 1024)
    return w.select("doc_id", _ints(s["y_in"]).alias("y_in"), _ints(s["target"]).alias("target"))


@register("repeat_expand", """
WITH e AS (SELECT vec_id, len(embedding) AS n, list_transform(range(1, len(embedding) + 1), lambda i: vec_id + i) AS vals,
                  list_transform(embedding, lambda x: CAST(floor(abs(x) * 10) AS INTEGER)) AS cnt FROM embeddings)
SELECT vec_id, array_to_string(flatten(list_transform(range(1, n + 1), lambda i: list_transform(range(cnt[i]), lambda k: vals[i]))), ' ') AS expanded,
       CASE WHEN list_sum(cnt) <> n THEN 'count_mismatch' END AS reject_reason
FROM e""")
def q_repeat_expand(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.size("embedding").alias("n"), F.transform("embedding", lambda x, i: F.col("vec_id") + i + 1).alias("vals"),
        F.transform("embedding", lambda x: F.floor(F.abs(x) * 10).cast("int")).alias("cnt"))
    return e.select("vec_id", _ints(R.repeat_expand("vals", "cnt")).alias("expanded"),
                    R.repeat_expand_check("vals", "cnt", F.col("n")).alias("reject_reason"))


@register("intersperse", f"""
SELECT doc_id, array_to_string(list_concat(flatten(list_transform({LINE_LENS}, lambda x: [0, x])), [0]), ' ') AS ids FROM documents""")
def q_intersperse(spark, sf):
    return _line_lens(spark, sf).select("doc_id", _ints(R.intersperse("lens", 0)).alias("ids"))


@register("slice_segments", f"""
WITH s AS (SELECT vec_id, embedding, CAST(floor({sql.md5_unit('vec_id')} * (len(embedding) - 8 + 1)) AS INTEGER) AS start FROM embeddings)
SELECT vec_id, start, CAST(embedding[start + 1] AS DOUBLE) AS first_value, CAST(len(embedding[start + 1:start + 8]) AS BIGINT) AS n
FROM s""")
def q_slice_segments(spark, sf):
    e = table(spark, sf, "embeddings")
    st = R.random_start(F.size("embedding"), 8, "vec_id")
    seg = e.select("vec_id", st.alias("start"), "embedding").withColumn("seg", R.slice_segment("embedding", F.col("start"), 8))
    return seg.select("vec_id", "start", F.get("seg", 0).cast("double").alias("first_value"),
                      F.size("seg").cast("long").alias("n"))


@register("ref_target_split", f"""
WITH s AS (SELECT vec_id, len(embedding) AS n, CAST(floor(len(embedding) / 3) AS INTEGER) AS third,
                  {sql.md5_unit('vec_id', 42)} AS u, {sql.md5_unit('vec_id', 43)} < 0.5 AS lft FROM embeddings),
c AS (SELECT *, CAST(third + floor(u * (third + 1)) AS INTEGER) AS cut FROM s)
SELECT vec_id, CAST(CASE WHEN lft THEN cut ELSE n - cut END AS BIGINT) AS n_reference,
       CAST(CASE WHEN lft THEN n - cut ELSE cut END AS BIGINT) AS n_target
FROM c""")
def q_ref_target_split(spark, sf):
    e = table(spark, sf, "embeddings")
    s = R.ref_target_split("embedding", "vec_id")
    return e.select("vec_id", F.size(s["reference"]).cast("long").alias("n_reference"),
                    F.size(s["target"]).cast("long").alias("n_target"))


@register("negative_pairs", f"""
WITH w AS (SELECT conv_id, turn, list_transform(regexp_extract_all(lower(text), '[\\p{{L}}'']+', 0), lambda x: CAST(length(x) AS BIGINT)) AS y FROM conversations),
p AS (SELECT *, len(y) AS n, CAST(floor({sql.md5_unit("conv_id || ':' || turn")} * len(y)) AS INTEGER) AS a,
             CAST(floor({sql.md5_unit("conv_id || ':' || turn", 43)} * len(y)) AS INTEGER) AS b FROM w),
q AS (SELECT *, least(a, b) AS i, greatest(a, b) AS j FROM p)
SELECT conv_id, turn,
       array_to_string(CASE WHEN n > 0 THEN list_concat(list_concat(list_concat(y[1:i], y[i + 1:j]), y[i + 1:j]), y[j + 1:n]) ELSE y END, ' ') AS rejected,
       array_to_string(CASE WHEN n > 0 THEN list_concat(y[1:i], y[j + 1:n]) ELSE y END, ' ') AS lost
FROM q""")
def q_negative_pairs(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}']+"), 0),
                                       lambda x: F.length(x).cast("long")).alias("y"))
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return c.select("conv_id", "turn", _ints(R.negative_pair("y", key)).alias("rejected"),
                    _ints(R.negative_pair("y", key, mode="lose")).alias("lost"))


@register("log_compress", f"""
SELECT event_id, {sql.r6('ln(greatest(value, 1e-5) * 1.0)')} AS compressed,
       {sql.r6('exp(ln(greatest(value, 1e-5) * 1.0)) / 1.0')} AS restored FROM events""")
def q_log_compress(spark, sf):
    e = table(spark, sf, "events")
    c = R.log_compress("value")
    return e.select("event_id", r6(c).alias("compressed"), r6(R.log_decompress(c)).alias("restored"))


PREF_SQL = """
p AS (SELECT l_orderkey, l_linenumber, -l_extendedprice / 100000.0 AS pc, -l_quantity / 10.0 AS pr,
             -l_discount AS rc, -l_tax AS rr FROM lineitem),
t AS (SELECT *, -0.1 * ((pc - pr) - (rc - rr)) AS z FROM p),
v AS (SELECT l_orderkey, l_linenumber, greatest(z, 0.0) + ln(1 + exp(-abs(z))) AS loss,
             0.1 * (pc - rc) AS chosen_reward, 0.1 * (pr - rr) AS rejected_reward FROM t)"""


def _pref(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (-F.col("l_extendedprice") / 100000.0).alias("pc"),
        (-F.col("l_quantity") / 10.0).alias("pr"), (-F.col("l_discount")).alias("rc"), (-F.col("l_tax")).alias("rr"))
    return li.select("l_orderkey", "l_linenumber", R.preference_terms("pc", "pr", "rc", "rr", 0.1).alias("t")) \
             .select("l_orderkey", "l_linenumber", "t.*")


@register("preference_margin", f"""
WITH {PREF_SQL}
SELECT l_orderkey, l_linenumber, {sql.r6('loss')} AS loss, {sql.r6('chosen_reward')} AS chosen_reward,
       {sql.r6('rejected_reward')} AS rejected_reward FROM v""")
def q_preference_margin(spark, sf):
    p = _pref(spark, sf)
    return p.select("l_orderkey", "l_linenumber", r6("loss").alias("loss"), r6("chosen_reward").alias("chosen_reward"),
                    r6("rejected_reward").alias("rejected_reward"))


@register("preference_margin_mean", f"""
WITH {PREF_SQL}
SELECT {sql.r6('avg(loss)')} AS mean_loss, count(*) AS n FROM v""")
def q_preference_margin_mean(spark, sf):
    return _pref(spark, sf).agg(r6(F.avg("loss")).alias("mean_loss"), F.count(F.lit(1)).alias("n"))


@register("sequence_logp", f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS s FROM embeddings),
l AS (SELECT label, s[label + 1] - (list_max(s) + ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s)))))) AS lp FROM e)
SELECT label, {sql.r6('sum(lp)')} AS logp, count(*) AS n FROM l GROUP BY label""")
def q_sequence_logp(spark, sf):
    e = table(spark, sf, "embeddings").select("label", V.as_double_vec("embedding").alias("s"))
    return e.groupBy("label").agg(r6(F.sum(R.log_softmax_at("s", "label"))).alias("logp"), F.count(F.lit(1)).alias("n"))


# vector quantisation ---------------------------------------------------------------

def cb_sql(k: int, seed: int, name: str, scale: str = "") -> str:
    return f"""
{name} AS (SELECT CAST(row_number() OVER (ORDER BY {sql.md5_key('vec_id', seed)}, vec_id) - 1 AS INTEGER) AS code,
                  list_transform(CAST(embedding AS DOUBLE[]), lambda x: x{scale}) AS vec
           FROM embeddings ORDER BY {sql.md5_key('vec_id', seed)}, vec_id LIMIT {k})"""


def dist_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


ASSIGN_SQL = f"""
{cb_sql(16, 0, 'cb')},
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT e.vec_id, cb.code, {dist_sql('e.v', 'cb.vec')} AS dist FROM e, cb),
a AS (SELECT vec_id, arg_min(code, (dist, code)) AS code, min(dist) AS dist FROM d GROUP BY vec_id),
av AS (SELECT a.vec_id, a.code, a.dist, e.v FROM a JOIN e USING (vec_id))"""


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", V.as_double_vec("embedding").alias("vec"))


def _cb(spark, sf, k=16, seed=0):
    return V.sample_codebook(table(spark, sf, "embeddings"), "vec_id", "embedding", k, seed)


@register("nearest_code", f"""
WITH {ASSIGN_SQL}
SELECT vec_id, code FROM a""")
def q_nearest_code(spark, sf):
    return V.nearest_code(_emb(spark, sf), _cb(spark, sf)).select("vec_id", "code")


@register("commit_loss", f"""
WITH {ASSIGN_SQL}
SELECT {sql.r6('avg(dist / 64)')} AS commit_loss FROM av""")
def q_commit_loss(spark, sf):
    return V.commit_loss(_emb(spark, sf), _cb(spark, sf)).select(r6("commit_loss").alias("commit_loss"))


def _long(df, *keys):
    """One row for each dimension of ``vec``, from 1."""
    return df.select(*keys, F.posexplode("vec").alias("d", "value")).select(
        *keys, (F.col("d") + 1).cast("long").alias("d"), r6("value").alias("value"))


@register("kmeans_step", f"""
WITH {ASSIGN_SQL},
m AS (SELECT code, d, count(*) AS n, avg(v[d]) AS m FROM av, range(1, 65) r(d) GROUP BY code, d)
SELECT cb.code, CAST(coalesce(m.n, 0) AS BIGINT) AS n, d.d, {sql.r6('coalesce(m.m, cb.vec[d.d])')} AS value
FROM cb CROSS JOIN range(1, 65) d(d) LEFT JOIN m ON cb.code = m.code AND m.d = d.d""")
def q_kmeans_step(spark, sf):
    return _long(V.kmeans_step(_emb(spark, sf), _cb(spark, sf), 64), "code", "n")


def kmeans_sql(src: str, k: int, iters: int, seed: int, name: str) -> str:
    """Lloyd rounds over ``src`` (vec_id, v), unrolled; the last round is ``{name}`` (code, vec, n)."""
    out = [f"""
{name}_0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY {sql.md5_key('vec_id', seed)}, vec_id) - 1 AS INTEGER) AS code, v AS vec, 0 AS n
           FROM {src} ORDER BY {sql.md5_key('vec_id', seed)}, vec_id LIMIT {k})"""]
    for i in range(iters):
        c, last = f"{name}_{i}", i == iters - 1
        out.append(f"""
{name}_a{i} AS MATERIALIZED (SELECT e.vec_id, arg_min(c.code, ({dist_sql('e.v', 'c.vec')}, c.code)) AS code FROM {src} e, {c} c GROUP BY e.vec_id),
{name}_m{i} AS MATERIALIZED (SELECT code, d, avg(v[d]) AS m, count(*) AS n FROM {name}_a{i} JOIN {src} USING (vec_id), range(1, 65) r(d) GROUP BY code, d),
{name if last else f'{name}_{i + 1}'} AS MATERIALIZED (SELECT c.code, list(coalesce(m.m, c.vec[r.d]) ORDER BY r.d) AS vec, CAST(coalesce(max(m.n), 0) AS BIGINT) AS n
           FROM {c} c CROSS JOIN range(1, 65) r(d) LEFT JOIN {name}_m{i} m ON m.code = c.code AND m.d = r.d GROUP BY c.code)""")
    return ",".join(out)


@register("kmeans_fit", f"""
WITH e AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),{kmeans_sql('e', 16, 10, 0, 'fit')}
SELECT code, n, d, {sql.r6('vec[d]')} AS value FROM fit, range(1, 65) r(d)""")
def q_kmeans_fit(spark, sf):
    return _long(V.kmeans_fit(table(spark, sf, "embeddings"), "vec_id", "embedding", k=16, iters=10, seed=0), "code", "n")


@register("codebook_update", f"""
WITH {ASSIGN_SQL},
n AS (SELECT code, count(*) AS n FROM av GROUP BY code),
s AS (SELECT code, d, sum(v[d]) AS s FROM av, range(1, 65) r(d) GROUP BY code, d),
u AS (SELECT cb.code, 0.99 * 0.0 + 0.01 * coalesce(n.n, 0) AS cs, cb.vec FROM cb LEFT JOIN n ON cb.code = n.code),
t AS (SELECT sum(cs) AS total, count(*) AS k FROM u)
SELECT u.code, r.d, {sql.r6('cs')} AS cluster_size,
       {sql.r6('(0.99 * u.vec[r.d] + 0.01 * coalesce(s.s, 0.0)) / ((cs + 1e-5) / (total + k * 1e-5) * total)')} AS value
FROM u CROSS JOIN t CROSS JOIN range(1, 65) r(d) LEFT JOIN s ON s.code = u.code AND s.d = r.d""")
def q_codebook_update(spark, sf):
    cb = _cb(spark, sf).withColumn("cluster_size", F.lit(0.0)).withColumn("embed_avg", F.col("vec"))
    up = V.codebook_update(_emb(spark, sf), cb, 64)
    return _long(up.withColumn("cluster_size", r6("cluster_size")), "code", "cluster_size")


@register("expire_codes", f"""
WITH {ASSIGN_SQL},
{cb_sql(16, 1, 'cb2')},
n AS (SELECT code, count(*) AS n FROM av GROUP BY code)
SELECT cb.code, coalesce(n.n, 0) < 2 AS expired, r.d,
       {sql.r6('CASE WHEN coalesce(n.n, 0) < 2 THEN cb2.vec[r.d] ELSE cb.vec[r.d] END')} AS value
FROM cb CROSS JOIN range(1, 65) r(d) LEFT JOIN n ON cb.code = n.code LEFT JOIN cb2 ON cb.code = cb2.code""")
def q_expire_codes(spark, sf):
    emb = _emb(spark, sf)
    cb = _cb(spark, sf)
    counts = V.nearest_code(emb, cb).groupBy("code").agg(F.count(F.lit(1)).cast("double").alias("cluster_size"))
    cbs = cb.join(counts, "code", "left").withColumn("cluster_size", F.coalesce("cluster_size", F.lit(0.0)))
    ex = V.expire_codes(table(spark, sf, "embeddings"), cbs, "vec_id", "embedding", 2, seed=1)
    return _long(ex, "code", "expired")


@register("rvq_encode", f"""
WITH {cb_sql(8, 0, 'c1')},
{cb_sql(8, 2, 'c2', ' * 0.5')},
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d1 AS (SELECT e.vec_id, c1.code, {dist_sql('e.v', 'c1.vec')} AS dist FROM e, c1),
a1 AS (SELECT vec_id, arg_min(code, (dist, code)) AS k1 FROM d1 GROUP BY vec_id),
r1 AS (SELECT e.vec_id, a1.k1, e.v, c1.vec AS q1,
              list_transform(range(1, len(e.v) + 1), lambda i: e.v[i] - c1.vec[i]) AS r
       FROM e JOIN a1 USING (vec_id) JOIN c1 ON c1.code = a1.k1),
d2 AS (SELECT r1.vec_id, c2.code, {dist_sql('r1.r', 'c2.vec')} AS dist FROM r1, c2),
a2 AS (SELECT vec_id, arg_min(code, (dist, code)) AS k2, min(dist) AS dist2 FROM d2 GROUP BY vec_id)
SELECT r1.vec_id, r1.k1 AS code1, a2.k2 AS code2, {sql.r6('a2.dist2 / 64')} AS loss2,
       d.d, {sql.r6('r1.q1[d.d] + c2.vec[d.d]')} AS value
FROM range(1, 65) d(d), r1 JOIN a2 USING (vec_id) JOIN c2 ON c2.code = a2.k2""")
def q_rvq_encode(spark, sf):
    emb = _emb(spark, sf)
    c1 = _cb(spark, sf, 8, 0)
    c2 = _cb(spark, sf, 8, 2).withColumn("vec", F.transform("vec", lambda x: x * 0.5))
    enc = V.rvq_encode(emb, [c1, c2])
    dec = V.rvq_decode(enc, [c1, c2])
    return _long(dec.select("vec_id", F.get("codes", 0).alias("code1"), F.get("codes", 1).alias("code2"),
                            r6(F.get("layer_losses", 1)).alias("loss2"), F.col("decoded").alias("vec")), "vec_id", "code1", "code2", "loss2")
