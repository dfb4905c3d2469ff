"""Registered joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from . import derive, sql
from .base import register, table


def _doc_name(prefix="doc", suffix=""):
    return F.concat(F.lit(prefix), F.col("doc_id").cast("string"), F.lit(suffix))


@register("pair_join", """
SELECT d.doc_id, l.doc_id IS NOT NULL AS matched, CAST(l.quality AS DOUBLE) AS quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_pair_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("name"), "quality")
    return J.pair_join(d, lab, "doc_id", "name").select("doc_id", "matched", F.col("quality").cast("double"))


@register("key_intersection", """
WITH p AS (SELECT DISTINCT 'doc' || doc_id AS key FROM documents),
f AS (SELECT substr('doc' || doc_id || '.pt', 1, length('doc' || doc_id || '.pt') - 3) AS key FROM labels),
a AS (SELECT 'doc' || conv_id AS key FROM conversations)
SELECT key FROM p WHERE key IN (SELECT key FROM f) AND key IN (SELECT key FROM a)""")
def q_key_intersection(spark, sf):
    p = table(spark, sf, "documents").select(_doc_name().alias("name"))
    f = table(spark, sf, "labels").select(_doc_name(suffix=".pt").alias("name"))
    a = table(spark, sf, "conversations").select(
        F.concat(F.lit("doc"), F.col("conv_id").cast("string")).alias("name"))
    return J.key_intersection(p, f, a, "name", 3)


@register("skip_done", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def q_skip_done(spark, sf):
    return J.skip_done(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@register("require_upstream", """
SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def q_require_upstream(spark, sf):
    return J.require_upstream(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@register("optional_feature", """
WITH d AS (SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n FROM documents),
f AS (SELECT l.doc_id, CASE WHEN l.toxic = 1 THEN d.n + 1 ELSE d.n END AS flen, CAST(l.quality AS DOUBLE) AS fval
      FROM labels l JOIN d ON l.doc_id = d.doc_id)
SELECT d.doc_id, d.n,
       CAST(coalesce(f.flen, d.n) AS BIGINT) AS feature_len,
       coalesce(f.fval * f.flen, 0.0) AS feature_sum,
       f.doc_id IS NULL AS feature_missing,
       CASE WHEN f.doc_id IS NOT NULL AND f.flen <> d.n THEN 'feature_length' END AS reject_reason
FROM d LEFT JOIN f ON d.doc_id = f.doc_id""")
def q_optional_feature(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n"))
    lab = table(spark, sf, "labels")
    feats = lab.join(d, "doc_id").select(
        "doc_id", F.array_repeat(F.col("quality").cast("double"),
                                 F.when(F.col("toxic") == 1, F.col("n") + 1).otherwise(F.col("n")).cast("int"))
        .alias("feature"))
    out = J.optional_feature(d, feats, "doc_id", "n", "feature")
    return out.select("doc_id", "n", F.size("feature").cast("long").alias("feature_len"),
                      F.aggregate("feature", F.lit(0.0), lambda a, x: a + x).alias("feature_sum"),
                      "feature_missing", "reject_reason")


VOCAB_SQL = f"""
vocab AS (SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) - 1 AS INTEGER) AS id
          FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{sql.WORD_RE.replace("'", "''")}', 0)) AS symbol
                FROM benchmark UNION SELECT 'UNK')),
cw AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '{sql.WORD_RE.replace("'", "''")}', 0) AS words FROM conversations),
ex AS (SELECT conv_id, turn, unnest(generate_series(1, len(words))) AS p, unnest(words) AS w FROM cw),
lk AS (SELECT ex.conv_id, ex.turn, ex.p, v.id FROM ex LEFT JOIN vocab v ON ex.w = v.symbol),
agg AS (SELECT conv_id, turn, count(*) AS n, count(id) AS n_known, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY p) AS known,
               string_agg(CAST(coalesce(id, (SELECT id FROM vocab WHERE symbol = 'UNK')) AS VARCHAR), ' ' ORDER BY p) AS all_ids
        FROM lk GROUP BY conv_id, turn)"""


def _text_of(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


def _vocab(spark, sf):
    b = table(spark, sf, "benchmark").select(F.explode(derive.doc_words()).alias("symbol"))
    sy = b.unionByName(spark.range(1).select(F.lit("UNK").alias("symbol")))
    return J.symbol_vocabulary(sy)


def _conv_words(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", derive.doc_words().alias("words"))


@register("vocab_encode", f"""
WITH {VOCAB_SQL}
SELECT cw.conv_id, cw.turn,
       CASE WHEN coalesce(a.n_known, 0) = coalesce(a.n, 0) THEN CAST(coalesce(a.n, 0) AS DOUBLE) END AS n_ids,
       CASE WHEN coalesce(a.n_known, 0) = coalesce(a.n, 0) THEN coalesce(a.known, '') END AS ids,
       CASE WHEN coalesce(a.n_known, 0) <> coalesce(a.n, 0) THEN 'not_in' END AS reject_reason
FROM cw LEFT JOIN agg a ON cw.conv_id = a.conv_id AND cw.turn = a.turn""")
def q_vocab_encode(spark, sf):
    out = J.vocab_encode(_conv_words(spark, sf), "words", _vocab(spark, sf), policy="reject")
    # rejected rows have no ids: counts are returned as double so both sides share one dtype
    return out.select("conv_id", "turn", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("double").alias("n_ids"),
                      _text_of("ids").alias("ids"), "reject_reason")


@register("vocab_encode_unk", f"""
WITH {VOCAB_SQL}
SELECT cw.conv_id, cw.turn, CAST(coalesce(a.n, 0) AS BIGINT) AS n_ids,
       coalesce(a.all_ids, '') AS ids
FROM cw LEFT JOIN agg a ON cw.conv_id = a.conv_id AND cw.turn = a.turn""")
def q_vocab_encode_unk(spark, sf):
    out = J.vocab_encode(_conv_words(spark, sf), "words", _vocab(spark, sf), policy="unk")
    return out.select("conv_id", "turn", F.size("ids").cast("long").alias("n_ids"), _text_of("ids").alias("ids"))


@register("vocab_encode_drop_join", f"""
WITH {VOCAB_SQL}
SELECT cw.conv_id, cw.turn, CAST(coalesce(a.n_known, 0) AS BIGINT) AS n_ids, coalesce(a.known, '') AS ids
FROM cw LEFT JOIN agg a ON cw.conv_id = a.conv_id AND cw.turn = a.turn""")
def q_vocab_encode_drop_join(spark, sf):
    out = J.vocab_encode(_conv_words(spark, sf), "words", _vocab(spark, sf), policy="drop")
    return out.select("conv_id", "turn", F.size("ids").cast("long").alias("n_ids"), _text_of("ids").alias("ids"))


@register("vocab_decode", f"""
WITH {VOCAB_SQL},
dec AS (SELECT ex.conv_id, ex.turn, string_agg(ex.w, ' ' ORDER BY ex.p) AS s FROM ex JOIN vocab v ON ex.w = v.symbol GROUP BY 1, 2)
SELECT cw.conv_id, cw.turn, coalesce(dec.s, '') AS symbols
FROM cw LEFT JOIN dec ON cw.conv_id = dec.conv_id AND cw.turn = dec.turn""")
def q_vocab_decode(spark, sf):
    v = _vocab(spark, sf)
    enc = J.vocab_encode(_conv_words(spark, sf), "words", v, policy="drop")
    dec = J.vocab_decode(enc, "ids", v, out_col="symbols")
    return dec.select("conv_id", "turn", F.array_join("symbols", " ").alias("symbols"))


@register("catalog_reconcile", """
WITH cat AS (SELECT lang AS locale, source || '#' || n_chars AS key,
                    CAST(count(*) AS VARCHAR) AS value
             FROM documents GROUP BY 1, 2),
std AS (SELECT DISTINCT key FROM cat WHERE locale = 'en'),
locs AS (SELECT DISTINCT locale FROM cat)
SELECT l.locale, s.key, coalesce(c.value, s.key) AS value, c.value IS NULL AS added
FROM locs l CROSS JOIN std s LEFT JOIN cat c ON c.locale = l.locale AND c.key = s.key""")
def q_catalog_reconcile(spark, sf):
    d = table(spark, sf, "documents")
    cat = d.groupBy(F.col("lang").alias("locale"),
                    F.concat(F.col("source"), F.lit("#"), F.col("n_chars").cast("string")).alias("key")) \
        .agg(F.count(F.lit(1)).cast("string").alias("value"))
    std = cat.where(F.col("locale") == "en").select("key")
    return J.catalog_reconcile(cat, std)
