"""Registered filters and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import filters as FL
from ..sources import corpus
from . import derive, sql
from .base import r6, register, table

@register("clean_lines", f"""
WITH {sql.DOC_LINES}
SELECT doc_id, line_no,
       array_to_string(list_filter(regexp_split_to_array(lower({sql.strip_ws('line')}), '\\s+'),
                                   lambda w: regexp_matches(w, '^\\p{{L}}+$')), ' ') AS text
FROM doc_lines WHERE NOT regexp_matches(line, '^\\s*$')""")
def q_clean_lines(spark, sf):
    lines = corpus.explode_lines(table(spark, sf, "documents"), "text", keep=["doc_id"])
    return FL.clean_lines(lines, "line", "text").select("doc_id", "line_no", "text")


@register("drop_empty_texts", """
SELECT conv_id, turn, text FROM conversations WHERE NOT (text IS NULL OR text IN ('', ' '))""")
def q_drop_empty_texts(spark, sf):
    c = table(spark, sf, "conversations")
    return FL.drop_empty_texts(c, "text").select("conv_id", "turn", "text")


@register("not_only_punct", f"""
WITH {sql.DOC_LINES}
SELECT doc_id, line_no, line FROM doc_lines WHERE regexp_matches(line, '[\\p{{L}}\\p{{N}}]')""")
def q_not_only_punct(spark, sf):
    lines = corpus.explode_lines(table(spark, sf, "documents"), "text", keep=["doc_id"])
    return lines.where(P.has_letter_or_digit("line"))


@register("duration_gate", f"""
SELECT page_id, {sql.r6('strlen(html) / 100 / 2')} AS duration,
       CASE WHEN strlen(html) / 100 / 2 = 0 THEN 'zero_duration'
            WHEN NOT (strlen(html) / 100 / 2 > 0.6 AND strlen(html) / 100 / 2 < 54.0) THEN 'duration' END AS reject_reason
FROM pages""")
def q_duration_gate(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.octet_length("html").alias("length"))
    gated = FL.duration_gate(corpus.item_durations(pages, "length", 100, 640), "duration")
    return gated.select("page_id", r6("duration").alias("duration"), "reject_reason")


@register("reference_gate", """
SELECT doc_id, n_chars * 50 AS n_samples,
       CASE WHEN NOT (n_chars * 50 BETWEEN 48000 AND 160000) THEN 'reference_length' END AS reject_reason
FROM documents""")
def q_reference_gate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") * 50).alias("n_samples"))
    return FL.reference_gate(d, "n_samples", 16000, 3, 10)


QUALITY_SQL = f"""
WITH {sql.PHONEME_TABLE},
tok AS (SELECT 'doc' || doc_id || '.wav' AS item_name, n_chars AS n_sem FROM documents),
ph AS (SELECT name, CAST(len(phones) AS BIGINT) AS n_phon,
              list_bool_and(list_transform(phones, lambda p: regexp_matches(p, '^[a-z'']+$'))) AS all_known
       FROM phonemes),
j AS (SELECT t.item_name, t.n_sem, p.n_phon, p.all_known, p.name IS NOT NULL AS matched
      FROM tok t LEFT JOIN ph p ON t.item_name = p.name),
g AS (SELECT *, CASE
        WHEN NOT matched THEN 'not_in'
        WHEN n_sem > 54 * 25 THEN 'bigger'
        WHEN NOT coalesce(all_known, false) THEN 'not_in'
        WHEN n_phon > 54 * 25 / 2.5 THEN 'ps'
        WHEN n_sem = 0 THEN 'ps'
        WHEN n_phon / (n_sem / 25.0) > 25.0 OR n_phon / (n_sem / 25.0) < 3.0 THEN 'ps' END AS reject_reason
      FROM j)"""


def _gated(spark, sf, **options):
    from ..plans.training import gate_training_pairs
    docs = table(spark, sf, "documents")
    tokens = docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("item_name"),
                         F.col("n_chars").alias("n_sem"))
    from ..sources.tables import parse_phoneme_lines
    ph = parse_phoneme_lines(derive.phoneme_lines(docs, table(spark, sf, "labels")))
    return gate_training_pairs(tokens, ph, key="item_name", phon_key="name", known_re=r"^[a-z']+\z",
                               hz=25, max_sec=54, min_ps=3, max_ps=25, **options)


@register("quality_gate", QUALITY_SQL + """
SELECT item_name, n_sem, CAST(n_phon AS DOUBLE) AS n_phon, reject_reason FROM g""")
def q_quality_gate(spark, sf):
    # n_phon is null for unmatched items: returned as double so both sides share one dtype
    return _gated(spark, sf).select("item_name", "n_sem", F.col("n_phon").cast("double").alias("n_phon"),
                                    "reject_reason")


@register("build_training_set", QUALITY_SQL + """
SELECT coalesce(reject_reason, 'kept') AS reason, count(*) AS n FROM g GROUP BY 1""")
def q_build_training_set(spark, sf):
    from ..operators.aggs import reject_report
    return reject_report(_gated(spark, sf))


@register("map_language", """
SELECT doc_id, CASE lang WHEN 'ZH' THEN 'zh' WHEN 'zh' THEN 'zh' WHEN 'JP' THEN 'ja' WHEN 'jp' THEN 'ja'
  WHEN 'JA' THEN 'ja' WHEN 'ja' THEN 'ja' WHEN 'EN' THEN 'en' WHEN 'en' THEN 'en' WHEN 'En' THEN 'en' END AS lang_code,
  CASE WHEN lang NOT IN ('ZH','zh','JP','jp','JA','ja','EN','en','En') OR lang IS NULL
       THEN 'unsupported_language' END AS reject_reason
FROM documents""")
def q_map_language(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return FL.map_language(d, "lang", "lang_code").select("doc_id", "lang_code", "reject_reason")


@register("map_language_infer", f"""
SELECT doc_id, CASE lang {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in FL.INFER_LANGUAGES.items())} END AS lang_code,
  CASE WHEN lang NOT IN ({', '.join(f"'{a}'" for a in FL.INFER_LANGUAGES)}) OR lang IS NULL THEN 'unsupported_language' END AS reject_reason
FROM documents""")
def q_map_language_infer(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return FL.map_inference_language(d).select("doc_id", "lang_code", "reject_reason")


@register("training_rows", QUALITY_SQL.replace("n_chars AS n_sem FROM documents)", "n_chars AS n_sem FROM documents ORDER BY item_name LIMIT 400)") + """,
kept AS (SELECT item_name, n_sem, n_phon FROM g WHERE reject_reason IS NULL), n AS (SELECT count(*) AS n FROM kept)
SELECT item_name, n_sem, n_phon,
       CAST(unnest(generate_series(1, CASE WHEN n >= 100 THEN 1 ELSE greatest(2, CAST(floor(100 / n) AS INTEGER)) END)) AS INTEGER) AS copy_no
FROM kept, n""")
def q_training_rows(spark, sf):
    """The rows to train on: the first 400 items (O5) that pass the gate (F6), repeated when there are few."""
    from ..operators.sets import upsample_small
    from ..operators.filters import accepted
    return upsample_small(accepted(_gated(spark, sf, max_sample=400))).select("item_name", "n_sem", "n_phon", "copy_no")


@register("is_empty_full", """
SELECT o.o_orderkey,
  (c.c_name IS NULL OR c.c_name = '') AND (c.c_mktsegment IS NULL OR c.c_mktsegment = '')
    AND (o.o_orderpriority IS NULL OR o.o_orderpriority = '') AS is_empty,
  NOT (c.c_name IS NULL OR c.c_name = '') AND NOT (c.c_mktsegment IS NULL OR c.c_mktsegment = '')
    AND NOT (o.o_orderpriority IS NULL OR o.o_orderpriority = '') AS is_full
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_is_empty_full(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    cols = ("c_name", "c_mktsegment", "o_orderpriority")
    return j.select("o_orderkey", P.is_empty(*cols).alias("is_empty"), P.is_full(*cols).alias("is_full"))


@register("default_group_fill", """
WITH c AS (SELECT conv_id, turn,
                  CASE WHEN turn % 3 = 0 THEN '' ELSE 'ref/' || conv_id || '.wav' END AS path,
                  text, role FROM conversations)
SELECT conv_id, turn,
  CASE WHEN any_empty THEN 'default.wav' ELSE path END AS path,
  CASE WHEN any_empty THEN 'default text' ELSE text END AS text,
  CASE WHEN any_empty THEN 'en' ELSE role END AS role,
  any_empty AS filled
FROM (SELECT *, (path IS NULL OR path = '') OR (text IS NULL OR text = '') OR (role IS NULL OR role = '') AS any_empty FROM c)""")
def q_default_group_fill(spark, sf):
    c = table(spark, sf, "conversations")
    c = c.select("conv_id", "turn",
                 F.when(F.pmod("turn", F.lit(3)) == 0, F.lit("")).otherwise(
                     F.concat(F.lit("ref/"), F.col("conv_id").cast("string"), F.lit(".wav"))).alias("path"),
                 "text", "role")
    return FL.default_group_fill(c, ["path", "text", "role"], ["default.wav", "default text", "en"])


@register("clean_path", """
WITH p AS (SELECT page_id, ' "' || url || '"' || chr(10) || ' ' AS raw FROM pages),
s AS (SELECT page_id, raw,
   regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw,
     '^ +| +$', '', 'g'), '^"+|"+$', '', 'g'), '^\\n+|\\n+$', '', 'g'), '^"+|"+$', '', 'g'), '^ +| +$', '', 'g'),
     '^‪+|‪+$', '', 'g') AS cleaned FROM p)
SELECT page_id, cleaned, string_split(cleaned, '/')[-1] AS name FROM s""")
def q_clean_path(spark, sf):
    p = table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit(' "'), F.col("url"), F.lit('"\n ')).alias("raw"))
    c = p.select("page_id", P.clean_path("raw").alias("cleaned"))
    return c.select("page_id", "cleaned", P.basename("cleaned").alias("name"))


@register("shard_filter", """
SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 4 AS BIGINT) AS shard FROM documents""")
def q_shard_filter(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return FL.shard_of(d, ["doc_id"], 4, "shard")


@register("train_val_split", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {sql.md5_key('doc_id')}, doc_id) AS rn,
                  count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= ceil(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM r""")
def q_train_val_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return FL.train_val_split(d, "doc_id", 0.1, 42, exact=True)


@register("train_val_split_bucket", f"""
SELECT doc_id, CASE WHEN floor({sql.md5_unit('doc_id')} * 10000) < 1000 THEN 'val' ELSE 'train' END AS split
FROM documents""")
def q_train_val_split_bucket(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return FL.train_val_split(d, "doc_id", 0.1, 42, exact=False)


EXIT_MARK_SQL = """
c AS (SELECT conv_id, turn, role,
             CASE WHEN role = 'user' AND turn = conv_id % 8 THEN 'Exit' ELSE text END AS text
      FROM conversations)"""


def exit_marked(spark, sf):
    c = table(spark, sf, "conversations")
    mark = (F.col("role") == "user") & (F.col("turn") == F.pmod("conv_id", F.lit(8)))
    return c.select("conv_id", "turn", "role", F.when(mark, F.lit("Exit")).otherwise(F.col("text")).alias("text"))


@register("turns_until_exit", f"""
WITH {EXIT_MARK_SQL},
e AS (SELECT conv_id, min(turn) AS exit_at FROM c WHERE lower(text) = 'exit' GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.text FROM c LEFT JOIN e USING (conv_id)
WHERE (e.exit_at IS NULL OR c.turn < e.exit_at) AND NOT (c.text IS NULL OR c.text = '')""")
def q_turns_until_exit(spark, sf):
    return FL.turns_until_exit(exit_marked(spark, sf)).select("conv_id", "turn", "text")


@register("argmax_label", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS cls,
       CASE WHEN list_position(embedding, list_max(embedding)) = 1 THEN 'Sad' ELSE 'Happy' END AS mood
FROM embeddings""")
def q_argmax_label(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", P.argmax_index("embedding").alias("cls"), P.argmax_label("embedding").alias("mood"))
