"""Registered lexicon lookup (J6 with T18) over whole documents.

Lexicon layers are built by Spark from the tables: base = benchmark words
(phones = their upper-case letters) plus the 26 letters, extra = words of
conversations (adds missing words only), hot = benchmark words starting with
"th" (overrides), names = nation names.
"""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from ..operators import lexicon as L
from .base import register, table

TOKEN_RE = "[\\p{L}']+|[.,!?]"


def _layers(spark, sf):
    b = table(spark, sf, "benchmark").select(
        "item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("p", "word"))
    base = b.select("word", F.split(F.upper("word"), "", -1).alias("phones"),
                    F.struct(F.col("item_id").alias("a"), F.lit(0).cast("long").alias("b"), F.col("p").alias("c")).alias("line_no"))
    letters = spark.createDataFrame([(ch, [ch.upper()], (-1, 0, 0)) for ch in string.ascii_lowercase],
                                    "word string, phones array<string>, line_no struct<a:long,b:long,c:int>")
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("p", "word"))
    extra = c.select("word", F.array("word").alias("phones"),
                     F.struct(F.col("conv_id").alias("a"), F.col("turn").alias("b"), F.col("p").alias("c")).alias("line_no"))
    hot = b.where(F.col("word").startswith("th")).select(
        "word", F.array(F.lit("HOT"), F.col("word")).alias("phones"),
        F.struct(F.col("item_id").alias("a"), F.lit(0).cast("long").alias("b"), F.col("p").alias("c")).alias("line_no"))
    names = table(spark, sf, "nation").select(F.lower("n_name").alias("word"),
                                              F.array(F.lit("NAME"), F.upper("n_name")).alias("phones"))
    return L.build_lexicon(base.unionByName(letters), extra, hot), names


@register("lexicon_lookup", f"""
WITH bw AS (SELECT item_id, unnest(generate_series(1, len(ws))) AS p, unnest(ws) AS w
            FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+', 0) AS ws FROM benchmark)),
base AS (SELECT w AS word, string_split(upper(w), '') AS phones, 1 AS l, [-item_id, 0, -p] AS o FROM bw
         UNION ALL SELECT chr(96 + CAST(i AS INTEGER)), [upper(chr(96 + CAST(i AS INTEGER)))], 1, [1, 0, 0] FROM range(1, 27) t(i)),
cw AS (SELECT conv_id, turn, unnest(generate_series(1, len(ws))) AS p, unnest(ws) AS w
       FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+', 0) AS ws FROM conversations)),
extra AS (SELECT w AS word, [w] AS phones, 2 AS l, [conv_id, turn, p] AS o FROM cw),
hot AS (SELECT w AS word, ['HOT', w] AS phones, 0 AS l, [-item_id, 0, -p] AS o FROM bw WHERE starts_with(w, 'th')),
lex AS (SELECT word, arg_min(phones, (l, o)) AS phones
        FROM (SELECT * FROM base UNION ALL SELECT * FROM extra UNION ALL SELECT * FROM hot)
        WHERE word NOT IN ('ae', 'ai', 'ar', 'ios', 'hud', 'os') GROUP BY word),
letters AS (SELECT map_from_entries(list({{'k': word, 'v': phones}})) AS m FROM lex WHERE length(word) = 1),
names AS (SELECT lower(n_name) AS word, ['NAME', upper(n_name)] AS phones FROM nation),
tok AS (SELECT doc_id, unnest(generate_series(1, len(ts))) AS pos, unnest(ts) AS o
        FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN_RE.replace("'", "''")}', 0) AS ts FROM documents)),
t1 AS (SELECT tok.*, lower(o) AS w,
              CASE WHEN regexp_matches(lower(o), '^[a-z]+''s$') THEN substr(lower(o), 1, length(lower(o)) - 2) END AS stem
       FROM tok),
t2 AS (SELECT t1.*, lx.phones AS lexp, sx.phones AS slex, nm.phones AS namep, (SELECT m FROM letters) AS m
       FROM t1 LEFT JOIN lex lx ON t1.w = lx.word LEFT JOIN lex sx ON t1.stem = sx.word LEFT JOIN names nm ON t1.w = nm.word),
t3 AS (SELECT *,
         CASE WHEN list_bool_or(list_transform(string_split(w, ''), lambda ch: ch <> 'a' AND m[ch] IS NULL)) THEN NULL
              ELSE flatten(list_transform(string_split(w, ''), lambda ch: CASE WHEN ch = 'a' THEN ['EY1'] ELSE m[ch] END)) END AS spelled,
         CASE WHEN stem IS NULL THEN NULL
              WHEN length(stem) > 1 AND slex IS NOT NULL THEN slex
              WHEN length(stem) <= 3 THEN
                CASE WHEN list_bool_or(list_transform(string_split(stem, ''), lambda ch: ch <> 'a' AND m[ch] IS NULL)) THEN NULL
                     ELSE flatten(list_transform(string_split(stem, ''), lambda ch: CASE WHEN ch = 'a' THEN ['EY1'] ELSE m[ch] END)) END
         END AS stemp
       FROM t2),
t4 AS (SELECT doc_id, pos,
         CASE WHEN NOT regexp_matches(w, '[a-z]') THEN [o]
              WHEN length(w) = 1 THEN CASE WHEN o = 'A' THEN ['EY1'] ELSE m[w] END
              WHEN lexp IS NOT NULL THEN lexp
              WHEN regexp_matches(o, '^\\p{{Lu}}\\p{{Ll}}*$') AND namep IS NOT NULL THEN namep
              WHEN length(w) <= 3 THEN spelled
              WHEN stem IS NOT NULL THEN
                CASE WHEN len(stemp) > 0 THEN list_concat(stemp,
                  CASE WHEN stemp[-1] IN ('P', 'T', 'K', 'F', 'TH', 'HH') THEN ['S']
                       WHEN stemp[-1] IN ('S', 'Z', 'SH', 'ZH', 'CH', 'JH') THEN ['AH0', 'Z'] ELSE ['Z'] END) END
         END AS ph
       FROM t3),
agg AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE ph IS NULL) AS n_oov,
               list(coalesce(ph, []::VARCHAR[]) ORDER BY pos) AS parts FROM t4 GROUP BY doc_id)
SELECT doc_id, n_words, n_oov,
       array_to_string(flatten(list_transform(range(1, len(parts) + 1),
         lambda i: CASE WHEN i = 1 THEN parts[i] ELSE list_concat([' '], parts[i]) END)), ' ') AS phones
FROM agg""")
def q_lexicon_lookup(spark, sf):
    lex, names = _layers(spark, sf)
    texts = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(TOKEN_RE), 0).alias("words"))
    per_doc = L.lookup_sentences(texts, lex, names, ["doc_id"])
    return per_doc.select("doc_id", "n_words", "n_oov", "phones")
