"""Registered compositions (rows-only: their parts are checked one by one) and the D2 map."""

from __future__ import annotations



from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.udf import map_batches
from ..plans.batching import plan_batches, plan_bounded_batches
from ..plans.dialogue import prepare_dialogue
from ..plans.one_click import one_click
from ..plans.quantize import quantize_corpus
from ..operators.udf import Frontend, characters, table_units, unit_frontend
from ..plans.text_table import build_text_table
from ..plans.utterances import prepare_utterances
from ..sources.corpus import explode_lines
from ..streaming.jobs import scratch_dir
from . import arrays as A
from . import derive, sql
from ..functions.text import PROTECT as T_PROTECT
from .text import normalize_en_sql
from .windows import BOUNDED_SQL
from .base import register, table
from .joins import _vocab
from .signal import signals


def _symbol_vocab(spark, sf):
    """Symbols of the English front end: benchmark words, marks and UNK."""
    from ..operators.joins import symbol_vocabulary
    b = table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+|[,.?!\\-]"), 0)).alias("symbol"))
    return symbol_vocabulary(b)


TOKEN_SQL = "regexp_extract_all(lower(norm), '[a-z'']+|[,.?!\\-]', 0)"
TEXT_TABLE_SQL = f"""
WITH {sql.LABEL_LINES},
q AS (SELECT line, string_split(line, '|') AS parts FROM label_lines),
acc AS (SELECT string_split(parts[1], '/')[-1] AS name,
               replace(replace(parts[4], '%', '-'), '￥', ',') AS text
        FROM q WHERE len(parts) = 4 AND parts[3] IN ('en', 'fr', 'de', 'es')),
rej1 AS (SELECT line AS name, CASE WHEN len(parts) <> 4 THEN 'field_count' ELSE 'unsupported_language' END AS reason
         FROM q WHERE len(parts) <> 4 OR parts[3] NOT IN ('en', 'fr', 'de', 'es') OR parts[3] IS NULL),
nrm AS (SELECT name, {normalize_en_sql('text')} AS norm FROM acc),
tok AS (SELECT name, norm, {TOKEN_SQL} AS toks FROM nrm),
vocab AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z'']+|[,.?!\\-]', 0)) AS symbol FROM benchmark),
unk AS (SELECT tok.name, count(*) AS n_unknown
        FROM (SELECT name, unnest(toks) AS w FROM tok) t JOIN tok USING (name)
        WHERE w NOT IN (SELECT symbol FROM vocab) GROUP BY tok.name)
SELECT tok.name, CAST(len(toks) AS DOUBLE) AS n_ids,
       concat_ws(chr(9), tok.name, array_to_string(toks, ' '), 'None', norm) AS tsv
FROM tok LEFT JOIN unk ON tok.name = unk.name WHERE unk.name IS NULL
UNION ALL
SELECT tok.name, NULL, 'not_in' FROM tok JOIN unk ON tok.name = unk.name
UNION ALL
SELECT name, NULL, reason FROM rej1"""


@register("build_text_table", TEXT_TABLE_SQL)
def q_build_text_table(spark, sf):
    lines = derive.label_lines(table(spark, sf, "documents"))
    rows = build_text_table(lines, _symbol_vocab(spark, sf), mapping={"en": "en", "fr": "en", "de": "en", "es": "en"},
                            together=True)
    return _table_and_rejects(rows)


def _table_and_rejects(rows):
    """The table's lines, and the rejects with their reason in the place of a line."""
    ok = F.col("reject_reason").isNull()
    return rows.select(F.when(ok, F.col("name")).otherwise(F.col("line")).alias("name"),
                       F.when(ok, F.size("ids")).cast("double").alias("n_ids"),
                       F.when(ok, F.col("tsv")).otherwise(F.col("reject_reason")).alias("tsv"))


#: Phones of the vowels in the aligned front end; other characters stand for themselves.
VOWELS = {v: [v, f"{v}1"] for v in "aeiou"}
LETTER_RE = "[a-z]|[,.?!]| "
ALIGNED_SQL = f"""
WITH {sql.LABEL_LINES},
q AS (SELECT line, string_split(line, '|') AS parts FROM label_lines),
acc AS (SELECT string_split(parts[1], '/')[-1] AS name, parts[3] AS lang,
               lower(replace(replace(parts[4], '%', '-'), '￥', ',')) AS norm
        FROM q WHERE len(parts) = 4 AND parts[3] IN ('fr', 'de')),
ch AS (SELECT name, lang, norm, list_filter(string_split(norm, ''), lambda c: c <> '') AS cs FROM acc),
un AS (SELECT name, lang, norm, CASE WHEN lang = 'fr' THEN list_transform(cs, lambda c: CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') THEN [c, c || '1'] ELSE [c] END)
              ELSE list_transform(regexp_extract_all(norm, '{LETTER_RE}', 0), lambda c: [c]) END AS units,
              CASE WHEN lang = 'fr' THEN list_transform(cs, lambda c: CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') THEN 2 ELSE 1 END)
              ELSE list_transform(cs, lambda c: 1) END AS word2ph FROM ch),
ph AS (SELECT name, norm, flatten(units) AS phones, word2ph FROM un),
vocab AS (SELECT DISTINCT unnest(string_split(lower(text), '')) AS symbol FROM benchmark UNION SELECT unnest(['a1', 'e1', 'i1', 'o1', 'u1'])),
voc AS (SELECT list(symbol) AS symbols FROM vocab),
chk AS (SELECT *, CASE WHEN coalesce(list_sum(word2ph), 0) <> len(phones) THEN 'word2ph_sum'
                       WHEN len(list_filter(list_distinct(phones), lambda p: NOT list_contains(symbols, p))) > 0 THEN 'not_in' END AS reason FROM ph, voc)
SELECT name, CASE WHEN reason IS NULL THEN CAST(len(phones) AS DOUBLE) END AS n_ids,
       coalesce(reason, concat_ws(chr(9), name, array_to_string(phones, ' '), '[' || array_to_string(word2ph, ', ') || ']', norm)) AS tsv
FROM chk
UNION ALL
SELECT line, NULL, CASE WHEN len(parts) <> 4 THEN 'field_count' ELSE 'unsupported_language' END
FROM q WHERE len(parts) <> 4 OR parts[3] NOT IN ('fr', 'de') OR parts[3] IS NULL"""


@register("build_text_table_aligned", ALIGNED_SQL)
def q_build_text_table_aligned(spark, sf):
    """Lines in fr by an aligned front end; lines in de by one that counts one phone a character but reads letters and marks only."""
    from ..operators.joins import symbol_vocabulary
    frontends = {
        "fr": unit_frontend(F.lower, table_units(VOWELS)),
        "de": Frontend(F.lower, lambda c: F.regexp_extract_all(c, F.lit(LETTER_RE), 0),
                       lambda c: F.transform(characters(c), lambda _: F.lit(1))),
        "en": Frontend(F.lower, characters),  # the fallback, which no line takes
    }
    seen = table(spark, sf, "benchmark").select(F.explode(F.concat(
        F.split(F.lower("text"), "", -1), F.array(*[F.lit(p) for ps in VOWELS.values() for p in ps]))).alias("symbol")).distinct()
    lines = derive.label_lines(table(spark, sf, "documents"))
    rows = build_text_table(lines, symbol_vocabulary(seen), mapping={"fr": "fr", "de": "de"}, frontends=frontends, together=True)
    return _table_and_rejects(rows)


PLAN_SQL = f"""
WITH r0 AS (SELECT doc_id, CAST(floor(n_chars / 1000.0 / 2.0) AS BIGINT) AS f,
                   row_number() OVER (ORDER BY n_chars / 1000.0, doc_id) AS rn, len({sql.DOC_WORDS}) AS seq_len
            FROM documents),
b AS (SELECT doc_id, seq_len,
             CAST(rn + least(0, min(f - rn) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS BIGINT) AS bucket
      FROM r0),
g1 AS (SELECT *, row_number() OVER (ORDER BY bucket, {sql.md5_key('doc_id', 0)}, doc_id) AS grn FROM b),
g2 AS (SELECT *, CAST(floor((grn - 1) / (greatest(least(8, floor((SELECT count(*) FROM documents) / 4)), 1) * 2)) AS BIGINT) AS grp
       FROM g1),
g3 AS (SELECT *, CAST(row_number() OVER (ORDER BY {sql.md5_key('grp', 0)}, grp, grn) - 1 AS BIGINT) AS order_pos FROM g2),
nn AS (SELECT count(*) AS n FROM documents),
x AS (SELECT g3.*, nn.n, unnest(generate_series(0, CAST(floor((ceil(nn.n / 2) * 2 - 1 - g3.order_pos) / nn.n) AS BIGINT))) AS k
      FROM g3, nn)
SELECT doc_id, bucket, grp AS "group", CAST(order_pos + k * n AS BIGINT) AS pos,
       CAST((order_pos + k * n) % 2 AS BIGINT) AS rank, CAST(floor((order_pos + k * n) / 2) AS BIGINT) AS local_idx,
       CAST(max(seq_len) OVER (PARTITION BY grp) AS BIGINT) AS width,
       CAST(max(seq_len) OVER (PARTITION BY grp) AS BIGINT) AS padded_len
FROM x"""


@register("plan_batches", PLAN_SQL)
def q_plan_batches(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") / 1000.0).alias("sec"), derive.doc_words().alias("words"))
    items = d.select("doc_id", "sec", F.transform("words", lambda w: F.length(w)).alias("seq"))
    p = plan_batches(items, "doc_id", "sec", "seq", batch_size=8, replicas=2)
    return p.select("doc_id", "bucket", "group", "pos", "rank", "local_idx", F.col("width").cast("long"),
                    F.size("padded").cast("long").alias("padded_len"))


BOUNDED_PLAN_SQL = f"""
WITH {BOUNDED_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {sql.md5_key('doc_id', 0)}, doc_id) - 1 AS r,
             count(*) OVER (PARTITION BY bucket) AS n FROM bb),
t AS (SELECT *, n + ((16 - n % 16) % 16) AS target FROM r),
x AS (SELECT bucket, doc_id, r, n, unnest(generate_series(0, CAST(floor((target - 1 - r) / n) AS BIGINT))) AS k FROM t),
y AS (SELECT bucket, doc_id, CAST(r + k * n AS BIGINT) AS padded_pos, CAST((r + k * n) % 2 AS BIGINT) AS replica,
             CAST(floor(floor((r + k * n) / 2) / 8) AS BIGINT) AS batch_in_bucket FROM x),
w AS (SELECT doc_id, len({sql.DOC_WORDS}) AS seq_len FROM documents)
SELECT y.doc_id, y.bucket, y.padded_pos, y.replica, y.batch_in_bucket,
       max(w.seq_len) OVER (PARTITION BY y.bucket, y.batch_in_bucket, y.replica) AS width
FROM y JOIN w ON y.doc_id = w.doc_id"""


@register("plan_bounded_batches", BOUNDED_PLAN_SQL)
def q_plan_bounded_batches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", derive.doc_words().alias("words"))
    items = d.select("doc_id", "n_chars", F.transform("words", lambda w: F.length(w)).alias("seq"))
    p = plan_bounded_batches(items, "doc_id", "n_chars", "seq", batch_size=8, replicas=2)
    return p.select("doc_id", "bucket", "padded_pos", "replica", "batch_in_bucket", F.col("width").cast("long"))


QUANTIZE_SQL = f"""
WITH e AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),{A.kmeans_sql('e', 16, 5, 0, 'fit')},
a1 AS MATERIALIZED (SELECT e.vec_id, arg_min(c.code, ({A.dist_sql('e.v', 'c.vec')}, c.code)) AS k1 FROM e, fit c GROUP BY e.vec_id),
e2 AS MATERIALIZED (SELECT e.vec_id, list_transform(range(1, len(e.v) + 1), lambda d: e.v[d] - fit.vec[d]) AS v
       FROM e JOIN a1 USING (vec_id) JOIN fit ON fit.code = a1.k1),{A.kmeans_sql('e2', 16, 5, 1, 'fit2')},
a2 AS (SELECT e.vec_id, arg_min(c.code, ({A.dist_sql('e.v', 'c.vec')}, c.code)) AS k2 FROM e2 e, fit2 c GROUP BY e.vec_id)
SELECT CAST(vec_id AS VARCHAR) AS item_name, k1 || ' ' || k2 AS semantic_audio FROM a1 JOIN a2 USING (vec_id)"""


@register("quantize_corpus", QUANTIZE_SQL)
def q_quantize_corpus(spark, sf):
    tokens, _ = quantize_corpus(table(spark, sf, "embeddings"), "vec_id", "embedding", k=16, iters=5, n_q=2)
    return tokens


DIALOGUE_SQL = """
WITH lines AS (SELECT conv_id, turn, CAST(unnest(generate_series(0, len(p) - 1)) AS BIGINT) AS line_no, unnest(p) AS line
               FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS p FROM conversations)),
cl AS (SELECT conv_id, turn, line_no,
              array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(line, '^\\s+|\\s+$', '', 'g')), '\\s+'),
                                          lambda w: regexp_matches(w, '^\\p{L}+$')), ' ') AS text
       FROM lines WHERE NOT regexp_matches(line, '^\\s*$')),
k AS (SELECT *, md5(conv_id || ':' || turn || ':' || line_no || ':42') AS rid FROM cl),
r AS (SELECT *, row_number() OVER (ORDER BY md5(rid || ':42'), rid) AS rn, count(*) OVER () AS n FROM k),
t AS (SELECT *, CASE WHEN rn <= ceil(n * 0.1) THEN 'val' ELSE 'train' END AS split,
             list_filter(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda x: x <> '') AS tk
      FROM r)
SELECT conv_id, turn, line_no, split, CAST(512 AS BIGINT) AS width, CAST(least(len(tk), 512) AS BIGINT) AS n_real FROM t"""


@register("prepare_dialogue", DIALOGUE_SQL)
def q_prepare_dialogue(spark, sf):
    lines = explode_lines(table(spark, sf, "conversations"), "text", keep=["conv_id", "turn"])
    out = prepare_dialogue(lines, ["conv_id", "turn", "line_no"], _vocab(spark, sf), "line")
    return out.select("conv_id", "turn", "line_no", "split", F.size("input_ids").cast("long").alias("width"),
                      F.aggregate("attention", F.lit(0), lambda a, x: a + x).cast("long").alias("n_real"))


def _utterances_sql() -> str:
    from . import text as RT
    spl, nspl, p7 = RT.SPL, RT.NSPL, RT.P7
    cp, ncp, prot = RT.CP, RT.NCP, T_PROTECT
    mark = "CASE WHEN lang = 'en' THEN '.' ELSE '。' END"
    return f"""
WITH a AS (SELECT doc_id, lang,
                  regexp_replace(regexp_replace(text, '^\\n+|\\n+$', '', 'g'), '({p7}){p7}+', '\\1', 'g') AS t FROM documents),
b AS (SELECT doc_id, lang,
             CASE WHEN NOT regexp_matches(t, '^{spl}') AND length(t) > 0
                       AND length(regexp_replace(regexp_extract(t, '^({nspl}*)', 1), '^\\s+|\\s+$', '', 'g')) < 4
                  THEN {mark} || t ELSE t END AS target FROM a),
c AS (SELECT doc_id, lang,
             regexp_replace(regexp_replace(regexp_replace(target, '^\\n+|\\n+$', '', 'g'),
                            '(\\d)\\.(\\d)', '\\1{prot}\\2', 'g'), '(\\d)\\.(\\d)', '\\1{prot}\\2', 'g') AS t FROM b),
p AS (SELECT doc_id, lang,
             list_filter(list_filter(list_transform(regexp_extract_all(t, '{ncp}*{cp}|{ncp}+$', 0),
                                                    lambda s: replace(s, '{prot}', '.')),
                                     lambda s: NOT regexp_matches(s, '^{cp}*$')),
                         lambda s: NOT (s IS NULL OR s IN ('', ' ', chr(10)))) AS p FROM c),
f AS (SELECT doc_id, lang, p, list_reduce(p, lambda acc, x:
        CASE WHEN length(split_part(acc, chr(2), 2) || x) >= 5
             THEN CASE WHEN split_part(acc, chr(2), 1) = '' THEN '' ELSE split_part(acc, chr(2), 1) || chr(1) END
                  || split_part(acc, chr(2), 2) || x || chr(2)
             ELSE split_part(acc, chr(2), 1) || chr(2) || split_part(acc, chr(2), 2) || x END, chr(2)) AS st FROM p),
o AS (SELECT doc_id, lang, p, CASE WHEN split_part(st, chr(2), 1) = '' THEN []::VARCHAR[]
                                   ELSE string_split(split_part(st, chr(2), 1), chr(1)) END AS out,
             split_part(st, chr(2), 2) AS cur FROM f),
m AS (SELECT doc_id, lang, list_filter(CASE WHEN len(p) < 2 THEN p WHEN cur = '' THEN out WHEN len(out) = 0 THEN [cur]
                                            ELSE list_concat(out[1:len(out) - 1], [out[-1] || cur]) END,
                                       lambda s: regexp_matches(s, '[\\p{{L}}\\p{{N}}]')) AS ps FROM o),
e AS (SELECT doc_id, lang, CAST(unnest(generate_series(0, len(ps) - 1)) AS BIGINT) AS piece_no, unnest(ps) AS piece FROM m),
g AS (SELECT doc_id, piece_no,
             CASE WHEN regexp_matches(piece, '{spl}$') OR length(piece) = 0 THEN piece ELSE piece || {mark} END AS piece FROM e),
r AS (SELECT doc_id, piece_no, regexp_extract_all(piece, {RT.q(RT.RUN_RE2)}, 0) AS runs FROM g),
x AS (SELECT doc_id, piece_no, runs, unnest(generate_series(1, len(runs))) AS i FROM r)
SELECT doc_id, piece_no, CAST(i - 1 AS BIGINT) AS seg_no, runs[i] AS seg_text,
       CASE WHEN regexp_matches(runs[i], '^\\p{{Han}}') THEN 'zh'
            WHEN regexp_matches(runs[i], '^[\\p{{Hiragana}}\\p{{Katakana}}]') THEN 'ja'
            WHEN regexp_matches(runs[i], '^\\p{{Hangul}}') THEN 'zh' ELSE 'en' END AS seg_lang
FROM x"""


@register("prepare_utterances", _utterances_sql())
def q_prepare_utterances(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    u = prepare_utterances(d, "text", "lang", how="punct", mode="auto")
    return u.select("doc_id", F.col("piece_no").cast("long"), F.col("seg_no").cast("long"), "seg_text", "seg_lang")


ONE_CLICK_SQL = f"""
SELECT 'text_table' AS step, count(*) AS n_rows, false AS skipped
FROM ({TEXT_TABLE_SQL.replace("('en', 'fr', 'de', 'es')", "('en')")}) WHERE n_ids IS NOT NULL
UNION ALL
SELECT 'normalized', count(*), false FROM events WHERE user_id IN (
  SELECT user_id FROM events GROUP BY 1 HAVING NOT bool_or(isnan(value)) AND max(abs(value / 100.0)) <= 2.2 AND max(abs(value)) > 0)
UNION ALL
SELECT 'semantic', count(*), false FROM embeddings"""


@register("one_click", ONE_CLICK_SQL)
def q_one_click(spark, sf):
    out = scratch_dir(spark, "one-click")
    lines = derive.label_lines(table(spark, sf, "documents"))
    return one_click(spark, out, lines, _symbol_vocab(spark, sf), signals(spark, sf).select("signal_id", "pos", "v"),
                     table(spark, sf, "embeddings"), k=8, iters=3)


def _count_marks(row: dict) -> dict:
    text = row["text"]
    if "|" in text:
        raise ValueError("field separator inside text")
    return {"n_marks": sum(ch in ",.?!" for ch in text)}


def _count_marks_batch(pdf):
    if pdf["text"].str.contains("|", regex=False).any():
        raise ValueError("field separator inside text")
    return pdf.assign(n_marks=pdf["text"].str.count("[,.?!]"))


@register("map_batches", """
SELECT doc_id,
       CASE WHEN contains(text, '|') THEN NULL
            ELSE CAST(length(text) - length(regexp_replace(text, '[,.?!]', '', 'g')) AS DOUBLE) END AS n_marks,
       contains(text, '|') AS failed
FROM documents""")
def q_map_batches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    out = map_batches(d, _count_marks, T.StructType([T.StructField("n_marks", T.LongType())]), "doc_id", _count_marks_batch)
    # the error text carries a traceback; the check compares whether the row failed
    return out.select("doc_id", F.col("n_marks").cast("double"), F.col("error").isNotNull().alias("failed"))



