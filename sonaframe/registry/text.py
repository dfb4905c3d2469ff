"""Registered text functions (T1-T17, T19-T22, F3b) on whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from . import sql
from .base import register, table


def q(s: str) -> str:
    """Quote a Python string as a DuckDB literal."""
    return "'" + s.replace("'", "''") + "'"


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _joined(arr, name, sep="\n"):
    return [F.array_join(arr, sep).alias(name), F.size(arr).cast("long").alias(f"n_{name}")]


SPL = T._cls(T.SPLITS)
NSPL = T._ncls(T.SPLITS)
P7 = T._cls(T.PUNCT7)
STRIP_NL = "regexp_replace(text, '^\\n+|\\n+$', '', 'g')"


@register("collapse_punct", f"""
SELECT doc_id, regexp_replace(text, '({P7}){P7}+', '\\1', 'g') AS text FROM documents""")
def q_collapse_punct(spark, sf):
    return _docs(spark, sf).select("doc_id", T.collapse_punct("text").alias("text"))


@register("first_clause", f"""
SELECT doc_id, regexp_replace(regexp_extract(text, '^({NSPL}*)', 1), '^\\s+|\\s+$', '', 'g') AS clause FROM documents""")
def q_first_clause(spark, sf):
    return _docs(spark, sf).select("doc_id", T.first_clause("text").alias("clause"))


@register("ensure_edges", f"""
WITH d AS (SELECT doc_id, lang, text FROM documents),
a AS (SELECT doc_id, lang, CASE WHEN regexp_matches(text, '{SPL}$') OR length(text) = 0 THEN text
                                ELSE text || CASE WHEN lang = 'en' THEN '.' ELSE '。' END END AS final_text,
             regexp_replace({STRIP_NL}, '({P7}){P7}+', '\\1', 'g') AS t FROM d)
SELECT doc_id, final_text,
       CASE WHEN NOT regexp_matches(t, '^{SPL}') AND length(t) > 0
                 AND length(regexp_replace(regexp_extract(t, '^({NSPL}*)', 1), '^\\s+|\\s+$', '', 'g')) < 4
            THEN CASE WHEN lang = 'en' THEN '.' ELSE '。' END || t ELSE t END AS target_text
FROM a""")
def q_ensure_edges(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return d.select("doc_id", T.ensure_final_mark("text", "lang").alias("final_text"),
                    T.prepare_target("text", "lang").alias("target_text"))


SENT_SQL = f"""
s0 AS (SELECT doc_id, replace(replace(text, '……', '。'), '——', '，') AS t FROM documents),
s1 AS (SELECT doc_id, CASE WHEN regexp_matches(t, '{SPL}$') OR length(t) = 0 THEN t ELSE t || '。' END AS t FROM s0),
sents AS (SELECT doc_id, regexp_extract_all(t, '{NSPL}*{SPL}', 0) AS s FROM s1)"""


@register("split_sentences", f"""
WITH {SENT_SQL}
SELECT doc_id, array_to_string(s, chr(10)) AS sentences, CAST(len(s) AS BIGINT) AS n_sentences FROM sents""")
def q_split_sentences(spark, sf):
    return _docs(spark, sf).select("doc_id", *_joined(T.split_sentences("text"), "sentences"))


@register("not_in_punct_set", f"""
WITH {SENT_SQL}
SELECT doc_id, CAST(len(list_filter(s, lambda x: NOT regexp_matches(x, '^{P7}*$'))) AS BIGINT) AS n_kept FROM sents""")
def q_not_in_punct_set(spark, sf):
    from ..functions.predicates import only_punct_set
    s = T.split_sentences("text")
    return _docs(spark, sf).select("doc_id", F.size(F.filter(s, lambda x: ~only_punct_set(x))).cast("long").alias("n_kept"))


@register("cut_four", f"""
WITH r AS (SELECT doc_id, {STRIP_NL} AS raw FROM documents),
s0 AS (SELECT doc_id, raw, replace(replace(raw, '……', '。'), '——', '，') AS t FROM r),
s1 AS (SELECT doc_id, raw, CASE WHEN regexp_matches(t, '{SPL}$') OR length(t) = 0 THEN t ELSE t || '。' END AS t FROM s0),
s AS (SELECT doc_id, raw, regexp_extract_all(t, '{NSPL}*{SPL}', 0) AS s FROM s1),
m AS (SELECT doc_id, raw, s, len(s) AS n, CAST(ceil(len(s) / 4) AS BIGINT) AS m FROM s),
g AS (SELECT doc_id, CASE WHEN m > 1 THEN
        list_transform(generate_series(0, m - 2),
          lambda g: array_to_string(list_slice(s, g * 4 + 1, CASE WHEN g = m - 2 THEN n ELSE g * 4 + 4 END), ''))
      ELSE [raw] END AS opts FROM m),
f AS (SELECT doc_id, list_filter(opts, lambda p: NOT regexp_matches(p, '^{P7}*$')) AS p FROM g)
SELECT doc_id, array_to_string(p, chr(10)) AS pieces, CAST(len(p) AS BIGINT) AS n_pieces FROM f""")
def q_cut_four(spark, sf):
    return _docs(spark, sf).select("doc_id", *_joined(T.cut_four("text"), "pieces"))


FIFTY_SQL = f"""
WITH r AS (SELECT doc_id, {STRIP_NL} AS raw FROM documents),
s0 AS (SELECT doc_id, raw, replace(replace(raw, '……', '。'), '——', '，') AS t FROM r),
s1 AS (SELECT doc_id, raw, CASE WHEN regexp_matches(t, '{SPL}$') OR length(t) = 0 THEN t ELSE t || '。' END AS t FROM s0),
s AS (SELECT doc_id, raw, regexp_extract_all(t, '{NSPL}*{SPL}', 0) AS s FROM s1),
f AS (SELECT doc_id, raw, s, list_reduce(s, lambda acc, x:
        CASE WHEN length(split_part(acc, chr(2), 2) || x) > 50
             THEN CASE WHEN split_part(acc, chr(2), 1) = '' THEN '' ELSE split_part(acc, chr(2), 1) || chr(1) END
                  || split_part(acc, chr(2), 2) || x || chr(2)
             ELSE split_part(acc, chr(2), 1) || chr(2) || split_part(acc, chr(2), 2) || x END, chr(2)) AS st
      FROM s),
o AS (SELECT doc_id, raw, s,
             list_concat(CASE WHEN split_part(st, chr(2), 1) = '' THEN []::VARCHAR[] ELSE string_split(split_part(st, chr(2), 1), chr(1)) END,
                         CASE WHEN split_part(st, chr(2), 2) = '' THEN []::VARCHAR[] ELSE [split_part(st, chr(2), 2)] END) AS out
      FROM f),
m AS (SELECT doc_id, CASE WHEN len(s) < 2 THEN [raw]
             ELSE list_filter(CASE WHEN len(out) > 1 AND length(out[-1]) < 50
                                   THEN list_concat(out[1:len(out) - 2], [out[-2] || out[-1]]) ELSE out END,
                              lambda p: NOT regexp_matches(p, '^{P7}*$')) END AS p FROM o)
SELECT doc_id, array_to_string(p, chr(10)) AS pieces, CAST(len(p) AS BIGINT) AS n_pieces FROM m"""


@register("cut_fifty", FIFTY_SQL)
def q_cut_fifty(spark, sf):
    return _docs(spark, sf).select("doc_id", *_joined(T.cut_fifty("text"), "pieces"))


def _stop_sql(mark: str, esc: str) -> str:
    return f"""
WITH r AS (SELECT doc_id, regexp_replace({STRIP_NL}, '^{esc}+|{esc}+$', '', 'g') AS t FROM documents),
p AS (SELECT doc_id, list_filter(string_split(t, '{mark}'), lambda x: NOT regexp_matches(x, '^{P7}*$')) AS p FROM r)
SELECT doc_id, array_to_string(p, chr(10)) AS pieces, CAST(len(p) AS BIGINT) AS n_pieces FROM p"""


@register("cut_zh_stop", _stop_sql("。", "。"))
def q_cut_zh_stop(spark, sf):
    return _docs(spark, sf).select("doc_id", *_joined(T.cut_on_stop("text", "。"), "pieces"))


@register("cut_en_stop", _stop_sql(".", "\\."))
def q_cut_en_stop(spark, sf):
    return _docs(spark, sf).select("doc_id", *_joined(T.cut_on_stop("text", "."), "pieces"))


CP = T._cls(T.CUT_PUNDS)
NCP = T._ncls(T.CUT_PUNDS)


@register("cut_punct", f"""
WITH r AS (SELECT doc_id, regexp_replace(regexp_replace({STRIP_NL}, '(\\d)\\.(\\d)', '\\1{T.PROTECT}\\2', 'g'),
                                         '(\\d)\\.(\\d)', '\\1{T.PROTECT}\\2', 'g') AS t FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '{NCP}*{CP}|{NCP}+$', 0),
                                                lambda s: replace(s, '{T.PROTECT}', '.')),
                                 lambda s: NOT regexp_matches(s, '^{CP}*$')) AS p FROM r)
SELECT doc_id, array_to_string(p, chr(10)) AS pieces, CAST(len(p) AS BIGINT) AS n_pieces FROM p""")
def q_cut_punct(spark, sf):
    return _docs(spark, sf).select("doc_id", *_joined(T.cut_punct("text"), "pieces"))


CUSTOM_MARKS = ",.?"
CM = T._cls(CUSTOM_MARKS)
NCM = T._ncls(CUSTOM_MARKS)


@register("cut_custom", f"""
WITH r AS (SELECT doc_id, {STRIP_NL} AS t FROM documents),
p AS (SELECT doc_id, array_to_string(list_concat(regexp_extract_all(t, '{NCM}*{CM}', 0),
                                                 [string_split_regex(t, '{CM}')[-1]]), chr(10)) AS x FROM r)
SELECT doc_id, regexp_replace(x, '\\n{{2,}}', chr(10), 'g') AS text FROM p""")
def q_cut_custom(spark, sf):
    return _docs(spark, sf).select("doc_id", T.cut_custom("text", CUSTOM_MARKS).alias("text"))


MERGE_SQL = f"""
WITH r AS (SELECT doc_id, regexp_replace(regexp_replace({STRIP_NL}, '(\\d)\\.(\\d)', '\\1{T.PROTECT}\\2', 'g'),
                                         '(\\d)\\.(\\d)', '\\1{T.PROTECT}\\2', 'g') AS t FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '{NCP}*{CP}|{NCP}+$', 0),
                                                lambda s: replace(s, '{T.PROTECT}', '.')),
                                 lambda s: NOT regexp_matches(s, '^{CP}*$')) AS p FROM r),
f AS (SELECT doc_id, p, list_reduce(p, lambda acc, x:
        CASE WHEN length(split_part(acc, chr(2), 2) || x) >= 5
             THEN CASE WHEN split_part(acc, chr(2), 1) = '' THEN '' ELSE split_part(acc, chr(2), 1) || chr(1) END
                  || split_part(acc, chr(2), 2) || x || chr(2)
             ELSE split_part(acc, chr(2), 1) || chr(2) || split_part(acc, chr(2), 2) || x END, chr(2)) AS st
      FROM p),
o AS (SELECT doc_id, p, CASE WHEN split_part(st, chr(2), 1) = '' THEN []::VARCHAR[]
                             ELSE string_split(split_part(st, chr(2), 1), chr(1)) END AS out,
             split_part(st, chr(2), 2) AS cur FROM f),
m AS (SELECT doc_id, CASE WHEN len(p) < 2 THEN p
                          WHEN cur = '' THEN out
                          WHEN len(out) = 0 THEN [cur]
                          ELSE list_concat(out[1:len(out) - 1], [out[-1] || cur]) END AS pieces FROM o)
SELECT doc_id, array_to_string(pieces, chr(10)) AS pieces, CAST(len(pieces) AS BIGINT) AS n_pieces FROM m"""


@register("merge_short", MERGE_SQL)
def q_merge_short(spark, sf):
    return _docs(spark, sf).select("doc_id", *_joined(T.merge_short(T.cut_punct("text"), 5), "pieces"))


def _translate_sql(x: str, src: str, dst: str) -> str:
    return f"translate({x}, {q(src)}, {q(dst)})"


@register("map_chars_zh", f"""
SELECT doc_id, regexp_replace({_translate_sql("replace(replace(replace(replace(replace(text, '%', '-'), '￥', ','), '嗯', '恩'), '呣', '母'), '...', '…')", T.ZH_FROM, T.ZH_TO)},
                              '[^一-龥!\\?…,\\.]+', '', 'g') AS text
FROM documents""")
def q_map_chars_zh(spark, sf):
    return _docs(spark, sf).select("doc_id", T.map_chars_zh("text").alias("text"))


def normalize_en_sql(x: str) -> str:
    """The English normaliser as one DuckDB expression over ``x``."""
    marks = "regexp_replace(regexp_replace(" + x + ", '[;:：，；]', ',', 'g'), " + q('["’]') + ", " + q("'") + ", 'g')"
    t = "translate(" + marks + ", '。！？', '.!?')"
    t = "regexp_replace(" + _translate_sql(t, T.ACCENT_FROM, T.ACCENT_TO) + ", " + q("[^ A-Za-z'.,?!\\-]") + ", '', 'g')"
    return ("regexp_replace(regexp_replace(" + t + ", " + q("i\\.e\\.") + ", 'that is', 'gi'), "
            + q("e\\.g\\.") + ", 'for example', 'gi')")


JA_TOKEN_RE = r"\p{L}+|\.\.\.|[：；，。！？·、\n,.?!~-]"


@register("map_marks_ja", f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), {q(JA_TOKEN_RE)}, 0) AS toks FROM documents),
m AS (SELECT doc_id, list_transform(toks, lambda x: coalesce(MAP {{{', '.join(f"{q(a) if a != chr(10) else 'chr(10)'}: {q(b)}" for a, b in T.JA_MARKS.items())}}}[x], x)) AS toks FROM t)
SELECT doc_id, array_to_string(list_transform(toks, lambda x: CASE WHEN regexp_matches(x, '^([a-z]+|[,.!?…-])$') THEN x ELSE 'UNK' END), ' ') AS phones
FROM m""")
def q_map_marks_ja(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(JA_TOKEN_RE), 0).alias("toks"))
    return d.select("doc_id", F.array_join(T.map_marks_ja("toks", r"^([a-z]+|[,.!?…-])\z"), " ").alias("phones"))


@register("normalize_en", f"""
WITH a AS (SELECT doc_id, translate(regexp_replace(regexp_replace(text, '[;:：，；]', ',', 'g'), '["’]', '''', 'g'), '。！？', '.!?') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace({_translate_sql('t', T.ACCENT_FROM, T.ACCENT_TO)}, '[^ A-Za-z''.,?!\\-]', '', 'g') AS t FROM a)
SELECT doc_id, regexp_replace(regexp_replace(t, 'i\\.e\\.', 'that is', 'gi'), 'e\\.g\\.', 'for example', 'gi') AS text FROM b""")
def q_normalize_en(spark, sf):
    return _docs(spark, sf).select("doc_id", T.normalize_en("text").alias("text"))


@register("fold_width", f"""
SELECT doc_id, {_translate_sql('text', T.FULLWIDTH_FROM, T.FULLWIDTH_TO)} AS text FROM documents""")
def q_fold_width(spark, sf):
    return _docs(spark, sf).select("doc_id", T.fold_width("text").alias("text"))


SCRIPT_MAP_SQL = """
pairs AS (SELECT n.n_nationkey AS k, substr(n.n_name, 1, 1) AS f, substr(r.r_name, 1, 1) AS t
          FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
fw AS (SELECT f, arg_min(t, k) AS t, min(k) AS k FROM pairs GROUP BY f),
bw AS (SELECT t AS f, arg_min(f, k) AS t, min(k) AS k FROM pairs GROUP BY t),
m AS (SELECT (SELECT string_agg(f, '' ORDER BY k) FROM fw) AS ff, (SELECT string_agg(t, '' ORDER BY k) FROM fw) AS ft,
             (SELECT string_agg(f, '' ORDER BY k) FROM bw) AS bf, (SELECT string_agg(t, '' ORDER BY k) FROM bw) AS bt)"""


@register("convert_script", f"""
WITH {SCRIPT_MAP_SQL}
SELECT doc_id, translate(text, ff, ft) AS forward, translate(text, bf, bt) AS backward FROM documents, m""")
def q_convert_script(spark, sf):
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    pairs = n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.substring("n_name", 1, 1).alias("f"), F.substring("r_name", 1, 1).alias("t"))
    rows = pairs.orderBy("n_nationkey").collect()  # pairs of letters: an alphabet
    mapping = [(x["f"], x["t"]) for x in rows]
    d = _docs(spark, sf)
    return d.select("doc_id", T.convert_script("text", mapping).alias("forward"),
                    T.convert_script("text", mapping, reverse=True).alias("backward"))


def _replace_chain_sql(x: str, rules) -> str:
    for a, b in rules:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


@register("strip_specials", f"""
SELECT doc_id, regexp_replace({_replace_chain_sql(_replace_chain_sql(
    "regexp_replace(replace(text, ' ', ''), " + q(T.ZH_SPECIALS_RE) + ", '', 'g')", T.MEASURE_WORDS), T.ZH_SYMBOL_WORDS)},
    {q(T.ZH_SPECIALS_POST_RE)}, '', 'g') AS text
FROM documents""")
def q_strip_specials(spark, sf):
    return _docs(spark, sf).select("doc_id", T.strip_specials("text").alias("text"))


RE2_CLASSES = [k for k, _ in T.NSW_PATTERNS if k not in T.NSW_NEEDS_JAVA]


@register("nsw_profile", "SELECT doc_id, " + ", ".join(
    f"CAST(len(regexp_extract_all(text, {q(p.replace(chr(92) + '×', '×'))}, 0)) AS BIGINT) AS {k}"
    for k, p in T.NSW_PATTERNS if k in RE2_CLASSES) + " FROM documents")
def q_nsw_profile(spark, sf):
    d = _docs(spark, sf).select("doc_id", T.nsw_counts("text", RE2_CLASSES).alias("m"))
    return d.select("doc_id", *[F.col("m")[k].alias(k) for k in RE2_CLASSES])


@register("nsw_profile_lookaround")
def q_nsw_profile_lookaround(spark, sf):
    d = _docs(spark, sf).select("doc_id", T.nsw_counts("text", list(T.NSW_NEEDS_JAVA)).alias("m"))
    return d.select("doc_id", *[F.col("m")[k].alias(k) for k in T.NSW_NEEDS_JAVA])


@register("nsw_first_match")
def q_nsw_first_match(spark, sf):
    d = _docs(spark, sf).select("doc_id", T.nsw_first_match("text").alias("m"))
    return d.select("doc_id", *[F.col("m")[k].alias(k) for k, _ in T.NSW_PATTERNS])


RUN_RE2 = (r"(\p{Han}[\p{Han}\s\p{P}\d]*|[\p{Hiragana}\p{Katakana}][\p{Hiragana}\p{Katakana}\p{Han}\s\p{P}\d]*"
           r"|\p{Hangul}[\p{Hangul}\s\p{P}\d]*|[\p{Latin}\d][\p{Latin}\s\p{P}\d]*)")
ROUTE_SQL = f"""
WITH r AS (SELECT doc_id, text, regexp_extract_all(text, {q(RUN_RE2)}, 0) AS runs FROM documents),
s AS (SELECT doc_id, text, runs,
             list_transform(runs, lambda x: CASE WHEN regexp_matches(x, '^\\p{{Han}}') THEN 'zh'
                                                 WHEN regexp_matches(x, '^[\\p{{Hiragana}}\\p{{Katakana}}]') THEN 'ja'
                                                 WHEN regexp_matches(x, '^\\p{{Hangul}}') THEN 'ko' ELSE 'en' END) AS langs
      FROM r),
ex AS (SELECT doc_id, runs, langs, unnest(generate_series(1, len(runs))) AS i FROM s)
SELECT doc_id, 'auto' AS mode, CAST(i - 1 AS BIGINT) AS seg_no, runs[i] AS text,
       CASE WHEN langs[i] = 'ko' THEN 'zh' ELSE langs[i] END AS lang FROM ex
UNION ALL
SELECT doc_id, 'zh', CAST(i - 1 AS BIGINT), runs[i], CASE WHEN langs[i] = 'en' THEN 'en' ELSE 'zh' END FROM ex
UNION ALL
SELECT doc_id, 'en', CAST(0 AS BIGINT),
       regexp_replace(array_to_string(list_filter(runs, lambda x, j: langs[j] = 'en'), ' '), ' {{2,}}', ' ', 'g'), 'en' FROM s
UNION ALL
SELECT doc_id, 'all_ja', CAST(0 AS BIGINT), regexp_replace(text, ' {{2,}}', ' ', 'g'), 'ja' FROM documents"""


@register("language_route", ROUTE_SQL)
def q_language_route(spark, sf):
    d = _docs(spark, sf)
    out = []
    for mode in ("auto", "zh", "en", "all_ja"):
        seg = T.language_route("text", mode)
        out.append(d.select("doc_id", F.lit(mode).alias("mode"),
                            F.posexplode(seg).alias("seg_no", "seg")).select(
            "doc_id", "mode", F.col("seg_no").cast("long").alias("seg_no"), "seg.text", "seg.lang"))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


TOKEN_RE = "[\\p{L}']+|[,.!?]"


@register("clean_special", f"""
SELECT doc_id, array_to_string(CASE WHEN contains(text, '|')
    THEN list_transform(regexp_extract_all(replace(text, '|', ','), {q(TOKEN_RE)}, 0), lambda x: CASE WHEN x = ',' THEN 'SP2' ELSE x END)
    ELSE regexp_extract_all(text, {q(TOKEN_RE)}, 0) END, ' ') AS tokens
FROM documents""")
def q_clean_special(spark, sf):
    d = _docs(spark, sf)
    marked = F.regexp_extract_all(F.replace(F.col("text"), F.lit("|"), F.lit(",")), F.lit(TOKEN_RE), 0)
    plain = F.regexp_extract_all(F.col("text"), F.lit(TOKEN_RE), 0)
    toks = F.when(F.col("text").contains("|"), T.mark_special(marked, "SP2")).otherwise(plain)
    return d.select("doc_id", F.array_join(toks, " ").alias("tokens"))


@register("split_keep_marks", f"""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(text, {q('[' + T.JA_WORD_CHARS + ']+|[^' + T.JA_WORD_CHARS + ']')}, 0),
                                      lambda x: x <> ' ') AS t FROM documents)
SELECT doc_id, array_to_string(t, '|') AS tokens, CAST(len(t) AS BIGINT) AS n_tokens FROM t""")
def q_split_keep_marks(spark, sf):
    t = T.split_keep_marks("text")
    return _docs(spark, sf).select("doc_id", F.array_join(t, "|").alias("tokens"), F.size(t).cast("long").alias("n_tokens"))


SP = T._cls(T.SPACING_PUNCT)


@register("normalize_spacing", f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\pZ+({SP})', '\\1', 'g'),
                              '({SP})(\\pL)', '\\1 \\2', 'g'), '\\pZ+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text
FROM documents""")
def q_normalize_spacing(spark, sf):
    return _docs(spark, sf).select("doc_id", T.normalize_spacing("text").alias("text"))


@register("tokenize_pad", f"""
WITH vocab AS (SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) - 1 AS INTEGER) AS id
               FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{sql.WORD_RE.replace("'", "''")}', 0)) AS symbol
                     FROM benchmark UNION SELECT 'UNK')),
unk AS (SELECT id FROM vocab WHERE symbol = 'UNK'),
tok AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+'),
                                   lambda t: t <> '') AS toks FROM documents),
ex AS (SELECT doc_id, unnest(toks) AS w, unnest(generate_series(1, len(toks))) AS pos FROM tok),
ids AS (SELECT ex.doc_id, string_agg(CAST(coalesce(v.id, (SELECT id FROM unk)) AS VARCHAR), ' ' ORDER BY ex.pos) AS s, count(*) AS n
        FROM ex LEFT JOIN vocab v ON ex.w = v.symbol WHERE ex.pos <= 512 GROUP BY ex.doc_id)
SELECT t.doc_id, CAST(512 AS BIGINT) AS width, CAST(coalesce(i.n, 0) AS BIGINT) AS n_real,
       coalesce(i.s, '') AS ids
FROM tok t LEFT JOIN ids i ON t.doc_id = i.doc_id""")
def q_tokenize_pad(spark, sf):
    from .joins import _vocab
    d = _docs(spark, sf).select("doc_id", T.whitespace_tokens(F.lower("text"), 512).alias("toks"))
    # only the tokens that stay are looked up
    enc = J.vocab_encode(d, "toks", _vocab(spark, sf), policy="unk")
    pad = -1
    padded = T.truncate_pad("ids", 512, pad)
    return enc.select("doc_id", F.size(padded).cast("long").alias("width"),
                      F.size(F.filter(padded, lambda x: x != pad)).cast("long").alias("n_real"),
                      F.array_join(F.transform(F.filter(padded, lambda x: x != pad), lambda x: x.cast("string")), " ").alias("ids"))



