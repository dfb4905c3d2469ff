"""DuckDB fragments mirroring ``derive.py`` (shared by the SQL twins)."""

WORD_RE = r"[\p{L}']+"

LABEL_LINES = """
label_lines AS (
  SELECT doc_id AS line_no,
         concat_ws('|', 'wavs/' || doc_id || '.wav', source, lang, replace(text, chr(10), ' ')) AS line
  FROM documents)"""

DOC_WORDS = "regexp_extract_all(lower(text), '" + WORD_RE.replace("'", "''") + "', 0)"

PHONEME_LINES = f"""
pj AS (SELECT d.doc_id, d.text, l.quality, l.toxic, {DOC_WORDS} AS words
       FROM documents d JOIN labels l USING (doc_id)),
phoneme_lines AS (
  SELECT doc_id * 2 AS line_no,
         concat_ws(chr(9), 'doc' || doc_id || '.wav', array_to_string(words, ' '),
                   '[' || array_to_string(list_transform(words, lambda w: CAST(length(w) AS VARCHAR)), ', ') || ']',
                   regexp_replace(text, '[\\n\\t]', ' ', 'g')) AS line
  FROM pj
  UNION ALL
  SELECT doc_id * 2 + 1,
         concat_ws(chr(9), 'doc' || doc_id || '.wav', array_to_string(list_reverse(words), ' '), 'None',
                   'v2 ' || regexp_replace(text, '[\\n\\t]', ' ', 'g'))
  FROM pj WHERE quality = 0
  UNION ALL
  SELECT doc_id * 2 + 1, concat_ws(chr(9), 'doc' || doc_id || '.wav', 'x')
  FROM pj WHERE toxic = 1 AND quality = 1)"""

PHONEME_TABLE = PHONEME_LINES + """,
phoneme_parts AS (SELECT line_no, string_split(line, chr(9)) AS p FROM phoneme_lines WHERE len(string_split(line, chr(9))) = 4),
phoneme_last AS (SELECT p[1] AS name, arg_max(p, line_no) AS p FROM phoneme_parts GROUP BY p[1]),
phonemes AS (
  SELECT name, string_split(p[2], ' ') AS phones, p[3] AS word2ph_raw,
         CASE WHEN p[3] = 'None' THEN NULL ELSE
           list_transform(list_filter(string_split(regexp_replace(p[3], '[\\[\\]\\s]', '', 'g'), ','), lambda x: x <> ''),
                          lambda x: TRY_CAST(x AS INTEGER)) END AS word2ph,
         p[4] AS norm_text
  FROM phoneme_last)"""

TOKEN_ROWS = """
token_rows AS (
  SELECT 'o' || l_orderkey || '_' || l_linenumber AS item_name,
         concat_ws(' ', CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                   CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS semantic_audio
  FROM lineitem)"""

DOC_LINES = """
doc_lines AS (
  SELECT doc_id, CAST(unnest(generate_series(0, len(p) - 1)) AS BIGINT) AS line_no, unnest(p) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"""


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def md5_key(expr: str, seed: int = 42) -> str:
    return f"md5(CAST({expr} AS VARCHAR) || ':{seed}')"


def md5_unit(expr: str, seed: int = 42) -> str:
    return f"(CAST(('0x' || substr({md5_key(expr, seed)}, 1, 13)) AS BIGINT) / 4503599627370496.0)"


def r6(x: str) -> str:
    """Same rounding as ``registry.base.r6``: identical double arithmetic in both engines."""
    k = f"floor(log10(abs({x})))"
    return (f"(CASE WHEN abs({x}) < 1e6 THEN floor(({x}) * 1000000.0 + 0.5) / 1000000.0 "
            f"ELSE floor(({x}) / pow(10.0, {k}) * 1000000.0 + 0.5) / 1000000.0 * pow(10.0, {k}) END)")
