"""Registered scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import basename
from ..sources import corpus, labels, tables
from ..streaming.jobs import scratch_dir
from . import derive, sql
from .base import r6, register, table


def _r6(c):
    return r6(c)


@register("scan_label_list", f"""
WITH {sql.LABEL_LINES},
p AS (SELECT line_no, string_split(line, '|') AS parts FROM label_lines)
SELECT line_no,
       CASE WHEN len(parts) = 4 THEN parts[1] END AS path,
       CASE WHEN len(parts) = 4 THEN parts[2] END AS speaker,
       CASE WHEN len(parts) = 4 THEN parts[3] END AS lang,
       CASE WHEN len(parts) = 4 THEN parts[4] END AS text,
       CAST(len(parts) AS BIGINT) AS n_fields,
       CASE WHEN len(parts) <> 4 THEN 'field_count' END AS reject_reason
FROM p""")
def q_scan_label_list(spark, sf):
    out = labels.parse_label_lines(derive.label_lines(table(spark, sf, "documents")))
    return out.select("line_no", "path", "speaker", "lang", "text", "n_fields", "reject_reason")


@register("scan_phoneme_tsv", f"""
WITH {sql.PHONEME_TABLE}
SELECT name, array_to_string(phones, ' ') AS phones, CAST(len(phones) AS BIGINT) AS n_phones,
       CASE WHEN word2ph IS NULL THEN NULL ELSE CAST(coalesce(list_sum(word2ph), 0) AS DOUBLE) END AS word2ph_sum,
       norm_text
FROM phonemes""")
def q_scan_phoneme_tsv(spark, sf):
    lines = derive.phoneme_lines(table(spark, sf, "documents"), table(spark, sf, "labels"))
    ph = tables.parse_phoneme_lines(lines)
    return ph.select(
        "name", F.array_join("phones", " ").alias("phones"), F.size("phones").cast("long").alias("n_phones"),
        F.aggregate("word2ph", F.lit(0).cast("long"), lambda a, x: a + x).cast("double").alias("word2ph_sum"),
        "norm_text")


@register("scan_token_tsv", f"""
WITH {sql.TOKEN_ROWS},
t AS (SELECT item_name, list_transform(string_split(semantic_audio, ' '), lambda x: TRY_CAST(x AS INTEGER)) AS ids
      FROM token_rows)
SELECT item_name, CAST(len(ids) AS BIGINT) AS n_ids, CAST(list_sum(ids) AS BIGINT) AS ids_sum,
       list_bool_or(list_transform(ids, lambda x: x IS NULL)) AS bad_ids
FROM t""")
def q_scan_token_tsv(spark, sf):
    t = tables.parse_token_table(derive.token_rows(table(spark, sf, "lineitem")))
    return t.select("item_name", F.size("semantic_ids").cast("long").alias("n_ids"),
                    F.aggregate("semantic_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids_sum"),
                    "bad_ids")


@register("scan_label_json", """
SELECT event_id, json_extract_string(props, '$.k') AS text, json_extract_string(props, '$.path') AS path
FROM events""")
def q_scan_label_json(spark, sf):
    ev = table(spark, sf, "events")
    return labels.parse_label_json(ev, "props", text_key="k", path_key="path").select("event_id", "text", "path")


@register("scan_text_corpus", f"""
WITH {sql.DOC_LINES}
SELECT doc_id, line_no, line FROM doc_lines""")
def q_scan_text_corpus(spark, sf):
    return corpus.explode_lines(table(spark, sf, "documents"), "text", keep=["doc_id"])


@register("scan_item_listing", f"""
SELECT page_id, CAST(strlen(html) AS BIGINT) AS length,
       {sql.r6('strlen(html) / 32000 / 2')} AS duration,
       CAST(floor(strlen(html) / 1280) AS BIGINT) AS frames,
       string_split(url, '/')[-1] AS name
FROM pages""")
def q_scan_item_listing(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", F.octet_length("html").cast("long").alias("length"))
    out = corpus.item_durations(pages, "length", 32000, 640)
    return out.select("page_id", "length", _r6(F.col("duration")).alias("duration"), "frames",
                      basename("url").alias("name"))


@register("scan_run_log", f"""
SELECT event_id, CAST(0 AS BIGINT) AS row_no, {sql.r6('value / 7.0')} AS best_metric,
       event_id AS step, {sql.r6('value / 10.0')} AS loss, CAST(NULL AS DOUBLE) AS eval_loss,
       {sql.r6('value')} AS grad_norm, CAST(NULL AS DOUBLE) AS eval_runtime
FROM events
UNION ALL
SELECT event_id, 1, {sql.r6('value / 7.0')}, event_id, NULL, {sql.r6('value / 7.0')}, NULL, {sql.r6('user_id / 10.0')}
FROM events""")
def q_scan_run_log(spark, sf):
    js = derive.run_log_json(table(spark, sf, "events"))
    rows = corpus.parse_run_log(js, "value")
    return rows.select("event_id", "row_no", _r6(F.col("best_metric")).alias("best_metric"), "step",
                       _r6(F.col("loss")).alias("loss"), _r6(F.col("eval_loss")).alias("eval_loss"),
                       _r6(F.col("grad_norm")).alias("grad_norm"), _r6(F.col("eval_runtime")).alias("eval_runtime"))


@register("sink_label_list", f"""
WITH {sql.LABEL_LINES},
p AS (SELECT line_no, string_split(line, '|') AS parts FROM label_lines)
SELECT line_no, {sql.strip_ws("concat_ws('|', parts[1], parts[2], upper(parts[3]), parts[4])")} AS out_line
FROM p WHERE len(parts) = 4""")
def q_sink_label_list(spark, sf):
    parsed = labels.parse_label_lines(derive.label_lines(table(spark, sf, "documents")))
    ok = parsed.where(F.col("reject_reason").isNull())
    return ok.select("line_no", labels.format_label_line().alias("out_line"))


@register("sink_json", """
SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'text': text}) AS json_line FROM documents""")
def q_sink_json(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", labels.to_json_line(["doc_id", "lang", "text"]).alias("json_line"))


@register("sink_tsv", f"""
WITH {sql.PHONEME_TABLE}
SELECT name, concat_ws(chr(9), name, array_to_string(phones, ' '), word2ph_raw, norm_text) AS tsv_line
FROM phonemes""")
def q_sink_tsv(spark, sf):
    lines = derive.phoneme_lines(table(spark, sf, "documents"), table(spark, sf, "labels"))
    ph = tables.parse_phoneme_lines(lines)
    return ph.select("name", tables.tsv_line("name", tables.join_spaces("phones"), "word2ph_raw",
                                             "norm_text").alias("tsv_line"))


# Sinks written, read back, and compared with what was written.

@register("round_trip_label_list", f"""
WITH {sql.LABEL_LINES},
p AS (SELECT string_split(line, '|') AS parts FROM label_lines)
SELECT parts[1] AS path, parts[2] AS speaker, upper(parts[3]) AS lang, {sql.strip_ws('parts[4]')} AS text FROM p WHERE len(parts) = 4""")
def q_round_trip_label_list(spark, sf):
    ok = labels.parse_label_lines(derive.label_lines(table(spark, sf, "documents"))).where(F.col("reject_reason").isNull())
    out = scratch_dir(spark, "labels")
    labels.write_label_list(ok, out)
    back = labels.read_label_list(spark, out)
    return back.select("path", "speaker", "lang", labels.strip_ws(F.col("text")).alias("text"))


@register("round_trip_json", "SELECT doc_id, lang, text FROM documents")
def q_round_trip_json(spark, sf):
    out = scratch_dir(spark, "json")
    labels.write_json(table(spark, sf, "documents").select("doc_id", "lang", "text"), out)
    return spark.read.schema("doc_id long, lang string, text string").json(out)


@register("round_trip_tsv", f"""
WITH {sql.PHONEME_TABLE}
SELECT name, array_to_string(phones, ' ') AS phones, array_to_string(word2ph, ' ') AS word2ph, norm_text FROM phonemes""")
def q_round_trip_tsv(spark, sf):
    lines = derive.phoneme_lines(table(spark, sf, "documents"), table(spark, sf, "labels"))
    out = scratch_dir(spark, "tsv")
    tables.write_tsv(tables.parse_phoneme_lines(lines).select("name", "phones", "word2ph", "norm_text"), out)
    back = tables.read_phoneme_tsv(spark, out)
    return back.select("name", F.array_join("phones", " ").alias("phones"), F.array_join("word2ph", " ").alias("word2ph"), "norm_text")
