"""Registered streaming jobs (X1-X4), each compared with its batch twin's SQL.

The jobs read the driver's parquet files incrementally (file source,
``availableNow``), write under the session's checkpoint folder and the query
returns the written result.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import streaming as X
from ..operators.filters import quality_gate
from . import derive, sql
from .base import table
from .base import register
from .filters import EXIT_MARK_SQL


@register("stream_ingest_labels", f"""
WITH {sql.LABEL_LINES},
p AS (SELECT line, string_split(line, '|') AS parts FROM label_lines),
q AS (SELECT line, CASE WHEN len(parts) = 4 THEN parts[1] END AS path, CASE WHEN len(parts) = 4 THEN parts[3] END AS lang,
             len(parts) <> 4 AS bad, length(parts[4]) AS n_sem, len({sql.DOC_WORDS.replace('text', 'parts[4]')}) AS n_phon FROM p)
SELECT line, path, lang,
       CASE lang WHEN 'ZH' THEN 'zh' WHEN 'zh' THEN 'zh' WHEN 'JP' THEN 'ja' WHEN 'jp' THEN 'ja' WHEN 'JA' THEN 'ja'
                 WHEN 'ja' THEN 'ja' WHEN 'EN' THEN 'en' WHEN 'en' THEN 'en' WHEN 'En' THEN 'en' END AS lang_code,
       CASE WHEN bad THEN 'field_count'
            WHEN lang NOT IN ('ZH','zh','JP','jp','JA','ja','EN','en','En') OR lang IS NULL THEN 'unsupported_language'
            WHEN n_sem > 54 * 25 THEN 'bigger' WHEN n_phon > 54 * 25 / 2.5 THEN 'ps' WHEN n_sem = 0 THEN 'ps'
            WHEN n_phon / (n_sem / 25.0) > 25.0 OR n_phon / (n_sem / 25.0) < 3.0 THEN 'ps' END AS reject_reason
FROM q""")
def q_stream_ingest_labels(spark, sf):
    base = X.jobs.scratch_dir(spark, "x1")
    inp = os.path.join(base, "in")
    derive.label_lines(table(spark, sf, "documents")).select(F.col("line").alias("value")).write.text(inp)
    X.stream_ingest_labels(spark, inp, os.path.join(base, "out"), gate=_rate_gate)
    cols = "line string, path string, lang string, lang_code string, reject_reason string"
    acc, rej = (spark.read.schema(cols).parquet(os.path.join(base, "out", x)).drop("batch_id") for x in ("accepted", "rejected"))
    return acc.unionByName(rej)


def _rate_gate(parsed):
    """F6 on a label line: characters stand for tokens, words for phones."""
    sized = parsed.withColumns({"n_sem": F.length("text"), "n_phon": F.size(F.regexp_extract_all(F.lower("text"), F.lit(derive.WORD_RE), 0))})
    return quality_gate(sized, "n_sem", "n_phon", max_sec=54).drop("n_sem", "n_phon")


GAP_S = 6 * 3600


@register("stream_gap_segments", f"""
WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events),
l AS (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us) AS prev FROM e),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR us - prev >= CAST({GAP_S} AS BIGINT) * 1000000 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM l)
SELECT user_id, min(us) AS start_us, max(us) + CAST({GAP_S} AS BIGINT) * 1000000 AS end_us, count(*) AS n_events
FROM s GROUP BY user_id, seg""")
def q_stream_gap_segments(spark, sf):
    base = X.jobs.scratch_dir(spark, "x2")
    out = X.stream_gap_segments(spark, sf, base, gap=f"{GAP_S} seconds", glob="events.parquet")
    return spark.read.parquet(out).select("user_id", "start_us", "end_us", "n_events")


def _mark_exit(turns):
    """Marks an exit turn, and gives every turn a time: conversations a minute apart, turns a second."""
    turns = turns.withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("conv_id") * 60 + F.col("turn")).cast("timestamp_ntz"))
    mark = (F.col("role") == "user") & (F.col("turn") == F.pmod("conv_id", F.lit(8)))
    return turns.withColumn("text", F.when(mark, F.lit("Exit")).otherwise(F.col("text")))


@register("stream_turns_until_exit", f"""
WITH {EXIT_MARK_SQL},
e AS (SELECT conv_id, min(turn) AS exit_at FROM c WHERE lower(text) = 'exit' GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.text FROM c LEFT JOIN e USING (conv_id)
WHERE (e.exit_at IS NULL OR c.turn < e.exit_at) AND NOT (c.text IS NULL OR c.text = '')""")
def q_stream_turns_until_exit(spark, sf):
    base = X.jobs.scratch_dir(spark, "x3")
    # the turns of a conversation lie in several files, and so arrive in any order
    src = os.path.join(base, "in")
    table(spark, sf, "conversations").repartition(3, F.xxhash64("conv_id", "turn")).write.parquet(src)
    out = X.stream_turns_until_exit(spark, src, base, glob="*.parquet", prepare=_mark_exit, watermark="400 days", files_per_batch=1)
    return spark.read.parquet(out).select("conv_id", "turn", "text")


def _gate(events):
    v = F.col("value")
    return events.withColumn("reject_reason", F.when(v > 200, "bigger").when(v < 1, "ps"))


@register("stream_reject_counts", """
SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS window_start_us,
       coalesce(CASE WHEN value > 200 THEN 'bigger' WHEN value < 1 THEN 'ps' END, 'kept') AS reason, count(*) AS n
FROM events GROUP BY 1, 2""")
def q_stream_reject_counts(spark, sf):
    base = X.jobs.scratch_dir(spark, "x4")
    out = X.stream_reject_counts(spark, sf, base, _gate, glob="events.parquet", window="1 hour")
    return X.latest_rows(spark.read.parquet(out), ["window_start_us", "reason"]).select("window_start_us", "reason", "n")
