"""Reference-format inputs derived by Spark from the driver tables.

The reference reads label lists, phoneme/token TSVs and run logs; the driver
ships parquet tables.  These functions turn the tables into those layouts
inside the same Spark plan, so every registered query still reads the whole
tables and grows with them.  Each has a matching SQL fragment in ``sql.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_RE = r"[\p{L}']+"


def label_lines(docs: DataFrame) -> DataFrame:
    """documents → ``wavs/<id>.wav|<source>|<lang>|<text on one line>``."""
    line = F.concat_ws(
        "|",
        F.concat(F.lit("wavs/"), F.col("doc_id").cast("string"), F.lit(".wav")),
        F.col("source"), F.col("lang"),
        F.regexp_replace(F.col("text"), "\n", " "),
    )
    return docs.select(F.col("doc_id").alias("line_no"), line.alias("line"))


def doc_words(text_col: str = "text"):
    return F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD_RE), 0)


def phoneme_lines(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Phoneme TSV lines for labelled documents; low-quality ones get a later duplicate.

    ``name<TAB>words<TAB>[len, len, ...]<TAB>text`` with ``line_no = 2·doc_id``;
    the duplicate (``2·doc_id + 1``) carries the reversed word list and must
    win; a toxic, high-quality document gets a malformed later line that must
    be dropped.  One pass: the words are extracted once per document and the
    up to three lines are exploded from that row.
    """
    j = docs.select("doc_id", "text").join(labels.select("doc_id", "quality", "toxic"), "doc_id")
    j = j.select("doc_id", "quality", "toxic", doc_words().alias("w"),
                 F.regexp_replace(F.col("text"), r"[\n\t]", " ").alias("norm"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".wav"))
    w = F.col("w")
    w2p = F.concat(F.lit("["), F.array_join(F.transform(w, lambda x: F.length(x).cast("string")), ", "), F.lit("]"))
    first = F.struct((F.col("doc_id") * 2).alias("line_no"),
                     F.concat_ws("\t", name, F.array_join(w, " "), w2p, F.col("norm")).alias("line"))
    dup = F.when(F.col("quality") == 0, F.struct(
        (F.col("doc_id") * 2 + 1).alias("line_no"),
        F.concat_ws("\t", name, F.array_join(F.reverse(w), " "), F.lit("None"),
                    F.concat(F.lit("v2 "), F.col("norm"))).alias("line")))
    bad = F.when((F.col("toxic") == 1) & (F.col("quality") == 1), F.struct(
        (F.col("doc_id") * 2 + 1).alias("line_no"), F.concat_ws("\t", name, F.lit("x")).alias("line")))
    lines = F.filter(F.array(first, dup, bad), lambda x: x.isNotNull())
    return j.select(F.explode(lines).alias("l")).select("l.line_no", "l.line")


def token_rows(lineitem: DataFrame) -> DataFrame:
    """Token TSV rows from lineitem: ``o<orderkey>_<line>`` and three ids."""
    return lineitem.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("_"),
                 F.col("l_linenumber").cast("string")).alias("item_name"),
        F.concat_ws(" ", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    F.col("l_quantity").cast("long").cast("string")).alias("semantic_audio"),
    )


def run_log_json(events: DataFrame) -> DataFrame:
    """One run-state JSON document per event: a training row and an evaluation row.

    ``to_json`` leaves out null fields, so the two history rows carry
    different field sets, as in the reference's logs.
    """
    null = F.lit(None).cast("double")
    ep = F.col("event_id") / 100.0

    def row(grad, lr, loss, ev_loss, ev_rt, ev_sps, ev_steps):
        return F.struct(ep.alias("epoch"), grad.alias("grad_norm"), lr.alias("learning_rate"),
                        loss.alias("loss"), F.col("event_id").alias("step"),
                        ev_loss.alias("eval_loss"), ev_rt.alias("eval_runtime"),
                        ev_sps.alias("eval_samples_per_second"), ev_steps.alias("eval_steps_per_second"))

    train = row(F.col("value"), F.lit(5e-5), F.col("value") / 10.0, null, null, null, null)
    ev = row(null, null, null, F.col("value") / 7.0, F.col("user_id") / 10.0, F.lit(3.5), F.lit(0.5))
    doc = F.struct(
        (F.col("value") / 7.0).alias("best_metric"),
        F.concat(F.lit("results/checkpoint-"), F.col("event_id").cast("string")).alias("best_model_checkpoint"),
        ep.alias("epoch"),
        F.col("event_id").alias("global_step"),
        F.array(train, ev).alias("log_history"))
    return events.select("event_id", "user_id", F.to_json(doc).alias("value"))
