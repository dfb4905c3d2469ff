"""Text-table build (S1 → F8 → F11 → T10/T11 → D1 → J7 → S10), with rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.predicates import basename, clean_path
from ..operators.filters import accepted, map_language, rejected
from ..operators.joins import vocab_encode
from ..operators.udf import Frontend, apply_frontend, check_word2ph, computed_once, table_units, unit_frontend
from ..sources.labels import LABEL_FIELDS, parse_label_lines
from ..sources.tables import print_list, tsv_line

EN_TOKEN_RE = "[a-z']+|[,.?!\\-]"


#: Front ends of the languages that a label list may name.
FRONTENDS = {
    "en": Frontend(T.normalize_en, lambda c: F.regexp_extract_all(F.lower(c), F.lit(EN_TOKEN_RE), 0)),
    "zh": unit_frontend(T.map_chars_zh, table_units({})),
    "ja": Frontend(lambda c: T.fold_width(c), T.split_keep_marks),
}


def build_text_table(lines: DataFrame, vocab: DataFrame, line_col: str = "line",
                     mapping=None, frontends=None, together: bool = False):
    """Returns (table with ``tsv`` lines, rejects with their reason).

    The symbol vocabulary is the encoder's: an unknown symbol rejects the
    item (``not_in``), as the reference's assertion does.  A front end with an
    alignment gives ``word2ph``, printed as a list in the third field of the
    line (``None`` without one); an item whose counts do not add up to its
    phones, or are not one for each character, is rejected (``word2ph_sum``,
    ``word2ph_length``).

    With ``together`` one frame holds both: ``reject_reason`` is null for the
    table's rows, and ``line`` is what the rejects give.  Who wants every row
    then runs the front ends once and not once for each frame.
    """
    fields = computed_once(parse_label_lines(lines, line_col), *LABEL_FIELDS, "n_fields", "reject_reason")
    parsed = map_language(fields, "lang", "lang_code", mapping).withColumnRenamed("reject_reason", "_refused")
    parsed = parsed.withColumn("name", basename(clean_path("path"))).withColumn(
        "text", F.replace(F.replace(F.col("text"), F.lit("%"), F.lit("-")), F.lit("￥"), F.lit(",")))
    # lines refused here have no language: the front ends read a blank for them
    taken = F.col("_refused").isNull()
    parsed = parsed.withColumn("lang_code", F.when(taken, F.col("lang_code")))
    fe = apply_frontend(parsed, "text", "lang_code", frontends=frontends or FRONTENDS)
    # the alignment is checked first, then the symbols
    aligned = check_word2ph(fe, text_col="norm_text").withColumnRenamed("reject_reason", "_misaligned")
    enc = vocab_encode(aligned, "phones", vocab, policy="reject")
    enc = enc.withColumn("reject_reason", F.coalesce("_refused", "_misaligned", "reject_reason"))
    tsv = tsv_line("name", F.array_join("phones", " "), print_list("word2ph"), "norm_text")
    rows = enc.select(
        "name", "phones", "ids", "word2ph", "norm_text", F.when(F.col("reject_reason").isNull(), tsv).alias("tsv"),
        F.when(taken, F.col("name")).otherwise(F.col(line_col)).alias("line"), "reject_reason")
    if together:
        return rows
    return accepted(rows).drop("line", "reject_reason"), rejected(rows).select("line", "reject_reason")
