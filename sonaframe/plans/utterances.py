"""Utterance preparation for synthesis input (T1 → T2 → cut → F2 → T9 → F3 → T16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.predicates import has_letter_or_digit

CUTTERS = {
    "none": lambda c: F.array(c),
    "four": T.cut_four,
    "fifty": T.cut_fifty,
    "zh_stop": lambda c: T.cut_on_stop(c, "。"),
    "en_stop": lambda c: T.cut_on_stop(c, "."),
    "punct": T.cut_punct,
}


def prepare_utterances(df: DataFrame, text_col: str = "text", lang_col: str = "lang", how: str = "punct",
                       mode: str = "auto", merge_threshold: int = 5) -> DataFrame:
    """One row per routed segment: ``piece_no, seg_no, seg_text, seg_lang``."""
    target = T.prepare_target(text_col, lang_col)
    pieces = CUTTERS[how](target)
    pieces = F.filter(pieces, lambda p: ~(p.isNull() | p.isin("", " ", "\n")))
    pieces = T.merge_short(pieces, merge_threshold)
    pieces = F.filter(pieces, has_letter_or_digit)
    out = df.select("*", F.posexplode(pieces).alias("piece_no", "piece"))
    out = out.withColumn("piece", T.ensure_final_mark("piece", lang_col))
    segs = out.select("*", F.posexplode(T.language_route("piece", mode)).alias("seg_no", "seg"))
    return segs.select(*[c for c in segs.columns if c not in ("seg",)], F.col("seg.text").alias("seg_text"),
                       F.col("seg.lang").alias("seg_lang"))
