"""Dialogue preparation (S5 → F1 → F13 → T21)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate_pad, whitespace_tokens
from ..operators.filters import clean_lines, train_val_split
from ..operators.joins import vocab_encode
from ..util.rank import md5_key


def prepare_dialogue(lines: DataFrame, key_cols: list[str], vocab: DataFrame, line_col: str = "line",
                     width: int = 512, pad: int = -1, seed: int = 42) -> DataFrame:
    """Clean lines, split 10 % validation (exact, md5 order), tokenize, pad to ``width``."""
    cleaned = clean_lines(lines, line_col, "text")
    cleaned = cleaned.withColumn("_rid", md5_key(*key_cols))
    split = train_val_split(cleaned, "_rid", 0.1, seed, exact=True)
    # only the first ``width`` tokens stay, so only these are looked up
    toks = split.withColumn("toks", whitespace_tokens("text", width))
    enc = vocab_encode(toks, "toks", vocab, policy="unk")
    return enc.withColumn("input_ids", truncate_pad("ids", width, pad)) \
              .withColumn("attention", F.transform("input_ids", lambda x: (x != pad).cast("int"))) \
              .drop("_rid", "toks")
