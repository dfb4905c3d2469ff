"""Corpus pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes every stage's result as Parquet into the shared folder and rereads it,
so that a lost executor never sends a later stage back to the first.  All
stages but the last return the columns of ``documents``.

Rows with a null doc_id pass the filters that name documents by id; an empty
table gives an empty result; further columns of the input pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaframe.llm.decontam import without_contaminated
from sonaframe.llm.neardup import keep_one, near_duplicates
from sonaframe.llm.packing import pack
from sonaframe.llm.passages import cut_passages
from sonaframe.llm.quality import fit_quality, score_quality
from sonaframe.llm.queries import crc_of_id
from sonaframe.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (a score of 0.3 or more)."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), train=crc_of_id() % 5 != 0)
    scored = score_quality(docs, model, score_col="__score", predicted_col="__predicted")
    return scored.where("__predicted = 1").select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id."""
    return keep_one(docs, near_duplicates(docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds; n_chars follows the text."""
    out = cut_passages(docs)
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, size).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents in sequences of at most 2048 tokens, one row a piece."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicate),
    ("passages", passages),
    ("decontaminate", decontaminate),
    ("pack", packed),
]

#: SQL can express neither the classifier nor the tokenizer: tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
