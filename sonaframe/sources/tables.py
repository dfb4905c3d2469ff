"""Phoneme TSV, token TSV and TSV sinks.

Phoneme table: ``name<TAB>phones<TAB>word2ph<TAB>norm_text`` without header;
rows with another field count are dropped silently and a repeated name keeps
its last line.  Token table: TSV with header ``item_name, semantic_audio``
whose second field holds space-joined integers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labels import read_lines

TOKEN_SCHEMA = T.StructType([
    T.StructField("item_name", T.StringType()),
    T.StructField("semantic_audio", T.StringType()),
])


def parse_word2ph(c: Column) -> Column:
    """Printed Python list (``[1, 2]``) or ``None`` → ``array<int>`` / null."""
    body = F.regexp_replace(c, r"[\[\]\s]", "")
    items = F.filter(F.split(body, ",", -1), lambda x: x != "")
    return F.when(c == "None", F.lit(None)).otherwise(
        F.transform(items, lambda x: x.try_cast("int")))


def parse_phoneme_lines(df: DataFrame, line_col: str = "line",
                        order_col: str = "line_no") -> DataFrame:
    """Keep 4-field lines, one row per name, the last line winning.

    The dedup is ``max_by`` inside a grouped aggregate, so partial
    aggregation runs before the shuffle even for a hot name.
    """
    parts = F.split(F.col(line_col), "\t", -1)
    rows = df.select(F.col(order_col).alias("_ord"), parts.alias("_p")).where(F.size("_p") == 4)
    last = rows.groupBy(F.get("_p", 0).alias("name")).agg(
        F.max_by(F.col("_p"), F.col("_ord")).alias("_p"))
    return last.select(
        "name",
        F.split(F.get("_p", 1), " ", -1).alias("phones"),
        F.get("_p", 2).alias("word2ph_raw"),
        parse_word2ph(F.get("_p", 2)).alias("word2ph"),
        F.get("_p", 3).alias("norm_text"),
    )


def read_phoneme_tsv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_phoneme_lines(read_lines(spark, paths))


def parse_token_ids(c: Column) -> Column:
    """Space-joined integers → ``array<int>`` (a bad item becomes null)."""
    return F.transform(F.split(c, " ", -1), lambda x: x.try_cast("int"))


def parse_token_table(df: DataFrame, ids_col: str = "semantic_audio") -> DataFrame:
    """S3: adds ``semantic_ids``; ``bad_ids`` is true when an item is not an integer."""
    ids = parse_token_ids(F.col(ids_col))
    return df.withColumn("semantic_ids", ids).withColumn(
        "bad_ids", F.exists("semantic_ids", lambda x: x.isNull()))


def read_token_tsv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    df = spark.read.csv(paths if isinstance(paths, str) else list(paths), sep="\t",
                        header=True, schema=TOKEN_SCHEMA, quote="")
    return parse_token_table(df)


def tsv_line(*cols: Column | str) -> Column:
    """Tab-joined line; a null field is empty, a tab or line break inside a field becomes a space."""
    out = [F.regexp_replace(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")), r"[\t\r\n]+", " ")
           for c in cols]
    return F.concat_ws("\t", *out)


def join_spaces(c: Column | str) -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, " ")


def print_list(c: Column | str) -> Column:
    """A printed list of numbers, ``[3, 1, 2]``, or ``None``; ``parse_word2ph`` reads it back."""
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.concat(F.lit("["), F.array_join(x.cast("array<string>"), ", "), F.lit("]")), F.lit("None"))


def write_tsv(df: DataFrame, out_path: str, header: bool = False,
              mode: str = "overwrite", printed: Sequence[str] = ("word2ph",)) -> None:
    """Write a TSV without quoting, one line a row.

    Array columns in ``printed`` are written as printed lists, other array
    columns are space-joined.  With ``header`` every part file starts with the
    header line, which is what ``read_token_tsv`` expects per file.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            c = print_list(c) if f.name in printed else join_spaces(c)
        cols.append(c)
    line = tsv_line(*cols).alias("value")
    if not header:
        df.select(line).write.mode(mode).text(out_path)
        return
    text = [F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\t\r\n]+", " ").alias(n) for c, n in zip(cols, df.columns)]
    (df.select(*text).write.mode(mode).option("sep", "\t").option("header", True).option("quote", "")
       .option("escapeQuotes", False).option("emptyValue", "").csv(out_path))
