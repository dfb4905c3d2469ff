"""Text corpora, item listings and run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labels import file_path, read_lines

# Fixed layout of a run-state file: metadata plus a history whose rows carry
# either training fields or evaluation fields.
LOG_ROW = T.StructType([
    T.StructField("epoch", T.DoubleType()),
    T.StructField("grad_norm", T.DoubleType()),
    T.StructField("learning_rate", T.DoubleType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("step", T.LongType()),
    T.StructField("eval_loss", T.DoubleType()),
    T.StructField("eval_runtime", T.DoubleType()),
    T.StructField("eval_samples_per_second", T.DoubleType()),
    T.StructField("eval_steps_per_second", T.DoubleType()),
])
RUN_STATE = T.StructType([
    T.StructField("best_metric", T.DoubleType()),
    T.StructField("best_model_checkpoint", T.StringType()),
    T.StructField("epoch", T.DoubleType()),
    T.StructField("global_step", T.LongType()),
    T.StructField("log_history", T.ArrayType(LOG_ROW)),
])


def read_text_corpus(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Several UTF-8 files as one line table ``(source_file, line_no, line)``."""
    return read_lines(spark, paths)


def explode_lines(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """S5 on a text column: one row per line with its position (from 0)."""
    return df.select(*keep, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line")) \
        .withColumn("line_no", F.col("line_no").cast("long"))


def item_durations(df: DataFrame, bytes_col: str = "length", sampling_rate: int = 32000,
                   hop_length: int = 640) -> DataFrame:
    """16-bit mono size → seconds ``bytes / rate / 2`` and frames ``bytes // (2·hop)``."""
    b = F.col(bytes_col)
    return df.withColumn("duration", b / F.lit(sampling_rate) / F.lit(2)) \
             .withColumn("frames", F.floor(b / F.lit(2 * hop_length)).cast("long"))


def read_item_listing(spark: SparkSession, path: str, glob: str = "*",
                      sampling_rate: int = 32000, hop_length: int = 640) -> DataFrame:
    """List files with their byte size; the content column is never read.

    The file source gives no task to a file without bytes, so the names come
    from the file index that Spark builds for every read (listed in parallel,
    kept on the driver as always) and the sizes from the tasks; a name that no
    task reported is an empty file, with length 0.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    named = spark.createDataFrame([(f,) for f in files.inputFiles()], "file string")
    key = file_path(F.col("file"))
    sized = files.select("path", F.col("length"), F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/").alias("_key"))
    listed = named.withColumn("_key", key).join(sized, "_key", "left").select(
        F.coalesce("path", "_key").alias("path"), F.coalesce("length", F.lit(0).cast("long")).alias("length"))
    return item_durations(listed, "length", sampling_rate, hop_length) \
        .withColumn("name", F.element_at(F.split("path", "/"), -1))


def parse_run_log(df: DataFrame, json_col: str = "value") -> DataFrame:
    """One row per history entry, with the run metadata kept on each row."""
    st = F.from_json(F.col(json_col), RUN_STATE)
    return (df.select(*[c for c in df.columns if c != json_col], st.alias("_s"))
              .select("*", F.col("_s.best_metric").alias("best_metric"),
                      F.col("_s.best_model_checkpoint").alias("best_model_checkpoint"),
                      F.col("_s.global_step").alias("global_step"),
                      F.posexplode_outer(F.col("_s.log_history")).alias("row_no", "h"))
              # outer + filter: the inferred "non-empty" filter of a plain explode
              # would parse the JSON a second time
              .where(F.col("h").isNotNull())
              .select("*", "h.*").drop("_s", "h")
              .withColumn("row_no", F.col("row_no").cast("long")))


def read_run_log(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Run-state JSON files (one document per file) → history rows."""
    # the keyword matters: text() would reset an earlier .option("wholetext", ...)
    df = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    return parse_run_log(df.withColumn("source_file", F.col("_metadata.file_path")), "value")


def col_or(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
