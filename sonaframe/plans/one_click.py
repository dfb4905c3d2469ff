"""The one-click preparation: text table, peak step, quantisation, each skipped when done."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.signal import peak_blend
from .quantize import quantize_corpus
from .text_table import build_text_table


def finished_rows(spark: SparkSession, path: str) -> int | None:
    """Rows of a finished output, from the marker that is written after it; None when there is none."""
    try:
        row = spark.read.schema("n_rows long").parquet(f"{path}_done").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row["n_rows"] if row else None


def run_step(spark: SparkSession, path: str, make: Callable[[], DataFrame], min_rows: int = 2) -> tuple[int, bool]:
    """(rows, skipped).  An output without its marker is a partial write and is written anew."""
    n = finished_rows(spark, path)
    if n is not None and n >= min_rows:
        return n, True
    make().write.mode("overwrite").parquet(path)
    n = spark.read.parquet(path).count()
    spark.createDataFrame([(n,)], "n_rows long").write.mode("overwrite").parquet(f"{path}_done")
    return n, False


def one_click(spark: SparkSession, out_dir: str, lines: DataFrame, vocab: DataFrame, signals: DataFrame,
              vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16,
              iters: int = 5) -> DataFrame:
    """Runs the three steps into ``out_dir``; a step whose finished output has
    two rows or more is skipped.  Returns one row per step: step, n_rows, skipped."""
    steps = (("text_table", lambda: build_text_table(lines, vocab)[0]),
             ("normalized", lambda: peak_blend(signals)),
             ("semantic", lambda: quantize_corpus(vectors, id_col, vec_col, k, iters)[0]))
    report = [(name, *run_step(spark, os.path.join(out_dir, name), make)) for name, make in steps]
    return spark.createDataFrame(report, "step string, n_rows long, skipped boolean")
