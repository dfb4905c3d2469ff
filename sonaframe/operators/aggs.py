"""Aggregations over corpus tables.

All of them are grouped aggregates with map-side partial aggregation; the
ones that need one global number use a scalar subquery rather than a window
over the whole table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

KEPT = "kept"


# A1 ---------------------------------------------------------------------------

def reject_report(df: DataFrame, reason_col: str = "reject_reason") -> DataFrame:
    """A1: rows per reject reason; passing rows are counted under ``kept``."""
    return (df.groupBy(F.coalesce(F.col(reason_col), F.lit(KEPT)).alias("reason"))
              .agg(F.count(F.lit(1)).alias("n")))


def observe_rejects(df: DataFrame, reasons: Sequence[str], reason_col: str = "reject_reason",
                    name: str = "rejects") -> tuple[DataFrame, Observation]:
    """A1 without a second scan: counters ride along the job that writes ``df``.

    ``observation.get`` is filled once an action on the returned frame ends.
    """
    obs = Observation(name)
    r = F.col(reason_col)
    metrics = [F.count(F.lit(1)).alias("total"),
               F.count_if(r.isNull()).alias(KEPT)]
    metrics += [F.count_if(r == F.lit(x)).alias(x) for x in reasons]
    return df.observe(obs, *metrics), obs


# A2 ---------------------------------------------------------------------------

def dataset_profile(inputs: Mapping[str, DataFrame], kept: DataFrame, n_sem_col: str,
                    hz: int = 25) -> DataFrame:
    """A2: one row: size of each input, kept size, and seconds per item (sum/min/max).

    Each number is a scalar subquery, so no input is joined to another.
    """
    spark = kept.sparkSession
    secs = F.col(n_sem_col) / F.lit(float(hz))
    stats = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(secs).alias("s"),
                     F.min(secs).alias("lo"), F.max(secs).alias("hi"))
    cols = [df.select(F.count(F.lit(1))).scalar().alias(f"n_{name}") for name, df in inputs.items()]
    cols += [stats.select("n").scalar().alias("n_kept"),
             stats.select("s").scalar().alias("total_sec"),
             stats.select("lo").scalar().alias("min_sec"),
             stats.select("hi").scalar().alias("max_sec")]
    return spark.range(1).select(*cols)


# A6 ---------------------------------------------------------------------------

def batch_pad_width(df: DataFrame, batch_col: str, len_col: str) -> DataFrame:
    """Per batch the max length and the even width ``2·(max//2 + 1)``."""
    m = F.max(F.col(len_col))
    return df.groupBy(batch_col).agg(
        m.cast("long").alias("max_len"),
        (F.lit(2) * (F.floor(m / 2) + 1)).cast("long").alias("even_width"),
        F.count(F.lit(1)).alias("n"))


# A7 ---------------------------------------------------------------------------

def distinct_keys(df: DataFrame, key_col: str, file_col: str) -> DataFrame:
    """Keys used per file plus the number of distinct keys overall."""
    total = df.select(F.count_distinct(F.col(key_col))).scalar()
    return (df.groupBy(file_col)
              .agg(F.count(F.col(key_col)).alias("n_keys"),
                   F.count_distinct(F.col(key_col)).alias("n_distinct"))
              .withColumn("total_distinct", total))


# A8 ---------------------------------------------------------------------------

def merge_labels(df: DataFrame, group_cols: Sequence[str], order_col: str, text_col: str = "text",
                 length_col: str | None = None, interval: float = 0.0,
                 keep_cols: Sequence[str] = ()) -> DataFrame:
    """Each selected group collapses into its first row.

    Texts are concatenated in row order with no separator; the merged length
    is ``sum(length) + (n-1)·interval``.  A merge group is a user selection,
    so the ordered list is bounded by the selection.
    """
    first = [F.min_by(F.col(c), F.col(order_col)).alias(c) for c in keep_cols]
    parts = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("t"))))
    aggs = [F.min(order_col).alias(order_col), *first,
            F.array_join(F.transform(parts, lambda s: s["t"]), "").alias(text_col),
            F.count(F.lit(1)).alias("n_merged")]
    if length_col:
        aggs.append((F.sum(length_col) + (F.count(F.lit(1)) - 1) * F.lit(interval)).alias(length_col))
    return df.groupBy(*group_cols).agg(*aggs)


# A9 / A10 -----------------------------------------------------------------------

def perplexity(log: DataFrame, loss_col: str = "loss") -> DataFrame:
    """``exp(loss)`` per logged row; rows without a loss are skipped."""
    return log.where(F.col(loss_col).isNotNull()).withColumn("perplexity", F.exp(F.col(loss_col)))


def eval_summary(log: DataFrame, run_cols: Sequence[str] = (), step_col: str = "step",
                 save_steps: int | None = None) -> DataFrame:
    """A10: train rows paired with eval rows of the same step, and the best evaluation per run.

    ``best_step``/``best_eval_loss`` consider only saved checkpoints when
    ``save_steps`` is given (the stored best is not the log minimum);
    ``log_min_*`` is the plain minimum; evaluated samples = runtime × samples/s.
    The pairing is not a self join: one grouped pass per (run, step) keeps
    counts and sums, and the pair multiplicity ``n_train · n_eval`` gives the
    inner join's totals exactly.
    """
    keys = [*run_cols, step_col]
    samples = F.col("eval_runtime") * F.col("eval_samples_per_second")
    per_step = log.groupBy(*keys).agg(
        F.count("loss").alias("_nt"), F.sum("loss").alias("_sl"),
        F.count("eval_loss").alias("_ne"), F.min("eval_loss").alias("_mel"),
        F.sum(F.when(F.col("eval_loss").isNotNull(), samples)).alias("_ses"))
    paired = per_step.where((F.col("_nt") > 0) & (F.col("_ne") > 0))
    pairs = F.col("_nt") * F.col("_ne")
    saved = F.lit(True) if not save_steps else (F.pmod(F.col(step_col), F.lit(save_steps)) == 0)
    grp = paired.groupBy(*run_cols) if run_cols else paired.groupBy()
    return grp.agg(
        F.sum(pairs).alias("n_pairs"),
        F.min_by(F.col(step_col), F.struct(F.col("_mel"), F.col(step_col))).alias("log_min_step"),
        F.min("_mel").alias("log_min_eval_loss"),
        F.min_by(F.when(saved, F.col(step_col)),
                 F.when(saved, F.struct(F.col("_mel"), F.col(step_col)))).alias("best_step"),
        F.min(F.when(saved, F.col("_mel"))).alias("best_eval_loss"),
        F.sum(F.col("_ses") * F.col("_nt")).alias("eval_samples"),
        F.sum(F.col("_sl") * F.col("_ne")).alias("train_loss_sum"),
        (F.sum(F.col("_sl") * F.col("_ne")) / F.sum(pairs)).alias("mean_train_loss"))
