"""Training-set build (S2 + S3 → O5 → J1 → F6 → A1 → U3).

One lineage: the token table is left-joined to the phoneme table, one CASE
expression names the first failing rule, the report is a grouped count over
the same gated rows, and a small kept set is repeated in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggs import reject_report
from ..operators.filters import accepted, quality_gate
from ..operators.joins import pair_join
from ..operators.sets import upsample_small
from ..operators.sorts import head_sample


def gate_training_pairs(tokens: DataFrame, phonemes: DataFrame, key: str = "item_name",
                        phon_key: str = "name", ids_col: str = "semantic_ids",
                        phones_col: str = "phones", known_re: str | None = None,
                        max_sample: int | None = None, order_col: str | None = None,
                        hz: int = 25, max_sec: float = 100, min_ps: float = 3,
                        max_ps: float = 25) -> DataFrame:
    """Token rows with their phonemes and ``reject_reason`` (null = kept).

    ``known_re``: every phone must match it (the symbol set); None skips the
    check.  ``n_sem``/``n_phon`` may already exist on the inputs; otherwise
    they are the sizes of ``ids_col``/``phones_col``.
    """
    if max_sample is not None:
        tokens = head_sample(tokens, order_col or key, max_sample)
    if "n_sem" not in tokens.columns:
        tokens = tokens.withColumn("n_sem", F.size(ids_col).cast("long"))
    if "n_phon" not in phonemes.columns:
        phonemes = phonemes.withColumn("n_phon", F.size(phones_col).cast("long"))
    if known_re is not None:
        phonemes = phonemes.withColumn(
            "all_known", F.forall(F.col(phones_col), lambda p: p.rlike(known_re)))
    paired = pair_join(tokens, phonemes, key, phon_key)
    return quality_gate(paired, "n_sem", "n_phon", matched="matched",
                        all_known="all_known" if known_re is not None else None,
                        hz=hz, max_sec=max_sec, min_ps=min_ps, max_ps=max_ps)


def build_training_set(tokens: DataFrame, phonemes: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(kept rows upsampled when fewer than 100, report per reason)."""
    gated = gate_training_pairs(tokens, phonemes, **kw)
    return upsample_small(accepted(gated)), reject_report(gated)
