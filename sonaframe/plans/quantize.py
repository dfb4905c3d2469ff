"""Corpus quantisation (A12 → R10 → S10 token strings)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.vq import as_double_vec, kmeans_fit, rvq_encode


def quantize_corpus(vectors: DataFrame, id_col: str, vec_col: str, k: int = 16, iters: int = 10,
                    n_q: int = 1, seed: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """Fit one codebook per layer on the previous layer's residuals, encode,
    and format ``item_name<TAB>codes`` lines.  Returns (tokens, codebooks)."""
    data = vectors.select(id_col, as_double_vec(vec_col).alias("vec"))
    books: list[DataFrame] = []
    current = data
    for layer in range(n_q):
        cb = kmeans_fit(current, id_col, "vec", k, iters, seed + layer)
        books.append(cb.select("code", "vec"))
        if layer + 1 < n_q:
            enc = rvq_encode(current, [books[-1]])
            current = enc.select(id_col, F.zip_with("vec", "quantized", lambda a, b: a - b).alias("vec"))
    enc = rvq_encode(data, books)
    tokens = enc.select(F.col(id_col).cast("string").alias("item_name"),
                        F.array_join(F.transform("codes", lambda c: c.cast("string")), " ").alias("semantic_audio"))
    return tokens, books
