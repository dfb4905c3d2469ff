"""Array and number column functions.

Built on Spark's higher-order array functions, evaluated per row on the JVM
(interpreted, outside whole-stage codegen); random choices are md5-derived
uniforms of the row id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..util.rank import md5_unit
from .predicates import c_


def pad_right(arr: Column | str, width: Column | int, pad: int | float = 0) -> Column:
    """Right-pad ``arr`` with ``pad`` to ``width`` (no cut)."""
    a = c_(arr)
    w = F.lit(width) if isinstance(width, int) else width
    return F.concat(a, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), (w - F.size(a)).cast("int"))))


def even_width(max_len: Column) -> Column:
    """The second loader's width ``2·(max//2 + 1)``."""
    return (F.lit(2) * (F.floor(max_len / 2) + 1)).cast("int")


def length_mask(length: Column | str, max_len: Column | int, pad_mask: bool = False) -> Column:
    """R2: ``i < len`` for i in 0..max-1 (or ``i >= len`` for the padding mask)."""
    m = F.lit(max_len) if isinstance(max_len, int) else max_len
    n = c_(length)
    seq = F.sequence(F.lit(0), (m - 1).cast("int"))
    seq = F.when(m > 0, seq).otherwise(F.array().cast("array<int>"))
    return F.transform(seq, lambda i: (i >= n) if pad_mask else (i < n))


def eos_shift(y: Column | str, length: Column | str, width: Column | int, eos: int) -> Column:
    """``struct(y_in, target)``: codes with padding replaced by EOS, and the
    same shifted by one with EOS appended (width + 1 positions before the shift)."""
    w = F.lit(width) if isinstance(width, int) else width
    n = c_(length)
    arr = c_(y)
    full = F.transform(F.sequence(F.lit(0), w.cast("int")),
                       lambda i: F.when(i < n, F.get(arr, i)).otherwise(F.lit(eos)))
    return F.struct(F.slice(full, 1, w.cast("int")).alias("y_in"),
                    F.slice(full, 2, w.cast("int")).alias("target"))


def repeat_expand(values: Column | str, counts: Column | str) -> Column:
    """Element i repeated ``counts[i]`` times (null when the sizes differ)."""
    v, c = c_(values), c_(counts)
    rep = F.flatten(F.zip_with(v, c, lambda x, k: F.array_repeat(x, k.cast("int"))))
    return F.when(F.size(v) == F.size(c), rep)


def repeat_expand_check(values: Column | str, counts: Column | str, n_phones: Column | str) -> Column:
    """R4 reject reason: sizes differ, or the counts do not sum to the phone count."""
    v, c = c_(values), c_(counts)
    total = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return (F.when(F.size(v) != F.size(c), F.lit("size_mismatch"))
             .when(total != c_(n_phones), F.lit("count_mismatch")))


def intersperse(arr: Column | str, blank: int | str = 0) -> Column:
    """Blank before, between and after the items (length 2n+1)."""
    a = c_(arr)
    return F.concat(F.flatten(F.transform(a, lambda x: F.array(F.lit(blank), x))), F.array(F.lit(blank)))


def random_start(length: Column | str, size: int, *id_cols: Column | str, seed: int = 42) -> Column:
    """``floor(u · (len - size + 1))`` with u from md5 of the ids."""
    return F.floor(md5_unit(*id_cols, seed=seed) * (c_(length) - F.lit(size) + 1)).cast("int")


def slice_segment(arr: Column | str, start: Column | int, size: int) -> Column:
    """``size`` items from the 0-based ``start``."""
    s = F.lit(start) if isinstance(start, int) else start
    return F.slice(c_(arr), s + 1, size)


def ref_target_split(arr: Column | str, *id_cols: Column | str, seed: int = 42, val: bool = False) -> Column:
    """``struct(reference, target)``; cut point uniform in [n//3, 2·(n//3)],
    a coin decides which side is the reference.  val: the first third is the
    reference and the target is the whole array."""
    a = c_(arr)
    n = F.size(a)
    third = F.floor(n / 3).cast("int")
    if val:
        return F.struct(F.slice(a, 1, third).alias("reference"), a.alias("target"))
    u = md5_unit(*id_cols, seed=seed)
    cut = (third + F.floor(u * (third * 2 - third + 1))).cast("int")
    left = md5_unit(*id_cols, seed=seed + 1) < 0.5
    before = F.slice(a, 1, cut)
    after = F.slice(a, cut + 1, F.greatest(n - cut, F.lit(0)))
    return F.struct(F.when(left, before).otherwise(after).alias("reference"),
                    F.when(left, after).otherwise(before).alias("target"))


def negative_pair(arr: Column | str, *id_cols: Column | str, seed: int = 42, mode: str = "repeat") -> Column:
    """A rejected version of a token array.

    Two md5-drawn points i <= j in [0, n): repeat → ``y[:i] + y[i:j] + y[i:j] + y[j:]``;
    lose → ``y[:i] + y[j:]``.
    """
    a = c_(arr)
    n = F.size(a)
    p = F.floor(md5_unit(*id_cols, seed=seed) * n).cast("int")
    q = F.floor(md5_unit(*id_cols, seed=seed + 1) * n).cast("int")
    i, j = F.least(p, q), F.greatest(p, q)
    pre = F.slice(a, 1, i)
    mid = F.slice(a, i + 1, j - i)
    post = F.slice(a, j + 1, F.greatest(n - j, F.lit(0)))
    if mode == "repeat":
        out = F.concat(pre, mid, mid, post)
    elif mode == "lose":
        out = F.concat(pre, post)
    else:
        raise ValueError(mode)
    return F.when(n > 0, out).otherwise(a)


def log_compress(x: Column | str, c: float = 1.0, clip: float = 1e-5) -> Column:
    """``ln(max(x, clip) · C)``."""
    return F.ln(F.greatest(c_(x), F.lit(clip)) * F.lit(c))


def log_decompress(x: Column | str, c: float = 1.0) -> Column:
    """R11 inverse: ``exp(x) / C``."""
    return F.exp(c_(x)) / F.lit(c)


def softplus(x: Column) -> Column:
    """``ln(1 + e^x)`` computed stably."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def preference_terms(pc: Column | str, pr: Column | str, rc: Column | str | None,
                     rr: Column | str | None, beta: float) -> Column:
    """``struct(loss, chosen_reward, rejected_reward)`` of a logged pair.

    loss = ``-ln σ(β·((pc − pr) − (rc − rr)))`` = softplus(−β·logits);
    reference terms are 0 when reference-free (rc/rr None).
    """
    pc_, pr_ = c_(pc), c_(pr)
    rc_ = F.lit(0.0) if rc is None else c_(rc)
    rr_ = F.lit(0.0) if rr is None else c_(rr)
    ref = F.lit(0.0) if rc is None else (rc_ - rr_)
    logits = (pc_ - pr_) - ref
    return F.struct(softplus(-F.lit(beta) * logits).alias("loss"),
                    (F.lit(beta) * (pc_ - rc_)).alias("chosen_reward"),
                    (F.lit(beta) * (pr_ - rr_)).alias("rejected_reward"))


def log_softmax_at(scores: Column | str, index: Column | str) -> Column:
    """``scores[index] − logsumexp(scores)`` (stable)."""
    s = c_(scores)
    m = F.array_max(s)
    lse = m + F.ln(F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    return F.get(s, c_(index).cast("int")) - lse
