"""Filters and gates.

Gates do not drop rows silently: they add a ``reject_reason`` column (null on
pass) so one pass yields both the kept rows and the per-reason counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import BLANKS, c_, is_blank
from ..util.rank import global_row_number, md5_bucket, md5_key

# Language spellings accepted for training and their codes.
TRAIN_LANGUAGES = {
    "ZH": "zh", "zh": "zh",
    "JP": "ja", "jp": "ja", "JA": "ja", "ja": "ja",
    "EN": "en", "en": "en", "En": "en",
}
# Inference language choices (display names and codes).
INFER_LANGUAGES = {
    "中文": "all_zh", "英文": "en", "日文": "all_ja",
    "中英混合": "zh", "日英混合": "ja", "多语种混合": "auto",
    "all_zh": "all_zh", "en": "en", "all_ja": "all_ja",
    "zh": "zh", "ja": "ja", "auto": "auto",
}

REASON_LANGUAGE = "unsupported_language"


def with_reason(df: DataFrame, reason: Column, name: str = "reject_reason") -> DataFrame:
    """Set the reject reason unless an earlier gate already set one."""
    if name in df.columns:
        return df.withColumn(name, F.coalesce(F.col(name), reason))
    return df.withColumn(name, reason)


def accepted(df: DataFrame, name: str = "reject_reason") -> DataFrame:
    return df.where(F.col(name).isNull())


def rejected(df: DataFrame, name: str = "reject_reason") -> DataFrame:
    return df.where(F.col(name).isNotNull())


# F1 ---------------------------------------------------------------------------

def clean_words(c: Column | str) -> Column:
    """Trim, lower, split on whitespace, keep all-letter words, join by one space.

    Every blank becomes a space, so the split needs no pattern; empty words
    hold no letter and go with the others.
    """
    words = F.split(F.translate(F.lower(c_(c)), BLANKS, " " * len(BLANKS)), " ", -1)
    return F.array_join(F.filter(words, lambda w: w.rlike(r"^\p{L}++\z")), " ")


def clean_lines(df: DataFrame, line_col: str = "line", out_col: str = "text") -> DataFrame:
    """drop blank lines, then clean; a line that cleans to '' is kept."""
    return df.where(F.col(line_col).rlike(f"[^{BLANKS}]")).withColumn(out_col, clean_words(line_col))


# F2 ---------------------------------------------------------------------------

def drop_empty_texts(df: DataFrame, text_col: str = "text", check: bool = True) -> DataFrame:
    """remove null, '' and ' '; raise when every text is empty ('\\n' too)."""
    t = F.col(text_col)
    if check:
        useful = df.where(~(t.isNull() | t.isin("", " ", "\n")))
        if useful.isEmpty():
            raise ValueError("no valid text")
    return df.where(~(t.isNull() | t.isin("", " ")))


# F4 / F5 ------------------------------------------------------------------------

def duration_gate(df: DataFrame, duration_col: str = "duration", low: float = 0.6,
                  high: float = 54.0, val: bool = False) -> DataFrame:
    """keep ``low < d < high``; zero duration is its own reason; ``val`` passes all non-zero."""
    d = F.col(duration_col)
    keep = F.lit(True) if val else ((d > F.lit(low)) & (d < F.lit(high)))
    reason = (F.when(d == 0, F.lit("zero_duration"))
               .when(~keep, F.lit("duration")))
    return with_reason(df, reason)


def reference_gate(df: DataFrame, samples_col: str = "n_samples", rate: int = 16000,
                   min_sec: float = 3.0, max_sec: float = 10.0) -> DataFrame:
    """reject a reference clip outside ``[min_sec, max_sec]`` seconds (inclusive)."""
    n = F.col(samples_col)
    ok = n.between(F.lit(int(min_sec * rate)), F.lit(int(max_sec * rate)))
    return with_reason(df, F.when(~ok, F.lit("reference_length")))


# F6 ---------------------------------------------------------------------------

def quality_gate(df: DataFrame, n_sem: str = "n_sem", n_phon: str = "n_phon",
                 matched: str | None = None, all_known: str | None = None,
                 hz: int = 25, max_sec: float = 100, min_ps: float = 3,
                 max_ps: float = 25) -> DataFrame:
    """first failing rule names the reason; passing rows keep null.

    Order: key missing → ``not_in``; tokens > max_sec·hz → ``bigger``;
    unknown symbol → ``not_in``; phones > max_sec·hz/2.5 → ``ps``;
    rate ``n_phon / (n_sem / hz)`` outside [min_ps, max_ps] → ``ps``.
    Zero tokens make the rate undefined and are rejected as ``ps``.
    """
    s, p = F.col(n_sem), F.col(n_phon)
    rate = p / (s / F.lit(float(hz)))
    cond = F.when(F.lit(False), F.lit(None))
    if matched is not None:
        cond = cond.when(~F.coalesce(F.col(matched), F.lit(False)), F.lit("not_in"))
    cond = cond.when(s > F.lit(max_sec * hz), F.lit("bigger"))
    if all_known is not None:
        cond = cond.when(~F.coalesce(F.col(all_known), F.lit(False)), F.lit("not_in"))
    cond = (cond.when(p > F.lit(max_sec * hz / 2.5), F.lit("ps"))
                .when(s == 0, F.lit("ps"))
                .when((rate > F.lit(float(max_ps))) | (rate < F.lit(float(min_ps))), F.lit("ps")))
    return with_reason(df, cond)


# F8 ---------------------------------------------------------------------------

def map_language(df: DataFrame, lang_col: str = "lang", out_col: str = "lang_code",
                 mapping: Mapping[str, str] | None = None) -> DataFrame:
    """F8: alias map (9 spellings by default); unsupported → reject reason.

    The map is a literal of the mapping's size, evaluated inside codegen.
    """
    m = TRAIN_LANGUAGES if mapping is None else dict(mapping)
    lit_map = F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    code = F.try_element_at(lit_map, F.col(lang_col))
    out = df.withColumn(out_col, code)
    return with_reason(out, F.when(F.col(out_col).isNull(), F.lit(REASON_LANGUAGE)))


def map_inference_language(df: DataFrame, lang_col: str = "lang", out_col: str = "lang_code") -> DataFrame:
    """F8 at inference: display names and codes, including ``all_*`` and ``auto``."""
    return map_language(df, lang_col, out_col, INFER_LANGUAGES)


# F10 --------------------------------------------------------------------------

def default_group_fill(df: DataFrame, cols: Sequence[str], defaults: Sequence[str | None]) -> DataFrame:
    """if any of ``cols`` is empty replace all of them by ``defaults``.

    The defaults must be complete (no null or ''), as the reference checks
    before serving.
    """
    if len(cols) != len(defaults):
        raise ValueError("one default per column")
    if any(d is None or d == "" for d in defaults):
        raise ValueError("default group is incomplete")
    any_empty = F.lit(False)
    for c in cols:
        any_empty = any_empty | is_blank(c)
    out = df
    filled = [F.when(any_empty, F.lit(d)).otherwise(F.col(c)).alias(c) for c, d in zip(cols, defaults)]
    keep = [F.col(c) for c in df.columns if c not in cols]
    return out.select(*keep, *filled, any_empty.alias("filled"))


# F12 / F13 ----------------------------------------------------------------------

def shard_filter(df: DataFrame, order_cols: Sequence[str], shard: int, num_shards: int) -> DataFrame:
    """row r (from 0, in ``order_cols`` order) goes to shard ``r mod N``.

    In a Spark job partitions replace shards; this keeps the reference's
    assignment when a downstream consumer needs the same split.
    """
    ranked = global_row_number(df, order_cols, "_rn")
    return ranked.where(F.pmod(F.col("_rn") - 1, F.lit(num_shards)) == shard).drop("_rn")


def shard_of(df: DataFrame, order_cols: Sequence[str], num_shards: int, out_col: str = "shard") -> DataFrame:
    ranked = global_row_number(df, order_cols, "_rn")
    return ranked.withColumn(out_col, F.pmod(F.col("_rn") - 1, F.lit(num_shards)).cast("long")).drop("_rn")


def train_val_split(df: DataFrame, id_col: str, fraction: float = 0.1, seed: int = 42,
                    exact: bool = True, out_col: str = "split") -> DataFrame:
    """``split`` = 'val' / 'train'.

    exact: validation = the ``ceil(n·fraction)`` rows first in md5 order
    (a global rank; the count is a scalar subquery).  scalable: md5 bucket
    below ``fraction`` (no rank, no count; size is close to, not equal to,
    the fraction).
    """
    if not exact:
        b = md5_bucket(id_col, seed=seed, buckets=10000)
        return df.withColumn(out_col, F.when(b < F.lit(int(round(fraction * 10000))), "val").otherwise("train"))
    n = df.select(F.count(F.lit(1))).scalar()
    k = F.ceil(n * F.lit(fraction))
    ranked = global_row_number(df.withColumn("_h", md5_key(id_col, seed=seed)), ["_h", id_col], "_rn")
    return ranked.withColumn(out_col, F.when(F.col("_rn") <= k, "val").otherwise("train")).drop("_h", "_rn")


# F14 --------------------------------------------------------------------------

def turns_until_exit(df: DataFrame, group_col: str = "conv_id", order_col: str = "turn",
                     text_col: str = "text", word: str = "exit") -> DataFrame:
    """keep non-empty turns before the first ``exit`` turn of each group.

    The first exit per group is an aggregate (partial aggregation, so a hot
    group is combined map side), joined back on the group key.
    """
    t = F.col(text_col)
    exits = (df.where(F.lower(t) == F.lit(word.lower()))
               .groupBy(group_col).agg(F.min(order_col).alias("_exit_at")))
    out = df.join(exits, group_col, "left")
    keep = (F.col("_exit_at").isNull() | (F.col(order_col) < F.col("_exit_at"))) & ~is_blank(text_col)
    return out.where(keep).drop("_exit_at")
