"""Extension surface.

D1: per-language text front ends as column functions, chosen by a ``when``
chain (native when the user's functions are native).  D2: a batched Python
map with per-row failure capture (``mapInPandas``).  D3: per-item sequence
work (``groupBy().applyInPandas``).
"""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColFn = Callable[[Column], Column]


@dataclass(frozen=True)
class Frontend:
    """``normalize``: text -> text; ``tokenize``: normalised text -> phones.

    ``align``: normalised text -> for each of its characters the number of
    phones that it gave, in order; without it the language has no alignment.
    ``units``: both in one, the phones of each character; they are then found
    once for phones and alignment.
    """

    normalize: ColFn
    tokenize: ColFn
    align: ColFn | None = None
    units: ColFn | None = None


def unit_frontend(normalize: ColFn, units: ColFn) -> Frontend:
    """An aligned front end from ``units``: normalised text -> the phones of each character (array of arrays)."""
    return Frontend(normalize, lambda c: F.flatten(units(c)), lambda c: F.transform(units(c), lambda u: F.size(u)), units)


def characters(c: Column) -> Column:
    """The characters (code points) of a text; none for an empty one."""
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, "", -1))


def table_units(phones: Mapping[str, Sequence[str]]) -> ColFn:
    """Phones of each character by a table of up to an alphabet's size; a character outside it stands for itself."""
    def units(c: Column) -> Column:
        pairs = [x for ch, ph in phones.items() for x in (F.lit(ch), F.array(*[F.lit(p) for p in ph]).cast("array<string>"))]
        known = F.create_map(*pairs).cast("map<string,array<string>>")
        return F.transform(characters(c), lambda ch: F.coalesce(F.try_element_at(known, ch), F.array(ch)))

    return units


def computed_once(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the columns ``names`` computed where they stand.

    Spark moves a filter below the projection it reads and writes the
    projection's expressions out inside it, once for each mention; a chain of
    text functions is then run many times over on every row.  No filter
    moves below a generator, and this one gives one row for each row.
    """
    once = F.inline(F.array(F.struct(*names)))
    return df.select(*[c for c in df.columns if c not in names], once).select(*df.columns)


_FRONTENDS: dict[str, Frontend] = {}


def register_frontend(lang: str, normalize: ColFn, tokenize: ColFn, align: ColFn | None = None) -> None:
    """Register column functions for one language code."""
    _FRONTENDS[lang] = Frontend(normalize, tokenize, align)


def registered_languages() -> list[str]:
    return sorted(_FRONTENDS)


def apply_frontend(df: DataFrame, text_col: str = "text", lang_col: str = "lang",
                   fallback: str = "en", frontends: Mapping[str, Frontend] | None = None) -> DataFrame:
    """``norm_text``, ``phones`` and ``word2ph`` by language.

    ``word2ph`` is null where the language's front end has no alignment.

    ``frontends``: language code -> front end; without it the registered ones
    are used.

    An unregistered language is processed as ``fallback`` with the text
    replaced by a single space, as the reference does.
    """
    use = dict(_FRONTENDS if frontends is None else frontends)
    if fallback not in use:
        raise ValueError(f"fallback front end {fallback!r} is not registered")
    lang = F.col(lang_col)
    known = F.coalesce(lang.isin(*use), F.lit(False))
    text = F.when(known, F.col(text_col)).otherwise(F.lit(" "))
    eff_lang = F.when(known, lang).otherwise(F.lit(fallback))
    norm = None
    for code, fe in use.items():
        branch = fe.normalize(text)
        norm = F.when(eff_lang == code, branch) if norm is None else norm.when(eff_lang == code, branch)
    out = computed_once(df.withColumn("front_lang", eff_lang).withColumn("norm_text", norm), "norm_text")
    here = F.col("front_lang")
    units, phones, word2ph = F.lit(None).cast("array<array<string>>"), F.lit(None), F.lit(None).cast("array<int>")
    for code, fe in use.items():
        if fe.units is not None:
            units = F.when(here == code, fe.units(F.col("norm_text"))).otherwise(units)
    out = computed_once(out.withColumn("_units", units), "_units")
    for code, fe in use.items():
        tokens, counts = (fe.tokenize(F.col("norm_text")), fe.align and fe.align(F.col("norm_text"))) if fe.units is None else \
            (F.flatten("_units"), F.transform("_units", lambda u: F.size(u)))
        phones = F.when(here == code, tokens).otherwise(phones)
        if counts is not None:
            word2ph = F.when(here == code, counts.cast("array<int>")).otherwise(word2ph)
    return computed_once(out.withColumn("phones", phones).withColumn("word2ph", word2ph), "phones", "word2ph").drop("_units")


def check_word2ph(df: DataFrame, phones_col: str = "phones", word2ph_col: str = "word2ph",
                  text_col: str | None = None) -> DataFrame:
    """D1 invariants where ``word2ph`` is present: its sum is the phone count ('word2ph_sum'),
    and with ``text_col`` it has one entry for each character ('word2ph_length')."""
    total = F.aggregate(F.col(word2ph_col), F.lit(0).cast("long"), lambda a, x: a + x)
    there = F.col(word2ph_col).isNotNull()
    # a null entry makes the sum null: that is no sum either
    reason = F.when(there & F.coalesce(total != F.size(phones_col), F.lit(True)), F.lit("word2ph_sum"))
    if text_col is not None:
        reason = reason.when(there & (F.size(word2ph_col) != F.length(text_col)), F.lit("word2ph_length"))
    if "reject_reason" in df.columns:
        return df.withColumn("reject_reason", F.coalesce(F.col("reject_reason"), reason))
    return df.withColumn("reject_reason", reason)


# D2 ---------------------------------------------------------------------------

def map_batches(df: DataFrame, fn: Callable[[dict], dict], schema: T.StructType,
                key_col: str, batch_fn: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Apply ``fn`` to every row (as a dict) inside Arrow batches.

    ``batch_fn`` does the same for a whole batch at once (one output row for
    each row, in order); rows go one by one through ``fn`` only in batches
    where it raises.

    A row whose call raises is kept with ``error`` set (the output fields
    null), so the caller can route it to a reject table; the others carry
    ``fn``'s fields.  Output: ``key_col``, the schema's fields, ``error``.
    """
    key_type = df.schema[key_col].dataType
    out_schema = T.StructType([T.StructField(key_col, key_type)] + list(schema.fields)
                              + [T.StructField("error", T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if batch_fn is not None:
                try:
                    whole = batch_fn(pdf)
                    yield pd.DataFrame({key_col: pdf[key_col].to_numpy(), **{k: whole[k].to_numpy() for k in names}, "error": None})
                    continue
                except Exception:  # noqa: BLE001 - find the failing rows one by one
                    pass
            recs = []
            for row in pdf.to_dict(orient="records"):
                try:
                    res = fn(row)
                    recs.append({key_col: row[key_col], **{k: res.get(k) for k in names}, "error": None})
                except Exception as e:  # noqa: BLE001 - captured per row by design
                    msg = json.dumps({"type": type(e).__name__, "msg": str(e), "where": traceback.format_exc(limit=1)})
                    recs.append({key_col: row[key_col], **{k: None for k in names}, "error": msg})
            yield pd.DataFrame(recs, columns=[key_col, *names, "error"])

    return df.mapInPandas(run, out_schema)


# D3 ---------------------------------------------------------------------------

def apply_per_signal(df: DataFrame, key: str | list[str], fn: Callable[[pd.DataFrame], pd.DataFrame],
                     schema: str | T.StructType) -> DataFrame:
    """D3: ``fn`` over each item's rows (one item, or one bounded chunk of an
    item, per group)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).applyInPandas(fn, schema)
