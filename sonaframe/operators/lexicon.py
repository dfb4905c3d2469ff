"""Layered pronunciation lexicon and word lookup.

Layers: a base dictionary (a later line of the same word wins), a second
dictionary that only adds missing words (its first line wins), and a hot
list that overrides both (its later line wins).  A few words are deleted
from the merged lexicon.  The distinct words of a corpus are joined
with the merged lexicon, and once more for the stem of a possessive; the
result is then joined to the words' occurrences.  Spark picks each join by
the tables' sizes.  ``lookup_sentences`` leaves the words in their texts and
replaces them there (``joins.lookup_arrays``).  Short unknown words are spelled from a map of the
lexicon's single letters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import lookup_arrays
from .udf import computed_once

# Words removed from the merged lexicon.
DELETED_WORDS = ("ae", "ai", "ar", "ios", "hud", "os")
# Phone classes that decide the possessive ending.
UNVOICED_END = ("P", "T", "K", "F", "TH", "HH")
SIBILANT_END = ("S", "Z", "SH", "ZH", "CH", "JH")


def build_lexicon(base: DataFrame, extra: DataFrame | None = None, hot: DataFrame | None = None,
                  deleted: Sequence[str] = DELETED_WORDS) -> DataFrame:
    """Merge layers of ``word, phones array<string>, line_no`` into ``word, phones``."""
    # hot list, base, extra: the first layer that has a word gives its phones
    best = None
    for rank, (layer, pick) in enumerate(((hot, F.max_by), (base, F.max_by), (extra, F.min_by))):
        if layer is None:
            continue
        words = layer.select(F.lower("word").alias("word"), "phones", "line_no").where(~F.col("word").isin(*deleted))
        one = words.groupBy("word").agg(pick("phones", "line_no").alias("phones")).withColumn("_rank", F.lit(rank))
        best = one if best is None else best.unionByName(one)
    return best.groupBy("word").agg(F.min_by("phones", "_rank").alias("phones"))


def _letter_map(lexicon: DataFrame) -> Column:
    """Single letters of the lexicon as one map (an alphabet), for every row."""
    return lexicon.where(F.length("word") == 1).select(F.map_from_entries(F.collect_list(F.struct("word", "phones")))).scalar()


def spell(word: Column, letters: Column) -> Column:
    """Phones of each letter; ``a`` reads ``EY1``; an unknown letter makes the result null."""
    chars = F.split(word, "", -1)
    per = F.transform(chars, lambda ch: F.when(ch == "a", F.array(F.lit("EY1"))).otherwise(F.try_element_at(letters, ch)))
    return F.when(F.exists(per, lambda x: x.isNull()), F.lit(None)).otherwise(F.flatten(per))


def possessive_end(stem_phones: Column) -> Column:
    last = F.element_at(stem_phones, -1)
    suffix = (F.when(last.isin(*UNVOICED_END), F.array(F.lit("S")))
               .when(last.isin(*SIBILANT_END), F.array(F.lit("AH0"), F.lit("Z")))
               .otherwise(F.array(F.lit("Z"))))
    return F.when(F.size(stem_phones) > 0, F.concat(stem_phones, suffix))


def lookup_words(tokens: DataFrame, lexicon: DataFrame, names: DataFrame | None = None,
                 word_col: str = "word") -> DataFrame:
    """J6 + T18: adds ``phones`` and ``source``.

    Order: no letter a-z → the token itself ('literal'); one letter → ``A``
    is ``EY1``, else the lexicon ('letter'); in the lexicon ('lexicon');
    Title-case and in the names ('name'); up to 3 letters → spelled
    ('spelled'); ``stem's`` → the stem's phones plus S / AH0 Z / Z
    ('possessive'); anything else 'oov' with null phones.
    """
    # a corpus has far fewer words than tokens: look up each spelling once
    found = _lookup_spellings(tokens.select(F.col(word_col).alias("_o")).distinct(), lexicon, names)
    return tokens.join(found, F.col(word_col).eqNullSafe(F.col("_o")), "left").drop("_o")


def _lookup_spellings(spellings: DataFrame, lexicon: DataFrame, names: DataFrame | None) -> DataFrame:
    """``phones`` and ``source`` of each spelling ``_o``."""
    lexicon = lexicon.select("word", "phones")
    o = F.col("_o")
    t = spellings.withColumn("_w", F.lower("_o"))
    t = t.withColumn("_stem", F.when(F.col("_w").rlike("^[a-z]+'s\\z"),
                                     F.expr("substring(_w, 1, length(_w) - 2)")))
    t = t.join(lexicon.select(F.col("word").alias("_w"), F.col("phones").alias("_lex")), "_w", "left")
    t = t.join(lexicon.select(F.col("word").alias("_stem"), F.col("phones").alias("_slex")), "_stem", "left")
    if names is not None:
        t = t.join(names.select(F.lower("word").alias("_w"), F.col("phones").alias("_name")), "_w", "left")
    else:
        t = t.withColumn("_name", F.lit(None).cast("array<string>"))
    # a scalar subquery cannot sit inside a lambda
    t = t.withColumn("_letters", _letter_map(lexicon))
    letters = F.col("_letters")
    w = F.col("_w")
    title = o.rlike(r"^\p{Lu}\p{Ll}*\z")
    stem = F.col("_stem")
    stem_phones = (F.when((F.length(stem) > 1) & F.col("_slex").isNotNull(), F.col("_slex"))
                    .when(F.length(stem) <= 3, spell(stem, letters)))
    phones = (F.when(~w.rlike("[a-z]"), F.array(o))
               .when(F.length(w) == 1, F.when(o == "A", F.array(F.lit("EY1"))).otherwise(F.try_element_at(letters, w)))
               .when(F.col("_lex").isNotNull(), F.col("_lex"))
               .when(title & F.col("_name").isNotNull(), F.col("_name"))
               .when(F.length(w) <= 3, spell(w, letters))
               .when(stem.isNotNull(), possessive_end(stem_phones)))
    source = (F.when(~w.rlike("[a-z]"), "literal")
               .when(F.length(w) == 1, "letter")
               .when(F.col("_lex").isNotNull(), "lexicon")
               .when(title & F.col("_name").isNotNull(), "name")
               .when(F.length(w) <= 3, "spelled")
               .when(stem.isNotNull(), "possessive"))
    out = t.withColumn("phones", phones).withColumn(
        "source", F.when(F.col("phones").isNull(), F.lit("oov")).otherwise(source))
    return out.select("_o", "phones", "source")


def sentence_phones(looked: DataFrame, key_cols: Sequence[str], pos_col: str = "pos") -> DataFrame:
    """Per text: phones of its words in order with a ``' '`` between words, and counts."""
    g = looked.groupBy(*key_cols).agg(
        F.sort_array(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col("phones").alias("ph")))).alias("_w"),
        F.count(F.lit(1)).alias("n_words"),
        F.count_if(F.col("phones").isNull()).alias("n_oov"))
    parts = F.transform("_w", lambda s: F.coalesce(s["ph"], F.array().cast("array<string>")))
    joined = F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.array(F.lit(" ")), p))))
    return g.select(*key_cols, "n_words", "n_oov", joined.alias("phones"))


def lookup_sentences(texts: DataFrame, lexicon: DataFrame, names: DataFrame | None, key_cols: Sequence[str],
                     words_col: str = "words") -> DataFrame:
    """``lookup_words`` and ``sentence_phones`` for texts that hold their words as an array; phones joined by blanks.

    Each spelling of the corpus is looked up once; its phones then replace it
    inside the arrays, so tokens are neither shuffled to their word nor back
    to their text.  Texts without words give no row.  Rows of one key are one
    text, as in ``sentence_phones``: keys are counted, and only those that
    repeat are grouped.
    """
    keys = texts.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_m"))
    most = keys.agg(F.max("_m")).first()[0] or 0
    texts = computed_once(texts.select(*key_cols, words_col), words_col).where(F.size(words_col) > 0)
    ensure_checkpoint_dir(texts.sparkSession)
    spelled = _lookup_spellings(texts.select(F.explode(words_col).alias("_o")).distinct(), lexicon, names)
    spelled = spelled.where(F.col("phones").isNotNull()).select("_o", "phones").checkpoint()
    # what a word adds behind the words before it: a blank, and its phones if there are any
    added = spelled.select("_o", F.when(F.size("phones") == 0, " ").otherwise(
        F.concat(F.lit("  "), F.array_join("phones", " "))).alias("_added"))

    def joined(rows: DataFrame) -> DataFrame:
        rows = lookup_arrays(rows, words_col, added, "_o", "_added", "_ph")
        parts = F.transform("_ph", lambda a, i: F.when(i == 0, F.when(a != " ", F.substr(a, F.lit(3)))).otherwise(F.coalesce(a, F.lit(" "))))
        return rows.select(*key_cols, F.size("_ph").cast("long").alias("n_words"),
                           F.size(F.filter("_ph", lambda a: a.isNull())).cast("long").alias("n_oov"), F.array_join(parts, " ").alias("phones"))

    if most <= 1:
        return joined(texts)
    twice = keys.where("_m > 1").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key_cols)])
    same = F.lit(True)
    for i, c in enumerate(key_cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    tokens = lookup_arrays(texts.join(twice, same, "left_semi"), words_col, spelled, "_o", "phones", "_ph")
    grouped = sentence_phones(tokens.select(*key_cols, F.posexplode("_ph").alias("pos", "phones")), key_cols)
    return joined(texts.join(twice, same, "left_anti")).unionByName(grouped.withColumn("phones", F.array_join("phones", " ")))
