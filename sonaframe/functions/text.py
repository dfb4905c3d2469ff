"""Text column functions.

Every function maps Columns to a Column built from Spark SQL expressions
(regexp, translate, higher-order array functions), so they run on the JVM
(higher-order functions interpreted, the rest in whole-stage codegen); none
collects or explodes.  Functions returning several
pieces return ``array<string>``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import BLANKS as WS
from .predicates import c_

# Sentence split marks.
SPLITS = "，。？！,.?!~:：—…"
# Marks that collapse when repeated (T1) and drop-if-only set.
PUNCT7 = "!?…,.- "
# Marks of the punctuation cutter (T7) and the custom cutter's allowed set.
CUT_PUNDS = ",.;?!、，。？！;：…"
CUSTOM_ALLOWED = ",.;?!、，。？！；：…"
# Symbol set kept by the Chinese cleaner.
ZH_KEEP_PUNCT = "!?…,."
# One-to-one replacements of the Chinese cleaner (after "..." → "…").
ZH_FROM = "：；，。！？\n·、$/—~～"
ZH_TO = ",,,.!?.,,.,-……"
# Specials removed by the sentence splitter and, with "-" and "=", after post-replace.
ZH_SPECIALS_RE = r"[——《》【】<>{}()（）#&@“”^_|\\]"
ZH_SPECIALS_POST_RE = r"[-——《》【】<=>{}()（）#&@“”^_|\\]"
# Post-replace symbols (in order).
ZH_SYMBOL_WORDS = (
    ("/", "每"), ("①", "一"), ("②", "二"), ("③", "三"), ("④", "四"), ("⑤", "五"),
    ("⑥", "六"), ("⑦", "七"), ("⑧", "八"), ("⑨", "九"), ("⑩", "十"),
    ("α", "阿尔法"), ("β", "贝塔"), ("γ", "伽玛"), ("Γ", "伽玛"), ("δ", "德尔塔"), ("Δ", "德尔塔"),
    ("ε", "艾普西龙"), ("ζ", "捷塔"), ("η", "依塔"), ("θ", "西塔"), ("Θ", "西塔"), ("ι", "艾欧塔"),
    ("κ", "喀帕"), ("λ", "拉姆达"), ("Λ", "拉姆达"), ("μ", "缪"), ("ν", "拗"), ("ξ", "克西"),
    ("Ξ", "克西"), ("ο", "欧米克伦"), ("π", "派"), ("Π", "派"), ("ρ", "肉"), ("ς", "西格玛"),
    ("Σ", "西格玛"), ("σ", "西格玛"), ("τ", "套"), ("υ", "宇普西龙"), ("φ", "服艾"), ("Φ", "服艾"),
    ("χ", "器"), ("ψ", "普赛"), ("Ψ", "普赛"), ("ω", "欧米伽"), ("Ω", "欧米伽"),
)
# Unit words, replaced in this order ("m" before "mm", so "mm" → 米米).
MEASURE_WORDS = (
    ("cm2", "平方厘米"), ("cm²", "平方厘米"), ("cm3", "立方厘米"), ("cm³", "立方厘米"),
    ("cm", "厘米"), ("db", "分贝"), ("ds", "毫秒"), ("kg", "千克"), ("km", "千米"),
    ("m2", "平方米"), ("m²", "平方米"), ("m³", "立方米"), ("m3", "立方米"), ("ml", "毫升"),
    ("m", "米"), ("mm", "毫米"), ("s", "秒"),
)
# Characters that count as words for the Japanese mark splitter.
JA_WORD_CHARS = ("A-Za-z\\d々぀-ヿ一-鿿１-９"
                 "Ａ-Ｚａ-ｚｦ-ﾝ")
# Spacing punctuation of the phonemizer.
SPACING_PUNCT = ".;:,!?—…«»"


def _cls(chars: str) -> str:
    """A regex character class holding exactly ``chars``."""
    return "[" + "".join("\\" + ch if ch in "\\]^-[" else ch for ch in chars) + "]"


def _ncls(chars: str) -> str:
    return "[^" + _cls(chars)[1:]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element ``transform``),
    so a costly array is not recomputed inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


# rule-built tables --------------------------------------------------------------

def _fullwidth_tables() -> tuple[str, str]:
    """Full-width ASCII letters and digits (code point + 65248) and their half-width forms."""
    import string
    half = string.ascii_letters + string.digits
    return "".join(chr(ord(c) + 65248) for c in half), half


FULLWIDTH_FROM, FULLWIDTH_TO = _fullwidth_tables()


def _accent_tables() -> tuple[str, str]:
    """Latin letters whose NFD form is an ASCII letter plus combining marks."""
    src, dst = [], []
    for cp in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        ch = chr(cp)
        d = unicodedata.normalize("NFD", ch)
        base = "".join(x for x in d if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != ch and base.isascii() and base.isalpha():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENT_FROM, ACCENT_TO = _accent_tables()


# T1 / T2 / T22 ---------------------------------------------------------------------

def collapse_punct(c: Column | str) -> Column:
    """A run of two or more of ``! ? … , . - space`` becomes its first mark."""
    k = _cls(PUNCT7)
    return F.regexp_replace(c_(c), f"({k}){k}+", "$1")


def strip_newlines(c: Column | str) -> Column:
    """Python ``strip("\\n")`` (a ``btrim``, no regex)."""
    return F.btrim(c_(c), F.lit("\n"))


def ends_with_any(c: Column, chars: str) -> Column:
    """Last character is one of ``chars`` (constant time, no regex scan)."""
    return F.substring(c, -1, 1).isin(*list(chars)) & (F.length(c) > 0)


def starts_with_any(c: Column, chars: str) -> Column:
    return F.substring(c, 1, 1).isin(*list(chars)) & (F.length(c) > 0)


def first_clause(c: Column | str) -> Column:
    """Text before the first split mark, whitespace-stripped."""
    return F.btrim(F.regexp_extract(c_(c), f"^({_ncls(SPLITS)}*)", 1), F.lit(WS))


def ensure_final_mark(c: Column | str, lang: Column | str | None = None) -> Column:
    """Append '.' (English) or '。' when the last character is not a split mark."""
    x = c_(c)
    mark = F.lit(".") if lang is None else F.when(c_(lang) == "en", F.lit(".")).otherwise(F.lit("。"))
    ends = ends_with_any(x, SPLITS)
    return F.when(ends | (F.length(x) == 0), x).otherwise(F.concat(x, mark))


def ensure_leading_mark(c: Column | str, lang: Column | str | None = None) -> Column:
    """Prefix a mark when the text starts with no mark and its first clause is under 4 characters."""
    x = c_(c)
    mark = F.lit(".") if lang is None else F.when(c_(lang) == "en", F.lit(".")).otherwise(F.lit("。"))
    starts = starts_with_any(x, SPLITS)
    need = ~starts & (F.length(first_clause(x)) < 4) & (F.length(x) > 0)
    return F.when(need, F.concat(mark, x)).otherwise(x)


def prepare_target(c: Column | str, lang: Column | str | None = None) -> Column:
    """T2 as applied to target text: strip newlines, collapse marks, maybe prefix."""
    return ensure_leading_mark(collapse_punct(strip_newlines(c)), lang)


# T3-T9 ------------------------------------------------------------------------------

def split_sentences(c: Column | str) -> Column:
    """T3: '……'→'。', '——'→'，', ensure a final mark, cut after every split mark."""
    x = F.replace(F.replace(c_(c), F.lit("……"), F.lit("。")), F.lit("——"), F.lit("，"))
    x = F.when(ends_with_any(x, SPLITS) | (F.length(x) == 0), x).otherwise(F.concat(x, F.lit("。")))
    # the text now ends with a mark: split after every mark (lookbehind) and
    # drop the empty piece after the last one; linear, no backtracking
    return F.filter(F.split(x, f"(?<={_cls(SPLITS)})", -1), lambda p: p != "")


def not_punct_only(arr: Column, chars: str = PUNCT7) -> Column:
    """Drop array items made only of ``chars`` (an empty item too)."""
    return F.filter(arr, lambda s: ~s.rlike(f"^{_cls(chars)}*\\z"))


def cut_four(c: Column | str) -> Column:
    """T4: groups of four sentences, the last group taking the rest; one group → the raw text."""
    def body(raw):
        def groups_of(s):
            n = F.size(s)
            m = F.ceil(n / 4).cast("int")
            groups = F.transform(
                F.sequence(F.lit(0), m - 2),
                lambda g: F.array_join(F.slice(s, g * 4 + 1,
                                               F.when(g == m - 2, n - g * 4).otherwise(F.lit(4))), ""))
            return F.when(m > 1, groups).otherwise(F.array(raw))
        return not_punct_only(let(split_sentences(raw), groups_of))

    return let(strip_newlines(c), body)


#: Pieces that the inner fold takes at a time.
_FOLD = 512


def _piece_ends(sizes: Column, full) -> Column:
    """Fold over the sizes of pieces: ``ends`` (the places, from 0, at which the sum since the last end is ``full``)
    and ``rest`` (the sum after the last end).

    ``aggregate`` copies its state at every step.  So an inner fold takes
    ``_FOLD`` sizes and holds their ends only, and the outer one, a step for
    each inner fold, gathers them: no step of the long way copies all ends.
    """
    none = F.array().cast("array<int>")

    def one(acc, n):
        total = acc["rest"] + n
        hit = full(total)
        return F.struct(F.when(hit, F.concat(acc["ends"], F.array(acc["i"]))).otherwise(acc["ends"]).alias("ends"),
                        F.when(hit, F.lit(0)).otherwise(total).alias("rest"), (acc["i"] + 1).alias("i"))

    def many(sizes):
        def block(acc, b):
            start = b * _FOLD
            part = F.aggregate(F.slice(sizes, start + 1, _FOLD), F.struct(none.alias("ends"), acc["rest"].alias("rest"), start.alias("i")), one)
            return let(part, lambda x: F.struct(F.concat(acc["ends"], x["ends"]).alias("ends"), x["rest"].alias("rest")))

        blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(sizes) - 1) / _FOLD), F.lit(0)).cast("int"))
        return F.aggregate(blocks, F.struct(none.alias("ends"), F.lit(0).alias("rest")), block)

    return let(sizes, many)


def _pieces(s: Column, ends: Column) -> Column:
    """Array items joined up to each end."""
    def cut(e, i):
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(ends, i - 1))
        return F.array_join(F.slice(s, before + 2, e - before), "")

    return F.transform(ends, cut)


def cut_fifty(c: Column | str, limit: int = 50) -> Column:
    """T5: add sentences until the piece passes ``limit`` characters; a short
    last piece joins the one before.  One sentence or none → the raw text."""
    raw = strip_newlines(c)
    s = split_sentences(raw)

    def body(x):
        k, n, ends = F.size(x["f"]["ends"]), F.size(x["s"]), x["f"]["ends"]
        last = F.array(n - 1)
        joined = F.when(F.get(ends, k - 1) == n - 1, ends) \
            .when((k > 0) & (x["f"]["rest"] < limit), F.concat(F.slice(ends, 1, F.greatest(k - 1, F.lit(0))), last)) \
            .otherwise(F.concat(ends, last))
        pieces = let(F.struct(x["s"].alias("s"), joined.alias("e")), lambda y: _pieces(y["s"], y["e"]))
        return F.when(n < 2, F.array(x["raw"])).otherwise(not_punct_only(pieces))

    def folded(pair):
        f = _piece_ends(F.transform(pair["s"], F.length), lambda total: total > limit)
        return let(F.struct(pair["raw"].alias("raw"), pair["s"].alias("s"), f.alias("f")), body)

    return let(F.struct(raw.alias("raw"), s.alias("s")), folded)


def cut_on_stop(c: Column | str, mark: str = "。") -> Column:
    """Strip the mark at both ends, split on it (the mark is lost), drop punctuation-only pieces."""
    e = re.escape(mark)
    x = F.regexp_replace(strip_newlines(c), f"^{e}+|{e}+\\z", "")
    return not_punct_only(F.split(x, e, -1))


PROTECT = ""


def cut_punct(c: Column | str) -> Column:
    """Cut after each of ``, . ; ? ! 、 ， 。 ？ ！ ： …`` except a dot between
    two digits; the tail is kept; pieces made only of those marks are dropped."""
    x = F.regexp_replace(strip_newlines(c), r"(?<=\d)\.(?=\d)", PROTECT)
    p = _cls(CUT_PUNDS)
    # split after each mark (linear); the empty tail of a mark-ended text is
    # removed by the marks-only filter below, as in the reference
    pieces = F.split(x, f"(?<={p})", -1)
    pieces = F.transform(pieces, lambda s: F.replace(s, F.lit(PROTECT), F.lit(".")))
    return F.filter(pieces, lambda s: ~s.rlike(f"^{p}*\\z"))


def cut_custom(c: Column | str, punc: str) -> Column:
    """Cut after the caller's marks (restricted to the allowed set), keep
    the tail, one piece per line, blank lines squeezed.  Returns a string."""
    marks = "".join(ch for ch in dict.fromkeys(punc) if ch in CUSTOM_ALLOWED)
    x = c_(c)
    if marks:
        # a split after each mark (lookbehind) is linear and yields the
        # mark-ended pieces followed by the tail, as the reference pairs them
        x = F.array_join(F.split(strip_newlines(x), f"(?<={_cls(marks)})", -1), "\n")
    return F.regexp_replace(x, "\n{2,}", "\n")


def merge_short(arr: Column | str, threshold: int = 5) -> Column:
    """Join pieces until the length reaches ``threshold``; a leftover joins
    the last piece; fewer than two pieces are returned unchanged."""
    def body(x):
        k, n, ends = F.size(x["f"]["ends"]), F.size(x["v"]), x["f"]["ends"]
        last = F.array(n - 1)
        joined = F.when(x["f"]["rest"] == 0, ends).when(k == 0, last).otherwise(F.concat(F.slice(ends, 1, F.greatest(k - 1, F.lit(0))), last))
        pieces = let(F.struct(x["v"].alias("v"), joined.alias("e")), lambda y: _pieces(y["v"], y["e"]))
        return F.when(n < 2, x["v"]).otherwise(pieces)

    def folded(v):
        f = _piece_ends(F.transform(v, F.length), lambda total: total >= threshold)
        return let(F.struct(v.alias("v"), f.alias("f")), body)

    return let(c_(arr), folded)


# T10-T14 -----------------------------------------------------------------------------

def map_chars_zh(c: Column | str) -> Column:
    """The Chinese cleaner's punctuation table, then keep only CJK and ``! ? … , .``.

    ``%``→``-`` and ``￥``→``,`` are applied first, as the table builder does.
    """
    x = F.replace(F.replace(c_(c), F.lit("%"), F.lit("-")), F.lit("￥"), F.lit(","))
    x = F.replace(F.replace(x, F.lit("嗯"), F.lit("恩")), F.lit("呣"), F.lit("母"))
    x = F.replace(x, F.lit("..."), F.lit("…"))
    x = F.translate(x, ZH_FROM, ZH_TO)
    return F.regexp_replace(x, "[^一-龥" + re.escape(ZH_KEEP_PUNCT) + "]+", "")


# Mark replacements of the Japanese front end.
JA_MARKS = {"：": ",", "；": ",", "，": ",", "。": ".", "！": "!", "？": "?", "\n": ".", "·": ",", "、": ",", "...": "…"}


def map_marks_ja(tokens: Column | str, known_re: str) -> Column:
    """T10, Japanese: marks replaced one to one; a token that is then not of ``known_re`` (the symbol set) is ``UNK``."""
    marks = F.create_map(*[F.lit(x) for pair in JA_MARKS.items() for x in pair])
    mapped = F.transform(c_(tokens), lambda t: F.coalesce(F.try_element_at(marks, t), t))
    return F.transform(mapped, lambda t: F.when(t.rlike(known_re), t).otherwise(F.lit("UNK")))


def normalize_en(c: Column | str) -> Column:
    """English normalisation: marks to ``,`` and ``'``, accents stripped
    (explicit Latin table), only ``[ A-Za-z'.,?!-]`` kept, then i.e./e.g. spelled."""
    # one-to-one marks: translate (a hash lookup per character, no regex)
    x = F.translate(c_(c), ";:：，；\"’。！？", ",,,,,''.!?")
    x = F.translate(x, ACCENT_FROM, ACCENT_TO)
    x = F.regexp_replace(x, r"[^ A-Za-z'.,?!\-]++", "")
    x = F.regexp_replace(x, r"(?i)i\.e\.", "that is")
    return F.regexp_replace(x, r"(?i)e\.g\.", "for example")


def fold_width(c: Column | str) -> Column:
    """Full-width letters and digits to half-width (punctuation and the
    ideographic space stay, as in the reference)."""
    return F.translate(c_(c), FULLWIDTH_FROM, FULLWIDTH_TO)


def convert_script(c: Column | str, mapping: Sequence[tuple[str, str]], reverse: bool = False) -> Column:
    """One-to-one character conversion from a mapping; unknown characters stay."""
    pairs = [(b, a) for a, b in mapping] if reverse else list(mapping)
    seen, src, dst = set(), [], []
    for a, b in pairs:
        if len(a) == 1 and len(b) == 1 and a not in seen:
            seen.add(a)
            src.append(a)
            dst.append(b)
    return F.translate(c_(c), "".join(src), "".join(dst))


def ordered_replace(c: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """Plain substring replaces applied one after another, in rule order."""
    x = c_(c)
    for a, b in rules:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _class_chars(pattern: str) -> str:
    """The characters of a plain ``[...]`` class (escapes resolved)."""
    body = pattern[1:-1]
    out, i = [], 0
    while i < len(body):
        if body[i] == "\\" and i + 1 < len(body):
            out.append(body[i + 1])
            i += 2
        else:
            out.append(body[i])
            i += 1
    return "".join(dict.fromkeys(out))


def replace_symbols(c: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """Replace single characters by words in one pass: the text is cut into
    runs of ordinary characters and single rule characters, and only the
    latter are looked up.  Equal to the sequential replaces when no target
    contains a source character (true for the symbol table)."""
    src = "".join(dict.fromkeys(a for a, _ in rules))
    k = _cls(src)
    m = F.create_map(*[F.lit(x) for a, b in rules for x in (a, b)])

    def tokenized(v: Column) -> Column:
        parts = F.regexp_extract_all(v, F.lit(f"{k}|{_ncls(src)}+"), 0)
        return F.array_join(F.transform(parts, lambda t: F.coalesce(F.try_element_at(m, t), t)), "")

    # a translate deletion is a cheap test for "holds a rule character":
    # texts without one skip the tokenizer
    return let(c_(c), lambda v: F.when(F.length(F.translate(v, src, "")) != F.length(v), tokenized(v)).otherwise(v))


def strip_specials(c: Column | str, zh: bool = True) -> Column:
    """The sentence splitter's special-character removal (zh also drops
    spaces), then unit words, symbol words and the post pass (adds ``-``, ``=``).

    Removals are ``translate`` deletions (one hash lookup per character); the
    unit words keep their order (``m`` before ``mm``); the symbol words are
    one tokenising pass."""
    x = c_(c)
    if zh:
        x = F.translate(x, " " + _class_chars(ZH_SPECIALS_RE), "")
    x = ordered_replace(x, MEASURE_WORDS)
    x = replace_symbols(x, ZH_SYMBOL_WORDS)
    return F.translate(x, _class_chars(ZH_SPECIALS_POST_RE), "")


# T15 --------------------------------------------------------------------------------

# Quantifier words that follow a number.
COM_QUANTIFIERS = (
    "(封|艘|把|目|套|段|人|所|朵|匹|张|座|回|场|尾|条|个|首|阙|阵|网|炮|顶|丘|棵|只|支|袭|辆|挑|担|颗|壳|窠|曲|墙|群|腔|"
    "砣|座|客|贯|扎|捆|刀|令|打|手|罗|坡|山|岭|江|溪|钟|队|单|双|对|出|口|头|脚|板|跳|枝|件|贴|针|线|管|名|位|身|堂|课|本|"
    "页|家|户|层|丝|毫|厘|分|钱|两|斤|担|铢|石|钧|锱|忽|(千|毫|微)克|毫|厘|(公)分|分|寸|尺|丈|里|寻|常|铺|程|(千|分|厘|毫|微)米|"
    "米|撮|勺|合|升|斗|石|盘|碗|碟|叠|桶|笼|盆|盒|杯|钟|斛|锅|簋|篮|盘|桶|罐|瓶|壶|卮|盏|箩|箱|煲|啖|袋|钵|年|月|日|季|刻|时|周|"
    "天|秒|分|小时|旬|纪|岁|世|更|夜|春|夏|秋|冬|代|伏|辈|丸|泡|粒|颗|幢|堆|条|根|支|道|面|片|张|颗|块|元|(亿|千万|百万|万|千|百)|"
    "(亿|千万|百万|万|千|百|美|)元|(亿|千万|百万|万|千|百|十|)吨|(亿|千万|百万|万|千|百|)块|角|毛|分)")
_NUM = r"(-?)((\d+)(\.\d+)?)|(\.(\d+))"
_UNITS = "(%|°C|℃|度|摄氏度|cm2|cm²|cm3|cm³|cm|db|ds|kg|km|m2|m²|m³|m3|ml|m|mm|s)"
# Non-standard-word classes, in the normaliser's order.
NSW_PATTERNS = (
    ("date", r"(\d{4}|\d{2})年((0?[1-9]|1[0-2])月)?(((0?[1-9])|((1|2)[0-9])|30|31)([日号]))?"),
    ("date2", r"(\d{4})([- /.])(0[1-9]|1[012])\2(0[1-9]|[12][0-9]|3[01])"),
    ("time_range", r"([0-1]?[0-9]|2[0-3]):([0-5][0-9])(:([0-5][0-9]))?(~|-)([0-1]?[0-9]|2[0-3]):([0-5][0-9])(:([0-5][0-9]))?"),
    ("time", r"([0-1]?[0-9]|2[0-3]):([0-5][0-9])(:([0-5][0-9]))?"),
    ("to_range", f"({_NUM}){_UNITS}[~]({_NUM}){_UNITS}"),
    ("temperature", r"(-?)(\d+(\.\d+)?)(°C|℃|度|摄氏度)"),
    ("fraction", r"(-?)(\d+)/(\d+)"),
    ("percentage", r"(-?)(\d+(\.\d+)?)%"),
    ("mobile", r"(?<!\d)((\+?86 ?)?1([38]\d|5[0-35-9]|7[678]|9[89])\d{8})(?!\d)"),
    ("telephone", r"(?<!\d)((0(10|2[1-3]|[3-9]\d{2})-?)?[1-9]\d{6,7})(?!\d)"),
    ("national_number", r"(400)(-)?\d{3}(-)?\d{4}"),
    ("range", r"(?<![\d\+\-\×÷=])((-?)((\d+)(\.\d+)?))[-~]((-?)((\d+)(\.\d+)?))(?![\d\+\-\×÷=])"),
    ("arithmetic", r"((-?)((\d+)(\.\d+)?)|(\.(\d+)))([\+\-\×÷=])((-?)((\d+)(\.\d+)?)|(\.(\d+)))"),
    ("negative_integer", r"(-)(\d+)"),
    ("decimal", r"(-?)((\d+)(\.\d+))|(\.(\d+))"),
    ("quantity", r"(\d+)([多余几\+])?" + COM_QUANTIFIERS),
    ("digit_run", r"\d{3}\d*"),
    ("number", _NUM),
)
NSW_NEEDS_JAVA = ("date2", "mobile", "telephone", "range")


def nsw_counts(c: Column | str, classes: Sequence[str] | None = None) -> Column:
    """``map<class, count>`` of matches per class (classes overlap)."""
    x = c_(c)
    chosen = [(k, p) for k, p in NSW_PATTERNS if classes is None or k in classes]
    counts = F.create_map(*[v for k, p in chosen for v in (F.lit(k), F.regexp_count(x, F.lit(p)).cast("long"))])
    zeros = F.create_map(*[v for k, _ in chosen for v in (F.lit(k), F.lit(0).cast("long"))])
    # every class needs a digit: one scan for a digit spares the other patterns
    return F.when(x.rlike(r"\d"), counts).otherwise(zeros)


def nsw_first_match(c: Column | str) -> Column:
    """T15 first-match-wins: ``map<class, count>`` where each class only sees
    the text left after removing the earlier classes' matches (rule order)."""
    x0 = c_(c)
    x = x0
    parts = []
    for k, p in NSW_PATTERNS:
        parts += [F.lit(k), F.regexp_count(x, F.lit(p)).cast("long")]
        x = F.regexp_replace(x, p, " ")
    zeros = F.create_map(*[v for k, _ in NSW_PATTERNS for v in (F.lit(k), F.lit(0).cast("long"))])
    return F.when(x0.rlike(r"\d"), F.create_map(*parts)).otherwise(zeros)


# T16 / T17 / T19 / T20 ------------------------------------------------------------------

SCRIPT_RUN_RE = (r"(\p{IsHan}[\p{IsHan}\s\p{P}\d]*"
                 r"|[\p{IsHiragana}\p{IsKatakana}][\p{IsHiragana}\p{IsKatakana}\p{IsHan}\s\p{P}\d]*"
                 r"|\p{IsHangul}[\p{IsHangul}\s\p{P}\d]*"
                 r"|[\p{IsLatin}\d][\p{IsLatin}\s\p{P}\d]*)")


def script_runs(c: Column | str) -> Column:
    """Runs of one script as ``array<struct<text, lang>>`` (Han→zh, kana→ja, Hangul→ko, Latin→en)."""
    runs = F.regexp_extract_all(c_(c), F.lit(SCRIPT_RUN_RE), 0)
    return F.transform(runs, lambda r: F.struct(
        r.alias("text"),
        F.when(r.rlike(r"^\p{IsHan}"), "zh")
         .when(r.rlike(r"^[\p{IsHiragana}\p{IsKatakana}]"), "ja")
         .when(r.rlike(r"^\p{IsHangul}"), "ko").otherwise("en").alias("lang")))


def squeeze_spaces(c: Column) -> Column:
    return F.regexp_replace(c, " {2,}", " ")


def language_route(c: Column | str, mode: str) -> Column:
    """Segments routed by mode, as ``array<struct<text, lang>>``.

    auto: detected language, ko → zh; zh / ja: en stays en, everything else
    becomes the mode; en: only the English runs, joined by a space, as one
    segment; all_zh / all_ja: the whole text as one segment.  Double spaces
    are squeezed in the single-segment modes.
    """
    x = c_(c)
    if mode in ("all_zh", "all_ja"):
        return F.array(F.struct(squeeze_spaces(x).alias("text"), F.lit(mode[4:]).alias("lang")))
    runs = script_runs(x)
    if mode == "en":
        en = F.filter(runs, lambda r: r["lang"] == "en")
        joined = squeeze_spaces(F.array_join(F.transform(en, lambda r: r["text"]), " "))
        return F.array(F.struct(joined.alias("text"), F.lit("en").alias("lang")))
    if mode == "auto":
        return F.transform(runs, lambda r: F.struct(
            r["text"].alias("text"), F.when(r["lang"] == "ko", "zh").otherwise(r["lang"]).alias("lang")))
    if mode in ("zh", "ja"):
        return F.transform(runs, lambda r: F.struct(
            r["text"].alias("text"), F.when(r["lang"] == "en", "en").otherwise(F.lit(mode)).alias("lang")))
    raise ValueError(mode)


def mark_special(tokens: Column | str, marker: str) -> Column:
    """Every ``,`` token becomes the marker token (real commas too, as in the reference)."""
    return F.transform(c_(tokens), lambda t: F.when(t == ",", F.lit(marker)).otherwise(t))


def split_keep_marks(c: Column | str) -> Column:
    """Word runs and single marks in order; space marks dropped."""
    toks = F.regexp_extract_all(c_(c), F.lit(f"[{JA_WORD_CHARS}]+|[^{JA_WORD_CHARS}]"), 0)
    return F.filter(toks, lambda t: t != " ")


def normalize_spacing(c: Column | str) -> Column:
    """No blank before punctuation, one space after it before a letter, squeeze, trim."""
    p = _cls(SPACING_PUNCT)
    x = F.regexp_replace(c_(c), r"\p{Z}+(" + p + ")", "$1")
    x = F.regexp_replace(x, "(" + p + r")(\p{L})", "$1 $2")
    x = F.regexp_replace(x, r"\p{Z}+", " ")
    return F.btrim(x, F.lit(WS))


# T21 ---------------------------------------------------------------------------------

def whitespace_tokens(c: Column | str, limit: int | None = None) -> Column:
    """Words between blanks; with ``limit`` only the first ones (the rest of the text is not split)."""
    x = F.translate(c_(c), WS, " " * len(WS))
    if limit is None:
        return F.filter(F.split(x, " ", -1), lambda t: t != "")
    return F.filter(F.slice(F.split(F.btrim(x), " +", limit + 1), 1, limit), lambda t: t != "")


def truncate_pad(arr: Column | str, width: int = 512, pad: int | str = 0) -> Column:
    """Cut to ``width`` and pad on the right to exactly ``width``."""
    a = F.slice(c_(arr), 1, width)
    return F.concat(a, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(width) - F.size(a))))
