"""Row predicates and small column cleaners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that ``str.isspace`` counts as white space, as ``str.split`` and ``str.strip`` do.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# The punctuation set whose all-member segments are dropped.
PUNCT_SET = "!?…,.- "
PUNCT_ONLY_RE = r"^[!?…,.\- ]*\z"


def c_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_letter_or_digit(c: Column | str) -> Column:
    """False for a text with no letter or digit (punctuation only)."""
    return c_(c).rlike(r"[\p{L}\p{N}]")


def only_punct_set(c: Column | str, pattern: str = PUNCT_ONLY_RE) -> Column:
    """True when every character is in the punctuation set (or empty)."""
    return c_(c).rlike(pattern)


def is_blank(c: Column | str) -> Column:
    """Null or the empty string."""
    x = c_(c)
    return x.isNull() | (x == "")


def is_empty(*cols: Column | str) -> Column:
    """every item is null or ``''``."""
    out = F.lit(True)
    for c in cols:
        out = out & is_blank(c)
    return out


def is_full(*cols: Column | str) -> Column:
    """no item is null or ``''``."""
    out = F.lit(True)
    for c in cols:
        out = out & ~is_blank(c)
    return out


def _strip_char(c: Column, ch: str) -> Column:
    import re
    e = re.escape(ch) if ch != "\n" else r"\n"
    return F.regexp_replace(c, f"^{e}+|{e}+\\z", "")


def clean_path(c: Column | str) -> Column:
    """strip space, quote, newline, quote, space, U+202A at both ends, in that order."""
    x = c_(c)
    for ch in (" ", '"', "\n", '"', " ", "‪"):
        x = _strip_char(x, ch)
    return x


def basename(c: Column | str) -> Column:
    """Last path component (text after the last ``/``)."""
    return F.element_at(F.split(c_(c), "/", -1), -1)


def argmax_index(c: Column | str) -> Column:
    """0-based index of the largest score, first one on ties."""
    arr = c_(c)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("long")


def argmax_label(c: Column | str, names: Sequence[str] = ("Sad", "Happy")) -> Column:
    """class 0 → first name, any other class → second name."""
    return F.when(argmax_index(c) == 0, F.lit(names[0])).otherwise(F.lit(names[1]))
