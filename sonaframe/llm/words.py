"""Words, word hashes and shingle hashes for tasks that work on whole texts."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

#: Runs of letters, digits and underscores, in lower case.
WORD = re.compile(r"\w+")
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


_BASE = 0xD1342543DE82EF95
#: Positions that are hashed at once.
_SPAN = 1 << 15


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(_SPAN, base, np.uint64))])


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
#: Latin letters, digits and the underscore in lower case; 32 for all else.
_LATIN = bytes(ord(chr(c).lower()) if chr(c).isalnum() or c == 95 else 32 for c in range(256))


@lru_cache(maxsize=1)
def _word_table() -> np.ndarray:
    """Whether each code point is of ``\\w``."""
    return np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)])


def _word_hash(points: np.ndarray) -> int:
    """The hash of one word of any length, from its code points."""
    h, scale = 0, 1
    for i in range(0, len(points), _SPAN):
        part = points[i: i + _SPAN].astype(np.uint64) + np.uint64(1)
        h = (h + int((part * _UP[: len(part)]).sum(dtype=np.uint64)) * scale) % (1 << 64)
        scale = scale * pow(_BASE, _SPAN, 1 << 64) % (1 << 64)
    return int(mixed(np.array([h], np.uint64))[0])


class WordHashes(dict):
    """64-bit hashes of words: polynomials of their code points, mixed.

    ``text`` hashes all words of a text in one go, without an object for each;
    ``of`` gives the same for words as strings, and remembers about ``most``.
    """

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most
        self.hashes = array("Q")

    def __missing__(self, word: str) -> int:
        self.hashes.append(_word_hash(np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)))
        at = self[word] = len(self.hashes) - 1
        return at

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) >= self.most:
            self.clear()
            self.hashes = array("Q")
        at = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return np.frombuffer(self.hashes, np.uint64)[at] if len(at) else np.zeros(0, np.uint64)

    def text(self, text: str | None) -> np.ndarray:
        """The hashes of ``words_of(text)``."""
        if not text:
            return np.zeros(0, np.uint64)
        try:
            points = np.frombuffer(text.encode("latin-1").translate(_LATIN), np.uint8)
            inside = points != 32
        except UnicodeEncodeError:
            points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            inside = _word_table()[points]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        start, end = edge[0::2], edge[1::2]
        out = np.zeros(len(start), np.uint64)
        i = 0
        while i < len(start):
            lo = int(start[i])
            j = int(np.searchsorted(end, lo + _SPAN, "right"))
            if j == i:  # one word that is longer than a span
                out[i] = _word_hash(points[lo: end[i]])
                i += 1
                continue
            hi = int(end[j - 1])
            v = (points[lo:hi].astype(np.uint64) + np.uint64(1)) * _UP[: hi - lo]
            v[~inside[lo:hi]] = 0
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)])
            out[i:j] = mixed((total[end[i:j] - lo] - total[start[i:j] - lo]) * _DOWN[start[i:j] - lo])
            i = j
        return out


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX2
    return h ^ (h >> np.uint64(33))


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """One hash for each run of ``k`` words; a text of fewer words is one shingle, an empty one none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = hashes[: n - k + 1].copy()
    for j in range(1, k):
        out *= _FOLD
        out += hashes[j: n - k + 1 + j]
    out += np.uint64(k)
    return mixed(out)
