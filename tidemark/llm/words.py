"""Words and character classes of whole blocks of texts as numpy arrays.

A word is a maximal run of letters, digits and combining marks (Unicode categories L, N, M) of
the text in lower case. Words are known by a 64-bit hash: a polynomial over their code points,
taken from prefix sums modulo 2^64 and mixed, so a block costs a few array operations
and no loop over words.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
_BREAK = "\n"


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """For every code point: is it part of a word?"""
    return np.fromiter(
        (unicodedata.category(chr(c))[0] in "LNM" for c in range(sys.maxunicode + 1)),
        dtype=bool, count=sys.maxunicode + 1,
    )


class _Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self):
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            step = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(BASE, step, 1 << 64))])
            self.down = np.concatenate(
                [self.down, self.down * np.uint64(pow(INVERSE, step, 1 << 64))]
            )
        return self.up, self.down


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line break, and where each text starts.

    The second array has one more entry than there are texts: the end.
    """
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)])
    joined = _BREAK.join(texts) + _BREAK if texts else ""
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    return edges[0::2], edges[1::2]


def span_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers.to(len(cps) + 1)
    sums = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(cps * up[: len(cps)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def pieces_of(text: str, limit: int = 1 << 20) -> list[str]:
    """The text in parts of at most `limit` code points, cut at blanks.

    Words longer than `limit` are cut as well; equal texts are always cut in the same places.
    """
    if len(text) <= limit:
        return [text]
    parts, at = [], 0
    while len(text) - at > limit:
        blank = text.rfind(" ", at, at + limit)
        end = blank if blank > at else at + limit
        parts.append(text[at:end])
        at = end
    return [*parts, text[at:]]


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and each text's first word (plus the end)."""
    if len(texts) == 1 and len(parts := pieces_of(texts[0])) > 1:
        found = np.concatenate([hashed_words([part])[0] for part in parts])
        return found, np.array([0, len(found)])
    cps, bounds = codepoints([t.lower() for t in texts])
    starts, ends = spans_of(word_table()[cps])
    return span_hashes(cps, starts, ends), np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `width` words; of the whole if it is shorter."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * np.uint64(BASE) + words[i: i + n]
    return np.unique(mix(total + np.uint64(width)))
