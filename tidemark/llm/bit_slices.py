"""Bit-sliced Bloom signatures of blocks of documents.

A document sets, for each of its terms and each level of TERM_LEVELS that the term's count in it
reaches, HASHES bits of its column; a row of bits over the documents of a block is a slice. The
slices of a term, taken together with AND, mark all documents of the block that hold it that often,
and some that do not: never too few.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .words import mix

# Counts at which a level begins. Within a level a term counts as often as the next level allows.
TERM_LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128)
HASHES, BITS_A_TERM = 6, 16
# A block has at most so many documents and bits.
BLOCK_DOCS, BLOCK_BITS = 2048, 1 << 24
# Fixed values of the term pattern: ASCII letters and digits and everything that is not ASCII.
_TERM_BYTES = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


@dataclass(frozen=True)
class Terms:
    """Distinct terms of texts: text by text, with their counts."""

    hashes: np.ndarray
    counts: np.ndarray
    bounds: np.ndarray  # where each text's terms begin, and the end
    sizes: np.ndarray  # number of terms of each text, repeats included


def term_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, starts and ends of their terms, and each text's first term."""
    joined = b"\n".join(texts) + b"\n"
    data = _LOWER[np.frombuffer(joined, np.uint8)]
    inside = _TERM_BYTES[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return data, starts, ends, np.searchsorted(starts, first)


def terms_of(texts: list[bytes], span_hashes) -> Terms:
    data, starts, ends, bounds = term_bytes(texts)
    hashes = span_hashes(data, starts, ends)
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(hashes)))
    return Terms(hashes[at], counts, np.searchsorted(text[at], np.arange(len(texts) + 1)), sizes)


def rows_of(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """The slices of terms at a level, HASHES for each."""
    salt = np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))
    one = mix(hashes ^ salt)
    two = mix(one) | np.uint64(1)
    steps = np.arange(HASHES, dtype=np.uint64)[:, None]
    return ((one + steps * two) % np.uint64(width)).astype(np.int64)


def entries(terms: Terms) -> np.ndarray:
    """How many entries each text has: the levels that its terms reach."""
    reached = np.searchsorted(TERM_LEVELS, terms.counts, "right")
    running = np.concatenate([[0], np.cumsum(reached)])
    return running[terms.bounds[1:]] - running[terms.bounds[:-1]]


def cut(n_entries: np.ndarray) -> list[np.ndarray]:
    """Texts in blocks of like size, so that one width of signatures suits all of a block.

    The widest document decides the width; a block ends where more documents would pass BLOCK_BITS.
    """
    order = np.argsort(n_entries, kind="stable")[::-1]
    found, at = [], 0
    while at < len(order):
        width = width_of(int(n_entries[order[at]]))
        n = max(8, min(BLOCK_DOCS, BLOCK_BITS // width))
        found.append(order[at: at + n])
        at += n
    return found


def width_of(n_entries: int) -> int:
    return max(64, BITS_A_TERM * n_entries)


def build(terms: Terms, texts: np.ndarray, width: int) -> np.ndarray:
    """The block's slices: `width` rows of packed bits, a column for each of `texts`."""
    bits = np.zeros((width, -(-len(texts) // 8) * 8), bool)
    starts, stops = terms.bounds[texts], terms.bounds[texts + 1]
    n = stops - starts
    column = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)
    hashes, counts = terms.hashes[at], terms.counts[at]
    for level, least in enumerate(TERM_LEVELS):
        reached = counts >= least
        if not reached.any():
            break
        hashes, counts, column = hashes[reached], counts[reached], column[reached]
        bits[rows_of(hashes, level, width), column] = True
    return np.packbits(bits, axis=1)


def marked(slices: np.ndarray, hashes: np.ndarray, level: int) -> np.ndarray:
    """For each term the packed documents that may hold it at this level."""
    rows = rows_of(hashes, level, len(slices))
    found = slices[rows[0]]
    for row in rows[1:]:
        found &= slices[row]
    return found
