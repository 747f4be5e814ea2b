"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a dozen numbers (shares of character classes, repetition of words, pairs and lines,
lengths). Every number is cut into bins, and cyclic boosting learns a table of one value per bin:
round after round, each feature in turn gets a shallow tree over its own bins, fitted to what is
left of the errors and added to its table. The pairs of features that explain most of the errors
left then get tables of their own. A score is a sum of table entries, so it can be read.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import capped, with_texts
from .shared import blocks, in_arrow, map_texts
from .words import BASE, codepoints, mix, pieces_of, span_hashes, spans_of, word_table

FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "repeated_words",
    "distinct_pairs", "upper", "digits", "sentence_marks", "other_signs", "blanks",
    "lines", "distinct_lines", "sentence_length",
)
# Rows of each label, at most about so many, that the tables are learned from.
SAMPLE_PER_LABEL = 10_000
LOWER, UPPER, DIGIT, BLANK, BREAK, MARK, OTHER = range(7)
SENTENCE_MARKS = ".,;:?'\"()-"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    by_category = {"L": LOWER, "M": LOWER, "N": DIGIT, "Z": BLANK}
    for c in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(c))
        table[c] = UPPER if category in ("Lu", "Lt") else by_category.get(category[0], OTHER)
    table[[ord(c) for c in SENTENCE_MARKS]] = MARK
    table[[9, 11, 12, 13]] = BLANK
    table[10] = BREAK
    return table


@dataclass
class _Parts:
    """What features are made of: counts by text, hashes of words and lines in order."""

    classes: np.ndarray
    stops: np.ndarray
    words: np.ndarray
    word_bounds: np.ndarray
    lines: np.ndarray
    line_bounds: np.ndarray


def _parts(texts: list[str]) -> _Parts:
    cps, bounds = codepoints(texts)
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    classes = _classes()[cps]
    counts = np.bincount(owner * 7 + classes, minlength=7 * n).reshape(n, 7)
    counts[:, BREAK] -= 1  # the break that was put behind each text
    stops = np.bincount(owner[(cps == ord(".")) | (cps == ord("?"))], minlength=n)
    lines, line_ends = spans_of(classes != BREAK)
    line_hashes = span_hashes(cps, lines, line_ends)
    low, low_bounds = codepoints([t.lower() for t in texts])
    starts, ends = spans_of(word_table()[low])
    return _Parts(counts, stops, span_hashes(low, starts, ends),
                  np.searchsorted(starts, low_bounds), line_hashes, np.searchsorted(lines, bounds))


def _joined_parts(text: str) -> _Parts:
    """The parts of one very long text, a block at a time; lines are cut where blocks are."""
    each = [_parts([p]) for p in pieces_of(text)]
    words = np.concatenate([p.words for p in each])
    lines = np.concatenate([p.lines for p in each])
    return _Parts(sum(p.classes for p in each), sum(p.stops for p in each), words,
                  np.array([0, len(words)]), lines, np.array([0, len(lines)]))


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many different hashes each text has."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(bounds))
    keys = np.sort(owner << np.uint64(40) | hashes[: len(owner)] >> np.uint64(24))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=n)


def features(texts: list[str]) -> np.ndarray:
    """One row of FEATURES per text; shares of nothing are 0 (of distinct ones: 1)."""
    long = len(texts) == 1 and len(pieces_of(texts[0])) > 1
    p = _joined_parts(texts[0]) if long else _parts(texts)
    counts = p.classes.astype(np.float64)
    chars, n_words = counts.sum(axis=1), np.diff(p.word_bounds).astype(np.float64)
    letters = counts[:, LOWER] + counts[:, UPPER]
    some, words, pairs = np.maximum(chars, 1), np.maximum(n_words, 1), np.maximum(n_words - 1, 1)
    # a pair is known by its first word; the last word of a text begins none
    next_words = np.append(p.words[1:], np.uint64(0))
    pair_hashes = mix(p.words * np.uint64(BASE) + next_words)
    owner = np.repeat(np.arange(len(texts)), np.diff(p.word_bounds))
    within = np.append(owner[1:] == owner[:-1], False)[: len(owner)]
    equal = np.bincount(owner[within & (p.words == next_words)], minlength=len(texts))
    pair_bounds = np.concatenate([[0], np.cumsum(np.bincount(owner[within], minlength=len(texts)))])
    n_lines = np.diff(p.line_bounds)
    share_or_one = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 1.0)
    return np.column_stack([
        np.log1p(chars), np.log1p(n_words), (letters + counts[:, DIGIT]) / words,
        share_or_one(_distinct(p.words, p.word_bounds), n_words), equal / pairs,
        share_or_one(_distinct(pair_hashes[within], pair_bounds), np.maximum(n_words - 1, 0)),
        counts[:, UPPER] / np.maximum(letters, 1), counts[:, DIGIT] / some,
        counts[:, MARK] / some, counts[:, OTHER] / some, counts[:, BLANK] / some,
        1000 * counts[:, BREAK] / some, share_or_one(_distinct(p.lines, p.line_bounds), n_lines),
        n_words / np.maximum(p.stops, 1),
    ])


# ---- learning ----------------------------------------------------------------------------------

BINS, PAIRS = 32, 8
RATE, RIDGE, MOST_ROUNDS, PATIENCE = 0.1, 1.0, 300, 20


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of ordered bins, and where it is (0: none)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = (left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE)
            - all_g**2 / (all_h + RIDGE))
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """One value per bin: a tree over ordered bins, fitted to gradients g and curvatures h."""
    at = _cut(g, h)[1] if depth else 0
    if not at:
        return np.full(len(g), RATE * g.sum() / (h.sum() + RIDGE))
    return np.concatenate([shallow_tree(g[:at], h[:at], depth - 1),
                           shallow_tree(g[at:], h[at:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A table over two features' bins: the best cut of the first, then one of the second.

    Also returns the gain over no cut at all.
    """
    def strip(rows):
        own_g, own_h = g[rows].sum(axis=0), h[rows].sum(axis=0)
        gain, at = _cut(own_g, own_h)
        total = gain + own_g.sum() ** 2 / (own_h.sum() + RIDGE)
        return total, np.concatenate([
            np.full(b - a, RATE * own_g[a:b].sum() / (own_h[a:b].sum() + RIDGE))
            for a, b in ((0, at), (at, len(own_g)))])

    cuts = [(strip(slice(0, i)), strip(slice(i, None)), i) for i in range(1, len(g))]
    if not cuts:
        return 0.0, np.zeros_like(g)
    (top, upper), (bottom, lower), i = max(cuts, key=lambda c: c[0][0] + c[1][0])
    table = np.vstack([np.tile(upper, (i, 1)), np.tile(lower, (len(g) - i, 1))])
    return top + bottom - g.sum() ** 2 / (h.sum() + RIDGE), table


@dataclass
class Model:
    """edges: upper ends of bins by feature; tables: values by bin; pairs: (i, j, table)."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        f = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            f += table[b[:, j]]
        for i, j, table in self.pairs:
            f += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def _loss(f: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, f) - y * f).mean()) if len(y) else 0.0


def _boost(f: np.ndarray, y: np.ndarray, apart: np.ndarray, indices: list, sizes: list, fit):
    """Cyclic boosting of one table per index until the rows kept apart gain no more.

    Returns the tables of the best round and the sums with them.
    """
    tables = [np.zeros(s) for s in sizes]
    best, best_loss, waited = ([t.copy() for t in tables], f.copy()), np.inf, 0
    for _ in range(MOST_ROUNDS):
        for k, index in enumerate(indices):
            p = 1 / (1 + np.exp(-f))
            size = tables[k].size
            g = np.bincount(index[~apart], weights=(y - p)[~apart], minlength=size)
            h = np.bincount(index[~apart], weights=(p * (1 - p))[~apart], minlength=size)
            step = fit(g.reshape(sizes[k]), h.reshape(sizes[k]))
            tables[k] += step
            f = f + step.ravel()[index]
        held = apart if apart.any() else ~apart
        loss = _loss(f[held], y[held])
        if loss < best_loss - 1e-5:
            best, best_loss, waited = ([t.copy() for t in tables], f.copy()), loss, 0
        else:
            waited += 1
            if waited >= PATIENCE:
                break
    return best


def fit(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> Model:
    """Learn from rows x with labels y; the rows marked `apart` decide when to stop."""
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(rate / (1 - rate))), edges, [], [])
    b = model.bins(x)
    sizes = [len(e) + 1 for e in edges]
    f = np.full(len(y), model.bias)
    model.tables, f = _boost(f, y, apart, list(b.T), sizes, shallow_tree)

    def index(i, j):
        return b[:, i] * sizes[j] + b[:, j]

    p = 1 / (1 + np.exp(-f))
    gains = []
    for i, j in combinations(range(len(sizes)), 2):
        g, h = (np.bincount(index(i, j)[~apart], weights=v[~apart], minlength=sizes[i] * sizes[j])
                .reshape(sizes[i], sizes[j]) for v in (y - p, p * (1 - p)))
        gains.append((pair_tree(g, h)[0], i, j))
    chosen = sorted(gains, key=lambda t: (-t[0], t[1:]))[:PAIRS]
    tables, _ = _boost(
        f, y, apart, [index(i, j) for _, i, j in chosen],
        [(sizes[i], sizes[j]) for _, i, j in chosen], lambda g, h: pair_tree(g, h)[1])
    model.pairs = [(i, j, t) for (_, i, j), t in zip(chosen, tables)]
    return model


def train(
    docs: DataFrame, labels: DataFrame, may_learn: Column, id_column: str = "doc_id",
    text_column: str = "text", label_column: str = "quality",
    sample_per_label: int = SAMPLE_PER_LABEL,
) -> Model:
    """Learn from labelled rows where `may_learn` (over id_column) holds.

    The sample has about `sample_per_label` rows of each label at most; if it thins out one
    label, the bias is moved back to the share that the label has among all rows. Several labels
    of a document: the highest counts. Without labelled rows every score is 0.5.
    """
    marks = (labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & may_learn)
             .groupBy(id_column).agg(F.max(label_column).alias("_label")))
    share = {r["_label"]: r["count"] for r in marks.groupBy("_label").count().collect()}
    sample = capped(marks, "_label", [id_column], sample_per_label)

    def run(batches):
        for batch in batches:
            for first, block in blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(features(block).tolist(), pa.list_(pa.float64())),
                     batch.column(1).slice(first, len(block)),
                     batch.column(2).slice(first, len(block))], ["x", "label", "key"])

    chosen = with_texts(docs, sample, id_column, text_column).select(
        "_text", F.col("_label").cast("int"), F.xxhash64("_id").alias("_key"))
    rows = in_arrow(chosen, run, "x array<double>, label int, key long").collect()
    if not rows:
        width = len(FEATURES)
        return Model(0.0, [np.zeros(0)] * width, [np.zeros(1)] * width, [])
    rows.sort(key=lambda r: (r["key"], r["x"]))
    y = np.array([r["label"] for r in rows], np.float64)
    apart = np.array([r["key"] % 6 == 0 for r in rows])
    model = fit(np.array([r["x"] for r in rows]), y, apart)
    if y.sum() and (1 - y).sum():
        model.bias += float(np.log(share[1] / share[0]) - np.log(y.sum() / (1 - y).sum()))
    return model


def score(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id and score (higher: better), from the whole text alone.

    A null text counts as empty and has a score as well. Ids may be null or repeated; each row is
    scored by itself.
    """
    def work(ids, texts):
        return pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), pa.array(model.scores(features(texts)))], ["doc_id", "score"])

    return map_texts(docs, id_column, text_column, "doc_id long, score double", work)
