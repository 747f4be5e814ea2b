"""Language identification: sparse multinomial logistic regression on TF-IDF n-grams.

Features are hashed n-grams of one to three characters of the text in lower case, in which
everything but letters is a space, weighted by 1 + ln(count) times the inverse document frequency
(over all documents to learn from) and scaled to length one. The weights are learned by
follow-the-regularised-leader steps with an L1 and an L2 penalty on a bounded sample, and a
temperature fitted on rows kept apart makes the probabilities honest.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import of_every_group
from .shared import BLOCK_CHARS, blocks, in_arrow
from .words import codepoints

BITS = 15
DIMS = 1 << BITS
ORDERS = 3
# Rows of each language, at most about so many, that the weights are learned from, and of all
# languages together: with more than 40, each has less rows, but one at least.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 1500, 60_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Every code point as itself if it is a letter, else as a space."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            table[c] = c
    return table


def _grams(cps: np.ndarray) -> list[np.ndarray]:
    """For each order the hashed n-gram that begins at each position."""
    out, key = [], np.zeros(len(cps), np.uint32)
    for order in range(ORDERS):
        key = key[: len(cps) - order] * np.uint32(0x01000193) ^ (
            cps[order:] * np.uint32(0x9E3779B1) + np.uint32(order))
        spread = (key ^ key >> np.uint32(15)) * np.uint32(0x85EBCA6B)
        out.append((spread >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def gram_counts(texts: list[str]) -> list[np.ndarray | None]:
    """Counts of all hashed n-grams of every text; None for a text without a letter.

    A text longer than a block is counted in parts that overlap by what an n-gram needs.
    """
    if len(texts) == 1 and len(texts[0]) > BLOCK_CHARS:
        text, total = texts[0].lower(), None
        for at in range(0, len(text), BLOCK_CHARS):
            part = text[at: at + BLOCK_CHARS + ORDERS - 1]
            counts = _counts([part], [min(BLOCK_CHARS, len(part))])[0]
            if counts is not None:
                total = counts if total is None else total + counts
        return [total]
    return _counts(texts, [len(t) + 1 for t in texts])


def _counts(texts: list[str], begins: list[int]) -> list[np.ndarray | None]:
    """Counts of the n-grams that begin at the first `begins` positions of each text."""
    cps, bounds = codepoints([t.lower() for t in texts])
    cps = _letters()[cps]
    grams = _grams(cps)
    out = []
    for row, low in enumerate(bounds[:-1]):
        high = bounds[row + 1]
        if (cps[low:high] == 32).all():
            out.append(None)
            continue
        counts = np.zeros(DIMS, np.int64)
        for order, gram in enumerate(grams):
            stop = high - order  # where the last one begins that ends within the text's break
            if begins[row] <= len(texts[row]):
                stop = min(stop, low + begins[row])
            counts += np.bincount(gram[low:stop], minlength=DIMS)
        out.append(counts)
    return out


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt((values * values).sum())
    return at, (values / norm if norm else values).astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIMS x languages
    bias: np.ndarray
    temperature: float

    def predict(self, counts: np.ndarray | None) -> tuple[str, float]:
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        at, values = tf_idf(counts, self.idf)
        p = _softmax((values @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.2, l2: float = 0.5, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader, one row at a time.

    The last feature is a bias, which has no L1 penalty. The L1 penalty keeps weights at zero.
    """
    z = np.zeros((DIMS + 1, classes))
    n = np.zeros((DIMS + 1, classes))
    penalty = np.full((DIMS + 1, 1), l1)
    penalty[DIMS] = 0

    def weights(at):
        own = z[at]
        w = (np.sign(own) * penalty[at] - own) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(own) <= penalty[at], 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, values, label = rows[i]
            at, values = np.append(at, DIMS), np.append(values, 1.0)
            w = weights(at)
            error = _softmax(values @ w)
            error[label] -= 1
            g = values[:, None] * error
            squares = n[at]
            sigma = (np.sqrt(squares + g * g) - np.sqrt(squares)) / alpha
            z[at] += g - sigma * w
            n[at] = squares + g * g
    everything = weights(np.arange(DIMS + 1))
    return everything[:DIMS].astype(np.float32), everything[DIMS].astype(np.float32)


def fitted_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, on a grid from 0.05 to 20."""
    if not len(labels):
        return 1.0

    def loss(t):
        p = _softmax(logits / t)[np.arange(len(labels)), labels]
        return -np.log(np.maximum(p, 1e-12)).mean()

    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def _pack(counts: list[np.ndarray | None], labels: list[str], keys: list[int]) -> pa.RecordBatch:
    rows = [(lab, key, np.flatnonzero(c).astype("<u2").tobytes(),
             c[np.flatnonzero(c)].astype("<u4").tobytes())
            for c, lab, key in zip(counts, labels, keys) if c is not None]
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
         pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
        ["label", "key", "at", "counts"])


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(dim, df) over all rows of `_text`; each task adds up its own rows first.

    Dimension -1 counts the documents.
    """
    def run(batches):
        df = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for _, block in blocks(batch.column(0)):
                for counts in gram_counts(block):
                    if counts is not None:
                        df[:DIMS] += counts > 0
                        df[DIMS] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(at == DIMS, -1, at)), pa.array(df[at])], ["dim", "df"])

    counted = in_arrow(texts.select("_text"), run, "dim long, df long")
    return counted.groupBy("dim").agg(F.sum("df").alias("df"))


def train(
    docs: DataFrame, may_learn: Column, id_column: str = "doc_id", text_column: str = "text",
    lang_column: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE,
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Learn from the rows where `may_learn` holds and the language is not null.

    Every language with a letter in some text is learned. Document frequencies count all of these
    rows; the weights are learned from about `sample_per_language` rows of each language at most and
    `sample_rows` in all (some 10 kB a row reach the driver), one row of every language at least.
    The weights take memory in proportion to the languages. Nine tenths of the sample give the
    weights, the rest the temperature; the only rows of a language give weights. Without any row the
    model knows no language.
    """
    learn = docs.where(may_learn & F.col(lang_column).isNotNull()).select(
        F.col(id_column).alias("_id"), F.col(text_column).alias("_text"),
        F.col(lang_column).alias("_lang"))

    def vectors(batches):
        for batch in batches:
            keys, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, block in blocks(batch.column(1)):
                last = first + len(block)
                yield _pack(gram_counts(block), labels[first:last], keys[first:last])

    chosen = of_every_group(learn, "_lang", ["_id", "_text"], sample_per_language, sample_rows,
                            F.col("_text").rlike(r"\p{L}"))
    sample = in_arrow(
        chosen.select(F.xxhash64("_id", "_text").alias("_key"), "_text", "_lang"), vectors,
        "label string, key long, at binary, counts binary").collect()
    languages = sorted({r["label"] for r in sample})
    place = {lang: i for i, lang in enumerate(languages)}
    idf = np.zeros(DIMS, np.float32)
    if not languages:
        return Model([], idf, np.zeros((DIMS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    frequencies = {r["dim"]: r["df"] for r in document_frequencies(learn).collect()}
    total = frequencies.pop(-1)
    at = np.fromiter(frequencies, np.int64, len(frequencies))
    idf[at] = np.log((1 + total) / (1 + np.fromiter(frequencies.values(), np.int64, len(at)))) + 1
    learned = {r["label"] for r in sample if r["key"] % 10}
    rows, apart = [], []
    for r in sorted(sample, key=lambda r: (r["key"], r["label"])):
        counts = np.zeros(DIMS, np.int64)
        counts[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["counts"], "<u4")
        (apart if r["key"] % 10 == 0 and r["label"] in learned else rows).append(
            (*tf_idf(counts, idf), place[r["label"]]))
    weights, bias = train_ftrl(rows, len(languages))
    logits = np.array([v @ weights[at] + bias for at, v, _ in apart]).reshape(-1, len(languages))
    return Model(languages, idf, weights, bias,
                 fitted_temperature(logits, np.array([y for *_, y in apart], np.int64)))


def identify(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id, lang_pred and score, from the whole text alone.

    A text that is null, empty or without a letter is `und` with score 0; among equally likely
    languages the first in alphabetical order is taken. Ids may be null or repeated.
    """
    def run(batches):
        for batch in batches:
            for first, block in blocks(batch.column(1)):
                found = [model.predict(c) for c in gram_counts(block)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(block)), pa.array([x[0] for x in found]),
                     pa.array([x[1] for x in found], pa.float64())],
                    ["doc_id", "lang_pred", "score"])

    return in_arrow(docs.select(
        F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_text")
    ), run, "doc_id long, lang_pred string, score double")
