"""Toxicity by non-negative positive-unlabelled learning.

Only two kinds of text are learned from: documents that a person marked as toxic, and documents
that nobody marked. Some of the unmarked are toxic too, a share that the class prior tells. The
risk of a classifier f is then estimated as

    prior * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - prior * E_pos[loss(-f)])

where the second part estimates the risk on clean texts; once it would be negative, which is a
sign of overfitting, the step goes up that part instead. f is linear in the presence of hashed
words, of the beginnings of words and of character runs within words, chosen by how much more
often they are in the marked texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import capped, with_texts
from .shared import blocks, checkpointed, in_arrow, map_texts
from .words import BASE, codepoints, mix, pieces_of, span_hashes, spans_of, word_table

BITS = 18
PREFIXES = (4, 5)
RUN = 5
# Bounds of the training sample, and how many features the classifier may use.
POSITIVES, UNLABELLED, FEATURES = 3000, 9000, 4096
# A feature must be in so many marked texts, so many times as often as in unmarked texts, and by so
# many standard deviations more often than chance would have it. All texts are counted.
LEAST_TEXTS, LEAST_LIFT, LEAST_Z = 4, 2.0, 5.0


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed feature of everything that the texts hold; a feature may come up again."""
    rows, found = [], []
    for row, text in enumerate(texts):
        for part in pieces_of(text):
            if part is not text:
                r, f = _features([part])
                rows.append(r + row)
                found.append(f)
    whole = [t if len(pieces_of(t)) == 1 else "" for t in texts]
    r, f = _features(whole)
    return np.concatenate([r, *rows]), np.concatenate([f, *found])


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    cps, bounds = codepoints([t.lower() for t in texts])
    inside = word_table()[cps]
    starts, ends = spans_of(inside)
    hashes = [span_hashes(cps, starts, ends)]
    at = [starts]
    for n in PREFIXES:
        longer = ends - starts > n
        hashes.append(span_hashes(cps, starts[longer], starts[longer] + n) ^ np.uint64(n))
        at.append(starts[longer])
    if len(cps) >= RUN:
        low = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(inside, RUN).all(axis=1))
        hashes.append(span_hashes(cps, low, low + RUN) ^ np.uint64(99))
        at.append(low)
    keys = (mix(np.concatenate(hashes) * np.uint64(BASE)) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.searchsorted(bounds, np.concatenate(at), "right") - 1, keys


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of all hashed features; most are 0
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of each text to be toxic."""
        rows, keys = features(texts)
        used = self.weights[keys] != 0
        once = np.unique(rows[used] << BITS | keys[used])
        total = np.bincount(once >> BITS, weights=self.weights[once & ((1 << BITS) - 1)],
                            minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -40, 40)))


def train_nnpu(
    rows: list[np.ndarray], positive: np.ndarray, width: int, prior: float,
    steps: int = 400, rate: float = 0.06, l2: float = 2e-4,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk, by Adam steps.

    `rows`: the features (0 to width-1) of each text; `positive`: marked or not. Steps up the clean
    risk also lift the bias, so at the end it is set such that the unlabelled texts have the
    prior as their mean score.
    """
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    share = np.where(positive, 1 / max(positive.sum(), 1), 1 / max((~positive).sum(), 1))
    w = np.zeros(width + 1)
    w[width] = np.log(prior / (1 - prior))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        f = np.bincount(owner, weights=w[flat], minlength=len(rows)) + w[width]
        p = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
        as_clean = np.logaddexp(0, f)  # loss of calling a text clean; its slope is p
        clean_risk = ((as_clean * share)[~positive].sum()
                      - prior * (as_clean * share)[positive].sum())
        slope_clean = np.where(positive, -prior, 1.0) * share * p
        slope = slope_clean + np.where(positive, prior * share * (p - 1), 0.0)
        if clean_risk < 0:
            slope = -slope_clean
        g = np.append(np.bincount(flat, weights=slope[owner], minlength=width), slope.sum())
        g[:width] += l2 * w[:width]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    f = np.bincount(owner, weights=w[flat], minlength=len(rows))[~positive]
    low, high = -40.0, 40.0
    for _ in range(60):
        middle = (low + high) / 2
        mean = (1 / (1 + np.exp(-np.clip(f + middle, -40, 40)))).mean()
        low, high = (low, middle) if mean > prior else (middle, high)
    return w[:width], low


def _frequencies(texts: DataFrame) -> DataFrame:
    """(key, in_positive, in_unlabelled): in how many texts each feature is."""
    def run(batches):
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            marks = np.array(batch.column(1).to_pylist(), bool)
            for first, block in blocks(batch.column(0)):
                rows, keys = features(block)
                once = np.unique(rows << BITS | keys)
                own = marks[first + (once >> BITS)]
                for kind in (0, 1):
                    counts[kind] += np.bincount(
                        once[own == bool(kind)] & ((1 << BITS) - 1), minlength=1 << BITS)
        at = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(counts[1][at]), pa.array(counts[0][at])], ["key", "p", "u"])

    counted = in_arrow(texts.select("_text", "_positive"), run, "key long, p long, u long")
    return counted.groupBy("key").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def train(
    docs: DataFrame, labels: DataFrame, may_learn: Column, id_column: str = "doc_id",
    text_column: str = "text", label_column: str = "toxic", prior: float | None = None,
    positives: int = POSITIVES, unlabelled: int = UNLABELLED, most_features: int = FEATURES,
) -> Model:
    """Learn from rows of `docs` where `may_learn` (over id_column) holds.

    Features are counted in, and chosen from, all documents that are marked 1 or not at all. Only
    their weights are fitted on a sample: about `positives` documents marked 1 and `unlabelled`
    documents without a mark at most. The prior is, if not given, the share of 1 among the marks of rows that may be
    learned from. Several marks of a document: the highest counts. Documents without an id are
    not learned from. Without marked or unmarked documents the score is the prior everywhere.
    """
    marks = (labels.where(F.col(label_column).isNotNull())
             .groupBy(F.col(id_column)).agg(F.max(label_column).alias("_mark")))
    learn = (docs.select(id_column).where(F.col(id_column).isNotNull() & may_learn).distinct()
             .join(marks, id_column, "left"))
    kinds = learn.withColumn("_kind", F.coalesce(F.col("_mark"), F.lit(-1)))
    counts = {r["_kind"]: r["count"] for r in kinds.groupBy("_kind").count().collect()}
    marked, clean, unknown = counts.get(1, 0), counts.get(0, 0), counts.get(-1, 0)
    if prior is None:
        prior = (marked + 1) / (marked + clean + 2)
    base = float(np.log(prior / (1 - prior)))
    if not marked or not unknown:
        return Model(np.zeros(1 << BITS, np.float32), base)
    chosen = (capped(kinds.where("_kind = 1"), "_kind", [id_column], positives)
              .unionByName(capped(kinds.where("_kind = -1"), "_kind", [id_column], unlabelled))
              .select(id_column, (F.col("_kind") == 1).alias("_positive")))
    texts = checkpointed(with_texts(docs, chosen, id_column, text_column))
    n_p, n_u = marked, unknown
    kind_of = kinds.where("_kind <> 0").select(
        F.col(id_column).alias("_id"), (F.col("_kind") == 1).alias("_positive"))
    every = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).groupBy(
        "_id").agg(F.min("_text").alias("_text")).join(kind_of, "_id")
    in_p, in_u = F.col("p") / n_p, F.col("u") / n_u
    rate = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (in_p - in_u) / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-9)) * (1 / n_p + 1 / n_u))
    keys = [r["key"] for r in _frequencies(every)
            .where(F.col("p") >= LEAST_TEXTS)
            .where((in_p > LEAST_LIFT * in_u) & (z >= LEAST_Z))
            .orderBy(z.desc(), "key").limit(most_features).collect()]
    place = np.full(1 << BITS, -1, np.int64)
    place[keys] = np.arange(len(keys))

    def chosen_features(batches):
        for batch in batches:
            marks_ = batch.column(1).to_pylist()
            for first, block in blocks(batch.column(0)):
                rows, found = features(block)
                kept = place[found] >= 0
                once = np.unique(rows[kept] << BITS | place[found[kept]])
                bounds = np.searchsorted(once, np.arange(len(block) + 1) << BITS)
                own = [(once[a:b] & ((1 << BITS) - 1)).astype("<u4").tobytes()
                       for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks_[first: first + len(block)]), pa.array(own, pa.binary())],
                    ["positive", "at"])

    sample = in_arrow(texts.select("_text", "_positive"), chosen_features,
                      "positive boolean, at binary").collect()
    sample.sort(key=lambda r: (r["positive"], r["at"]))
    w, bias = train_nnpu([np.frombuffer(r["at"], "<u4") for r in sample],
                         np.array([r["positive"] for r in sample], bool), len(keys), prior)
    weights = np.zeros(1 << BITS, np.float32)
    weights[keys] = w
    return Model(weights, bias)


def score(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id and score, from the whole text alone.

    A null or empty text has the score of a text without any feature. Ids may be null or
    repeated; each row is scored by itself.
    """
    def work(ids, texts):
        return pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), pa.array(model.scores(texts).astype(np.float64))],
            ["doc_id", "score"])

    return map_texts(docs, id_column, text_column, "doc_id long, score double", work)


def keep_clean(
    docs: DataFrame, model: Model, text_column: str = "text", threshold: float = 0.3
) -> DataFrame:
    """The rows and columns of `docs` whose score is below the threshold."""
    place = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            scores = [model.scores(block) for _, block in blocks(batch.column(place))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < threshold))

    return in_arrow(docs, run, docs.schema)
