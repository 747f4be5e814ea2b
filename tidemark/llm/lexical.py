"""Ranked lexical search over bit-sliced Bloom signatures, with exact results.

The index holds blocks of documents: their keys, lengths and slices (see `bit_slices`). A query
reads it twice. The first time, weighted sums over the slices bound every document's score from
above, and each item's best bounds are scored exactly from the texts: the score of the tenth is a
floor. The second time every document whose bound reaches the floor is scored, so those left out are
provably below ten others.

Items are taken in groups of bounded size; for each group the corpus is read once for the document
frequencies of its terms.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bit_slices
from .columns import text_of
from .shared import blocks, in_arrow
from .stored import scratch_folder
from .words import span_hashes

TOP = 10
# The term pattern and lower-casing of the scores.
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
# Code points of items that are worked on together, and documents gathered to be cut in blocks.
ITEM_CHARS, GATHERED_TERMS = 1 << 20, 1 << 21
# So many candidates with their lists of items are broadcast; more are joined by a shuffle.
BROADCAST_CANDIDATES = 1 << 18
INDEX = ("doc_ids array<long>, no_id array<boolean>, text_keys array<long>, sizes array<long>, "
         "width long, slices binary")


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def term_hashes(names: list[str]) -> np.ndarray:
    data, starts, ends, _ = bit_slices.term_bytes([n.encode() for n in names])
    return span_hashes(data, starts, ends)


def text_key(text: str):
    return F.xxhash64(text_of(text))


def build_index(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Blocks of documents of like length with their signatures, written to the shared folder.

    Every row with at least one term is in one block; null and empty texts have none. A document is
    known by its id and a hash of its text, and repeated rows are as many documents.
    """
    folder = scratch_folder(docs.sparkSession, "slices")

    def rows(held):
        ids, keys, found = (list(x) for x in zip(*held))
        joined = bit_slices.Terms(
            *(np.concatenate([getattr(t, f) for t in found]) for f in ("hashes", "counts")),
            np.concatenate([[0], np.cumsum(np.concatenate([np.diff(t.bounds) for t in found]))]),
            np.concatenate([t.sizes for t in found]))
        ids, keys = pa.concat_arrays(ids), pa.concat_arrays(keys)
        n_entries = bit_slices.entries(joined)
        for texts in bit_slices.cut(n_entries):
            texts = texts[joined.sizes[texts] > 0]
            if not len(texts):
                continue
            width = bit_slices.width_of(int(n_entries[texts].max()))
            slices = bit_slices.build(joined, texts, width)
            taken = ids.take(pa.array(texts))
            yield pa.RecordBatch.from_arrays([
                pa.array([taken.to_pylist()], pa.list_(pa.int64())),
                pa.array([taken.is_null().to_pylist()], pa.list_(pa.bool_())),
                pa.array([keys.take(pa.array(texts)).to_pylist()], pa.list_(pa.int64())),
                pa.array([joined.sizes[texts].tolist()], pa.list_(pa.int64())),
                pa.array([width], pa.int64()), pa.array([slices.tobytes()], pa.binary()),
            ], [c.split()[0] for c in INDEX.split(", ")])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for first, texts in blocks(batch.column(2)):
                found = bit_slices.terms_of([t.encode() for t in texts], span_hashes)
                n = len(texts)
                held.append((batch.column(0).slice(first, n), batch.column(1).slice(first, n), found))
                size += len(found.hashes)
                if size >= GATHERED_TERMS:
                    yield from rows(held)
                    held, size = [], 0
        if held:
            yield from rows(held)

    in_arrow(docs.select(
        F.col(id_column).cast("long").alias("_id"), text_key(text_column).alias("_key"),
        F.col(text_column).alias("_text")), run, INDEX).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


@dataclass(frozen=True)
class Items:
    """A group of items: the distinct terms of all, and each item's terms with their weights."""

    ids: list  # item ids; may be null and may repeat
    names: list[str]
    hashes: np.ndarray
    of: list[np.ndarray]  # each item's terms as positions in `names`
    weights: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 0


def item_groups(items: DataFrame, id_column: str, text_column: str, item_chars: int) -> list[DataFrame]:
    """Distinct (id, text) rows dealt by a hash into groups of about `item_chars` code points."""
    rows = items.select(
        F.col(id_column).alias("_item"), text_of(text_column).alias("_text")).distinct()
    total = rows.agg(F.sum(F.length("_text"))).first()[0] or 0
    n = -(-total // item_chars)
    group = F.pmod(F.xxhash64("_item", "_text"), F.lit(max(1, n)))
    return [rows.where(group == i) for i in range(n)]


def _items(group: DataFrame) -> Items:
    rows = sorted(group.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    found = [(r[0], sorted(set(terms(r[1])))) for r in rows]
    found = [(i, names) for i, names in found if names]
    names = sorted({n for _, of in found for n in of})
    place = {n: i for i, n in enumerate(names)}
    return Items([i for i, _ in found], names, term_hashes(names) if names else np.zeros(0, np.uint64),
                 [np.array([place[n] for n in of]) for _, of in found])


def weighted(docs: DataFrame, items: Items, text_column: str = "text") -> Items:
    """The items with the weights of their terms, from counts over all documents.

    A task adds up one row of counts: documents with a term, their terms, and for each of the
    items' terms the documents that hold it. Terms are told apart by a 64-bit hash.
    """
    order = np.argsort(items.hashes)
    known = items.hashes[order]

    def run(batches):
        sums = np.zeros(2 + len(known), np.int64)
        for batch in batches:
            for _, texts in blocks(batch.column(0)):
                found = bit_slices.terms_of([t.encode() for t in texts], span_hashes)
                sums[0] += (found.sizes > 0).sum()
                sums[1] += found.sizes.sum()
                at = np.minimum(np.searchsorted(known, found.hashes), len(known) - 1)
                at = at[known[at] == found.hashes]
                sums[2:] += np.bincount(at, minlength=len(known))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["at", "n"])

    counts = np.zeros(2 + len(known), np.int64)
    rows = in_arrow(docs.select(F.col(text_column).alias("_text")), run, "at long, n long")
    for row in rows.groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[row["at"]] = row["n"]
    n_docs, n_terms = int(counts[0]), int(counts[1])
    holding = np.zeros(len(known), np.int64)
    holding[order] = counts[2:]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1)))
                        for n in holding], np.int64)
    return replace(items, weights=weights, n_docs=n_docs, n_terms=n_terms)


def length_factor(sizes: np.ndarray, items: Items) -> np.ndarray:
    return 100 - 90 + (90 * sizes * items.n_docs) // max(1, items.n_terms)


def _gain(counts, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def bounds(slices: np.ndarray, sizes: np.ndarray, items: Items) -> np.ndarray:
    """Upper bounds of all scores of a block: a row for each item, a column for each document."""
    m, n_docs = length_factor(sizes, items), len(sizes)
    levels = bit_slices.TERM_LEVELS
    place = np.concatenate(items.of)
    stops = np.cumsum([len(of) for of in items.of])
    weight = items.weights[place]
    total, before = np.zeros((len(items.of), n_docs), np.int64), np.zeros(n_docs, np.int64)
    alive, marks = np.arange(len(items.names)), None
    for level, least in enumerate(levels):
        found = bit_slices.marked(slices, items.hashes[alive], level)
        if marks is not None:
            found &= marks
        some = found.any(axis=1)
        alive, marks = alive[some], found[some]
        if not len(alive):
            break
        # a term of this level may count as often as the next level, or the document, allows
        most = np.minimum(levels[level + 1] - 1, sizes) if level + 1 < len(levels) else sizes
        gain = np.where(sizes >= least, _gain(most, m), before)
        row = np.full(len(items.names), -1)
        row[alive] = np.arange(len(alive))
        used = np.flatnonzero(row[place] >= 0)
        bits = np.unpackbits(marks, axis=1, count=n_docs)
        item = np.searchsorted(stops, used, "right")
        starts = np.flatnonzero(np.diff(item, prepend=-1))
        sums = np.add.reduceat(
            bits[row[place[used]]] * weight[used].astype(np.int32)[:, None], starts, axis=0,
            dtype=np.int64)
        total[item[starts]] += sums * (gain - before)
        before = np.maximum(before, gain)
    return total


def _scan(index: DataFrame, items: Items, choose, schema: str) -> DataFrame:
    """`choose(row columns, bounds)` over all blocks of the index."""
    def run(batches):
        yield from choose(_blocks_of(batches, items))
    return in_arrow(index, run, schema)


def _blocks_of(batches, items: Items):
    for batch in batches:
        for at in range(batch.num_rows):
            ids, no_id, keys, sizes, width, slices = (batch.column(i)[at] for i in range(6))
            sizes = sizes.values.to_numpy()
            packed = np.frombuffer(slices.as_buffer(), np.uint8).reshape(width.as_py(), -1)
            ids = np.where(no_id.values.to_numpy(zero_copy_only=False), 0,
                           ids.values.fill_null(0).to_numpy())
            yield (ids, no_id.values.to_numpy(zero_copy_only=False),
                   keys.values.to_numpy(), bounds(packed, sizes, items))


CANDIDATES = "item long, has_id boolean, doc_id long, text_key long, bound long"


def _candidate_batch(item, ids, no_id, keys, bound) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(item, pa.int64()), pa.array(~no_id), pa.array(ids, pa.int64()),
         pa.array(keys, pa.int64()), pa.array(bound, pa.int64())],
        ["item", "has_id", "doc_id", "text_key", "bound"])


def _highest(index: DataFrame, items: Items, top: int) -> DataFrame:
    """The documents with each item's highest bounds: `top` different ones."""
    def choose(found):
        held = None
        for ids, no_id, keys, bound in found:
            n = min(top, bound.shape[1])
            best = np.argpartition(bound, bound.shape[1] - n, axis=1)[:, -n:]
            values = np.take_along_axis(bound, best, 1)
            new = [ids[best], no_id[best], keys[best], values]
            if held is not None:
                new = [np.concatenate([x, y], axis=1) for x, y in zip(held, new)]
                n = min(top, new[3].shape[1])
                best = np.argpartition(new[3], new[3].shape[1] - n, axis=1)[:, -n:]
                new = [np.take_along_axis(x, best, 1) for x in new]
            held = new
        if held is not None:
            item = np.repeat(np.arange(len(held[3])), held[3].shape[1])
            some = held[3].ravel() > 0
            ids, no_id, keys, bound = (x.ravel()[some] for x in held)
            yield _candidate_batch(item[some], ids, no_id, keys, bound)

    best = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id", "has_id", "text_key")
    return _scan(index, items, choose, CANDIDATES).distinct().withColumn(
        "_place", F.row_number().over(best)).where(F.col("_place") <= top).drop("_place")


def _reaching(index: DataFrame, items: Items, floors: np.ndarray) -> DataFrame:
    """All documents whose bound reaches their item's floor."""
    def choose(found):
        for ids, no_id, keys, bound in found:
            item, at = np.nonzero(bound >= floors[:, None])
            if len(item):
                yield _candidate_batch(item, ids[at], no_id[at], keys[at], bound[item, at])

    return _scan(index, items, choose, CANDIDATES)


def _scores(
    docs: DataFrame, candidates: DataFrame, items: Items, folder: str, id_column: str,
    text_column: str,
) -> DataFrame:
    """(item, doc_id, score): exact scores of the candidates, one row for each row of `docs`.

    Candidates are written first and counted: a bounded number of them is broadcast to the texts.
    """
    spark = docs.sparkSession
    candidates.groupBy("has_id", "doc_id", "text_key").agg(
        F.sort_array(F.collect_set("item")).alias("items")).write.parquet(folder)
    chosen = spark.read.parquet(folder)
    n = chosen.agg(F.sum(F.size("items"))).first()[0] or 0
    number = F.col(id_column).cast("long")
    rows = docs.select(
        number.isNotNull().alias("has_id"), F.coalesce(number, F.lit(0)).alias("doc_id"),
        text_key(text_column).alias("text_key"), F.col(text_column).alias("_text"))
    found = rows.join(
        F.broadcast(chosen) if n <= BROADCAST_CANDIDATES else chosen,
        ["has_id", "doc_id", "text_key"])

    def run(batches):
        names = items.names
        for batch in batches:
            out = []
            for has_id, doc_id, text, of in zip(*(batch.column(i) for i in range(4))):
                counts = Counter(terms(text.as_py()))
                size = sum(counts.values())
                m = 100 - 90 + (90 * size * items.n_docs) // max(1, items.n_terms)
                for item in of.as_py():
                    score = 0
                    for at in items.of[item].tolist():
                        if tf := counts.get(names[at]):
                            score += int(items.weights[at]) * (
                                (1_000_000_000 * tf) // (1000 * tf + 8 * m))
                    if score > 0:
                        out.append((item, doc_id.as_py() if has_id.as_py() else None, score))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*out)], ["item", "doc_id", "score"])

    return in_arrow(found.select("has_id", "doc_id", "_text", "items"), run,
                    "item long, doc_id long, score long")


def _ranked(scores: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_id: str = "item_id", item_text: str = "text", top: int = TOP,
    index: DataFrame | None = None, item_chars: int = ITEM_CHARS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of each item, as defined below.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, only A-Z
    lower-cased. With N documents that have a term, L terms in all of them, n in one of them and tf
    of a term that df documents hold, weighing w = floor(1000 ln((2N + 2) / (2 df + 1))):
    m = 10 + 90 n N div L, and a document's score is the sum of w * (10^9 tf div (1000 tf + 8 m)) over
    the item's distinct terms. Only scores above 0 are returned; equal ones by ascending id, null ids
    last. Null and empty texts match nothing. Repeated rows of `docs` are as many documents; repeated
    rows of `items` are one item, and texts that share an id are ranked each for itself. Other
    columns are not read. `index` is `build_index(docs)`, which is made if it is not given.
    """
    spark = docs.sparkSession
    schema = f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id long, score long"
    folder, result = scratch_folder(spark, "ranked"), None
    for number, group in enumerate(item_groups(items, item_id, item_text, item_chars)):
        chosen = _items(group)
        if not chosen.ids:
            continue
        chosen = weighted(docs, chosen, text_column)
        index = build_index(docs, id_column, text_column) if index is None else index
        arguments = chosen, f"{folder}/{number}", id_column, text_column
        first = _scores(docs, _highest(index, chosen, top), chosen, f"{folder}/{number}-first",
                        id_column, text_column)
        floors = np.ones(len(chosen.ids), np.int64)
        for row in _ranked(first, top).where(F.col("rank") == top).collect():
            floors[row["item"]] = row["score"]
        scores = _scores(docs, _reaching(index, chosen, floors), *arguments)
        names = spark.createDataFrame(
            list(enumerate(chosen.ids)), f"item long, {schema.partition(',')[0]}")
        ranked = _ranked(scores, top).join(F.broadcast(names), "item").select(
            "item_id", "rank", "doc_id", "score")
        result = ranked if result is None else result.unionByName(ranked)
    return spark.createDataFrame([], schema) if result is None else result
