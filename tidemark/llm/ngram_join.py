"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

1. Every text becomes the set of hashes of its runs of five words, and a MinHash signature that is
   cut into bands. Band and row counts follow from the threshold and the wanted recall.
2. Documents with equal sets are one class; from here on there is one row per class, so
   thousands of copies cost no more than one.
3. Classes that share a band hash are candidates. A bucket of m classes yields m - 1 edges to its
   least member, not m^2 / 2 pairs. Components of these edges hold all candidate pairs.
4. A component is compared in cells. A small one is one cell; a larger one is dealt into blocks
   of bounded size, and every two blocks make a cell, so no task holds more than two
   blocks and every pair is compared in exactly one cell. A component of more than MOST_BLOCKS blocks
   is mostly a chain of unlike families: it is not compared as a whole, but bucket by bucket, in cells
   of the bucket's blocks, and a pair counts in the first band that it shares. So a class meets a
   bounded number of others besides those it shares a bucket with. A cell counts common n-grams of
   all its pairs by a matrix product and returns one row per class: how many documents it
   is linked with, and the least class it hangs together with.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import row_key, unused
from .components import connected_components
from .shared import blocks, checkpointed, in_arrow
from .words import hashed_words, mix, shingles

WIDTH, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9995, 192
# N-grams of a block; every class counts for CLASS_WEIGHT more, so a block has a thousand classes at
# most and the pairs of a cell's two blocks are some 4 million numbers. One class alone may be more.
BLOCK_WEIGHT, CLASS_WEIGHT = 250_000, 250
# Blocks of a component up to which all its pairs are compared, whatever buckets they share.
MOST_BLOCKS = 8


def bands_for(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): as many rows as can be, so that few dissimilar pairs meet, such that pairs at
    the threshold meet in some band with probability `recall` using at most `most_hashes`."""
    best = None
    for rows in range(1, most_hashes + 1):
        meet = threshold**rows
        bands = 1 if meet >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-meet))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("the recall needs more hashes")
    return best


class Hasher:
    """MinHash band keys of n-gram sets. The functions follow from fixed numbers."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)) >> np.uint64(32)
        flip, times = seeds.astype(np.uint32).reshape(2, bands * rows, 1)
        self.flip, self.times = flip, times | np.uint32(1)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """One 64-bit key per band; the band's number is part of it."""
        x = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 4096):
            values = (x[None, at: at + 4096] ^ self.flip) * self.times
            np.minimum(least, values.min(axis=1), out=least)
        total = np.arange(self.bands, dtype=np.uint64)
        for column in least.reshape(self.bands, self.rows).T:
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + column)
        return total.view(np.int64)


def gram_sets(texts: list[str], width: int) -> list[np.ndarray]:
    words, bounds = hashed_words(texts)
    return [shingles(words[a:b], width) for a, b in zip(bounds, bounds[1:])]


def _set_key(grams: np.ndarray, text: str) -> tuple[int, int] | None:
    """128 bits of the set; of the text if it has no words; None if it is empty."""
    if len(grams):
        digest = hashlib.blake2b(grams.tobytes(), digest_size=16)
    elif text:
        raw_text = text.encode("utf-8", "surrogatepass")
        digest = hashlib.blake2b(raw_text, digest_size=16, person=b"text")
    else:
        return None
    raw = digest.digest()
    return (int.from_bytes(raw[:8], "little", signed=True),
            int.from_bytes(raw[8:], "little", signed=True))


SIGNATURES = "_id long, _a long, _h long, _k1 long, _k2 long, _grams long, _bands array<long>"
CELL = "array<struct<group:long,part:int,blocks:int,block:int>>"
SETS = f"_node long, _copies long, _bands array<long>, _cells {CELL}, _set binary"
CELLS = "_node long, _linked long, _root long"


def signatures(
    docs: DataFrame, id_column: str, text_column: str, width: int, bands: int, rows: int
) -> DataFrame:
    hasher = Hasher(bands, rows)
    names = [x.split()[0] for x in SIGNATURES.split(", ")]

    def run(batches):
        for batch in batches:
            for first, block in blocks(batch.column(3)):
                own = [batch.column(i).slice(first, len(block)) for i in range(3)]
                keys, grams, bands_ = [], [], []
                for text, found in zip(block, gram_sets(block, width)):
                    keys.append(_set_key(found, text) or (None, None))
                    grams.append(len(found))
                    bands_.append(hasher.keys(found) if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array([k[0] for k in keys], pa.int64()),
                     pa.array([k[1] for k in keys], pa.int64()), pa.array(grams, pa.int64()),
                     pa.array(bands_, pa.list_(pa.int64()))], names)

    a, h = row_key(id_column, text_column)
    rows_ = docs.select(F.col(id_column).cast("long").alias("_id"), a.alias("_a"), h.alias("_h"),
                        F.col(text_column).alias("_text"))
    return in_arrow(rows_, run, SIGNATURES)


def compare_cell(
    sets: list[np.ndarray], copies: np.ndarray, left: np.ndarray, within: bool, threshold: Fraction,
    earlier: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """For each class of a cell the documents it is linked with, and the first class (by order of
    rows) that it hangs together with. `within`: one block; else only pairs across `left`.

    `earlier`: the keys of bands before the cell's own, a row for each class. Pairs that share one
    count in that band's cells and not here.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1
    column, owner = column[several], owner[several]
    column = np.unique(column, return_inverse=True)[1]
    common = np.zeros((n, n), np.float32)
    step = max(1, 2_000_000 // n)
    for low in range(0, int(column.max(initial=-1)) + 1, step):
        a, b = np.searchsorted(column, [low, low + step])
        part = np.zeros((n, step), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    p, q = threshold.numerator, threshold.denominator
    # common / (sum - common) >= p / q, in whole numbers
    linked = (common.astype(np.int64) * (p + q) >= p * (sizes[:, None] + sizes[None, :]))
    np.fill_diagonal(linked, False)
    if not within:
        linked &= left[:, None] != left[None, :]
    root = np.arange(n)
    while True:
        lower = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1))
        lower = lower[lower]
        if (lower == root).all():
            break
        root = lower
    if earlier is not None:
        for keys in earlier.T:
            linked &= keys[:, None] != keys[None, :]
    return linked @ copies, root


def _cells(threshold: Fraction):
    """Compare cell after cell of a partition that is sorted by cell."""
    names = [x.split()[0] for x in CELLS.split(", ")]

    def result(rows):
        part, i, j = rows[0][0], rows[0][2], rows[0][3]
        rows.sort(key=lambda r: r[4])
        sets = [np.frombuffer(r[8], "<u8") for r in rows]
        earlier = np.array([r[7][:part] for r in rows], np.int64) if part > 0 else None
        linked, root = compare_cell(
            sets, np.array([r[5] for r in rows], np.int64), np.array([r[6] == i for r in rows]),
            i == j, threshold, earlier)
        nodes = [r[4] for r in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array(linked, pa.int64()),
             pa.array([nodes[r] for r in root], pa.int64())], names)

    def run(batches):
        cell, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:4] != cell and rows:
                    yield result(rows)
                    rows = []
                cell = row[:4]
                rows.append(row)
        if rows:
            yield result(rows)

    return run


def near_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH,
    threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES,
) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id, n_links and the keys _a, _h, _keep.

    Two documents are linked if the Jaccard similarity of their sets of runs of `width` words is at
    least `threshold`; a text of fewer words is one run. n_links counts the other documents that a
    document is linked with, copies included. class_id is the least id of all documents that links
    lead to (its own if there are none). Texts without words are linked with equal texts only, null
    and empty texts with nothing. Ids may be null or repeated: each row is a document, null ids
    do not become class ids unless a class has no other. _keep marks one distinct row (by _a, _h)
    of every class. Other columns are not read.
    """
    limit = Fraction(threshold).limit_denominator(10_000)
    bands, rows = bands_for(threshold, recall, most_hashes)
    signed = checkpointed(signatures(docs, id_column, text_column, width, bands, rows))
    # a class is a node by its place in the table that is written here, so no two are one node
    classes = checkpointed(signed.where("_k1 IS NOT NULL").groupBy("_k1", "_k2").agg(
        F.min("_id").alias("_least"), F.min(F.struct("_a", "_h")).alias("_first"),
        F.count(F.lit(1)).alias("_copies"), F.max("_grams").alias("_grams"),
        F.first("_bands").alias("_bands")).withColumn("_node", F.monotonically_increasing_id()))
    # stars from the members of a bucket to its least member
    members = classes.select("_node", F.explode("_bands").alias("_band"))
    # Grouped sides of the joins below are written out first. They are small, and a join that
    # shuffles both sides anew can split a bucket or a component that holds many rows.
    hubs = checkpointed(members.groupBy("_band").agg(
        F.min("_node").alias("_hub"), F.max("_node").alias("_other")).where("_hub < _other"))
    stars = members.join(hubs.select("_band", "_hub"), "_band").where("_node <> _hub").select(
        F.col("_node").alias("u"), F.col("_hub").alias("v"))
    candidates = connected_components(stars).select(
        F.col("node").alias("_node"), F.col("component").alias("_component"))
    dealt = deal(classes.join(candidates, "_node"))
    compared = checkpointed(_compare(docs, dealt, id_column, text_column, width, limit))
    linked = compared.groupBy("_node").agg(F.sum("_linked").alias("_linked"))
    found = connected_components(
        compared.select(F.col("_node").alias("u"), F.col("_root").alias("v")))
    grouped = (
        classes.drop("_bands").join(linked, "_node", "left")
        .join(found.withColumnRenamed("node", "_node"), "_node", "left"))
    of_group = checkpointed(grouped.where("component IS NOT NULL").groupBy("component").agg(
        F.min("_least").alias("_group_least"), F.min("_first").alias("_group_first")))
    known = grouped.join(of_group, "component", "left").select(
        "_k1", "_k2", F.coalesce("_group_least", "_least").alias("class_id"),
        F.coalesce("_group_first", "_first").alias("_kept"),
        (F.col("_copies") - 1 + F.coalesce("_linked", F.lit(0))).alias("n_links"))
    return signed.drop("_bands").join(known, ["_k1", "_k2"], "left").select(
        F.col("_id").alias("doc_id"),
        F.when(F.col("_k1").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), "_a", "_h",
        (F.col("_k1").isNull() | (F.col("_kept") == F.struct("_a", "_h"))).alias("_keep"))


def _blocks():
    weight = F.sum(F.col("_grams") + CLASS_WEIGHT)
    return F.ceil(weight / BLOCK_WEIGHT).cast("int").alias("_blocks")


def _cell(group: str, part) -> Column:
    block = F.pmod(F.xxhash64("_node"), "_blocks").cast("int")
    return F.struct(F.col(group).alias("group"), part.cast("int").alias("part"),
                    F.col("_blocks").alias("blocks"), block.alias("block"))


def deal(weighed: DataFrame) -> DataFrame:
    """(_node, _copies, _bands, _cells, _a, _h): the groups in which each class is compared.

    That is its component (part -1, no bands) if it has at most MOST_BLOCKS blocks, else each of its
    buckets with other classes in it (part: the band).
    """
    size = checkpointed(weighed.groupBy("_component").agg(_blocks()))
    sized = weighed.join(size, "_component")
    key = (F.col("_first._a").alias("_a"), F.col("_first._h").alias("_h"))
    whole = sized.where(F.col("_blocks") <= MOST_BLOCKS).select(
        "_node", "_copies", F.lit(None).cast("array<long>").alias("_bands"),
        F.array(_cell("_component", F.lit(-1))).alias("_cells"), *key)
    if size.where(F.col("_blocks") > MOST_BLOCKS).isEmpty():
        return whole
    large = sized.where(F.col("_blocks") > MOST_BLOCKS).drop("_blocks")
    members = large.select("_node", "_grams", F.posexplode("_bands").alias("_part", "_group"))
    buckets = checkpointed(members.groupBy("_part", "_group").agg(
        _blocks(), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    cells = members.join(buckets, ["_part", "_group"]).groupBy("_node").agg(
        F.collect_list(_cell("_group", F.col("_part"))).alias("_cells"))
    return whole.unionByName(
        large.join(cells, "_node").select("_node", "_copies", "_bands", "_cells", *key))


def _compare(docs, dealt, id_column, text_column, width, limit) -> DataFrame:
    """Read the texts of candidate classes, one document of each, and compare them in cells."""
    a, h = row_key(id_column, text_column)
    texts = (docs.select(a.alias("_a"), h.alias("_h"), F.col(text_column).alias("_text"))
             .join(dealt, ["_a", "_h"]))
    names = [x.split()[0] for x in SETS.split(", ")]

    def run(batches):
        for batch in batches:
            for first, block in blocks(batch.column(4)):
                sets = [s.astype("<u8").tobytes() for s in gram_sets(block, width)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, len(block)) for i in range(4)),
                     pa.array(sets, pa.binary())], names)

    sets = in_arrow(texts.dropDuplicates(["_a", "_h"]).select(
        "_node", "_copies", "_bands", "_cells", "_text"), run, SETS)
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other")
    cells = sets.select("_node", "_copies", "_bands", "_set", F.inline("_cells")).select(
        "*", others).select(
        F.col("part").alias("_part"), F.col("group").alias("_group"),
        F.least("block", "_other").alias("_i"), F.greatest("block", "_other").alias("_j"),
        "_node", "_copies", F.col("block").alias("_block"), "_bands", "_set")
    cell = ["_part", "_group", "_i", "_j"]
    together = cells.repartition(*cell).sortWithinPartitions(*cell)
    return in_arrow(together, _cells(limit), CELLS)


def one_of_each(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """The rows and columns of `docs`, one row of each class of near copies.

    The one with the least id stays. Texts that are linked with nothing stay, among them a null and an
    empty text of one id. Of rows that repeat another's id and text, the one whose other columns are
    least stays (columns that have no order, such as maps, do not decide). The columns may have any
    names.
    """
    a, h = row_key(id_column, text_column)
    row_a, row_h, null, keep_a, keep_h, row = unused(
        docs, "_row_a", "_row_h", "_null", "_keep_a", "_keep_h", "_row")
    keep = near_groups(docs, id_column, text_column, **options).where("_keep").select(
        F.col("_a").alias(keep_a), F.col("_h").alias(keep_h)).distinct()
    keyed = docs.withColumns({row_a: a, row_h: h, null: F.col(text_column).isNull()})
    kept = keyed.join(keep, (F.col(row_a) == F.col(keep_a)) & (F.col(row_h) == F.col(keep_h)),
                      "left_semi")
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes
              if c not in (id_column, text_column) and "map<" not in kind and kind != "variant"]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = F.min_by(whole, F.struct(*others)) if others else F.first(whole)
    return kept.groupBy(row_a, row_h, null).agg(least.alias(row)).select(f"{row}.*")
