"""Benchmark decontamination: size-partitioned MinHash containment search, all in SQL functions.

An item is found in a document if the document holds at least a threshold's share of the item's
distinct shingles. Documents are far longer than items, so signatures of equal length for both
would hardly ever agree. Instead the items are partitioned by size (powers of two) and an item
of q shingles is sketched by its k = q - ceil(threshold * q) + 1 smallest shingle hashes. A
document that lacks all k of them holds at most q - k < threshold * q shingles of the item, so no
match is lost. Every size partition is searched by itself: it has a cut, the largest hash in its
sketches, and a filter of bounded size over their hashes, and a document's hashes that are above the
one or not in the other are dropped before they become rows. The documents that hit a sketch are
written down first, and only their texts are verified, on the shingles themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import row_key, shingle_hashes, shingle_texts, text_of, unused, word_list
from .shared import checkpointed

WIDTH, THRESHOLD = 5, 0.8
# Sketch or shingle rows of the items up to which they are broadcast (some 100 bytes a row);
# beyond, Spark chooses a shuffled join. The result is the same.
BROADCAST_ROWS = 500_000
# Slots of a size partition's filter: so many for each hash, up to a bound (256 KB).
SLOTS_A_HASH, MOST_SLOTS = 64, 1 << 21


def _needed(size, threshold: float):
    return F.ceil(F.round(size * threshold, 9))


def item_texts(items: DataFrame, item_column: str, text_column: str, all_items: bool) -> DataFrame:
    """(item, item_text, _words): the different texts of every id; without an id if `all_items`."""
    rows = items.select(F.col(item_column).alias("item"), text_of(text_column).alias("_text"))
    return rows.where(F.lit(all_items) | F.col("item").isNotNull()).select(
        "item", F.xxhash64("_text").alias("item_text"), word_list(F.col("_text")).alias("_words")
    ).dropDuplicates(["item", "item_text"])


def item_shingles(texts: DataFrame, width: int) -> DataFrame:
    """(item, item_text, n_shingles, shingle): distinct shingles of each text of `item_texts`.

    An item is an id and a text: texts that share an id are not mixed. A text with fewer words
    than a shingle has none here.
    """
    own = texts.select("item", "item_text",
                       F.array_distinct(shingle_texts(F.col("_words"), width)).alias("_all"))
    return own.select("item", "item_text", F.size("_all").cast("long").alias("n_shingles"),
                      F.explode("_all").alias("shingle"))


def short_items(texts: DataFrame, width: int) -> DataFrame:
    """(item, item_text, n_words, shingle): texts of 1 to `width` - 1 words, one shingle each."""
    n = F.size("_words")
    return texts.where((n > 0) & (n < width)).select(
        "item", "item_text", n.alias("n_words"), F.array_join("_words", " ").alias("shingle"))


def _hash_of(shingle: str, width: int):
    words = F.split(shingle, " ")
    return F.get(shingle_hashes(words, width), F.lit(0))


def item_sketches(shingles: DataFrame, threshold: float, width: int) -> DataFrame:
    """(size_class, item, item_text, hash): the sketch of every item, smallest hashes first.

    An item's hashes are gathered in one row: they are as many as the item has words.
    """
    hashed = shingles.select("item", "item_text", "n_shingles", _hash_of("shingle", width).alias("hash"))
    k = F.col("n_shingles") - _needed(F.col("n_shingles"), threshold) + 1
    return (
        hashed.groupBy("item", "item_text", "n_shingles")
        .agg(F.array_sort(F.collect_set("hash")).alias("all"))
        .select(F.floor(F.log2("n_shingles")).cast("int").alias("size_class"), "item", "item_text",
                F.explode(F.slice("all", F.lit(1), k.cast("int"))).alias("hash"))
    )


def _filters(sketches: DataFrame) -> list[tuple[int, int, int, list[int]]]:
    """For each size class its number, cut, slots and the marked slots in words of 64 bits.

    There are at most 32 classes; the filters' bound is what passes the driver.
    """
    sizes = sketches.groupBy("size_class").agg(
        F.max("hash").alias("cut"), F.countDistinct("hash").alias("n")).orderBy("size_class")
    found = []
    for row in sizes.collect():
        slots = min(MOST_SLOTS, 1 << max(6, (SLOTS_A_HASH * row["n"] - 1).bit_length()))
        slot = _slot(F.col("hash"), slots)
        words = [0] * (slots // 64)
        marked = sketches.where(F.col("size_class") == row["size_class"]).groupBy(
            F.shiftright(slot, 6).alias("word")).agg(F.bit_or(_bit(slot)).alias("mask"))
        for word, mask in marked.collect():
            words[word] = mask
        found.append((row["size_class"], row["cut"], slots, words))
    return found


def _slot(hashed, slots: int):
    return F.xxhash64(hashed).bitwiseAND(F.lit(slots - 1))


def _bit(slot):
    return F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))


def _hits(hashes, filters):
    """(size_class, hash) for every class whose cut and filter a hash passes."""
    def of(number, cut, slots, words):
        # one literal, which the optimizer folds into an array
        marked = F.split(F.lit(",".join(map(str, words))), ",").cast("array<long>")

        def passes(x):
            slot = _slot(x, slots)
            word = F.get(marked, F.shiftright(slot, 6).cast("int"))
            return (x <= F.lit(cut)) & (word.bitwiseAND(_bit(slot)) != 0)

        return F.transform(F.filter(hashes, passes), lambda x: F.struct(
            F.lit(number).alias("size_class"), x.alias("hash")))

    return F.concat(*[of(*f) for f in filters])


def find_items(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
    width: int = WIDTH, all_items: bool = False,
) -> DataFrame:
    """One row per document and item in it: doc_id, item_id, n_shared, n_shingles, containment,
    and the row key (_a, _h) of the document.

    Null texts count as empty and hold nothing; documents with equal id and text count once;
    ids may be null. Every different text of an item id is an item of its own, equal ones count
    once. `all_items`: also items without an id (item_id is null) and those with fewer than `width`
    words, which are one shingle of all their words; else both are in no document. Other columns
    of either table are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    named = checkpointed(item_texts(items, item_column, item_text, all_items))
    shingles = checkpointed(item_shingles(named, width))
    sketches = checkpointed(item_sketches(shingles, threshold, width))
    filters = _filters(sketches)
    probes = sketches.select("size_class", "hash").distinct()
    small = probes.count() <= BROADCAST_ROWS
    a, h = row_key(id_column, text_column)
    texts = docs.select(F.col(id_column).cast("long").alias("_id"), a.alias("_a"), h.alias("_h"),
                        text_of(text_column).alias("_text"))
    # A hash finds its candidates whichever item it belongs to: the documents to verify.
    words = word_list(F.col("_text"))
    if filters:
        hits = texts.select("_a", "_h", F.inline(F.transform(
            F.array(shingle_hashes(words, width)), lambda all_: _hits(all_, filters))[0]))
        candidates = checkpointed(hits.join(
            F.broadcast(probes) if small else probes, ["size_class", "hash"]
        ).select("_a", "_h").distinct())
    else:
        candidates = checkpointed(texts.select("_a", "_h").limit(0))
    if candidates.count() <= BROADCAST_ROWS:
        candidates = F.broadcast(candidates)
    held = texts.join(candidates, ["_a", "_h"], "left_semi").select(
        "_id", "_a", "_h",
        F.explode(F.array_distinct(shingle_texts(words, width))).alias("shingle"))
    few = shingles.count() <= BROADCAST_ROWS
    shared = held.join(F.broadcast(shingles) if few else shingles, "shingle")
    found = (
        shared.distinct().groupBy("_id", "_a", "_h", "item", "item_text", "n_shingles")
        .agg(F.count(F.lit(1)).alias("n_shared"))
        .where(F.col("n_shared") >= _needed(F.col("n_shingles"), threshold))
        .select("_id", "_a", "_h", "item", "n_shared", "n_shingles")
    )
    if all_items:
        found = _with_short(found, texts, short_items(named, width))
    return found.select(
        F.col("_id").alias("doc_id"), F.col("item").alias("item_id"), "n_shared", "n_shingles",
        (F.col("n_shared") / F.col("n_shingles")).alias("containment"), "_a", "_h")


def _with_short(found: DataFrame, texts: DataFrame, short: DataFrame) -> DataFrame:
    """`found` and a row for every short item that a text holds as a run of words."""
    # one row per number of words, fewer than a shingle has
    widths = {r["n_words"]: r["n"] for r in short.groupBy("n_words").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if not widths:
        return found
    # words hold no blanks, so runs of different numbers of words differ
    runs = F.flatten(F.transform(F.array(word_list(F.col("_text"))), lambda words: F.flatten(
        F.array(*[shingle_texts(words, n) for n in sorted(widths)]))))
    few = sum(widths.values()) <= BROADCAST_ROWS
    held = texts.select("_id", "_a", "_h", F.explode(F.array_distinct(runs)).alias("shingle"))
    hits = held.join(F.broadcast(short) if few else short, "shingle").select(
        "_id", "_a", "_h", "item", "item_text").distinct()
    one = F.lit(1).cast("long")
    return found.unionByName(hits.select(
        "_id", "_a", "_h", "item", one.alias("n_shared"), one.alias("n_shingles")))


def without_items(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    **options,
) -> DataFrame:
    """The rows and columns of `docs` that hold no item, short ones and those without an id included.

    Rows that repeat stay or go together. The columns may have any names.
    """
    options = {"all_items": True, **options}
    found = find_items(docs, items, id_column, text_column, **options)
    a, h = row_key(id_column, text_column)
    gone_a, gone_h = unused(docs, "_gone_a", "_gone_h")
    gone = found.select(F.col("_a").alias(gone_a), F.col("_h").alias(gone_h)).distinct()
    return docs.join(gone, (a == F.col(gone_a)) & (h == F.col(gone_h)), "left_anti")


def least_shared(n_shingles: int, threshold: float = THRESHOLD) -> int:
    """How many of an item's shingles a document must hold."""
    return math.ceil(round(n_shingles * threshold, 9))
