"""Document fingerprints: SimHash, and a search within a Hamming radius by permuted block tables.

Everything is SQL functions. Terms are pairs of neighbouring words; each occurrence hashes to 64
bits and votes for its ones and against its zeros, so a term weighs as much as it is frequent. The
votes are summed by Spark's own aggregation: one long holds the counts of two bits, 32 apart, in
lanes of 32 bits, so 32 sums count all 64 bits of up to 2^31 terms.

Fingerprints that differ in at most r bits agree in b - r of b blocks of bits. There is a table for
every choice of b - r blocks, keyed by them; a pair within the radius meets in at least one
table and is counted in the first one only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import row_key, text_of, word_list
from .shared import checkpointed

BITS, LANE = 64, 32
LANES = (1 << LANE) + 1
RADIUS, BLOCKS = 3, 5


def term_hashes(text: Column) -> Column:
    """Hashes of all pairs of neighbouring words; of the word itself if there is only one."""
    hashes = F.transform(word_list(text), lambda w: F.xxhash64(w))
    return F.flatten(F.transform(F.array(hashes), lambda h: F.when(
        F.size(h) > 1, F.zip_with(
            F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))),
            F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))),
            lambda x, y: F.xxhash64(x, y))).otherwise(h)))


def _bit(k: int) -> int:
    return 1 << k if k < 63 else -(1 << 63)


def fingerprints(texts: DataFrame) -> DataFrame:
    """(_a, _h, fingerprint) of rows (_a, _h, _text); 0 for a text without words.

    Rows with equal keys have equal texts; together they vote as one of them does. Ties between
    votes count as ones.
    """
    terms = texts.select("_a", "_h", F.explode_outer(term_hashes(F.col("_text"))).alias("_t"))
    counts = terms.groupBy("_a", "_h").agg(F.count("_t").alias("_n"), *[
        F.sum(F.shiftrightunsigned("_t", k).bitwiseAND(F.lit(LANES))).alias(f"_c{k}")
        for k in range(LANE)])

    def voted(k: int) -> Column:
        low, high = F.col(f"_c{k % LANE}").bitwiseAND(F.lit((1 << LANE) - 1)), F.shiftright(
            f"_c{k % LANE}", LANE)
        ones = low if k < LANE else high
        return F.when(ones * 2 >= F.col("_n"), F.lit(_bit(k))).otherwise(F.lit(0))

    value = voted(0)
    for k in range(1, BITS):
        value = value.bitwiseOR(voted(k))
    return counts.select(
        "_a", "_h", F.when(F.col("_n") > 0, value).otherwise(F.lit(0)).alias("fingerprint"))


def likeness(x: Column, y: Column) -> Column:
    """The share of bits that two fingerprints have in common."""
    return 1 - F.bit_count(x.bitwiseXOR(y)) / BITS


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# ---- the next document, without gathering the order in one task ----------------------------------


def followers(rows: DataFrame) -> DataFrame:
    """(_a, _h, _before_a, _before_h, _before_chars): the row before each, in a ring.

    `rows` holds (_null, _a, _h, _chars), in the order of its columns. They are sorted in range
    partitions; a row's place is its place in the partition plus the rows of the partitions before,
    so only one count per partition is summed up in one place.
    """
    ordered = rows.repartitionByRange(F.desc("_null"), "_a", "_h").sortWithinPartitions(
        F.desc("_null"), "_a", "_h")
    # written once: numbers and range bounds must not be computed again
    numbered = checkpointed(ordered.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_row", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    so_far = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(so_far), F.lit(0)).alias("_offset"),
        F.sum("_size").over(Window.partitionBy()).alias("_total"))
    within = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition
    placed = (numbered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
              .withColumn("_place", F.col("_offset") + within))
    before = placed.select(
        F.pmod(F.col("_place") + 1, "_total").alias("_place"), F.col("_a").alias("_before_a"),
        F.col("_h").alias("_before_h"), F.col("_chars").alias("_before_chars"))
    return placed.select("_a", "_h", "_place").join(before, "_place").drop("_place")


def fingerprint_report(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    radius: int = RADIUS, blocks: int = BLOCKS, every: int = 50,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next and n_near.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the
    next document, in ascending order of id (null ids first), equal ids by a hash of the
    text; after the last comes the first. Rows with equal id and text count as one
    document there and get equal rows. Null texts count as empty; a text without words has the
    fingerprint 0. n_near: for ids divisible by `every`, the number of other documents within
    `radius` bits; null for all other rows. Other columns are not read.
    """
    a, h = row_key(id_column, text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), a.alias("_a"), h.alias("_h"),
                       text_of(text_column).alias("_text"))
    ids = (rows.groupBy("_a", "_h").agg(
        F.first(F.col("_id").isNull()).alias("_null"), F.first(F.length("_text")).alias("_chars"),
        F.count(F.lit(1)).alias("_copies")))
    ids = checkpointed(ids)
    link = checkpointed(followers(ids.select("_null", "_a", "_h", "_chars")))
    quarter = F.floor(F.col("_before_chars") / 4).cast("int")
    texts = rows.select("_a", "_h", "_text").dropDuplicates(["_a", "_h"])
    heads = texts.join(link, ["_a", "_h"]).select(
        F.col("_before_a").alias("_a"), F.col("_before_h").alias("_h"),
        F.substring("_text", F.lit(1), quarter).alias("_head"))
    n = F.length("_text")
    edited = F.concat(
        F.substring("_text", F.lit(1), (n - F.floor(n / 4)).cast("int")), F.col("_head"))
    both = texts.join(heads, ["_a", "_h"])
    edited_prints = fingerprints(both.select("_a", "_h", edited.alias("_text")))
    digests = both.select("_a", "_h", n.cast("long").alias("n_chars"),
                          F.sha2(edited.cast("binary"), 256).alias("edited_sha256"))
    prints = checkpointed(
        fingerprints(rows.select("_a", "_h", "_text")).withColumnRenamed("fingerprint", "_print")
        .join(edited_prints.withColumnRenamed("fingerprint", "_edited_print"), ["_a", "_h"])
        .join(digests, ["_a", "_h"]))
    following = prints.join(link, ["_a", "_h"]).select(
        F.col("_before_a").alias("_a"), F.col("_before_h").alias("_h"),
        F.col("_print").alias("_next_print"))
    near = count_near(
        prints.join(ids, ["_a", "_h"]).select(
            "_print", "_copies",
            (~F.col("_null") & (F.pmod("_a", F.lit(every)) == 0)).alias("_query")),
        radius, blocks)
    query = F.col("_id").isNotNull() & (F.pmod("_id", F.lit(every)) == 0)
    return (
        rows.select("_id", "_a", "_h")
        .join(prints.join(following, ["_a", "_h"]), ["_a", "_h"])
        .join(near, "_print", "left")
        .select(
            F.col("_id").alias("doc_id"), "n_chars", "edited_sha256",
            as_hex(F.col("_print")).alias("fingerprint"),
            as_hex(F.col("_edited_print")).alias("edited_fingerprint"),
            likeness(F.col("_print"), F.col("_edited_print")).alias("near_edited"),
            likeness(F.col("_print"), F.col("_next_print")).alias("near_next"),
            F.when(query, F.col("_within") - 1).alias("n_near"))
    )


# ---- search within a radius ----------------------------------------------------------------------


def block_masks(radius: int, blocks: int) -> list[int]:
    """For each table the bits that it is keyed by, as signed 64-bit masks."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("there must be more blocks than the radius")
    bounds = [BITS * i // blocks for i in range(blocks + 1)]
    own = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(bounds, bounds[1:])]
    masks = [sum(own[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    return [m - (1 << BITS) if m >> 63 else m for m in masks]


def near_pairs(
    prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """(_one, _other, _distance): pairs of a query fingerprint and one within the radius, itself too.

    `queries` and `prints` hold distinct values of _print; a pair appears once per direction in which
    its first value is a query.
    """
    masks = block_masks(radius, blocks)

    def keyed(rows, name):
        keys = F.array(*[
            F.struct(F.lit(i).alias("_table"), F.col("_print").bitwiseAND(F.lit(m)).alias("_block"))
            for i, m in enumerate(masks)])
        return rows.select(F.col("_print").alias(name), F.inline(keys))

    differ = F.col("_one").bitwiseXOR(F.col("_other"))
    first_table = F.lit(len(masks))
    for i in reversed(range(len(masks))):
        agree = differ.bitwiseAND(F.lit(masks[i])) == 0
        first_table = F.when(agree, F.lit(i)).otherwise(first_table)
    q = keyed(queries, "_one").alias("q")
    d = keyed(prints, "_other").alias("d")
    found = q.join(d, (F.col("q._table") == F.col("d._table"))
                   & (F.col("q._block") == F.col("d._block"))
                   & (F.bit_count(differ) <= radius) & (first_table == F.col("d._table")))
    return found.select("_one", "_other", F.bit_count(differ).alias("_distance"))


def near_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS,
    blocks: int = BLOCKS,
) -> tuple[DataFrame, DataFrame]:
    """All near documents, as two tables: pairs of fingerprints, and the documents of a fingerprint.

    Pairs: fingerprint, near_fingerprint and distance; every pair of different fingerprints within
    `radius` bits once, the one with the smaller number (signed) first. Members: fingerprint, doc_id and
    n_rows, the rows of that id and text. Documents are near if they are members of one fingerprint or of
    the two of a pair, so copies are never paired. Ids may be null. Other columns are not read.
    """
    a, h = row_key(id_column, text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), a.alias("_a"), h.alias("_h"),
                       text_of(text_column).alias("_text"))
    ids = rows.groupBy("_a", "_h").agg(
        F.first("_id").alias("doc_id"), F.count(F.lit(1)).alias("n_rows"))
    members = checkpointed(
        fingerprints(rows.select("_a", "_h", "_text")).join(ids, ["_a", "_h"])
        .select(F.col("fingerprint").alias("_print"), "doc_id", "n_rows"))
    distinct = checkpointed(members.select("_print").distinct())
    pairs = near_pairs(distinct, distinct, radius, blocks).where(F.col("_one") < F.col("_other"))
    return (
        pairs.select(as_hex(F.col("_one")).alias("fingerprint"),
                     as_hex(F.col("_other")).alias("near_fingerprint"),
                     F.col("_distance").alias("distance")),
        members.select(as_hex(F.col("_print")).alias("fingerprint"), "doc_id", "n_rows"))


def count_near(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(_print, _within): for query fingerprints, the documents within the radius, itself included.

    `prints`: (_print, _copies, _query) by document. Equal fingerprints are one row with a count
    before any table is built, so copies are never paired.
    """
    distinct = checkpointed(prints.groupBy("_print").agg(
        F.sum("_copies").alias("_copies"), F.max("_query").alias("_query")))
    pairs = near_pairs(distinct.select("_print"), distinct.where("_query"), radius, blocks)
    copies = distinct.select(F.col("_print").alias("_other"), "_copies")
    return pairs.join(copies, "_other").groupBy(F.col("_one").alias("_print")).agg(
        F.sum("_copies").alias("_within"))
