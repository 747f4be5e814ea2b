"""Token counts from flat token files: a vectorised search for end-of-document ids.

The files hold little-endian 16-bit ids and nothing else: no index, no lengths. Every file is
searched in blocks, whose byte ranges are the units of work; a block reports where its separators are and how many ids it has. What
a block cannot know is where the document that reaches into it began: a running maximum of the
last separator before it (a prefix scan over the blocks of a file) tells that, and a running
count tells which document of the file it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import in_arrow
from .stored import opened
from .tokens import END_OF_TEXT, as_16_bits, token_ids

BLOCK_TOKENS, ID_BYTES = 1 << 16, 2
# Blocks of one byte range, and bytes that one task reads.
RANGE_BLOCKS, TASK_BYTES = 8, 16 << 20
# Bytes of a record that the writer puts together, and records of a file: a file has about
# 4 MB, more only if single documents are longer.
RECORD_BYTES, FILE_RECORDS = 1 << 18, 16


def write_token_files(
    docs: DataFrame, path: str, text_column: str = "text", vocabulary: str | None = None,
    end_id: int = END_OF_TEXT,
) -> None:
    """Write every text's ids and an end id behind each, 16 bits an id, to flat files.

    A null text counts as empty. The special token's string in a text is ordinary text, so
    the end id separates documents and is nothing else. Spark's text writer puts the
    separator's two bytes behind every record; a record is as many whole documents as make up
    RECORD_BYTES, without its last separator.
    """
    separator = np.array([end_id], "<u2").tobytes()

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                ids = token_ids(text.as_py() or "", vocabulary, special=False)
                parts.append(as_16_bits(ids).tobytes())
                size += len(parts[-1]) + len(separator)
                if size >= RECORD_BYTES:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([separator.join(parts)], pa.binary())], ["value"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([separator.join(parts)], pa.binary())], ["value"])

    records = in_arrow(docs.select(F.col(text_column).alias("_text")), run, "value binary")
    (records.select(F.col("value").cast("string")).write
        .option("encoding", "ISO-8859-1").option("lineSep", separator.decode("latin-1"))
        .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def scan_blocks(
    spark: SparkSession, path: str, end_id: int = END_OF_TEXT, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """One row per block of a file: its place, size and the places of its separators.

    `path` tells files apart; `shard` is the file's name without the random part that Spark's writers
    add, so the same table gives the same shards. Files are only listed; their byte ranges, of
    RANGE_BLOCKS blocks each, are dealt to tasks, which read a range at a time whatever the size
    of the file. A file that ends within an id is an error.
    """
    range_bytes = RANGE_BLOCKS * block_tokens * ID_BYTES
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    total = files.agg(F.sum("length")).first()[0] or 0
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(
        F.lit(0), F.col("length") - 1, F.lit(range_bytes))).alias("first")).repartition(
        max(1, -(-total // TASK_BYTES)))

    def run(batches):
        for batch in batches:
            for place, length, low in zip(*(c.to_pylist() for c in batch.columns)):
                if length % ID_BYTES:
                    raise ValueError(f"{place} ends within an id")
                store, inner = opened(place)
                with store.open_input_file(inner) as file:
                    file.seek(low)
                    ids = np.frombuffer(file.read(min(range_bytes, length - low)), "<u2")
                for first in range(0, len(ids), block_tokens):
                    part = ids[first: first + block_tokens]
                    at = np.flatnonzero(part == end_id)
                    start = low // ID_BYTES + first
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([place]), pa.array([start // block_tokens], pa.int64()),
                         pa.array([start], pa.int64()), pa.array([len(part)], pa.int64()),
                         pa.array([(at + start).tolist()], pa.list_(pa.int64()))],
                        ["path", "block", "first", "n_tokens", "separators"])

    file_name = F.element_at(F.split("path", "/"), -1)
    name = F.regexp_replace(file_name, "-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "")
    return in_arrow(
        ranges, run, "path string, block long, first long, n_tokens long, separators array<long>",
    ).select("path", name.alias("shard"), "block", "first", "n_tokens", "separators")


def count_tokens(
    spark: SparkSession, path: str, end_id: int = END_OF_TEXT, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """One row per document of the files: shard, doc_index in it, start, n_tokens, terminated.

    n_tokens is without the separator. Two separators in a row, or one at a file's
    start, enclose an empty document. Ids behind a file's last separator are a document that is
    not terminated; an empty file has no documents. A document may span any number of blocks
    but not files. Files of one name in several folders are shards of one name, each counted by itself.
    """
    blocks = scan_blocks(spark, path, end_id, block_tokens)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("path").orderBy("block")
    carried = blocks.select(
        "shard", "separators", (F.col("first") + F.col("n_tokens")).alias("stop"),
        # the first id of the document that reaches into the block
        (F.coalesce(F.max(F.array_max("separators")).over(before), F.lit(-1)) + 1).alias("since"),
        F.coalesce(F.sum(F.size("separators")).over(before), F.lit(0)).alias("documents_before"),
        F.lead("block").over(ahead).isNull().alias("is_last"),
    )
    # separators close documents; the end of the file closes one that has none
    last_id = F.coalesce(F.array_max("separators"), F.col("since") - 1)
    rest = F.when(F.col("is_last") & (F.col("stop") - 1 > last_id), F.array("stop"))
    ends = carried.select(
        "*", F.concat("separators", F.coalesce(rest, F.array().cast("array<long>"))).alias("ends"),
        F.size("separators").alias("n_separators"),
    )
    return ends.select(
        "shard", "documents_before", "since", "ends", "n_separators", F.posexplode("ends"),
    ).select(
        "shard", (F.col("documents_before") + F.col("pos")).alias("doc_index"),
        F.when(F.col("pos") == 0, F.col("since"))
        .otherwise(F.get("ends", F.col("pos") - 1) + 1).alias("start"),
        "col", (F.col("pos") < F.col("n_separators")).alias("terminated"),
    ).select(
        "shard", "doc_index", "start", (F.col("col") - F.col("start")).alias("n_tokens"),
        "terminated",
    )
