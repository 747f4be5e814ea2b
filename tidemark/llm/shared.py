"""Helpers that several operators of this package use."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# One Python worker works on at most about so many code points at a time (a longer text is
# a block of its own), so that its memory does not depend on the size of Arrow batches and its
# arrays stay in the processor's cache.
BLOCK_CHARS = 1 << 16
SLICE_ROWS = 256
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or the one checkpoints go to.

    Only a session on one machine may have neither: a folder is made for it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not context.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_at_exit(spark: SparkSession, path: str) -> str:
    """Delete the path when the process ends with its session alive; a lazy result may read it."""
    def run():
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            drop(spark, path)

    atexit.register(run)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage; the rows are written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def in_arrow(df: DataFrame, work, schema) -> DataFrame:
    """`df.mapInArrow` in batches that suit texts, unless the session has a batch size of its own.

    Spark's default of 10,000 rows would hold tens of megabytes of text in the JVM, on its way
    and in Python at the same time.
    """
    if BATCH_SETTING not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(work, schema)


def blocks(texts: pa.Array, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts in blocks of at most `limit` code points: first row, texts (null: '').

    Only some rows of the Arrow column are Python strings at a time.
    """
    first, block, size = 0, [], 0
    sliced = (texts.slice(at, SLICE_ROWS).to_pylist() for at in range(0, len(texts), SLICE_ROWS))
    for row, text in enumerate(chain.from_iterable(sliced)):
        text = text or ""
        if block and size + len(text) > limit:
            yield first, block
            first, block, size = row, [], 0
        block.append(text)
        size += len(text)
    if block:
        yield first, block


def map_texts(
    df: DataFrame, id_column: str, text_column: str, schema: str,
    work: Callable[[list, list[str]], pa.RecordBatch], limit: int = BLOCK_CHARS,
) -> DataFrame:
    """Apply `work(ids, texts)` to blocks of rows; only the two columns are read.

    `work` returns a record batch of `schema`. Each block is independent of the others.
    """
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, block in blocks(batch.column(1), limit):
                yield work(ids.slice(first, len(block)), block)

    return in_arrow(df.select(
        F.col(id_column).alias("_id"), F.col(text_column).alias("_text")), run, schema)
