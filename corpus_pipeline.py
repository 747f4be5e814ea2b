"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes the documents that the one before kept, and what it decides takes effect: toxic
documents go, one document of each class of near copies stays, documents that hold a benchmark item
go, secrets are masked in the text, and the rest is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bin_slack, contamination, ngram_join, secrets, toxicity
from tidemark.llm.shared import drop, drop_at_exit, read, shared_path

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM; learned from all marked documents.

    Null and empty texts have the score of a text without any feature, and stay unless the marks
    say that most texts are toxic. Repeated rows stay or go together; without marks nothing goes.
    """
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.keep_clean(docs, model, threshold=TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies.

    Null and empty texts are copies of nothing. Of rows with equal id and text, the least stays.
    """
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none.

    Items without an id and items of one to four words count too: a one-word item removes every
    document with that word. Without items all rows stay, repeated ones too.
    """
    return contamination.without_items(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by their kind; null texts stay null."""
    return secrets.masked_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence; a null or empty text is its end id alone."""
    return bin_slack.pack_bin_slack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("packing", pack),
]
# A trained classifier and a tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`; each stage's rows are written once and read again.

    A stage's table is dropped once the next one is written, and the last, which the result reads,
    when the process ends. An empty table gives no rows; columns besides doc_id and text may be any.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    *filters, (_, last) = STAGES
    for name, stage in filters:
        path = drop_at_exit(spark, shared_path(spark, name.replace(" ", "-")))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop(spark, before)
        before = path
    return last(spark, docs, sf_dir)
