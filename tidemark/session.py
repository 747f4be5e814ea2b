"""Session settings and staged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Skewed join partitions are split at run time even where that costs a shuffle:
# a third of all rows on one item must not end in one task.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}
SHUFFLE_PARTITION_BYTES = 256 * 1024**2
# Without a size: enough shuffle partitions for half a terabyte at 256 MB each. Run-time
# coalescing merges those that stay small.
INITIAL_PARTITIONS = 2000
PARTITIONS = "spark.sql.shuffle.partitions"
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def configure(spark: SparkSession, shuffled_bytes: int | None = None) -> SparkSession:
    """Set the runtime settings the operators rely on, where the session has none of its own.

    `shuffled_bytes`, the size of the pruned order lines, sets the number of shuffle
    partitions so that each fits in a task's memory. Without it the session's own
    number stays, and if it has none, a high one is set.
    """
    own = spark.conf.getAll
    for key, value in RUNTIME_SETTINGS.items():
        if key not in own:
            spark.conf.set(key, value)
    if shuffled_bytes is not None:
        partitions = max(1, -(-shuffled_bytes // SHUFFLE_PARTITION_BYTES))
        spark.conf.set(PARTITIONS, str(partitions))
    elif PARTITIONS not in own and INITIAL not in own:
        spark.conf.set(INITIAL, str(INITIAL_PARTITIONS))
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the session names in spark.checkpoint.dir, or None."""
    return spark.conf.get("spark.checkpoint.dir", None)


class Staging:
    """Intermediate results written once as tables of a shared folder; `close` drops them.

    `folder` is the session's checkpoint folder unless given. Readers get a columnar scan
    with pruning, and a lost executor costs no recomputation. Without a folder the plans stay
    lazy, in every kind of session: same rows, computed again by each reader.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        folder = folder or shared_folder(spark)
        self.path = f"{folder}/tidemark-{uuid.uuid4().hex}" if folder else None

    def put(self, df: DataFrame, name: str) -> DataFrame:
        if self.path is None:
            return df
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Drop all tables; results that still read them can no longer be computed."""
        if self.path is not None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        self.close()
