"""Reading the input tables and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import SCHEMAS, Sources


OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


def read_tables(spark: SparkSession, database: str) -> Sources:
    """All nine tables from a catalog database."""
    return Sources(**{name: spark.table(f"{database}.{name}") for name in SCHEMAS})


def read_orders_csv(
    spark: SparkSession, path: str, sep: str = ",", schema: str = SCHEMAS["cohort_orders"]
) -> DataFrame:
    """Order lines from CSV, or TSV with `sep="\\t"`; files are split across tasks."""
    return spark.read.csv(path, sep=sep, header=True, schema=schema)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def write_table(
    df: DataFrame, name: str | None = None, path: str | None = None, partition_by: tuple = ()
) -> None:
    """Replace a result table, by catalog name or by path."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if name is not None:
        writer.saveAsTable(name)
    else:
        writer.parquet(path)


def replace_parts(
    df: DataFrame, name: str | None = None, path: str | None = None,
    partition_by: tuple = ("event_year",),
) -> None:
    """Replace the parts of a result table that `df` has rows of, by year unless told otherwise.

    Parts without rows in `df` stay as they are. The new files are moved in when all are written, so a
    run that fails leaves every part of the old table. A catalog table is made if it is not there;
    one that exists must be partitioned by the same columns, and gets its columns by name.
    """
    if name is None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            *partition_by).parquet(path)
        return
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        df.write.partitionBy(*partition_by).saveAsTable(name)
        return
    parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    if parts != list(partition_by):
        raise ValueError(f"{name} is partitioned by {parts}, not by {list(partition_by)}")
    # An insert into a table knows the mode from the session only, which gets its own back.
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "dynamic")
    try:
        # by position; the table has its partition columns last
        df.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(OVERWRITE_MODE, before)
