from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark import session
from tidemark.sources import (
    SCHEMAS, Sources, load_testdata, read_orders_csv, read_tables, replace_parts, write_csv,
    write_table,
)

ORDERS = [("V", "i", 1, datetime(2001, 1, 2, 3, 4, 5), 1, "l1"),
          ("NaN", "j", 2, datetime(2001, 1, 3), 6, "l2")]


@pytest.mark.parametrize("sep", [",", "\t"])
def test_csv_round_trip(spark, tmp_path, sep):
    frame = spark.createDataFrame(ORDERS, SCHEMAS["cohort_orders"])
    path = str(tmp_path / "orders")
    write_csv(frame, path, sep)
    got = read_orders_csv(spark, path, sep)
    assert got.schema == frame.schema
    assert rows(got) == rows(frame)


def test_write_table_overwrites(spark, tmp_path):
    path = str(tmp_path / "report")
    frame = spark.createDataFrame([(2000, 1), (2001, 2)], "event_year int, x int")
    write_table(frame, path=path, partition_by=("event_year",))
    write_table(frame.filter("event_year = 2001"), path=path, partition_by=("event_year",))
    assert rows(spark.read.parquet(path), "event_year", "x") == [(2001, 2)]


YEARS = "x int, event_year int, y string"


@pytest.fixture(params=["path", "name"])
def result_table(request, spark, tmp_path):
    """A result table of two years, and how to read it."""
    if request.param == "path":
        place = {"path": str(tmp_path / "report")}
        read = lambda: spark.read.parquet(place["path"])
    else:
        spark.sql(f"create database if not exists reports location '{tmp_path}/reports'")
        place = {"name": "reports.by_year"}
        read = lambda: spark.table(place["name"])
    replace_parts(spark.createDataFrame(
        [(1, 2000, "a"), (2, 2001, "b"), (3, 2001, "c"), (4, None, "d")], YEARS), **place)
    yield place, lambda: rows(read(), "event_year", "x", "y")
    spark.sql("drop database if exists reports cascade")


def test_years_are_replaced_one_by_one(spark, result_table):
    place, read = result_table
    before = [(None, 4, "d"), (2000, 1, "a"), (2001, 2, "b"), (2001, 3, "c")]
    assert read() == before
    new = spark.createDataFrame([("e", 2001, 5), ("f", 2002, 6)], "y string, event_year int, x int")
    replace_parts(new, **place)  # columns go by name
    assert read() == [(None, 4, "d"), (2000, 1, "a"), (2001, 5, "e"), (2002, 6, "f")]
    replace_parts(new.limit(0), **place)
    assert len(read()) == 4
    replace_parts(spark.createDataFrame([(7, None, "g")], YEARS), **place)
    assert read()[0] == (None, 7, "g")


def test_a_failing_run_keeps_the_old_years(spark, result_table):
    place, read = result_table
    before = read()
    failing = spark.range(0, 1000, 1, 4).select(
        F.col("id").cast("int").alias("x"), (F.col("id") % 2 + 2001).cast("int").alias("event_year"),
        F.when(F.col("id") == 990, F.raise_error(F.lit("lost"))).otherwise("z").alias("y"))
    with pytest.raises(Exception, match="lost"):
        replace_parts(failing, **place)
    assert read() == before


def test_other_partitions_are_refused(spark, tmp_path):
    spark.sql(f"create database if not exists reports location '{tmp_path}/reports'")
    frame = spark.createDataFrame([(1, 2000, "a")], YEARS)
    write_table(frame, name="reports.by_y", partition_by=("y",))
    with pytest.raises(ValueError, match="partitioned by"):
        replace_parts(frame, name="reports.by_y")
    spark.sql("drop database reports cascade")


def test_catalog_tables(spark, tmp_path):
    spark.sql(f"create database if not exists shop location '{tmp_path}/shop'")
    for name, schema in SCHEMAS.items():
        write_table(spark.createDataFrame([], schema), name=f"shop.{name}")
    tables = read_tables(spark, "shop")
    assert isinstance(tables, Sources)
    assert tables.items.columns == [c.split()[0] for c in SCHEMAS["items"].split(", ")]
    spark.sql("drop database shop cascade")


def test_temp_view(spark):
    spark.createDataFrame(ORDERS, SCHEMAS["cohort_orders"]).createOrReplaceTempView("orders_v")
    assert spark.table("orders_v").count() == 2
    spark.catalog.dropTempView("orders_v")


@pytest.mark.parametrize("name", SCHEMAS)
def test_every_testdata_table_has_rows_and_columns(spark, sf_dir, name):
    table = getattr(load_testdata(spark, sf_dir), name)
    assert sorted(table.columns) == sorted(c.split()[0] for c in SCHEMAS[name].split(", "))
    assert not table.isEmpty()


def test_staging_writes_to_the_shared_folder_and_drops_it(spark):
    frame = spark.range(10).withColumn("x", F.col("id") % 3)
    with session.Staging(spark) as staging:
        staged = staging.put(frame, "numbers")
        assert staging.path.startswith(spark.conf.get("spark.checkpoint.dir"))
        assert all(staging.path in f for f in staged.inputFiles())
        assert rows(staged) == rows(frame)
        folder = Path(staging.path)
        assert folder.exists()
    assert not folder.exists()


def test_without_a_shared_folder_the_plan_stays_lazy(spark, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: None)
    frame = spark.range(3)
    with session.Staging(spark) as staging:
        assert staging.put(frame, "numbers") is frame


@pytest.fixture
def own_settings(spark):
    """Settings a test changes, put back behind it."""
    names = (session.PARTITIONS, session.INITIAL, "spark.sql.session.timeZone")
    before = {n: spark.conf.getAll.get(n) for n in names}
    yield spark.conf
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_settings_of_the_session_stay(spark, own_settings):
    own_settings.set("spark.sql.session.timeZone", "Europe/Paris")
    own_settings.set(session.PARTITIONS, "7")
    own_settings.unset(session.INITIAL)
    session.configure(spark)
    assert own_settings.get("spark.sql.session.timeZone") == "Europe/Paris"
    assert own_settings.get(session.PARTITIONS) == "7"
    assert session.INITIAL not in own_settings.getAll


def test_many_partitions_where_the_session_names_none(spark, monkeypatch):
    class Conf(dict):
        getAll = property(lambda self: self)

        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf()

    session.configure(Session)
    assert Session.conf[session.INITIAL] == str(session.INITIAL_PARTITIONS)
    assert set(session.RUNTIME_SETTINGS) < set(Session.conf)


def test_shuffle_partitions_follow_the_data(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    session.configure(spark, shuffled_bytes=10 * 1024**4)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "40960"
    spark.conf.set("spark.sql.shuffle.partitions", before)
