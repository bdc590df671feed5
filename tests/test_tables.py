import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from kilowatch.operators import ingest
from kilowatch.plans import queries as Q
from kilowatch.sources import streams, tables

AS_OF = "2024-01-20 12:34:56"
NAMES = ("energy_consumption", "frequency", "volt1", "volt2")


@pytest.fixture(scope="module")
def month(readings):
    rows = [
        (f"2024-01-{day:02d} {hour:02d}:00:00", owner, name, day * 100.0 + hour)
        for day in range(1, 31)
        for hour in range(24)
        for owner in ("7", "11")
        for name in NAMES
    ]
    return readings(rows)


@pytest.fixture(scope="module")
def stored(spark, month, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("table") / "readings")
    tables.write_batch(month, path, "w", 0)
    return path


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_round_trip(spark, month, stored):
    back = tables.read_readings(spark, stored)
    assert back.schema.simpleString() == month.select(*back.columns).schema.simpleString()
    assert back.exceptAll(month.select(*back.columns)).isEmpty() and back.count() == month.count()


def test_a_batch_written_again_replaces_itself(spark, month, tmp_path):
    path = str(tmp_path / "readings")
    for _ in range(2):
        tables.write_batch(month, path, "w", 3)
    tables.write_batch(month.limit(10), path, "other", 3)
    assert tables.read_readings(spark, path).count() == month.count() + 10


def test_only_the_days_asked_for_are_listed(spark, stored):
    week = tables.read_readings(spark, stored, date(2024, 1, 28), date(2024, 2, 3))
    assert sorted({str(row.reading_date) for row in week.select("reading_date").distinct().collect()}) == [
        "2024-01-28",
        "2024-01-29",
        "2024-01-30",
    ]
    assert all("reading_date=2024-01-2" in name or "reading_date=2024-01-30" in name for name in week.inputFiles())
    assert week.count() == 3 * 24 * 2 * len(NAMES)


def test_queries_over_the_table_equal_those_over_the_readings(spark, month, stored):
    table = tables.read_readings(spark, stored)
    for query in (Q.energy_consumption, Q.ghg_emission, Q.voltage_stats, Q.frequency):
        for interval in ("hr", "day", "year"):
            mine, theirs = query(table, AS_OF, interval), query(month, AS_OF, interval)
            assert mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()
    assert Q.energy_stats(table, AS_OF).exceptAll(Q.energy_stats(month, AS_OF)).isEmpty()


def test_dates_measures_and_columns_are_pruned(spark, stored):
    table = tables.read_readings(spark, stored)
    text = plan(Q.voltage_stats(table, AS_OF, "hr"))
    assert re.search(r"PartitionFilters: \[[^\]]*reading_date#\d+ >= 2024-01-18", text)
    assert "In(value_name, [volt1,volt2,volt3])" in text and "GreaterThanOrEqual(event_time,2024-01-19" in text
    assert re.search(r"ReadSchema: struct<event_time:timestamp,owner_name:string,value_name:string,value:double>", text)
    text = plan(Q.energy_consumption(table, AS_OF, "day", owner="11"))
    assert "EqualTo(owner_name,11)" in text and "EqualTo(value_name,energy_consumption)" in text
    text = plan(Q.ghg_emission(table, AS_OF, "day"))
    assert "GreaterThanOrEqual(time,2024-01-01 00:00:00)" in text and "LessThanOrEqual(time,2024-01-20 12:34:56)" in text


def test_only_the_days_asked_for_are_read(spark, stored):
    table = tables.read_readings(spark, stored)
    files = Q.voltage_stats(table, AS_OF, "hr").inputFiles()
    assert len(files) >= 30
    scanned = table.filter((F.col("reading_date") >= "2024-01-19") & (F.col("reading_date") <= "2024-01-20"))
    assert scanned.select(F.input_file_name()).distinct().count() == 2


def test_one_shuffle_of_pre_aggregated_rows(spark, stored):
    table = tables.read_readings(spark, stored)

    def exchanges(frame):
        return plan(frame).count("Exchange hashpartitioning")

    assert exchanges(Q.voltage_stats(table, AS_OF, "day")) == 1
    assert exchanges(Q.frequency(table, AS_OF, "day")) == 1
    # The readings are shuffled once; the other exchanges list the owners and gather each owner's few buckets.
    assert exchanges(Q.energy_consumption(table, AS_OF, "day")) == 3
    assert exchanges(Q.energy_consumption(table, AS_OF, "day", owner="11")) == 2
    # One scan: buckets, then owners.
    yearly = Q.energy_consumption(table, AS_OF, "year")
    assert exchanges(yearly) == 2 and plan(yearly).count("FileScan") == 1
    assert plan(Q.energy_stats(table, AS_OF, owner="11")).count("FileScan") == 1


def test_no_query_sorts_readings_or_joins(spark, stored):
    table = tables.read_readings(spark, stored)
    for frame in (
        Q.energy_consumption(table, AS_OF, "day"),
        Q.energy_consumption(table, AS_OF, "year"),
        Q.ghg_emission(table, AS_OF, "hr"),
        Q.energy_stats(table, AS_OF),
        Q.range_consumption(table, "2024-01-01 00:00:00", AS_OF),
        Q.voltage_stats(table, AS_OF, "day"),
    ):
        text = plan(frame)
        assert "SortAggregate" not in text and "Sort [" not in text and "Join" not in text and "Window" not in text


def test_sampling_sorts_no_messages(messages):
    raw = messages(["a", "b"])
    assert "Sort" not in plan(ingest.sample_latest(raw)) and "Sort" not in plan(ingest.newest(raw))


def test_each_message_is_parsed_once(spark, messages, tmp_path):
    path = str(tmp_path / "raw")
    messages(["a", "b"]).write.parquet(path)
    text = plan(ingest.flatten(spark.read.parquet(path)))
    assert text.count("from_json") == 1 and "ReadSchema: struct<value:string>" in text


def test_a_date_with_most_of_the_rows_is_split(spark, readings, tmp_path):
    rows = [("2024-01-20 12:00:00", str(number), "volt1", number * 1.1) for number in range(20000)]
    rows += [("2024-01-21 12:00:00", "1", "volt1", 1.0)]
    path = str(tmp_path / "readings")
    spread = readings(rows).repartition(4)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200000")
    try:
        tables.write_batch(spread, path, "w", 0)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = tables.read_readings(spark, path).inputFiles()
    assert sum("reading_date=2024-01-20" in name for name in files) > 1
    assert tables.read_readings(spark, path).count() == 20001


def test_publishing_to_a_folder(spark, messages, tmp_path):
    target = str(tmp_path / "out")
    payloads = ["a", "b\nc", "\r\n"]
    keyed = messages(payloads).selectExpr("CAST(offset AS STRING) AS key", "*")
    streams.publish(keyed, target)
    streams.publish(keyed, target)
    assert sorted(tuple(row) for row in spark.read.parquet(target).select("key", "value").collect()) == [(str(k), t) for k, t in enumerate(payloads)]
    target = str(tmp_path / "lines")
    messages(["a", "b"]).select("value").write.text(target)
    lines = streams.text_messages(spark, target, topic="x", streaming=False).collect()
    assert {(row.value, row.topic) for row in lines} == {("a", "x"), ("b", "x")} and lines[0].timestamp is not None


def test_compacted_days_read_like_their_batches(spark, readings, tmp_path):
    from datetime import date
    from pathlib import Path

    path, target = str(tmp_path / "many"), str(tmp_path / "few")
    for batch in range(40):
        rows = [(f"2024-01-{day:02} 01:{batch:02}:00", str(batch % 3), "volt1", float(batch)) for day in (5, 6, 7)]
        tables.write_batch(readings(rows), path, "w", batch)
    before = sorted(map(str, tables.read_readings(spark, path).collect()))
    for _ in range(2):
        tables.compact_days(spark, path, target, date(2024, 1, 4), date(2024, 1, 6))
    both = tables.read_with_compacted(spark, path, target, date(2024, 1, 6), date(2024, 1, 9))
    assert sorted(map(str, both.collect())) == before
    files = lambda where, day: len(list(Path(where).glob(f"reading_date=2024-01-0{day}/*/*/*.parquet")))
    assert files(path, 5) >= 40 and files(target, 5) == files(target, 6) == 1 and files(target, 7) == 0
    assert {row.owner_name for row in tables.read_owners(spark, target).collect()} == {"0", "1", "2"}
