import pytest
from pyspark.sql import functions as F

from kilowatch.operators import ingest
from kilowatch.sources import streams, tables
from kilowatch.streaming import distinct, jobs

PATH = "c/b/f/s/l/{owner}/{name}/EM"


def message(ts, value=1.0, owner="11", name="volt1"):
    return f'{{"ts":"{ts}","params":{{"{PATH.format(owner=owner, name=name)}":{value}}}}}'


@pytest.fixture
def deliver(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    count = [0]

    def run(*texts, batches=True):
        if texts:
            rows = [(t, "t", 0, k, 1705750000 + count[0]) for k, t in enumerate(texts)]
            frame = spark.createDataFrame(rows, "value string, topic string, partition int, offset bigint, s bigint")
            frame.selectExpr("* except (s)", "timestamp_seconds(s) AS timestamp").coalesce(1).write.mode("append").parquet(folder)
            count[0] += 1
        raw = streams.stored_messages(spark, folder, files_per_trigger=1)
        assert jobs.wait(distinct.store_distinct(ingest.flatten(raw), out, checkpoint, available_now=True), 120)
        rows = tables.read_readings(spark, out).select("time", "owner_name", "value").collect()
        return sorted((tuple(r) for r in rows), key=str)

    run.checkpoint, run.out = tmp_path / "checkpoint", out
    return run


def test_late_readings_stay_and_repeats_go(deliver):
    day2 = [message("2024-01-21 12:00:00"), message("2024-01-21 12:00:00"), message("2024-01-21 12:00:00", 2.0)]
    assert len(deliver(*day2)) == 2
    # A meter reconnects: first readings of the day before, with what was delivered already.
    late = [message("2024-01-20 08:00:00"), message("2024-01-21 12:00:00"), message("2023-06-01 00:00:00")]
    want = deliver(*late)
    assert len(want) == 4
    assert deliver(*late, *day2) == want
    # Malformed times are told apart by their text.
    odd = [message("noon"), message("noon"), message("midnight"), message("2024-01-21 12:00:00", owner="12")]
    assert len(deliver(*odd)) == 7
    assert len(deliver(*odd)) == 7


def test_replay_and_restart_change_nothing(deliver):
    deliver(message("2024-01-21 12:00:00"), message("2024-01-21 12:01:00"))
    want = deliver(message("2024-01-21 12:01:00"), message("2024-01-21 12:02:00"), message("2024-01-20 12:02:00"))
    commits = sorted((deliver.checkpoint / "commits").glob("[0-9]*"), key=lambda name: int(name.name))
    for name in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        name.unlink(missing_ok=True)
    assert deliver() == want and len(want) == 4


def test_only_touched_hours_are_read(spark, readings, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"2024-01-{day:02d} {hour:02d}:10:00", "11", "volt1", 1.0) for day in (1, 2, 3) for hour in range(24)]
    tables.write_batch(readings(rows), path, "w", 0)
    batch = readings([("2024-01-02 05:30:00", "11", "volt1", 1.0), ("2024-01-02 05:10:00", "11", "volt1", 1.0), ("2024-01-02 06:10:00", "11", "volt1", 9.0)])
    found = distinct.stretches(batch)
    earlier = distinct.stored(spark, path, found)
    plan = earlier._jdf.queryExecution().executedPlan().toString()
    assert "event_time" in plan.split("PushedFilters:")[1].split("]")[0]
    assert "reading_date" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert sorted(r["time"] for r in earlier.collect()) == ["2024-01-02 05:10:00", "2024-01-02 06:10:00"]
    assert sorted(r["time"] for r in distinct.unseen(batch, earlier).collect()) == ["2024-01-02 05:30:00", "2024-01-02 06:10:00"]


def test_very_many_hours_are_bounded_by_date(spark, readings, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = [(f"2024-{month:02d}-01 {hour:02d}:10:00", "11", "volt1", 1.0) for month in range(1, 13) for hour in range(24)]
    tables.write_batch(readings(rows[::2]), path, "w", 0)
    for most, hours, dates in ((5, 10_000, 4000), (5, 20, 4000), (5, 20, 6)):
        monkeypatch.setattr(distinct, "STRETCHES", most)
        monkeypatch.setattr(distinct, "HOURS", hours)
        monkeypatch.setattr(distinct, "DATES", dates)
        batch = readings(rows)
        new = distinct.unseen(batch, distinct.stored(spark, path, distinct.stretches(batch)))
        assert sorted(r["time"] for r in new.collect()) == [r[0] for r in rows[1::2]]


def test_values_that_are_no_numbers_are_equal_to_themselves(spark, readings, tmp_path):
    rows = [("2024-01-01 00:00:00", "11", "volt1", float("nan")), ("2024-01-01 00:00:00", "11", "volt1", None), ("2024-01-01 00:00:00", None, "volt1", 1.0)]
    path = str(tmp_path / "t")
    tables.write_batch(readings(rows), path, "w", 0)
    batch = readings(rows)
    assert distinct.unseen(batch, distinct.stored(spark, path, distinct.stretches(batch))).count() == 0
    # The table's own batch, run again, does not count as stored.
    assert distinct.unseen(batch, distinct.stored(spark, path, distinct.stretches(batch), "w", 0)).count() == 3
    assert distinct.unseen(readings([]), distinct.stored(spark, path, [])).select(F.count("*")).first()[0] == 0
