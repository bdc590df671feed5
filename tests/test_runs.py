import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kilowatch.schema import READINGS
from kilowatch.sources import tables
from kilowatch.streaming import buckets, jobs, runs

START = datetime(2024, 1, 20, 12, 0, 0)
GAP = timedelta(minutes=15)


def made(seed, n=400):
    r = random.Random(seed)
    rows, at = [], START
    for _ in range(n):
        at += timedelta(seconds=r.choice([0, 60, 600, 900, 901, 3600]))
        rows.append((at.strftime("%Y-%m-%d %H:%M:%S"), r.choice(["11", "11", "12", None]), "volt1", 1.0, r.choice("fg")))
    return rows


def islands(rows):
    """Runs per owner: (owner, first, last, readings)."""
    found = []
    for owner in {r[1] for r in rows}:
        times = sorted(datetime.fromisoformat(r[0]) for r in rows if r[1] == owner)
        for at in times:
            if found and found[-1][0] == owner and at - found[-1][2] <= GAP:
                found[-1][2:] = [at, found[-1][3] + 1]
            else:
                found.append([owner, at, at, 1])
    return sorted(map(tuple, found), key=str)


@pytest.fixture
def stream(spark, readings, tmp_path):
    folder = str(tmp_path / "in")

    def add(rows):
        readings(rows).select(*READINGS.fieldNames()).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(READINGS).option("maxFilesPerTrigger", 1).parquet(folder)

    return add


@pytest.mark.parametrize("chunk", [1, 7, runs.CHUNK])
def test_runs_equal_brute_force_in_any_order(readings, monkeypatch, chunk):
    monkeypatch.setattr(runs, "CHUNK", chunk)
    rows = made(1)
    random.Random(2).shuffle(rows)
    parts = [runs.run_parts(readings(rows[k::3])) for k in range(3)]
    merged = parts[2].unionByName(parts[0]).unionByName(parts[1])
    want = islands(rows)
    assert sorted(map(tuple, runs.runs(merged).collect()), key=str) == want
    assert sorted(map(tuple, runs.runs(runs.merge_runs(merged)).collect()), key=str) == want
    in_time = sorted(want, key=lambda run: (str(run[0]), run[1]))
    breaks = [(a[0], a[2], b[1]) for a, b in zip(in_time, in_time[1:]) if a[0] == b[0]]
    assert sorted(map(tuple, runs.outages(merged).collect()), key=str) == sorted(breaks, key=str)
    by_meter = runs.runs(runs.run_parts(readings(rows), per_meter=True))
    assert {r["floor_name"] for r in by_meter.collect()} == {"f", "g"} and by_meter.agg(F.sum("readings")).first()[0] == len(rows)


def test_no_readings_have_no_runs(readings):
    parts = runs.run_parts(readings([("noon", "11", "volt1", 1.0)]))
    assert runs.runs(parts).collect() == runs.outages(parts).collect() == []


def test_parts_of_a_stream_merge(spark, readings, stream, tmp_path):
    rows = made(3, 120)
    stream(rows[60:])
    source = stream(rows[:60])
    out, checkpoint = str(tmp_path / "parts"), str(tmp_path / "checkpoint")
    assert jobs.wait(buckets.store_parts(source, runs.run_parts, out, checkpoint, available_now=True), 120)
    parts = buckets.read_parts(spark, out, runs.run_parts(readings(rows)).schema)
    assert sorted(map(tuple, runs.runs(parts).collect()), key=str) == islands(rows)


def test_sessions_in_state_are_handed_on_once_closed(spark, stream, tmp_path):
    rows = [r for r in made(4, 150) if r[1]]
    for k in (0, 50, 100):
        source = stream(rows[k : k + 50])
    out = tmp_path / "closed"

    def write(batch, writer, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    live = runs.live_runs(source)
    assert jobs.wait(jobs.per_batch(live, str(tmp_path / "checkpoint"), write, None, True), 120)
    found = {tuple(r) for r in spark.read.schema(live.schema).parquet(str(out)).select(*live.columns).collect()}
    mark = max(datetime.fromisoformat(r[0]) for r in rows) - timedelta(hours=1)
    assert found == {r for r in islands(rows) if r[2] + GAP < mark}


def test_refused_readings_are_stored_and_counted(spark, readings, stream, tmp_path):
    path, late, checkpoint = (str(tmp_path / name) for name in ("in-time", "late", "checkpoint"))

    def run(source):
        assert jobs.wait(runs.split_late(source, path, late, checkpoint, "1 hour", available_now=True), 120)

    run(stream([("2024-01-20 12:00:00", "11", "volt1", 1.0), ("2024-01-19 00:00:00", "11", "volt1", 2.0)]))
    second = [("2024-01-20 11:00:00", "11", "volt1", 3.0), ("2024-01-20 10:59:59", "11", "volt1", 4.0), ("2024-01-20 15:00:00", "12", "volt1", 5.0), ("noon", "12", "volt1", 6.0)]
    run(stream(second))
    run(stream([("2024-01-20 13:59:00", "12", "volt1", 7.0), ("2024-01-20 14:00:00", "12", "volt1", 8.0)]))

    def state():
        kept = sorted(r["value"] for r in tables.read_readings(spark, path).collect())
        refused = runs.read_late(spark, late, READINGS)
        return kept, sorted((r["value"], r["watermark"].hour) for r in refused.collect()), sorted(map(tuple, runs.late_counts(refused).collect()))

    want = ([1.0, 2.0, 3.0, 5.0, 6.0, 8.0], [(4.0, 11), (7.0, 14)], [("11", 1, 1), ("12", 1, 60)])
    assert state() == want
    # The last batch, run again, sees the marks of earlier batches only.
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda name: int(name.name))
    for name in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        name.unlink(missing_ok=True)
    run(spark.readStream.schema(READINGS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    assert state() == want
