import random
from datetime import datetime, timedelta

import pytest

from kilowatch.functions import timeaxis as X
from kilowatch.plans import queries as Q
from kilowatch.streaming import jobs, rollups
from kilowatch.schema import READINGS

NAME = "energy_consumption"


def made(seed, n=600):
    r = random.Random(seed)
    rows, value = [], 0.0
    for _ in range(n):
        value += r.choice([0.25, 1.0, 3.5, -2.0])
        at = datetime(2023, 11, 1) + timedelta(seconds=r.randrange(150 * 86400))
        rows.append((at.strftime("%Y-%m-%d %H:%M:%S"), r.choice(["11", "12", None]), r.choice([NAME, NAME, "volt1"]), round(value, 2)))
    return [*rows, ("noon", "11", NAME, 5.0), ("2024-02-01 00:00:00", "12", NAME, None), ("2024-02-01 00:00:00", "12", NAME, float("nan"))]


def covered(nodes, start, stop):
    """Minutes of whole nodes, as (start, end) stretches."""
    found = []
    for name, first, last in nodes:
        interval = X.INTERVALS[name]
        at = first
        while at < last:
            following = rollups._up(at + timedelta(seconds=1), interval)
            found.append((at, following))
            at = following
    return found


def test_a_cut_covers_its_range_once_with_few_nodes():
    r = random.Random(1)
    for _ in range(300):
        start = datetime(2020, 1, 1) + timedelta(seconds=r.randrange(4 * 365 * 86400))
        stop = start + timedelta(seconds=r.choice([0, 1, 59, 60, 3600, 86400, 40 * 86400, r.randrange(10**8)]))
        if r.random() < 0.2:
            start = X.bucket_start(start, X.INTERVALS[r.choice(rollups.LEVELS)])
        nodes, edges = rollups.cut(start, stop)
        pieces = sorted(covered(nodes, start, stop) + edges)
        assert [a for a, _ in pieces[1:]] == [b for _, b in pieces[:-1]]
        if start < stop:
            assert pieces[0][0] == start and pieces[-1][1] == stop
        months = (stop.year - start.year) * 12 + stop.month - start.month
        assert len(pieces) - len(edges) <= 2 * (59 + 23 + 30) + months and len(edges) <= 2
        assert all(b - a < timedelta(minutes=2) for a, b in edges)


@pytest.fixture
def stored(spark, readings, tmp_path):
    def build(rows, wall, parts=3):
        path = str(tmp_path / f"rollups-{wall}-{parts}")
        for k in range(parts):
            rollups.write_rollups(readings(rows[k::parts]), path, "w", k, 2, wall)
        return rollups.Rollup(spark, path, readings(rows), 2, wall)

    return build


def collected(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_ranges_equal_the_scan(spark, readings, stored, tmp_path):
    rows = made(1)
    frame, rollup = readings(rows), stored(rows, True)
    target = str(tmp_path / "compacted")
    rollups.compact(spark, rollup.path, target, True)
    small = rollups.Rollup(spark, target, frame, 2, True)
    exact = sorted(r[0] for r in rows if r[0][0] == "2")
    ranges = [("2023-11-20 10:11:12", "2024-02-03 04:05:06"), ("2024-01-01 00:00:00", "2024-02-01 00:00:00"), (exact[100], exact[101]), (exact[200], exact[200]), ("2020-01-01 00:00:00", "2021-01-01 00:00:00")]
    for start, stop in ranges:
        want = collected(Q.range_consumption(frame, start, stop, owners=frame, scale=2))
        assert collected(rollups.range_consumption(rollup, start, stop, frame)) == want
        assert collected(rollups.range_consumption(small, start, stop, frame)) == want


def test_years_and_statistics_equal_the_scan(readings, stored):
    rows = made(2)
    frame = readings(rows)
    for as_of in ("2024-02-10 12:34:56", "2023-12-31 18:30:00", "2024-01-01 00:00:00", "2023-11-15 05:00:00"):
        wall, instants = stored(rows, True), stored(rows, False)
        assert collected(rollups.energy_stats(wall, as_of, frame)) == collected(Q.energy_stats(frame, as_of, owners=frame, scale=2))
        assert collected(rollups.energy_by_year(instants, as_of)) == collected(Q.energy_consumption(frame, as_of, "year", scale=2))
        assert collected(rollups.emission_by_year(wall, as_of)) == collected(Q.ghg_emission(frame, as_of, "year", scale=2))


def test_a_stream_keeps_the_same_nodes(spark, readings, tmp_path):
    rows = [r for r in made(3, 200) if r[1]]
    folder, path, checkpoint = (str(tmp_path / name) for name in ("in", "rollups", "checkpoint"))
    for k in range(3):
        readings(rows[k::3]).select(*READINGS.fieldNames()).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(READINGS).parquet(folder)
        assert jobs.wait(rollups.store_rollups(source, path, checkpoint, available_now=True, scale=2, wall=True), 120)
    frame = readings(rows)
    found = rollups.range_consumption(rollups.Rollup(spark, path, frame, 2, True), "2023-12-01 00:00:30", "2024-02-10 12:34:56", frame)
    assert collected(found) == collected(Q.range_consumption(frame, "2023-12-01 00:00:30", "2024-02-10 12:34:56", owners=frame, scale=2))


def test_nodes_of_a_range_are_pushed_down(spark, readings, stored):
    rollup = stored(made(4), True)
    plan = rollup.between(datetime(2023, 12, 24, 10, 11, 12), datetime(2024, 2, 3, 4, 5, 6))._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.splitlines() if "level=" in line and "PushedFilters" in line]
    assert len(pushed) == 7 and all("LessThan(bucket" in line and "GreaterThanOrEqual(bucket" in line for line in pushed)


def test_zones_that_shift_are_refused_by_instants(readings, tmp_path):
    with pytest.raises(ValueError):
        rollups.write_rollups(readings([]), str(tmp_path), "w", 0, 2, False, "Europe/Berlin")


def test_lagged_parts_equal_the_batch_in_any_order(spark, readings):
    from kilowatch.streaming import buckets

    rows = [r for r in made(5, 300) if r[1] and r[0][0] == "2"]
    for interval in ("hr", "month", "year"):
        want = {}
        for owner in ("11", "12"):
            ticks = sorted((t, v) for t, o, n, v in rows if o == owner and n == NAME and v is not None and v == v)
            for (_, a), (t, b) in zip(ticks, ticks[1:]):
                local = datetime.fromisoformat(t) + timedelta(minutes=330)
                label = local.strftime({"hr": "%Y-%m-%d %H:00", "month": "%Y-%m", "year": "%Y"}[interval])
                want[owner, label] = round(want.get((owner, label), 0) + b - a, 6)
        parts = [buckets.consumption_parts(readings(rows[k::4]), interval, scale=2) for k in (2, 0, 3, 1)]
        merged = parts[0]
        for part in parts[1:]:
            merged = buckets.merge_consumption(merged.unionByName(part))
        found = {(r["owner_name"], r["time"]): r["energy"] for r in buckets.consumption(merged, interval, scale=2, method="lag").collect()}
        assert {k: v for k, v in found.items() if k in want} == want and all(v == 0 for k, v in found.items() if k not in want)
