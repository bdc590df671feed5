"""Cases where a shortened order, a lost row or the session's zone would give another result."""

from datetime import datetime, timezone

import pytest

from kilowatch.operators import ingest
from kilowatch.plans import queries as Q
from kilowatch.streaming import buckets

AS_OF = "2024-01-20 12:34:56"
REGISTER = "energy_consumption"


def day(frame, **options):
    rows = Q.energy_consumption(frame, AS_OF, "day", **options).collect()
    return {row.energy for row in rows if row.time.startswith("2024-01-20")}


@pytest.mark.parametrize("scale", [None, 2])
@pytest.mark.parametrize("turned", [False, True])
def test_large_values_break_ties_on_time(readings, scale, turned):
    rows = [("2024-01-20 01:00:00", "11", REGISTER, v) for v in (200_000_000.0, 200_000_005.0, 3e12)]
    assert day(readings(rows[::-1] if turned else rows), scale=scale) == {3e12 - 200_000_000.0}


def test_fractions_of_a_second_are_in_the_order(readings):
    rows = [("2024-01-20 01:00:00.1", "11", REGISTER, 9.0), ("2024-01-20 01:00:00.9", "11", REGISTER, 4.0)]
    assert day(readings(rows)) == {-5.0}


@pytest.mark.parametrize("scale", [None, 2])
@pytest.mark.parametrize("place", [0, 1, 2])
@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_values_that_are_no_numbers_do_not_count(readings, scale, place, bad):
    values = [1.0, 5.0]
    values.insert(place, bad)
    frame = readings([(f"2024-01-20 01:0{k}:00", "11", REGISTER, v) for k, v in enumerate(values)])
    assert day(frame, scale=scale) == {4.0}
    (total,) = Q.range_consumption(frame, "2024-01-20 00:00:00", "2024-01-20 23:00:00", scale=scale).collect()
    (stats,) = Q.energy_stats(frame, AS_OF, scale=scale).collect()
    assert float(total.energy) == 4.0 and float(stats.one_day_energy) == 4.0 and stats.one_day_cost is not None


def test_range_from_datetimes(readings):
    frame = readings([(f"2024-01-20 0{k}:00:00", "11", REGISTER, float(k)) for k in (1, 2, 3)])
    text = Q.range_consumption(frame, "2024-01-20 01:00:00", "2024-01-20 02:00:00").collect()
    zoned = [datetime(2024, 1, 19, 19, 30, tzinfo=timezone.utc), datetime(2024, 1, 19, 20, 30, tzinfo=timezone.utc)]
    assert text == Q.range_consumption(frame, datetime(2024, 1, 20, 1), datetime(2024, 1, 20, 2)).collect() == Q.range_consumption(frame, *zoned).collect()
    assert text[0].energy == 1.0


def test_another_session_zone_is_refused(spark, readings):
    frame = readings([("2024-01-20 01:00:00", "11", REGISTER, 1.0)])
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        for question in (lambda: day(frame), lambda: Q.voltage_stats(frame, AS_OF, "hr"), lambda: ingest.with_event_time(frame.select("time"))):
            with pytest.raises(ValueError, match="UTC"):
                question()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_only_repeated_readings_are_dropped(readings):
    row = ("2024-01-20 12:00:00", "11", "volt1", 1.0)
    rows = [row, row, (*row[:3], 2.0), ("bad1", *row[1:]), ("bad2", *row[1:]), ("bad2", *row[1:])]
    assert ingest.deduplicated(readings(rows)).count() == 4


@pytest.mark.parametrize("interval", ["hr", "day", "month", "year"])
def test_parts_of_any_order_give_the_batch_result(readings, interval):
    rows = [(f"2024-01-{d:02} {h:02}:30:00", o, REGISTER, float(d * 100 + h)) for o in ("11", "12") for d in (3, 9, 20) for h in (1, 5, 22)]
    rows += [(t, o, "frequency", v / 7) for t, o, _, v in rows]
    whole = readings(rows)
    late_last = [whole.filter(f"hour(event_time) = {h}") for h in (22, 1, 5)]
    columns = {"frequency": "frequency"}
    for scale in (None, 2):
        parts = [buckets.consumption_parts(f, interval, scale=scale) for f in late_last]
        merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
        once = buckets.consumption(buckets.consumption_parts(whole, interval, scale=scale), interval, scale)
        assert sorted(buckets.consumption(merged, interval, scale).collect()) == sorted(once.collect())
        assert sorted(buckets.consumption(buckets.merge_consumption(merged), interval, scale).collect()) == sorted(once.collect())
        sums = [buckets.mean_parts(f, interval, columns, scale=scale) for f in late_last]
        means = buckets.means(sums[0].unionByName(sums[1]).unionByName(sums[2]), interval, scale=scale)
        assert sorted(means.collect()) == sorted(buckets.means(buckets.mean_parts(whole, interval, columns, scale=scale), interval, scale=scale).collect())


PATH = "c/b/f/s/l/11/volt1/{}"


@pytest.mark.parametrize(("salvage", "drop_nan", "keep_malformed"), [(False, False, True), (False, True, False), (True, True, True)])
def test_every_message_is_either_stored_or_reported(messages, salvage, drop_nan, keep_malformed):
    em, wm = PATH.format("EM"), PATH.format("WM")
    bodies = ["x", "[]", "{}", '{"ts":"t","params":{}}', '{"ts":"t","params":null}', '{"ts":"2024-01-20 01:00:00","params":{"%s":1}}' % em]
    for ts in ("2024-01-20 01:00:00", "t"):
        for values in ('"%s":NaN' % em, '"%s":"x"' % em, '"%s":1,"%s":NaN' % (em, em.replace("11", "12")), '"%s":1' % wm, '"%s":null' % em, '"a/b":2,"%s":3' % em):
            bodies.append('{"ts":"%s","params":{%s}}' % (ts, values))
    options = {"salvage": salvage, "drop_nan": drop_nan, "keep_malformed": keep_malformed}
    raw = messages(bodies)
    reported = {row.offset for row in ingest.dead_letters(raw, **options).collect()}
    for place in range(len(bodies)):
        stored = ingest.flatten(raw.filter(f"offset = {place}"), **options).count()
        assert (stored > 0) != (place in reported), bodies[place]
