import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.errors import PySparkException

from kilowatch.operators import documents, owners
from kilowatch.plans import queries as Q

AS_OF = "2024-01-20 12:34:56"
E = "energy_consumption"


def shown(frame, *columns):
    return {tuple(row)[:2]: tuple(row)[2:] if len(row) > 3 else row[2] for row in frame.select("owner_name", "time", *columns or frame.columns[2:]).collect()}


def energy(readings, interval, **options):
    return shown(Q.energy_consumption(readings, AS_OF, interval, **options))


def ghg(readings, interval, **options):
    return shown(Q.ghg_emission(readings, AS_OF, interval, **options))


def test_energy_is_last_minus_first_inside_a_bucket(readings):
    frame = readings(
        [
            ("2024-01-20 01:00:00", "11", E, 10.0),
            ("2024-01-20 05:00:00", "11", E, 12.5),
            ("2024-01-20 20:00:00", "11", E, 20.0),
        ]
    )
    result = energy(frame, "day")
    assert len(result) == 31
    assert result["11", "2024-01-20"] == 2.5
    # One reading gives 0, and what was used between two buckets belongs to neither.
    assert result["11", "2024-01-21"] == 0.0
    assert energy(frame, "day", method="lag")["11", "2024-01-21"] == 7.5


def test_lag_skips_empty_buckets_and_equals_the_whole_range(readings):
    rows = [(f"2024-01-{day:02d} 0{hour}:00:00", "11", E, 100.0 * day + hour) for day in (3, 4, 9, 15) for hour in (1, 2, 3)]
    result = energy(readings(rows), "day", method="lag")
    assert result["11", "2024-01-09"] == 500.0 and sum(result.values()) == 1503.0 - 301.0


def test_resets_pass_as_negative_energy_but_never_as_emission(readings):
    frame = readings([("2024-01-20 01:00:00", "11", E, 10.0), ("2024-01-20 02:00:00", "11", E, 4.0)])
    assert energy(frame, "day")["11", "2024-01-20"] == -6.0
    assert ghg(frame, "day")["11", "2024-01-20"] == 0.0


def test_ties_on_time_are_ordered_by_value(readings):
    rows = [("2024-01-20 01:00:00", "11", E, value) for value in (5.0, 3.0, 9.0)]
    for order in (rows, rows[::-1]):
        assert energy(readings(order), "day")["11", "2024-01-20"] == 6.0


def test_emission_factor_and_rounding(readings):
    frame = readings([("2024-01-20 01:00:00", "11", E, 0.0), ("2024-01-20 02:00:00", "11", E, 123.45)])
    for scale in (None, 2):
        assert ghg(frame, "day", scale=scale)["11", "2024-01-20"] == 0.071601


def test_every_owner_gets_every_slot(readings):
    frame = readings([("2024-01-20 07:00:00", "11", E, 1.0), ("2024-01-02 07:00:00", "12", "volt1", 1.0)])
    for interval, slots in (("min", 60), ("hr", 24), ("day", 31), ("month", 12)):
        result = energy(frame, interval)
        assert len(result) == 2 * slots and {owner for owner, _ in result} == {"11", "12"}
    for interval, slots in (("min", 60), ("hr", 24), ("day", 20), ("month", 1)):
        assert len(ghg(frame, interval)) == 2 * slots


def test_years_run_from_an_owners_first_register_reading(readings):
    frame = readings(
        [
            ("2021-05-05 05:00:00", "11", E, 1.0),
            ("2021-06-05 05:00:00", "11", E, 3.0),
            ("2023-05-05 05:00:00", "12", E, 1.0),
            ("2022-05-05 05:00:00", "13", "volt1", 1.0),
        ]
    )
    for result in (energy(frame, "year"), ghg(frame, "year")):
        assert sorted(result) == [("11", str(y)) for y in range(2021, 2025)] + [("12", "2023"), ("12", "2024")]
    assert energy(frame, "year")["11", "2021"] == 2.0


def test_first_year_slot_is_the_utc_year(readings):
    frame = readings([("2022-12-31 19:00:00", "11", E, 1.0), ("2023-12-31 17:00:00", "11", E, 4.0)])
    assert energy(frame, "year") == {("11", "2022"): 0.0, ("11", "2023"): 3.0, ("11", "2024"): 0.0}


def test_an_owner_whose_readings_all_lie_ahead(readings):
    frame = readings([("2024-06-01 00:00:00", "11", E, 1.0), ("2024-06-02 00:00:00", "11", E, 4.0)])
    assert energy(frame, "year") == {("11", "2024"): 0.0}
    later = readings([("2030-06-01 00:00:00", "11", E, 1.0)])
    assert energy(later, "year") == {}


def test_a_named_owner(spark, readings):
    frame = readings([("2024-01-20 01:00:00", "11", E, 1.0), ("2024-01-20 02:00:00", "11", E, 2.0)])
    assert energy(frame, "day", owner="11")["11", "2024-01-20"] == 1.0
    assert len(energy(frame, "hr", owner="99")) == 24 and energy(frame, "year", owner="99") == {}
    # Owners the table lacks are shown when they have a bucket, and whoever is shown has all slots.
    listed = energy(frame, "hr", owners=spark.createDataFrame([("a",), ("b",), ("b",)], "owner_name string"))
    assert len(listed) == 3 * 24 and listed["11", "2024-01-20 03:00"] == 0.0
    with pytest.raises(ValueError):
        energy(frame, "day", owner="")


def test_unknown_parameters_fail_before_any_job(readings):
    frame = readings([])
    for query in (
        Q.energy_consumption,
        Q.ghg_emission,
        Q.voltage_stats,
        Q.current_stats,
        Q.power_factor,
        Q.frequency,
    ):
        with pytest.raises(ValueError):
            query(frame, AS_OF, "week")
        with pytest.raises(ValueError):
            query(frame, None, "day")
        with pytest.raises(ValueError):
            query(frame, AS_OF, "day", owner="")
        with pytest.raises(ValueError):
            query(frame, AS_OF, "day", rounding="up")


def test_the_two_clocks(readings):
    # 18:30 UTC on the 19th is midnight in the display zone.
    frame = readings([("2024-01-19 18:29:00", "11", E, 1.0), ("2024-01-19 18:30:00", "11", E, 5.0), ("2024-01-19 18:31:00", "11", E, 6.0)])
    assert energy(frame, "day")["11", "2024-01-20"] == 1.0
    assert energy(frame, "day", consistent_time=True)["11", "2024-01-19"] == 5.0
    assert energy(frame, "hr")["11", "2024-01-20 00:00"] == 1.0


def test_emission_by_the_two_clocks(readings):
    rows = [(f"2024-01-20 {hour:02d}:{minute:02d}:00", "11", E, 10.0 * hour + minute / 10) for hour in range(12) for minute in (0, 30)]
    consistent, compat = ghg(readings(rows), "hr"), ghg(readings(rows), "hr", consistent_time=False)
    assert consistent["11", "2024-01-20 11:00"] == pytest.approx(3 * 0.00058)
    # Labels run 5 h 30 min late: 06:30 and 07:00 are shown at 12:00, later readings have no slot.
    assert compat["11", "2024-01-20 12:00"] == pytest.approx((70.0 - 63.0) * 0.00058)
    assert [compat["11", f"2024-01-19 {hour}:00"] for hour in range(13, 18)] == [0.0] * 5
    minutes = [((datetime(2024, 1, 20, 11, 0) + timedelta(minutes=n)).strftime("%Y-%m-%d %H:%M:%S"), "11", E, float(n)) for n in range(95)]
    assert set(ghg(readings(minutes), "min", consistent_time=False).values()) == {0.0}


def test_bounds_are_inclusive_or_not(readings):
    ends = readings([("2024-01-20 12:00:00", "11", E, 0.0), ("2024-01-20 12:34:56", "11", E, 7.0), ("2024-01-20 12:34:57", "11", E, 9.0)])
    assert ghg(ends, "hr", scale=2)["11", "2024-01-20 12:00"] == pytest.approx(7 * 0.00058)
    hour = readings([("2024-01-20 06:30:00", "11", E, 0.0), ("2024-01-20 07:29:59", "11", E, 3.0), ("2024-01-20 07:30:00", "11", E, 9.0)])
    result = energy(hour, "hr")
    assert result["11", "2024-01-20 12:00"] == 3.0 and result["11", "2024-01-20 13:00"] == 0.0


def test_meters_of_one_owner_are_mixed_unless_kept_apart(readings):
    frame = readings(
        [
            ("2024-01-20 01:00:00", "11", E, 100.0, "f1"),
            ("2024-01-20 02:00:00", "11", E, 7.0, "f2"),
            ("2024-01-20 03:00:00", "11", E, 101.0, "f1"),
            ("2024-01-20 04:00:00", "11", E, 9.0, "f2"),
        ]
    )
    assert energy(frame, "day")["11", "2024-01-20"] == -91.0
    for interval, slot in (("day", "2024-01-20"), ("year", "2024")):
        assert energy(frame, interval, per_meter=True)["11", slot] == 3.0
        assert energy(frame, interval, per_meter=True, method="lag")["11", slot] == 3.0


def test_range_consumption(readings):
    frame = readings(
        [
            ("2024-01-01 00:00:00", "11", E, 1.0),
            ("2024-01-02 00:00:00", "11", E, 1.5),
            ("2024-01-03 00:00:00", "11", E, 4.126),
            ("2024-01-03 00:00:01", "11", E, 9.0),
            ("2024-01-02 00:00:00", "12", E, 9.0),
            ("2024-01-02 00:00:00", "13", "volt1", 9.0),
        ]
    )
    rows = Q.range_consumption(frame, "2024-01-01 00:00:00", "2024-01-03 00:00:00").collect()
    assert {row.owner_name: row.energy for row in rows} == {"11": 3.13, "12": 0.0, "13": 0.0}


def test_energy_stats(readings):
    frame = readings(
        [
            ("2023-12-31 23:00:00", "11", E, 0.0),
            ("2024-01-01 00:00:00", "11", E, 10.0),
            ("2024-01-19 23:59:59", "11", E, 20.0),
            ("2024-01-20 00:00:00", "11", E, 30.0),
            ("2024-01-20 12:34:56", "11", E, 32.25),
            ("2024-01-20 12:34:57", "11", E, 99.0),
            ("2024-01-20 01:00:00", "12", E, 5.0),
            ("2024-01-20 01:00:00", "13", "volt1", 5.0),
        ]
    )
    for scale in (None, 2):
        rows = {row.owner_name: tuple(row)[1:] for row in Q.energy_stats(frame, AS_OF, scale=scale).collect()}
        assert rows["11"] == (2.25, 18.56, 22.25, 183.56, 22.25, 183.56)
        assert rows["12"] == rows["13"] == (0.0,) * 6
    march = readings(
        [
            ("2024-01-01 00:00:00", "11", E, 1.0),
            ("2024-02-10 00:00:00", "11", E, 2.0),
            ("2024-03-01 00:00:00", "11", E, 4.0),
            ("2024-03-09 00:00:00", "11", E, 8.0),
            ("2024-03-10 00:00:00", "11", E, 16.0),
        ]
    )
    row = Q.energy_stats(march, "2024-03-10 10:00:00").collect()[0]
    assert (row.one_day_energy, row.one_month_energy, row.one_year_energy) == (0.0, 12.0, 15.0)


def test_a_malformed_time_fails_only_strict_readings(readings, spark):
    from kilowatch.operators.ingest import with_event_time

    frame = readings([("2024-01-20 01:00:00", "11", E, 1.0), ("2024-01-20 02:00:00", "11", E, 3.0), ("bad", "11", E, 1.0)])
    assert energy(frame, "day")["11", "2024-01-20"] == 2.0
    assert energy(frame, "year") == {("11", "2024"): 2.0}
    assert ghg(frame, "day", scale=2)["11", "2024-01-20"] == 0.00116
    assert ghg(frame, "year", scale=2) == {("11", "2024"): 0.00116}
    with pytest.raises(PySparkException):
        energy(with_event_time(frame, strict=True), "day")


def test_a_missing_phase_is_null(readings):
    frame = readings([("2024-01-20 06:00:00", "11", "volt1", 230.0), ("2024-01-20 06:10:00", "11", "volt3", 231.0), ("2024-01-20 06:20:00", "11", "volt3", 232.0)])
    assert shown(Q.voltage_stats(frame, AS_OF, "hr")) == {("11", "2024-01-20 11:00"): (230.0, None, 231.5)}
    current = readings([("2024-01-20 06:00:00", "11", "current2", 4.0)])
    assert shown(Q.current_stats(current, AS_OF, "hr")) == {("11", "2024-01-20 11:00"): (None, 4.0, None)}


def test_voltage_has_no_upper_bound_and_starts_mid_bucket(readings):
    rows = [(time, "11", "volt1", value) for time, value in (("2024-01-19 07:04:55", 1.0), ("2024-01-19 07:04:56", 2.0), ("2024-01-19 07:20:00", 4.0), ("2024-02-01 00:00:00", 5.0))]
    result = shown(Q.voltage_stats(readings(rows), AS_OF, "hr"))
    assert result == {("11", "2024-01-19 12:00"): (3.0, None, None), ("11", "2024-02-01 05:00"): (5.0, None, None)}
    gauges = readings([(time, "11", "frequency", value) for time, _, _, value in rows])
    assert shown(Q.frequency(gauges, AS_OF, "day")) == {("11", "2024-01-19"): 2.33}
    assert shown(Q.frequency(gauges, AS_OF, "year")) == {("11", "2024"): 2.33}


def test_gauges_fill_no_gaps(readings):
    frame = readings([("2024-01-20 06:00:00", "11", "powerfactor", 0.9), ("2024-01-20 06:30:00", "11", "volt1", 0.9)])
    assert shown(Q.power_factor(frame, AS_OF, "hr")) == {("11", "2024-01-20 11:00"): 0.9}


def test_rounding_of_ties(readings):
    frame = readings([("2024-01-20 06:30:00", "11", "frequency", 50.12), ("2024-01-20 06:31:00", "11", "frequency", 50.13)])
    results = {mode: shown(Q.frequency(frame, AS_OF, "hr", scale=2, rounding=mode)) for mode in ("half_up", "even")}
    assert [result["11", "2024-01-20 12:00"] for result in results.values()] == [50.13, 50.12]


def test_means_ignore_nulls(readings):
    frame = readings([("2024-01-20 06:30:00", "11", "frequency", 50.0), ("2024-01-20 06:31:00", "11", "frequency", None)])
    for scale in (None, 2):
        assert shown(Q.frequency(frame, AS_OF, "hr", scale=scale)) == {("11", "2024-01-20 12:00"): 50.0}


def test_what_is_no_number_does_not_count_when_values_are_exact(readings):
    nan = float("nan")
    frame = readings([("2024-01-20 06:30:00", "11", "frequency", 50.0), ("2024-01-20 06:31:00", "11", "frequency", nan)])
    assert shown(Q.frequency(frame, AS_OF, "hr", scale=2)) == {("11", "2024-01-20 12:00"): 50.0}
    assert str(shown(Q.frequency(frame, AS_OF, "hr"))["11", "2024-01-20 12:00"]) == "nan"


def test_registers_of_any_size(readings):
    big = [("2024-01-20 06:30:00", "11", E, 1e300), ("2024-01-20 06:31:00", "11", E, 7e12), ("2024-01-20 06:32:00", "11", E, 7e12 + 8)]
    assert energy(readings(big[1:]), "day", scale=2)["11", "2024-01-20"] == 8.0
    assert energy(readings(big), "day")["11", "2024-01-20"] == 7e12 + 8 - 1e300
    ties = [("2024-01-20 06:30:00", "11", E, value) for value in (-1e9, 1e9, -1.3e9, 1.3e9)]
    for interval, slot in (("hr", "2024-01-20 12:00"), ("month", "2024-01"), ("year", "2024")):
        assert energy(readings(ties), interval, scale=2)["11", slot] == 2.6e9


def test_the_first_second_of_a_long_year(readings):
    ends = [("2023-12-31 18:30:00", "11", E, 5.0), ("2024-12-31 18:29:59", "11", E, 3.0), ("2024-06-01 00:00:00", "11", E, 9.0)]
    frame = readings(ends)
    assert shown(Q.energy_consumption(frame, "2025-06-01 00:00:00", "year"))["11", "2024"] == -2.0


def test_owner_order(readings):
    names = ["7", "20", "11", "9", "12", "abc", None, "16"]
    frame = readings([("2024-01-20 06:30:00", name, "volt1", 1.0) for name in names * 2])
    rows = Q.display_order(Q.unique_owners(frame)).collect()
    assert [row.owner_name for row in rows] == ["11", "12", "16", "7", "9", "20", "None", "abc"]


def test_earliest(readings):
    frame = readings([("2024-01-20 06:30:00", "11", "volt1", 1.0), ("2024-01-19 06:30:00", "11", "volt2", 1.0)])
    for measures, day in ((("volt1",), 20), ((), 19), (("volt1", "volt2"), 19)):
        assert owners.earliest(frame, *measures).collect()[0].earliest.day == day


def test_response_documents(readings):
    import json

    frame = readings([("2024-01-20 06:00:00", "11", "volt1", 230.0), ("2024-01-20 05:00:00", "11", "volt3", 231.0)])
    docs = documents.documents(Q.voltage_stats(frame, AS_OF, "h"), "hr")
    assert json.loads(documents.as_json(docs).collect()[0].value) == {
        "owner_name": "11",
        "interval": "hr",
        "data": [
            {"time": "2024-01-20 10:00", "volt1": None, "volt2": None, "volt3": 231.0},
            {"time": "2024-01-20 11:00", "volt1": 230.0, "volt2": None, "volt3": None},
        ],
    }


def test_results_in_time_order(readings):
    frame = readings([("2024-01-20 06:00:00", "12", "volt1", 1.0), ("2024-01-20 05:00:00", "12", "volt1", 1.0), ("2024-01-20 06:00:00", "11", "volt1", 1.0)])
    rows = documents.in_time_order(Q.voltage_stats(frame, AS_OF, "hr")).collect()
    assert [(row.owner_name, row.time[-5:]) for row in rows] == [("11", "11:00"), ("12", "10:00"), ("12", "11:00")]


@pytest.fixture(scope="module")
def crowd():
    """Readings of which one owner has more than a third, many at the same time, with resets."""
    rng = random.Random(7)
    start, rows = datetime(2022, 11, 1), []
    for _ in range(6000):
        owner = "11" if rng.random() < 0.4 else rng.choice(["7", "8", "20", "x"])
        time = start + timedelta(minutes=rng.randrange(0, 650000, 10))
        rows.append((time.strftime("%Y-%m-%d %H:%M:%S"), owner, rng.choice([E, E, "frequency"]), rng.randrange(0, 500000) / 100))
    return rows


SHAPES = {"min": "%Y-%m-%d %H:%M", "hr": "%Y-%m-%d %H:00", "day": "%Y-%m-%d", "month": "%Y-%m", "year": "%Y"}


def grouped(rows, measure, interval, keep):
    found = defaultdict(list)
    for time, owner, name, value in rows:
        moment = datetime.strptime(time, "%Y-%m-%d %H:%M:%S") + timedelta(minutes=330)
        if name == measure and keep(moment):
            found[owner, moment.strftime(SHAPES[interval])].append((moment, Decimal(str(value))))
    return found


PERIODS = {
    "hr": (datetime(2024, 1, 20), datetime(2024, 1, 21)),
    "day": (datetime(2024, 1, 1), datetime(2024, 2, 1)),
    "month": (datetime(2024, 1, 1), datetime(2025, 1, 1)),
    "year": (datetime(1, 1, 1), datetime(2024, 1, 20, 12, 34, 56)),
}


@pytest.mark.parametrize("interval", PERIODS)
def test_energy_against_brute_force(readings, crowd, interval):
    low, high = PERIODS[interval]
    expected = {key: float(max(ticks)[1] - min(ticks)[1]) for key, ticks in grouped(crowd, E, interval, lambda at: low <= at < high).items()}
    result = energy(readings(crowd), interval, scale=2)
    assert {key: value for key, value in result.items() if key in expected} == expected
    assert all(value == 0.0 for key, value in result.items() if key not in expected)
    assert len(result) == 5 * {"hr": 24, "day": 31, "month": 12, "year": 3}[interval]


@pytest.mark.parametrize("interval", PERIODS)
def test_means_against_brute_force(readings, crowd, interval):
    low, high = PERIODS[interval]
    expected = {}
    for key, ticks in grouped(crowd, "frequency", interval, lambda at: low <= at < high).items():
        mean = sum(value for _, value in ticks) / len(ticks)
        expected[key] = float(mean.quantize(Decimal("0.01"), ROUND_HALF_UP))
    assert shown(Q.frequency(readings(crowd), AS_OF, interval, scale=2)) == expected


def test_buckets_never_exceed_the_range_for_a_rising_register(readings, crowd):
    times = sorted(time for time, _, _, _ in crowd if "2024-01-01" <= time < "2024-01-20")
    frame = readings([(time, "11", E, float(place)) for place, time in enumerate(times)])
    total = sum(energy(frame, "day", consistent_time=True).values())
    whole = Q.range_consumption(frame, times[0], times[-1]).collect()[0].energy
    assert 0 < total <= whole
    assert all(value >= 0 for value in ghg(frame, "day").values())
    assert sum(energy(frame, "day", consistent_time=True, method="lag").values()) == whole
