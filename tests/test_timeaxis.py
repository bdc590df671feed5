from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from kilowatch.functions import timeaxis as X

NOW = X.as_local("2024-01-20 12:34:56")
TEXT = X.wall_text


def slots(span, interval):
    return TEXT(span.first_slot), TEXT(span.last_slot)


def test_interval_codes():
    assert [X.resolve_interval(code).name for code in ("m", "h", "d", "M", "y")] == ["min", "hr", "day", "month", "year"]
    assert X.resolve_interval("min").name == "min"
    for bad in ("H", "minute", None, ""):
        with pytest.raises(ValueError):
            X.resolve_interval(bad)


def test_as_of_is_required_and_local_to_the_zone():
    with pytest.raises(ValueError):
        X.as_local(None)
    aware = datetime(2024, 1, 20, 7, 4, 56, tzinfo=timezone.utc)
    assert X.as_local(aware) == NOW == X.as_local(datetime(2024, 1, 20, 12, 34, 56))


@pytest.mark.parametrize(
    "code, start",
    [
        ("min", "2024-01-20 11:34:56"),
        ("hr", "2024-01-19 12:34:56"),
        ("day", "2023-12-21 12:34:56"),
        ("month", "2023-01-01 12:34:56"),
        ("year", "2019-01-02 12:34:56"),
    ],
)
def test_rolling_bounds(code, start):
    span = X.rolling_span(NOW, X.resolve_interval(code))
    assert TEXT(span.start) == start and span.stop is None


@pytest.mark.parametrize(
    "code, start, first, last",
    [
        ("min", "2024-01-20 11:35:00", "2024-01-20 11:35:00", "2024-01-20 12:34:00"),
        ("hr", "2024-01-19 13:00:00", "2024-01-19 13:00:00", "2024-01-20 12:00:00"),
        ("day", "2024-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-20 00:00:00"),
        ("month", "2024-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00"),
    ],
)
def test_to_date_bounds(code, start, first, last):
    interval = X.resolve_interval(code)
    span = X.to_date_span(NOW, interval)
    assert (TEXT(span.start), TEXT(span.stop), span.stop_included) == (start, "2024-01-20 12:34:56", True)
    assert slots(span, interval) == (first, last)


@pytest.mark.parametrize(
    "code, start, stop, last",
    [
        ("min", "2024-01-20 12:00:00", "2024-01-20 13:00:00", "2024-01-20 12:59:00"),
        ("hr", "2024-01-20 00:00:00", "2024-01-21 00:00:00", "2024-01-20 23:00:00"),
        ("day", "2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-01-31 00:00:00"),
        ("month", "2024-01-01 00:00:00", "2025-01-01 00:00:00", "2024-12-01 00:00:00"),
    ],
)
def test_full_period_bounds(code, start, stop, last):
    interval = X.resolve_interval(code)
    span = X.full_period_span(NOW, interval)
    assert (TEXT(span.start), TEXT(span.stop), span.stop_included) == (start, stop, False)
    assert slots(span, interval) == (start, last)


def test_month_ends():
    interval = X.resolve_interval("day")
    leap = X.full_period_span(X.as_local("2024-02-10 00:00:00"), interval)
    assert TEXT(leap.last_slot) == "2024-02-29 00:00:00"
    december = X.full_period_span(X.as_local("2023-12-31 23:59:59"), interval)
    assert TEXT(december.stop) == "2024-01-01 00:00:00" and TEXT(december.last_slot) == "2023-12-31 00:00:00"
    hour = X.to_date_span(X.as_local("2024-01-01 00:10:00"), X.resolve_interval("min"))
    assert TEXT(hour.start) == "2023-12-31 23:11:00"


def labels(spark, times, code, zone):
    frame = spark.createDataFrame([(time,) for time in times], "t string").select(
        F.to_timestamp("t").alias("event_time")
    )
    interval = X.resolve_interval(code)
    bucket = X.bucket_of(X.local_seconds(zone), interval)
    return [row[0] for row in frame.select(X.label_of(bucket, interval)).collect()]


TIMES = [
    "2025-12-31 18:29:59",
    "2025-12-31 18:30:00",
    "2024-02-28 18:30:00",
    "2024-03-10 07:30:00",
    "2024-11-03 05:59:59",
    "2024-11-03 06:30:00",
    "1969-12-31 18:29:59",
    "1943-06-01 12:00:00",
]


@pytest.mark.parametrize("zone", ["Asia/Kolkata", "America/New_York", "UTC", "Asia/Kathmandu"])
@pytest.mark.parametrize("code", ["min", "hr", "day", "month", "year"])
def test_labels_agree_with_the_zone_database(spark, zone, code):
    shapes = {"min": "%Y-%m-%d %H:%M", "hr": "%Y-%m-%d %H:00", "day": "%Y-%m-%d", "month": "%Y-%m", "year": "%Y"}
    instants = [datetime.fromisoformat(time).replace(tzinfo=timezone.utc) for time in TIMES]
    expected = [instant.astimezone(ZoneInfo(zone)).strftime(shapes[code]) for instant in instants]
    assert labels(spark, TIMES, code, zone) == expected


def test_year_rolls_over_in_the_display_zone(spark):
    assert labels(spark, ["2025-12-31 20:10:00"], "year", "Asia/Kolkata") == ["2026"]
