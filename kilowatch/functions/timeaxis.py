"""Intervals, bounds as of an instant, bucket and label columns, calendar slots.

Bounds are computed in the driver from `as_of` and enter the plan as literals; the system clock is never read.
A *wall* predicate compares the text in `time` with bounds written in the display zone. An *instant* predicate
compares `event_time` with the bounds as instants. Both reach the Parquet scan.
"""

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from kilowatch.vocabulary import CONSTANT_ZONES, DISPLAY_TZ


@dataclass(frozen=True)
class Interval:
    name: str
    unit: str
    label: str
    step: str


# Interval names, truncation unit, label pattern, distance between slots.
INTERVALS = {
    "min": Interval("min", "MINUTE", "yyyy-MM-dd HH:mm", "1 minute"),
    "hr": Interval("hr", "HOUR", "yyyy-MM-dd HH:00", "1 hour"),
    "day": Interval("day", "DAY", "yyyy-MM-dd", "1 day"),
    "month": Interval("month", "MONTH", "yyyy-MM", "1 month"),
    "year": Interval("year", "YEAR", "yyyy", "1 year"),
}
# Intervals of equal length.
STEP_SECONDS = {"min": 60, "hr": 3600, "day": 86400}
# Short codes, case-sensitive.
SHORT_CODES = {"m": "min", "h": "hr", "d": "day", "M": "month", "y": "year"}

# How far the rolling range reaches back.
ROLLING_MINUTES = 60
ROLLING_HOURS = 24
ROLLING_DAYS = 30
ROLLING_MONTH_DAYS = 365
ROLLING_YEAR_DAYS = 1825


def resolve_interval(code):
    interval = INTERVALS.get(SHORT_CODES.get(code, code))
    if interval is None:
        raise ValueError(f"unknown interval: {code!r}")
    return interval


def as_local(as_of, display_tz=DISPLAY_TZ):
    """`as_of` in the display zone. Text and zone-less datetimes are taken as local to that zone."""
    if as_of is None:
        raise ValueError("as_of is required")
    zone = ZoneInfo(display_tz)
    moment = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return moment.replace(tzinfo=zone) if moment.tzinfo is None else moment.astimezone(zone)


@dataclass(frozen=True)
class Span:
    """A time range in the display zone, and the first and last slot of its calendar where it has one.

    An absent `start` means "from the earliest reading", an absent `stop` "no upper bound".
    """

    start: datetime | None
    stop: datetime | None
    stop_included: bool = False
    first_slot: datetime | None = None
    last_slot: datetime | None = None


def period_start(moment, interval):
    """Start of the clock hour, day, month or year a bucket of this interval belongs to."""
    hour = moment.replace(minute=0, second=0, microsecond=0)
    starts = {
        "min": hour,
        "hr": hour.replace(hour=0),
        "day": hour.replace(hour=0, day=1),
        "month": hour.replace(hour=0, day=1, month=1),
    }
    return starts[interval.name]


def period_stop(start, interval):
    """Start of the following period, on the wall clock."""
    if interval.name == "min":
        return start + timedelta(hours=1)
    if interval.name == "hr":
        return start + timedelta(days=1)
    if interval.name == "month" or start.month == 12:
        return start.replace(year=start.year + 1, month=1)
    return start.replace(month=start.month + 1)


def bucket_start(moment, interval):
    floor = moment.replace(second=0, microsecond=0)
    if interval.name != "min":
        floor = floor.replace(minute=0)
    if interval.name in ("day", "month", "year"):
        floor = floor.replace(hour=0)
    if interval.name in ("month", "year"):
        floor = floor.replace(day=1)
    if interval.name == "year":
        floor = floor.replace(month=1)
    return floor


def rolling_span(as_of, interval):
    """The last hour, day, 30 days, year or five years; not truncated, no upper bound."""
    backs = {
        "min": lambda: as_of - timedelta(minutes=ROLLING_MINUTES),
        "hr": lambda: as_of - timedelta(hours=ROLLING_HOURS),
        "day": lambda: as_of - timedelta(days=ROLLING_DAYS),
        "month": lambda: as_of.replace(day=1) - timedelta(days=ROLLING_MONTH_DAYS),
        "year": lambda: as_of.replace(month=1, day=1) - timedelta(days=ROLLING_YEAR_DAYS),
    }
    return Span(backs[interval.name](), None)


def to_date_span(as_of, interval):
    """The last 60 minutes or 24 hours, or the month or year up to `as_of`, with one slot per bucket so far."""
    last = bucket_start(as_of, interval)
    if interval.name == "min":
        start = last - timedelta(minutes=59)
    elif interval.name == "hr":
        start = last - timedelta(hours=23)
    elif interval.name == "year":
        return Span(None, as_of, True, None, last)
    else:
        start = period_start(as_of, interval)
    return Span(start, as_of, True, start, last)


def full_period_span(as_of, interval):
    """The whole clock hour, day, month or year around `as_of`; for years everything before `as_of`."""
    if interval.name == "year":
        return Span(None, as_of, False, None, bucket_start(as_of, interval))
    start = period_start(as_of, interval)
    stop = period_stop(start, interval)
    steps = {"min": timedelta(minutes=1), "hr": timedelta(hours=1), "day": timedelta(days=1)}
    last = stop - steps[interval.name] if interval.name in steps else stop.replace(year=start.year, month=12)
    return Span(start, stop, False, start, last)


def require_utc(frame):
    """Texts and instants are turned into each other in the session's zone; another one than UTC would shift buckets."""
    zone = frame.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Z", "GMT", "Etc/UTC", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone has to be UTC, not {zone}; kilowatch.session.prepare sets it")


def wall_text(moment):
    """A bound in the text form of `time`."""
    return moment.strftime("%Y-%m-%d %H:%M:%S")


def instant_literal(moment):
    return F.lit(moment.astimezone(timezone.utc))


def in_span(readings, span, wall):
    """Predicate for a span, on `time` when `wall` is set and on `event_time` otherwise.

    A table that has `reading_date` also gets a date range, one day wider on both sides because a zone can move a
    reading to the neighbouring date; it prunes partitions and never decides by itself.
    """
    if wall:
        column, literal = F.col("time"), lambda moment: F.lit(wall_text(moment))
    else:
        column, literal = F.col("event_time"), instant_literal
    keep = column.isNotNull()
    dated = "reading_date" in readings.columns
    if span.start is not None:
        keep &= column >= literal(span.start)
        if dated:
            keep &= F.col("reading_date") >= F.lit((span.start - timedelta(days=1)).date())
    if span.stop is not None:
        keep &= (column <= literal(span.stop)) if span.stop_included else (column < literal(span.stop))
        if dated:
            keep &= F.col("reading_date") <= F.lit((span.stop + timedelta(days=1)).date())
    return keep


def constant_offset(display_tz):
    """Seconds a zone is ahead of UTC at all times from 1970 on, for the zones known to have such an offset, else None."""
    return CONSTANT_ZONES.get(display_tz)


def local_seconds(display_tz, consistent_time=False):
    """Wall clock of the display zone in seconds: `time` as written, or `event_time` moved to the zone. Null where the
    text is malformed.

    Moving by a constant is a fraction of the cost of a zone lookup per reading; it is used where it gives the same.
    """
    if consistent_time:
        return F.unix_seconds(F.try_to_timestamp("time"))
    looked_up = F.unix_seconds(F.from_utc_timestamp("event_time", display_tz))
    offset = constant_offset(display_tz)
    if offset is None:
        return looked_up
    instant = F.unix_seconds("event_time")
    return F.when(instant >= 0, instant + offset).otherwise(looked_up)


def bucket_of(local, interval):
    """Start of the bucket in local seconds: an 8-byte grouping key. Labels are formatted once per result row."""
    if interval.name in STEP_SECONDS:
        return local - F.pmod(local, F.lit(STEP_SECONDS[interval.name]))
    return F.unix_seconds(F.date_trunc(interval.unit, F.timestamp_seconds(local)))


def label_of(bucket, interval):
    return F.date_format(F.timestamp_seconds(bucket), interval.label)


def slot_literal(moment):
    """A slot or bound as a bucket."""
    return F.lit(int(moment.replace(tzinfo=timezone.utc).timestamp()))


def slot_sequence(first, last, interval):
    """Buckets from the first to the last, both given in local seconds."""
    starts = F.sequence(F.timestamp_seconds(first), F.timestamp_seconds(last), F.expr(f"INTERVAL {interval.step}"))
    return F.transform(starts, F.unix_seconds)
