"""A stream of readings that keeps each reading once, however late it comes, and drops nothing else.

A repeated delivery is one that is in the table already, so the table itself is the state: no watermark refuses a meter that
reconnects after a day, and nothing is forgotten. Each batch drops its own repeats and anti-joins the rest with what is
stored for the stretches of time it touches: the dates prune folders, and the hours within them reach the scan as bounds on
`event_time`, by which Parquet skips the files and row groups of other batches. An in-order batch therefore reads the last
hour or so of its meters, a late one the hours it brings.

A batch that is run again doesn't see its own earlier folders, finds the same readings new, and replaces them. Two streams
into one table keep their readings apart only if no meter is in both, as neither sees what the other is about to write.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from kilowatch.sources import tables
from kilowatch.streaming.jobs import per_batch
from kilowatch.vocabulary import PATH_PARTS

#: What makes two deliveries one reading: path, time as written and value.
KEYS = [*PATH_PARTS[:-1], "time", "value"]
HOURS = 10_000  # of a batch that are told apart; with more, each date is one stretch
STRETCHES = 64  # bounds a scan is given one by one; with more, each date is one stretch
DATES = 4000  # folders named one by one; with more, all are listed
NO_DATE = "__HIVE_DEFAULT_PARTITION__"
HOUR = 3600 * 10**6


def _by_date(found):
    """Stretches (date, low, high) in microseconds, one a date."""
    dates = {}
    for date, low, high in found:
        before = dates.get(date)
        dates[date] = (low, high) if before is None else (min(low, before[0]), max(high, before[1]))
    return [(date, *bounds) for date, bounds in dates.items()]


def stretches(readings):
    """Rows (reading_date, low, high) of event time the readings touch, in microseconds; a malformed time has none of them.

    Neighbouring hours of a date are one stretch.
    """
    bounds = [F.unix_micros(F.min("event_time")).alias("low"), F.unix_micros(F.max("event_time")).alias("high")]
    hours = readings.groupBy("reading_date", F.date_trunc("hour", "event_time").alias("hour")).agg(*bounds).drop("hour")
    found = [tuple(row) for row in hours.limit(HOURS + 1).collect()]
    if len(found) > HOURS:
        found = [tuple(row) for row in readings.groupBy("reading_date").agg(*bounds).limit(DATES + 1).collect()]
    merged, none = [], [row for row in found if row[1] is None][:1]
    for date, low, high in sorted(row for row in found if row[1] is not None):
        if merged and merged[-1][0] == date and low - merged[-1][2] < HOUR:
            merged[-1] = (date, merged[-1][1], max(merged[-1][2], high))
        else:
            merged.append((date, low, high))
    return (merged if len(merged) <= STRETCHES else _by_date(merged)) + none


def _within(found):
    """Whether a stored reading lies in one of the stretches."""
    said = [
        "event_time IS NULL" if low is None else f"(reading_date = DATE'{date}' AND event_time BETWEEN timestamp_micros({low}) AND timestamp_micros({high}))"
        for date, low, high in found
    ]
    return F.expr(" OR ".join(said))


def stored(spark, path, found, writer=None, batch_id=None):
    """Readings of the table in the given stretches, but those of one writer's batch; None if no folder has any."""
    where = path.rstrip("/")
    if not found:
        return None
    reader, names = spark.read.schema(tables.LAYOUT).option("basePath", where), where
    if len(found) <= DATES:
        dates = {NO_DATE if date is None else date.isoformat() for date, _, _ in found}
        names = f"{where}/reading_date={{{','.join(sorted(dates))}}}"
    try:
        rows = reader.parquet(names)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if len(found) <= DATES:
        rows = rows.filter(_within(found))
    if writer is not None:
        rows = rows.filter(~((F.col("writer") == writer) & (F.col("batch_id") == batch_id)))
    return rows


def unseen(readings, earlier):
    """Readings once each that `earlier` doesn't have. Nulls are equal to nulls, and NaN to NaN."""
    new = readings.dropDuplicates(KEYS)
    if earlier is None:
        return new
    held = earlier.select(*(F.col(key).alias(f"held_{key}") for key in KEYS))
    same = [F.col(key).eqNullSafe(F.col(f"held_{key}")) for key in KEYS]
    return new.join(held, same, "left_anti")


def store_distinct(readings, path, checkpoint, every=None, available_now=False):
    """Append each reading of a stream to the readings table once."""

    def write(batch, writer, batch_id):
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            earlier = stored(spark, path, stretches(batch), writer, batch_id)
            new = unseen(batch, earlier).persist()
            try:
                tables.write_batch(new, path, writer, batch_id)
            finally:
                new.unpersist()
        finally:
            batch.unpersist()

    return per_batch(readings, checkpoint, write, every, available_now)
