"""Runs and outages of meters, and readings that come too late, on a stream.

A run is a stretch of readings none of which is more than `gap` after the one before; an outage lies between two runs.

`run_parts` leaves one row per owner and stretch of clock time as long as the gap: readings within one such stretch are of
one run, so its first and last time and its count are all that is needed, whatever order batches come in and however late
readings are. Parts merge like those of `streaming.buckets` (`store_parts`, `read_parts`, `compact`), and `runs` joins them
into islands, in two passes: within stretches of `CHUNK` parts first, then over what is left, so no task orders all parts of
an owner that never stops.

`live_runs` keeps sessions in Spark's state instead and hands them on once the watermark has passed them; what is later than
its delay is not counted there. `split_late` tells such readings apart before any state sees them: it stores those in time
as a readings table and those refused, with the watermark that refused them, in a table of their own.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Window, functions as F

from kilowatch.functions import timeaxis as X
from kilowatch.sources import tables
from kilowatch.streaming.jobs import per_batch
from kilowatch.vocabulary import METER_PARTS

CHUNK = 4096
GAP = "15 minutes"


def _micros(gap):
    """A gap such as "15 minutes" in microseconds."""
    number, unit = gap.split()
    return int(number) * {"second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}[unit.rstrip("s")]


def _keys(per_meter):
    return ["owner_name", *(METER_PARTS if per_meter else ())]


def _held(parts):
    """The keys of parts, however they were made."""
    return [name for name in _keys(True) if name in parts.columns]


# ---- mergeable parts ------------------------------------------------------------------------------------------------


def run_parts(readings, gap=GAP, per_meter=False):
    """(keys, part, first, last, n) of readings with a time."""
    X.require_utc(readings)
    at = F.unix_micros("event_time")
    part = at - F.pmod(at, F.lit(_micros(gap)))
    rows = readings.filter(F.col("event_time").isNotNull())
    rows = rows.select(*_keys(per_meter), part.alias("part"), at.alias("at"))
    return rows.groupBy(*_keys(per_meter), "part").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))


def merge_runs(parts):
    return parts.groupBy(*_held(parts), "part").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


def _islands(rows, keys, gap):
    """Rows (keys, first, last, n) whose neighbours are no further apart than the gap, as one."""
    order = Window.partitionBy(*keys).orderBy("first")
    apart = F.col("first") - F.lag("last").over(order) > _micros(gap)
    marked = rows.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy(*keys, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return found.drop("island")


def _joined(parts, gap):
    merged = merge_runs(parts)
    keys = _held(merged)
    chunk = F.floor(F.col("part") / F.lit(CHUNK * _micros(gap)))
    near = _islands(merged.withColumn("chunk", chunk).drop("part"), [*keys, "chunk"], gap).drop("chunk")
    return keys, _islands(near, keys, gap)


def runs(parts, gap=GAP):
    """(keys, first, last, readings) of every run of merged parts, as instants."""
    keys, found = _joined(parts, gap)
    return found.select(*keys, F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), F.col("n").alias("readings"))


def outages(parts, gap=GAP):
    """(keys, since, until) between one run and the next."""
    keys, found = _joined(parts, gap)
    following = F.lead("first").over(Window.partitionBy(*keys).orderBy("first"))
    found = found.withColumn("until", following).filter(F.col("until").isNotNull())
    return found.select(*keys, F.timestamp_micros("last").alias("since"), F.timestamp_micros("until").alias("until"))


# ---- sessions in state ----------------------------------------------------------------------------------------------


def live_runs(readings, gap=GAP, delay="1 hour", per_meter=False):
    """Runs the watermark has passed, each once: (keys, first, last, readings). For output mode `append`.

    A session ends a microsecond after the gap, so that readings exactly the gap apart are of one run, as in `runs`.
    """
    X.require_utc(readings)
    session = F.session_window("event_time", f"{_micros(gap) + 1} microseconds")
    found = readings.withWatermark("event_time", delay).groupBy(*_keys(per_meter), session)
    found = found.agg(F.min("event_time").alias("first"), F.max("event_time").alias("last"), F.count("*").alias("readings"))
    return found.select(*_keys(per_meter), "first", "last", "readings")


# ---- late readings --------------------------------------------------------------------------------------------------


def _marks_path(path):
    return f"{path.rstrip('/')}/_marks"


def _newest_before(spark, path, writer, batch_id):
    """The newest reading of all earlier batches of the stream, or None."""
    try:
        marks = spark.read.schema("newest TIMESTAMP, writer STRING, batch_id BIGINT").parquet(_marks_path(path))
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    earlier = marks.filter((F.col("writer") == writer) & (F.col("batch_id") < batch_id))
    return earlier.agg(F.max("newest").alias("newest")).first()["newest"]


def split_late(readings, path, late_path, checkpoint, delay="1 hour", every=None, available_now=False):
    """Store the readings of a stream that are in time, and, apart, those more than `delay` behind the newest reading of all
    batches before their own.

    The marks of earlier batches are stored, so a batch that is run again refuses the same readings. Readings without an
    instant are never late.
    """
    behind = F.expr(f"INTERVAL {delay}")

    def write(batch, writer, batch_id):
        spark = batch.sparkSession
        newest = _newest_before(spark, path, writer, batch_id)
        mark = F.lit(newest) - behind if newest is not None else F.lit(None).cast("timestamp")
        batch = batch.persist()
        try:
            late = F.coalesce(F.col("event_time") < mark, F.lit(False))
            tables.write_batch(batch.filter(~late), path, writer, batch_id)
            refused = batch.filter(late).withColumn("watermark", mark)
            refused.write.mode("overwrite").parquet(tables.batch_folder(late_path, writer, batch_id))
            seen = batch.agg(F.max("event_time").alias("newest"))
            seen.write.mode("overwrite").parquet(tables.batch_folder(_marks_path(path), writer, batch_id))
        finally:
            batch.unpersist()

    return per_batch(readings, checkpoint, write, every, available_now)


def read_late(spark, late_path, schema):
    """All refused readings, with the watermark of their batch; the schema is that of the readings."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return spark.read.schema(f"{fields}, watermark TIMESTAMP").parquet(late_path)


def late_counts(late):
    """Per owner: refused readings and how far behind, in seconds, the worst of them was."""
    behind = F.max(F.unix_seconds("watermark") - F.unix_seconds("event_time")).alias("most_behind")
    return late.groupBy("owner_name").agg(F.count("*").alias("refused"), behind)
