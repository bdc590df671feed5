"""Consumption per slot of a calendar kept by a stream, empty slots included.

Time passes with the newest reading: once it has left a slot behind, every owner gets a row for that slot, with zero where
there was no reading, in the batch that closed it. A reading that comes later corrects its slot; an owner that is new gets
all slots closed so far. `read_slots` gives the last word on every owner and slot.

A batch reads the parts of the slots it writes, its own and earlier ones, which batches leave as in `streaming.buckets`; marks
and owners of earlier batches are small tables beside them. All of it is in folders per batch, which a batch that is run
again replaces, having seen what it saw before.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from kilowatch.functions import rounding as R, timeaxis as X
from kilowatch.functions.grouping import hashed
from kilowatch.sources.tables import batch_folder
from kilowatch.streaming import buckets
from kilowatch.streaming.jobs import per_batch
from kilowatch.vocabulary import DISPLAY_TZ

SCHEMA = "owner_name STRING, bucket BIGINT, energy DOUBLE"
AT = "STRUCT<at: TIMESTAMP, reading: DOUBLE>"


def _earlier(spark, path, schema, writer, batch_id, own=False):
    """What earlier batches of the stream left in a folder, or None."""
    try:
        rows = spark.read.schema(f"{schema}, writer STRING, batch_id BIGINT").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    before = F.col("batch_id") <= batch_id if own else F.col("batch_id") < batch_id
    return rows.filter((F.col("writer") == writer) & before).drop("writer", "batch_id")


def store_slots(readings, path, checkpoint, interval="hr", display_tz=DISPLAY_TZ, scale=None, rounding="half_up", every=None, available_now=False):
    """Keep the consumption of every owner and closed slot of a stream of readings."""
    interval = X.resolve_interval(interval)
    if interval.name not in X.STEP_SECONDS or X.constant_offset(display_tz) is None:
        raise ValueError(f"no slots of equal length for {interval.name} in {display_tz}")
    step, where = X.STEP_SECONDS[interval.name], path.rstrip("/")

    def write(batch, writer, batch_id):
        spark = batch.sparkSession
        folder = lambda kind: batch_folder(f"{where}/{kind}", writer, batch_id)
        parts = buckets.consumption_parts(batch, interval.name, display_tz, scale)
        parts.write.mode("overwrite").parquet(folder("parts"))
        own = spark.read.schema(f"owner_name STRING, bucket BIGINT, head {AT}, tail {AT}").parquet(folder("parts"))

        marks = _earlier(spark, f"{where}/marks", "first BIGINT, open BIGINT", writer, batch_id)
        before = marks.agg(F.min("first"), F.max("open")).first() if marks is not None else (None, None)
        seen = own.agg(F.min("bucket"), F.max("bucket")).first()
        first = min((b for b in (before[0], seen[0]) if b is not None), default=None)
        now = max((b for b in (before[1], seen[1]) if b is not None), default=None)
        mark = spark.createDataFrame([(first, now)], "first BIGINT, open BIGINT").coalesce(1)
        mark.write.mode("overwrite").parquet(folder("marks"))

        names = own.select("owner_name").distinct()
        known = _earlier(spark, f"{where}/owners", "owner_name STRING", writer, batch_id)
        known = known.distinct() if known is not None else names.limit(0)
        fresh = names.join(known.select(F.col("owner_name").alias("known")), F.col("owner_name").eqNullSafe(F.col("known")), "left_anti")
        fresh.coalesce(1).write.mode("overwrite").parquet(folder("owners"))
        if now is None:
            return

        opened = before[1] if before[1] is not None else first
        # Slots that closed with this batch, for owners known before; all closed ones for new owners; those a late reading
        # belongs to. A first slot that moves back gives all owners the slots before the old one.
        since = [(known, opened, now), (fresh, first, now)]
        if before[0] is not None and first < before[0]:
            since.append((known, first, min(before[0], now)))
        due = own.filter(F.col("bucket") < opened).select("owner_name", "bucket")
        for owners, low, high in since:
            if low < high:
                due = due.unionByName(owners.select("owner_name", F.explode(F.sequence(F.lit(low), F.lit(high - step), F.lit(step))).alias("bucket")))
        due = due.distinct()
        least = due.agg(F.min("bucket")).first()[0]
        if least is None:
            return
        every_part = _earlier(spark, f"{where}/parts", f"owner_name STRING, bucket BIGINT, head {AT}, tail {AT}", writer, batch_id, own=True)
        merged = buckets.merge_consumption(every_part.filter(F.col("bucket").between(least, now)))
        used = R.rounded(R.difference(F.col("tail.reading"), F.col("head.reading"), scale), 6, rounding)
        held = merged.select(F.col("owner_name").alias("owner"), F.col("bucket").alias("slot"), used.alias("energy"))
        found = due.join(held, F.col("owner_name").eqNullSafe(F.col("owner")) & (F.col("bucket") == F.col("slot")), "left")
        found.select("owner_name", "bucket", F.coalesce("energy", F.lit(0.0)).alias("energy")).write.mode("overwrite").parquet(folder("slots"))

    return per_batch(readings, checkpoint, write, every, available_now)


def read_slots(spark, path, interval="hr"):
    """(owner_name, time, energy) of every owner and closed slot, as last written; none as long as no slot has closed."""
    kinds = f"{SCHEMA}, writer STRING, batch_id BIGINT"
    try:
        rows = spark.read.schema(kinds).parquet(f"{path.rstrip('/')}/slots")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], kinds)
    last = rows.groupBy("owner_name", "bucket").agg(hashed(F.max_by("energy", F.struct("batch_id", "writer"))).alias("energy"))
    return last.select("owner_name", X.label_of(F.col("bucket"), X.resolve_interval(interval)).alias("time"), "energy")
