"""Bucket results kept up to date while readings arrive, in two ways.

With a watermark (`live_...`), the state holds one row per owner and open bucket, the watermark closes buckets, and readings
that come later than `delay` are not counted. Without one (`..._parts`), batches leave parts that merge, and every reading
counts.
"""

from pyspark.sql import functions as F

from kilowatch.functions import rounding as R, timeaxis as X
from kilowatch.functions.grouping import hashed
from kilowatch.operators import registers
from kilowatch.sources.tables import batch_folder
from kilowatch.streaming.jobs import per_batch
from kilowatch.vocabulary import DISPLAY_TZ


def local_window(interval, display_tz=DISPLAY_TZ):
    """Tumbling window whose edges are the display zone's bucket starts."""
    seconds, offset = X.STEP_SECONDS.get(interval.name), X.constant_offset(display_tz)
    if seconds is None or offset is None:
        raise ValueError(f"no windows of equal length for {interval.name} in {display_tz}")
    shift = -offset % seconds
    return F.window("event_time", f"{seconds} seconds", f"{seconds} seconds", f"{shift} seconds")


def _labelled(result, interval, display_tz, *columns):
    start = F.unix_seconds("window.start") + X.constant_offset(display_tz)
    return result.select("owner_name", X.label_of(start, interval).alias("time"), *columns)


def live_means(
    readings, interval, columns, digits=2, delay="1 hour", display_tz=DISPLAY_TZ, scale=None, rounding="half_up"
):
    """Means per owner and bucket of the measures in `columns` (measure -> output name)."""
    interval = X.resolve_interval(interval)
    values = {name: F.when(F.col("value_name") == measure, F.col("value")) for measure, name in columns.items()}
    result = (
        readings.filter(F.col("value_name").isin(*columns))
        .withWatermark("event_time", delay)
        .groupBy("owner_name", local_window(interval, display_tz))
        .agg(*(R.mean(value, digits, scale, rounding).alias(name) for name, value in values.items()))
    )
    return _labelled(result, interval, display_tz, *columns.values())


def live_consumption(readings, interval, delay="1 hour", display_tz=DISPLAY_TZ, scale=None, rounding="half_up"):
    """Register consumption per owner and bucket, as far as it has arrived."""
    interval = X.resolve_interval(interval)
    window = local_window(interval, display_tz)
    rows = registers.register_rows(readings, scale).withWatermark("event_time", delay)
    rows = rows.withColumn("order", registers.ordered(F.col("event_time")))
    result = registers.bucket_ends(rows, ["owner_name", window])
    used = R.difference(F.col("last_value"), F.col("first_value"), scale)
    return _labelled(result, interval, display_tz, R.rounded(used, 6, rounding).alias("energy"))


def store_updates(live, path, checkpoint, every=None, available_now=False):
    """Write the buckets each batch has changed, a folder per stream and batch. A stream of its own needs a path of its own."""

    def write(batch, writer, batch_id):
        batch.write.mode("overwrite").parquet(batch_folder(path, writer, batch_id))

    return per_batch(live, checkpoint, write, every, available_now, mode="update")


def read_latest(spark, path, schema):
    """The last written state of every bucket; of several streams into one path, that of the one with the later batch."""
    names = [name for name in schema.fieldNames() if name not in ("owner_name", "time")]
    updates = spark.read.schema(f"{_ddl(schema)}, writer STRING, batch_id BIGINT").parquet(path)
    newest = updates.groupBy("owner_name", "time").agg(
        hashed(F.max_by(F.struct(*names), F.struct("batch_id", "writer"))).alias("state")
    )
    return newest.select("owner_name", "time", "state.*")


# ---- buckets without a watermark ------------------------------------------------------------------------------------
#
# A batch leaves, for each owner and bucket it touches, what later batches can be merged with: the first and last reading,
# or count and sum. Nothing is held in state, so a reading counts however late it comes, and calendar months and years work
# like any other bucket. Reading merges; `compact` merges for good.


def consumption_parts(readings, interval, display_tz=DISPLAY_TZ, scale=None):
    """First and last register reading per owner and bucket."""
    interval = X.resolve_interval(interval)
    X.require_utc(readings)
    bucket = X.bucket_of(X.local_seconds(display_tz), interval)
    rows = registers.register_rows(readings, scale).filter(F.col("event_time").isNotNull())
    rows = rows.select("owner_name", bucket.alias("bucket"), registers.ordered(F.col("event_time")).alias("order"))
    return rows.groupBy("owner_name", "bucket").agg(hashed(F.min("order")).alias("head"), F.max("order").alias("tail"))


def merge_consumption(parts):
    return parts.groupBy("owner_name", "bucket").agg(hashed(F.min("head")).alias("head"), F.max("tail").alias("tail"))


def consumption(parts, interval, scale=None, rounding="half_up", method="within"):
    """Consumption per owner and bucket of merged parts.

    With `method="lag"` a bucket also has the step from the last reading before it. A part's steps are its last reading less
    its first, which merges like these do, whatever order parts come in; what lies between two buckets is added by one pass
    over an owner's merged buckets, so a late part also changes the bucket after it.
    """
    label = X.label_of(F.col("bucket"), X.resolve_interval(interval))
    merged = merge_consumption(parts)
    ends = merged.select("owner_name", "bucket", F.col("head.reading").alias("first_value"), F.col("tail.reading").alias("last_value"))
    used = registers.bucket_consumption(ends, scale, method=method)
    return used.select("owner_name", label.alias("time"), R.rounded(F.col("used"), 6, rounding).alias("energy"))


def mean_parts(readings, interval, columns, display_tz=DISPLAY_TZ, scale=None):
    """What means are made of, per owner and bucket, of the measures in `columns` (measure -> output name): count and sum."""
    interval = X.resolve_interval(interval)
    X.require_utc(readings)
    bucket = X.bucket_of(X.local_seconds(display_tz), interval)
    rows = readings.filter(F.col("value_name").isin(*columns) & F.col("event_time").isNotNull())
    found = []
    for measure, name in columns.items():
        value = F.when(F.col("value_name") == measure, F.col("value") if scale is None else R.units(F.col("value"), scale))
        sums = R.exact_sums(value) if scale is None else {"n": F.count(value), "sum": F.sum(value)}
        found += [part.alias(f"{name}_{kind}") for kind, part in sums.items()]
    return rows.groupBy("owner_name", bucket.alias("bucket")).agg(*found)


def merge_means(parts):
    kinds = dict(parts.dtypes)
    names = [name for name in parts.columns if name not in ("owner_name", "bucket", "writer", "batch_id")]
    # Sums keep their type, so that merged parts merge again.
    return parts.groupBy("owner_name", "bucket").agg(*(F.sum(name).cast(kinds[name]).alias(name) for name in names))


def means(parts, interval, digits=2, scale=None, rounding="half_up"):
    """Means per owner and bucket of merged parts."""
    merged = merge_means(parts)
    shown = []
    for name in (c.removesuffix("_n") for c in merged.columns if c.endswith("_n")):
        if scale is None:
            sums = {kind: F.col(f"{name}_{kind}") for kind in ("n", "sum", "odd", "doubles")}
            shown.append(R.mean_of(sums, digits, rounding).alias(name))
            continue
        total, count = F.col(f"{name}_sum").cast("decimal(20,0)"), (F.col(f"{name}_n") * F.lit(10**scale)).cast("decimal(20,0)")
        shown.append(R.rounded(F.try_divide(total, count), digits, rounding).alias(name))
    label = X.label_of(F.col("bucket"), X.resolve_interval(interval))
    return merged.select("owner_name", label.alias("time"), *shown)


def store_parts(readings, parts, path, checkpoint, every=None, available_now=False):
    """Write `parts(batch)` of each batch of a stream of readings, a folder per stream and batch."""

    def write(batch, writer, batch_id):
        parts(batch).write.mode("overwrite").parquet(batch_folder(path, writer, batch_id))

    return per_batch(readings, checkpoint, write, every, available_now)


def read_parts(spark, path, schema):
    """All written parts; the schema is that of `parts(readings)`."""
    return spark.read.schema(_plain(schema)).parquet(path)


def compact(spark, path, schema, merge, target):
    """Merge the parts of all batches into a new path; writing it again gives the same."""
    merge(read_parts(spark, path, schema)).write.mode("overwrite").parquet(target)


def _plain(schema):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)


def _ddl(schema):
    return ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in schema)
