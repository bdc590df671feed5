"""Registers rolled up by minute, hour, day and month, and questions answered from the rolled-up nodes.

Each level holds, per owner and bucket, the first and last reading and their number: what a range of readings is asked for.
Batches leave parts of every level, each made from the one below; parts merge in any order, so late readings count and
nothing is ever rebuilt (`compact` merges the parts of closed batches for good).

A range is cut as in a range tree: whole months, then the whole days, hours and minutes left at its two ends, and readings
only within the two minutes at its edges. What is read grows with the number of buckets in the cut, at most some 60 + 24 + 31
at either end and one a month between, not with the readings.

`wall` tells whose clock buckets follow: the text as written (ranges by text, as `range_consumption` and `energy_stats` have
them; texts that are no times in the usual form are in no node), or the instant in the display zone. Zones that shift their clocks are refused for the latter, as hours that occur twice
would share a bucket with themselves.
"""

from datetime import timedelta, timezone

from pyspark.sql import functions as F

from kilowatch.functions import rounding as R, timeaxis as X
from kilowatch.functions.grouping import hashed
from kilowatch.operators import calendar as C, owners as O, registers as S
from kilowatch.plans.queries import energy_if_two, stats_of
from kilowatch.sources.tables import batch_folder
from kilowatch.streaming.jobs import per_batch
from kilowatch.vocabulary import DISPLAY_TZ, GHG_PER_UNIT, UNIT_COST

LEVELS = ("min", "hr", "day", "month")
SCHEMA = "owner_name STRING, bucket BIGINT, head STRUCT<at: {at}, reading: DOUBLE>, tail STRUCT<at: {at}, reading: DOUBLE>, n BIGINT"


def _at(wall):
    return F.col("time") if wall else F.col("event_time")


def _local(wall, display_tz):
    if not wall and X.constant_offset(display_tz) is None:
        raise ValueError(f"no nodes of equal length in {display_tz}")
    return X.local_seconds(display_tz, consistent_time=wall)


def _ends(rows, *keys):
    return rows.groupBy(*keys).agg(hashed(F.min("head")).alias("head"), F.max("tail").alias("tail"), F.sum("n").cast("bigint").alias("n"))


def _leaves(readings, scale, wall, display_tz, *more):
    """One row per register reading, as a node of its own."""
    X.require_utc(readings)
    rows = S.register_rows(readings, scale).withColumn("local", _local(wall, display_tz)).filter(F.col("local").isNotNull())
    order = S.ordered(_at(wall))
    return rows.select("owner_name", "local", order.alias("head"), order.alias("tail"), F.lit(1).cast("bigint").alias("n"), *more)


def _path(path, name):
    return f"{path.rstrip('/')}/level={name}"


def write_rollups(readings, path, writer, batch_id, scale=None, wall=False, display_tz=DISPLAY_TZ):
    """Write the parts of one batch; written again, they replace themselves."""
    below = None
    for name in LEVELS:
        rows = _leaves(readings, scale, wall, display_tz) if below is None else below.withColumn("local", F.col("bucket"))
        parts = _ends(rows.withColumn("bucket", X.bucket_of(F.col("local"), X.INTERVALS[name])), "owner_name", "bucket")
        target = batch_folder(_path(path, name), writer, batch_id)
        # Clustered by bucket, so that a range skips row groups.
        parts.repartitionByRange("bucket").sortWithinPartitions("bucket", "owner_name").write.mode("overwrite").parquet(target)
        below = readings.sparkSession.read.schema(_schema(wall)).parquet(target)


def store_rollups(readings, path, checkpoint, every=None, available_now=False, **options):
    """Keep the rollups of a stream of readings."""

    def write(batch, writer, batch_id):
        batch = batch.persist()
        try:
            write_rollups(batch, path, writer, batch_id, **options)
        finally:
            batch.unpersist()

    return per_batch(readings, checkpoint, write, every, available_now)


def compact(spark, path, target, wall=False):
    """Merge the parts of all batches into a new path; writing it again gives the same."""
    for name in LEVELS:
        merged = _ends(nodes(spark, path, name, wall), "owner_name", "bucket")
        merged.repartitionByRange("bucket").sortWithinPartitions("bucket", "owner_name").write.mode("overwrite").parquet(batch_folder(_path(target, name), "compacted", 0))


def _schema(wall):
    return SCHEMA.format(at="STRING" if wall else "TIMESTAMP")


def nodes(spark, path, level, wall=False):
    return spark.read.schema(_schema(wall)).parquet(_path(path, level))


# ---- ranges ---------------------------------------------------------------------------------------------------------


def _up(moment, interval):
    start = X.bucket_start(moment, interval)
    if start == moment:
        return start
    if interval.name == "month":
        return X.period_stop(start, X.INTERVALS["day"])
    return start + timedelta(seconds=X.STEP_SECONDS[interval.name])


def cut(start, stop):
    """A range [start, stop) of local time as nodes: rows (level, first, stop), and the stretches left over as readings.

    Without a start the range begins with the first month there is.
    """
    found, ranges = [], [(start, stop)]
    for name in reversed(LEVELS):
        interval, rest = X.INTERVALS[name], []
        for low, high in ranges:
            first, last = low and _up(low, interval), X.bucket_start(high, interval)
            if first is not None and first >= last:
                rest.append((low, high))
                continue
            found.append((name, first, last))
            rest += [r for r in ((low, first), (last, high)) if r[0] is not None and r[0] < r[1]]
        ranges = rest
    return found, ranges


class Rollup:
    """Stored rollups and the readings they were made of, for the edges."""

    def __init__(self, spark, path, readings, scale=None, wall=False, display_tz=DISPLAY_TZ):
        self.spark, self.path, self.readings = spark, path, readings
        self.scale, self.wall, self.display_tz = scale, wall, display_tz

    def _bound(self, moment):
        """A local time in the terms of the clock."""
        if self.wall:
            return F.lit(X.wall_text(moment))
        return F.lit((moment - timedelta(seconds=X.constant_offset(self.display_tz))).replace(tzinfo=timezone.utc))

    def _edge(self, low, high):
        """Readings of a stretch of less than a minute or two, as nodes; dates prune, a day wider on both sides."""
        rows = self.readings
        if "reading_date" in rows.columns:
            rows = rows.filter(F.col("reading_date").between(F.lit((low - timedelta(days=1)).date()), F.lit((high + timedelta(days=1)).date())))
        rows = rows.filter(_at(self.wall).between(self._bound(low), self._bound(high)))
        leaves = _leaves(rows, self.scale, self.wall, self.display_tz, _at(self.wall).alias("at"))
        return leaves.withColumn("bucket", F.col("local"))

    def between(self, start, stop, included=True):
        """(owner_name, bucket, head, tail, n) that cover the local range from `start` to `stop`, the stop included or not.

        A bucket is the start of its node, or a reading's own second.
        """
        start, stop = (t and t.replace(tzinfo=None) for t in (start, stop))
        whole, edges = cut(start, stop)
        # The stop itself is a reading's time: the last edge, if need be of no length, reaches it.
        if included and not any(high == stop for _, high in edges):
            edges = [*edges, (stop, stop)]
        found = None
        columns = ["owner_name", "bucket", "head", "tail", "n"]
        for name, first, last in whole:
            rows = nodes(self.spark, self.path, name, self.wall).filter(F.col("bucket") < X.slot_literal(last))
            rows = rows.filter(F.col("bucket") >= X.slot_literal(first)) if first is not None else rows
            found = rows.select(columns) if found is None else found.unionByName(rows.select(columns))
        for low, high in edges:
            rows = self._edge(low, high)
            if not (included and high == stop):
                rows = rows.filter(F.col("at") < self._bound(high))
            found = rows.select(columns) if found is None else found.unionByName(rows.select(columns))
        return found


def _shown(owners, totals):
    """Owners with what was found of them, if anything; an owner without a name is one as well."""
    held = totals.withColumnRenamed("owner_name", "_owner")
    return owners.join(held, F.col("owner_name").eqNullSafe(F.col("_owner")), "left").drop("_owner")


def range_consumption(rollup, start, stop, owners, rounding="half_up"):
    """As `plans.queries.range_consumption`, of a rollup by the text as written; `owners` is the table of owners to show."""
    start, stop = (X.as_local(t, rollup.display_tz) for t in (start, stop))
    shown = _shown(owners.select("owner_name").distinct(), _ends(rollup.between(start, stop), "owner_name"))
    used = energy_if_two(F.coalesce("n", F.lit(0)), F.col("tail.reading"), F.col("head.reading"), rollup.scale, rounding)
    return shown.select("owner_name", used.alias("energy"))


def energy_stats(rollup, as_of, owners, unit_cost=UNIT_COST, rounding="half_up"):
    """As `plans.queries.energy_stats`, of a rollup by the text as written."""
    now = X.as_local(as_of, rollup.display_tz)
    starts = {"one_day": "hr", "one_month": "day", "one_year": "month"}
    shown = owners.select("owner_name").distinct()
    for name, interval in starts.items():
        total = _ends(rollup.between(X.period_start(now, X.INTERVALS[interval]), now), "owner_name")
        shown = _shown(shown, total.select("owner_name", *(F.col(c).alias(f"{name}_{c}") for c in ("n", "head", "tail"))))
    return stats_of(shown.fillna(0, [f"{name}_n" for name in starts]), starts, unit_cost, rollup.scale, rounding)


def _by_year(rollup, stop, included):
    """Consumption per owner and year up to `stop`; years start with an owner's first reading, whenever that is."""
    interval = X.INTERVALS["year"]
    counted = rollup.between(None, stop, included).withColumn("bucket", X.bucket_of(F.col("bucket"), interval))
    first = _ends(nodes(rollup.spark, rollup.path, "month", rollup.wall), "owner_name").select("owner_name", F.col("head.at").alias("at"))
    seen = F.unix_seconds(F.try_to_timestamp("at") if rollup.wall else F.col("at"))
    first = first.select("owner_name", X.bucket_of(seen, interval).alias("earliest"))
    ends = _ends(counted, "owner_name", "bucket").select("owner_name", "bucket", F.col("head.reading").alias("first_value"), F.col("tail.reading").alias("last_value"))
    used = S.bucket_consumption(ends, rollup.scale).select("owner_name", "bucket", "used")
    rows = first.withColumns({"bucket": F.col("earliest"), "used": F.lit(None).cast(used.schema["used"].dataType)})
    rows = used.withColumn("earliest", F.lit(None).cast("bigint")).unionByName(rows)
    last = X.slot_literal(X.bucket_start(stop, interval))
    return C.filled(rows, "used", F.col("earliest"), last, interval, None, [F.min("earliest").alias("earliest")])


def energy_by_year(rollup, as_of, rounding="half_up"):
    """As `plans.queries.energy_consumption` by year, of a rollup by instants."""
    dense = _by_year(rollup, X.as_local(as_of, rollup.display_tz), False)
    energy = F.coalesce(R.rounded(F.col("used"), 6, rounding), F.lit(0.0))
    return dense.select("owner_name", X.label_of(F.col("bucket"), X.INTERVALS["year"]).alias("time"), energy.alias("energy"))


def emission_by_year(rollup, as_of, per_unit=GHG_PER_UNIT, rounding="half_up"):
    """As `plans.queries.ghg_emission` by year, of a rollup by the text as written."""
    dense = _by_year(rollup, X.as_local(as_of, rollup.display_tz), True)
    emitted = F.greatest(F.col("used"), F.lit(0)) * R.factor(per_unit, rollup.scale)
    emission = F.coalesce(R.rounded(emitted, 6, rounding), F.lit(0.0))
    return dense.select("owner_name", X.label_of(F.col("bucket"), X.INTERVALS["year"]).alias("time"), emission.alias("ghg_emission"))
