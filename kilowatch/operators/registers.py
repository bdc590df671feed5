"""Cumulative registers: first and last reading of a group, consumption as their difference.

First and last are the readings with the least and greatest (time, value), so nothing is sorted by time and every task
hands on one row per group, however many readings an owner has. Ties on time are ordered by value.
"""

from pyspark.sql import Window, functions as F

from kilowatch.functions import rounding as R
from kilowatch.functions.grouping import hashed
from kilowatch.vocabulary import METER_PARTS, REGISTER


def register_rows(readings, scale=None):
    """Readings of the energy register. A row without a finite value is no reading, nor, where the scale is known, is one
    that 64 bits can't count."""
    value = F.col("value")
    held = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    if scale is not None:
        held &= R.units(value, scale).isNotNull()
    return readings.filter((F.col("value_name") == REGISTER) & held)


def ordered(clock):
    """A reading as (time, value), whole: least and greatest are the first and the last."""
    return F.struct(clock.alias("at"), F.col("value").alias("reading"))


def bucket_ends(rows, keys, *more):
    """First and last value per group by the column `order`; rows without an order only keep their group alive."""
    ends = rows.groupBy(*keys).agg(hashed(F.min("order")).alias("head"), F.max("order").alias("tail"), *more)
    return ends.select(
        *(c for c in ends.columns if c not in ("head", "tail")),
        F.col("head.reading").alias("first_value"),
        F.col("tail.reading").alias("last_value"),
    )


def first_last(rows, keys, clock):
    """First and last value per group by the text in `clock`, with that text, so that groups can be merged again.

    Rows without a value only keep their group alive.
    """
    tick = F.when(F.col("value").isNotNull(), ordered(F.col(clock)))
    return rows.groupBy(*keys).agg(
        hashed(F.min(tick)).alias("head"), F.max(tick).alias("tail"), F.count("value").alias("n")
    )


def meter_keys(per_meter):
    return list(METER_PARTS) if per_meter else []


def bucket_consumption(buckets, scale, per_meter=False, method="within"):
    """Consumption per (owner_name, bucket), null where the bucket holds no reading.

    `within` takes last - first inside the bucket. `lag` sums the steps between consecutive readings, which telescopes
    to the bucket's last reading minus the last one of the bucket before; the window runs over buckets, not readings.
    """
    if method not in ("within", "lag"):
        raise ValueError(f"unknown method: {method!r}")
    base = F.col("first_value")
    if method == "lag":
        earlier = (
            Window.partitionBy("owner_name", *meter_keys(per_meter))
            .orderBy("bucket")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        base = F.coalesce(F.last("last_value", ignorenulls=True).over(earlier), base)
    used = buckets.withColumn("used", R.difference(F.col("last_value"), base, scale))
    if not per_meter:
        return used
    since = [F.min("earliest").alias("earliest")] if "earliest" in buckets.columns else []
    return used.groupBy("owner_name", "bucket").agg(F.sum("used").alias("used"), *since)
