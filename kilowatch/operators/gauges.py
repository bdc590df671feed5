"""Gauges: means per bucket, one column per phase."""

from pyspark.sql import functions as F

from kilowatch.functions import rounding as R


def bucket_means(rows, columns, digits, scale=None, rounding="half_up"):
    """Mean per (owner_name, bucket) of each measure in `columns` (measure -> output name).

    Conditional aggregates instead of group, push and pivot: one shuffle, of pre-aggregated sums.
    """
    if len(columns) == 1:
        values = {name: F.col("value") for name in columns.values()}
    else:
        values = {name: F.when(F.col("value_name") == measure, F.col("value")) for measure, name in columns.items()}
    return rows.groupBy("owner_name", "bucket").agg(
        *(R.mean(value, digits, scale, rounding).alias(name) for name, value in values.items())
    )


def measure_means(rows, digits, scale=None, rounding="half_up"):
    """The long form: mean per (owner_name, bucket, value_name)."""
    return rows.groupBy("owner_name", "bucket", "value_name").agg(
        R.mean(F.col("value"), digits, scale, rounding).alias("mean_value")
    )
