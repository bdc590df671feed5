"""Schemas of raw messages, parsed messages and readings."""

from pyspark.sql import types as T

RAW_MESSAGE = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

NUMERIC_MESSAGE = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

TEXT_MESSAGE = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    ]
)

# The stored table. `time` is the text the meter sent, `event_time` the instant it stands for in the
# source zone, `reading_date` its calendar date as written (the partition column).
READINGS = T.StructType(
    [
        T.StructField("time", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("reading_date", T.DateType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("building_name", T.StringType()),
        T.StructField("floor_name", T.StringType()),
        T.StructField("S0", T.StringType()),
        T.StructField("L0", T.StringType()),
        T.StructField("owner_name", T.StringType()),
        T.StructField("value_name", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
