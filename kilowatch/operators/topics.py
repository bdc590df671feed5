"""Data jobs over raw-message tables with topic, partition, offset and timestamp columns."""

from pyspark.sql import functions as F

from kilowatch.functions.messages import message_text
from kilowatch.vocabulary import RETENTION_HOURS


def to_messages(rows, value=None):
    """Rows as JSON messages: the whole row, or one column as is."""
    if value is not None:
        return rows.select(F.col(value).cast("string").alias("value"))
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def unwrapped(raw, payload_type="STRING", name="payload"):
    """Payload of `{"schema": ..., "payload": ...}` envelopes."""
    message = F.from_json(message_text(), f"schema STRING, payload {payload_type}")
    return raw.withColumn(name, message["payload"])


def wrapped(raw, schema_text):
    """Put the payload into a `{"schema": ..., "payload": ...}` envelope."""
    envelope = F.struct(F.lit(schema_text).alias("schema"), message_text().alias("payload"))
    return raw.withColumn("value", F.to_json(envelope))


def mirrored(raw, topic_pattern):
    """Messages of the topics whose whole name matches."""
    return raw.filter(F.col("topic").rlike(f"^(?:{topic_pattern})$"))


def offset_ranges(raw):
    return raw.groupBy("topic", "partition").agg(
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
        F.count(F.lit(1)).alias("messages"),
    )


def retained(raw, as_of, hours=RETENTION_HOURS):
    """Messages younger than the retention time."""
    return raw.filter(F.col("timestamp") >= F.lit(as_of) - F.expr(f"INTERVAL {hours} HOURS"))
