"""Streaming jobs. Each starts a query and returns it; `wait` blocks until it ends.

Positions live in the checkpoint of the stream. Sinks that are folders get one per batch, replaced when a batch is run
again, so that a restart after losing the driver or executors gives every message exactly once. A topic has no such
folders: there a batch that is run again repeats its messages (at least once).
"""

from pyspark.sql import functions as F

from kilowatch.operators import ingest, topics
from kilowatch.sources.streams import publish, sent
from kilowatch.sources.tables import batch_folder, write_batch
from kilowatch.vocabulary import SAMPLE_SECONDS, SOURCE_TZ


def _paced(writer, every, available_now):
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=every) if every else writer


def query_id(spark, checkpoint):
    """Identity of a stream as its checkpoint keeps it: the same after a restart, a new one for a new checkpoint."""
    metadata = spark.read.text(f"{checkpoint.rstrip('/')}/metadata")
    return metadata.select(F.get_json_object("value", "$.id").alias("id")).first()["id"]


def per_batch(stream, checkpoint, write, every, available_now, mode="append"):
    """foreachBatch with the stream's identity, so that two streams into one table never share a folder."""

    identity = []

    def run(batch, batch_id):
        if not identity:
            identity.append(query_id(batch.sparkSession, checkpoint))
        write(batch, identity[0], batch_id)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(run)
    return _paced(writer, every, available_now).start()


def store_readings(
    raw,
    path,
    checkpoint,
    source_tz=SOURCE_TZ,
    salvage=False,
    drop_nan=False,
    every=None,
    available_now=False,
    keep_malformed=True,
):
    """Flatten energy-meter messages and append them to the readings table and, by name, to its list of owners."""
    readings = ingest.flatten(raw, source_tz, salvage, drop_nan, keep_malformed=keep_malformed)

    def write(batch, writer, batch_id):
        write_batch(batch, path, writer, batch_id)

    return per_batch(readings, checkpoint, write, every, available_now)


def store_dead_letters(
    raw, path, checkpoint, every=None, available_now=False, salvage=False, drop_nan=False, keep_malformed=True
):
    """Keep the messages that give no reading, with the reason. Takes the options given to `store_readings`, so that every
    message is either stored or reported."""

    def write(batch, writer, batch_id):
        batch.write.mode("overwrite").parquet(batch_folder(path, writer, batch_id))

    return per_batch(ingest.dead_letters(raw, salvage, drop_nan, keep_malformed=keep_malformed), checkpoint, write, every, available_now)


def show_wide(raw, sink="console", name=None, checkpoint=None, every=None, available_now=False):
    """Print the three live parameters of each message as it arrives; `memory` keeps them in a table instead."""
    writer = ingest.widen(raw).writeStream.outputMode("append").format(sink)
    if sink == "console":
        writer = writer.option("truncate", "false")
    if name:
        writer = writer.queryName(name)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return _paced(writer, every, available_now).start()


def forward_latest(raw, target, checkpoint, servers=None, every=f"{SAMPLE_SECONDS} seconds", available_now=False):
    """Once per trigger, publish the newest accepted message of the batch, or nothing.

    The batch is the buffer: it is replayed when publishing fails and done with when it succeeds.
    """

    def write(batch, writer, batch_id):
        latest = ingest.newest(batch).filter(F.col("value").isNotNull())
        publish(latest, target if servers else batch_folder(target, writer, batch_id), servers)

    return per_batch(ingest.accepted(raw), checkpoint, write, every, available_now)


def forward_slots(
    raw, target, checkpoint, servers=None, seconds=SAMPLE_SECONDS, delay="0 seconds", every=None, available_now=False
):
    """Publish the newest accepted message of each stretch of arrival time, once, however batches fall.

    The slot is state: it outlives a batch that brings nothing for it, a restart, and a send that fails, after which the
    same slots are sent again. It is emptied by time, when later messages have arrived.
    """

    def write(batch, writer, batch_id):
        publish(batch.drop("arrival"), target if servers else batch_folder(target, writer, batch_id), servers)

    return per_batch(ingest.latest_by_slot(raw, seconds, delay), checkpoint, write, every, available_now)


def lines_to_topic(lines, target, checkpoint, servers=None, every=None, available_now=False):
    """Publish each line as a message."""

    def write(batch, writer, batch_id):
        publish(batch, target if servers else batch_folder(target, writer, batch_id), servers)

    return per_batch(topics.to_messages(lines, "value"), checkpoint, write, every, available_now)


def topic_to_lines(raw, path, checkpoint, every=None, available_now=False):
    """Append each message to text files, one per line."""
    writer = topics.to_messages(raw, "value").writeStream.outputMode("append").format("text")
    writer = writer.option("checkpointLocation", checkpoint).option("path", path)
    return _paced(writer, every, available_now).start()


def topic_to_console(raw, every=None, available_now=False):
    """Print each message untruncated."""
    writer = topics.to_messages(raw, "value").writeStream.outputMode("append").format("console")
    return _paced(writer.option("truncate", "false"), every, available_now).start()


def mirror_topics(raw, topic_pattern, path, checkpoint, servers=None, every=None, available_now=False):
    """Copy the topics whose name matches, each to the topic or folder of its own name."""

    def write(batch, writer, batch_id):
        if servers:
            sent(batch).write.format("kafka").option("kafka.bootstrap.servers", servers).save()
        else:
            batch.write.mode("overwrite").partitionBy("topic").parquet(batch_folder(path, writer, batch_id))

    return per_batch(topics.mirrored(raw, topic_pattern), checkpoint, write, every, available_now)


def wait(query, timeout=None):
    """Block until the query ends, or for `timeout` seconds; tells whether it has ended."""
    if timeout is None:
        query.awaitTermination()
        return True
    return query.awaitTermination(timeout)
