"""Raw-message sources and sinks, for batch and streaming alike.

Kafka is used when its connector is on the classpath; files serve where it is not. Kafka keeps positions and can start
at the latest one; a file source has no such start and reads all files of the folder that its checkpoint has not seen.
"""

from pyspark.sql import functions as F

from kilowatch.schema import RAW_MESSAGE
from kilowatch.vocabulary import RAW_TOPIC


def _columns(with_key):
    return [*(["key"] if with_key else []), *RAW_MESSAGE.fieldNames()]


def kafka_messages(spark, servers, topic=RAW_TOPIC, starting="latest", with_key=False, **options):
    """Stream of a topic, with the messages' keys if asked for. `maxOffsetsPerTrigger` and `minPartitions` can be given as
    options."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.option("startingOffsets", starting).options(**options).load().select(*_columns(with_key))


def kafka_matching(spark, servers, topic_pattern, starting="latest", with_key=True, **options):
    """Stream of all topics whose name matches, with the messages' keys, so that a mirror keeps the partitioning."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option("subscribePattern", topic_pattern).option("startingOffsets", starting)
    return reader.options(**options).load().select(*_columns(with_key))


def stored_messages(spark, path, files_per_trigger=None):
    """Stream of raw messages kept as Parquet with all of Kafka's columns."""
    reader = spark.readStream.schema(RAW_MESSAGE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def text_messages(spark, path, topic=RAW_TOPIC, files_per_trigger=None, streaming=True):
    """One message per line of the text files in a folder. Its arrival is the time its file was written.

    Lines carry no offset; their place in the file's block and the line's text stand in to break ties.
    """
    reader = spark.readStream if streaming else spark.read
    if files_per_trigger and streaming:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format("text").load(path).select(
        "value",
        F.lit(topic).alias("topic"),
        F.lit(0).alias("partition"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.col("_metadata.file_modification_time").alias("timestamp"),
    )


def sent(messages):
    """What goes out of a message: its value, and its key and topic where it has them."""
    return messages.select(*(name for name in ("key", "topic", "value") if name in messages.columns))


def publish(messages, target, servers=None):
    """Write a batch of messages to a topic when servers are given, else as Parquet to a folder of its own.

    Payloads are kept whole, line ends included; keys are kept where there are any. A batch written again replaces itself;
    each batch needs a folder of its own (`tables.batch_folder`).
    """
    kept = sent(messages).drop("topic")
    if servers:
        kept.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", target).save()
    else:
        kept.write.mode("overwrite").parquet(target)
