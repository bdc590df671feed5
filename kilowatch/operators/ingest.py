"""Raw messages to readings, wide rows, samples and dead letters.

All but the sampler are narrow: they add no shuffle and serve batch and streaming input alike.
"""

from pyspark.sql import functions as F

from kilowatch.functions import messages as M
from kilowatch.functions.grouping import hashed
from kilowatch.functions.timeaxis import require_utc
from kilowatch.schema import READINGS, TEXT_MESSAGE
from kilowatch.vocabulary import (
    ENERGY_METER,
    PATH_PARTS,
    SAMPLE_SECONDS,
    SOURCE_TZ,
    WIDE_KEYS,
)

STORED = READINGS.fieldNames()


def with_event_time(readings, source_tz=SOURCE_TZ, strict=False):
    """Add `event_time` and `reading_date`. Malformed text becomes null, or fails the job when `strict`."""
    require_utc(readings)
    written = F.to_timestamp("time") if strict else F.try_to_timestamp("time")
    instant = written if source_tz == "UTC" else F.to_utc_timestamp(written, source_tz)
    return readings.withColumns({"event_time": instant, "reading_date": written.cast("date")})


def flatten(raw, source_tz=SOURCE_TZ, salvage=False, drop_nan=False, meter_class=ENERGY_METER, keep_malformed=True):
    """Readings of one meter class, in the stored layout: one per entry of `params` whose path names the class.

    Times are parsed per message, before its entries become rows. Short paths give null parts and fall away. Messages with
    a malformed time give readings with a null instant, or none unless `keep_malformed`. With the same options,
    `dead_letters` has exactly the messages that give no reading.
    """
    messages = raw.select(M.parsed(M.message_text(), salvage).alias("message"))
    timed = with_event_time(messages.select(F.col("message.ts").alias("time"), "message"), source_tz)
    # Entries are sifted before they become rows. Exploding an expression, not a column, also keeps Spark from deriving
    # a filter that would parse every message a second time.
    sifted = F.map_filter("message.params", lambda key, _: key.contains(f"/{meter_class}"))
    entries = timed.select("time", "event_time", "reading_date", F.explode(sifted).alias("full_key", "value"))
    parts = F.split("full_key", "/")
    named = {name: F.get(parts, F.lit(place)) for place, name in enumerate(PATH_PARTS)}
    kept = named.pop("meter_class") == meter_class
    if drop_nan:
        kept &= ~F.coalesce(F.isnan("value"), F.lit(False))
    if not keep_malformed:
        kept &= F.col("event_time").isNotNull()
    columns = {**named, **{name: F.col(name) for name in ("time", "event_time", "reading_date", "value")}}
    return entries.filter(kept).select(*(columns[name].alias(name) for name in STORED))


def widen(raw):
    """One row per message with the three live parameters as text; absent ones are null."""
    params = F.col("message.params")
    return raw.select(F.from_json(M.message_text(), TEXT_MESSAGE).alias("message")).select(
        F.col("message.ts").alias("timestamp"), *(params[key].alias(name) for key, name in WIDE_KEYS.items())
    )


def accepted(raw):
    """Messages whose `ts` lies on a full minute; everything that is no JSON object has none and is dropped."""
    return raw.filter(M.on_the_minute(M.message_text()))


def envelope(raw):
    """Replace a payload that is no JSON object by `{"raw": payload}`."""
    return raw.withColumn("value", M.enveloped(M.message_text()))


def newest(raw, *keys):
    """The last message to arrive, per `keys` or overall; of several with one arrival the one with the greatest text.
    Pre-aggregates, so one row per task and key is shuffled."""
    message = F.struct(*(F.col(name) for name in raw.columns if name not in keys))
    arrival = F.struct("timestamp", "partition", "offset", M.message_text())
    return raw.groupBy(*keys).agg(hashed(F.max_by(message, arrival)).alias("message")).select(*keys, "message.*")


def sample_latest(raw, seconds=SAMPLE_SECONDS):
    """The newest accepted message per stretch of arrival time."""
    arrived = accepted(raw).withColumn("arrival", F.window("timestamp", f"{seconds} seconds")["start"])
    return newest(arrived, "arrival")


def latest_by_slot(raw, seconds=SAMPLE_SECONDS, delay="0 seconds"):
    """`sample_latest` of a stream, kept in state: a slot holds the newest accepted message of its stretch of arrival time,
    over batches, restarts and failed sends, and is handed on once, when arrivals have passed its end by `delay`. Messages
    that are not accepted move time on as well. For output mode `append`."""
    arrived = accepted(raw.withWatermark("timestamp", delay)).withColumn("arrival", F.window("timestamp", f"{seconds} seconds"))
    return newest(arrived, "arrival").withColumn("arrival", F.col("arrival.start"))


def dead_letters(raw, salvage=False, drop_nan=False, meter_class=ENERGY_METER, keep_malformed=True):
    """Messages that yield no reading, with the reason. As a generator the reason is worked out once per message."""
    reason = M.unusable(M.message_text(), salvage, drop_nan, keep_malformed, meter_class)
    return raw.select("*", F.explode(F.array_compact(F.array(reason))).alias("reason"))


def deduplicated(readings, delay="10 minutes"):
    """Drop repeated deliveries of a reading, on a stream within the watermark: there, readings later than `delay` are
    dropped too. `streaming.distinct.store_distinct` keeps those.

    A reading is repeated if path, time as written and value are the same, so different values at one time all stay, and
    malformed times are told apart by their text.
    """
    keys = [*PATH_PARTS[:-1], "time", "value"]
    if readings.isStreaming:
        return readings.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(keys)
    return readings.dropDuplicates(keys)
