"""Registered queries: name -> function of (spark, sf_dir)."""

from datetime import datetime
from functools import partial

from pyspark.sql import functions as F

from kilowatch.catalogue import profiles as P
from kilowatch.operators import documents, gauges, ingest, owners, topics
from kilowatch.functions import timeaxis as X
from kilowatch.plans import queries as Q
from kilowatch.schema import READINGS
from kilowatch.session import prepare, shared_folder
from kilowatch.sources import lines, tables
from kilowatch.streaming import buckets, distinct, jobs, rollups, runs, slots
from kilowatch.vocabulary import DISPLAY_TZ, FREQUENCY, PATH_PARTS, PHASE_VOLTAGES

EXACT = {"scale": 2}
RANGE = ("2024-01-05 00:00:00", P.AS_OF)


def by_interval(interval, wall=False):
    """Readings and as_of that give an interval full buckets: a day of seconds, a month of minutes, years of days."""
    if interval in ("min", "hr"):
        start = P.WALL_DAY_START if wall else P.DAY_START
        return partial(P.daily, day_start=start), P.AS_OF
    if interval == "day":
        return P.monthly, P.AS_OF
    return P.yearly, P.ORDERS_AS_OF


def bucketed(query, interval, wall=False, **options):
    profile, as_of = by_interval(interval, wall)

    def run(spark, sf_dir):
        return query(profile(spark, sf_dir), as_of, interval, **EXACT, **options)

    return run


def owners_ordered(spark, sf_dir):
    return Q.unique_owners(P.monthly(spark, sf_dir))


def range_consumption(spark, sf_dir):
    return Q.range_consumption(P.monthly(spark, sf_dir), *RANGE, **EXACT)


def energy_stats_to_date(spark, sf_dir):
    return Q.energy_stats(P.monthly(spark, sf_dir), P.AS_OF, **EXACT)


def energy_stats_in_march(spark, sf_dir):
    return Q.energy_stats(P.yearly(spark, sf_dir), "2001-03-15 12:00:00", **EXACT)


def range_consumption_datetimes(spark, sf_dir):
    start, stop = (datetime.fromisoformat(t) for t in RANGE)
    return Q.range_consumption(P.monthly(spark, sf_dir), start, stop, **EXACT)


def owners_with_null(spark, sf_dir):
    """Owners in display order where one has no name."""
    return Q.unique_owners(P.monthly(spark, sf_dir).withColumn("owner_name", F.nullif("owner_name", F.lit("7"))))


def energy_day_default(spark, sf_dir):
    """Without the number of decimals: plain doubles."""
    return Q.energy_consumption(P.monthly(spark, sf_dir), P.AS_OF, "day")


def energy_day_large(spark, sf_dir):
    """Registers beyond 10^8 that share their seconds: all readings of an hour carry its start."""
    coarse = {"event_time": F.date_trunc("hour", "event_time"), "value": F.col("value") * 1e6}
    return Q.energy_consumption(P.monthly(spark, sf_dir).withColumns(coarse), P.AS_OF, "day")


def energy_day_nan(spark, sf_dir):
    """Readings that are no numbers among others."""
    value = F.when(F.second("event_time") % 5 == 0, float("nan")).otherwise(F.col("value"))
    return Q.energy_consumption(P.monthly(spark, sf_dir).withColumn("value", value), P.AS_OF, "day", **EXACT)


def response_owners(spark, sf_dir):
    """Number of entries in the documents of all owners, some of whom have no readings."""
    frame = P.monthly(spark, sf_dir)
    some = Q.frequency(frame.filter("owner_name <> '11'"), P.AS_OF, "day", **EXACT)
    docs = documents.documents(some, "day", owners=frame)
    return docs.select("owner_name", "interval", F.size("data").cast("bigint").alias("entries"))


def earliest_by_owner(spark, sf_dir):
    first = owners.earliest(P.yearly(spark, sf_dir), "energy_consumption")
    return first.select("owner_name", F.date_format("earliest", "yyyy-MM-dd HH:mm:ss").alias("earliest"))


def voltage_long_hr(spark, sf_dir):
    """Phase means in long form, one row per owner, hour and phase."""
    interval = X.INTERVALS["hr"]
    rows = P.daily(spark, sf_dir).filter(F.col("value_name").isin(*PHASE_VOLTAGES))
    rows = rows.withColumn("bucket", X.bucket_of(X.local_seconds(DISPLAY_TZ), interval))
    means = gauges.measure_means(rows, 2, **EXACT)
    return means.select("owner_name", X.label_of(F.col("bucket"), interval).alias("time"), "value_name", "mean_value")


def _shown(readings):
    """Readings in comparable types."""
    return readings.select(
        "time",
        F.date_format("reading_date", "yyyy-MM-dd").alias("reading_date"),
        *(name for name in READINGS.fieldNames() if name not in ("time", "event_time", "reading_date")),
    )


def flatten_readings(spark, sf_dir):
    return _shown(ingest.flatten(P.raw_messages(spark, sf_dir)))


def wide_params(spark, sf_dir):
    return ingest.widen(P.wide_messages(spark, sf_dir))


def props_explode(spark, sf_dir):
    events = P.table(spark, sf_dir, "events")
    params = F.from_json("props", "map<string,double>")
    return events.select("event_id", F.explode(params).alias("full_key", "value"))


def minute_filter(spark, sf_dir):
    kept = ingest.accepted(P.raw_messages(spark, sf_dir))
    return kept.select("topic", "partition", "offset", F.get_json_object("value", "$.ts").alias("time"))


def minute_latest(spark, sf_dir):
    sampled = ingest.sample_latest(P.raw_messages(spark, sf_dir, folded=True))
    return sampled.select(
        F.date_format("arrival", "yyyy-MM-dd HH:mm").alias("arrival"),
        "topic",
        "partition",
        "offset",
        F.get_json_object("value", "$.ts").alias("time"),
    )


def payload_or_raw(spark, sf_dir):
    """Payloads that are no JSON object, put under `raw`; the time of all others."""
    sealed = ingest.envelope(P.raw_messages(spark, sf_dir))
    return sealed.select(
        "topic",
        "partition",
        "offset",
        F.get_json_object("value", "$.raw").alias("raw"),
        F.get_json_object("value", "$.ts").alias("time"),
    )


def dead_letters(spark, sf_dir):
    return ingest.dead_letters(P.raw_messages(spark, sf_dir)).select("topic", "partition", "offset", "reason")


def raw_envelope(spark, sf_dir):
    sent = topics.wrapped(P.wide_messages(spark, sf_dir), '{"type":"string"}')
    opened = topics.unwrapped(sent, name="value")
    return ingest.widen(opened)


def topic_mirror(spark, sf_dir):
    copied = topics.mirrored(P.raw_messages(spark, sf_dir), "meters_(click|purchase)")
    return copied.select("topic", "partition", "offset")


def offset_ranges(spark, sf_dir):
    return topics.offset_ranges(P.raw_messages(spark, sf_dir))


def retention(spark, sf_dir):
    kept = topics.retained(P.raw_messages(spark, sf_dir), X.as_local(P.AS_OF))
    return kept.select("topic", "partition", "offset")


def message_round_trip(spark, sf_dir):
    """Rows published as JSON messages and read back."""
    rows = P.monthly(spark, sf_dir).select("time", "owner_name", "value_name", "value")
    back = F.from_json("value", "time STRING, owner_name STRING, value_name STRING, value DOUBLE")
    return topics.to_messages(rows).select(back.alias("row")).select("row.*")


def response_documents(spark, sf_dir):
    """Energy per day as one JSON document per owner, with its length and days."""
    energy = bucketed(Q.energy_consumption, "day")(spark, sf_dir)
    return documents.as_json(documents.documents(energy, "day"))


def response_entries(spark, sf_dir):
    """The entries of the documents, back in rows."""
    energy = bucketed(Q.energy_consumption, "day")(spark, sf_dir)
    docs = documents.documents(energy, "day")
    return docs.select("owner_name", "interval", F.posexplode("data").alias("place", "entry")).select(
        "owner_name", "interval", "place", "entry.time", "entry.energy"
    )


def energy_day_stored(spark, sf_dir):
    """Energy per day over the written readings table, where date and measure prune the scan."""
    path = shared_folder(spark, "readings")
    readings = P.monthly(spark, sf_dir).withColumn("reading_date", F.to_date("event_time"))
    tables.write_batch(readings, path, "catalogue", 0)
    owners = tables.read_owners(spark, path)
    return Q.energy_consumption(tables.read_readings(spark, path), P.AS_OF, "day", owners=owners, **EXACT)


def _stream_of(spark, sf_dir, name):
    reader = spark.readStream.schema(P.table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", 1000)
    return reader.parquet(f"{sf_dir}/{name}.parquet*")


def _event_stream(spark, sf_dir):
    return _stream_of(spark, sf_dir, "events")


def flatten_readings_stream(spark, sf_dir):
    """The streaming job over all events, then the table it wrote."""
    path, checkpoint = shared_folder(spark, "readings"), shared_folder(spark, "positions")
    raw = P.raw_messages_of(_event_stream(spark, sf_dir))
    jobs.wait(jobs.store_readings(raw, path, checkpoint, available_now=True))
    return _shown(tables.read_readings(spark, path))


def _parts_stream(spark, sf_dir, parts):
    """The parts a stream of readings leaves, in files of no particular order of time."""
    path, checkpoint = shared_folder(spark, "buckets"), shared_folder(spark, "positions")
    readings = P.monthly_of(_event_stream(spark, sf_dir))
    jobs.wait(buckets.store_parts(readings, parts, path, checkpoint, available_now=True))
    return buckets.read_parts(spark, path, parts(P.monthly(spark, sf_dir)).schema)


def frequency_stream(interval):
    """Means per bucket kept by a stream."""

    def query(spark, sf_dir):
        parts = _parts_stream(spark, sf_dir, lambda r: buckets.mean_parts(r, interval, {FREQUENCY: "frequency"}, scale=EXACT["scale"]))
        return buckets.means(parts, interval, **EXACT)

    return query


def energy_stream(interval, **options):
    """Consumption per bucket kept by a stream."""

    def query(spark, sf_dir):
        parts = _parts_stream(spark, sf_dir, lambda r: buckets.consumption_parts(r, interval, scale=EXACT["scale"]))
        return buckets.consumption(parts, interval, **EXACT, **options)

    return query


def energy_years_stream(interval):
    """Consumption with the steps between buckets, kept by a stream of years of readings."""

    def query(spark, sf_dir):
        path, checkpoint = shared_folder(spark, "buckets"), shared_folder(spark, "positions")
        parts = lambda r: buckets.consumption_parts(r, interval, scale=EXACT["scale"])
        readings = P.yearly_of(_stream_of(spark, sf_dir, "orders"))
        jobs.wait(buckets.store_parts(readings, parts, path, checkpoint, available_now=True))
        found = buckets.read_parts(spark, path, parts(P.yearly(spark, sf_dir)).schema)
        return buckets.consumption(found, interval, **EXACT, method="lag")

    return query


def energy_day_watermark(spark, sf_dir):
    """Daily consumption kept by a stream with state and a watermark, which refuses nothing here: the delay is a month.
    `refused_readings_stream` has one that does."""
    path, checkpoint = shared_folder(spark, "buckets"), shared_folder(spark, "positions")
    live = buckets.live_consumption(P.monthly_of(_event_stream(spark, sf_dir)), "day", delay="31 days", **EXACT)
    jobs.wait(buckets.store_updates(live, path, checkpoint, available_now=True))
    return buckets.read_latest(spark, path, live.schema)


def redelivered_readings(spark, sf_dir):
    """What is left of readings that were all delivered twice."""
    raw = P.raw_messages(spark, sf_dir)
    left = ingest.deduplicated(ingest.flatten(raw.unionByName(raw)))
    return _shown(left)


def _each_delivered(spark, deliveries, job):
    """Write one delivery after the other into a folder and run the streaming job after each, on the positions it left."""
    folder = shared_folder(spark, "deliveries")
    for delivery in deliveries:
        delivery.write.mode("append").parquet(folder)
        reader = spark.readStream.schema(delivery.schema).option("maxFilesPerTrigger", 1000)
        jobs.wait(job(reader.parquet(folder)))


def redelivered_readings_stream(spark, sf_dir):
    """Readings of a stream whose deliveries all reach back over the whole month, and are then all sent again."""
    path, checkpoint = shared_folder(spark, "readings"), shared_folder(spark, "positions")
    raw = P.raw_messages(spark, sf_dir)
    deliveries = [*(raw.filter(F.col("offset") % 3 == part) for part in (2, 0, 1)), raw]

    def job(stream):
        return distinct.store_distinct(ingest.flatten(stream), path, checkpoint, available_now=True)

    _each_delivered(spark, deliveries, job)
    return _shown(tables.read_readings(spark, path))


def _text_lines(spark, messages, folder):
    messages.select("value").write.mode("append").text(folder)


def flatten_lines_stream(spark, sf_dir):
    """Messages as lines of text files, read with positions and stored."""
    folder, path, checkpoint = (shared_folder(spark, name) for name in ("lines", "readings", "positions"))
    _text_lines(spark, P.raw_messages(spark, sf_dir), folder)
    raw = lines.line_messages(spark, folder, "earliest")
    jobs.wait(jobs.store_readings(raw, path, checkpoint, available_now=True))
    return _shown(tables.read_readings(spark, path))


def flatten_lines_from_latest(spark, sf_dir):
    """Of messages as lines, those written after the stream had started at the latest position."""
    folder, path, checkpoint = (shared_folder(spark, name) for name in ("lines", "readings", "positions"))
    raw = P.raw_messages(spark, sf_dir)
    for part in (0, 1):
        _text_lines(spark, raw.filter(F.col("offset") % 2 == part), folder)
        jobs.wait(jobs.store_readings(lines.line_messages(spark, folder), path, checkpoint, available_now=True))
    return _shown(tables.read_readings(spark, path))


RUN_GAP = "1 hour"
TEXT_TIME = "yyyy-MM-dd HH:mm:ss"


def _in_text(found, *names):
    return found.withColumns({name: F.date_format(name, TEXT_TIME) for name in names})


def _run_parts(spark, sf_dir):
    return _parts_stream(spark, sf_dir, lambda r: runs.run_parts(r, RUN_GAP))


def owner_runs_stream(spark, sf_dir):
    """Runs of every owner's readings without a gap of more than an hour, from parts a stream left."""
    return _in_text(runs.runs(_run_parts(spark, sf_dir), RUN_GAP), "first", "last").withColumnsRenamed({"first": "started", "last": "ended"})


def owner_outages_stream(spark, sf_dir):
    return _in_text(runs.outages(_run_parts(spark, sf_dir), RUN_GAP), "since", "until")


def _by_day(events):
    """Events in three deliveries of about ten days."""
    return [events.filter(F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)) == part) for part in range(3)]


def closed_runs_stream(spark, sf_dir):
    """Runs the watermark has passed, from sessions in state; events come in order of days."""
    path, checkpoint = shared_folder(spark, "runs"), shared_folder(spark, "positions")
    live = lambda stream: runs.live_runs(P.monthly_of(stream), RUN_GAP, "2 days")

    def write(batch, writer, batch_id):
        batch.write.mode("overwrite").parquet(tables.batch_folder(path, writer, batch_id))

    _each_delivered(spark, _by_day(P.table(spark, sf_dir, "events")), lambda s: jobs.per_batch(live(s), checkpoint, write, None, True))
    found = spark.read.schema("owner_name STRING, first TIMESTAMP, last TIMESTAMP, readings BIGINT").parquet(path)
    return _in_text(found.select("owner_name", "first", "last", "readings"), "first", "last").withColumnsRenamed({"first": "started", "last": "ended"})


def _with_late(spark, sf_dir):
    """Events in deliveries of ten days, one in ten a delivery too late; (readings in time, refused readings)."""
    path, late, checkpoint = (shared_folder(spark, name) for name in ("readings", "late", "positions"))
    events = P.table(spark, sf_dir, "events")
    part = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)) + (F.col("event_id") % 10 == 0).cast("int")
    deliveries = [events.filter(part == k) for k in range(4)]
    dated = lambda stream: P.monthly_of(stream).withColumn("reading_date", F.to_date("event_time"))
    _each_delivered(spark, deliveries, lambda s: runs.split_late(dated(s), path, late, checkpoint, "2 days", available_now=True))
    return tables.read_readings(spark, path), runs.read_late(spark, late, dated(events).schema)


def refused_readings_stream(spark, sf_dir):
    refused = _with_late(spark, sf_dir)[1].select("time", "owner_name", "value_name", "value", "watermark")
    return _in_text(refused, "watermark")


def late_counts_stream(spark, sf_dir):
    """Per owner, readings in time and refused, and the seconds the worst was behind."""
    kept, refused = _with_late(spark, sf_dir)
    kept = kept.groupBy("owner_name").agg(F.count("*").alias("in_time"))
    return kept.join(runs.late_counts(refused), "owner_name", "full").fillna(0, ["in_time", "refused"])


def _rollup(spark, readings, wall):
    """Rollups of a table, written in three batches."""
    path = shared_folder(spark, "rollups")
    spread = F.pmod(F.xxhash64("time", "value"), F.lit(3))
    for part in range(3):
        rollups.write_rollups(readings.filter(spread == part), path, "catalogue", part, EXACT["scale"], wall)
    return rollups.Rollup(spark, path, readings, EXACT["scale"], wall)


def range_consumption_rollup(spark, sf_dir):
    readings = P.monthly(spark, sf_dir)
    return rollups.range_consumption(_rollup(spark, readings, True), *RANGE, readings)


def energy_stats_rollup(spark, sf_dir):
    readings = P.yearly(spark, sf_dir)
    return rollups.energy_stats(_rollup(spark, readings, True), "2001-03-15 12:00:00", readings)


def energy_year_rollup(spark, sf_dir):
    return rollups.energy_by_year(_rollup(spark, P.yearly(spark, sf_dir), False), P.ORDERS_AS_OF)


def ghg_year_rollup(spark, sf_dir):
    return rollups.emission_by_year(_rollup(spark, P.yearly(spark, sf_dir), True), P.ORDERS_AS_OF)


def parse_facts(salvage):
    """What becomes of messages in eight forms, whole or with what can be salvaged."""

    def query(spark, sf_dir):
        found = ingest.flatten(P.faulty_messages(spark, sf_dir), salvage=salvage)
        odd = F.coalesce(F.isnan("value"), F.lit(False))
        shown = F.when(~odd, F.col("value")).alias("value")
        return found.select("time", F.date_format("reading_date", "yyyy-MM-dd").alias("reading_date"), "building_name", "owner_name", "value_name", shown, odd.alias("no_number"))

    return query


def frequency_day_default(spark, sf_dir):
    """Means without the number of decimals: the digits as they are, in any order."""
    return Q.frequency(P.monthly(spark, sf_dir), P.AS_OF, "day")


def voltage_hr_default(spark, sf_dir):
    return Q.voltage_stats(P.daily(spark, sf_dir), P.AS_OF, "hr")


def frequency_day_default_stream(spark, sf_dir):
    parts = _parts_stream(spark, sf_dir, lambda r: buckets.mean_parts(r, "day", {FREQUENCY: "frequency"}))
    return buckets.means(parts, "day")


def minute_latest_stream(spark, sf_dir):
    """The newest accepted message of every minute that has passed, from a slot in state; messages come in three batches."""
    path, checkpoint = shared_folder(spark, "sampled"), shared_folder(spark, "positions")
    raw = P.raw_messages(spark, sf_dir, folded=True)
    part = F.floor((F.unix_seconds("timestamp") - F.unix_seconds(F.lit(P.DAY_START).cast("timestamp")) - P.DENSE_FIRST_SECOND) / 3000)
    part = F.least(F.greatest(part, F.lit(0)), F.lit(2))
    before = F.unix_seconds("timestamp") < F.unix_seconds(F.lit(P.DAY_START).cast("timestamp")) + P.DENSE_FIRST_SECOND
    # Seconds before the first dense one hold messages only once events fill the day.
    deliveries = [raw.filter(before), *(raw.filter(~before & (part == k)) for k in range(3))]

    def write(batch, writer, batch_id):
        batch.write.mode("overwrite").parquet(tables.batch_folder(path, writer, batch_id))

    _each_delivered(spark, deliveries, lambda s: jobs.per_batch(ingest.latest_by_slot(s), checkpoint, write, None, True))
    kinds = "arrival TIMESTAMP, value STRING, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP"
    sampled = spark.read.schema(kinds).parquet(path)
    return sampled.select(
        F.date_format("arrival", "yyyy-MM-dd HH:mm").alias("arrival"), "topic", "partition", "offset", F.get_json_object("value", "$.ts").alias("time")
    )


def energy_hr_slots_stream(spark, sf_dir):
    """Energy of every owner and hour that has passed, empty ones included, kept by a stream with late readings."""
    path, checkpoint = shared_folder(spark, "slots"), shared_folder(spark, "positions")
    events = P.table(spark, sf_dir, "events")
    second = F.pmod(F.col("event_id") + P.DENSE_FIRST_SECOND, F.lit(P.DAY_SECONDS))
    part = F.when(F.col("event_id") % 20 == 0, 3).otherwise(F.floor(second / 28800))
    deliveries = [events.filter(part == k) for k in range(4)]
    _each_delivered(spark, deliveries, lambda s: slots.store_slots(P.daily_of(s), path, checkpoint, "hr", **EXACT, available_now=True))
    return slots.read_slots(spark, path)


def queries():
    found = {
        "owners_ordered": owners_ordered,
        "range_consumption": range_consumption,
        "energy_stats_to_date": energy_stats_to_date,
        "energy_stats_in_march": energy_stats_in_march,
        "range_consumption_datetimes": range_consumption_datetimes,
        "owners_with_null": owners_with_null,
        "energy_day_default": energy_day_default,
        "energy_day_large": energy_day_large,
        "energy_day_nan": energy_day_nan,
        "energy_day_of_owner": bucketed(Q.energy_consumption, "day", owner="11"),
        "response_owners": response_owners,
        "earliest_by_owner": earliest_by_owner,
        "voltage_long_hr": voltage_long_hr,
        "energy_day_lag": bucketed(Q.energy_consumption, "day", method="lag"),
        "energy_day_per_meter": bucketed(Q.energy_consumption, "day", per_meter=True),
        "energy_year_per_meter": bucketed(Q.energy_consumption, "year", per_meter=True),
        "energy_hr_consistent": bucketed(Q.energy_consumption, "hr", wall=True, consistent_time=True),
        "power_factor_hr_consistent": bucketed(Q.power_factor, "hr", wall=True, consistent_time=True),
        "flatten_readings": flatten_readings,
        "wide_params": wide_params,
        "props_explode": props_explode,
        "minute_filter": minute_filter,
        "minute_latest": minute_latest,
        "payload_or_raw": payload_or_raw,
        "dead_letters": dead_letters,
        "raw_envelope": raw_envelope,
        "topic_mirror": topic_mirror,
        "offset_ranges": offset_ranges,
        "retention": retention,
        "message_round_trip": message_round_trip,
        "response_documents": response_documents,
        "response_entries": response_entries,
        "energy_day_stored": energy_day_stored,
        "flatten_readings_stream": flatten_readings_stream,
        "frequency_day_stream": frequency_stream("day"),
        "energy_day_stream": energy_stream("day"),
        "energy_month_stream": energy_stream("month"),
        "energy_year_stream": energy_stream("year"),
        "energy_day_watermark": energy_day_watermark,
        "redelivered_readings": redelivered_readings,
        "redelivered_readings_stream": redelivered_readings_stream,
        "flatten_lines_stream": flatten_lines_stream,
        "flatten_lines_from_latest": flatten_lines_from_latest,
        "owner_runs_stream": owner_runs_stream,
        "owner_outages_stream": owner_outages_stream,
        "closed_runs_stream": closed_runs_stream,
        "refused_readings_stream": refused_readings_stream,
        "late_counts_stream": late_counts_stream,
        "energy_day_lag_stream": energy_stream("day", method="lag"),
        "energy_month_lag_stream": energy_years_stream("month"),
        "energy_year_lag_stream": energy_years_stream("year"),
        "parse_facts": parse_facts(False),
        "parse_facts_salvaged": parse_facts(True),
        "frequency_day_default": frequency_day_default,
        "voltage_hr_default": voltage_hr_default,
        "frequency_day_default_stream": frequency_day_default_stream,
        "minute_latest_stream": minute_latest_stream,
        "energy_hr_slots_stream": energy_hr_slots_stream,
        "range_consumption_rollup": range_consumption_rollup,
        "energy_stats_rollup": energy_stats_rollup,
        "energy_year_rollup": energy_year_rollup,
        "ghg_year_rollup": ghg_year_rollup,
    }
    for interval in X.INTERVALS:
        found[f"voltage_{interval}"] = bucketed(Q.voltage_stats, interval)
        found[f"ghg_{interval}"] = bucketed(Q.ghg_emission, interval, wall=True)
        found[f"ghg_{interval}_compat"] = bucketed(Q.ghg_emission, interval, consistent_time=False)
        found[f"energy_{interval}"] = bucketed(Q.energy_consumption, interval)
        found[f"power_factor_{interval}"] = bucketed(Q.power_factor, interval)
        found[f"current_{interval}"] = bucketed(Q.current_stats, interval)
        found[f"frequency_{interval}"] = bucketed(Q.frequency, interval)
    return {name: _prepared(query) for name, query in found.items()}


def _prepared(query):
    def run(spark, sf_dir):
        prepare(spark)
        return query(spark, sf_dir)

    return run
