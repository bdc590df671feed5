import shutil

import pytest
from pyspark.sql import functions as F

from kilowatch.operators import ingest
from kilowatch.sources import streams, tables
from kilowatch.streaming import buckets, jobs

PATH = "c/b/f/s/l/{owner}/{name}/EM"


def text(minute, owner="11", name="volt1", value=1.0, second=0):
    path = PATH.format(owner=owner, name=name)
    return f'{{"ts":"2024-01-20 12:{minute:02d}:{second:02d}","params":{{"{path}":{value}}}}}'


@pytest.fixture
def folder(tmp_path):
    made = tmp_path / "in"
    made.mkdir()

    def add(name, lines):
        part = tmp_path / f"{name}.part"
        part.write_text("\n".join(lines) + "\n")
        shutil.move(part, made / f"{name}.txt")
        return str(made)

    add.path = str(made)
    add.out = str(tmp_path / "out")
    add.checkpoint = str(tmp_path / "checkpoint")
    return add


def store(spark, folder, checkpoint=None):
    raw = streams.text_messages(spark, folder.path, files_per_trigger=1)
    query = jobs.store_readings(raw, folder.out, checkpoint or folder.checkpoint, available_now=True)
    assert jobs.wait(query, 120)
    return tables.read_readings(spark, folder.out)


def test_stream_equals_batch_survives_restart_and_replay(spark, folder, tmp_path):
    for part in range(3):
        folder(f"p{part}", [text(3 * part + n, value=part + n) for n in range(3)] + ["broken"])
    stored = store(spark, folder)
    batch = ingest.flatten(streams.text_messages(spark, folder.path, streaming=False))
    assert stored.exceptAll(batch).isEmpty() and stored.count() == batch.count() == 9
    # A restart on the same positions finds nothing new, and later files only.
    assert store(spark, folder).count() == 9
    folder("p3", [text(30)])
    assert store(spark, folder).count() == 10
    # The last batch is run again when its commit was lost: it replaces its own folder.
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda name: int(name.name))
    for name in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        name.unlink(missing_ok=True)
    assert store(spark, folder).count() == 10


def test_two_streams_into_one_table_keep_apart(spark, folder, tmp_path):
    folder("p", [text(1), text(2)])
    assert store(spark, folder).count() == 2
    assert store(spark, folder, str(tmp_path / "another")).count() == 4


def test_dead_letters_are_kept(spark, folder):
    folder("p", [text(1), "broken", '{"ts":"x","params":{"a":"b"}}'])
    raw = streams.text_messages(spark, folder.path)
    assert jobs.wait(jobs.store_dead_letters(raw, folder.out, folder.checkpoint, available_now=True), 120)
    assert sorted(row.reason for row in spark.read.parquet(folder.out).collect()) == ["no_numeric_params", "not_an_object"]


def test_wide_view(spark, folder):
    folder("p", ['{"ts":"t","params":{"voltage":"230","pf":"0.9"}}'])
    raw = streams.text_messages(spark, folder.path)
    assert jobs.wait(jobs.show_wide(raw, "memory", "wide_view", available_now=True), 120)
    assert [tuple(row) for row in spark.table("wide_view").collect()] == [("t", "230", None, "0.9")]


def test_console_sinks(spark, folder):
    folder("p", ['{"ts":"t","params":{"voltage":"230"}}'])
    raw = streams.text_messages(spark, folder.path)
    assert jobs.wait(jobs.show_wide(raw, available_now=True), 120)
    assert jobs.wait(jobs.topic_to_console(raw, available_now=True), 120)


def test_newest_accepted_message_of_each_batch_is_forwarded(spark, folder, tmp_path):
    rows = [(text(n, second=0 if n % 2 else 30), "t", 0, n, 1705750000 + n) for n in range(9)]
    names = "value string, topic string, partition int, offset bigint, s bigint"
    for part in (rows[:4], rows[4:8], rows[8:]):
        frame = spark.createDataFrame(part, names).selectExpr("* except (s)", "timestamp_seconds(s) AS timestamp")
        frame.coalesce(1).write.mode("append").parquet(folder.path)
    raw = streams.stored_messages(spark, folder.path, files_per_trigger=1)
    assert jobs.wait(jobs.forward_latest(raw, folder.out, folder.checkpoint, available_now=True), 120)
    assert sorted(row.value for row in spark.read.parquet(folder.out).collect()) == [text(3), text(7)]


def test_lines_to_topic_and_back(spark, folder, tmp_path):
    folder("p", ["one", "two"])
    lines = streams.text_messages(spark, folder.path)
    assert jobs.wait(jobs.lines_to_topic(lines, folder.out, folder.checkpoint, available_now=True), 120)
    assert sorted(row.value for row in spark.read.parquet(folder.out).collect()) == ["one", "two"]
    back, positions = str(tmp_path / "lines"), str(tmp_path / "positions")
    assert jobs.wait(jobs.topic_to_lines(lines, back, positions, available_now=True), 120)
    assert sorted(row.value for row in spark.read.text(back).collect()) == ["one", "two"]


def test_mirrored_topics(spark, folder, messages):
    messages(["a"], "iot").union(messages(["b"], "log")).write.mode("append").parquet(folder.path)
    raw = streams.stored_messages(spark, folder.path)
    assert jobs.wait(jobs.mirror_topics(raw, "io.", folder.out, folder.checkpoint, available_now=True), 120)
    assert [(row.value, row.topic) for row in spark.read.parquet(folder.out).collect()] == [("a", "iot")]


def flattened(spark, folder):
    return ingest.flatten(streams.text_messages(spark, folder.path, files_per_trigger=1))


def test_live_means_and_consumption_reach_the_batch_result(spark, folder, tmp_path):
    folder("p1", [text(n, name="frequency", value=50 + n) for n in range(4)])
    folder("p2", [text(n, name="frequency", value=40) for n in (30, 45)])
    live = buckets.live_means(flattened(spark, folder), "hr", {"frequency": "frequency"}, scale=2)
    assert buckets.store_updates(live, folder.out, folder.checkpoint, available_now=True).awaitTermination(120)
    rows = [tuple(row) for row in buckets.read_latest(spark, folder.out, live.schema).orderBy("time").collect()]
    assert rows == [("11", "2024-01-20 17:00", 51.5), ("11", "2024-01-20 18:00", 40.0)]


def test_live_consumption(spark, folder, tmp_path):
    folder("p1", [text(n, name="energy_consumption", value=100 + n) for n in (5, 3, 9)])
    folder("p2", [text(20, name="energy_consumption", value=150)])
    live = buckets.live_consumption(flattened(spark, folder), "hr", scale=2)
    assert buckets.store_updates(live, folder.out, folder.checkpoint, available_now=True).awaitTermination(120)
    rows = [tuple(row) for row in buckets.read_latest(spark, folder.out, live.schema).collect()]
    assert rows == [("11", "2024-01-20 17:00", 47.0)]


def test_windows_need_equal_lengths():
    from kilowatch.functions.timeaxis import INTERVALS

    with pytest.raises(ValueError):
        buckets.local_window(INTERVALS["month"])
    with pytest.raises(ValueError):
        buckets.local_window(INTERVALS["hr"], "America/New_York")


def test_repeated_deliveries_are_dropped_from_a_stream(spark, folder):
    folder("p1", [text(1), text(2)])
    folder("p2", [text(2), text(3)])
    query = (
        ingest.deduplicated(flattened(spark, folder))
        .writeStream.format("memory")
        .queryName("deduplicated")
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(120)
    assert spark.table("deduplicated").select(F.minute("event_time")).orderBy(F.minute("event_time")).collect() == [(1,), (2,), (3,)]


def test_kafka_source_needs_its_connector(spark):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        streams.kafka_messages(spark, "localhost:1")
