import math

import pytest
from pyspark.errors import PySparkException

from kilowatch.functions import messages as M
from kilowatch.operators import ingest

FULL = "c1/b1/f1/s/l/11/{}/EM"


def flat(raw, **options):
    return [tuple(row) for row in ingest.flatten(raw, **options).orderBy("value_name").collect()]


def test_a_message_becomes_a_reading_per_entry(messages):
    text = '{"ts":"2024-01-20 12:30:00","params":{"%s":230.5,"%s":231}}' % (FULL.format("volt1"), FULL.format("volt2"))
    rows = ingest.flatten(messages([text])).orderBy("value_name").collect()
    assert [(row.owner_name, row.value_name, row.value) for row in rows] == [("11", "volt1", 230.5), ("11", "volt2", 231.0)]
    assert rows[0].time == "2024-01-20 12:30:00" and str(rows[0].event_time) == "2024-01-20 12:30:00"
    assert str(rows[0].reading_date) == "2024-01-20"
    assert (rows[0].company_name, rows[0].building_name, rows[0].floor_name, rows[0].S0, rows[0].L0) == (
        "c1",
        "b1",
        "f1",
        "s",
        "l",
    )


@pytest.mark.parametrize(
    "params",
    [
        '{"%s":"x","%s":2}' % (FULL.format("a"), FULL.format("b")),
        '{"%s":"1.5"}' % FULL.format("a"),
        '{"%s":true}' % FULL.format("a"),
        "{}",
        "null",
        "5",
        '{"c1/b1/f1":1}',
        '{"c1/b1/f1/s/l/11/volt1/WM":1}',
        '{"c1/b1/f1/s/l/11/volt1/x/EM":1}',
        '{"c1/b1/f1/s/l/11/volt1/EMX":1}',
    ],
)
def test_entries_that_give_no_reading(messages, params):
    assert flat(messages(['{"ts":"2024-01-20 12:30:00","params":%s}' % params])) == []


@pytest.mark.parametrize("text", ["not json", "[1,2]", '"s"', "5", "null", "{}", ""])
def test_texts_that_give_no_reading(messages, text):
    raw = messages([text])
    assert flat(raw) == [] and ingest.dead_letters(raw).count() == 1


def test_class_is_the_eighth_part_whatever_follows(messages):
    rows = ingest.flatten(messages(['{"ts":"t","params":{"c/b/f/s/l/11/volt1/EM/more":1}}'])).collect()
    assert [(row.owner_name, row.value_name, row.value) for row in rows] == [("11", "volt1", 1.0)]


def test_nan_is_kept_unless_dropped(messages):
    raw = messages(['{"ts":"t","params":{"%s":NaN}}' % FULL.format("a")])
    assert math.isnan(flat(raw)[0][-1])
    assert flat(raw, drop_nan=True) == []


def test_salvage_keeps_the_good_neighbours(messages):
    raw = messages(['{"ts":"t","params":{"%s":"x","%s":2}}' % (FULL.format("a"), FULL.format("b"))])
    assert [row[-1] for row in flat(raw, salvage=True)] == [None, 2.0]


def test_malformed_time_is_null_or_fails(spark, messages, readings):
    raw = messages(['{"ts":"soon","params":{"%s":1}}' % FULL.format("a")])
    row = ingest.flatten(raw).collect()[0]
    assert row.time == "soon" and row.event_time is None and row.reading_date is None
    with pytest.raises(PySparkException):
        ingest.with_event_time(ingest.flatten(raw), strict=True).collect()


def test_source_zone_sets_the_instant(messages):
    raw = messages(['{"ts":"2024-01-20 00:00:00","params":{"%s":1}}' % FULL.format("a")])
    row = ingest.flatten(raw, source_tz="Asia/Kolkata").collect()[0]
    assert str(row.event_time) == "2024-01-19 18:30:00" and str(row.reading_date) == "2024-01-20"


def test_wide_rows(messages):
    raw = messages(['{"ts":"t","params":{"voltage":"230","pf":"0.9"}}', "not json"])
    rows = [tuple(row) for row in ingest.widen(raw).collect()]
    assert rows == [("t", "230", None, "0.9"), (None, None, None, None)]


ACCEPTED = [
    '{"ts":"2024-01-20 12:30:00"}',
    '{"ts":"2024-01-20 12:30:00","params":{"a":NaN}}',
    '{"ts":"x","ts":"12:30:00"}',
    '{"ts":"12:30:\\u0030\\u0030"}',
    '{"ts":":00"}  ',
]
REFUSED = [
    '{"ts":"2024-01-20 12:30:01"}',
    '{"params":{"x":":00"}}',
    '{"ts":null}',
    '{"ts":5}',
    '{"ts":{"a":":00"}}',
    '{"ts":[":00"]}',
    '[{"ts":"12:30:00"}]',
    '{"ts":"12:30:00"} trailing',
    '{"ts":"12:30:00"},{"ts":"12:31:00"}',
    '{"ts":"12:30:00"}]',
    "{'ts':'12:30:00'}",
    '{"ts":"12:30:00"',
    "12:30:00",
    "",
]


def test_only_whole_objects_on_the_minute_are_accepted(messages):
    kept = {row.value for row in ingest.accepted(messages(ACCEPTED + REFUSED)).collect()}
    assert kept == set(ACCEPTED)


def test_envelope(messages):
    import json

    texts = ['{"ts":"a"}', "plain", '{"ts":"a"} x', 'say "hi"', "[1]"]
    sealed = [row.value for row in ingest.envelope(messages(texts)).orderBy("offset").collect()]
    assert sealed[0] == texts[0]
    assert [json.loads(text)["raw"] for text in sealed[1:]] == texts[1:]


def test_newest_of_a_minute_wins_and_order_of_rows_does_not_matter(spark):
    text = '{"ts":"12:%02d:00"}'
    rows = [(text % n, "t", n % 3, n, 1705750020 + n * 7) for n in range(20)]
    names = "value string, topic string, partition int, offset bigint, s bigint"
    for order in (rows, rows[::-1]):
        raw = spark.createDataFrame(order, names).selectExpr("* except (s)", "timestamp_seconds(s) AS timestamp")
        latest = {row.arrival.minute: row.offset for row in ingest.sample_latest(raw).collect()}
        assert latest == {27: 8, 28: 17, 29: 19}


def test_tie_on_arrival_goes_to_the_later_offset(spark):
    rows = [('{"ts":":00"}', "t", p, o, 1705750020) for p, o in ((0, 9), (1, 2), (1, 3))]
    raw = spark.createDataFrame(rows, "value string, topic string, partition int, offset bigint, s bigint")
    row = ingest.sample_latest(raw.selectExpr("* except (s)", "timestamp_seconds(s) AS timestamp")).collect()[0]
    assert (row.partition, row.offset) == (1, 3)


def test_dead_letters_and_readings_split_the_messages(messages):
    good = '{"ts":"t","params":{"%s":1}}' % FULL.format("a")
    single = "{'ts':'t','params':{'%s':1}}" % FULL.format("a")
    texts = [good, single, "x", '{"ts":"t","params":{"a":"x"}}', '{"ts":"t","params":{}}', '{"ts":"t","params":{"a":1}}', "{}"]
    reasons = [(row.offset, row.reason) for row in ingest.dead_letters(messages(texts)).orderBy("offset").collect()]
    assert reasons == [
        (2, "not_an_object"),
        (3, "no_numeric_params"),
        (4, "empty_params"),
        (5, "no_energy_meter"),
        (6, "no_numeric_params"),
    ]


def test_batch_deduplication(readings):
    row = ("2024-01-20 12:00:00", "11", "volt1", 1.0)
    assert ingest.deduplicated(readings([row, row, ("2024-01-20 12:01:00", "11", "volt1", 1.0)])).count() == 2


def test_the_strict_parse_agrees_with_python(messages):
    import json

    texts = ACCEPTED + REFUSED + ["[]", "{}", "{} {}", "{},", "{}]", "{}],[{}", " {} ", '{"a":1e5}', '{"a":01}', '{"a":}']

    def whole(text):
        try:
            return isinstance(json.loads(text), dict)
        except json.JSONDecodeError:
            return False

    raw = messages(texts)
    mine = [row.o for row in raw.orderBy("offset").select(M.is_object(raw.value).alias("o")).collect()]
    assert mine == [whole(text) for text in texts]
