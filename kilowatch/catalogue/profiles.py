"""Readings and raw messages derived from the given tables, row by row.

Every column is an expression over its own row: deriving a profile adds no shuffle, and each one grows with its table.
The register is a rising count per row plus the row's own value, so it mostly rises and sometimes falls back, as meters
do when they are reset.
"""

from kilowatch.vocabulary import MEASURES, REGISTER, TIME_PATTERN

AS_OF = "2024-01-20 12:34:56"
ORDERS_AS_OF = "2001-08-01 12:00:00"
# The day of AS_OF in the display zone, in UTC and as written on its own wall clock.
DAY_START = "2024-01-19 18:30:00"
WALL_DAY_START = "2024-01-20 00:00:00"
DAY_SECONDS = 86400
DENSE_FIRST_SECOND = 37800

NAMES = ", ".join(f"'{name}'" for name in MEASURES)
SECOND_OF_DAY = f"(event_id + {DENSE_FIRST_SECOND}) % {DAY_SECONDS}"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _measure(number):
    return f"element_at(array({NAMES}), CAST({number} % {len(MEASURES)} + 1 AS INT))"


def _folded(day_start):
    return f"timestamp_seconds(unix_timestamp('{day_start}') + {SECOND_OF_DAY})"


def _readings(rows, event_time, owner, number, meter, value, register):
    return rows.selectExpr(
        f"{event_time} AS event_time",
        f"concat('b', {meter} % 3) AS building_name",
        f"concat('f', {meter} % 2) AS floor_name",
        f"CAST({owner} AS STRING) AS owner_name",
        f"{_measure(number)} AS value_name",
        f"CASE WHEN {_measure(number)} = '{REGISTER}' THEN {register} ELSE {value} END AS value",
    ).selectExpr(f"date_format(event_time, '{TIME_PATTERN}') AS time", "'c1' AS company_name", "'s' AS S0", "'l' AS L0", "*")


def monthly(spark, sf_dir):
    """One month of readings of 14 owners, at the events' own times."""
    return monthly_of(table(spark, sf_dir, "events"))


def monthly_of(events):
    return _readings(
        events,
        event_time="date_trunc('SECOND', CAST(ts AS TIMESTAMP))",
        owner="7 + user_id % 14",
        number="event_id",
        meter="user_id",
        value="value",
        register="event_id * 2D + value",
    )


def daily(spark, sf_dir, day_start=DAY_START):
    """One day of readings of two owners: events folded onto the seconds of a day that starts at `day_start`.

    The more events there are, the more readings share a second.
    """
    return daily_of(table(spark, sf_dir, "events"), day_start)


def daily_of(events, day_start=DAY_START):
    return _readings(
        events,
        event_time=_folded(day_start),
        owner=f"7 + event_id div {len(MEASURES)} % 2",
        number="event_id",
        meter="user_id",
        value="value",
        register=f"{SECOND_OF_DAY} * 2D + value",
    )


def yearly(spark, sf_dir):
    """Years of readings of 14 owners from orders; many share a time."""
    return yearly_of(table(spark, sf_dir, "orders"))


def yearly_of(orders):
    return _readings(
        orders,
        event_time="CAST(o_orderdate AS TIMESTAMP)",
        owner="7 + o_custkey % 14",
        number="o_orderkey",
        meter="o_custkey",
        value="o_totalprice",
        register="datediff(o_orderdate, DATE'1995-01-01') * 5000D + o_totalprice",
    )


def raw_messages(spark, sf_dir, folded=False):
    return raw_messages_of(table(spark, sf_dir, "events"), folded)


def raw_messages_of(events, folded=False):
    """One message per event, in Kafka's shape; `folded` lets all of them arrive within one day.

    Events of type `error` are plain text, `view` belongs to another meter class, `signup` has a path that is cut short;
    the rest carry two readings. A third of all messages lie on a full minute.
    """
    time = f"date_format(CASE WHEN event_id % 3 = 0 THEN date_trunc('MINUTE', ts) ELSE ts END, '{TIME_PATTERN}')"
    place = "concat_ws('/', 'c1', concat('b', user_id % 3), concat('f', user_id % 2), 's', 'l', 7 + user_id % 14)"
    kind = "CASE event_type WHEN 'view' THEN '/WM' WHEN 'signup' THEN '' ELSE '/EM' END"
    first = f"concat({place}, '/', {_measure('event_id')}, {kind}), value"
    second = f"concat({place}, '/spare', {kind}), event_id * 0.5D"
    message = f"to_json(named_struct('ts', {time}, 'params', map({first}, {second})))"
    plain = f"concat('error at ', date_format(ts, '{TIME_PATTERN}'))"
    return events.selectExpr(
        f"CASE WHEN event_type = 'error' THEN {plain} ELSE {message} END AS value",
        "concat('meters_', event_type) AS topic",
        "CAST(event_id % 4 AS INT) AS partition",
        "event_id div 4 AS offset",
        f"{_folded(DAY_START) if folded else 'CAST(ts AS TIMESTAMP)'} AS timestamp",
    )


def faulty_messages(spark, sf_dir):
    """One message per event with two readings, in eight forms: whole, one value that is no number, quoted, true or NaN, plain
    text, an array, and a number for a time."""
    time = f"date_format(ts, '{TIME_PATTERN}')"
    place = "concat('c1/b', user_id % 3, '/f0/s/l/', 7 + user_id % 14)"
    odd = "element_at(array('1.25', '\"x\"', '\"1.5\"', 'true', 'NaN', '2.5', '3.5', '4.5'), CAST(event_id % 8 + 1 AS INT))"
    sent = f"CASE WHEN event_id % 8 = 7 THEN '5' ELSE concat('\"', {time}, '\"') END"
    message = (
        f"concat('{{\"ts\":', {sent}, ',\"params\":{{\"', {place}, '/volt1/EM\":', {odd}, "
        f"',\"', {place}, '/volt2/EM\":', event_id % 100, '.5}}}}')"
    )
    value = f"CASE event_id % 8 WHEN 5 THEN concat('error at ', {time}) WHEN 6 THEN concat('[', {message}, ']') ELSE {message} END"
    return table(spark, sf_dir, "events").selectExpr(f"{value} AS value", "event_id")


def wide_messages(spark, sf_dir):
    """One message per event with the three live parameters; some lack the current."""
    voltage, factor = "CAST(value AS STRING)", "CAST(event_id % 100 AS STRING)"
    all_three = f"map('voltage', {voltage}, 'current', CAST(user_id AS STRING), 'pf', {factor})"
    params = f"CASE WHEN event_type = 'view' THEN map('voltage', {voltage}, 'pf', {factor}) ELSE {all_three} END"
    return table(spark, sf_dir, "events").selectExpr(
        f"to_json(named_struct('ts', date_format(ts, '{TIME_PATTERN}'), 'params', {params})) AS value"
    )
