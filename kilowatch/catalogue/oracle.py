"""SQL for the registered queries, written apart from them: bounds are spelled out, results are counted in integers."""

NAMES = "['volt1','volt2','volt3','current1','current2','current3','powerfactor','frequency','energy_consumption']"

METER = """
    'c1' AS company_name, concat('b', {m} % 3) AS building_name, concat('f', {m} % 2) AS floor_name,
    's' AS "S0", 'l' AS "L0\""""

MONTHLY = f"""
monthly AS (
  SELECT date_trunc('second', ts) AS event_time, {METER.format(m='user_id')},
         CAST(7 + user_id % 14 AS VARCHAR) AS owner_name, {NAMES}[event_id % 9 + 1] AS value_name,
         CAST(round((CASE WHEN event_id % 9 = 8 THEN event_id * 2 + value ELSE value END) * 100) AS BIGINT) AS cents
  FROM events)"""

YEARLY = f"""
yearly AS (
  SELECT o_orderdate AS event_time, {METER.format(m='o_custkey')},
         CAST(7 + o_custkey % 14 AS VARCHAR) AS owner_name, {NAMES}[o_orderkey % 9 + 1] AS value_name,
         CAST(round((CASE WHEN o_orderkey % 9 = 8
                          THEN date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 5000 + o_totalprice
                          ELSE o_totalprice END) * 100) AS BIGINT) AS cents
  FROM orders)"""


def daily(start):
    return f"""
daily AS (
  SELECT TIMESTAMP '{start}' + to_seconds((event_id + 37800) % 86400) AS event_time, {METER.format(m='user_id')},
         CAST(7 + (event_id // 9) % 2 AS VARCHAR) AS owner_name, {NAMES}[event_id % 9 + 1] AS value_name,
         CAST(round((CASE WHEN event_id % 9 = 8 THEN (event_id + 37800) % 86400 * 2 + value ELSE value END) * 100)
              AS BIGINT) AS cents
  FROM events)"""


UTC_DAY = "2024-01-19 18:30:00"
IST_DAY = "2024-01-20 00:00:00"
FORMATS = {"min": "%Y-%m-%d %H:%M", "hr": "%Y-%m-%d %H:00", "day": "%Y-%m-%d", "month": "%Y-%m", "year": "%Y"}
SOURCES = {"min": "daily", "hr": "daily", "day": "monthly", "month": "yearly", "year": "yearly"}

# Bounds as UTC timestamps, for the moment 2024-01-20 12:34:56 +05:30 (min, hr, day) or 2001-08-01 12:00:00 +05:30.
ROLLING = {
    "min": "2024-01-20 06:04:56",
    "hr": "2024-01-19 07:04:56",
    "day": "2023-12-21 07:04:56",
    "month": "2000-08-01 06:30:00",
    "year": "1996-01-03 06:30:00",
}
PERIOD = {
    "min": ("2024-01-20 06:30:00", "2024-01-20 07:30:00"),
    "hr": ("2024-01-19 18:30:00", "2024-01-20 18:30:00"),
    "day": ("2023-12-31 18:30:00", "2024-01-31 18:30:00"),
    "month": ("2000-12-31 18:30:00", "2001-12-31 18:30:00"),
    "year": ("0001-01-01 00:00:00", "2001-08-01 06:30:00"),
}
# First and last slot of the whole period, local time.
PERIOD_SLOTS = {
    "min": ("2024-01-20 12:00:00", "2024-01-20 12:59:00"),
    "hr": ("2024-01-20 00:00:00", "2024-01-20 23:00:00"),
    "day": ("2024-01-01 00:00:00", "2024-01-31 00:00:00"),
    "month": ("2001-01-01 00:00:00", "2001-12-01 00:00:00"),
}
# Range as written and slots of the period so far, local time.
TO_DATE = {
    "min": ("2024-01-20 11:35:00", "2024-01-20 12:34:56"),
    "hr": ("2024-01-19 13:00:00", "2024-01-20 12:34:56"),
    "day": ("2024-01-01 00:00:00", "2024-01-20 12:34:56"),
    "month": ("2001-01-01 00:00:00", "2001-08-01 12:00:00"),
    "year": ("0001-01-01 00:00:00", "2001-08-01 12:00:00"),
}
TO_DATE_SLOTS = {
    "min": ("2024-01-20 11:35:00", "2024-01-20 12:34:00"),
    "hr": ("2024-01-19 13:00:00", "2024-01-20 12:00:00"),
    "day": ("2024-01-01 00:00:00", "2024-01-20 00:00:00"),
    "month": ("2001-01-01 00:00:00", "2001-08-01 00:00:00"),
}
STEPS = {"min": "1 minute", "hr": "1 hour", "day": "1 day", "month": "1 month"}


def source(interval, start=UTC_DAY):
    return {"daily": daily(start), "monthly": MONTHLY, "yearly": YEARLY}[SOURCES[interval]]


def label(interval, minutes=330):
    return f"strftime(event_time + INTERVAL {minutes} MINUTE, '{FORMATS[interval]}')"


def mean(digits, condition=None):
    """Half-up mean of cents, by integer division; values are never negative."""
    kept = f" FILTER (WHERE {condition})" if condition else ""
    more = 10 ** (digits - 2)
    return (
        f"((2 * sum(cents){kept} * {more} + count(cents){kept}) // nullif(2 * count(cents){kept}, 0)) / {10**digits}.0"
    )


def means(interval, columns, digits, where, minutes=330, start=UTC_DAY):
    several = len(columns) > 1
    shown = ", ".join(
        f"{mean(digits, f'value_name = {measure!r}' if several else None)} AS {name}"
        for measure, name in columns.items()
    )
    listed = ", ".join(repr(measure) for measure in columns)
    return f"""
WITH {source(interval, start)}
SELECT owner_name, {label(interval, minutes)} AS time, {shown}
FROM {SOURCES[interval]} WHERE value_name IN ({listed}) AND {where}
GROUP BY 1, 2"""


def in_period(interval):
    low, high = PERIOD[interval]
    return f"event_time >= TIMESTAMP '{low}' AND event_time < TIMESTAMP '{high}'"


def voltage(interval):
    columns = {"volt1": "volt1", "volt2": "volt2", "volt3": "volt3"}
    return means(interval, columns, 2, f"event_time >= TIMESTAMP '{ROLLING[interval]}'")


def buckets(interval, where, minutes, extra="", source=None):
    """First and last register reading per owner and label; ties on time are ordered by value."""
    tick = "{'at': event_time, 'reading': cents}"
    return f"""
buckets AS (
  SELECT owner_name{extra}, {label(interval, minutes)} AS time,
         arg_min(cents, {tick}) AS first_cents, arg_max(cents, {tick}) AS last_cents
  FROM {source or SOURCES[interval]} WHERE value_name = 'energy_consumption' AND {where}
  GROUP BY ALL)"""


def slots(interval, bounds, last_year):
    name = SOURCES[interval]
    if interval == "year":
        return f"""
slots AS (
  SELECT owner_name, CAST(unnest(generate_series(year(min(event_time)), {last_year})) AS VARCHAR) AS time
  FROM {name} WHERE value_name = 'energy_consumption' GROUP BY owner_name)"""
    low, high = bounds[interval]
    return f"""
slots AS (
  SELECT owner_name, strftime(slot, '{FORMATS[interval]}') AS time
  FROM (SELECT DISTINCT owner_name FROM {name}) AS o,
       (SELECT unnest(generate_series(TIMESTAMP '{low}', TIMESTAMP '{high}', INTERVAL {STEPS[interval]})) AS slot) AS s)"""


ENERGY = "coalesce((last_cents - first_cents) / 100.0, 0.0)"
GHG = "coalesce(((greatest(last_cents - first_cents, 0) * 58 + 5) // 10) / 1000000.0, 0.0)"


def register(interval, where, bounds, minutes, figure, name, start):
    return f"""
WITH {source(interval, start)}, {buckets(interval, where, minutes)}, {slots(interval, bounds, 2001)}
SELECT owner_name, time, {figure} AS {name}
FROM slots LEFT JOIN buckets USING (owner_name, time)"""


def energy(interval):
    return register(interval, in_period(interval), PERIOD_SLOTS, 330, ENERGY, "energy", UTC_DAY)


def to_date(interval):
    low, high = TO_DATE[interval]
    return f"event_time >= TIMESTAMP '{low}' AND event_time <= TIMESTAMP '{high}'"


def ghg(interval, consistent=True):
    start = IST_DAY if consistent else UTC_DAY
    minutes = 0 if consistent else 330
    return register(interval, to_date(interval), TO_DATE_SLOTS, minutes, GHG, "ghg_emission", start)


def per_meter(interval):
    path = ', company_name, building_name, floor_name, "S0", "L0"'
    return f"""
WITH {source(interval)}, {buckets(interval, in_period(interval), 330, path)}, {slots(interval, PERIOD_SLOTS, 2001)},
sums AS (SELECT owner_name, time, sum(last_cents - first_cents) AS cents FROM buckets GROUP BY ALL)
SELECT owner_name, time, coalesce(cents / 100.0, 0.0) AS energy
FROM slots LEFT JOIN sums USING (owner_name, time)"""


ENERGY_DAY_LAG = f"""
WITH {MONTHLY},
steps AS (
  SELECT owner_name, {label('day')} AS time,
         cents - lag(cents) OVER (PARTITION BY owner_name ORDER BY event_time, cents) AS step
  FROM monthly WHERE value_name = 'energy_consumption' AND {in_period('day')}),
sums AS (SELECT owner_name, time, sum(step) AS cents FROM steps GROUP BY ALL), {slots('day', PERIOD_SLOTS, 2024)}
SELECT owner_name, time, coalesce(cents / 100.0, 0.0) AS energy
FROM slots LEFT JOIN sums USING (owner_name, time)"""

OWNERS = f"""
WITH {MONTHLY}
SELECT DISTINCT owner_name,
       coalesce(list_position(['11','12','16','17','18','13','10','7','8','9'], owner_name), 11) AS position
FROM monthly"""


OWNERS_WITH_NULL = f"""
WITH {MONTHLY}, named AS (SELECT DISTINCT coalesce(nullif(owner_name, '7'), 'None') AS owner_name FROM monthly)
SELECT owner_name,
       coalesce(list_position(['11','12','16','17','18','13','10','7','8','9'], owner_name), 11) AS position
FROM named"""


def spread(low, high="2024-01-20 12:34:56"):
    """Last minus first in cents, 0 with fewer than two readings."""
    tick = "{'at': event_time, 'reading': cents}"
    kept = (
        "FILTER (WHERE value_name = 'energy_consumption' "
        f"AND event_time BETWEEN TIMESTAMP '{low}' AND TIMESTAMP '{high}')"
    )
    return (
        f"CASE WHEN count(*) {kept} >= 2 "
        f"THEN arg_max(cents, {tick}) {kept} - arg_min(cents, {tick}) {kept} ELSE 0 END"
    )


RANGE_CONSUMPTION = f"""
WITH {MONTHLY}
SELECT owner_name, {spread('2024-01-05 00:00:00')} / 100.0 AS energy FROM monthly GROUP BY owner_name"""


def cost(cents):
    return f"sign({cents}) * ((abs({cents}) * 825 + 50) // 100) / 100.0"



def energy_stats(profile, name, now, day, month, year):
    return f"""
WITH {profile},
spreads AS (
  SELECT owner_name, {spread(day, now)} AS d, {spread(month, now)} AS m, {spread(year, now)} AS y
  FROM {name} GROUP BY owner_name)
SELECT owner_name, d / 100.0 AS one_day_energy, {cost('d')} AS one_day_cost,
       m / 100.0 AS one_month_energy, {cost('m')} AS one_month_cost,
       y / 100.0 AS one_year_energy, {cost('y')} AS one_year_cost
FROM spreads"""


ENERGY_STATS = energy_stats(
    MONTHLY, "monthly", "2024-01-20 12:34:56", "2024-01-20 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00"
)
ENERGY_STATS_MARCH = energy_stats(
    YEARLY, "yearly", "2001-03-15 12:00:00", "2001-03-15 00:00:00", "2001-03-01 00:00:00", "2001-01-01 00:00:00"
)


def energy_day_from(changed, figure=ENERGY):
    """Energy per day over `changed`, a SELECT from the monthly readings."""
    return f"""
WITH {MONTHLY}, changed AS ({changed}), {buckets('day', in_period('day'), 330, source='changed')},
{slots('day', PERIOD_SLOTS, 2024)}
SELECT owner_name, time, {figure} AS energy FROM slots LEFT JOIN buckets USING (owner_name, time)"""


EARLIEST = f"""
WITH {YEARLY}
SELECT owner_name, strftime(min(event_time), '%Y-%m-%d %H:%M:%S') AS earliest
FROM yearly WHERE value_name = 'energy_consumption' GROUP BY owner_name"""

VOLTAGE_LONG = f"""
WITH {daily(UTC_DAY)}
SELECT owner_name, {label('hr')} AS time, value_name, {mean(2)} AS mean_value
FROM daily WHERE value_name IN ('volt1', 'volt2', 'volt3') GROUP BY 1, 2, 3"""

SENT_TIME = """strftime(CASE WHEN event_id % 3 = 0 THEN date_trunc('minute', ts) ELSE ts END, '%Y-%m-%d %H:%M:%S')"""
ADDRESS = """concat('meters_', event_type) AS topic, CAST(event_id % 4 AS INTEGER) AS partition,
       event_id // 4 AS "offset\""""

FLATTEN = f"""
WITH sent AS (
  SELECT *, {SENT_TIME} AS time FROM events WHERE event_type NOT IN ('error', 'view', 'signup')),
entries AS (
  SELECT *, {NAMES}[event_id % 9 + 1] AS value_name, value AS reading FROM sent
  UNION ALL
  SELECT *, 'spare' AS value_name, event_id / 2 AS reading FROM sent)
SELECT time, substr(time, 1, 10) AS reading_date, {METER.format(m='user_id')},
       CAST(7 + user_id % 14 AS VARCHAR) AS owner_name, value_name, reading AS value
FROM entries"""

REDELIVERED = f"""
SELECT DISTINCT * FROM ({FLATTEN})"""



def energy_stream(interval):
    return f"""
WITH {MONTHLY}, {buckets(interval, 'true', 330, source=SOURCES['day'])}
SELECT owner_name, time, (last_cents - first_cents) / 100.0 AS energy FROM buckets"""


WIDE = """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CAST(value AS VARCHAR) AS voltage,
       CASE WHEN event_type <> 'view' THEN CAST(user_id AS VARCHAR) END AS current,
       CAST(event_id % 100 AS VARCHAR) AS power_factor
FROM events"""

PROPS = """
WITH keyed AS (SELECT event_id, props, unnest(json_keys(props)) AS full_key FROM events)
SELECT event_id, full_key, CAST(json_extract_string(props, concat('$.', full_key)) AS DOUBLE) AS value FROM keyed"""

ACCEPTED = "event_type <> 'error' AND (event_id % 3 = 0 OR strftime(ts, '%S') = '00')"

MINUTE_FILTER = f"SELECT {ADDRESS}, {SENT_TIME} AS time FROM events WHERE {ACCEPTED}"

MINUTE_LATEST = f"""
WITH arrivals AS (
  SELECT *, TIMESTAMP '{UTC_DAY}' + to_seconds((event_id + 37800) % 86400) AS arrived, {SENT_TIME} AS time
  FROM events WHERE {ACCEPTED}),
newest AS (
  SELECT strftime(arrived, '%Y-%m-%d %H:%M') AS arrival,
         max({{'at': arrived, 'p': event_id % 4, 'o': event_id // 4, 'kind': event_type, 'time': time}}) AS m
  FROM arrivals GROUP BY 1)
SELECT arrival, concat('meters_', m.kind) AS topic, CAST(m.p AS INTEGER) AS partition, m.o AS "offset", m.time AS time
FROM newest"""

PAYLOAD_OR_RAW = f"""
SELECT {ADDRESS},
       CASE WHEN event_type = 'error' THEN concat('error at ', strftime(ts, '%Y-%m-%d %H:%M:%S')) END AS raw,
       CASE WHEN event_type <> 'error' THEN {SENT_TIME} END AS time
FROM events"""

DEAD_LETTERS = f"""
SELECT {ADDRESS}, CASE WHEN event_type = 'error' THEN 'not_an_object' ELSE 'no_energy_meter' END AS reason
FROM events WHERE event_type IN ('error', 'view', 'signup')"""

TOPIC_MIRROR = f"SELECT {ADDRESS} FROM events WHERE event_type IN ('click', 'purchase')"

OFFSET_RANGES = f"""
WITH raw AS (SELECT {ADDRESS} FROM events)
SELECT topic, partition, min("offset") AS first_offset, max("offset") AS last_offset, count(*) AS messages
FROM raw GROUP BY topic, partition"""

RETENTION = f"SELECT {ADDRESS} FROM events WHERE ts >= TIMESTAMP '2024-01-13 07:04:56'"

ROUND_TRIP = f"""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, CAST(7 + user_id % 14 AS VARCHAR) AS owner_name,
       {NAMES}[event_id % 9 + 1] AS value_name,
       CASE WHEN event_id % 9 = 8 THEN event_id * 2 + value ELSE value END AS value
FROM events"""


# Minutes and hours that time has passed: it moves on with every message, and with the newest reading of a register.
MINUTE_LATEST_PASSED = f"""
SELECT * FROM ({MINUTE_LATEST})
WHERE strptime(arrival, '%Y-%m-%d %H:%M') + INTERVAL 1 MINUTE
      <= (SELECT max(TIMESTAMP '{UTC_DAY}' + to_seconds((event_id + 37800) % 86400)) FROM events)"""
ENERGY_HR_PASSED = f"""
WITH {daily(UTC_DAY)}, held AS (SELECT DISTINCT {label('hr')} AS time FROM daily WHERE value_name = 'energy_consumption'),
named AS (SELECT DISTINCT owner_name FROM daily WHERE value_name = 'energy_consumption')
SELECT e.* FROM ({energy('hr')}) AS e JOIN named USING (owner_name)
WHERE time >= (SELECT min(time) FROM held) AND time < (SELECT max(time) FROM held)"""


def lag_stream(interval, profile, name):
    return f"""
WITH {profile},
steps AS (
  SELECT owner_name, {label(interval)} AS time,
         cents - lag(cents) OVER (PARTITION BY owner_name ORDER BY event_time, cents) AS step
  FROM {name} WHERE value_name = 'energy_consumption')
SELECT owner_name, time, coalesce(sum(step), 0) / 100.0 AS energy FROM steps GROUP BY ALL"""


ISLANDS = f"""
WITH {MONTHLY},
marked AS (
  SELECT owner_name, event_time,
         CASE WHEN event_time - lag(event_time) OVER (PARTITION BY owner_name ORDER BY event_time) <= INTERVAL 1 HOUR
              THEN 0 ELSE 1 END AS new
  FROM monthly),
numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY owner_name ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS island FROM marked),
runs AS (
  SELECT owner_name, min(event_time) AS started, max(event_time) AS ended, count(*) AS readings
  FROM numbered GROUP BY owner_name, island)"""
CLOCK = "'%Y-%m-%d %H:%M:%S'"
RUNS = f"""{ISLANDS}
SELECT owner_name, strftime(started, {CLOCK}) AS started, strftime(ended, {CLOCK}) AS ended, readings FROM runs"""
OUTAGES = f"""{ISLANDS},
following AS (SELECT owner_name, ended, lead(started) OVER (PARTITION BY owner_name ORDER BY started) AS until FROM runs)
SELECT owner_name, strftime(ended, {CLOCK}) AS since, strftime(until, {CLOCK}) AS until
FROM following WHERE until IS NOT NULL"""
CLOSED_RUNS = f"""{RUNS} WHERE ended + INTERVAL 1 HOUR < (SELECT max(event_time) - INTERVAL 2 DAY FROM monthly)"""

# Deliveries of ten days, one reading in ten a delivery late; refused is what lies two days behind all earlier ones.
DELIVERED = f"""
WITH delivered AS (
  SELECT date_trunc('second', ts) AS event_time, CAST(7 + user_id % 14 AS VARCHAR) AS owner_name,
         {NAMES}[event_id % 9 + 1] AS value_name,
         CASE WHEN event_id % 9 = 8 THEN event_id * 2 + value ELSE value END AS value,
         least((day(ts) - 1) // 10, 2) + CAST(event_id % 10 = 0 AS INTEGER) AS delivery
  FROM events),
newest AS (SELECT delivery, max(event_time) AS newest FROM delivered GROUP BY delivery),
marks AS (
  SELECT delivery, max(newest) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                   - INTERVAL 2 DAY AS mark
  FROM newest),
judged AS (SELECT *, coalesce(event_time < mark, false) AS late FROM delivered JOIN marks USING (delivery))"""
REFUSED = f"""{DELIVERED}
SELECT strftime(event_time, {CLOCK}) AS time, owner_name, value_name, value, strftime(mark, {CLOCK}) AS watermark
FROM judged WHERE late"""
LATE_COUNTS = f"""{DELIVERED}
SELECT owner_name, count(*) FILTER (WHERE NOT late) AS in_time, count(*) FILTER (WHERE late) AS refused,
       CAST(max(epoch(mark) - epoch(event_time)) FILTER (WHERE late) AS BIGINT) AS most_behind
FROM judged GROUP BY owner_name"""


def parse_facts(kinds, odd):
    """Messages of the given kinds, `odd` the first of their two values by kind; a time that is a number is no date."""
    return f"""
WITH kept AS (SELECT *, event_id % 8 AS kind FROM events WHERE event_id % 8 IN ({kinds})),
entries AS (
  SELECT *, 'volt1' AS value_name, {odd} AS reading FROM kept
  UNION ALL
  SELECT *, 'volt2' AS value_name, event_id % 100 + 0.5 AS reading FROM kept)
SELECT CASE WHEN kind = 7 THEN '5' ELSE strftime(ts, {CLOCK}) END AS time,
       CASE WHEN kind <> 7 THEN strftime(ts, '%Y-%m-%d') END AS reading_date,
       concat('b', user_id % 3) AS building_name, CAST(7 + user_id % 14 AS VARCHAR) AS owner_name, value_name,
       CAST(reading AS DOUBLE) AS value, kind = 4 AND value_name = 'volt1' AS no_number
FROM entries"""


def oracle_sql():
    found = {
        "owners_ordered": OWNERS,
        "range_consumption": RANGE_CONSUMPTION,
        "energy_stats_to_date": ENERGY_STATS,
        "energy_stats_in_march": ENERGY_STATS_MARCH,
        "range_consumption_datetimes": RANGE_CONSUMPTION,
        "owners_with_null": OWNERS_WITH_NULL,
        "energy_day_default": energy("day"),
        "energy_day_large": energy_day_from(
            "SELECT * REPLACE (date_trunc('hour', event_time) AS event_time, cents * 1000000 AS cents) FROM monthly"
        ),
        "energy_day_nan": energy_day_from("SELECT * FROM monthly WHERE second(event_time) % 5 <> 0"),
        "energy_day_of_owner": f"SELECT * FROM ({energy('day')}) WHERE owner_name = '11'",
        "response_owners": f"""
WITH {MONTHLY},
held AS (
  SELECT owner_name, count(DISTINCT {label('day')}) AS entries FROM monthly
  WHERE value_name = 'frequency' AND owner_name <> '11' AND {in_period('day')} GROUP BY owner_name)
SELECT owner_name, 'day' AS interval, coalesce(entries, 0) AS entries
FROM (SELECT DISTINCT owner_name FROM monthly) LEFT JOIN held USING (owner_name)""",
        "earliest_by_owner": EARLIEST,
        "voltage_long_hr": VOLTAGE_LONG,
        "energy_day_lag": ENERGY_DAY_LAG,
        "energy_day_per_meter": per_meter("day"),
        "energy_year_per_meter": per_meter("year"),
        "energy_hr_consistent": register(
            "hr",
            "event_time >= TIMESTAMP '2024-01-20 00:00:00' AND event_time < TIMESTAMP '2024-01-21 00:00:00'",
            PERIOD_SLOTS,
            0,
            ENERGY,
            "energy",
            IST_DAY,
        ),
        "power_factor_hr_consistent": means(
            "hr",
            {"powerfactor": "power_factor"},
            3,
            "event_time >= TIMESTAMP '2024-01-20 00:00:00' AND event_time < TIMESTAMP '2024-01-21 00:00:00'",
            0,
            IST_DAY,
        ),
        "flatten_readings": FLATTEN,
        "flatten_readings_stream": FLATTEN,
        "redelivered_readings": REDELIVERED,
        "redelivered_readings_stream": REDELIVERED,
        "flatten_lines_stream": FLATTEN,
        "flatten_lines_from_latest": FLATTEN.replace("FROM events WHERE", "FROM events WHERE event_id // 4 % 2 = 1 AND"),
        "owner_runs_stream": RUNS,
        "owner_outages_stream": OUTAGES,
        "closed_runs_stream": CLOSED_RUNS,
        "refused_readings_stream": REFUSED,
        "late_counts_stream": LATE_COUNTS,
        "energy_day_lag_stream": lag_stream("day", MONTHLY, "monthly"),
        "energy_month_lag_stream": lag_stream("month", YEARLY, "yearly"),
        "energy_year_lag_stream": lag_stream("year", YEARLY, "yearly"),
        "parse_facts": parse_facts("0, 4, 7", "CASE kind WHEN 0 THEN 1.25 WHEN 7 THEN 4.5 END"),
        "parse_facts_salvaged": parse_facts(
            "0, 1, 2, 3, 4, 7", "CASE kind WHEN 0 THEN 1.25 WHEN 2 THEN 1.5 WHEN 7 THEN 4.5 END"
        ),
        "frequency_day_default": means("day", {"frequency": "frequency"}, 2, in_period("day")),
        "voltage_hr_default": voltage("hr"),
        "frequency_day_default_stream": means("day", {"frequency": "frequency"}, 2, "true"),
        "minute_latest_stream": MINUTE_LATEST_PASSED,
        "energy_hr_slots_stream": ENERGY_HR_PASSED,
        "response_documents": f"""
SELECT CAST(to_json(struct_pack(owner_name := owner_name, "interval" := 'day',
                                data := list(struct_pack("time" := time, energy := energy) ORDER BY time))) AS VARCHAR) AS value
FROM ({energy('day')}) GROUP BY owner_name""",
        "range_consumption_rollup": RANGE_CONSUMPTION,
        "energy_stats_rollup": ENERGY_STATS_MARCH,
        "energy_year_rollup": energy("year"),
        "ghg_year_rollup": ghg("year"),
        "energy_day_stream": energy_stream("day"),
        "energy_month_stream": energy_stream("month"),
        "energy_year_stream": energy_stream("year"),
        "energy_day_watermark": energy_stream("day"),
        "wide_params": WIDE,
        "raw_envelope": WIDE,
        "props_explode": PROPS,
        "minute_filter": MINUTE_FILTER,
        "minute_latest": MINUTE_LATEST,
        "payload_or_raw": PAYLOAD_OR_RAW,
        "dead_letters": DEAD_LETTERS,
        "topic_mirror": TOPIC_MIRROR,
        "offset_ranges": OFFSET_RANGES,
        "retention": RETENTION,
        "message_round_trip": ROUND_TRIP,
        "energy_day_stored": energy("day"),
        "response_entries": f"""
SELECT owner_name, 'day' AS interval, CAST(row_number() OVER (PARTITION BY owner_name ORDER BY time) - 1 AS INTEGER)
       AS place, time, energy FROM ({energy('day')})""",
        "frequency_day_stream": means("day", {"frequency": "frequency"}, 2, "true"),
    }
    for interval in FORMATS:
        found[f"voltage_{interval}"] = voltage(interval)
        found[f"ghg_{interval}"] = ghg(interval)
        found[f"ghg_{interval}_compat"] = ghg(interval, consistent=False)
        found[f"energy_{interval}"] = energy(interval)
        found[f"power_factor_{interval}"] = means(interval, {"powerfactor": "power_factor"}, 3, in_period(interval))
        phases = {"current1": "a1", "current2": "a2", "current3": "a3"}
        found[f"current_{interval}"] = means(interval, phases, 2, in_period(interval))
        found[f"frequency_{interval}"] = means(interval, {"frequency": "frequency"}, 2, in_period(interval))
    return found
