"""Meter queries over a readings DataFrame, for all owners at once or for one.

Every function only builds a plan. `as_of` is the instant the question is asked at; text and zone-less datetimes are
local to the display zone. `interval` is one of min, hr, day, month, year or its short code m, h, d, M, y.

Options shared by the queries
    owner            restrict to one owner
    owners           complete table of owners for gap-filled results, saves the scan that lists them
    consistent_time  read `time` as local to the display zone for ranges and labels alike; otherwise ranges and labels
                     follow `event_time`, or whichever clock the query is specified with
    scale            number of decimals the meters report; makes sums exact and independent of row order
    rounding         half_up or even
"""

from pyspark.sql import functions as F

from kilowatch.functions import rounding as R, timeaxis as X
from kilowatch.functions.grouping import hashed
from kilowatch.operators import calendar as C, gauges as G, owners as O, registers as S
from kilowatch.vocabulary import (
    DISPLAY_TZ,
    FREQUENCY,
    GHG_PER_UNIT,
    PHASE_CURRENTS,
    PHASE_VOLTAGES,
    POWER_FACTOR,
    UNIT_COST,
)


def unique_owners(readings):
    """Owners with their place in the display order; sort by (position, owner_name) to show them."""
    return O.ordered_owners(readings)


def display_order(owners):
    return owners.orderBy("position", "owner_name")


def range_consumption(readings, start, stop, owner=None, owners=None, scale=None, rounding="half_up"):
    """Register consumption between two wall-clock times, both included; 0 with fewer than two readings.

    Times are texts or datetimes; a datetime with a zone is moved to the display zone.
    """
    start, stop = (t if isinstance(t, str) else X.wall_text(X.as_local(t, DISPLAY_TZ)) for t in (start, stop))
    rows = O.of_owner(S.register_rows(readings, scale), owner).filter(F.col("time").between(start, stop))
    if "reading_date" in readings.columns:
        rows = rows.filter(F.col("reading_date").between(F.lit(start[:10]).cast("date"), F.lit(stop[:10]).cast("date")))
    rows = rows.select("owner_name", "time", "value")
    shown = O.roster(readings, owner, owners)
    totals = S.first_last(rows.unionByName(shown, allowMissingColumns=True), ["owner_name"], clock="time")
    used = energy_if_two(F.col("n"), F.col("tail.reading"), F.col("head.reading"), scale, rounding)
    return totals.select("owner_name", used.alias("energy"))


def energy_if_two(count, last, first, scale, rounding):
    energy = R.rounded(R.difference(last, first, scale), 2, rounding)
    return F.when(count >= 2, energy).otherwise(F.lit(0.0))


def energy_stats(
    readings, as_of, owner=None, owners=None, display_tz=DISPLAY_TZ, unit_cost=UNIT_COST, scale=None, rounding="half_up"
):
    """Energy and cost of the day, month and year up to `as_of`.

    One scan: a reading belongs to the innermost range that holds it, first and last are found per owner and range,
    and at most three rows per owner are then merged outwards.
    """
    now = X.as_local(as_of, display_tz)
    starts = {
        "one_day": X.period_start(now, X.INTERVALS["hr"]),
        "one_month": X.period_start(now, X.INTERVALS["day"]),
        "one_year": X.period_start(now, X.INTERVALS["month"]),
    }
    time = F.col("time")
    ring = F.lit(2)
    for depth, start in ((1, starts["one_month"]), (0, starts["one_day"])):
        ring = F.when(time >= X.wall_text(start), F.lit(depth)).otherwise(ring)
    year = X.Span(starts["one_year"], now, True)
    rows = (
        O.of_owner(S.register_rows(readings, scale), owner)
        .filter(X.in_span(readings, year, wall=True))
        .select("owner_name", "time", "value", ring.alias("ring"))
    )
    shown = O.roster(readings, owner, owners)
    rings = S.first_last(rows.unionByName(shown, allowMissingColumns=True), ["owner_name", "ring"], clock="time")
    merged = []
    for reach, name in enumerate(starts):
        inside = F.col("ring") <= reach
        merged += [
            F.sum(F.when(inside, F.col("n"))).alias(f"{name}_n"),
            hashed(F.min(F.when(inside, F.col("head")))).alias(f"{name}_head"),
            F.max(F.when(inside, F.col("tail"))).alias(f"{name}_tail"),
        ]
    return stats_of(rings.groupBy("owner_name").agg(*merged), starts, unit_cost, scale, rounding)


def stats_of(totals, names, unit_cost, scale, rounding):
    """Energy and cost of ranges from their number of readings (`_n`), first (`_head`) and last (`_tail`)."""
    shown = []
    for name in names:
        energy = energy_if_two(
            F.col(f"{name}_n"), F.col(f"{name}_tail.reading"), F.col(f"{name}_head.reading"), scale, rounding
        )
        cost = R.rounded(energy.cast("decimal(24,2)") * F.lit(unit_cost), 2, rounding)
        shown += [energy.alias(f"{name}_energy"), cost.alias(f"{name}_cost")]
    return totals.select("owner_name", *shown)


def _register_by_bucket(readings, span, interval, finish, name, wall, options):
    """Register consumption per bucket with all slots filled; `finish` turns a difference into the shown figure."""
    consistent_time, owner, scale = options["consistent_time"], options["owner"], options["scale"]
    rows = O.of_owner(S.register_rows(readings, scale), owner)
    local = X.local_seconds(options["display_tz"], consistent_time)
    clock = F.try_to_timestamp("time") if consistent_time else F.col("event_time")
    rows = rows.withColumn("bucket", X.bucket_of(local, interval))
    order = S.ordered(clock)
    keys = ["owner_name", *S.meter_keys(options["per_meter"]), "bucket"]
    last = X.slot_literal(span.last_slot)
    if span.start is not None:
        # What has no slot is dropped before it is aggregated.
        first = X.slot_literal(span.first_slot)
        rows = rows.filter(X.in_span(readings, span, wall) & F.col("bucket").between(first, last))
        ends = S.bucket_ends(rows.select(*keys, order.alias("order")), keys)
        shown, carried = O.roster(readings, owner, options["owners"]), ()
    else:
        # Years start with an owner's first register reading; an owner without one has no years. The upper bound
        # decides which readings count, not which owners exist, so it is applied inside the aggregation.
        seen = X.local_seconds(options["display_tz"], True) if wall else F.unix_seconds(clock)
        counted = F.when(X.in_span(rows.select("time", "event_time"), span, wall), order)
        rows = rows.filter(F.col("bucket").isNotNull()).select(
            *keys, counted.alias("order"), seen.alias("seen")
        )
        ends = S.bucket_ends(rows, keys, F.min("seen").alias("earliest"))
        first = X.bucket_of(F.col("earliest"), interval)
        shown, carried = None, [F.min("earliest").alias("earliest")]
    used = S.bucket_consumption(ends, scale, options["per_meter"], options["method"])
    dense = C.filled(used, "used", first, last, interval, shown, carried)
    return dense.select(
        "owner_name", X.label_of(F.col("bucket"), interval).alias("time"), finish(F.col("used")).alias(name)
    )


def _register_options(display_tz, consistent_time, scale, per_meter, method, owner, owners):
    return {
        "display_tz": display_tz,
        "consistent_time": consistent_time,
        "scale": scale,
        "per_meter": per_meter,
        "method": method,
        "owner": owner,
        "owners": owners,
    }


def ghg_emission(
    readings,
    as_of,
    interval,
    owner=None,
    owners=None,
    display_tz=DISPLAY_TZ,
    consistent_time=True,
    per_unit=GHG_PER_UNIT,
    scale=None,
    rounding="half_up",
    per_meter=False,
    method="within",
):
    """Emission per bucket so far, never negative, all slots filled.

    The range is always taken on `time` as written. With `consistent_time=False` the labels follow `event_time`, which
    shifts them against the slots and drops what falls outside.
    """
    X.require_utc(readings)
    interval = X.resolve_interval(interval)
    span = X.to_date_span(X.as_local(as_of, display_tz), interval)

    def finish(used):
        emitted = F.greatest(used, F.lit(0)) * R.factor(per_unit, scale)
        return F.coalesce(R.rounded(emitted, 6, rounding), F.lit(0.0))

    options = _register_options(display_tz, consistent_time, scale, per_meter, method, owner, owners)
    return _register_by_bucket(readings, span, interval, finish, "ghg_emission", True, options)


def energy_consumption(
    readings,
    as_of,
    interval,
    owner=None,
    owners=None,
    display_tz=DISPLAY_TZ,
    consistent_time=False,
    scale=None,
    rounding="half_up",
    per_meter=False,
    method="within",
):
    """Energy per bucket of the current hour, day, month, year, or of all years; resets pass through as negatives."""
    X.require_utc(readings)
    interval = X.resolve_interval(interval)
    span = X.full_period_span(X.as_local(as_of, display_tz), interval)

    def finish(used):
        return F.coalesce(R.rounded(used, 6, rounding), F.lit(0.0))

    options = _register_options(display_tz, consistent_time, scale, per_meter, method, owner, owners)
    return _register_by_bucket(readings, span, interval, finish, "energy", consistent_time, options)


def _gauge(readings, span, interval, columns, digits, owner, display_tz, consistent_time, scale, rounding):
    names = list(columns)
    wanted = F.col("value_name") == names[0] if len(names) == 1 else F.col("value_name").isin(*names)
    rows = (
        O.of_owner(readings, owner)
        .filter(wanted & X.in_span(readings, span, wall=consistent_time))
        .select(
            "owner_name",
            X.bucket_of(X.local_seconds(display_tz, consistent_time), interval).alias("bucket"),
            "value_name",
            "value",
        )
    )
    means = G.bucket_means(rows, columns, digits, scale, rounding)
    return means.select("owner_name", X.label_of(F.col("bucket"), interval).alias("time"), *columns.values())


def voltage_stats(
    readings,
    as_of,
    interval,
    owner=None,
    display_tz=DISPLAY_TZ,
    consistent_time=False,
    scale=None,
    rounding="half_up",
):
    """Mean voltage per phase over the rolling range; later readings than `as_of` are included."""
    X.require_utc(readings)
    interval = X.resolve_interval(interval)
    span = X.rolling_span(X.as_local(as_of, display_tz), interval)
    columns = {phase: phase for phase in PHASE_VOLTAGES}
    return _gauge(readings, span, interval, columns, 2, owner, display_tz, consistent_time, scale, rounding)


def current_stats(
    readings,
    as_of,
    interval,
    owner=None,
    display_tz=DISPLAY_TZ,
    consistent_time=False,
    scale=None,
    rounding="half_up",
):
    """Mean current per phase in the current period."""
    X.require_utc(readings)
    interval = X.resolve_interval(interval)
    span = X.full_period_span(X.as_local(as_of, display_tz), interval)
    columns = {phase: f"a{number}" for number, phase in enumerate(PHASE_CURRENTS, 1)}
    return _gauge(readings, span, interval, columns, 2, owner, display_tz, consistent_time, scale, rounding)


def power_factor(
    readings,
    as_of,
    interval,
    owner=None,
    display_tz=DISPLAY_TZ,
    consistent_time=False,
    scale=None,
    rounding="half_up",
):
    """Mean power factor in the current period."""
    X.require_utc(readings)
    interval = X.resolve_interval(interval)
    span = X.full_period_span(X.as_local(as_of, display_tz), interval)
    columns = {POWER_FACTOR: "power_factor"}
    return _gauge(readings, span, interval, columns, 3, owner, display_tz, consistent_time, scale, rounding)


def frequency(
    readings,
    as_of,
    interval,
    owner=None,
    display_tz=DISPLAY_TZ,
    consistent_time=False,
    scale=None,
    rounding="half_up",
):
    """Mean frequency in the current period."""
    X.require_utc(readings)
    interval = X.resolve_interval(interval)
    span = X.full_period_span(X.as_local(as_of, display_tz), interval)
    columns = {FREQUENCY: "frequency"}
    return _gauge(readings, span, interval, columns, 2, owner, display_tz, consistent_time, scale, rounding)
