"""Owners: who is there, in which order, since when."""

from pyspark.sql import functions as F

from kilowatch.vocabulary import OWNER_ORDER


def display_name(owner="owner_name"):
    return F.coalesce(F.col(owner).cast("string"), F.lit("None"))


def display_rank(owner):
    """Place in the display order; owners it does not list share the place after the last."""
    place = F.array_position(F.array(*(F.lit(name) for name in OWNER_ORDER)), owner)
    return F.when(place > 0, place).otherwise(F.lit(len(OWNER_ORDER) + 1)).cast("int")


def distinct_owners(readings):
    return readings.select("owner_name").distinct()


def roster(readings, owner=None, owners=None):
    """The owners a dense result has to show: one given name, a given table, or all that have readings."""
    if owner is not None:
        return readings.sparkSession.range(0, 1, 1, 1).select(F.lit(owner).alias("owner_name"))
    if owners is not None:
        return owners.select("owner_name").distinct()
    return distinct_owners(readings)


def of_owner(readings, owner=None):
    if owner == "":
        raise ValueError("owner is empty")
    return readings if owner is None else readings.filter(F.col("owner_name") == owner)


def ordered_owners(readings):
    """Owners and their place in the display order, which is a sort key, not a row number: no task sees all owners."""
    names = distinct_owners(readings).select(display_name().alias("owner_name")).distinct()
    return names.select("owner_name", display_rank(F.col("owner_name")).alias("position"))


def earliest(readings, *measures):
    """Time of the first reading per owner, of the given measures or of any."""
    rows = readings.filter(F.col("value_name").isin(*measures)) if measures else readings
    return rows.groupBy("owner_name").agg(F.min("event_time").alias("earliest"))
