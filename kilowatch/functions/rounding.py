"""Means, differences and rounding.

Meters report fixed decimals. With `scale` given, values are counted in units of 10^-scale as 64-bit integers, so sums
do not depend on the order of the rows and ties round the same way everywhere. Without it, differences are of doubles as
they are, and means add the decimal digits of the values, exactly up to the twelfth, so they don't depend on the order of
the rows either. Only a group with a value that such a decimal can't hold (NaN, infinite, of 10^16 or more) is added up in
doubles.
"""

from pyspark.sql import functions as F

ROUNDINGS = {"half_up": F.round, "even": F.bround}


def rounded(column, digits, rounding="half_up"):
    if rounding not in ROUNDINGS:
        raise ValueError(f"unknown rounding: {rounding!r}")
    return ROUNDINGS[rounding](column, digits).cast("double")


#: Holds a value's digits; sums of up to 10^10 of them have 38 digits.
DIGITS = "decimal(28,12)"


def exact_sums(column):
    """Aggregates a mean without `scale` is made of; those of parts add up."""
    exact = column.try_cast(DIGITS)
    odd = F.count(column) - F.count(exact)
    return {"n": F.count(column), "sum": F.coalesce(F.sum(exact), F.lit(0).cast("decimal(38,12)")), "odd": odd, "doubles": F.sum(column)}


def mean_of(sums, digits, rounding="half_up"):
    """Rounded mean from the aggregates of `exact_sums`, null without values."""
    exact = F.try_divide(sums["sum"], sums["n"].cast("decimal(20,0)"))
    doubles = F.try_divide(sums["doubles"], sums["n"])
    return F.when(sums["odd"] > 0, rounded(doubles, digits, rounding)).otherwise(rounded(exact, digits, rounding))


def units(column, scale):
    """Null for what cannot be counted, such as NaN."""
    return F.rint(column * F.lit(float(10**scale))).try_cast("bigint")


def mean(column, digits, scale=None, rounding="half_up"):
    """Rounded mean of a group; nulls do not count, a group without values gives null."""
    if scale is None:
        return mean_of(exact_sums(column), digits, rounding)
    counted = units(column, scale)
    total = F.sum(counted).cast("decimal(20,0)")
    divisor = (F.count(counted) * F.lit(10**scale)).cast("decimal(20,0)")
    return rounded(F.try_divide(total, divisor), digits, rounding)


def difference(last, first, scale=None):
    """last - first: a double, or exact decimal when the scale is known."""
    if scale is None:
        return last - first
    step = F.lit(10**scale).cast("decimal(10,0)")
    return ((units(last, scale) - units(first, scale)).cast("decimal(20,0)") / step).cast(f"decimal(24,{scale})")


def factor(number, scale=None):
    """A constant multiplier in the arithmetic of `difference`."""
    return F.lit(number if scale is not None else float(number))
