"""Aggregates of structs."""

from pyspark.sql import functions as F


def hashed(aggregate):
    """The aggregate, computed without sorting the rows by group.

    With a collection among its functions Spark keeps the groups of an aggregation in a hash table of objects, and falls
    back to sorting only when a task meets very many of them; minima and maxima of structs or text alone would make it
    sort all rows first. The collection here is always empty, and the result refers to it so that it is not optimised
    away. One such aggregate in a grouping is enough.
    """
    nothing = F.collect_set(F.lit(None).cast("int"))
    return F.when(F.size(nothing) == 0, aggregate)
