"""One response document per owner."""

from pyspark.sql import functions as F


def documents(result, interval, time="time", owners=None):
    """`{owner_name, interval, data: [{time, ...}]}`, data in time order.

    An owner's list holds one entry per bucket of the result, so its size is that of the result's calendar; a question
    without an upper bound in time gives as many entries as there are buckets. With a table of `owners`, each of them
    gets a document, with empty data if the result has nothing of theirs.
    """
    if owners is not None:
        result = result.withColumn("_held", F.lit(True)).unionByName(owners.select("owner_name").distinct(), allowMissingColumns=True)
    entry = F.struct(time, *(name for name in result.columns if name not in ("owner_name", time, "_held")))
    if owners is not None:
        entry = F.when(F.col("_held"), entry)  # collect_list leaves nulls out
    return result.groupBy("owner_name").agg(F.sort_array(F.collect_list(entry)).alias("data")).select(
        "owner_name", F.lit(interval).alias("interval"), "data"
    )


def as_json(docs):
    """The documents as JSON text, nulls written out."""
    return docs.select(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).alias("value"))


def in_time_order(result):
    """Sort by owner and label; labels sort like the times they stand for. For the edge only."""
    return result.orderBy("owner_name", "time")
