"""Gap filling: every owner gets every slot of the calendar.

An owner's buckets, at most one per slot, are folded into a map; the slots are a literal sequence exploded per owner and
looked up there. Empty slots therefore arise after the last shuffle, there is no calendar table to broadcast and no cross
join, and buckets outside the slots fall away.
"""

from pyspark.sql import functions as F

from kilowatch.functions import timeaxis as X


def filled(buckets, measure, first, last, interval, shown=None, carried=()):
    """(owner_name, bucket, measure) for all slots from `first` to `last`, null where there is no bucket.

    `first` and `last` are columns in local seconds; `first` may refer to the aggregates in `carried`. Owners without
    any bucket appear when the table `shown` lists them.
    """
    entries = buckets.withColumn("entry", F.when(F.col(measure).isNotNull(), F.struct("bucket", measure)))
    if shown is not None:
        entries = entries.unionByName(shown.select("owner_name"), allowMissingColumns=True)
    folded = entries.groupBy("owner_name").agg(
        F.map_from_entries(F.collect_list("entry")).alias("found"), *carried
    )
    slots = F.when(first <= last, X.slot_sequence(first, last, interval))
    return folded.select("owner_name", "found", F.explode(slots).alias("bucket")).select(
        "owner_name", "bucket", F.try_element_at("found", F.col("bucket")).alias(measure)
    )
