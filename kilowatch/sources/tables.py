"""The readings table: Parquet folders by date, and below by writer and batch.

A batch that is written again replaces its own folders, so a retry neither loses nor repeats rows. Files are clustered by
measure and owner: statistics then skip most of a file for a query on one measure.
"""

from datetime import date, timedelta

from pyspark.sql import functions as F, types as T

from kilowatch.schema import READINGS

FOLDERS = ("reading_date", "writer", "batch_id")
CLUSTERED_BY = (*FOLDERS, "value_name", "owner_name", "event_time")
LAYOUT = T.StructType(
    [
        *READINGS.fields,
        T.StructField("writer", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def batch_folder(path, writer, batch_id):
    """Where a batch of anything but readings goes."""
    return f"{path.rstrip('/')}/writer={writer}/batch_id={int(batch_id)}"


def owners_path(path):
    """The list of owners beside the readings; names with an underscore are no part of the readings table."""
    return f"{path.rstrip('/')}/_owners"


def read_owners(spark, path):
    """All owners of a stored table, for `owners=` of the gap-filled queries: a few rows a batch instead of a scan of all
    readings."""
    return spark.read.schema("owner_name STRING").parquet(owners_path(path)).distinct()


def write_batch(readings, path, writer, batch_id):
    """Write one batch of readings and its owners. Written again, both are replaced.

    The rebalance hint gathers a date's rows into files of the advisory size, and adaptive execution splits a date that
    holds most of the batch.
    """
    (
        readings.select(*READINGS.fieldNames())
        .hint("rebalance", "reading_date")
        .withColumns({"writer": F.lit(writer), "batch_id": F.lit(int(batch_id)).cast("bigint")})
        .sortWithinPartitions(*CLUSTERED_BY)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*FOLDERS)
        .parquet(path)
    )
    owners = readings.select("owner_name").distinct().coalesce(1)
    owners.write.mode("overwrite").parquet(batch_folder(owners_path(path), writer, batch_id))


def read_readings(spark, path, first_day=None, last_day=None):
    """The table, in the stored layout. Its schema is known, so no file is opened to infer it.

    Queries prune dates by themselves, after all folders were listed. With `first_day` and `last_day` given, other days
    are not even listed, which matters once years of batches have piled up.
    """
    reader = spark.read.schema(LAYOUT)
    where = path.rstrip("/")
    if first_day and last_day:
        count = (last_day - first_day).days + 1
        days = ",".join(str(first_day + timedelta(days=place)) for place in range(count))
        reader = reader.option("basePath", where)
        where = f"{where}/reading_date={{{days}}}"
    return reader.parquet(where).select(*READINGS.fieldNames())


def compact_days(spark, path, target, first_day, last_day):
    """Write the readings of closed days, from however many batches, to the table `target` in files of the advisory size.

    Nothing is deleted from `path`, and run again for the same days it replaces what it wrote. Days without any folder may
    be among them, but not only those.
    """
    days = read_readings(spark, path, first_day, last_day)
    write_batch(days, target, "compacted", (first_day - date(1970, 1, 1)).days)


def read_with_compacted(spark, path, target, closed_until, last_day):
    """Readings of both tables: days up to `closed_until` from the compacted one, later ones up to `last_day` from `path`.

    Of `path` only the folders of the open days are listed, however many batches the closed ones had.
    """
    closed = read_readings(spark, target).filter(F.col("reading_date") <= F.lit(closed_until))
    return closed.unionByName(read_readings(spark, path, closed_until + timedelta(days=1), last_day))
