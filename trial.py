"""Larger trials: $TRIAL_ROWS readings (10 million unless set) of which a third are one owner's, stored in many batches.

Prints one JSON line of seconds per question over the stored table. The readings are made by Spark, row by row.
"""

import json
import os
import time

from pyspark.sql import functions as F

from kilowatch.plans import queries as Q
from kilowatch.session import local_session, shared_folder
from kilowatch.sources import tables
from kilowatch.vocabulary import REGISTER

AS_OF = "2024-01-20 12:34:56"
ROWS = int(os.environ.get("TRIAL_ROWS", "10000000"))
BATCHES = int(os.environ.get("TRIAL_BATCHES", "20"))


def made(spark, rows):
    number = F.col("id")
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod(number * 7919, F.lit(30 * 86400)))
    return spark.range(rows).select(
        F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("time"),
        at.alias("event_time"),
        F.to_date(at).alias("reading_date"),
        *(F.lit(part).alias(part) for part in ("company_name", "building_name", "floor_name", "S0", "L0")),
        F.when(number % 3 == 0, F.lit("11")).otherwise(F.concat(F.lit("o"), number % 5000)).alias("owner_name"),
        F.when(number % 2 == 0, F.lit(REGISTER)).otherwise(F.lit("frequency")).alias("value_name"),
        (F.unix_seconds(at) % 100000 + F.rand(7)).alias("value"),
    )


def main():
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "kilowatch-trial", spark__ui__showConsoleProgress="false")
    path, times = shared_folder(spark, "trial"), {}
    start = time.perf_counter()
    for batch in range(BATCHES):
        tables.write_batch(made(spark, ROWS // BATCHES), path, "trial", batch)
    times["write"] = round(time.perf_counter() - start, 2)
    readings, owners = tables.read_readings(spark, path), tables.read_owners(spark, path)
    asked = {
        "energy_day": lambda: Q.energy_consumption(readings, AS_OF, "day", owners=owners),
        "energy_hr": lambda: Q.energy_consumption(readings, AS_OF, "hr", owners=owners),
        "energy_stats": lambda: Q.energy_stats(readings, AS_OF, owners=owners),
        "frequency_day": lambda: Q.frequency(readings, AS_OF, "day"),
    }
    for name, question in asked.items():
        for _ in range(2):
            start = time.perf_counter()
            question().write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 2)
    print(json.dumps({"rows": ROWS, "batches": BATCHES, "seconds": times}))
    spark.stop()


if __name__ == "__main__":
    main()
