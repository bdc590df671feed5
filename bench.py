"""Times the registered meter queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line.

Every query is timed from building its plan to its last row, in a session as `prepare` leaves it: once to warm up and then
again, or only once if that took `LONG` seconds, as some streaming jobs do. `value` sums the headline queries, so that rounds compare; `queries` has all of them.
"""

import json
import os
import time

from kilowatch.catalogue.registry import queries
from kilowatch.session import local_session

HEADLINE = (
    "owners_ordered range_consumption energy_stats_to_date earliest_by_owner "
    "voltage_min voltage_hr voltage_day voltage_month voltage_year "
    "ghg_min ghg_hr ghg_day ghg_month ghg_year ghg_hr_compat "
    "energy_min energy_hr energy_day energy_month energy_year energy_day_lag energy_day_per_meter "
    "power_factor_hr power_factor_day power_factor_year "
    "current_hr current_day current_year "
    "frequency_hr frequency_day frequency_year "
    "flatten_readings wide_params props_explode minute_filter minute_latest dead_letters "
    "offset_ranges retention response_documents"
).split()

LONG = 15


def seconds(query, spark, sf_dir):
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(
        os.environ.get("BENCH_CPUS", "8"),
        "kilowatch-bench",
        spark__ui__showConsoleProgress="false",
    )
    found, times = queries(), {}
    for name in [*HEADLINE, *sorted(set(found) - set(HEADLINE))]:
        first = seconds(found[name], spark, sf_dir)
        times[name] = round(first if first > LONG else seconds(found[name], spark, sf_dir), 4)
    total = round(sum(times[name] for name in HEADLINE), 4)
    scale = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
