"""Headline queries, timed one by one; prints a single JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

import json
import os
import time

from pyspark.sql import functions as F

from zonecast import bindings as b
from zonecast import catalog
from zonecast.catalog.scores import sensitivity
from zonecast.session import build_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "monthly_quality",
    "hourly_counts",
    "prepare_panel",
    "exact_duplicates",
    "reporting_volume_flags",
    "lags",
    "rolling_means",
    "delayed_features",
    "lagged_peers",
    "describe_features",
    "walk_forward",
    "delay_study",
    "slice_scores",
    "daily_scores",
    "delay_scenarios",
    "weather_bundle",
    "boundary_pairs",
    "forecast_misses",
    "error_slices",
)


def bootstrap_10000(spark, sf):
    """The full-size bootstrap: 10,000 replicates for three block lengths."""
    return sensitivity(spark, sf, 10_000)


def run(frame):
    """Compute every column of every row and keep nothing."""
    frame.write.format("noop").mode("overwrite").save()


def main():
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    cases = {name: catalog.QUERIES[name] for name in HEADLINE} | {"bootstrap_10000": bootstrap_10000}
    # One small untimed query starts the JVM's compilers and the file system client.
    run(b.table(spark, SF, "events").groupBy("event_type").agg(F.count("*")))
    seconds = {}
    for name, case in cases.items():
        started = time.perf_counter()
        run(case(spark, SF))
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_seconds_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
