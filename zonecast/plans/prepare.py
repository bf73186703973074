"""Raw trip files to a saved panel and its quality report."""

from pyspark.sql import SparkSession

from zonecast.operators import panel as steps
from zonecast.operators.contracts import (
    check_conservation,
    check_counts,
    check_trip_schema,
    check_zones,
    require,
    stack,
)
from zonecast.operators.folds import utc_midnight
from zonecast.settings import BOROUGHS
from zonecast.sources import tables as sources


def prepare(
    spark: SparkSession, trip_paths, zones_path: str, start: str, stop: str, out: str, boroughs=BOROUGHS
) -> None:
    """Writes ``zones``, ``panel``, ``quality`` and ``summary`` under ``out``; bounds are local midnights.

    The sparse counts are saved first: the checks, the panel and the report then read a small
    table instead of the raw trips again.
    """
    lookup = sources.read_zones_csv(spark, zones_path)
    require(check_zones(lookup, boroughs))
    zones = sources.load_zones(lookup, boroughs)
    sources.write_table(zones, f"{out}/zones")
    trips = sources.read_trips(spark, *trip_paths)
    check_trip_schema(trips)
    sources.write_table(steps.hourly_counts(trips, zones, start, stop), f"{out}/local_counts")
    sources.write_report_table(steps.monthly_quality(trips, zones), f"{out}/quality")
    local = spark.read.parquet(f"{out}/local_counts")
    counts = steps.utc_counts(local)
    require(
        stack(
            steps.check_spine(steps.hour_spine(spark, start, stop)),
            check_counts(counts, zones, utc_midnight(start), utc_midnight(stop)),
        )
    )
    dense = steps.filled(steps.attach_zone(counts, zones), zones, start, stop, ["borough", "Zone"])
    sources.write_panel(dense, f"{out}/panel")
    saved = spark.read.parquet(f"{out}/panel")
    require(check_conservation(counts, saved))
    sources.write_run_record(steps.panel_summary(saved), f"{out}/summary")
