"""Station files to saved observations, snapshots, coverage tables and bundles."""

from pyspark.sql import SparkSession

from zonecast.operators import weather as steps
from zonecast.operators.contracts import check_observations, check_snapshots, require, stack
from zonecast.settings import DELAYS
from zonecast.sources import tables as sources


def weather_job(
    spark: SparkSession,
    paths: list[str],
    stations: dict[str, tuple[str, float, float]],
    start,
    stop,
    out: str,
    delays=DELAYS,
    max_age_hours: int = 6,
    bundle_delays=(3, 6),
) -> None:
    """``stations`` maps an alias to ``(id, latitude, longitude)``; bounds are UTC hours."""
    texts = [t.strftime("%Y-%m-%dT%H:%M:%S") for t in (start, stop)]
    raw = sources.read_station_files(spark, paths, *texts)
    require(steps.check_station(raw, {i: (la, lo) for i, la, lo in stations.values()}, *texts))
    parsed = steps.parse_observations(raw, *texts)
    sources.write_table(steps.core_rows(parsed), f"{out}/observations")
    sources.write_report_table(steps.quality_flag_counts(parsed), f"{out}/quality_flags")
    seen = spark.read.parquet(f"{out}/observations")
    require(check_observations(seen))
    sources.write_report_table(
        steps.native_coverage(raw, seen, start, stop), f"{out}/native_coverage"
    )
    sources.write_table(
        steps.delay_scenarios(seen, start, stop, delays, max_age_hours), f"{out}/snapshots"
    )
    snapshots = spark.read.parquet(f"{out}/snapshots")
    ids = {alias: place[0] for alias, place in stations.items()}
    targets = steps.target_grid(seen, start, stop, (0,)).select("hour").distinct()
    require(stack(*[check_snapshots(snapshots, list(ids.values()), targets, d) for d in bundle_delays]))
    sources.write_report_table(
        steps.availability_coverage(snapshots), f"{out}/availability_coverage"
    )
    chosen = snapshots.where(snapshots.delay_hours.isin(*bundle_delays))
    sources.write_table(steps.weather_bundle(chosen, ids, ["delay_hours"]), f"{out}/bundles")
    summary = steps.bundle_summary(
        spark.read.parquet(f"{out}/bundles"), steps.bundle_features(ids)
    )
    sources.write_report_table(summary, f"{out}/bundle_summary")
