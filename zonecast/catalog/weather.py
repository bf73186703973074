"""Queries of station observations, snapshots and bundles."""

from pyspark.sql import functions as F

from zonecast import bindings as b
from zonecast.catalog.panel import DEV_START, DEV_STOP
from zonecast.catalog.registry import query
from zonecast.catalog.study import assigned, report
from zonecast.operators import contracts, models, weather
from zonecast.sources.tables import project_station_rows
from zonecast.settings import WEATHER_VALUES

TEXT = "%Y-%m-%dT%H:%M:%S"
START_TEXT, STOP_TEXT = DEV_START.strftime(TEXT), DEV_STOP.strftime(TEXT)
BUNDLE_DELAYS = (1, 3)
FEATURES = weather.bundle_features(b.STATIONS)


def parsed(spark, sf):
    return weather.parse_observations(b.raw_weather(spark, sf), START_TEXT, STOP_TEXT)


def observations(spark, sf):
    return weather.core_rows(parsed(spark, sf))


def snapshots(spark, sf, delays=weather.DELAYS):
    return weather.delay_scenarios(
        observations(spark, sf), DEV_START, DEV_STOP, delays, b.MAX_AGE_HOURS
    )


def bundles(spark, sf, delays=BUNDLE_DELAYS):
    return weather.weather_bundle(snapshots(spark, sf, delays), b.STATIONS, ["delay_hours"])


def targets(spark, sf):
    return weather.target_grid(observations(spark, sf), DEV_START, DEV_STOP, (0,)).select("hour").distinct()


@query
def read_station_files(spark, sf):
    return project_station_rows(b.raw_weather(spark, sf), "2024-02-25T05:00:00", "2024-03-05T05:00:00")


@query
def parse_observations(spark, sf):
    return parsed(spark, sf).select(
        "station_id", "observed_at", "temperature", "dew_point_temperature", "wind_speed", "precipitation"
    )


@query
def check_station(spark, sf):
    """Only two stations are known and the tolerance is tight, so both rules find rows."""
    known = {name: place for name, place in b.COORDINATES.items() if name != "view"}
    return weather.check_station(b.raw_weather(spark, sf), known, START_TEXT, STOP_TEXT, 0.004)


@query
def quality_good(spark, sf):
    return weather.quality_good(parsed(spark, sf))


@query
def quality_unverified(spark, sf):
    return weather.quality_unverified(parsed(spark, sf))


@query
def quality_status(spark, sf):
    return weather.quality_status(parsed(spark, sf))


@query
def core_rows(spark, sf):
    return observations(spark, sf)


@query
def quality_flag_counts(spark, sf):
    return weather.quality_flag_counts(parsed(spark, sf))


@query
def check_observations(spark, sf):
    """Times cut to the minute, so that some repeat."""
    rows = observations(spark, sf).withColumn(
        "observed_at", F.substring(F.col("observed_at").cast("string"), 1, 16).cast("timestamp_ntz")
    )
    return contracts.check_observations(rows)


@query
def asof_snapshot(spark, sf):
    return weather.asof_snapshot(
        observations(spark, sf).select("station_id", "observed_at", *WEATHER_VALUES),
        DEV_START,
        DEV_STOP,
        (1,),
        b.MAX_AGE_HOURS,
    )


@query
def delay_scenarios(spark, sf):
    return snapshots(spark, sf)


@query
def snapshot_quality(spark, sf):
    return snapshots(spark, sf, (3,)).select(
        "station_id", "hour", *[f"{v}_{k}" for v in WEATHER_VALUES for k in ("quality", "source")]
    )


@query
def check_snapshots(spark, sf):
    """Contract of the wrong delay's rows: the three hour rows relabelled as one hour rows."""
    named = list(b.STATIONS.values())
    rows = snapshots(spark, sf, (3,)).where(F.col("station_id").isin(named)).withColumn("delay_hours", F.lit(1))
    return contracts.check_snapshots(rows, named, targets(spark, sf), 1)


@query
def native_coverage(spark, sf):
    raw = project_station_rows(b.raw_weather(spark, sf), START_TEXT, STOP_TEXT)
    return weather.native_coverage(raw, observations(spark, sf), DEV_START, DEV_STOP)


@query
def longest_missing_run(spark, sf):
    flagged = snapshots(spark, sf, (1, 3)).select(
        "station_id", "delay_hours", "hour", F.col("temperature_c").isNotNull().alias("present")
    )
    return weather.longest_missing_run(flagged, ["station_id", "delay_hours"])


@query
def availability_coverage(spark, sf):
    return weather.availability_coverage(snapshots(spark, sf))


@query
def weather_bundle(spark, sf):
    return bundles(spark, sf)


@query
def bundle_summary(spark, sf):
    return weather.bundle_summary(bundles(spark, sf), FEATURES)


@query
def append_weather(spark, sf):
    rows = assigned(spark, sf).where("role = 'validation'").select("zone_id", "hour", "demand")
    one = bundles(spark, sf, (3,)).drop("delay_hours")
    return weather.append_weather(rows, one)


@query
def check_append(spark, sf):
    """A bundle that starts a week late loses rows."""
    late = bundles(spark, sf, (3,)).drop("delay_hours").where(
        F.col("hour") >= F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    )
    return contracts.check_append(assigned(spark, sf).select("zone_id", "hour", "demand"), late, FEATURES)


@query
def weather_preflight(spark, sf):
    return weather.weather_preflight(assigned(spark, sf), bundles(spark, sf), FEATURES, BUNDLE_DELAYS)


@query
def verify_asof(spark, sf):
    """Rows on which two formulations of the as-of choice differ, per side."""
    seen = observations(spark, sf).select("station_id", "observed_at", *WEATHER_VALUES)
    grid = weather.target_grid(seen, DEV_START, DEV_STOP, weather.DELAYS)
    fast = weather.asof_snapshot(seen, DEV_START, DEV_STOP, weather.DELAYS, b.MAX_AGE_HOURS)
    slow = weather.asof_any_target(seen, grid, b.MAX_AGE_HOURS)
    return contracts.reconcile_tables(fast, slow, fast.columns)


@query
def asof_any_target(spark, sf):
    """The latest click reading before every order-like event: targets are not whole hours."""
    seen = observations(spark, sf).select("station_id", "observed_at", *WEATHER_VALUES)
    moved = F.col("ts") + F.make_dt_interval(F.lit(b.SHIFT_DAYS))
    asked = b.table(spark, sf, "events").where(F.col("event_type") == "purchase").select(
        F.lit("click").alias("station_id"), moved.alias("hour"), F.lit(1).alias("delay_hours")
    )
    return weather.asof_any_target(seen, asked, b.MAX_AGE_HOURS)


@query
def weather_models(spark, sf):
    """Temporal features with and without the bundle, for both delays, on all folds."""
    parts = []
    for delay in BUNDLE_DELAYS:
        joined = weather.append_weather(assigned(spark, sf), bundles(spark, sf, (delay,)).drop("delay_hours"))
        parts.append(report(joined, models.bundle_fits({f"temporal_{delay}h": [], f"weather_{delay}h": FEATURES})))
    return parts[0].unionByName(parts[1])
