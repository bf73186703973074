"""Queries of sources, contracts, panel preparation and the quality audit."""

from pyspark.sql import functions as F

from zonecast import bindings as b
from zonecast.catalog.registry import query
from zonecast.functions.clock import hour_floor, hours
from zonecast.operators import audit, contracts, panel
from zonecast.operators.folds import utc_midnight
from zonecast.plans.quality import label_sensitivity
from zonecast.session import new_path
from zonecast.sources import tables as sources

KEPT = b.REGIONS[:4]
NARROW = ("2024-02-25 00:00:00", "2024-03-15 00:00:00")
VOLUME_RULE = {"min_reference": 2, "fraction": 0.5}


def eligible(spark, sf):
    return panel.eligible_trips(b.trips(spark, sf), b.zones(spark, sf), b.START, b.STOP)


def local_counts(spark, sf):
    return panel.hourly_counts(b.trips(spark, sf), b.zones(spark, sf), b.START, b.STOP)


def utc_counts(spark, sf):
    return panel.utc_counts(local_counts(spark, sf))


def all_counts(spark, sf):
    """Counts of every pickup zone, listed or not, on the unconverted clock."""
    return (
        b.trips(spark, sf)
        .groupBy(
            F.col("PULocationID").alias("zone_id"),
            hour_floor(F.col("tpep_pickup_datetime")).alias("hour"),
        )
        .agg(F.count(F.lit(1)).alias("demand"))
    )


def repeated(spark, sf):
    kept = panel.eligible_trips(b.doubled_trips(spark, sf), b.zones(spark, sf), b.START, b.STOP)
    return audit.exact_duplicates(kept)


def doubled_counts(spark, sf):
    return panel.utc_counts(panel.hourly_counts(b.doubled_trips(spark, sf), b.zones(spark, sf), b.START, b.STOP))


def rollup(spark, sf):
    return audit.duplicate_rollup(repeated(spark, sf))


def vendor_hours(spark, sf):
    return audit.vendor_counts(eligible(spark, sf))


def volumes(spark, sf):
    city = audit.city_totals(b.panel(spark, sf))
    return audit.series_grid(vendor_hours(spark, sf), city, b.START, b.STOP)


def flags(spark, sf):
    return audit.reporting_volume_flags(volumes(spark, sf), **VOLUME_RULE)


def alternative(spark, sf):
    return audit.dedup_panel(b.doubled_panel(spark, sf), rollup(spark, sf))


@query
def read_trips(spark, sf):
    """Written files of two schemas, read back as one table."""
    return sources.read_trips(spark, *b.trip_files(spark, sf).values())


@query
def trips_of_months(spark, sf):
    return sources.trips_of_months(b.trips(spark, sf), "2024-03", "2024-03")


@query
def check_trip_schema(spark, sf):
    paths = [*b.trip_files(spark, sf).values(), b.faulty_trip_file(spark, sf)]
    found = contracts.check_file_schemas(spark, sources.path_schemas(spark, paths))
    return found.withColumn("file", F.element_at(F.split("file", "/"), -1))


@query
def write_panel(spark, sf):
    """The panel written by month and read back in a window that ends inside the second month."""
    path = new_path(spark, "panel")
    sources.write_panel(b.panel(spark, sf), path)
    return sources.read_window(spark, path, "2024-02-25 05:00:00", "2024-03-15 04:00:00")


@query
def write_report_tables(spark, sf):
    """The quality report and the zone lookup as CSV and Parquet, read back and joined by nothing: one row per table row."""
    report, path = panel.monthly_quality(b.trips(spark, sf), b.zones(spark, sf)), new_path(spark, "report")
    sources.write_report_table(report, f"{path}/quality")
    sources.write_table(b.zones(spark, sf), f"{path}/zones")
    quality = spark.read.csv(f"{path}/quality", schema=report.schema, header=True, mode="FAILFAST", enforceSchema=False)
    zones = spark.read.parquet(f"{path}/zones")
    per_zone = zones.select(F.lit("zones").alias("report"), F.col("Zone").alias("key"), F.col("zone_id").cast("long").alias("value"))
    counts = [name for name in report.columns if name != "month"]
    per_month = quality.unpivot("month", counts, "column", "value").select(
        F.lit("quality").alias("report"), F.concat_ws(" ", "month", "column").alias("key"), F.col("value").cast("long").alias("value")
    )
    return per_month.unionByName(per_zone)


@query
def write_run_record(spark, sf):
    """The panel's summary as one JSON record, read back."""
    record, path = panel.panel_summary(b.panel(spark, sf)), new_path(spark, "record")
    sources.write_run_record(record, path)
    return spark.read.json(path, schema=record.schema, mode="FAILFAST")


@query
def load_zones(spark, sf):
    return sources.load_zones(b.lookup(spark, sf), KEPT)


@query
def read_window(spark, sf):
    events = b.table(spark, sf, "events")
    return sources.window_of(events, "2024-01-10 05:00:00", "2024-01-20 05:00:00", "ts").select(
        "event_id", "ts", "user_id"
    )


@query
def check_zones(spark, sf):
    return contracts.check_zones(b.lookup(spark, sf), KEPT, (1, 1000))


@query
def months(spark, sf):
    bounds = b.table(spark, sf, "orders").agg(
        F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end")
    )
    return panel.months(bounds)


@query
def check_panel(spark, sf):
    return contracts.check_panel(utc_counts(spark, sf), (2, 60))


@query
def check_complete_window(spark, sf):
    first, last = "2024-02-26 05:00:00", "2024-03-01 05:00:00"
    part = sources.window_of(utc_counts(spark, sf), first, last)
    return contracts.check_complete_window(part, b.zones(spark, sf), first, last)


@query
def check_counts(spark, sf):
    return contracts.check_counts(all_counts(spark, sf), b.zones(spark, sf), *NARROW)


@query
def check_volume_series(spark, sf):
    return contracts.check_volume_series(
        vendor_hours(spark, sf).withColumnRenamed("vendor", "series")
    )


@query
def reconcile_tables(spark, sf):
    columns = ["zone_id", "hour", "demand"]
    return contracts.reconcile_tables(b.doubled_panel(spark, sf), alternative(spark, sf), columns)


@query
def table_fingerprint(spark, sf):
    return contracts.table_fingerprint(b.panel(spark, sf), ["zone_id", "hour", "demand"])


@query
def check_keys(spark, sf):
    grid = panel.zone_grid_hours(b.zones(spark, sf), b.START, b.SEALED)
    return contracts.check_keys(utc_counts(spark, sf), grid, ["zone_id", "hour"])


@query
def check_conservation(spark, sf):
    return contracts.check_conservation(local_counts(spark, sf), b.panel(spark, sf))


@query
def monthly_quality(spark, sf):
    return panel.monthly_quality(b.trips(spark, sf), b.zones(spark, sf))


@query
def eligible_trips(spark, sf):
    return eligible(spark, sf)


@query
def hourly_counts(spark, sf):
    return local_counts(spark, sf)


@query
def local_to_utc(spark, sf):
    return panel.local_to_utc(b.local_hours(spark, sf))


@query
def dst_dropped(spark, sf):
    quality = panel.monthly_quality(b.trips(spark, sf), b.zones(spark, sf))
    return panel.dst_dropped(local_counts(spark, sf), quality)


@query
def hour_spine(spark, sf):
    """UTC hours from the first order date to the last."""
    first, last = b.order_days(spark, sf).agg(F.min("day").cast("string"), F.max("day").cast("string")).first()
    return panel.hour_spine(spark, first, last)


@query
def month_spines(spark, sf):
    """Every order date that is a first of a month starts one spine; repeated hours are counted."""
    starts = b.order_days(spark, sf).groupBy(F.trunc("day", "month").alias("first")).agg(
        F.count(F.lit(1)).alias("days")
    )
    first = F.col("first").cast("timestamp_ntz")
    stepped = panel.with_spine(starts, first, F.add_months("first", 1).cast("timestamp_ntz"))
    local = panel.to_local(F.col("hour"))
    return stepped.groupBy("first").agg(
        F.count(F.lit(1)).alias("utc_hours"), F.countDistinct(local).alias("local_hours")
    ).select(F.col("first").cast("string").alias("month_start"), "utc_hours", "local_hours")


@query
def densify(spark, sf):
    return panel.densify(utc_counts(spark, sf), b.zones(spark, sf), b.START, b.STOP)


@query
def attach_zone(spark, sf):
    return panel.attach_zone(utc_counts(spark, sf), b.zones(spark, sf))


@query
def panel_summary(spark, sf):
    return panel.panel_summary(b.panel(spark, sf))


@query
def prepare_panel(spark, sf):
    return b.panel(spark, sf)


@query
def development_range(spark, sf):
    return audit.development_range(b.trips(spark, sf), b.START, "2024-03-01")


@query
def exact_duplicates(spark, sf):
    return repeated(spark, sf)


@query
def duplicate_rollup(spark, sf):
    return rollup(spark, sf)


@query
def vendor_counts(spark, sf):
    return vendor_hours(spark, sf)


@query
def city_totals(spark, sf):
    return audit.city_totals(b.panel(spark, sf))


@query
def series_grid(spark, sf):
    return volumes(spark, sf)


@query
def reporting_volume_flags(spark, sf):
    return flags(spark, sf)


@query
def flagged_hours(spark, sf):
    return audit.flagged_hours(flags(spark, sf))


@query
def dedup_panel(spark, sf):
    return alternative(spark, sf)


@query
def duplicates_by_month(spark, sf):
    return audit.duplicates_by_month(doubled_counts(spark, sf), rollup(spark, sf))


@query
def duplicates_by_zone(spark, sf):
    return audit.duplicates_by_zone(alternative(spark, sf))


@query
def series_summary(spark, sf):
    return audit.series_summary(flags(spark, sf))


@query
def duplicate_share(spark, sf):
    return audit.duplicate_share(alternative(spark, sf))


@query
def baseline_sensitivity(spark, sf):
    recorded = b.doubled_panel(spark, sf)
    return label_sensitivity(
        recorded, alternative(spark, sf), b.START, b.BOUNDARIES[2], b.SEALED
    )


DEV_START, DEV_STOP = utc_midnight(b.START), utc_midnight(b.SEALED)
