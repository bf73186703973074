"""Queries of reports, analyst questions and exports."""

from pyspark.sql import functions as F

from zonecast import bindings as b
from zonecast.catalog.registry import query
from zonecast.catalog.study import development, predictions
from zonecast.functions.clock import to_local
from zonecast.operators import contracts, explorer, folds, reports
from zonecast.sources import tables as sources

# The last 48 hours of the last fold.
WINDOW = ("2024-03-16 04:00:00", "2024-03-18 04:00:00")
MODELS = ["previous_hour", "zone_hour_average", "previous_week_168h"]
COLUMNS = ["demand", *MODELS]


def window(spark, sf):
    rows = explorer.demo_window(predictions(spark, sf), *WINDOW, fold="fold_3")
    return rows.join(b.zones(spark, sf).select("zone_id", "Zone"), "zone_id", "left")


def long(spark, sf):
    return explorer.long_rows(window(spark, sf), MODELS)


def banded(spark, sf):
    split = folds.chronological_split(development(spark, sf), b.START, b.BOUNDARIES[2], b.SEALED)
    rows = predictions(spark, sf).withColumn("weekday", F.weekday(to_local(F.col("hour"))))
    return reports.demand_bands(rows, split.where("role = 'train'"))


def nested(spark, sf):
    return sources.export_nested(window(spark, sf), COLUMNS)


@query
def daily_totals(spark, sf):
    return reports.daily_totals(development(spark, sf))


@query
def hourly_profile(spark, sf):
    return reports.hourly_profile(development(spark, sf))


@query
def zone_totals(spark, sf):
    return reports.zone_totals(development(spark, sf))


@query
def top_zones(spark, sf):
    return reports.top_zones(development(spark, sf))


@query
def error_columns(spark, sf):
    return reports.error_columns(predictions(spark, sf), "zone_hour_average").select(
        "zone_id", "hour", "fold", "absolute_error", "residual"
    )


@query
def demand_bands(spark, sf):
    return banded(spark, sf).select("zone_id", "hour", "demand", "demand_band")


@query
def error_slices(spark, sf):
    return reports.error_slices(banded(spark, sf), "zone_hour_average")


@query
def zone_map_table(spark, sf):
    return reports.zone_map_table(development(spark, sf), predictions(spark, sf), "zone_hour_average")


@query
def demo_window(spark, sf):
    return explorer.demo_window(predictions(spark, sf), *WINDOW, fold="fold_3").select(
        "zone_id", "hour", *COLUMNS
    )


@query
def borough_summary(spark, sf):
    names = {"temporal_mae": MODELS[0], "borough_context_mae": MODELS[1], "weekly_mae": MODELS[2]}
    return explorer.borough_summary(window(spark, sf), names)


@query
def zone_search(spark, sf):
    return explorer.zone_search(b.square_zones(spark, sf), "ASIA", "  CUSTOMER#0000000 ")


@query
def zone_search_by_id(spark, sf):
    return explorer.zone_search(b.square_zones(spark, sf), explorer.ALL_BOROUGHS, " 0042 ")


@query
def hour_summary(spark, sf):
    return explorer.hour_summary(long(spark, sf))


@query
def one_hour_summary(spark, sf):
    return explorer.one_hour_summary(long(spark, sf), "2024-03-17 13:00:00", "ASIA", MODELS[1])


@query
def borough_comparison(spark, sf):
    return explorer.borough_comparison(long(spark, sf))


@query
def forecast_misses(spark, sf):
    return explorer.forecast_misses(long(spark, sf))


@query
def zone_model_errors(spark, sf):
    return explorer.zone_model_errors(long(spark, sf))


@query
def zone_daily_summaries(spark, sf):
    return explorer.zone_daily_summaries(long(spark, sf))


@query
def zone_largest_miss(spark, sf):
    return explorer.zone_largest_miss(long(spark, sf))


@query
def export_rows(spark, sf):
    return explorer.export_rows(window(spark, sf), MODELS, "study-1", "two days, local time")


@query
def map_intensity(spark, sf):
    return explorer.map_intensity(long(spark, sf))


@query
def zone_trace(spark, sf):
    return explorer.zone_trace(long(spark, sf))


@query
def export_nested(spark, sf):
    """The nested cells as text in millionths, which both engines print alike."""
    cells = F.transform(
        "values",
        lambda row: F.array_join(
            F.transform(row, lambda v: F.round(v * 1000000).cast("bigint").cast("string")), ","
        ),
    )
    return nested(spark, sf).select("hour", F.array_join(cells, ";").alias("cells"))


@query
def check_export(spark, sf):
    """Against all suppliers plus one hour too many, so the hour rule finds a gap."""
    return contracts.check_export(nested(spark, sf), b.zones(spark, sf), len(COLUMNS), 49)


@query
def export_csv_quoted(spark, sf):
    rows = explorer.export_rows(window(spark, sf), MODELS, "study-1", 'a "quoted", scope')
    whole = rows.withColumn("zone_name", F.concat("zone_name", F.lit(","), F.col("borough")))
    shown = ["study_id", "scope", "time_utc", "zone_id", "zone_name", "borough", "model", "recorded_pickups"]
    return sources.export_csv_quoted(whole, shown)
