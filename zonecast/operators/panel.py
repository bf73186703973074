"""Raw trips to a dense zone x hour panel."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.functions.clock import (
    hour_floor,
    hour_index,
    hours,
    instant,
    is_hour,
    month_text,
    resolved,
    strict_utc,
    to_local,
    to_utc,
)
from zonecast.functions.tables import add_up, count_true
from zonecast.operators.contracts import check_rows
from zonecast.settings import TIMEZONE

PICKUP, DROPOFF, ZONE = "tpep_pickup_datetime", "tpep_dropoff_datetime", "PULocationID"


def months(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Inclusive months between two date columns as ``month``; a reversed range is an error."""
    low, high = F.trunc(F.col(start), "month"), F.trunc(F.col(end), "month")
    steps = F.when(low <= high, F.sequence(low, high, F.expr("interval 1 month"))).otherwise(
        F.raise_error(F.lit("Month range is reversed"))
    )
    return bounds.select(F.explode(steps).alias("first")).select(
        F.substring(F.col("first").cast("string"), 1, 7).alias("month")
    )


def monthly_quality(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Overlapping quality flags per file month in one scan. Comparisons with NULL do not count.

    Flags are counted per month and zone first, so the lookup meets a few aggregated rows and
    never the raw trips.
    """
    pickup = F.col(PICKUP)
    flags = {
        "raw_rows": F.lit(True),
        "null_pickups": pickup.isNull(),
        "outside_file_month": month_text(pickup) != F.col("file_month"),
        "missing_passenger_count": F.col("passenger_count").isNull(),
        "nonpositive_distance": F.col("trip_distance") <= 0,
        "negative_fare": F.col("fare_amount") < 0,
        "nonpositive_duration": F.col(DROPOFF) <= pickup,
    }
    by_zone = trips.groupBy(F.col("file_month").alias("month"), F.col(ZONE).alias("zone_id")).agg(
        *[count_true(rule).alias(name) for name, rule in flags.items()]
    )
    listed = zones.select("zone_id").distinct().withColumn("listed", F.lit(True))
    unlisted = F.when(F.col("listed").isNull(), F.col("raw_rows")).otherwise(0)
    sums = {name: F.sum(name) for name in flags} | {"non_nyc_or_invalid_zone": F.sum(unlisted)}
    order = list(flags)[:3] + ["non_nyc_or_invalid_zone"] + list(flags)[3:]
    return (
        by_zone.join(listed, "zone_id", "left")
        .groupBy("month")
        .agg(*[sums[name].alias(name) for name in order])
    )


def in_window(trips: DataFrame, start, stop) -> DataFrame:
    """Pickups inside ``[start, stop)`` (local) and inside their file month."""
    pickup = F.col(PICKUP)
    inside = trips.where((pickup >= instant(start)) & (pickup < instant(stop)))
    if "file_month" in trips.columns:
        inside = inside.where(month_text(pickup) == F.col("file_month"))
    return inside


def eligible_trips(trips: DataFrame, zones: DataFrame, start, stop) -> DataFrame:
    """Pickups of the window in a listed zone. Fare and distance never filter.

    Spark broadcasts a lookup below its own threshold and shuffles the join beyond it.
    """
    keys = zones.select(F.col("zone_id").alias(ZONE))
    return in_window(trips, start, stop).join(keys, ZONE, "left_semi").select(*trips.columns)


def hourly_counts(trips: DataFrame, zones: DataFrame, start, stop) -> DataFrame:
    """Eligible pickups per zone and local hour.

    Trips are counted before they meet the lookup: the scan feeds partial counts and nothing
    else is shuffled, whatever share of the trips one zone holds.
    """
    counted = (
        in_window(trips, start, stop)
        .groupBy(F.col(ZONE).cast("int").alias("zone_id"), hour_floor(F.col(PICKUP)).alias("hour"))
        .agg(F.count(F.lit(1)).alias("demand"))
    )
    return counted.join(zones.select("zone_id"), "zone_id", "left_semi").select(
        "zone_id", "hour", "demand"
    )


def local_to_utc(frame: DataFrame, column: str = "hour", zone: str = TIMEZONE) -> DataFrame:
    """Adds ``utc``; NULL for a skipped or repeated local hour."""
    return frame.withColumn("utc", strict_utc(F.col(column), zone))


def utc_counts(counts: DataFrame) -> DataFrame:
    """Resolvable counts on the UTC clock."""
    return resolved(counts)


def dst_dropped(counts: DataFrame, quality: DataFrame) -> DataFrame:
    """Per month: pickups lost to unresolvable hours, accepted and excluded pickups."""
    by_month = local_to_utc(counts).groupBy(month_text(F.col("hour")).alias("month")).agg(
        add_up(F.when(F.col("utc").isNull(), F.col("demand")).otherwise(0)).alias("lost"),
        add_up(F.when(F.col("utc").isNotNull(), F.col("demand")).otherwise(0)).alias("kept"),
    )
    zero = F.lit(0).cast("bigint")
    return quality.select("month", "raw_rows").join(by_month, "month", "left").select(
        "month",
        F.coalesce("lost", zero).alias("unresolvable_dst_pickups"),
        F.coalesce("kept", zero).alias("accepted_pickups"),
        (F.col("raw_rows") - F.coalesce("kept", zero)).alias("excluded_pickups"),
    )


def with_spine(frame: DataFrame, start, stop, name: str = "hour", local: bool = True) -> DataFrame:
    """Each input row once per UTC hour of ``[start, stop)``, by explode instead of a join.

    Bounds are local midnights, or UTC hours with ``local=False``. Days are exploded first, hours second, so no row holds a long
    array for a long history.
    """
    begin, end = instant(start), instant(stop)
    if local:
        begin, end = to_utc(begin), to_utc(end)
    day = F.expr("interval 1 day")
    last = end - hours(1)
    by_day = frame.withColumn("_day", F.explode(F.sequence(begin, last, day)))
    stretch = F.sequence(F.col("_day"), F.least(F.col("_day") + hours(23), last), F.expr("interval 1 hour"))
    return by_day.withColumn(name, F.explode(stretch)).drop("_day")


def hour_spine(spark: SparkSession, start, stop) -> DataFrame:
    """UTC hours between two local midnights."""
    return with_spine(spark.range(1), start, stop).select("hour")


def check_spine(spine: DataFrame, zone: str = TIMEZONE) -> DataFrame:
    """A span holding a repeated local hour cannot be zero-filled; it must be refused."""
    local = to_local(F.col("hour"), zone)
    grouped = spine.groupBy(local.alias("local")).agg(F.count(F.lit(1)).alias("n"))
    totals = grouped.agg(
        add_up(F.col("n") - 1).alias("repeated_local_hour"),
        add_up((~is_hour(F.col("local"))).cast("int")).alias("misaligned_bound"),
        (F.count(F.lit(1)) == 0).cast("bigint").alias("empty_span"),
    )
    return check_rows(totals, totals.columns)


def zone_grid_hours(zones: DataFrame, start, stop) -> DataFrame:
    """All zones at all hours."""
    return with_spine(zones.select("zone_id"), start, stop)


def filled(counts: DataFrame, zones: DataFrame, start, stop, attributes: list[str]) -> DataFrame:
    """Grid rows with 0 and count rows, added up per key.

    What is shuffled is one row per key and day of the grid, and the counts. Both meet per day, and only what comes out has a
    row per hour, so no task ever holds the hours of all zones, however few files the zones are read from.
    """
    keys = ["zone_id", *attributes]
    begin, end = to_utc(instant(start)), to_utc(instant(stop))
    last = end - hours(1)
    at = begin + hours(F.floor((hour_index(F.col("hour")) - hour_index(begin)) / 24) * 24)
    days = F.explode(F.sequence(begin, last, F.expr("interval 1 day"))).alias("_day")
    empty = zones.select(*keys, days).select(
        *keys, "_day", F.lit(True).alias("_asked"), F.lit(None).cast("timestamp_ntz").alias("hour"), F.lit(None).cast("bigint").alias("demand")
    )
    seen = counts.select(*keys, at.alias("_day"), F.lit(False).alias("_asked"), "hour", F.col("demand").cast("bigint").alias("demand"))
    cells = empty.unionByName(seen).repartition(*keys, "_day").groupBy(*keys, "_day", "_asked", "hour").agg(F.sum("demand").alias("demand"))
    by_day = cells.groupBy(*keys, "_day").agg(
        F.max("_asked").alias("_asked"), F.collect_list(F.when(~F.col("_asked"), F.struct("hour", "demand"))).alias("_seen")
    )
    stretch = F.sequence(F.col("_day"), F.least(F.col("_day") + hours(23), last), F.expr("interval 1 hour"))
    grid = F.when(F.col("_asked"), stretch).otherwise(F.array().cast("array<timestamp_ntz>"))
    # A key without a known demand counts 0 where the grid has it, as beside a row of 0.
    known = F.filter("_seen", lambda x: x["demand"].isNotNull() | ~F.coalesce(F.array_contains(F.col("_grid"), x["hour"]), F.lit(False)))
    zeros = F.transform(
        F.array_except("_grid", "_seen.hour"), lambda h: F.struct(h.alias("hour"), F.lit(0).cast("bigint").alias("demand"))
    )
    return (
        by_day.withColumn("_grid", grid)
        .withColumn("_seen", known)
        .select(*keys, F.inline(F.concat("_seen", zeros)))
        .select("zone_id", "hour", F.col("demand").cast("int").alias("demand"), *attributes)
    )


def densify(counts: DataFrame, zones: DataFrame, start, stop) -> DataFrame:
    """Zero-filled ``zone_id, hour, demand``.

    Run ``check_counts`` first: a count outside the grid must be an error, here it would
    stay a row of its own and break ``check_conservation``.
    """
    return filled(counts, zones, start, stop, [])


def attach_zone(frame: DataFrame, zones: DataFrame) -> DataFrame:
    """Many-to-one zone attributes; zones must be unique (``check_zones``)."""
    return frame.join(zones.select("zone_id", "borough", "Zone"), "zone_id", "left")


def prepare_panel(trips: DataFrame, zones: DataFrame, start, stop) -> DataFrame:
    """Trips to ``zone_id, hour, demand, borough, Zone`` for all months in one scan.

    Attributes join the sparse counts, not the dense panel, and travel as grouping keys.
    """
    counts = attach_zone(utc_counts(hourly_counts(trips, zones, start, stop)), zones)
    return filled(counts, zones, start, stop, ["borough", "Zone"])


def panel_summary(panel: DataFrame) -> DataFrame:
    """Rows, zones, hours, total and zero share. Distinct counts combine before the shuffle."""
    return panel.agg(
        F.count(F.lit(1)).alias("panel_rows"),
        F.countDistinct("zone_id").alias("nyc_zones"),
        F.countDistinct("hour").alias("utc_hours"),
        F.sum("demand").alias("total_pickups"),
        F.avg((F.col("demand") == 0).cast("double")).alias("zero_demand_fraction"),
    )


def hours_between(start, stop):
    return hour_index(to_utc(instant(stop))) - hour_index(to_utc(instant(start)))
