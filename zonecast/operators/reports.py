"""Report tables: demand summaries, error bands and slices, zone map."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.functions.accuracy import merged, metric_columns
from zonecast.functions.clock import day_text, to_local
from zonecast.functions.quantiles import exact_quantiles
from zonecast.functions.tables import count_true
from zonecast.operators.contracts import check_rows
from zonecast.operators.scores import error_cube
from zonecast.settings import BAND_PROBABILITIES

REPORT_DIMENSIONS = ("zone_id", "borough", "local_hour", "weekday", "rush_hour", "demand_band")


def daily_totals(panel: DataFrame) -> DataFrame:
    return panel.groupBy(day_text(to_local(F.col("hour"))).alias("date_nyc")).agg(
        F.sum("demand").alias("demand")
    )


def hourly_profile(panel: DataFrame) -> DataFrame:
    """Mean demand per zone by weekday or weekend and local hour."""
    local = to_local(F.col("hour"))
    return panel.groupBy(
        (F.weekday(local) >= 5).cast("int").alias("weekend"), F.hour(local).alias("local_hour")
    ).agg(F.avg("demand").alias("mean_demand"))


def zone_totals(panel: DataFrame) -> DataFrame:
    return (
        panel.groupBy("zone_id", "Zone", "borough")
        .agg(F.sum("demand").alias("pickups"))
        .orderBy(F.desc("pickups"), "zone_id")
    )


def top_zones(panel: DataFrame, k: int = 15) -> DataFrame:
    """The busiest zones, ties by id."""
    return zone_totals(panel).limit(k)


def error_columns(predictions: DataFrame, model: str) -> DataFrame:
    miss = F.col(model) - F.col("demand")
    return predictions.withColumns({"absolute_error": F.abs(miss), "residual": miss})


def band_edges(train: DataFrame, probabilities=BAND_PROBABILITIES) -> DataFrame:
    """Distinct training quantiles of demand as one row ``edges``; at most one per probability."""
    found = exact_quantiles(train, [], "demand", probabilities)
    return found.agg(F.array_sort(F.collect_set("quantile")).alias("edges"))


def demand_bands(rows: DataFrame, train: DataFrame, probabilities=BAND_PROBABILITIES) -> DataFrame:
    """Adds ``demand_band``: right-closed bins between training quantiles, outer edges open.

    The edges are a handful of numbers, read once as job parameters.
    """
    edges = band_edges(train, probabilities).first()["edges"]
    if len(edges) < 2:
        raise ValueError("Demand bands need at least two distinct training quantiles")
    return rows.withColumn("demand_band", band_label(F.col("demand"), edges))


def band_label(value, edges: list[float]):
    """``(low, high]`` label; the first and last edge count as infinite."""
    texts = ["-inf", *[str(float(e)) for e in edges[1:-1]], "inf"]
    label = F.lit(f"({texts[-2]}, {texts[-1]}]")
    for i in range(len(edges) - 2, 0, -1):
        label = F.when(value <= edges[i], F.lit(f"({texts[i - 1]}, {texts[i]}]")).otherwise(label)
    return F.when(value.isNotNull(), label)


def error_slices(predictions: DataFrame, model: str, dimensions=REPORT_DIMENSIONS) -> DataFrame:
    """Metrics of one model by each dimension; cells of all dimensions are summed first."""
    dimensions = list(dimensions)
    cube = error_cube(predictions, [model], dimensions)
    sums = [c for c in cube.columns if c not in dimensions]
    text = cube.select(*sums, *[F.col(d).cast("string").alias(d) for d in dimensions])
    long = text.unpivot(sums, dimensions, "dimension", "value")
    return merged(long, ["dimension", "value"]).select("dimension", "value", "rows", *metric_columns())


def zone_map_table(panel: DataFrame, predictions: DataFrame, model: str) -> DataFrame:
    """Mean demand and MAE per zone; ``check_zone_map`` reports unmatched zones."""
    demand = panel.groupBy("zone_id").agg(F.avg("demand").alias("mean_pickups"))
    errors = predictions.groupBy("zone_id").agg(
        F.avg(F.abs(F.col(model) - F.col("demand"))).alias("mae")
    )
    return demand.join(errors, "zone_id", "full_outer").select("zone_id", "mean_pickups", "mae")


def check_zone_map(zone_map: DataFrame, zones: DataFrame) -> DataFrame:
    joined = zones.select("zone_id").join(zone_map, "zone_id", "left")
    totals = joined.agg(
        count_true(F.col("mean_pickups").isNull()).alias("zone_without_demand"),
        count_true(F.col("mae").isNull()).alias("zone_without_errors"),
    )
    return check_rows(totals, totals.columns)
