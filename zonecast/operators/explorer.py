"""Analyst questions on saved forecasts.

Input rows are ``zone_id, Zone, borough, hour, demand`` and one column per model; ``long_rows``
turns them into one row per model. Every question is answered for all hours, zones and models at
once; filter the result for one of them and Spark pushes the filter down.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecast.functions.clock import day_text, instant, to_local
from zonecast.functions.tables import long_models
from zonecast.sources.tables import window_of

ALL_BOROUGHS = "All boroughs"


def demo_window(predictions: DataFrame, start, stop, fold: str | None = None) -> DataFrame:
    """A slice of consecutive hours of one fold."""
    rows = predictions if fold is None else predictions.where(F.col("fold") == fold)
    return window_of(rows, start, stop)


def long_rows(rows: DataFrame, models: list[str]) -> DataFrame:
    keep = [c for c in ("zone_id", "Zone", "borough", "hour") if c in rows.columns]
    return long_models(rows, models, [*keep, "demand"]).select(
        *keep,
        "model",
        F.col("demand").cast("double").alias("actual"),
        F.col("prediction").alias("forecast"),
        (F.col("prediction") - F.col("demand")).alias("error"),
    )


def borough_summary(rows: DataFrame, models: dict[str, str]) -> DataFrame:
    """Zone-hours, pickups and one MAE column per model; ``models`` maps output name to column."""
    return (
        rows.groupBy("borough")
        .agg(
            F.count(F.lit(1)).alias("zone_hours"),
            F.sum("demand").cast("bigint").alias("recorded_pickups"),
            *[F.avg(F.abs(F.col("demand") - F.col(c))).alias(n) for n, c in models.items()],
        )
        .orderBy(F.desc("recorded_pickups"))
    )


def zone_search(zones: DataFrame, borough: str, query: str) -> DataFrame:
    """Zones of a borough by exact id (digits) or by part of the name, sorted by name."""
    term = " ".join(query.split()).lower()
    hit = (
        F.col("zone_id").cast("decimal(38,0)") == F.lit(term).cast("decimal(38,0)")
        if term.isdecimal() and term.isascii()
        else F.contains(F.regexp_replace(F.lower(F.col("Zone")), r"\s+", " "), F.lit(term))
    )
    scope = F.lit(True) if borough == ALL_BOROUGHS else F.col("borough") == borough
    return zones.where(scope & hit).select("zone_id", "Zone", "borough").orderBy("Zone")


def hour_summary(long: DataFrame) -> DataFrame:
    """Actual, forecast and MAE per hour and model over the given rows."""
    return long.groupBy("hour", "model").agg(
        F.sum("actual").alias("actual"),
        F.sum("forecast").alias("forecast"),
        F.avg(F.abs("error")).alias("mae"),
    )


def one_hour_summary(long: DataFrame, hour, borough: str, model: str) -> DataFrame:
    """The summary of one hour, borough and model: always one row, zeros without data."""
    mine = long.where((F.col("hour") == instant(hour)) & (F.col("model") == model))
    if borough != ALL_BOROUGHS:
        mine = mine.where(F.col("borough") == borough)
    return mine.agg(
        F.coalesce(F.sum("actual"), F.lit(0.0)).alias("actual"),
        F.coalesce(F.sum("forecast"), F.lit(0.0)).alias("forecast"),
        F.coalesce(F.avg(F.abs("error")), F.lit(0.0)).alias("mae"),
    )


def borough_comparison(long: DataFrame) -> DataFrame:
    """``hour_summary`` per borough with zones and total absolute error, worst MAE first."""
    return (
        long.groupBy("hour", "model", "borough")
        .agg(
            F.count(F.lit(1)).alias("zones"),
            F.sum("actual").alias("actual"),
            F.sum("forecast").alias("forecast"),
            F.avg(F.abs("error")).alias("mae"),
            F.sum(F.abs("error")).alias("absolute_error"),
        )
        .orderBy("hour", "model", F.desc("mae"), "borough")
    )


def forecast_misses(long: DataFrame, k: int = 5) -> DataFrame:
    """The largest misses per hour and model, ties by zone id.

    Spark keeps only the best ``k`` rows per group and task before the shuffle.
    """
    order = Window.partitionBy("hour", "model").orderBy(F.desc(F.abs("error")), "zone_id")
    return (
        long.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("hour", "model", "zone_id", "actual", "forecast", "error", "rank")
    )


def zone_model_errors(long: DataFrame) -> DataFrame:
    return long.groupBy("zone_id", "model").agg(
        F.avg(F.abs("error")).alias("mae"), F.avg("error").alias("mean_error")
    )


def zone_daily_summaries(long: DataFrame) -> DataFrame:
    return long.groupBy("zone_id", "model", day_text(to_local(F.col("hour"))).alias("day")).agg(
        F.count(F.lit(1)).alias("hours"),
        F.sum("actual").alias("actual"),
        F.sum("forecast").alias("forecast"),
        F.avg(F.abs("error")).alias("mae"),
    )


def zone_largest_miss(long: DataFrame) -> DataFrame:
    """Hour of the largest absolute error per zone and model, the earliest on ties.

    A plain aggregation: ties are settled by the size first and the reversed time second.
    """
    worst = long.groupBy("zone_id", "model").agg(
        F.min_by(F.struct("hour", "error"), F.struct((-F.abs("error")).alias("size"), F.col("hour"))).alias("w")
    )
    return worst.select("zone_id", "model", "w.hour", "w.error")


def export_rows(rows: DataFrame, models: list[str], study_id: str, scope: str) -> DataFrame:
    """The eleven export columns, unrounded."""
    long = long_rows(rows, models)
    utc = F.concat(F.replace(F.substring(F.col("hour").cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit(".000Z"))
    return long.select(
        F.lit(study_id).alias("study_id"),
        F.lit(scope).alias("scope"),
        utc.alias("time_utc"),
        "zone_id",
        F.col("Zone").alias("zone_name"),
        "borough",
        "model",
        F.col("actual").cast("bigint").alias("recorded_pickups"),
        F.col("forecast").alias("estimate"),
        F.col("error").alias("error_estimate_minus_recorded"),
        F.abs("error").alias("absolute_error"),
    )


def map_intensity(long: DataFrame, borough: str | None = None) -> DataFrame:
    """Demand and absolute error per zone and hour on a square-root scale of the hour's maximum.

    The maximum is that of the zones shown: of ``borough``, or of all. Maxima are aggregated and joined
    back, so no task holds a whole hour.
    """
    if borough is not None:
        long = long.where(F.col("borough") == borough)
    measures = F.array(
        F.struct(F.lit("demand").alias("measure"), F.col("actual").alias("level")),
        F.struct(F.lit("absolute_error").alias("measure"), F.abs("error").alias("level")),
    )
    levels = long.select("hour", "zone_id", "model", F.inline(measures))
    peaks = levels.groupBy("hour", "model", "measure").agg(F.max("level").alias("peak"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("level"), F.col("peak"))))
    return levels.join(peaks, ["hour", "model", "measure"]).select(
        "hour",
        "zone_id",
        "model",
        "measure",
        F.when(F.col("peak") > 0, F.sqrt(share)).otherwise(F.lit(0.0)).alias("intensity"),
    )


def zone_trace(long: DataFrame) -> DataFrame:
    """Hourly actual and forecast per zone and model with their common peak, at least 1."""
    peaks = long.groupBy("zone_id", "model").agg(
        F.greatest(F.lit(1.0), F.max(F.greatest("actual", "forecast"))).alias("peak")
    )
    return long.join(peaks, ["zone_id", "model"]).select(
        "zone_id", "hour", "model", "actual", "forecast", "peak"
    )
