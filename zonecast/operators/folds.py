"""Chronological splits, expanding folds and cohorts. Intervals are half-open."""

from datetime import datetime
from typing import NamedTuple
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecast.functions.clock import hours, instant, is_hour, to_utc
from zonecast.functions.tables import count_true
from zonecast.operators.contracts import check_rows
from zonecast.settings import SPARSE_ZONE_MEAN_MAX, TIMEZONE, WARMUP_HOURS


class Fold(NamedTuple):
    """Naive UTC instants."""

    name: str
    train_start: datetime
    validation_start: datetime
    validation_end: datetime


def utc_midnight(day: str, zone: str = TIMEZONE) -> datetime:
    """UTC instant of a local midnight, for job parameters."""
    local = datetime.fromisoformat(day).replace(tzinfo=ZoneInfo(zone))
    return local.astimezone(ZoneInfo("UTC")).replace(tzinfo=None)


def local_boundary(days: DataFrame, column: str = "day", zone: str = TIMEZONE) -> DataFrame:
    """Adds ``utc``: the instant of each local midnight."""
    return days.withColumn("utc", to_utc(F.col(column), zone))


def study_folds(train_start: str, boundaries, sealed: str) -> list[Fold]:
    """Fold parameters of a study; rejects unordered or sealed boundaries."""
    days = [train_start, *boundaries]
    if len(boundaries) < 2 or days != sorted(set(days)) or boundaries[-1] > sealed:
        raise ValueError("Fold boundaries must increase strictly and end before the sealed test")
    start = utc_midnight(train_start)
    cuts = [utc_midnight(day) for day in boundaries]
    return [Fold(f"fold_{i}", start, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]), 1)]


def expanding_folds(boundaries: DataFrame, train_start, sealed) -> DataFrame:
    """Fold table from a table of local ``boundary`` days (a few hundred rows at most).

    The last boundary only ends the last fold.
    """
    order = Window.partitionBy(F.lit(1)).orderBy("boundary")
    return boundaries.select(
        F.concat(F.lit("fold_"), F.row_number().over(order).cast("string")).alias("name"),
        to_utc(instant(train_start)).alias("train_start"),
        to_utc(F.col("boundary")).alias("validation_start"),
        to_utc(F.lead("boundary").over(order)).alias("validation_end"),
    ).where(F.col("validation_end").isNotNull() & (F.col("validation_end") <= to_utc(instant(sealed))))


def check_folds(folds: DataFrame, sealed) -> DataFrame:
    start, end = F.col("validation_start"), F.col("validation_end")
    totals = folds.agg(
        (F.count(F.lit(1)) == 0).cast("bigint").alias("no_folds"),
        count_true(F.col("train_start") >= start).alias("no_training"),
        count_true(start >= end).alias("unordered"),
        count_true(end > to_utc(instant(sealed))).alias("sealed"),
        count_true(~is_hour(start) | ~is_hour(end)).alias("misaligned"),
    )
    return check_rows(totals, totals.columns)


def chronological_split(frame: DataFrame, train_start, validation_start, test_start) -> DataFrame:
    """Rows with ``role`` train or validation; test rows are never returned. Local midnights."""
    a, b, c = (utc_midnight(d) for d in (train_start, validation_start, test_start))
    if not a < b < c:
        raise ValueError("Chronological boundaries must increase strictly")
    kept = frame.where((F.col("hour") >= instant(a)) & (F.col("hour") < instant(c)))
    return kept.withColumn(
        "role", F.when(F.col("hour") < instant(b), F.lit("train")).otherwise(F.lit("validation"))
    )


def assign_folds(
    features: DataFrame, folds: list[Fold], warmup_hours: int = WARMUP_HOURS, embargo_hours: int = 0
) -> DataFrame:
    """Each row once per fold it belongs to, with ``fold`` and ``role``.

    Folds are job parameters, so rows are matched to them in place: no join and no shuffle, and
    rows outside all folds disappear before anything else happens.
    """
    hour = F.col("hour")
    roles = []
    for fold in folds:
        first = instant(fold.train_start) + hours(warmup_hours)
        last = instant(fold.validation_start) - hours(embargo_hours)
        training = (hour >= first) & (hour < last)
        validation = (hour >= instant(fold.validation_start)) & (hour < instant(fold.validation_end))
        role = F.when(training, F.lit("train")).when(validation, F.lit("validation"))
        roles.append(F.struct(F.lit(fold.name).alias("fold"), role.alias("role")))
    span = (hour >= instant(min(f.train_start for f in folds))) & (
        hour < instant(max(f.validation_end for f in folds))
    )
    mine = F.filter(F.array(*roles), lambda r: r["role"].isNotNull())
    return features.where(span).select(*features.columns, F.inline(mine))


def zone_keys(assigned: DataFrame) -> list[str]:
    """Fold and zone; the borough rides along, so that training means and validation rows need
    the same columns and Spark shuffles the panel once for both."""
    return ["fold", "zone_id", *[c for c in ("borough",) if c in assigned.columns]]


def zone_means(assigned: DataFrame) -> DataFrame:
    """Training mean per fold and zone, and the 24 local-hour means as a map."""
    keys = zone_keys(assigned)
    by_hour = (
        assigned.where(F.col("role") == "train")
        .groupBy(*keys, "local_hour")
        .agg(F.sum("demand").alias("s"), F.count("demand").alias("n"))
    )
    entries = F.collect_list(F.struct("local_hour", (F.col("s") / F.col("n")).alias("m")))
    return by_hour.groupBy(*keys).agg(
        (F.sum("s") / F.sum("n")).alias("zone_mean"), F.map_from_entries(entries).alias("hour_means")
    )


def cohort_of(mean, sparse_max: float):
    return F.when(mean <= sparse_max, F.lit("sparse")).otherwise(F.lit("dense"))


def zone_cohort(assigned: DataFrame, sparse_max: float = SPARSE_ZONE_MEAN_MAX) -> DataFrame:
    """Sparse or dense per fold and zone, from training rows only."""
    means = (
        assigned.where(F.col("role") == "train")
        .groupBy("fold", "zone_id")
        .agg(F.avg("demand").alias("mean"))
    )
    return means.select("fold", "zone_id", cohort_of(F.col("mean"), sparse_max).alias("zone_cohort"))


def target_cohort(frame: DataFrame) -> DataFrame:
    kind = F.when(F.col("demand") == 0, F.lit("zero")).otherwise(F.lit("positive"))
    return frame.withColumn("target_cohort", kind)


def check_label_availability(assigned: DataFrame, folds: list[Fold], delay_hours: int) -> DataFrame:
    """Per fold: 1 when the last training label arrives after the forecast origin."""
    origin = F.coalesce(
        *[F.when(F.col("fold") == f.name, instant(f.validation_start)) for f in folds]
    )
    last = (
        assigned.where(F.col("role") == "train").groupBy("fold").agg(F.max("hour").alias("last_target"))
    )
    arrives = F.col("last_target") + hours(1 + delay_hours)
    return last.select(
        "fold",
        F.lit("label_available").alias("check"),
        (arrives > origin).cast("bigint").alias("bad_rows"),
        arrives.alias("available_at"),
    )
