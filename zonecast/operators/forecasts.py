"""Baseline forecasts, walk-forward tables and the next-hour batch score."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.functions.clock import hours, instant
from zonecast.operators.contracts import table_fingerprint
from zonecast.operators.folds import Fold, assign_folds, cohort_of, target_cohort, zone_keys, zone_means
from zonecast.session import cut_lineage
from zonecast.operators.temporal import (
    cyclic,
    delayed_features,
    drop_warmup,
    future_target_rows,
    local_calendar,
    make_features,
)
from zonecast.settings import (
    BASELINES,
    DELAYS,
    SPARSE_ZONE_MEAN_MAX,
    STUDY_EMBARGO_HOURS,
    STUDY_WARMUP_HOURS,
    WARMUP_HOURS,
)

KEYS = ["zone_id", "hour", "demand", "borough", "local_hour", "weekend", "rush_hour", "fold"]
COHORTS = ["zone_cohort", "target_cohort"]


def baseline_lags(features: DataFrame, latest_name: str = "previous_hour") -> DataFrame:
    """Last value, same hour yesterday and a week ago. Under a delay the first is the latest
    available value and is named so."""
    return features.withColumns(
        {
            latest_name: F.col("lag_1").cast("double"),
            "previous_day_24h": F.col("lag_24").cast("double"),
            "previous_week_168h": F.col("lag_168").cast("double"),
        }
    )


def rolling_baseline(features: DataFrame) -> DataFrame:
    return features.withColumn("rolling_mean_24h", F.col("rolling_mean_24"))


def with_zone_means(assigned: DataFrame, sparse_max: float) -> DataFrame:
    """Validation rows with ``zone_hour_average`` and ``zone_cohort``.

    The training side is at most fold x zone rows after aggregation; one join serves both.
    The average stays NULL for a zone without training rows, which ``check_scores_input`` reports.
    """
    valid = assigned.where(F.col("role") == "validation")
    joined = valid.join(zone_means(assigned), zone_keys(assigned), "left")
    hourly = F.try_element_at("hour_means", F.col("local_hour"))
    return joined.withColumns(
        {
            "zone_hour_average": F.coalesce(hourly, F.col("zone_mean")),
            "zone_cohort": cohort_of(F.col("zone_mean"), sparse_max),
        }
    ).drop("zone_mean", "hour_means")


def zone_hour_average(
    features: DataFrame, folds: list[Fold], warmup_hours: int = WARMUP_HOURS, embargo_hours: int = 0
) -> DataFrame:
    """Training mean of the zone at the local hour, else of the zone."""
    assigned = assign_folds(features, folds, warmup_hours, embargo_hours)
    return with_zone_means(assigned, SPARSE_ZONE_MEAN_MAX).select(
        "fold", "zone_id", "hour", "zone_hour_average"
    )


def clip_predictions(frame: DataFrame, column: str = "prediction") -> DataFrame:
    return frame.withColumn(column, F.greatest(F.lit(0.0), F.col(column).cast("double")))


def baseline_table(
    features: DataFrame,
    folds: list[Fold],
    warmup_hours: int = WARMUP_HOURS,
    embargo_hours: int = 0,
    sparse_max: float = SPARSE_ZONE_MEAN_MAX,
    latest_name: str = "previous_hour",
    keep=(),
) -> DataFrame:
    """Validation rows of all folds with cohorts and one column per baseline."""
    assigned = assign_folds(drop_warmup(features), folds, warmup_hours, embargo_hours)
    rows = target_cohort(with_zone_means(assigned, sparse_max))
    rows = rolling_baseline(baseline_lags(rows, latest_name))
    names = [latest_name, *BASELINES[1:]]
    return rows.select(*keep, *KEYS, *COHORTS, *names)


def walk_forward(
    panel: DataFrame,
    folds: list[Fold],
    models: dict | None = None,
    warmup_hours: int = WARMUP_HOURS,
    embargo_hours: int = 0,
    sparse_max: float = SPARSE_ZONE_MEAN_MAX,
    features: DataFrame | None = None,
) -> DataFrame:
    """Wide out-of-fold table: baselines plus one column per fitted model.

    ``models`` maps a name to ``fit(train, valid) -> zone_id, hour, prediction``. Fits loop over
    folds on the driver, rows stay distributed; all predictions join once.
    """
    made = features if features is not None else make_features(panel)
    table = baseline_table(made, folds, warmup_hours, embargo_hours, sparse_max)
    if not models:
        return table
    assigned = cut_lineage(assign_folds(drop_warmup(made), folds, warmup_hours, embargo_hours))
    for name, fit in models.items():
        parts = []
        for fold in folds:
            mine = assigned.where(F.col("fold") == fold.name)
            scored = fit(mine.where("role = 'train'"), mine.where("role = 'validation'"))
            parts.append(clip_predictions(scored).select("zone_id", "hour", F.col("prediction").alias(name)))
        table = table.join(reduce(DataFrame.unionByName, parts), ["zone_id", "hour"], "left")
    return table


def delay_study(
    panel: DataFrame,
    folds: list[Fold],
    delays=DELAYS,
    warmup_hours: int = STUDY_WARMUP_HOURS,
    embargo_hours: int = STUDY_EMBARGO_HOURS,
    sparse_max: float = SPARSE_ZONE_MEAN_MAX,
) -> DataFrame:
    """Baselines under every observation delay on common targets, with ``delay_hours``.

    The delays are rows of one job. Training means do not depend on the delay (same warm-up and
    embargo), so they are built from the first delay's rows only.
    """
    features = cyclic(local_calendar(delayed_features(panel, delays)))
    assigned = assign_folds(drop_warmup(features), folds, warmup_hours, embargo_hours)
    means = zone_means(assigned.where(F.col("delay_hours") == min(delays)))
    joined = assigned.where("role = 'validation'").join(means, zone_keys(assigned), "left")
    rows = joined.withColumns(
        {
            "zone_hour_average": F.coalesce(
                F.try_element_at("hour_means", F.col("local_hour")), F.col("zone_mean")
            ),
            "zone_cohort": cohort_of(F.col("zone_mean"), sparse_max),
        }
    )
    rows = target_cohort(rolling_baseline(baseline_lags(rows, "latest_available")))
    return rows.select("delay_hours", *KEYS, *COHORTS, "latest_available", *BASELINES[1:])


def score_next_hour(
    panel: DataFrame, scorer, trained_until=None, minimum_hours: int = 168, trained_zones: DataFrame | None = None
) -> DataFrame:
    """Forecast of the next hour for every zone with enough history.

    ``scorer`` maps feature rows to rows with ``prediction``. Only the last ``minimum_hours``
    rows of a zone can matter, so older history is cut before the windows. With ``trained_zones`` (``zone_id``)
    a zone that was not in training is an error.
    """
    newest = panel.groupBy("zone_id").agg(F.max("hour").alias("_newest"))
    recent = (
        panel.join(newest, "zone_id")
        .where(F.col("hour") > F.col("_newest") - hours(minimum_hours))
        .select(*panel.columns)
    )
    featured = make_features(future_target_rows(recent))
    target = drop_warmup(featured.where(F.col("demand").isNull()))
    if trained_until is not None:
        target = target.where(F.col("hour") > instant(trained_until))
    if trained_zones is not None:
        known = trained_zones.select("zone_id", F.lit(True).alias("_trained")).distinct()
        unseen = F.raise_error(F.concat(F.lit("No training rows for zone "), F.col("zone_id").cast("string"))).cast("boolean")
        target = target.join(known, "zone_id", "left").where(F.coalesce(F.col("_trained"), unseen)).drop("_trained")
    return clip_predictions(scorer(target)).select(
        "zone_id",
        F.col("hour").alias("target_hour_utc"),
        (F.col("hour") + hours(1)).alias("target_end_utc"),
        (F.col("hour") - hours(1)).alias("latest_observed_hour_utc"),
        F.col("prediction").alias("predicted_pickups"),
    )


def match_control(
    candidate: DataFrame, control: DataFrame, columns=(*KEYS, *COHORTS)
) -> DataFrame:
    """``fold, check, bad_rows``: both tables hold the same keys, labels and cohorts per fold."""
    columns = list(columns)
    signed = candidate.select(*columns, F.lit(1).alias("sign")).unionByName(
        control.select(*columns, F.lit(-1).alias("sign"))
    )
    balance = signed.groupBy(*columns).agg(F.sum("sign").alias("b"))
    by_fold = balance.groupBy("fold").agg(
        F.sum(F.greatest(F.col("b"), F.lit(0))).alias("only_in_candidate"),
        F.sum(F.greatest(-F.col("b"), F.lit(0))).alias("only_in_control"),
    )
    return by_fold.unpivot("fold", ["only_in_candidate", "only_in_control"], "check", "bad_rows")


def training_signature(assigned: DataFrame) -> DataFrame:
    """Rows and content hash of the training targets per fold."""
    return table_fingerprint(
        assigned.where("role = 'train'"), ["zone_id", "hour", "demand"], ["fold"]
    )

