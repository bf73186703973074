"""Queries of scores, comparisons, resampling and score contracts."""

from pyspark.sql import functions as F

from zonecast import bindings as b
from zonecast.catalog.registry import query
from zonecast.catalog.study import FOLDS, delayed_predictions, features, predictions
from zonecast.operators import contracts, resample, scores
from zonecast.session import cut_lineage, new_path
from zonecast.settings import BASELINES
from zonecast.sources import tables as sources

MODELS = list(BASELINES)
DELAYED = ["latest_available", *MODELS[1:]]
CONTRASTS = (
    ("rolling_mean_24h", "previous_week_168h"),
    ("zone_hour_average", "previous_week_168h"),
    ("rolling_mean_24h", "zone_hour_average"),
)
BLOCKS, PRIMARY = (2, 1, 4), 2
REPLICATES, SEED = 10_000, 42


def daily(spark, sf):
    return scores.daily_scores(predictions(spark, sf), MODELS)


def stored_daily(spark, sf):
    """The daily error table behind a checkpoint: tiny, expensive, and read several times."""
    return cut_lineage(daily(spark, sf))


def losses(spark, sf, table=None):
    table = daily(spark, sf) if table is None else table
    return resample.loss_matrix(table, resample.day_weights(b.zones(spark, sf), FOLDS))


def pooled(spark, sf):
    return scores.pooled_scores(predictions(spark, sf), MODELS)


def draws_and_pooled(spark, sf, blocks=BLOCKS, replicates=REPLICATES):
    table = stored_daily(spark, sf)
    drawn = resample.bootstrap_mae(losses(spark, sf, table), blocks, replicates, SEED)
    return drawn, scores.pooled_from_daily(table)


@query
def check_scores_input(spark, sf):
    rows = features(spark, sf).select("demand", "lag_1", "trend_1", "rolling_std_24")
    return contracts.check_scores_input(rows, ["lag_1", "trend_1", "rolling_std_24"])


@query
def mae_rmse(spark, sf):
    return scores.mae_rmse(predictions(spark, sf), MODELS)


@query
def r2(spark, sf):
    return scores.r2(predictions(spark, sf), MODELS)


@query
def smape_pct(spark, sf):
    return scores.smape_pct(predictions(spark, sf), MODELS)


@query
def fold_scores(spark, sf):
    return scores.fold_scores(predictions(spark, sf), MODELS)


@query
def pooled_scores(spark, sf):
    return pooled(spark, sf)


@query
def slice_scores(spark, sf):
    return scores.slice_scores(predictions(spark, sf), MODELS)


@query
def daily_scores(spark, sf):
    return daily(spark, sf)


@query
def read_daily_errors(spark, sf):
    """The daily error table as CSV, read back under its schema."""
    path = new_path(spark, "daily")
    sources.write_report_table(daily(spark, sf).select("fold", "date_nyc", "model", "rows", "mae"), path)
    return sources.read_daily_errors(spark, path)


@query
def compare_models(spark, sf):
    return scores.compare_models(scores.all_scores(predictions(spark, sf), MODELS), CONTRASTS)


@query
def delay_effects(spark, sf):
    table = scores.all_scores(delayed_predictions(spark, sf), DELAYED, ["delay_hours"])
    return scores.delay_effects(table, "latest_available")


@query
def reconcile_daily(spark, sf):
    return scores.reconcile_daily(daily(spark, sf), pooled(spark, sf))


@query
def cohort_change(spark, sf):
    return scores.cohort_change(scores.slice_scores(predictions(spark, sf), MODELS), CONTRASTS)


@query
def select_champion(spark, sf):
    """The averages stand in for fitted models here."""
    return scores.select_champion(pooled(spark, sf), ["zone_hour_average", "rolling_mean_24h"])


@query
def reconcile_scores(spark, sf):
    """Fold scores without delay against fold scores with a three hour delay."""
    table = scores.fold_scores(delayed_predictions(spark, sf), DELAYED, ["delay_hours"])
    side = lambda d: table.where(F.col("delay_hours") == d).drop("delay_hours")
    return contracts.reconcile_scores(
        side(0), side(3), ["fold", "model"], ["mae", "rmse", "r2", "smape_pct"], 1e-9, 1e-9
    )


@query
def check_daily_errors(spark, sf):
    """Stored scores leave out fold_2's daily rows, so the contract finds missing cells."""
    kept = daily(spark, sf).drop("absolute_error_sum").where("fold <> 'fold_2'")
    table = predictions(spark, sf)
    return contracts.check_daily_errors(
        kept,
        resample.day_weights(b.zones(spark, sf), FOLDS),
        scores.fold_scores(table, MODELS),
        scores.pooled_scores(table, MODELS),
        MODELS,
    )


@query
def check_abs_error_sums(spark, sf):
    shifted = daily(spark, sf).withColumn(
        "absolute_error_sum", F.col("absolute_error_sum") + F.when(F.col("fold") == "fold_1", 1).otherwise(0)
    )
    return contracts.check_abs_error_sums(shifted)


@query
def day_weights(spark, sf):
    return resample.day_weights(b.zones(spark, sf), FOLDS)


@query
def loss_matrix(spark, sf):
    return losses(spark, sf)


@query
def circular_blocks(spark, sf):
    days = resample.fold_days(losses(spark, sf))
    return resample.circular_blocks(days, BLOCKS, REPLICATES, SEED)


@query
def bootstrap_mae(spark, sf):
    return draws_and_pooled(spark, sf)[0]


@query
def contrast_intervals(spark, sf):
    return resample.contrast_intervals(
        *draws_and_pooled(spark, sf, (PRIMARY,)), CONTRASTS, PRIMARY
    )


@query
def family_intervals(spark, sf):
    return resample.family_intervals(*draws_and_pooled(spark, sf, (PRIMARY,)), CONTRASTS, PRIMARY)


def sensitivity(spark, sf, replicates, weather_candidate=None):
    table = stored_daily(spark, sf)
    return resample.block_sensitivity(
        losses(spark, sf, table),
        scores.pooled_from_daily(table),
        CONTRASTS,
        BLOCKS,
        PRIMARY,
        replicates,
        SEED,
        weather_candidate=weather_candidate,
    )


@query
def block_sensitivity(spark, sf):
    return sensitivity(spark, sf, REPLICATES)


@query
def weather_block_sensitivity(spark, sf):
    return sensitivity(spark, sf, REPLICATES, CONTRASTS[0][0])


@query
def linear_percentiles(spark, sf):
    drawn, _ = draws_and_pooled(spark, sf)
    return resample.linear_percentiles(drawn, CONTRASTS, (0.025, 0.5, 0.975))
