"""Saved panel to forecasts, scores, intervals and report tables.

Each job reads saved tables and saves its own, so a later job never replays an earlier one.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.operators import explorer, reports, resample, scores
from zonecast.operators.contracts import (
    check_complete_window,
    check_daily_errors,
    check_export,
    check_keys,
    check_panel,
    check_scores_input,
    require,
    stack,
)
from zonecast.operators.folds import study_folds, utc_midnight
from zonecast.operators.forecasts import delay_study, walk_forward
from zonecast.settings import BASELINES, SPARSE_ZONE_MEAN_MAX, WARMUP_HOURS
from zonecast.sources import tables as sources

KEY = ["zone_id", "hour"]


def development_panel(spark: SparkSession, path: str, train_start: str, sealed: str) -> DataFrame:
    """Saved labels before the sealed test. Later labels never leave the files."""
    return sources.read_window(spark, path, utc_midnight(train_start), utc_midnight(sealed))


def saved_zones(spark: SparkSession, panel_path: str) -> DataFrame:
    """The lookup that was saved beside the panel: a zone that the panel lacks altogether is in it."""
    return spark.read.parquet(f"{panel_path.rstrip('/').rpartition('/')[0]}/zones")


def backtest(
    spark: SparkSession,
    panel_path: str,
    train_start: str,
    boundaries,
    sealed: str,
    out: str,
    models: dict | None = None,
    id_range=(2, 263),
    sparse_max: float = SPARSE_ZONE_MEAN_MAX,
    warmup_hours: int = WARMUP_HOURS,
    embargo_hours: int = 0,
) -> None:
    """Walk-forward predictions and their pooled, fold, slice and daily score tables."""
    folds = study_folds(train_start, boundaries, sealed)
    panel = development_panel(spark, panel_path, train_start, sealed)
    zones = saved_zones(spark, panel_path)
    require(
        stack(
            check_panel(panel, id_range),
            check_complete_window(panel, zones, utc_midnight(train_start), utc_midnight(sealed)),
        )
    )
    table = walk_forward(panel, folds, models, warmup_hours, embargo_hours, sparse_max)
    sources.write_table(table, f"{out}/predictions")
    sources.write_table(zones, f"{out}/zones")
    saved = spark.read.parquet(f"{out}/predictions")
    names = [*BASELINES, *(models or {})]
    grid = panel.where(F.col("hour") >= F.lit(str(folds[0].validation_start)).cast("timestamp_ntz"))
    require(stack(check_scores_input(saved, names), check_keys(saved, grid, KEY)))
    made = {
        "pooled": scores.pooled_scores(saved, names),
        "folds": scores.fold_scores(saved, names),
        "slices": scores.slice_scores(saved, names),
        "daily": scores.daily_scores(saved, names),
    }
    for name, frame in made.items():
        sources.write_table(frame, f"{out}/{name}")
        sources.write_report_table(spark.read.parquet(f"{out}/{name}"), f"{out}/csv/{name}")
    record = scores.select_champion(spark.read.parquet(f"{out}/pooled"), list(models or BASELINES))
    sources.write_run_record(record, f"{out}/record")


def latency(
    spark: SparkSession, panel_path: str, train_start: str, boundaries, sealed: str, out: str, **options
) -> None:
    """The delay study with effects against the zero-delay control."""
    folds = study_folds(train_start, boundaries, sealed)
    panel = development_panel(spark, panel_path, train_start, sealed)
    sources.write_table(delay_study(panel, folds, **options), f"{out}/predictions")
    saved = spark.read.parquet(f"{out}/predictions")
    names = ["latest_available", *BASELINES[1:]]
    table = scores.all_scores(saved, names, ["delay_hours"])
    sources.write_table(table, f"{out}/scores")
    effects = scores.delay_effects(spark.read.parquet(f"{out}/scores"), names[0])
    sources.write_report_table(effects, f"{out}/csv/delay_effects")


def uncertainty(
    spark: SparkSession,
    study: str,
    train_start: str,
    boundaries,
    sealed: str,
    contrasts,
    out: str,
    block_days=(7, 1, 14),
    replicates: int = 10_000,
    seed: int = 42,
    confidence: float = 0.95,
    weather_candidate: str | None = None,
) -> None:
    """Intervals from the saved daily errors of a backtest, after they reconcile.

    With ``weather_candidate``, the model of the delay asked about, intervals carry ``weather_role``.
    """
    folds = study_folds(train_start, boundaries, sealed)
    daily, pooled, by_fold = (spark.read.parquet(f"{study}/{n}") for n in ("daily", "pooled", "folds"))
    weights = resample.day_weights(spark.read.parquet(f"{study}/zones"), folds)
    names = [r["model"] for r in pooled.select("model").collect()]
    resample.check_contrasts(contrasts, names)
    require(check_daily_errors(daily, weights, by_fold, pooled, names))
    losses = resample.loss_matrix(daily, weights)
    sources.write_table(
        resample.bootstrap_mae(losses, block_days, replicates, seed), f"{out}/draws"
    )
    draws = spark.read.parquet(f"{out}/draws")
    found = resample.family_intervals(draws, pooled, contrasts, block_days[0], confidence, confidence)
    if weather_candidate is not None:
        found = resample.with_weather_role(found, contrasts, weather_candidate)
    sources.write_report_table(found, f"{out}/csv/intervals")


def report(spark: SparkSession, panel_path: str, study: str, train_start: str, first: str, sealed: str, model: str, out: str) -> None:
    """Demand summaries, error slices and the zone map of one model."""
    panel = development_panel(spark, panel_path, train_start, sealed)
    saved = spark.read.parquet(f"{study}/predictions")
    train = panel.where(F.col("hour") < F.lit(str(utc_midnight(first))).cast("timestamp_ntz"))
    banded = reports.demand_bands(saved, train)
    dimensions = [d for d in reports.REPORT_DIMENSIONS if d in banded.columns]
    zone_map = reports.zone_map_table(panel, saved, model)
    require(reports.check_zone_map(zone_map, saved_zones(spark, panel_path)))
    for name, frame in {
        "daily_totals": reports.daily_totals(panel),
        "hourly_profile": reports.hourly_profile(panel),
        "zone_totals": reports.zone_totals(panel),
        "error_slices": reports.error_slices(banded, model, dimensions),
        "zone_map": zone_map,
    }.items():
        sources.write_report_table(frame, f"{out}/{name}")


def export(spark: SparkSession, panel_path: str, study: str, fold: str, start, stop, models, out: str) -> None:
    """The nested explorer export, its borough summary and the quoted CSV of a window."""
    saved = explorer.demo_window(spark.read.parquet(f"{study}/predictions"), start, stop, fold)
    zones = saved_zones(spark, panel_path)
    rows = saved.join(zones.select("zone_id", "Zone"), "zone_id", "left")
    nested = sources.export_nested(rows, ["demand", *models])
    require(check_export(nested, zones.select("zone_id"), 1 + len(models)))
    nested.write.mode("errorifexists").json(f"{out}/hours")
    summary = explorer.borough_summary(rows, {f"{m}_mae": m for m in models})
    sources.write_report_table(summary, f"{out}/boroughs")
    sources.write_csv_quoted(explorer.export_rows(rows, list(models), fold, f"{start} to {stop}"), f"{out}/rows")
