"""Studies of fitted models over folds, from a saved feature table to scores, comparisons and a run record.

One feature table may hold temporal, borough and weather columns, and rows of several delays: a study is a map of
named fits on it. The delay, borough, depth and weather studies only differ in that map.
"""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.operators import forecasts, models, scores
from zonecast.operators.contracts import check_append, check_keys, check_rows, check_scores_input, require, stack
from zonecast.operators.folds import assign_folds, study_folds
from zonecast.operators.peers import make_peer_features
from zonecast.operators.temporal import cyclic, delayed_features, drop_warmup, local_calendar
from zonecast.plans.study import development_panel, saved_zones
from zonecast.settings import BASELINES, BOROUGHS, DELAYS, SPARSE_ZONE_MEAN_MAX, STUDY_EMBARGO_HOURS, STUDY_WARMUP_HOURS
from zonecast.sources import tables as sources

KEYS = ["fold", "zone_id", "hour"]


def save_features(
    spark: SparkSession, panel_path: str, train_start: str, sealed: str, out: str, bundle: DataFrame | None = None, boroughs=BOROUGHS
) -> None:
    """Temporal and borough features of the development panel, with the columns of a weather bundle if given."""
    panel = development_panel(spark, panel_path, train_start, sealed)
    rows = drop_warmup(make_peer_features(panel, saved_zones(spark, panel_path), boroughs))
    if bundle is not None:
        require(check_append(rows, bundle, [c for c in bundle.columns if c != "hour"]))
        rows = rows.join(bundle, "hour", "left")
    sources.write_table(rows, out)


def save_delayed_features(spark: SparkSession, panel_path: str, train_start: str, sealed: str, out: str, delays=DELAYS) -> None:
    """Features under every observation delay, with ``delay_hours``, from one shuffle of the panel."""
    panel = development_panel(spark, panel_path, train_start, sealed)
    rows = drop_warmup(cyclic(local_calendar(delayed_features(panel, delays))))
    rows.write.mode("errorifexists").partitionBy("delay_hours").parquet(out)


def fitted_study(
    spark: SparkSession,
    features_path: str,
    train_start: str,
    boundaries,
    sealed: str,
    fits: dict,
    out: str,
    delay: int | None = None,
    control: str | None = None,
    contrasts=(),
    sparse_max: float = SPARSE_ZONE_MEAN_MAX,
    warmup_hours: int = STUDY_WARMUP_HOURS,
    embargo_hours: int = STUDY_EMBARGO_HOURS,
    parameters: dict | None = None,
) -> None:
    """Writes ``predictions`` (validation rows, baselines and one column per fit), ``pooled``, ``folds``,
    ``slices``, ``daily``, ``comparison``, ``signatures`` and ``record`` under ``out``.

    ``fits`` maps a name to ``fit(train) -> score``. With ``control``, the folder of an earlier study, the study must
    have its keys, labels, cohorts, training rows and baseline scores. ``delay`` picks the rows of one delay.
    """
    folds = study_folds(train_start, boundaries, sealed)
    rows = spark.read.parquet(features_path)
    latest = "previous_hour" if delay is None else "latest_available"
    if delay is not None:
        rows = rows.where(F.col("delay_hours") == delay)
    assigned = assign_folds(rows, folds, warmup_hours, embargo_hours)
    sources.write_table(models.fit_folds(assigned, folds, fits).where("role = 'validation'"), f"{out}/long")
    wide = spark.read.parquet(f"{out}/long").groupBy(*KEYS).pivot("model", list(fits)).agg(F.first("prediction"))
    table = forecasts.baseline_table(rows, folds, warmup_hours, embargo_hours, sparse_max, latest)
    sources.write_table(table.join(wide, KEYS, "left"), f"{out}/predictions")
    sources.write_table(forecasts.training_signature(assigned), f"{out}/signatures")
    saved = spark.read.parquet(f"{out}/predictions")
    baselines = [latest, *BASELINES[1:]]
    names = [*baselines, *fits]
    grid = assigned.where("role = 'validation'").select(*KEYS)
    require(stack(check_scores_input(saved, names), check_keys(saved, grid, KEYS)))
    made = {
        "pooled": scores.pooled_scores(saved, names),
        "folds": scores.fold_scores(saved, names),
        "slices": scores.slice_scores(saved, names),
        "daily": scores.daily_scores(saved, names),
        "scores": scores.all_scores(saved, names),
    }
    for name, frame in made.items():
        sources.write_table(frame, f"{out}/{name}")
    if contrasts:
        sources.write_report_table(scores.compare_models(spark.read.parquet(f"{out}/scores"), list(contrasts)), f"{out}/comparison")
    if control is not None:
        require(match_study(spark, out, control, baselines))
    record = scores.select_champion(spark.read.parquet(f"{out}/pooled"), list(fits))
    bounds = {
        f.name: {
            "validation_start": str(f.validation_start),
            "validation_end": str(f.validation_end),
            "warmup_hours": warmup_hours,
            "embargo_hours": embargo_hours,
        }
        for f in folds
    }
    told = spark.read.parquet(f"{out}/scores").select("scope", "model", "rows", "mae", "rmse", "r2", "smape_pct").collect()
    trained = {r["fold"]: r["rows"] for r in spark.read.parquet(f"{out}/signatures").select("fold", "rows").collect()}
    sources.write_run_record(
        record.select(
            "*",
            F.lit(json.dumps(parameters or {}, sort_keys=True)).alias("parameters"),
            F.lit(json.dumps(bounds, sort_keys=True)).alias("folds"),
            F.lit(json.dumps(trained, sort_keys=True)).alias("training_rows"),
            F.lit(json.dumps([r.asDict() for r in told], sort_keys=True)).alias("scores"),
        ),
        f"{out}/record",
    )


def match_study(spark: SparkSession, study: str, control: str, shared_models, tolerance: float = 1e-9) -> DataFrame:
    """Both studies hold the same rows, labels and cohorts, trained on the same targets, with equal shared scores."""
    read = lambda root, name: spark.read.parquet(f"{root}/{name}")
    rows = forecasts.match_control(read(study, "predictions"), read(control, "predictions"))
    balance = rows.groupBy("check").agg(F.sum("bad_rows").alias("bad_rows"))
    mine, theirs = (read(root, "signatures").select("fold", "rows", "hash_sum", "hash_xor") for root in (study, control))
    differ = mine.exceptAll(theirs).union(theirs.exceptAll(mine)).agg(F.count("*").alias("training_differs"))
    of = lambda root: read(root, "scores").where(F.col("model").isin(list(shared_models))).select("scope", "model", "rows", "mae")
    left, right = of(study), of(control).withColumnsRenamed({"rows": "_rows", "mae": "_mae"})
    off = F.coalesce((F.col("rows") != F.col("_rows")) | (F.abs(F.col("mae") - F.col("_mae")) > tolerance), F.lit(True))
    scored = left.join(right, ["scope", "model"], "full_outer").agg(F.coalesce(F.sum(off.cast("bigint")), F.lit(0)).alias("scores_differ"))
    return balance.unionByName(check_rows(differ, ["training_differs"])).unionByName(check_rows(scored, ["scores_differ"]))


def delay_study(
    spark: SparkSession, features_path: str, train_start: str, boundaries, sealed: str, fits: dict, out: str, delays=DELAYS, **options
) -> None:
    """The fitted study for every delay, each matched to the first one's rows, and their effects."""
    for delay in delays:
        fitted_study(spark, features_path, train_start, boundaries, sealed, fits, f"{out}/delay_{delay}", delay=delay, **options)
        if delay != delays[0]:
            require(match_study(spark, f"{out}/delay_{delay}", f"{out}/delay_{delays[0]}", []))
    parts = [
        spark.read.parquet(f"{out}/delay_{d}/scores").where(F.col("model").isin(list(fits))).withColumn("delay_hours", F.lit(d)) for d in delays
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    for name in fits:
        sources.write_report_table(scores.delay_effects(table.where(F.col("model") == name), name), f"{out}/effects_{name}")

