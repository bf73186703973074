"""Queries of splits, folds, cohorts and forecasts."""

from pyspark.sql import functions as F

from zonecast import bindings as b
from zonecast.catalog.panel import DEV_STOP
from zonecast.catalog.registry import query
from zonecast.operators import folds, forecasts, models, peers, regressions, temporal
from zonecast.operators.scores import fold_scores, pooled_scores
from zonecast.session import cut_lineage, saved
from zonecast.settings import BASELINES, NUMERIC_FEATURES

FOLDS = folds.study_folds(b.START, b.BOUNDARIES, b.SEALED)
WARMUP, EMBARGO = 174, 6
KEYS = ["zone_id", "hour", "demand"]
FITTED = [name for name, _, _ in regressions.STUDY_CANDIDATES]


def development(spark, sf):
    """The panel without sealed labels: later trips are not even counted."""
    return b.panel(spark, sf, b.SEALED)


def features(spark, sf):
    return temporal.make_features(development(spark, sf))


def assigned(spark, sf):
    return folds.assign_folds(
        temporal.drop_warmup(features(spark, sf)), FOLDS, WARMUP, EMBARGO
    )


def predictions(spark, sf):
    return forecasts.walk_forward(
        development(spark, sf), FOLDS, None, WARMUP, EMBARGO, b.SPARSE_MAX
    )


def delayed_predictions(spark, sf):
    return forecasts.delay_study(
        development(spark, sf), FOLDS, warmup_hours=WARMUP, embargo_hours=EMBARGO, sparse_max=b.SPARSE_MAX
    )


@query
def local_boundary(spark, sf):
    return folds.local_boundary(b.order_days(spark, sf))


@query
def chronological_split(spark, sf):
    return folds.chronological_split(
        b.panel(spark, sf).select(*KEYS), b.START, b.BOUNDARIES[2], b.SEALED
    )


@query
def expanding_folds(spark, sf):
    """One fold per month in which orders exist."""
    months = b.order_days(spark, sf).select(
        F.trunc("day", "month").cast("timestamp_ntz").alias("boundary")
    ).distinct()
    return folds.expanding_folds(months, "1994-12-01", "2001-01-01")


@query
def assign_folds(spark, sf):
    return folds.assign_folds(b.panel(spark, sf).select(*KEYS), FOLDS, WARMUP, EMBARGO)


@query
def zone_cohort(spark, sf):
    return folds.zone_cohort(assigned(spark, sf), b.SPARSE_MAX)


@query
def target_cohort(spark, sf):
    return folds.target_cohort(b.panel(spark, sf).select(*KEYS))


@query
def check_label_availability(spark, sf):
    plain = folds.assign_folds(temporal.drop_warmup(features(spark, sf)), FOLDS, 168, 3)
    return folds.check_label_availability(plain, FOLDS, 6)


@query
def match_control(spark, sf):
    loose = forecasts.walk_forward(development(spark, sf), FOLDS, None, 168, 0, b.SPARSE_MAX)
    return forecasts.match_control(loose, predictions(spark, sf))


@query
def training_signature(spark, sf):
    return forecasts.training_signature(assigned(spark, sf))


@query
def baseline_lags(spark, sf):
    return forecasts.baseline_lags(features(spark, sf)).select(*KEYS, *BASELINES[:3])


@query
def zone_hour_average(spark, sf):
    return forecasts.zone_hour_average(
        temporal.drop_warmup(features(spark, sf)), FOLDS, WARMUP, EMBARGO
    )


@query
def rolling_baseline(spark, sf):
    return forecasts.rolling_baseline(features(spark, sf)).select(*KEYS, "rolling_mean_24h")


@query
def clip_predictions(spark, sf):
    rows = features(spark, sf).select(*KEYS, F.col("trend_1").cast("double").alias("prediction"))
    return forecasts.clip_predictions(rows.where("prediction IS NOT NULL"))


@query
def walk_forward(spark, sf):
    return predictions(spark, sf)


@query
def delay_study(spark, sf):
    return delayed_predictions(spark, sf)


@query
def score_next_hour(spark, sf):
    def scorer(rows):
        return rows.withColumn("prediction", F.col("rolling_mean_24") + F.col("trend_1") / 8)

    return forecasts.score_next_hour(b.panel(spark, sf).select(*KEYS), scorer, DEV_STOP)


def report(rows, fits):
    """What every fit must hold, on all folds, and how far its last leaves are from the sums of their rows."""
    used = [f.features if isinstance(f, models.Boosting) else NUMERIC_FEATURES for f in fits.values()]
    needed = dict.fromkeys(["fold", "role", *KEYS, *(c for some in used for c in some)])
    rows = saved(rows.select(*needed), "assigned")
    predicted = saved(models.fit_cut_folds(rows, FOLDS, fits), "predicted")
    worst = predicted.groupBy("model", "fold").agg(F.max("breach").alias("breach"))
    return models.fit_report(rows, predicted).join(worst, ["model", "fold"])


def regression_report(spark, sf, place):
    """A regression's contract on all folds, its error in validation and the breach of its normal equations."""
    candidate = regressions.STUDY_CANDIDATES[place]
    rows = cut_lineage(temporal.drop_warmup(features(spark, sf)))
    split = folds.assign_folds(rows, FOLDS, WARMUP, EMBARGO)
    made = regressions.fit_regressions(rows, FOLDS, [candidate], WARMUP, EMBARGO)
    name = candidate[0]
    predicted = made.predictions(split)
    long = predicted.select(F.lit(name).alias("model"), "fold", "role", "zone_id", "hour", F.col(name).alias("prediction"))
    errors = fold_scores(predicted.where("role = 'validation'"), [name]).select("model", "fold", "mae", "rmse", "r2")
    proof = made.certificate(split).drop("train_rows")
    return models.fit_report(split, long).join(errors, ["model", "fold"]).join(proof, ["model", "fold"])


@query
def linear_model(spark, sf):
    return regression_report(spark, sf, 0)


@query
def ridge_model(spark, sf):
    return regression_report(spark, sf, 1)


@query
def boosted_model(spark, sf):
    return report(assigned(spark, sf), {"boosted_squared": models.Boosting()})


@query
def boosted_absolute(spark, sf):
    return report(assigned(spark, sf), {"boosted_absolute": models.Boosting(loss="absolute")})


@query
def loglinear_model(spark, sf):
    return report(assigned(spark, sf), {"loglinear": models.fit_loglinear})


@query
def poisson_model(spark, sf):
    return report(assigned(spark, sf), {"poisson": models.Boosting(loss="poisson")})


@query
def depth_grid(spark, sf):
    return report(assigned(spark, sf), models.depth_fits())


@query
def borough_models(spark, sf):
    rows = peers.make_peer_features(development(spark, sf), b.zones(spark, sf), b.REGIONS)
    ready = temporal.drop_warmup(rows).dropna(subset=list(peers.PEER_LAGS))
    static = list(peers.onehot_names(b.REGIONS).values())
    bundles = {"borough_static": static, "borough_context": [*static, *peers.PEER_LAGS]}
    return report(folds.assign_folds(ready, FOLDS, WARMUP, EMBARGO), models.bundle_fits(bundles))


def scored_with_proof(table, proofs, names, extra=()):
    """Pooled scores of all models, and for the fitted ones the largest breach of their normal equations."""
    worst = proofs.groupBy(*extra, "model").agg(F.max("breach").alias("breach"))
    return pooled_scores(table, names, extra).drop("smape_pct").join(worst, [*extra, "model"], "left")


@query
def fitted_walk_forward(spark, sf):
    """All folds with two fitted models beside the baselines, scored over all validation rows."""
    rows = cut_lineage(features(spark, sf))
    predicted, proofs = regressions.regression_study(temporal.drop_warmup(rows), FOLDS, None, WARMUP, EMBARGO)
    table = forecasts.baseline_table(rows, FOLDS, WARMUP, EMBARGO, b.SPARSE_MAX)
    wide = table.join(predicted.select("fold", "zone_id", "hour", *FITTED), ["fold", "zone_id", "hour"], "left")
    return scored_with_proof(wide, proofs, [*BASELINES, *FITTED])


@query
def fitted_delay_study(spark, sf):
    """Both regressions under every observation delay, all folds and delays fitted from the same scans."""
    made = temporal.cyclic(temporal.local_calendar(temporal.delayed_features(development(spark, sf))))
    rows = saved(temporal.drop_warmup(made).select("delay_hours", *KEYS, *NUMERIC_FEATURES), "delayed")
    predicted, proofs = regressions.regression_study(rows, FOLDS, None, WARMUP, EMBARGO, ["delay_hours"])
    return scored_with_proof(predicted, proofs, FITTED, ["delay_hours"])
