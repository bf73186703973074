"""Score tables. Errors are reduced to mergeable sums once, then read at any grain."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.functions.accuracy import error_sums, merged, metric_columns
from zonecast.functions.clock import day_text, to_local
from zonecast.functions.tables import long_models
from zonecast.settings import SLICE_DIMENSIONS


def error_cube(predictions: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """Error sums per ``keys`` and model. Partial sums form before the shuffle."""
    long = long_models(predictions, models, [*keys, "demand"])
    return long.groupBy(*keys, "model").agg(*error_sums(F.col("demand"), F.col("prediction")))


def mae_rmse(predictions: DataFrame, models: list[str]) -> DataFrame:
    return pooled_scores(predictions, models).select("model", "mae", "rmse")


def r2(predictions: DataFrame, models: list[str]) -> DataFrame:
    return pooled_scores(predictions, models).select("model", "r2")


def smape_pct(predictions: DataFrame, models: list[str]) -> DataFrame:
    return pooled_scores(predictions, models).select("model", "smape_pct")


def fold_scores(predictions: DataFrame, models: list[str], extra=()) -> DataFrame:
    keys = [*extra, "fold"]
    return error_cube(predictions, models, keys).select(*keys, "model", *metric_columns())


def pooled_scores(predictions: DataFrame, models: list[str], extra=()) -> DataFrame:
    """Metrics over all out-of-fold rows, best first. Fold metrics are never averaged."""
    cube = error_cube(predictions, models, list(extra))
    return cube.select(*extra, "model", *metric_columns()).orderBy(*extra, "mae", "model")


def all_scores(predictions: DataFrame, models: list[str], extra=()) -> DataFrame:
    """Pooled and fold scores together as ``scope, model, rows`` and metrics, from one pass."""
    cube = error_cube(predictions, models, [*extra, "fold"])
    scopes = cube.withColumn("scope", F.explode(F.array(F.lit("pooled"), F.col("fold"))))
    return merged(scopes, [*extra, "scope", "model"]).select(
        *extra, "scope", "model", "rows", *metric_columns()
    )


def slice_scores(
    predictions: DataFrame, models: list[str], dimensions=SLICE_DIMENSIONS, keys=("fold",)
) -> DataFrame:
    """Metrics per fold, model and value of each dimension.

    The combined cells of all dimensions are summed first. Only these few cells are then copied
    once per dimension, not the prediction rows.
    """
    keys, dimensions = list(keys), list(dimensions)
    cube = error_cube(predictions, models, [*keys, *dimensions])
    sums = [c for c in cube.columns if c not in dimensions]
    text = cube.select(*sums, *[F.col(d).cast("string").alias(d) for d in dimensions])
    long = text.unpivot(sums, dimensions, "dimension", "value")
    return merged(long, [*keys, "model", "dimension", "value"]).select(
        *keys,
        "model",
        "dimension",
        "value",
        "rows",
        (F.col("p_sum") / F.col("rows")).alias("mean_prediction"),
        (F.col("p_positive") / F.col("rows")).alias("positive_prediction_fraction"),
        *metric_columns(),
    )


def daily_scores(predictions: DataFrame, models: list[str], extra=()) -> DataFrame:
    """Rows, MAE and absolute-error sum per fold, local day and model."""
    dated = predictions.withColumn("date_nyc", day_text(to_local(F.col("hour"))))
    long = long_models(dated, models, [*extra, "fold", "date_nyc", "demand"])
    miss = F.abs(F.col("demand") - F.col("prediction"))
    return long.groupBy(*extra, "fold", "date_nyc", "model").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(miss).alias("mae"),
        F.sum(miss).alias("absolute_error_sum"),
    )


def contrast_table(frame: DataFrame, contrasts) -> DataFrame:
    """Each row once per contrast its model takes part in, with ``candidate, reference, side``."""
    entries = [
        F.struct(F.lit(c).alias("candidate"), F.lit(r).alias("reference")) for c, r in contrasts
    ]
    mine = F.filter(
        F.array(*entries), lambda e: (e["candidate"] == F.col("model")) | (e["reference"] == F.col("model"))
    )
    return frame.select(*frame.columns, F.inline(mine))


def compare_models(scores: DataFrame, contrasts) -> DataFrame:
    """MAE of candidate and reference per scope, difference and relative reduction in percent.

    ``scores`` is ``scope, model, mae``. One aggregation pairs the two sides; no self-join.
    """
    sided = contrast_table(scores.select("scope", "model", "mae"), contrasts)
    mine = lambda side: F.max(F.when(F.col("model") == F.col(side), F.col("mae")))
    paired = sided.groupBy("scope", "candidate", "reference").agg(
        mine("candidate").alias("mae"), mine("reference").alias("reference_mae")
    )
    control = F.col("reference_mae")
    return paired.withColumns(
        {
            "delta_mae": F.col("mae") - control,
            "relative_reduction_pct": F.when(control != 0, 100 * (1 - F.try_divide(F.col("mae"), control))),
        }
    )


def delay_effects(scores: DataFrame, model: str) -> DataFrame:
    """Change against the zero-delay score of the same scope.

    ``scores`` is ``delay_hours, scope, model, mae``.
    """
    mine = scores.where(F.col("model") == model).select("scope", "delay_hours", "model", "mae")
    control = mine.where("delay_hours = 0").select("scope", F.col("mae").alias("control_mae"))
    base = F.col("control_mae")
    return mine.join(control, "scope", "left").select(
        "scope",
        "delay_hours",
        "model",
        "mae",
        "control_mae",
        (F.col("mae") - base).alias("mae_change"),
        F.when(base > 0, 100 * (F.try_divide(F.col("mae"), base) - 1)).alias("mae_increase_pct"),
    )


def pooled_from_daily(daily: DataFrame) -> DataFrame:
    """Pooled MAE per model as the row-weighted mean of daily MAEs."""
    return daily.groupBy("model").agg(
        (F.sum(F.col("rows") * F.col("mae")) / F.sum("rows")).alias("mae"), F.sum("rows").alias("rows")
    )


def reconcile_daily(daily: DataFrame, pooled: DataFrame) -> DataFrame:
    """Row-weighted daily MAE against the pooled MAE per model."""
    total = pooled_from_daily(daily).withColumnRenamed("mae", "daily_mae")
    return total.join(pooled.select("model", "mae"), "model", "full_outer").select(
        "model", "rows", "daily_mae", "mae", F.abs(F.col("daily_mae") - F.col("mae")).alias("difference")
    )


def cohort_change(
    slices: DataFrame,
    contrasts,
    cells=(("zone_cohort", "sparse"), ("target_cohort", "zero")),
) -> DataFrame:
    """Candidate minus reference MAE of chosen slices, per fold."""
    chosen = F.lit(False)
    for dimension, value in cells:
        chosen = chosen | ((F.col("dimension") == dimension) & (F.col("value") == value))
    sided = contrast_table(
        slices.where(chosen).select("fold", "dimension", "value", "model", "mae"), contrasts
    )
    mine = lambda side: F.max(F.when(F.col("model") == F.col(side), F.col("mae")))
    return sided.groupBy("fold", "dimension", "value", "candidate", "reference").agg(
        (mine("candidate") - mine("reference")).alias("delta_mae")
    )


def select_champion(pooled: DataFrame, fitted: list[str]) -> DataFrame:
    """Lowest-MAE model overall and among fitted models, ties by name."""
    order = F.struct("mae", "model")
    return pooled.agg(
        F.min_by("model", order).alias("champion"),
        F.min_by(
            F.when(F.col("model").isin(*fitted), F.col("model")),
            F.when(F.col("model").isin(*fitted), order),
        ).alias("best_ml"),
    )
