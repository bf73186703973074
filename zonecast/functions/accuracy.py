"""Forecast accuracy as mergeable parts: build once per group, merge, then read the metrics.

The target's spread is held as mean and sum of squares around it. Raw sums of squares would cancel where the target is large
beside its spread.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("mae", "rmse", "r2", "smape_pct")


def error_sums(actual: Column, predicted: Column) -> list[Column]:
    """Parts of one group: sums that add up across groups, and count, mean and squares around the mean of the target."""
    y, p = actual.cast("double"), predicted.cast("double")
    miss = F.abs(y - p)
    size = F.abs(y) + F.abs(p)
    return [
        F.count(F.lit(1)).alias("rows"),
        F.sum(miss).alias("abs_sum"),
        F.sum(miss * miss).alias("sq_sum"),
        F.sum(F.when(size == 0, F.lit(0.0)).otherwise(200 * miss / size)).alias("smape_sum"),
        F.avg(y).alias("y_mean"),
        (F.var_pop(y) * F.count(y)).alias("y_squares"),
        F.min(y).alias("y_min"),
        F.max(y).alias("y_max"),
        F.sum(p).alias("p_sum"),
        F.sum((p > 0).cast("bigint")).alias("p_positive"),
    ]


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``error_sums`` of finer groups put together per ``keys``.

    Squares around the common mean are those around each part's own mean and those of the means. The parts of a group are cells of a few
    dimensions, so a window over them is small, and the aggregation after it is partitioned the same way.
    """
    n, own = F.col("rows"), Window.partitionBy(*keys)
    # Distances from some part's mean keep the common mean exact for large targets.
    apart = F.col("y_mean") - F.min("y_mean").over(own)
    off = apart - F.sum(n * apart).over(own) / F.sum(n).over(own)
    centred = parts.withColumn("y_squares", F.col("y_squares") + n * off * off)
    added = ("rows", "abs_sum", "sq_sum", "smape_sum", "y_squares", "p_sum", "p_positive")
    return centred.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in added],
        F.min("y_min").alias("y_min"),
        F.max("y_max").alias("y_max"),
    )


def metric_columns() -> list[Column]:
    """mae, rmse, r2, smape_pct. r2 is NULL on one row or a constant target."""
    n = F.col("rows")
    return [
        (F.col("abs_sum") / n).alias("mae"),
        F.sqrt(F.col("sq_sum") / n).alias("rmse"),
        F.when(
            (n > 1) & (F.col("y_min") != F.col("y_max")), 1 - F.col("sq_sum") / F.col("y_squares")
        ).alias("r2"),
        (F.col("smape_sum") / n).alias("smape_pct"),
    ]
