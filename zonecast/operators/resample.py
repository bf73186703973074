"""Paired circular block bootstrap of daily errors.

Draws come from a hash of (seed, block length, fold, replicate, block number), so every model
sees the same draws, a lost task redraws the same values, and no state is shared.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecast.functions.clock import day_text, hour_index, instant, to_utc
from zonecast.operators.folds import Fold
from zonecast.operators.scores import contrast_table


def day_weights(zones: DataFrame, folds: list[Fold]) -> DataFrame:
    """``fold, date_nyc, day_index, rows``: local validation days and their zone-hours.

    A day has 23 hours when the clock skips one. Folds are job parameters.
    """
    number = zones.select("zone_id").distinct().agg(F.count(F.lit(1)).alias("zone_count"))
    spans = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("fold"),
                F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), instant(f.validation_start)).alias("a"),
                F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), instant(f.validation_end)).alias("b"),
            )
            for f in folds
        ]
    )
    one_day = F.expr("interval 1 day")
    days = number.select("zone_count", F.inline(spans)).select(
        "zone_count", "fold", F.posexplode(F.sequence(F.col("a"), F.col("b") - one_day, one_day)).alias("day_index", "day")
    )
    length = hour_index(to_utc(F.col("day") + one_day)) - hour_index(to_utc(F.col("day")))
    return days.select(
        "fold", day_text(F.col("day")).alias("date_nyc"), "day_index", (length * F.col("zone_count")).alias("rows")
    )


def loss_matrix(daily: DataFrame, weights: DataFrame) -> DataFrame:
    """Daily losses with the day position inside the fold; long, one row per model."""
    return weights.join(daily.select("fold", "date_nyc", "model", "mae"), ["fold", "date_nyc"])


def fold_days(losses: DataFrame) -> DataFrame:
    return losses.groupBy("fold").agg((F.max("day_index") + 1).alias("days"))


def draw(seed: int, block: Column, fold: Column, replicate: Column, number: Column, days: Column) -> Column:
    """Start day of a block: 52 bits of an MD5, reduced modulo the days of the fold."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in (block, fold, replicate, number)])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") % days


def block_starts(folds: DataFrame, block_days, replicates: int, seed: int) -> DataFrame:
    """One row per drawn block: ``block_days, replicate, fold, days, number, start``."""
    blocks = F.explode(F.array(*[F.lit(b) for b in block_days])).alias("block_days")
    planned = folds.select("fold", "days", blocks).withColumn(
        "block_days",
        F.when(F.col("block_days") <= F.col("days"), F.col("block_days")).otherwise(
            F.raise_error(F.lit("A block may not exceed the days of its fold"))
        ),
    )
    # Replicates spread over tasks before they grow into blocks.
    spread = planned.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    last = F.ceil(F.col("days") / F.col("block_days")).cast("int") - 1
    numbered = spread.repartition("block_days", "replicate").withColumn(
        "number", F.explode(F.sequence(F.lit(0), last))
    )
    start = draw(
        seed, F.col("block_days"), F.col("fold"), F.col("replicate"), F.col("number"), F.col("days")
    )
    return numbered.withColumn("start", start)


def circular_blocks(folds: DataFrame, block_days, replicates: int, seed: int) -> DataFrame:
    """``block_days, replicate, fold, position, day_index``: wrapped blocks, cut to the day count."""
    starts = block_starts(folds, block_days, replicates, seed)
    steps = starts.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("block_days") - 1)))
    position = F.col("number") * F.col("block_days") + F.col("step")
    return steps.withColumn("position", position).where(F.col("position") < F.col("days")).select(
        "block_days",
        "replicate",
        "fold",
        "position",
        ((F.col("start") + F.col("step")) % F.col("days")).cast("int").alias("day_index"),
    )


def block_sums(losses: DataFrame, block_days) -> DataFrame:
    """Loss and weight of every circular run that a draw can hit.

    ``fold, model, block_days, start, length, loss, weight``. A run is as long as the block, or
    the remainder for the last block. There are days x 2 runs per block length, so a draw then
    needs one lookup per block instead of one per day.
    """
    sized = losses.join(fold_days(losses), "fold")
    block = F.explode(F.array(*[F.lit(b) for b in block_days])).alias("block_days")
    rest = F.col("days") % F.col("block_days")
    shapes = sized.select("*", block).withColumn(
        "length",
        F.explode(F.array_distinct(F.filter(F.array(F.col("block_days").cast("bigint"), rest.cast("bigint")), lambda n: n > 0))),
    )
    # A day belongs to the runs starting 0 .. length-1 days before it.
    member = shapes.withColumn("back", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1)))
    start = (F.col("day_index") - F.col("back") + F.col("days")) % F.col("days")
    return member.groupBy("fold", "model", "block_days", start.alias("start"), "length").agg(
        F.sum(F.col("rows") * F.col("mae")).alias("loss"), F.sum("rows").alias("weight")
    )


def bootstrap_mae(losses: DataFrame, block_days, replicates: int, seed: int) -> DataFrame:
    """``block_days, replicate, model, mae``: row-weighted MAE of every replicate.

    The same blocks are drawn for all models. The run table is small; Spark broadcasts it when
    its measured size allows. Draws of a replicate sit in one task, so their sums combine there.
    """
    starts = block_starts(fold_days(losses), block_days, replicates, seed)
    left = F.least(F.col("block_days"), F.col("days") - F.col("number") * F.col("block_days"))
    drawn = starts.select(
        "block_days", "replicate", "fold", "start", left.cast("bigint").alias("length")
    )
    runs = block_sums(losses, block_days)
    return (
        drawn.join(runs, ["fold", "block_days", "start", "length"])
        .groupBy("block_days", "replicate", "model")
        .agg((F.sum("loss") / F.sum("weight")).alias("mae"))
    )


def paired_draws(draws: DataFrame, contrasts) -> DataFrame:
    """Difference and relative reduction per replicate and contrast; a zero reference is an error."""
    sided = contrast_table(draws, contrasts)
    mine = lambda side: F.max(F.when(F.col("model") == F.col(side), F.col("mae")))
    paired = sided.groupBy("block_days", "replicate", "candidate", "reference").agg(
        mine("candidate").alias("c"), mine("reference").alias("r")
    )
    safe = F.when(F.col("r") > 0, F.col("r")).otherwise(
        F.raise_error(F.lit("The reference model makes no error, so no share of it can be given"))
    )
    return paired.select(
        "block_days",
        "replicate",
        "candidate",
        "reference",
        (F.col("c") - F.col("r")).alias("delta"),
        (100 * (1 - F.col("c") / safe)).alias("reduction"),
    )


def point_estimates(pooled: DataFrame, contrasts) -> DataFrame:
    sided = contrast_table(pooled.select("model", "mae"), contrasts)
    mine = lambda side: F.max(F.when(F.col("model") == F.col(side), F.col("mae")))
    return sided.groupBy("candidate", "reference").agg(
        mine("candidate").alias("c"), mine("reference").alias("r")
    ).select(
        "candidate",
        "reference",
        (F.col("c") - F.col("r")).alias("delta_mae"),
        (100 * (1 - F.col("c") / F.col("r"))).alias("relative_reduction_pct"),
    )


def intervals(draws, pooled, contrasts, primary_block, confidence, family_confidence=None) -> DataFrame:
    tails = [(1 - confidence) / 2, 1 - (1 - confidence) / 2]
    made = {
        "delta_mae_low": ("delta", tails[0]),
        "delta_mae_high": ("delta", tails[1]),
        "relative_reduction_pct_low": ("reduction", tails[0]),
        "relative_reduction_pct_high": ("reduction", tails[1]),
    }
    size = len(contrasts)
    if family_confidence is not None:
        wide = (1 - family_confidence) / (2 * size)
        made |= {
            "delta_mae_family_low": ("delta", wide),
            "delta_mae_family_high": ("delta", 1 - wide),
        }
    # One exact percentile call per column over at most `replicates` values per group.
    found = paired_draws(draws, contrasts).groupBy("block_days", "candidate", "reference").agg(
        *[F.percentile(column, F.lit(p)).alias(name) for name, (column, p) in made.items()]
    )
    role = F.when(F.col("block_days") == primary_block, F.lit("primary")).otherwise(F.lit("sensitivity"))
    joined = found.join(point_estimates(pooled, contrasts), ["candidate", "reference"]).withColumns(
        {"role": role, "confidence_level": F.lit(float(confidence))}
    )
    columns = [
        "block_days",
        "role",
        "confidence_level",
        "candidate",
        "reference",
        "delta_mae",
        "delta_mae_low",
        "delta_mae_high",
        "relative_reduction_pct",
        "relative_reduction_pct_low",
        "relative_reduction_pct_high",
    ]
    if family_confidence is None:
        return joined.select(*columns)
    return joined.select(
        *columns,
        "delta_mae_family_low",
        "delta_mae_family_high",
        F.lit(size).alias("family_size"),
        F.lit(1 - 2 * (1 - family_confidence) / (2 * size)).alias("per_contrast_confidence_level"),
    )


def contrast_intervals(draws, pooled, contrasts, primary_block, confidence=0.95) -> DataFrame:
    """Two-sided percentile intervals of each contrast around the pooled point estimate."""
    return intervals(draws, pooled, contrasts, primary_block, confidence)


def check_contrasts(contrasts, models) -> None:
    pairs = [tuple(c) for c in contrasts]
    if not pairs or len(set(pairs)) != len(pairs):
        raise ValueError("Contrasts must be unique and non-empty")
    if any(c == r or c not in models or r not in models for c, r in pairs):
        raise ValueError("Contrasts must pair two different scored models")


def family_intervals(
    draws, pooled, contrasts, primary_block, confidence=0.95, family_confidence=0.95
) -> DataFrame:
    """Adds Bonferroni-widened difference intervals over all contrasts."""
    if not 0 < family_confidence < 1:
        raise ValueError("family_confidence must lie between 0 and 1")
    return intervals(draws, pooled, contrasts, primary_block, confidence, family_confidence)


def block_sensitivity(
    losses: DataFrame, pooled, contrasts, block_days, primary_block, replicates, seed, confidence=0.95, weather_candidate=None
) -> DataFrame:
    """All block lengths in one job, with their role; with ``weather_role`` where a ``weather_candidate`` is named."""
    draws = bootstrap_mae(losses, block_days, replicates, seed)
    found = family_intervals(draws, pooled, contrasts, primary_block, confidence, confidence)
    return found if weather_candidate is None else with_weather_role(found, contrasts, weather_candidate)


def with_weather_role(found: DataFrame, contrasts, weather_candidate: str) -> DataFrame:
    """``weather_role``: primary for the delay that the study asks about, sensitivity for the other delays.

    A study whose contrasts never have ``weather_candidate`` on the candidate's side has no primary contrast: an error.
    """
    if all(candidate != weather_candidate for candidate, _ in contrasts):
        raise ValueError(f"No contrast has {weather_candidate} as its candidate")
    role = F.when(F.col("candidate") == weather_candidate, F.lit("primary")).otherwise(F.lit("sensitivity"))
    return found.withColumn("weather_role", role)


def linear_percentiles(draws: DataFrame, contrasts, probabilities) -> DataFrame:
    """Interpolated order statistics of the differences, written out as a second formulation.

    A group holds one value per replicate.
    """
    groups = ["block_days", "candidate", "reference"]
    values = paired_draws(draws, contrasts)
    ordered = Window.partitionBy(*groups).orderBy("delta", "replicate")
    ranked = values.select(
        *groups,
        "delta",
        (F.row_number().over(ordered) - 1).alias("rank"),
        F.count(F.lit(1)).over(Window.partitionBy(*groups)).alias("n"),
    )
    asked = ranked.withColumn(
        "probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    ).withColumn("at", F.col("probability") * (F.col("n") - 1))
    low, high = F.floor("at"), F.ceil("at")
    kept = asked.where((F.col("rank") == low) | (F.col("rank") == high))
    at_low = F.max(F.when(F.col("rank") == low, F.col("delta")))
    at_high = F.max(F.when(F.col("rank") == high, F.col("delta")))
    return kept.groupBy(*groups, "probability").agg(
        (at_low + (at_high - at_low) * F.max(F.col("at") - low)).alias("delta_mae")
    )
