"""Exact quantiles (linear interpolation) that never put one whole column into one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def exact_quantiles(
    frame: DataFrame, keys: list[str], value: str, probabilities, buckets: int = BUCKETS
) -> DataFrame:
    """``keys, probability, quantile`` for every probability.

    Equal values are counted first, so a hot value is one row. A mergeable sketch of the distinct
    values gives bucket edges; bucket sizes locate the two order statistics each probability
    needs, and only the buckets holding them are ranked, one bucket per task. The sketch only
    chooses how the work is split, the answer is exact. Keys are few (names of features, or none), so what is
    joined to the rows has at most keys x ``buckets`` rows and is sent to them.
    """
    # A constant key keeps the ungrouped case on the same path.
    keyed = frame.withColumn("_all", F.lit(0))
    keys = [*keys, "_all"]
    counted = (
        keyed.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = counted.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx("_v", steps, F.lit(20 * buckets))).alias("_edges")
    )
    placed = counted.join(F.broadcast(edges), keys).withColumn(
        "_bucket", F.size(F.filter("_edges", lambda e: e < F.col("_v")))
    ).drop("_edges")
    sizes = placed.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_size"))
    # At most `buckets` rows per key from here on.
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    located = sizes.select(
        *keys,
        "_bucket",
        (F.sum("_size").over(upto) - F.col("_size")).alias("_before"),
        F.sum("_size").over(upto).alias("_through"),
        F.sum("_size").over(whole).alias("_total"),
    )
    wanted = located.select(
        *keys,
        "_bucket",
        "_before",
        "_through",
        F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability"),
        ((F.col("_total") - 1).cast("double")).alias("_last"),
    ).withColumn("_at", F.col("probability") * F.col("_last"))
    low, high = F.floor("_at"), F.ceil("_at")
    inside = lambda rank: (rank >= F.col("_before")) & (rank < F.col("_through"))
    wanted = wanted.withColumn("_low", low).withColumn("_high", high).where(
        inside(F.col("_low")) | inside(F.col("_high"))
    )
    needed = wanted.select(*keys, "_bucket", "_before").distinct()
    in_bucket = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = placed.join(F.broadcast(needed), [*keys, "_bucket"]).withColumn(
        "_to", F.col("_before") + F.sum("_n").over(in_bucket)
    ).withColumn("_from", F.col("_to") - F.col("_n"))
    wanted = wanted.select(*keys, "_bucket", "probability", "_at", "_low", "_high")
    holds = lambda rank: (F.col(rank) >= F.col("_from")) & (F.col(rank) < F.col("_to"))
    picked = (
        ranked.join(F.broadcast(wanted), [*keys, "_bucket"])
        .where(holds("_low") | holds("_high"))
        .groupBy(*keys, "probability")
        .agg(
            F.max(F.when(holds("_low"), F.col("_v"))).alias("_lo"),
            F.max(F.when(holds("_high"), F.col("_v"))).alias("_hi"),
            F.max(F.col("_at") - F.col("_low")).alias("_share"),
        )
    )
    out = [k for k in keys if k != "_all"]
    return picked.select(
        *out,
        "probability",
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_share")).alias("quantile"),
    )
