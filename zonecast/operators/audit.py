"""Data-quality audit: exact duplicates, reporting volumes, label sensitivity."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.functions.clock import hour_floor, hours, month_text, resolved, to_local
from zonecast.functions.tables import add_up, count_true
from zonecast.operators.panel import PICKUP, ZONE, with_spine
from zonecast.settings import REFERENCE_WEEKS


def development_range(trips: DataFrame, start: str, sealed: str) -> DataFrame:
    """File months of the development window and their trips. Sealed months are never read."""
    pickup_month = F.col("file_month")
    last = F.substring(F.date_sub(F.lit(sealed).cast("date"), 1).cast("string"), 1, 7)
    inside = trips.where((pickup_month >= F.lit(start[:7])) & (pickup_month <= last))
    return inside.groupBy(pickup_month.alias("month")).agg(F.count(F.lit(1)).alias("trips"))


# 64-bit words of the filter that says which rows may repeat: 4 MB, 16 million bits.
FILTER_WORDS = 1 << 18


def every_column(frame: DataFrame) -> list[Column]:
    return [F.col(f"`{name.replace('`', '``')}`") for name in frame.columns]


def row_digest(frame: DataFrame) -> Column:
    """64 bits of all columns. The hash passes over NULLs, so where they stand is hashed too."""
    cells = every_column(frame)
    return F.xxhash64(F.array(*[cell.isNull() for cell in cells]), *cells)


def suspected_rows(frame: DataFrame, filter_words: int = FILTER_WORDS) -> DataFrame:
    """All rows that have a copy and some that have none: what is left to group exactly.

    Every row's digest is counted, which moves 16 bytes for a row without a copy. The digests that repeat set bits of a
    filter of at most ``filter_words`` words, whatever the number of rows, and the rows whose bit is not set
    have no copy. A fuller filter lets more rows pass and loses none.
    """
    place = lambda digest: (
        F.pmod(digest, F.lit(filter_words)).alias("word"),
        F.pmod(F.shiftrightunsigned(digest, 40), F.lit(64)).cast("int").alias("bit"),
    )
    counted = frame.select(row_digest(frame).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    repeated = counted.where("copies > 1").select(*place(F.col("digest")))
    bits = repeated.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    rows = frame.select(F.struct("*").alias("row"), *place(row_digest(frame)))
    # Broadcast by a proven bound: one row per word of the filter.
    return rows.join(F.broadcast(bits), "word").where(F.getbit("bits", F.col("bit")) == 1).select("row.*")


def exact_duplicates(frame: DataFrame, filter_words: int = FILTER_WORDS) -> DataFrame:
    """Groups of rows equal in every column (NULL equals NULL) with ``copies`` > 1.

    Only rows whose digest repeats are grouped, and those on all columns, so the digest decides nothing. Their copies are
    counted before the shuffle: a row repeated a billion times moves as one row per task.
    """
    suspected = suspected_rows(frame, filter_words)
    return suspected.groupBy(*every_column(frame)).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def duplicate_rollup(duplicates: DataFrame, zone: str = ZONE, pickup: str = PICKUP) -> DataFrame:
    """Per zone and UTC hour: surplus copies, groups, repeated rows, largest group."""
    local = duplicates.groupBy(
        F.col(zone).cast("int").alias("zone_id"), hour_floor(F.col(pickup)).alias("hour")
    ).agg(
        F.sum(F.col("copies") - 1).alias("duplicate_excess"),
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.sum("copies").alias("repeated_rows"),
        F.max("copies").alias("max_copies"),
    )
    return resolved(local)


def trip_cells(trips: DataFrame, zone: str = ZONE, vendor: str = "VendorID", pickup: str = PICKUP) -> DataFrame:
    """Trips per zone, local hour and vendor: what all counts of the audit are sums of."""
    name = F.coalesce(F.col(vendor).cast("string"), F.lit("missing"))
    return trips.groupBy(
        F.col(zone).cast("int").alias("zone_id"), hour_floor(F.col(pickup)).alias("hour"), name.alias("vendor")
    ).agg(F.count(F.lit(1)).alias("demand"))


def vendor_counts(trips: DataFrame, vendor: str = "VendorID", pickup: str = PICKUP) -> DataFrame:
    """Eligible trips per vendor and UTC hour; a missing vendor is its own series."""
    name = F.coalesce(F.col(vendor).cast("string"), F.lit("missing"))
    local = trips.groupBy(name.alias("vendor"), hour_floor(F.col(pickup)).alias("hour")).agg(
        F.count(F.lit(1)).alias("demand")
    )
    return resolved(local)


def city_totals(panel: DataFrame) -> DataFrame:
    return panel.groupBy("hour").agg(F.sum("demand").alias("demand"))


def series_grid(vendors: DataFrame, city: DataFrame, start, stop) -> DataFrame:
    """Zero-filled vendor series and the city series as ``series, hour, demand``."""
    empty = with_spine(vendors.select("vendor").distinct(), start, stop).withColumn(
        "demand", F.lit(0).cast("bigint")
    )
    filled = (
        empty.unionByName(vendors.select("vendor", "hour", "demand"))
        .groupBy(F.concat(F.lit("vendor_"), F.col("vendor")).alias("series"), "hour")
        .agg(F.sum("demand").alias("demand"))
    )
    return filled.unionByName(city.select(F.lit("city").alias("series"), "hour", "demand"))


def reporting_volume_flags(
    series: DataFrame,
    min_reference: float = 100,
    fraction: float = 0.1,
    minimum_matches: int = 3,
    weeks=REFERENCE_WEEKS,
) -> DataFrame:
    """Each hour against the median of the same elapsed hour of the preceding weeks.

    Every row is sent forward to the hours it is a reference for, then one aggregation by
    (series, hour) meets them. There is no window over a whole series, so a few long series
    still spread over all tasks.
    """
    if min_reference <= 0 or not 0 < fraction < 1:
        raise ValueError("min_reference must be positive and fraction between 0 and 1")
    offsets = F.array(*[F.lit(168 * w) for w in (0, *weeks)])
    sent = series.select("series", "hour", "demand", F.explode(offsets).alias("ahead")).select(
        "series", (F.col("hour") + hours(F.col("ahead"))).alias("hour"), "demand", "ahead"
    )
    met = sent.groupBy("series", "hour").agg(
        F.max(F.when(F.col("ahead") == 0, F.col("demand"))).alias("demand"),
        count_true(F.col("ahead") == 0).alias("own"),
        F.array_sort(
            F.collect_list(F.when(F.col("ahead") > 0, F.col("demand").cast("double")))
        ).alias("prior"),
    ).where("own > 0")
    n = F.size("prior")
    middle = (
        F.get("prior", F.floor((n - 1) / 2).cast("int")) + F.get("prior", F.floor(n / 2).cast("int"))
    ) / 2
    scored = met.select(
        "series",
        "hour",
        "demand",
        n.alias("reference_matches"),
        F.when(n > 0, middle).alias("historical_median"),
    ).withColumn(
        "coverage_ratio",
        F.when(F.col("historical_median") > 0, F.col("demand") / F.col("historical_median")),
    )
    low = (
        (F.col("reference_matches") >= minimum_matches)
        & (F.col("historical_median") >= min_reference)
        & (F.col("coverage_ratio") < fraction)
    )
    return scored.withColumn("flag", F.coalesce(low, F.lit(False)))


def flagged_hours(flags: DataFrame) -> DataFrame:
    return flags.where("flag").withColumn("hour_nyc", to_local(F.col("hour")))


def dedup_panel(panel: DataFrame, rollup: DataFrame) -> DataFrame:
    """Alternate labels: demand without surplus copies, plus ``duplicate_excess``."""
    joined = panel.join(
        rollup.select("zone_id", "hour", "duplicate_excess"), ["zone_id", "hour"], "left"
    )
    excess = F.coalesce(F.col("duplicate_excess"), F.lit(0)).cast("int")
    return joined.withColumn("duplicate_excess", excess).withColumn(
        "demand", F.col("demand") - F.col("duplicate_excess")
    )


def duplicates_by_month(counts: DataFrame, rollup: DataFrame) -> DataFrame:
    """Per local month: eligible pickups and duplicate totals; ``max_copies`` is 1 without any."""
    month = month_text(to_local(F.col("hour"))).alias("month")
    eligible = counts.groupBy(month).agg(F.sum("demand").alias("eligible_pickups"))
    repeated = rollup.groupBy(month).agg(
        F.sum("duplicate_excess").alias("excess"),
        F.sum("duplicate_groups").alias("groups"),
        F.sum("repeated_rows").alias("repeated"),
        F.max("max_copies").alias("largest"),
        F.count(F.lit(1)).alias("cells"),
    )
    zero = F.lit(0).cast("bigint")
    return eligible.join(repeated, "month", "left").select(
        "month",
        "eligible_pickups",
        F.coalesce("excess", zero).alias("exact_duplicate_excess"),
        F.coalesce("groups", zero).alias("exact_duplicate_groups"),
        F.coalesce("repeated", zero).alias("repeated_rows"),
        F.coalesce("largest", F.lit(1).cast("bigint")).alias("max_copies"),
        F.coalesce("cells", zero).alias("affected_zone_hours"),
    )


def duplicates_by_zone(alternative: DataFrame) -> DataFrame:
    return alternative.groupBy("zone_id", "Zone", "borough").agg(
        F.sum("duplicate_excess").alias("exact_duplicate_excess"),
        count_true(F.col("duplicate_excess") > 0).alias("affected_zone_hours"),
    )


def series_summary(flags: DataFrame) -> DataFrame:
    return flags.groupBy("series").agg(
        add_up("demand").alias("pickups"),
        count_true(F.col("demand") == 0).alias("zero_hours"),
        count_true(F.col("flag")).alias("flags"),
    )


def duplicate_share(alternative: DataFrame) -> DataFrame:
    """Surplus copies, their share of recorded pickups in percent, largest reduction, cells."""
    excess = F.sum("duplicate_excess")
    recorded = F.sum(F.col("demand") + F.col("duplicate_excess"))
    return alternative.agg(
        excess.alias("exact_duplicate_excess"),
        (100.0 * excess / recorded).alias("exact_duplicate_excess_pct"),
        F.max("duplicate_excess").cast("bigint").alias("max_zone_hour_reduction"),
        count_true(F.col("duplicate_excess") > 0).alias("affected_zone_hours"),
    )
