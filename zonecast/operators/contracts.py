"""Data contracts as tables: ``check, bad_rows``; ``require`` raises when anything is bad."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast.functions.clock import elapsed_hours, hour_index, instant, is_hour
from zonecast.functions.tables import add_up, count_true, finite, rows_from_columns
from zonecast.settings import (
    BUNDLE_MAX_AGE_HOURS,
    PANEL_ZONE_ID_RANGE,
    QUALITY_STATES,
    TRIP_COLUMNS,
    WEATHER_VALUES,
    ZONE_ID_RANGE,
)

INT32_MAX = 2147483647


def require(checks: DataFrame) -> None:
    """Raise with the names of all failed checks. The table has a handful of rows."""
    failed = checks.where(F.col("bad_rows") > 0).collect()
    if failed:
        raise ValueError("; ".join(f"{r['check']}: {r['bad_rows']}" for r in failed))


def check_rows(frame: DataFrame, names: list[str]) -> DataFrame:
    return rows_from_columns(frame, names, "check", "bad_rows")


def tally(frame: DataFrame, **conditions: Column) -> DataFrame:
    """Count rows per named condition in one pass."""
    counts = [count_true(c).alias(name) for name, c in conditions.items()]
    return check_rows(frame.agg(*counts), list(conditions))


def stack(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def duplicate_keys(frame: DataFrame, keys: list[str], name: str = "duplicate_key") -> DataFrame:
    """Surplus rows beyond one per key."""
    counted = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return check_rows(counted.agg(add_up(F.col("n") - 1).alias(name)), [name])


def unmatched(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows of ``left`` whose key is absent on the right."""
    keyed = right.select(*keys).distinct()
    missing = left.join(keyed, keys, "left_anti")
    return check_rows(missing.agg(F.count(F.lit(1)).alias(name)), [name])


def schema_breaches(schema: T.StructType, required=TRIP_COLUMNS, vendor: bool = False) -> dict[str, list[str]]:
    """Per rule the columns that break it: required ones that lack, zoned times, fractional ids, types that can't be grouped."""
    types = {f.name: f.dataType for f in schema.fields}
    wanted = [*required, "VendorID"] if vendor else list(required)
    held = [name for name in required if name in types]
    return {
        "missing_column": [name for name in wanted if name not in types],
        "zoned_time": [n for n in held if n.endswith("_datetime") and not isinstance(types[n], T.TimestampNTZType)],
        "fractional_id": [n for n in held if n.endswith("LocationID") and not isinstance(types[n], T.IntegralType)],
        "map_column": [name for name, kind in types.items() if isinstance(kind, T.MapType)],
    }


def check_trip_schema(trips: DataFrame, required=TRIP_COLUMNS, vendor: bool = False) -> None:
    """Required columns, naive timestamps, integer ids, groupable types. Reads no data."""
    said = {
        "missing_column": "Missing trip columns",
        "zoned_time": "Trip times must be timestamps without time zone",
        "fractional_id": "Trip zones must be an integer",
        "map_column": "Map columns cannot be grouped for exact duplicates",
    }
    for rule, columns in schema_breaches(trips.schema, required, vendor).items():
        if columns:
            raise ValueError(f"{said[rule]}: {columns}")


def check_file_schemas(spark: SparkSession, schemas: list[tuple[str, T.StructType]], required=TRIP_COLUMNS) -> DataFrame:
    """``file, check, bad_columns`` per path and rule: the same rules for each file, before any row is read."""
    rows = [(path, rule, len(bad)) for path, schema in schemas for rule, bad in schema_breaches(schema, required).items()]
    return spark.createDataFrame(rows, "file string, check string, bad_columns long")


def check_zones(raw: DataFrame, boroughs, id_range=ZONE_ID_RANGE) -> DataFrame:
    """Duplicate ids are counted before the borough filter, range and emptiness after it."""
    kept = raw.where(F.col("Borough").isin(*boroughs))
    ranged = kept.agg(
        (F.count(F.lit(1)) == 0).cast("bigint").alias("empty_lookup"),
        count_true(~F.coalesce(F.col("LocationID").between(*id_range), F.lit(False))).alias(
            "id_out_of_range"
        ),
    )
    return stack(
        duplicate_keys(raw, ["LocationID"], "duplicate_id"),
        check_rows(ranged, ["empty_lookup", "id_out_of_range"]),
    )


def check_panel(
    panel: DataFrame, id_range=PANEL_ZONE_ID_RANGE, allow_future_target: bool = False
) -> DataFrame:
    """Aligned hours, unique keys, valid ids, contiguous history, valid counts.

    Contiguity needs no window: a zone is gap-free when its distinct hours fill its span.
    """
    y = F.col("demand").cast("double")
    keyed = panel.groupBy("zone_id", "hour").agg(
        F.count(F.lit(1)).alias("n"),
        count_true(F.col("demand").isNull() | F.isnan(y)).alias("nulls"),
        count_true(F.col("demand").isNotNull() & (~finite(y) | (y < 0) | (y % 1 != 0))).alias("bad"),
    )
    per_zone = keyed.groupBy("zone_id").agg(
        F.sum(F.col("n") - 1).alias("duplicates"),
        F.sum(F.when(F.col("hour").isNull() | ~is_hour(F.col("hour")), F.col("n")).otherwise(0)).alias(
            "misaligned"
        ),
        (F.max(hour_index(F.col("hour"))) - F.min(hour_index(F.col("hour"))) + 1).alias("span"),
        F.countDistinct(hour_index(F.col("hour"))).alias("present"),
        F.sum("n").alias("n"),
        F.sum("nulls").alias("nulls"),
        F.max_by("nulls", "hour").alias("last_nulls"),
        F.sum("bad").alias("bad"),
    )
    forgiven = F.col("last_nulls") if allow_future_target else F.lit(0)
    outside = ~F.coalesce(F.col("zone_id").between(*id_range), F.lit(False))
    totals = per_zone.agg(
        add_up("misaligned").alias("misaligned_hour"),
        add_up("duplicates").alias("duplicate_key"),
        add_up(F.when(outside, F.col("n")).otherwise(0)).alias("zone_out_of_range"),
        add_up(F.col("span") - F.col("present")).alias("missing_hour"),
        add_up(F.col("nulls") - forgiven).alias("missing_demand"),
        add_up("bad").alias("invalid_demand"),
    )
    return check_rows(
        totals,
        [
            "misaligned_hour",
            "duplicate_key",
            "zone_out_of_range",
            "missing_hour",
            "missing_demand",
            "invalid_demand",
        ],
    )


def check_complete_window(frame: DataFrame, zones: DataFrame, start, stop) -> DataFrame:
    """Every zone holds exactly the hours of ``[start, stop)``; one row per broken zone rule."""
    begin, end = instant(start), instant(stop)
    expected = hour_index(end) - hour_index(begin)
    hour = F.col("hour")
    keyed = frame.groupBy("zone_id", "hour").agg(F.count(F.lit(1)).alias("n"))
    coverage = keyed.groupBy("zone_id").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") - 1).alias("surplus"),
        F.min("hour").alias("low"),
        F.max("hour").alias("high"),
        count_true(hour.isNull() | ~is_hour(hour)).alias("misaligned"),
    )
    known = zones.select("zone_id").distinct().withColumn("listed", F.lit(True))
    joined = coverage.join(known, "zone_id", "full_outer")
    seen = F.col("n").isNotNull()
    return tally(
        joined,
        missing_zone=~seen,
        unknown_zone=F.col("listed").isNull(),
        wrong_hour_count=seen & (F.col("n") != expected),
        wrong_first_hour=seen & (F.col("low") != begin),
        wrong_last_hour=seen & (F.col("high") != end - F.make_dt_interval(hours=F.lit(1))),
        duplicate_key=F.col("surplus") > 0,
        misaligned_hour=F.col("misaligned") > 0,
    )


def check_counts(counts: DataFrame, zones: DataFrame, start, stop) -> DataFrame:
    """Sparse counts before densifying: integral int32, unique, inside the zone and hour grid."""
    y = F.col("demand").cast("double")
    hour = F.col("hour")
    listed = zones.select("zone_id").distinct().withColumn("listed", F.lit(True))
    flagged = counts.join(listed, "zone_id", "left")
    rows = tally(
        flagged,
        missing_hour=hour.isNull(),
        not_finite=F.col("demand").isNull() | ~finite(y),
        negative=y < 0,
        not_integral=y % 1 != 0,
        above_int32=y > INT32_MAX,
        outside_zones=F.col("listed").isNull(),
        outside_hours=(hour < instant(start)) | (hour >= instant(stop)) | ~is_hour(hour),
    )
    return stack(rows, duplicate_keys(counts, ["zone_id", "hour"]))


def check_volume_series(series: DataFrame) -> DataFrame:
    """Reporting series: named, unique, aligned, contiguous, integral non-negative counts."""
    y = F.col("demand").cast("double")
    hour = F.col("hour")
    keyed = series.groupBy("series", "hour").agg(
        F.count(F.lit(1)).alias("n"),
        count_true(
            F.col("demand").isNull() | ~finite(y) | (y < 0) | (y % 1 != 0)
        ).alias("bad"),
    )
    per_series = keyed.groupBy("series").agg(
        F.sum(F.col("n") - 1).alias("duplicates"),
        F.sum(F.when(F.col("series").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        count_true(hour.isNull() | ~is_hour(hour)).alias("misaligned"),
        (F.max(hour_index(hour)) - F.min(hour_index(hour)) + 1).alias("span"),
        F.countDistinct(hour_index(hour)).alias("present"),
        F.sum("bad").alias("bad"),
    )
    totals = per_series.agg(
        add_up("unnamed").alias("missing_series"),
        add_up("duplicates").alias("duplicate_key"),
        add_up("misaligned").alias("misaligned_hour"),
        add_up(F.col("span") - F.col("present")).alias("missing_hour"),
        add_up("bad").alias("invalid_demand"),
        (F.count(F.lit(1)) == 0).cast("bigint").alias("empty_input"),
    )
    return check_rows(totals, totals.columns)


def check_observations(observations: DataFrame, values=WEATHER_VALUES) -> DataFrame:
    """Named stations, present times, unique (station, time), finite or missing values."""
    for name in values:
        kind = observations.schema[name].dataType
        if not isinstance(kind, T.NumericType):
            raise ValueError(f"{name} must be numeric")
    infinite = {
        f"infinite_{v}": F.col(v).cast("double").isin(float("inf"), float("-inf")) for v in values
    }
    rows = tally(
        observations,
        missing_station=F.col("station_id").isNull(),
        missing_time=F.col("observed_at").isNull(),
        **infinite,
    )
    return stack(rows, duplicate_keys(observations, ["station_id", "observed_at"]))


def check_targets(targets: DataFrame) -> DataFrame:
    """Target hours: present, unique, aligned, contiguous."""
    hour = F.col("hour")
    keyed = targets.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    totals = keyed.agg(
        count_true(hour.isNull()).alias("missing_target"),
        add_up(F.col("n") - 1).alias("duplicate_target"),
        count_true(~is_hour(hour)).alias("misaligned_target"),
        F.coalesce(
            F.max(hour_index(hour)) - F.min(hour_index(hour)) + 1 - F.countDistinct(hour_index(hour)),
            F.lit(0),
        ).alias("missing_hour"),
    )
    return check_rows(totals, totals.columns)


def check_snapshots(
    snapshots: DataFrame,
    stations: list[str],
    targets: DataFrame,
    delay_hours: int,
    values=WEATHER_VALUES,
    max_age_hours: int = BUNDLE_MAX_AGE_HOURS,
) -> DataFrame:
    """One delay scenario: exact station x target grid, past-only metadata, consistent quality."""
    chosen = snapshots.where(F.col("delay_hours") == delay_hours)
    grid = targets.select(
        "hour", F.explode(F.array(*[F.lit(s) for s in stations])).alias("station_id")
    )
    keys = ["station_id", "hour"]
    seen, at = F.col("observed_at"), F.col("assumed_available_at")
    matched = seen.isNotNull()
    age = F.col("age_hours")
    delay = F.make_dt_interval(hours=F.lit(delay_hours))
    rules = {
        "metadata_not_missing_together": matched != at.isNotNull(),
        "wrong_availability": matched & (at != seen + delay),
        "not_strictly_past": matched & (at >= F.col("hour")),
        "age_out_of_range": matched & ~F.coalesce((age > 0) & (age <= max_age_hours), F.lit(False)),
        "age_disagrees": matched & (F.abs(age - elapsed_hours(F.col("hour"), seen)) > 1e-9),
        "age_without_observation": ~matched & age.isNotNull(),
    }
    unknown, mismatch, unmatched_quality = F.lit(False), F.lit(False), F.lit(False)
    for value in values:
        state = F.col(f"{value}_quality")
        accepted = F.coalesce(state.isin("good", "unverified"), F.lit(False))
        unknown = unknown | ~F.coalesce(state.isin(*QUALITY_STATES), F.lit(False))
        mismatch = mismatch | (accepted != F.col(value).isNotNull())
        unmatched_quality = unmatched_quality | (~matched & ~F.coalesce(state == "missing", F.lit(False)))
    rules |= {
        "unknown_quality": unknown,
        "quality_disagrees_with_value": mismatch,
        "unmatched_not_missing": unmatched_quality,
    }
    return stack(
        tally(chosen, **rules),
        duplicate_keys(chosen, keys),
        unmatched(grid, chosen, keys, "missing_snapshot"),
        unmatched(chosen, grid, keys, "unexpected_snapshot"),
    )


def check_scores_input(predictions: DataFrame, models: list[str], actual: str = "demand") -> DataFrame:
    """Score inputs: non-empty, finite, non-negative predictions, finite labels."""
    def bad(name):
        value = F.col(name).cast("double")
        return F.col(name).isNull() | ~finite(value) | (value < 0)

    label = F.col(actual).cast("double")
    counts = [
        (F.count(F.lit(1)) == 0).cast("bigint").alias("empty_input"),
        count_true(F.col(actual).isNull() | ~finite(label)).alias("invalid_label"),
        *[count_true(bad(m)).alias(f"invalid_{m}") for m in models],
    ]
    totals = predictions.agg(*counts)
    return check_rows(totals, totals.columns)


def close(left: Column, right: Column, rtol: float, atol: float) -> Column:
    """Equal within ``atol + rtol * |right|``; NULL equals NULL."""
    near = F.abs(left - right) <= atol + rtol * F.abs(right)
    return F.when(left.isNull() | right.isNull(), left.isNull() & right.isNull()).otherwise(near)


def check_daily_errors(
    daily: DataFrame,
    weights: DataFrame,
    fold_mae: DataFrame,
    pooled_mae: DataFrame,
    models: list[str],
    rtol: float = 1e-10,
    atol: float = 1e-12,
) -> DataFrame:
    """Daily error table against the expected fold x day x model grid and the stored scores.

    ``weights`` is ``day_weights``; ``fold_mae`` is ``fold, model, mae`` and ``pooled_mae``
    is ``model, mae``.
    """
    keys = ["fold", "date_nyc", "model"]
    rows, mae = F.col("rows").cast("double"), F.col("mae")
    valid_date = F.coalesce(F.col("date_nyc").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) & (
        F.try_to_date("date_nyc", "yyyy-MM-dd").isNotNull()
    )
    basic = tally(
        daily,
        missing_value=F.greatest(*[F.col(c).isNull() for c in [*keys, "rows", "mae"]]),
        bad_date=~valid_date,
        invalid_number=~finite(rows) | ~finite(mae) | (rows < 0) | (mae < 0),
    )
    grid = weights.select(
        "fold",
        "date_nyc",
        F.col("rows").alias("expected_rows"),
        F.explode(F.array(*[F.lit(m) for m in models])).alias("model"),
    )
    joined = daily.join(grid, keys, "full_outer")
    coverage = tally(
        joined,
        missing_cell=F.col("mae").isNull(),
        unexpected_cell=F.col("expected_rows").isNull(),
        wrong_row_count=F.col("rows") != F.col("expected_rows"),
    )
    total = F.sum(rows * mae) / F.sum(rows)
    by_fold = daily.groupBy("fold", "model").agg(total.alias("observed")).join(
        fold_mae.select("fold", "model", F.col("mae").alias("stored")), ["fold", "model"], "full_outer"
    )
    by_model = daily.groupBy("model").agg(total.alias("observed")).join(
        pooled_mae.select("model", F.col("mae").alias("stored")), ["model"], "full_outer"
    )
    off = ~close(F.col("observed"), F.col("stored"), rtol, atol)
    return stack(
        basic,
        duplicate_keys(daily, keys),
        coverage,
        tally(by_fold, fold_mae_disagrees=off),
        tally(by_model, pooled_mae_disagrees=off),
    )


def check_abs_error_sums(daily: DataFrame, rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """``absolute_error_sum`` is finite, non-negative and equal to rows x MAE."""
    total = F.col("absolute_error_sum")
    expected = F.col("rows").cast("double") * F.col("mae")
    return tally(
        daily,
        invalid_total=total.isNull() | ~finite(total) | (total < 0),
        total_disagrees=~close(total, expected, rtol, atol),
    )


def check_append(left: DataFrame, bundle: DataFrame, values: list[str]) -> DataFrame:
    """Bundle keys are unique, hourly and complete for the left side; no clash, no infinities."""
    clash = len(set(values) & set(left.columns))
    infinite = F.lit(False)
    for name in values:
        infinite = infinite | F.col(name).cast("double").isin(float("inf"), float("-inf"))
    counted = bundle.agg(
        count_true(F.col("hour").isNull() | ~is_hour(F.col("hour"))).alias("bad_key"),
        count_true(infinite).alias("infinite_value"),
        F.lit(clash).cast("bigint").alias("column_clash"),
    )
    # Distinct hours first: the anti join then works on hours, not on all left rows.
    wanted = left.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    lost = wanted.join(bundle.select("hour").distinct(), "hour", "left_anti")
    return stack(
        check_rows(counted, counted.columns),
        duplicate_keys(bundle, ["hour"], "duplicate_hour"),
        check_rows(lost.agg(add_up("n").alias("left_row_without_hour")), ["left_row_without_hour"]),
    )


def check_export(
    nested: DataFrame, zones: DataFrame, columns: int, expected_hours: int | None = None
) -> DataFrame:
    """Nested export: unique ids, unique hours, arrays aligned to zones and columns, valid cells.

    Rows of a DataFrame carry no order, so "strictly increasing" is unique hours here; the
    writer sorts.
    """
    ids = zones.agg(
        F.countDistinct("zone_id").alias("unique_ids"), F.count(F.lit(1)).alias("all_ids")
    )
    listed = ids.select("unique_ids").scalar()
    cells = F.col("values")
    rows = tally(
        nested,
        zone_count_mismatch=F.size(cells) != listed,
        column_count_mismatch=F.exists(cells, lambda r: F.size(r) != columns),
        invalid_cell=F.exists(
            cells,
            lambda r: F.exists(
                r, lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))
            ),
        ),
        missing_hour=F.col("hour").isNull(),
    )
    tables = [
        check_rows(
            ids.select((F.col("all_ids") - F.col("unique_ids")).alias("duplicate_zone")),
            ["duplicate_zone"],
        ),
        rows,
        duplicate_keys(nested, ["hour"], "repeated_hour"),
    ]
    if expected_hours is not None:
        short = nested.agg(F.abs(F.count(F.lit(1)) - expected_hours).alias("wrong_hour_count"))
        tables.append(check_rows(short, ["wrong_hour_count"]))
    return stack(*tables)


def reconcile_tables(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """``side, rows``: rows of one table without a partner in the other, duplicates counted.

    Equal rows are counted on each side before they meet, so repeated rows stay one row in the
    shuffle.
    """
    both = left.select(*columns, F.lit(1).alias("sign")).unionByName(
        right.select(*columns, F.lit(-1).alias("sign"))
    )
    surplus = both.groupBy(*columns).agg(F.sum("sign").alias("balance"))
    totals = surplus.agg(
        add_up(F.greatest(F.col("balance"), F.lit(0))).alias("left_only"),
        add_up(F.greatest(-F.col("balance"), F.lit(0))).alias("right_only"),
    )
    return rows_from_columns(totals, ["left_only", "right_only"], "side", "rows")


def row_hash(columns: list[str]) -> Column:
    """60 bits of the MD5 of the row text; NULL has its own mark."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def table_fingerprint(frame: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``rows, hash_sum, hash_xor``: order-free content identity of the chosen columns."""
    hashed = frame.select(*(by or []), row_hash(columns).alias("h"))
    return hashed.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"),
    )


def reconcile_scores(
    stored: DataFrame,
    recomputed: DataFrame,
    keys: list[str],
    metrics: list[str],
    rtol: float = 1e-12,
    atol: float = 1e-12,
) -> DataFrame:
    """``metric, compared, mismatched, max_abs_diff`` of two score tables; NULL equals NULL.

    A key held by one side only counts as compared and mismatched.
    """
    def long(table, name):
        return table.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
            keys, metrics, "metric", name
        ).withColumn(f"has_{name}", F.lit(True))

    joined = long(stored, "left_value").join(
        long(recomputed, "right_value"), [*keys, "metric"], "full_outer"
    )
    paired = F.col("has_left_value").isNotNull() & F.col("has_right_value").isNotNull()
    same = paired & close(F.col("right_value"), F.col("left_value"), rtol, atol)
    return joined.groupBy("metric").agg(
        F.count(F.lit(1)).alias("compared"),
        count_true(~same).alias("mismatched"),
        F.coalesce(F.max(F.abs(F.col("left_value") - F.col("right_value"))), F.lit(0.0)).alias(
            "max_abs_diff"
        ),
    )


def check_keys(stored: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """The stored table holds exactly the expected keys, once each."""
    left = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    right = expected.select(*keys).distinct().withColumn("listed", F.lit(True))
    joined = left.join(right, keys, "full_outer")
    return tally(
        joined,
        missing_key=F.col("n").isNull(),
        unexpected_key=F.col("listed").isNull(),
        duplicate_key=F.col("n") > 1,
    )


def check_conservation(before: DataFrame, after: DataFrame, column: str = "demand") -> DataFrame:
    """Totals before and after a step agree."""
    tagged = before.select(F.col(column).cast("bigint").alias("v")).unionByName(
        after.select((-F.col(column)).cast("bigint").alias("v"))
    )
    return check_rows(
        tagged.agg(F.abs(add_up("v")).alias("total_difference")), ["total_difference"]
    )

