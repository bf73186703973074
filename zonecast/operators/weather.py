"""Station observations: parsing, per-value quality, past-only snapshots, hourly bundles."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecast.functions.clock import elapsed_hours, hour_floor, hour_index, hours, instant, month_text, to_local
from zonecast.functions.tables import count_true, long_models
from zonecast.operators.contracts import duplicate_keys, stack, tally
from zonecast.operators.panel import with_spine
from zonecast.operators.temporal import STRETCH_HOURS
from zonecast.settings import (
    AUDITED_FIELDS,
    DELAYS,
    HOURLY_REPORTS,
    HOURLY_SOURCE,
    ISO_SECONDS,
    PRIMARY_QUALITY,
    PRIMARY_REPORTS,
    PRIMARY_SOURCE,
    SYNOPTIC_REPORTS,
    SYNOPTIC_SOURCE,
    WEATHER_FIELDS,
    WEATHER_VALUES,
    WIND_MEASUREMENTS,
)
from zonecast.sources.tables import project_station_rows

OBSERVATION = ["station_id", "observed_at"]
STATES = [f"{v}_{kind}" for v in WEATHER_VALUES for kind in ("quality", "source")]


def attribute(field: str, suffix: str) -> Column:
    return F.coalesce(F.col(field + suffix).cast("string"), F.lit(""))


def parse_observations(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Bounded station rows with ``station_id``, ``observed_at`` and numeric values.

    The time bound is applied to the ISO text before anything else is looked at. Text that is not
    a number is an error (ANSI cast).
    """
    bounded = project_station_rows(raw, start, end)
    typed = bounded.withColumns(
        {
            "observed_at": F.to_timestamp_ntz("DATE", F.lit("yyyy-MM-dd'T'HH:mm:ss")),
            **{field: F.col(field).cast("double") for field in AUDITED_FIELDS},
        }
    )
    return typed.withColumnRenamed("STATION", "station_id")


def check_station(raw: DataFrame, stations: dict, start: str, end: str, tolerance: float = 0.01) -> DataFrame:
    """ISO dates everywhere; inside the window known stations, coordinates, unique times, no
    infinities. ``stations`` maps an id to ``(latitude, longitude)``."""
    bounded = project_station_rows(raw, start, end)
    known = F.col("STATION").isin(*stations)
    off = F.lit(False)
    for name, (latitude, longitude) in stations.items():
        near = (F.abs(F.col("LATITUDE").cast("double") - latitude) <= tolerance) & (
            F.abs(F.col("LONGITUDE").cast("double") - longitude) <= tolerance
        )
        off = off | ((F.col("STATION") == name) & ~F.coalesce(near, F.lit(False)))
    infinite = F.lit(False)
    for field in AUDITED_FIELDS:
        infinite = infinite | F.coalesce(
            F.col(field).cast("double").isin(float("inf"), float("-inf")), F.lit(False)
        )
    return stack(
        tally(raw, malformed_date=~F.coalesce(F.col("DATE").rlike(ISO_SECONDS), F.lit(False))),
        tally(
            bounded,
            unknown_station=~F.coalesce(known, F.lit(False)),
            coordinates_off=off,
            infinite_value=infinite,
        ),
        duplicate_keys(bounded, ["STATION", "DATE"], "duplicate_time"),
    )


def good(field: str) -> Column:
    """The value passed the strict policy: primary source, passed quality code, trusted report."""
    value, measure = F.col(field), attribute(field, "_Measurement_Code")
    base = (
        value.isNotNull()
        & (attribute(field, "_Source_Code") == PRIMARY_SOURCE)
        & (attribute(field, "_Quality_Code") == PRIMARY_QUALITY)
        & attribute(field, "_Report_Type").isin(*PRIMARY_REPORTS)
    )
    if field == "wind_speed":
        return F.coalesce(base & measure.isin(*WIND_MEASUREMENTS) & (value >= 0), F.lit(False))
    return base & (measure == "")


def unverified(field: str) -> Column:
    """Blank-flag values of the documented secondary sources; never for audited-only fields."""
    if field not in WEATHER_FIELDS:
        return F.lit(False)
    value, source = F.col(field), attribute(field, "_Source_Code")
    report = attribute(field, "_Report_Type")
    blank = (
        value.isNotNull()
        & (attribute(field, "_Quality_Code") == "")
        & (attribute(field, "_Measurement_Code") == "")
    )
    hourly = (source == HOURLY_SOURCE) & report.isin(*HOURLY_REPORTS)
    if field == "wind_speed":
        return F.coalesce(blank & hourly & (value >= 0), F.lit(False))
    return blank & (hourly | ((source == SYNOPTIC_SOURCE) & report.isin(*SYNOPTIC_REPORTS)))


def quality_good(parsed: DataFrame) -> DataFrame:
    return parsed.select(*OBSERVATION, *[good(f).alias(f"{v}_good") for f, v in WEATHER_FIELDS.items()])


def quality_unverified(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        *OBSERVATION, *[unverified(f).alias(f"{v}_unverified") for f, v in WEATHER_FIELDS.items()]
    )


def quality_status(parsed: DataFrame, allow_unverified: bool = True) -> DataFrame:
    """Accepted values only, with the state and source of every value."""
    columns = []
    for field, value in WEATHER_FIELDS.items():
        extra = unverified(field) if allow_unverified else F.lit(False)
        columns += [
            F.when(good(field) | extra, F.col(field)).alias(value),
            F.when(good(field), F.lit("good"))
            .when(extra, F.lit("unverified"))
            .when(F.col(field).isNotNull(), F.lit("rejected"))
            .otherwise(F.lit("missing"))
            .alias(f"{value}_quality"),
            attribute(field, "_Source_Code").alias(f"{value}_source"),
        ]
    return parsed.select(*OBSERVATION, *columns)


def with_core(parsed: DataFrame) -> DataFrame:
    """Rows that report at least one core field, accepted or not."""
    return parsed.where(F.coalesce(*[F.col(f) for f in WEATHER_FIELDS]).isNotNull())


def core_rows(parsed: DataFrame, allow_unverified: bool = True) -> DataFrame:
    """Observations of the pipeline. A rejected value stays in as missing, so that no older
    value takes its place later."""
    return quality_status(with_core(parsed), allow_unverified)


def quality_flag_counts(parsed: DataFrame, allow_unverified: bool = True) -> DataFrame:
    """Rows by month, source, flags, report, station and variable. Precipitation is audited only."""
    entries = []
    for field in AUDITED_FIELDS:
        core = field in WEATHER_FIELDS
        entries.append(
            F.struct(
                F.lit(field).alias("variable"),
                attribute(field, "_Source_Code").alias("source"),
                attribute(field, "_Quality_Code").alias("quality"),
                attribute(field, "_Measurement_Code").alias("measurement"),
                attribute(field, "_Report_Type").alias("report_type"),
                F.col(field).isNotNull().alias("seen"),
                (good(field) if core else F.lit(False)).alias("good"),
                (unverified(field) if core and allow_unverified else F.lit(False)).alias("unverified"),
            )
        )
    month = month_text(to_local(F.col("observed_at"))).alias("month")
    accepted = F.col("good") | F.col("unverified")
    return (
        parsed.select("station_id", month, F.inline(F.array(*entries)))
        .groupBy("month", "source", "quality", "measurement", "report_type", "station_id", "variable")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            count_true(F.col("seen")).alias("present"),
            count_true(accepted).alias("accepted"),
            count_true(F.col("seen") & ~accepted).alias("policy_excluded"),
            count_true(F.col("good")).alias("accepted_good"),
            count_true(F.col("unverified")).alias("accepted_unverified"),
        )
    )


def stations_of(observations: DataFrame, stations=None) -> DataFrame:
    """The named stations, silent ones included, or else those that have observations."""
    if stations is None:
        return observations.select("station_id").distinct()
    return observations.sparkSession.createDataFrame([(s,) for s in stations], "station_id string")


def target_grid(observations: DataFrame, start, stop, delays, stations=None) -> DataFrame:
    """Every station at every UTC hour of ``[start, stop)`` and delay."""
    stations = stations_of(observations, stations)
    scenario = F.explode(F.array(*[F.lit(d) for d in delays])).alias("delay_hours")
    return with_spine(stations, start, stop, local=False).select("station_id", "hour", scenario)


def snapshot_columns(picked: DataFrame, carried: list[str]) -> DataFrame:
    seen = F.col("pick.observed_at")
    return picked.select(
        "hour",
        "station_id",
        seen.alias("observed_at"),
        (seen + hours(F.col("delay_hours"))).alias("assumed_available_at"),
        elapsed_hours(F.col("hour"), seen).alias("age_hours"),
        *[F.col(f"pick.{c}").alias(c) for c in carried],
        "delay_hours",
    )


def carried_columns(observations: DataFrame) -> list[str]:
    return [c for c in (*WEATHER_VALUES, *STATES) if c in observations.columns]


def asof_snapshot(observations: DataFrame, start, stop, delays=DELAYS, max_age_hours: int = 6, stations=None) -> DataFrame:
    """Latest observation strictly before ``hour - delay`` and at most ``max_age_hours`` old.

    One row per station, hour and delay; without a match the values are NULL, and NULL values of
    the chosen observation stay NULL.

    Targets and delays are whole hours, so only the last observation of a clock hour can ever be
    chosen. Observations are cut to that one first (combining before the shuffle, however many a
    station sends), then each is offered to the few hours it can serve. The target grid takes
    part in the same aggregation, so there is no join and no window over a station.
    """
    carried = carried_columns(observations)
    row = F.struct("observed_at", *carried)
    last = observations.groupBy(
        "station_id", hour_floor(F.col("observed_at")).alias("clock")
    ).agg(F.max_by(row, "observed_at").alias("pick"))
    offers = [
        F.struct(F.lit(d).alias("delay_hours"), F.lit(ahead).alias("ahead"))
        for d in delays
        for ahead in range(1 + d, max_age_hours + 1)
    ]
    grid = target_grid(observations, start, stop, delays, stations)
    if not offers:
        none = grid.withColumn("pick", F.lit(None).cast(last.schema["pick"].dataType))
        return snapshot_columns(none, carried)
    offered = last.select("station_id", "clock", "pick", F.inline(F.array(*offers))).select(
        "station_id",
        (F.col("clock") + hours(F.col("ahead"))).alias("hour"),
        "delay_hours",
        "pick",
        F.lit(False).alias("asked"),
    ).where((F.col("hour") >= instant(start)) & (F.col("hour") < instant(stop)))
    asked = grid.select(
        "station_id",
        "hour",
        "delay_hours",
        F.lit(None).cast(last.schema["pick"].dataType).alias("pick"),
        F.lit(True).alias("asked"),
    )
    picked = (
        asked.unionByName(offered)
        .groupBy("station_id", "hour", "delay_hours")
        .agg(
            F.max_by("pick", F.col("pick.observed_at")).alias("pick"),
            F.max("asked").alias("asked"),
        )
        .where("asked")
    )
    return snapshot_columns(picked, carried)


def asof_any_target(observations: DataFrame, targets: DataFrame, max_age_hours: int) -> DataFrame:
    """The same choice for arbitrary target times (``station_id, hour, delay_hours``).

    Targets stand among the observations of their station and clock hour, at the time before which they may look, behind the
    last observation of earlier hours; the last observation before a target is the choice, if it is young enough. Work grows with
    observations plus targets, however many of both an hour holds. Also the second formulation that ``asof_snapshot`` is verified
    against.
    """
    carried = carried_columns(observations)
    row = F.struct("observed_at", *carried)
    rows = observations.where(F.col("station_id").isNotNull() & F.col("observed_at").isNotNull()).select(
        "station_id", F.col("observed_at").alias("_at"), row.alias("pick")
    )
    nothing = F.lit(None).cast(rows.schema["pick"].dataType).alias("pick")
    # At one time a carried observation stands first, then targets, then observations: a target looks strictly before itself.
    carry, target, seen = (F.lit(i).alias("_kind") for i in range(3))
    clock = hour_floor(F.col("_at")).alias("_clock")
    asked = targets.select(
        "station_id", (F.col("hour") - hours(F.col("delay_hours"))).alias("_at"), target, nothing, "hour", "delay_hours"
    ).withColumn("_clock", clock)
    lasts = rows.groupBy("station_id", clock).agg(F.max_by("pick", "_at").alias("pick")).withColumn("_kind", seen)
    clocks = asked.select("station_id", "_clock").distinct().withColumns({"pick": nothing, "_kind": target})
    # One row per station and clock hour with targets or observations.
    upto = Window.partitionBy("station_id").orderBy("_clock", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    before = clocks.unionByName(lasts).withColumn("pick", F.last("pick", ignorenulls=True).over(upto)).where(F.col("_kind") == target)
    line = rows.withColumns({"_clock": clock, "_kind": seen}).unionByName(before.withColumns({"_at": F.col("_clock"), "_kind": carry}))
    inside = Window.partitionBy("station_id", "_clock").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    latest = line.unionByName(asked, allowMissingColumns=True).withColumn("pick", F.last("pick", ignorenulls=True).over(inside))
    usable = (F.col("delay_hours") <= max_age_hours) & (F.col("pick.observed_at") + hours(max_age_hours) >= F.col("hour"))
    chosen = latest.where(F.col("_kind") == target).withColumn("pick", F.when(usable, F.col("pick")))
    return snapshot_columns(chosen, carried)


def snapshot_quality(snapshots: DataFrame) -> DataFrame:
    """Unmatched hours get quality ``missing`` and an empty source; others keep their own."""
    return snapshots.withColumns(
        {
            **{f"{v}_quality": F.coalesce(f"{v}_quality", F.lit("missing")) for v in WEATHER_VALUES},
            **{f"{v}_source": F.coalesce(f"{v}_source", F.lit("")) for v in WEATHER_VALUES},
        }
    )


def delay_scenarios(observations: DataFrame, start, stop, delays=DELAYS, max_age_hours: int = 6) -> DataFrame:
    """All delays stacked, with quality states."""
    return snapshot_quality(asof_snapshot(observations, start, stop, delays, max_age_hours))


def longest_missing_run(frame: DataFrame, keys: list[str], present: str = "present", stretch: int = STRETCH_HOURS) -> DataFrame:
    """Longest run of hours without ``present`` per key, edges included.

    Missing hours between two present ones share the running count of present hours. Runs are counted per
    (key, stretch of hours); only the run before a stretch's first present hour and the one after its last
    can go on elsewhere, so a key as a whole is a window over its few stretches.
    """
    parts = [*keys, "_stretch"]
    upto = Window.partitionBy(*parts).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    cut = frame.withColumn("_stretch", F.floor(hour_index(F.col("hour")) / stretch))
    island = cut.withColumn("_island", F.sum(F.col(present).cast("int")).over(upto))
    runs = island.groupBy(*parts, "_island").agg(count_true(~F.col(present)).alias("run"))
    run_of = lambda at: F.max_by("run", at)
    ends = runs.groupBy(*parts).agg(
        F.max("_island").alias("_present"),
        F.max("run").alias("_inner"),
        F.coalesce(F.max(F.when(F.col("_island") == 0, F.col("run"))), F.lit(0)).alias("_lead"),
        run_of("_island").alias("_trail"),
    )
    holds = F.col("_present") > 0
    whole = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, 0)
    group = F.sum(holds.cast("int")).over(whole)
    entry = lambda at, run: F.struct(at.alias("_group"), run.alias("_run"))
    open_ = F.when(holds, F.array(entry(F.col("_at") - 1, F.col("_lead")), entry(F.col("_at"), F.col("_trail")))).otherwise(
        F.array(entry(F.col("_at"), F.col("_lead")))
    )
    joined = ends.withColumn("_at", group).select(*keys, "_inner", F.inline(open_))
    sums = joined.groupBy(*keys, "_group").agg(F.sum("_run").alias("_run"), F.max("_inner").alias("_inner"))
    return sums.groupBy(*keys).agg(F.greatest(F.max("_run"), F.max("_inner")).alias("longest_missing_hours"))


def value_rows(observations: DataFrame) -> DataFrame:
    """One row per observation and variable with its value and quality."""
    entries = [
        F.struct(
            F.lit(v).alias("variable"), F.col(v).alias("value"), F.col(f"{v}_quality").alias("quality")
        )
        for v in WEATHER_VALUES
    ]
    return observations.select(
        "station_id", hour_floor(F.col("observed_at")).alias("hour"), F.inline(F.array(*entries))
    )


def native_coverage(raw_bounded: DataFrame, observations: DataFrame, start, stop, stations=None) -> DataFrame:
    """Coverage per station and variable on the native observation hours."""
    keys = ["station_id", "variable"]
    ok = F.col("value").isNotNull()
    hourly = value_rows(observations).groupBy(*keys, "hour").agg(
        F.count(F.lit(1)).alias("n"),
        count_true(ok).alias("accepted"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        count_true(F.col("quality") == "good").alias("good"),
        count_true(F.col("quality") == "unverified").alias("unverified"),
    )
    variables = F.explode(F.array(*[F.lit(v) for v in WEATHER_VALUES])).alias("variable")
    expected = with_spine(stations_of(observations, stations), start, stop, local=False).select(
        "station_id", "hour", variables
    )
    spread = expected.withColumn("wanted", F.lit(1)).join(hourly, [*keys, "hour"], "full_outer")
    wanted = F.col("wanted").isNotNull()
    hit = lambda c: count_true(wanted & (F.col(c) > 0))
    # Nulls of the outer join must not become counts.
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    summary = spread.groupBy(*keys).agg(
        total("n").alias("core_observation_rows"),
        count_true(F.col("n") > 0).alias("core_observed_hours"),
        total("accepted").alias("accepted_values"),
        hit("accepted").alias("accepted_hours"),
        count_true(wanted).alias("expected_hours"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
        total("good").alias("accepted_good_values"),
        hit("good").alias("accepted_good_hours"),
        total("unverified").alias("accepted_unverified_values"),
        hit("unverified").alias("accepted_unverified_hours"),
    )
    flagged = spread.where(wanted).select(
        *keys, "hour", (F.coalesce("accepted", F.lit(0)) > 0).alias("present")
    )
    gaps = longest_missing_run(flagged, keys)
    source = raw_bounded.groupBy(F.col("STATION").alias("station_id")).agg(
        F.count(F.lit(1)).alias("source_rows")
    )
    return summary.join(gaps, keys).join(source, "station_id", "left").select(
        "station_id",
        "variable",
        "source_rows",
        "core_observation_rows",
        "core_observed_hours",
        "accepted_values",
        "accepted_hours",
        "expected_hours",
        "longest_missing_hours",
        "min",
        "max",
        "accepted_good_values",
        "accepted_good_hours",
        "accepted_unverified_values",
        "accepted_unverified_hours",
    )


def availability_coverage(snapshots: DataFrame) -> DataFrame:
    """Matched and complete target hours per station, local month and delay."""
    everything, all_good, any_unverified = F.lit(True), F.lit(True), F.lit(False)
    for v in WEATHER_VALUES:
        everything = everything & F.col(v).isNotNull()
        all_good = all_good & (F.col(f"{v}_quality") == "good")
        any_unverified = any_unverified | (F.col(f"{v}_quality") == "unverified")
    per_value = []
    for v in WEATHER_VALUES:
        per_value += [
            count_true(F.col(v).isNotNull()).alias(f"{v}_hours"),
            count_true(F.col(f"{v}_quality") == "good").alias(f"{v}_good_hours"),
            count_true(F.col(f"{v}_quality") == "unverified").alias(f"{v}_unverified_hours"),
        ]
    return snapshots.groupBy(
        "station_id", month_text(to_local(F.col("hour"))).alias("month"), "delay_hours"
    ).agg(
        F.count(F.lit(1)).alias("target_hours"),
        count_true(F.col("observed_at").isNotNull()).alias("matched_observation_hours"),
        count_true(everything).alias("complete_hours"),
        F.avg(everything.cast("double")).alias("complete_fraction"),
        *per_value,
        count_true(all_good).alias("complete_good_hours"),
        count_true(everything & any_unverified).alias("complete_unverified_hours"),
    )


def bundle_features(stations: dict[str, str]) -> list[str]:
    """Feature names of a bundle; ``stations`` maps an alias to a station id."""
    names = []
    for alias in stations:
        for suffix in ("", "_missing", "_unverified"):
            names += [f"weather_{alias}_{v}{suffix}" for v in WEATHER_VALUES]
        names.append(f"weather_{alias}_age_hours")
    return names


def weather_bundle(snapshots: DataFrame, stations: dict[str, str], by=()) -> DataFrame:
    """One wide row per hour (and per ``by``); no hour is dropped and nothing is filled in."""
    columns = {}
    for alias, station in stations.items():
        mine = F.col("station_id") == station
        for v in WEATHER_VALUES:
            value = F.max(F.when(mine, F.col(v)))
            columns[f"weather_{alias}_{v}"] = value
            columns[f"weather_{alias}_{v}_missing"] = value.isNull().cast("int")
            columns[f"weather_{alias}_{v}_unverified"] = F.coalesce(
                F.max(F.when(mine, (F.col(f"{v}_quality") == "unverified").cast("int"))), F.lit(0)
            )
        columns[f"weather_{alias}_age_hours"] = F.max(F.when(mine, F.col("age_hours")))
    order = bundle_features(stations)
    return snapshots.groupBy(*by, "hour").agg(*[columns[name].alias(name) for name in order])


def bundle_summary(bundle: DataFrame, features: list[str]) -> DataFrame:
    """Rows, missing rows, min, max, mean per delay and feature."""
    long = long_models(bundle, features, ["delay_hours"]).withColumnsRenamed(
        {"model": "feature", "prediction": "value"}
    )
    return long.groupBy("delay_hours", "feature").agg(
        F.count(F.lit(1)).alias("rows"),
        count_true(F.col("value").isNull()).alias("missing_rows"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
    )


def append_weather(features: DataFrame, bundle: DataFrame) -> DataFrame:
    """Many-to-one hour join; check with ``check_append`` first."""
    return features.join(bundle, "hour", "left").select(
        *features.columns, *[c for c in bundle.columns if c != "hour"]
    )


def weather_preflight(assigned: DataFrame, bundle: DataFrame, features: list[str], delays) -> DataFrame:
    """Rows, rows lost and missing weather cells per fold and delay.

    Panel rows are counted per hour first; the weather side is one row per hour and delay.
    """
    hourly = assigned.groupBy("fold", "role", "hour").agg(F.count(F.lit(1)).alias("n"))
    missing = F.lit(0)
    for name in features:
        missing = missing + F.col(name).isNull().cast("int")
    cells = bundle.select("delay_hours", "hour", missing.alias("missing_cells"))
    wanted = hourly.withColumn(
        "delay_hours", F.explode(F.array(*[F.lit(d) for d in delays]))
    )
    joined = wanted.join(cells, ["delay_hours", "hour"], "left")
    of = lambda role, value: F.coalesce(
        F.sum(F.when(F.col("role") == role, value)), F.lit(0).cast("bigint")
    )
    return joined.groupBy("fold", F.col("delay_hours").alias("weather_delay_hours")).agg(
        of("train", F.col("n")).alias("training_rows"),
        of("validation", F.col("n")).alias("validation_rows"),
        F.coalesce(
            F.sum(F.when(F.col("missing_cells").isNull(), F.col("n"))), F.lit(0).cast("bigint")
        ).alias("weather_filter_rows_removed"),
        of("train", F.col("n") * F.col("missing_cells")).alias("training_missing_weather_cells"),
        of("validation", F.col("n") * F.col("missing_cells")).alias("validation_missing_weather_cells"),
    )
