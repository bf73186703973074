from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frames import checks, panel
from zonecast.operators import audit, contracts
from zonecast.operators import panel as prep

TRIP = (
    "tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, PULocationID int, "
    "DOLocationID int, passenger_count double, trip_distance double, fare_amount double, "
    "payment_type int, file_month string"
)


def zones(spark):
    return spark.createDataFrame(
        [(2, "Queens", "A"), (3, "Bronx", "B")], "zone_id int, borough string, Zone string"
    )


def trip(pickup, zone, month="2026-03", minutes=10, **changes):
    start = datetime.fromisoformat(pickup) if pickup else None
    values = dict(passengers=1.0, distance=2.0, fare=5.0) | changes
    end = datetime(2026, 3, 2, 0, minutes) if start is None else start.replace(minute=59)
    return (start, end, zone, 3, values["passengers"], values["distance"], values["fare"], 1, month)


def test_prepare_counts_and_fills(spark):
    rows = [
        trip("2026-03-07T10:05:00", 2),
        trip("2026-03-07T10:45:00", 2),
        trip("2026-03-07T11:00:00", 3),
        trip("2026-03-07T11:00:00", 99),
        trip("2026-04-01T00:00:00", 2),
        trip(None, 2),
        trip("2026-03-08T02:30:00", 2),
    ]
    trips = spark.createDataFrame(rows, TRIP)
    table = prep.prepare_panel(trips, zones(spark), "2026-03-07", "2026-03-09")
    # 24 + 23 hours on the day with the skipped hour.
    assert table.count() == 2 * 47
    assert table.agg(F.sum("demand")).first()[0] == 3
    busy = {(r.zone_id, r.hour.hour): r.demand for r in table.where("demand > 0").collect()}
    assert busy == {(2, 15): 2, (3, 16): 1}
    assert dict(table.dtypes)["demand"] == "int"
    quality = {r.month: r for r in prep.monthly_quality(trips, zones(spark)).collect()}["2026-03"]
    assert quality.raw_rows == 7
    assert quality.null_pickups == 1
    assert quality.outside_file_month == 1
    assert quality.non_nyc_or_invalid_zone == 1


def test_flags_overlap_and_null_does_not_count(spark):
    rows = [
        trip("2026-03-07T10:05:00", 99, passengers=None, distance=0.0, fare=-1.0),
        trip("2026-03-07T10:05:00", 2, distance=None, fare=None),
    ]
    row = prep.monthly_quality(spark.createDataFrame(rows, TRIP), zones(spark)).first()
    assert (row.missing_passenger_count, row.nonpositive_distance, row.negative_fare) == (1, 1, 1)


def test_local_hours(spark):
    text = ["2026-01-01 00:00", "2026-07-01 00:00", "2026-03-08 02:00", "2026-11-01 01:00", "2026-11-01 02:00"]
    frame = spark.createDataFrame([(t,) for t in text], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("hour")
    )
    found = {str(r.hour): r.utc for r in prep.local_to_utc(frame).collect()}
    assert found["2026-01-01 00:00:00"] == datetime(2026, 1, 1, 5)
    assert found["2026-07-01 00:00:00"] == datetime(2026, 7, 1, 4)
    assert found["2026-03-08 02:00:00"] is None
    assert found["2026-11-01 01:00:00"] is None
    assert found["2026-11-01 02:00:00"] == datetime(2026, 11, 1, 7)


def test_autumn_span_is_refused(spark):
    spine = prep.hour_spine(spark, "2026-10-31", "2026-11-02")
    assert spine.count() == 49
    assert checks(prep.check_spine(spine))["repeated_local_hour"] == 1


def test_reversed_months_are_an_error(spark):
    bounds = spark.sql("SELECT date'2026-03-01' AS start, date'2026-01-01' AS end")
    with pytest.raises(Exception, match="reversed"):
        prep.months(bounds).collect()


def test_trip_schema(spark):
    good = spark.createDataFrame([], TRIP)
    contracts.check_trip_schema(good)
    with pytest.raises(ValueError, match="VendorID"):
        contracts.check_trip_schema(good, vendor=True)
    with pytest.raises(ValueError, match="time zone"):
        contracts.check_trip_schema(good.withColumn("tpep_pickup_datetime", F.col("tpep_pickup_datetime").cast("timestamp")))
    with pytest.raises(ValueError, match="integer"):
        contracts.check_trip_schema(good.withColumn("PULocationID", F.col("PULocationID").cast("double")))


DEFECTS = {
    "duplicate_key": lambda f: f.unionByName(f.limit(1)),
    "missing_hour": lambda f: f.where(F.col("hour") != F.lit("2026-01-03 00:00:00").cast("timestamp_ntz")),
    "invalid_demand": lambda f: f.withColumn("demand", F.when(F.col("demand") == 5, -1).otherwise(F.col("demand"))),
    "missing_demand": lambda f: f.withColumn("demand", F.when(F.col("demand") == 5, None).otherwise(F.col("demand"))),
    "zone_out_of_range": lambda f: f.withColumn("zone_id", F.when(F.col("zone_id") == 2, 1).otherwise(3)),
    "misaligned_hour": lambda f: f.withColumn(
        "hour", F.when(F.col("demand") == 239, F.col("hour") + F.expr("interval 10 minutes")).otherwise(F.col("hour"))
    ),
}


@pytest.mark.parametrize("name", DEFECTS)
def test_panel_defects_are_found(spark, name):
    assert not any(checks(contracts.check_panel(panel(spark))).values())
    bad = contracts.check_panel(DEFECTS[name](panel(spark)))
    assert checks(bad)[name] > 0
    with pytest.raises(ValueError, match=name):
        contracts.require(bad)


def test_fraction_is_invalid(spark):
    frame = panel(spark).withColumn("demand", F.col("demand") + 0.5)
    assert checks(contracts.check_panel(frame))["invalid_demand"] == 480


def test_only_last_target_may_be_missing(spark):
    last = F.col("hour") == F.lit("2026-01-10 23:00:00").cast("timestamp_ntz")
    frame = panel(spark).withColumn("demand", F.when(~last, F.col("demand")))
    assert checks(contracts.check_panel(frame))["missing_demand"] == 2
    assert checks(contracts.check_panel(frame, allow_future_target=True))["missing_demand"] == 0


def test_exact_duplicates(spark):
    rows = [(1, None, "x")] * 3 + [(1, None, "y"), (2, 1.0, "x"), (2, 1.0, "x")]
    frame = spark.createDataFrame(rows, "a int, b double, extra string")
    found = {(r.a, r.b, r.extra): r.copies for r in audit.exact_duplicates(frame).collect()}
    assert found == {(1, None, "x"): 3, (2, 1.0, "x"): 2}


def volumes(spark, drops=(100, 700), change=None):
    demand = lambda zone, i: 0 if i in drops else (change or {}).get(i, 100)
    return panel(spark, 800, (2,), demand).select(F.lit("city").alias("series"), "hour", "demand")


def test_reporting_flags(spark):
    rows = sorted(audit.reporting_volume_flags(volumes(spark)).collect(), key=lambda r: r.hour)
    assert [i for i, r in enumerate(rows) if r.flag] == [700]
    assert rows[100].reference_matches == 0 and rows[100].historical_median is None
    assert rows[700].historical_median == 100.0 and rows[700].coverage_ratio == 0.0
    with pytest.raises(ValueError):
        audit.reporting_volume_flags(volumes(spark), fraction=1.5)


def test_reporting_flags_look_back_only(spark):
    before = sorted(audit.reporting_volume_flags(volumes(spark)).collect(), key=lambda r: r.hour)
    after = sorted(audit.reporting_volume_flags(volumes(spark, change={750: 9999})).collect(), key=lambda r: r.hour)
    assert before[:750] == after[:750]


def test_conservation_and_reconcile(spark):
    a, b = panel(spark, 5), panel(spark, 5).withColumn("demand", F.col("demand") + (F.col("zone_id") == 2).cast("int"))
    assert checks(contracts.check_conservation(a, b))["total_difference"] == 5
    sides = {r["side"]: r["rows"] for r in contracts.reconcile_tables(a, b, a.columns).collect()}
    assert sides == {"left_only": 5, "right_only": 5}
    same = {r["side"]: r["rows"] for r in contracts.reconcile_tables(a, a.repartition(3), a.columns).collect()}
    assert same == {"left_only": 0, "right_only": 0}
    keys = ["zone_id", "hour", "demand"]
    prints = [contracts.table_fingerprint(f, keys).first() for f in (a, a.repartition(5), b)]
    assert prints[0] == prints[1] != prints[2]


def test_raw_trips_are_counted_before_any_shuffle(spark):
    trips = spark.createDataFrame([trip("2026-03-07T10:05:00", 2)], TRIP)
    counts = prep.hourly_counts(trips, zones(spark), "2026-03-01", "2026-04-01")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    # Reading upwards from the trips, the partial count comes before the first exchange.
    below = plan[plan.index("partial_count"):]
    assert "Exchange" not in below.split("Scan")[0]


def test_exact_duplicates_of_any_types(spark):
    """Against plain counting, with NULLs in every place, NaN, zeros of both signs, nested columns and odd names."""
    rows = [
        (1, None, 0.0, "a", [1, None], (1, "x")),
        (1, None, -0.0, "a", [1, None], (1, "x")),
        (None, 1, 0.0, "a", [1, None], (1, "x")),
        (2, 2, float("nan"), None, None, (None, None)),
        (2, 2, float("nan"), None, None, (None, None)),
        (2, 2, float("nan"), None, None, None),
        (3, 3, 1.5, "b", [], (1, "x")),
    ]
    schema = "row int, bits int, `a.b` double, word string, list array<int>, pair struct<copies:int,y:string>"
    frame = spark.createDataFrame(rows * 1 + rows[-1:] * 4, schema)
    got = sorted((r["row"], r["copies"]) for r in audit.exact_duplicates(frame).collect())
    assert got == [(1, 2), (2, 2), (3, 5)]
    assert audit.exact_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("words", [1, 64, audit.FILTER_WORDS])
def test_a_full_filter_loses_no_duplicate(spark, words):
    frame = spark.range(3000).select((F.col("id") % 2000).alias("a"), F.lit("x").alias("b"))
    suspected = audit.suspected_rows(frame, words)
    assert suspected.count() == (3000 if words == 1 else suspected.count()) >= 2000
    found = audit.exact_duplicates(frame, words)
    assert found.count() == 1000 and {r["copies"] for r in found.collect()} == {2}


def test_rows_without_a_copy_move_as_digests(spark):
    frame = spark.range(5000).select("id", F.repeat(F.lit("wide"), 50).alias("text"), F.lit(1).alias("more"))
    plan = audit.exact_duplicates(frame)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert sum("text" in line for line in moved) == 1 and any("digest" in line for line in moved)
    # What is grouped on all columns are the suspected rows alone.
    assert audit.suspected_rows(frame).count() < 5


def test_filled_grid_is_never_grouped_by_hour(spark):
    """Counts off the grid stay, repeated zones and counts add up, and hours are made behind the last aggregation."""
    at = lambda text: datetime.fromisoformat(f"2026-03-{text}")
    counts = [(2, at("07 05:00"), 1), (2, at("07 05:00"), 2), (2, at("08 04:00"), None), (2, at("09 04:00"), 5), (2, at("07 06:30"), 7), (9, at("07 05:00"), 4), (None, None, None)]
    frame = spark.createDataFrame(counts, "zone_id int, hour timestamp_ntz, demand int")
    twice = zones(spark).unionByName(zones(spark))
    made = prep.densify(frame, twice, "2026-03-07", "2026-03-09")
    found = sorted(((r.zone_id, r.hour, r.demand) for r in made.collect()), key=repr)
    grid = {(z, at("07 05:00") + timedelta(hours=h)): 0 for z in (2, 3) for h in range(47)}
    grid |= {(2, at("07 05:00")): 3, (2, at("09 04:00")): 5, (2, at("07 06:30")): 7, (9, at("07 05:00")): 4, (None, None): None}
    assert found == sorted(((*k, v) for k, v in grid.items()), key=repr)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Aggregate")
    half = prep.densify(frame, zones(spark), "2026-03-07 00:30:00", "2026-03-09 00:30:00").where("demand = 0").collect()
    assert {r.hour.minute for r in half} == {30} and len(half) == 2 * 47 - 1
