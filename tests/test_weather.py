from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frames import checks
from zonecast.operators import contracts, weather
from zonecast.settings import WEATHER_VALUES

START = datetime(2026, 1, 1)

T0 = datetime(2026, 1, 1, 6)
OBS = "station_id string, observed_at timestamp_ntz, temperature_c double, dew_point_c double, wind_speed_m_s double"


def observations(spark, *rows):
    return spark.createDataFrame([("s", T0 + timedelta(minutes=m), t, 1.0, 2.0) for m, t in rows], OBS)


def snapshot(spark, rows, delay=0, max_age=6, hours=12):
    made = weather.asof_snapshot(observations(spark, *rows), T0, T0 + timedelta(hours=hours), (delay,), max_age)
    return {int((r.hour - T0).total_seconds() // 3600): r for r in made.collect()}


def test_exact_tie_is_not_past(spark):
    found = snapshot(spark, [(0, 5.0), (60, 6.0)])
    assert found[0].observed_at is None
    assert found[1].temperature_c == 5.0 and found[1].age_hours == 1.0
    assert found[2].temperature_c == 6.0


def test_maximum_age_is_inclusive_and_nothing_is_filled_back(spark):
    found = snapshot(spark, [(0, 5.0)])
    assert found[6].temperature_c == 5.0 and found[7].temperature_c is None and found[7].age_hours is None


def test_delay_counts_from_availability(spark):
    found = snapshot(spark, [(0, 5.0), (90, 7.0)], delay=3)
    assert found[3].temperature_c is None
    assert found[4].temperature_c == 5.0
    assert found[5].temperature_c == 7.0
    assert found[5].assumed_available_at == T0 + timedelta(minutes=90 + 180)


def test_delay_at_or_above_maximum_age_matches_nothing(spark):
    assert all(r.observed_at is None for r in snapshot(spark, [(0, 5.0)], delay=6).values())


def test_missing_value_of_newest_row_stays_missing(spark):
    found = snapshot(spark, [(0, 5.0), (30, None)])
    assert found[1].temperature_c is None and found[1].observed_at == T0 + timedelta(minutes=30)
    assert found[1].dew_point_c == 1.0


def test_future_observations_do_not_matter(spark):
    before = snapshot(spark, [(0, 5.0)])
    after = snapshot(spark, [(0, 5.0), (300, 99.0)])
    assert all(before[h] == after[h] for h in range(6))


def test_two_formulations_agree_on_random_times(spark):
    rows = [(i * i * 7 % 1400, float(i)) for i in range(40)]
    rows = list({m: (m, t) for m, t in rows}.values())
    seen = observations(spark, *rows)
    stop = T0 + timedelta(hours=30)
    fast = weather.asof_snapshot(seen, T0, stop, (0, 1, 3, 6), 4)
    slow = weather.asof_any_target(seen, weather.target_grid(seen, T0, stop, (0, 1, 3, 6)), 4)
    sides = {r["side"]: r["rows"] for r in contracts.reconcile_tables(fast, slow, fast.columns).collect()}
    assert sides == {"left_only": 0, "right_only": 0}


def test_targets_off_the_hour(spark):
    seen = observations(spark, (0, 5.0), (59, 6.0))
    asked = spark.createDataFrame([("s", T0 + timedelta(minutes=m), 0) for m in (59, 60, 61, 300)], "station_id string, hour timestamp_ntz, delay_hours int")
    found = {int((r.hour - T0).total_seconds() // 60): r.temperature_c for r in weather.asof_any_target(seen, asked, 4).collect()}
    assert found == {59: 5.0, 60: 6.0, 61: 6.0, 300: None}


def raw(spark, **changes):
    row = {"STATION": "s", "DATE": "2026-01-01T06:10:00", "LATITUDE": "40.0", "LONGITUDE": "-73.0"}
    for field in ("temperature", "dew_point_temperature", "wind_speed", "precipitation"):
        row |= {
            field: "3.5",
            f"{field}_Source_Code": "223",
            f"{field}_Quality_Code": "1",
            f"{field}_Measurement_Code": "N" if field == "wind_speed" else None,
            f"{field}_Report_Type": "FM15",
        }
    row |= changes
    schema = ", ".join(f"{k} string" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema)


BOUNDS = ("2026-01-01T00:00:00", "2026-01-02T00:00:00")


def status(spark, allow=True, **changes):
    return weather.quality_status(weather.parse_observations(raw(spark, **changes), *BOUNDS), allow).first()


@pytest.mark.parametrize(
    "changes, column, state",
    [
        ({}, "temperature_c", "good"),
        ({"temperature_Quality_Code": "2"}, "temperature_c", "rejected"),
        ({"temperature": None}, "temperature_c", "missing"),
        ({"temperature_Measurement_Code": "A"}, "temperature_c", "rejected"),
        ({"temperature_Report_Type": "SAO"}, "temperature_c", "rejected"),
        ({"wind_speed": "-1"}, "wind_speed_m_s", "rejected"),
        ({"wind_speed_Measurement_Code": None}, "wind_speed_m_s", "rejected"),
        ({"temperature_Source_Code": "413", "temperature_Quality_Code": None}, "temperature_c", "unverified"),
        ({"temperature_Source_Code": "412", "temperature_Quality_Code": None, "temperature_Report_Type": "FM94_1"}, "temperature_c", "unverified"),
        ({"wind_speed_Source_Code": "412", "wind_speed_Quality_Code": None, "wind_speed_Measurement_Code": None, "wind_speed_Report_Type": "FM12"}, "wind_speed_m_s", "rejected"),
    ],
)
def test_quality_states(spark, changes, column, state):
    row = status(spark, **changes)
    assert row[f"{column}_quality"] == state
    assert (row[column] is not None) == (state in ("good", "unverified"))


def test_strict_policy_has_no_unverified(spark):
    row = status(spark, False, temperature_Source_Code="413", temperature_Quality_Code=None)
    assert row.temperature_c is None and row.temperature_c_quality == "rejected"


def test_core_rows_keep_rejected_and_drop_rain_only(spark):
    kept = weather.core_rows(weather.parse_observations(raw(spark, temperature_Quality_Code="2"), *BOUNDS))
    assert kept.count() == 1
    empty = {"temperature": None, "dew_point_temperature": None, "wind_speed": None}
    assert weather.core_rows(weather.parse_observations(raw(spark, **empty), *BOUNDS)).count() == 0


def test_junk_number_is_an_error_inside_the_window_only(spark):
    with pytest.raises(Exception):
        weather.parse_observations(raw(spark, temperature="abc"), *BOUNDS).collect()
    late = raw(spark, temperature="abc", DATE="2026-02-01T00:00:00")
    assert weather.parse_observations(late, *BOUNDS).count() == 0


def test_station_checks(spark):
    found = checks(weather.check_station(raw(spark, DATE="2026-01-01 06:10"), {"s": (40.0, -73.0)}, *BOUNDS))
    assert found["malformed_date"] == 1
    found = checks(weather.check_station(raw(spark, LATITUDE="40.02"), {"s": (40.0, -73.0)}, *BOUNDS))
    assert found["coordinates_off"] == 1 and found["unknown_station"] == 0


def test_longest_run_counts_edges(spark):
    rows = [("k", T0 + timedelta(hours=i), flag) for i, flag in enumerate([False, False, True, False, False, False])]
    frame = spark.createDataFrame(rows, "key string, hour timestamp_ntz, present boolean")
    assert weather.longest_missing_run(frame, ["key"]).first().longest_missing_hours == 3


def snapshots(spark):
    row = status(spark)
    seen = weather.quality_status(weather.parse_observations(raw(spark), *BOUNDS))
    assert row.temperature_c == 3.5
    return weather.delay_scenarios(seen, T0, T0 + timedelta(hours=10), (0, 3), 6)


def test_bundle_and_contract(spark):
    made = snapshots(spark)
    hours = made.select("hour").distinct()
    good = contracts.check_snapshots(made, ["s"], hours, 3)
    assert not any(checks(good).values())
    broken = made.withColumn("age_hours", F.col("age_hours") + 1)
    assert checks(contracts.check_snapshots(broken, ["s"], hours, 3))["age_disagrees"] > 0
    lost = checks(contracts.check_snapshots(made.where("age_hours IS NULL"), ["s"], hours, 3))
    assert lost["missing_snapshot"] > 0
    bundle = weather.weather_bundle(made.where("delay_hours = 0"), {"a": "s", "b": "other"})
    rows = {r.hour: r for r in bundle.collect()}
    assert len(rows) == 10 and len(bundle.columns) == 21
    first = rows[T0 + timedelta(hours=1)]
    assert first.weather_a_temperature_c == 3.5 and first.weather_a_temperature_c_missing == 0
    assert first.weather_b_temperature_c is None and first.weather_b_temperature_c_missing == 1
    assert set(WEATHER_VALUES) == {"temperature_c", "dew_point_c", "wind_speed_m_s"}


@pytest.mark.parametrize("stretch", [1, 3, 7, 2184])
def test_longest_missing_run_over_stretches(spark, stretch):
    draw = [[(h * h + 3 * h + k) % (2 + k) == 0 for h in range(60)] for k in range(4)] + [[False] * 60, [True] * 60, [False] * 40 + [True] + [False] * 19]
    rows = [(k, START + timedelta(hours=h), p) for k, own in enumerate(draw) for h, p in enumerate(own)]
    frame = spark.createDataFrame(rows, "key int, hour timestamp_ntz, present boolean")
    got = {r.key: r.longest_missing_hours for r in weather.longest_missing_run(frame, ["key"], stretch=stretch).collect()}
    assert got == {k: max(len(run) for run in "".join("01"[p] for p in own).split("1")) for k, own in enumerate(draw)}


def test_silent_station_is_all_missing(spark):
    seen = spark.createDataFrame([("a", START, 1.0, 1.0, 1.0)], "station_id string, observed_at timestamp_ntz, temperature_c double, dew_point_c double, wind_speed_m_s double")
    made = weather.asof_snapshot(seen, START, START + timedelta(hours=4), (0,), 6, ["a", "b"]).collect()
    assert sum(r.station_id == "b" for r in made) == 4 and all(r.temperature_c is None for r in made if r.station_id == "b")


def test_any_target_meets_no_pairs(spark):
    """Many targets and observations of an hour, ties, repeats, nulls and old observations, against a plain loop."""
    minutes = sorted({i * i * 13 % 5000 for i in range(300)} - set(range(1000, 2400)))
    seen = observations(spark, *[(m, float(m)) for m in minutes])
    unknown = seen.limit(1).withColumn("observed_at", F.lit(None).cast("timestamp_ntz"))
    asked = [("s", T0 + timedelta(minutes=i * 7 % 5200), d) for i in range(700) for d in (0, 1, 5)]
    asked += [asked[0], (None, T0, 0), ("s", None, 0), ("s", T0, None), ("other", T0, 0)]
    targets = spark.createDataFrame(asked, "station_id string, hour timestamp_ntz, delay_hours int")
    made = weather.asof_any_target(seen.unionByName(unknown), targets, 4)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()

    def wanted(station, hour, delay):
        if station != "s" or hour is None or delay is None or delay > 4:
            return None
        at = (hour - T0).total_seconds() / 60
        return max((m for m in minutes if at - 240 <= m < at - 60 * delay), default=None)

    shown = lambda rows: sorted(rows, key=repr)
    found = [(r.station_id, r.hour, r.delay_hours, r.temperature_c) for r in made.collect()]
    assert shown(found) == shown([(*t, wanted(*t)) for t in asked])
