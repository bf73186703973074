import math
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from frames import START, by_key, checks, panel
from zonecast.functions.quantiles import exact_quantiles
from zonecast.operators import peers, temporal


def test_lags_and_windows_are_exact(spark):
    made = by_key(temporal.make_features(panel(spark)), *temporal.HISTORY)
    lag_1, lag_2, lag_3, lag_24, lag_168, mean_3, mean_24, mean_168, std_24, trend = made[(2, START + timedelta(hours=200))]
    assert (lag_1, lag_2, lag_3, lag_24, lag_168, trend) == (199, 198, 197, 176, 32, 1)
    assert mean_3 == 198 and mean_24 == sum(range(176, 200)) / 24 and mean_168 == sum(range(32, 200)) / 168
    assert std_24 == pytest.approx(math.sqrt(sum((v - mean_24) ** 2 for v in range(176, 200)) / 24))
    early = made[(3, START + timedelta(hours=2))]
    assert early[0] == 1001 and early[5] is None and early[8] is None


def test_stretches_do_not_change_results(spark):
    frame = panel(spark, 900, demand=lambda z, i: i * i % 97 + z)
    whole = by_key(temporal.history(frame, delay=6), *temporal.HISTORY)
    split = by_key(temporal.history(frame, delay=6, stretch=200), *temporal.HISTORY)
    assert whole == split


@pytest.mark.parametrize("delay", [0, 1, 3, 6])
def test_delay_moves_recent_history_only(spark, delay):
    frame = panel(spark, demand=lambda z, i: i * i % 97)
    made = by_key(temporal.history(frame, delay=delay), "lag_1", "lag_24", "lag_168", "rolling_mean_3")
    value = lambda i: i * i % 97
    at = 230
    lag_1, lag_24, lag_168, mean_3 = made[(2, START + timedelta(hours=at))]
    assert (lag_1, lag_24, lag_168) == (value(at - 1 - delay), value(at - 24), value(at - 168))
    assert mean_3 == pytest.approx(sum(value(at - 1 - delay - k) for k in range(3)) / 3)
    stacked = temporal.delayed_features(frame).where(F.col("delay_hours") == delay)
    assert by_key(stacked, "lag_1", "lag_24", "lag_168", "rolling_mean_3") == made


def test_present_and_future_never_leak(spark):
    changed = lambda z, i: 999999 if i >= 200 else i + (1000 if z == 3 else 0)
    before = by_key(temporal.make_features(panel(spark)), *temporal.HISTORY)
    after = by_key(temporal.make_features(panel(spark, demand=changed)), *temporal.HISTORY)
    cut = START + timedelta(hours=200)
    assert all(before[k] == after[k] for k in before if k[1] <= cut)
    assert any(before[k] != after[k] for k in before if k[1] > cut)


def test_input_order_does_not_matter(spark):
    frame = panel(spark)
    assert by_key(temporal.history(frame), *temporal.HISTORY) == by_key(
        temporal.history(frame.orderBy(F.rand(7))), *temporal.HISTORY
    )


def test_unsupported_delay(spark):
    with pytest.raises(ValueError):
        temporal.lags(panel(spark), 2)


def test_calendar(spark):
    # 2026-01-05 12:00 UTC is Monday 07:00 local; 2026-01-04 is a Sunday.
    made = by_key(temporal.local_calendar(panel(spark)), "local_hour", "weekday", "weekend", "month", "rush_hour")
    assert made[(2, START + timedelta(days=4, hours=12))] == (7, 0, 0, 1, 1)
    assert made[(2, START + timedelta(days=3, hours=13))] == (8, 6, 1, 1, 0)


def test_future_rows(spark):
    rows = temporal.make_features(temporal.future_target_rows(panel(spark))).where("demand IS NULL").collect()
    assert [(r.zone_id, r.lag_1, r.lag_168) for r in sorted(rows)] == [(2, 239, 72), (3, 1239, 1072)]


BOROUGHS = {2: "Queens", 3: "Queens", 4: "Manhattan"}


def peers_panel(spark, change=None):
    demand = lambda z, i: (change or {}).get((z, i), i + 10 * z)
    return panel(spark, 200, (2, 3, 4), demand, BOROUGHS)


def test_peer_means(spark):
    made = by_key(peers.lagged_peers(peers_panel(spark)), *peers.PEER_LAGS)
    assert made[(2, START + timedelta(hours=50))] == (49 + 30, 26 + 30)
    assert made[(3, START + timedelta(hours=50))] == (49 + 20, 26 + 20)
    assert made[(4, START + timedelta(hours=50))] == (0.0, 0.0)


def test_peers_exclude_own_zone_and_future(spark):
    base = by_key(peers.lagged_peers(peers_panel(spark)), *peers.PEER_LAGS)
    own = by_key(peers.lagged_peers(peers_panel(spark, {(2, i): 7777 for i in range(200)})), *peers.PEER_LAGS)
    assert all(base[k] == own[k] for k in base if k[0] == 2)
    later = by_key(peers.lagged_peers(peers_panel(spark, {(3, i): 7777 for i in range(100, 200)})), *peers.PEER_LAGS)
    cut = START + timedelta(hours=100)
    assert all(base[k] == later[k] for k in base if k[1] <= cut)


def test_all_peer_features_keep_temporal_columns(spark):
    frame = peers_panel(spark)
    zones = frame.select("zone_id", "borough").distinct()
    made = peers.make_peer_features(frame, zones)
    temporal_only = by_key(temporal.make_features(frame), *temporal.HISTORY)
    assert by_key(made, *temporal.HISTORY) == temporal_only
    row = made.where("zone_id = 2").first()
    assert (row.borough_queens, row.borough_manhattan, row.borough_other_count) == (1, 0, 1)
    bad = peers.check_lookup_available(frame, zones, "2026-01-02 00:00:00")
    assert checks(bad) == {"before_lookup": 72, "borough_mismatch": 0, "empty_input": 0}


@pytest.mark.parametrize("buckets", [2, 7, 256])
def test_exact_quantiles(spark, buckets):
    numpy = pytest.importorskip("numpy")
    rng = numpy.random.default_rng(1)
    heavy = numpy.concatenate([numpy.zeros(3000), rng.exponential(5, 2000), [1e9]])
    rows = [("a", float(v)) for v in heavy] + [("b", float(v)) for v in rng.normal(size=101)] + [("b", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    asked = (0.0, 0.25, 0.5, 0.61, 0.9, 0.999, 1.0)
    found = {(r.k, r.probability): r.quantile for r in exact_quantiles(frame, ["k"], "v", asked, buckets).collect()}
    for key, values in (("a", heavy), ("b", [v for k, v in rows if k == "b" and v is not None])):
        for p in asked:
            assert found[(key, p)] == pytest.approx(float(numpy.quantile(values, p)), rel=1e-12, abs=1e-12)
