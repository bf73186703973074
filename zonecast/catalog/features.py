"""Queries of temporal and borough features."""

from zonecast import bindings as b
from zonecast.catalog.registry import query
from zonecast.operators import peers, temporal

KEYS = ["zone_id", "hour", "demand"]


def bare(spark, sf):
    return b.panel(spark, sf).select(*KEYS)


@query
def lags(spark, sf):
    return temporal.lags(bare(spark, sf))


@query
def rolling_means(spark, sf):
    return temporal.rolling_means(bare(spark, sf))


@query
def rolling_std(spark, sf):
    return temporal.rolling_std(bare(spark, sf))


@query
def trend(spark, sf):
    return temporal.trend(bare(spark, sf))


@query
def local_calendar(spark, sf):
    return temporal.local_calendar(bare(spark, sf))


@query
def cyclic(spark, sf):
    return temporal.cyclic(temporal.local_calendar(bare(spark, sf))).select(
        *KEYS, "hour_sin", "hour_cos", "weekday_sin", "weekday_cos"
    )


@query
def delayed_features(spark, sf):
    return temporal.delayed_features(bare(spark, sf))


@query
def future_target_rows(spark, sf):
    rows = temporal.make_features(temporal.future_target_rows(bare(spark, sf)))
    return rows.where("demand IS NULL").select("zone_id", "hour", *temporal.HISTORY)


@query
def drop_warmup(spark, sf):
    return temporal.drop_warmup(temporal.make_features(bare(spark, sf))).select(*KEYS, "lag_168")


@query
def borough_onehot(spark, sf):
    return peers.borough_onehot(b.square_zones(spark, sf), b.REGIONS)


@query
def peer_mean(spark, sf):
    return peers.peer_mean(b.panel(spark, sf)).drop("Zone")


@query
def lagged_peers(spark, sf):
    return peers.lagged_peers(b.panel(spark, sf).drop("Zone"), delay=3)


@query
def peer_count(spark, sf):
    zones = b.square_zones(spark, sf)
    return peers.peer_count(zones, zones)


@query
def check_lookup_available(spark, sf):
    return peers.check_lookup_available(
        b.panel(spark, sf), b.square_zones(spark, sf), "2024-02-21 05:00:00"
    )


@query
def describe_features(spark, sf):
    features = temporal.history(bare(spark, sf))
    return peers.describe_features(
        features, ["lag_1", "rolling_mean_24", "rolling_mean_168", "rolling_std_24", "trend_1"]
    )


@query
def zones_per_borough(spark, sf):
    return peers.zones_per_borough(b.square_zones(spark, sf))
