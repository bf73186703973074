"""Small tables for the tests."""

from datetime import datetime, timedelta

START = datetime(2026, 1, 1)


def panel(spark, hours=240, zones=(2, 3), demand=None, boroughs=None, start=START):
    demand = demand or (lambda zone, i: i + (1000 if zone == 3 else 0))
    rows = [
        (zone, start + timedelta(hours=i), demand(zone, i), (boroughs or {}).get(zone, "Queens"))
        for zone in zones
        for i in range(hours)
    ]
    return spark.createDataFrame(rows, "zone_id int, hour timestamp_ntz, demand int, borough string")


def by_key(frame, *columns):
    return {(r["zone_id"], r["hour"]): tuple(r[c] for c in columns) for r in frame.collect()}


def checks(frame):
    return {r["check"]: r["bad_rows"] for r in frame.collect()}
