"""The jobs end to end on small files."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from test_weather import raw
from zonecast.operators.folds import utc_midnight
from zonecast.operators import models
from zonecast.plans import fitted, quality, study, weather
from zonecast.plans.prepare import prepare
from zonecast.sources import tables as sources

START, STOP = "2026-02-27", "2026-03-12"
BOUNDARIES = ("2026-03-08", "2026-03-10", "2026-03-11")
ARGS = (START, BOUNDARIES, BOUNDARIES[-1])


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("jobs")
    (base / "zones.csv").write_text("LocationID,Borough,Zone,service_zone\n2,Queens,A,x\n3,Queens,B,x\n4,Bronx,C,x\n265,N/A,,x\n")
    minute = F.col("id") * 7
    trips = spark.range(6000).select(
        (F.lit("2026-02-27 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(minute % 18720).cast("int"))).alias("tpep_pickup_datetime"),
        (F.col("id") % 5 + 2).cast("int").alias("PULocationID"),
        F.lit(3).alias("DOLocationID"),
        F.lit(1.0).alias("passenger_count"),
        F.lit(1.0).alias("trip_distance"),
        F.lit(9.0).alias("fare_amount"),
        F.lit(1).alias("payment_type"),
        F.lit(1).alias("VendorID"),
    ).withColumn("tpep_dropoff_datetime", F.col("tpep_pickup_datetime"))
    for month in ("2026-02", "2026-03"):
        part = trips.where(F.substring(F.col("tpep_pickup_datetime").cast("string"), 1, 7) == month)
        part.coalesce(1).write.parquet(str(base / "raw" / month))
    return base


@pytest.fixture(scope="module")
def panel(spark, root):
    files = [str(p) for m in ("2026-02", "2026-03") for p in (root / "raw" / m).glob("*.parquet")]
    named = []
    for month, path in zip(("2026-02", "2026-03"), files):
        target = root / f"trips_{month}.parquet"
        target.write_bytes(open(path, "rb").read())
        named.append(str(target))
    prepare(spark, named, str(root / "zones.csv"), START, STOP, str(root / "prepared"))
    return str(root / "prepared" / "panel")


def test_panel_and_quality(spark, root, panel):
    saved = spark.read.parquet(panel)
    assert saved.count() == 3 * (13 * 24 - 1)
    report = {r.month: r for r in spark.read.csv(f"{root}/prepared/quality", header=True, inferSchema=True).collect()}
    assert sum(r.raw_rows for r in report.values()) == 6000
    assert all(r.outside_file_month == 0 for r in report.values())


def test_backtest_latency_uncertainty_report_export(spark, root, panel):
    out = str(root / "study")
    study.backtest(spark, panel, *ARGS, out)
    assert spark.read.parquet(f"{out}/predictions").count() == 3 * (3 * 24 - 1)
    assert spark.read.json(f"{out}/record").first().champion is not None
    study.latency(spark, panel, *ARGS, str(root / "latency"), warmup_hours=174, embargo_hours=6)
    effects = spark.read.csv(f"{root}/latency/csv/delay_effects", header=True, inferSchema=True)
    assert effects.where("delay_hours = 0 AND mae_change <> 0").count() == 0 and effects.count() == 12
    pair = [("zone_hour_average", "previous_week_168h")]
    study.uncertainty(spark, out, *ARGS, pair, str(root / "intervals"), (1,), 100)
    found = spark.read.csv(f"{root}/intervals/csv/intervals", header=True, inferSchema=True).first()
    assert found.delta_mae_family_low <= found.delta_mae_low <= found.delta_mae_high <= found.delta_mae_family_high
    study.report(spark, panel, out, START, BOUNDARIES[0], BOUNDARIES[-1], "zone_hour_average", str(root / "report"))
    assert spark.read.csv(f"{root}/report/zone_map", header=True).count() == 3
    window = (utc_midnight("2026-03-10"), utc_midnight("2026-03-11"))
    study.export(spark, panel, out, "fold_2", *window, ["previous_hour"], str(root / "export"))
    assert spark.read.json(f"{root}/export/hours").count() == 24


def test_jobs_find_a_zone_that_the_panel_lacks(spark, root, panel):
    short = root / "short"
    spark.read.parquet(f"{root}/prepared/zones").write.parquet(f"{short}/zones")
    spark.read.parquet(panel).where("zone_id <> 4").write.partitionBy("month").parquet(f"{short}/panel")
    lacking = f"{short}/panel"
    with pytest.raises(ValueError):
        study.backtest(spark, lacking, *ARGS, str(root / "short_study"))
    with pytest.raises(ValueError):
        study.report(spark, lacking, str(root / "study"), START, BOUNDARIES[0], BOUNDARIES[-1], "zone_hour_average", str(root / "short_report"))
    spark.read.parquet(f"{root}/study/predictions").where("zone_id <> 4").write.parquet(str(root / "short_saved" / "predictions"))
    window = (utc_midnight("2026-03-10"), utc_midnight("2026-03-11"))
    with pytest.raises(ValueError):
        study.export(spark, lacking, str(root / "short_saved"), "fold_2", *window, ["previous_hour"], str(root / "short_export"))


def test_fitted_studies(spark, root, panel):
    features, out = str(root / "features"), str(root / "fitted")
    fitted.save_features(spark, panel, START, BOUNDARIES[-1], features, boroughs=("Queens", "Bronx"))
    fits = {"ridge": models.fit_ridge, **models.bundle_fits({"borough_context": ["borough_other_mean_lag_1"]}, rounds=2)}
    fitted.fitted_study(spark, features, *ARGS, fits, out, contrasts=[("ridge", "previous_week_168h")], parameters={"rounds": 2})
    record = spark.read.json(f"{out}/record").first()
    assert record.champion is not None and '"rounds": 2' in record.parameters and "fold_1" in record.training_rows
    assert spark.read.parquet(f"{out}/predictions").where("ridge IS NULL OR borough_context IS NULL").count() == 0
    fitted.fitted_study(spark, features, *ARGS, {"linear": models.fit_linear}, str(root / "second"), control=out)
    with pytest.raises(ValueError):
        fitted.fitted_study(spark, features, *ARGS, {"linear": models.fit_linear}, str(root / "third"), control=out, embargo_hours=3)


def test_fitted_delays(spark, root, panel):
    features, out = str(root / "delayed"), str(root / "delays")
    fitted.save_delayed_features(spark, panel, START, BOUNDARIES[-1], features, (0, 3))
    fitted.delay_study(spark, features, *ARGS, {"ridge": models.fit_ridge}, out, (0, 3))
    effects = spark.read.csv(f"{out}/effects_ridge", header=True, inferSchema=True)
    assert effects.where("delay_hours = 3").count() > 0 and effects.where("delay_hours = 0 AND mae_change <> 0").count() == 0


def test_audit_tables(spark, root, panel):
    trips = sources.read_trips(spark, *[str(root / f"trips_{m}.parquet") for m in ("2026-02", "2026-03")])
    zones = sources.load_zones(sources.read_zones_csv(spark, str(root / "zones.csv")))
    made = quality.audit_tables(trips, zones, START, BOUNDARIES[-1])
    repeated = made["duplicate_share"].first()
    assert repeated.exact_duplicate_excess == made["duplicates_by_zone"].agg(F.sum("exact_duplicate_excess")).first()[0]
    assert made["series_summary"].count() == 2


def test_weather_job(spark, root):
    raw(spark, DATE="2026-01-01T06:10:00").write.parquet(str(root / "station"))
    out = str(root / "weather")
    stations = {"a": ("s", 40.0, -73.0)}
    weather.weather_job(spark, [str(root / "station")], stations, datetime(2026, 1, 1), datetime(2026, 1, 2), out)
    assert spark.read.parquet(f"{out}/snapshots").count() == 24 * 4
    assert spark.read.parquet(f"{out}/bundles").count() == 24 * 2
    with pytest.raises(ValueError, match="coordinates_off"):
        weather.weather_job(spark, [str(root / "station")], {"a": ("s", 41.0, -73.0)}, datetime(2026, 1, 1), datetime(2026, 1, 2), out + "2")
