import csv
import glob
import shutil
import io
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from frames import checks, panel
from zonecast.operators import contracts, explorer
from zonecast.session import cut_lineage
from zonecast.sources import tables as sources


def test_panel_round_trip_and_pushdown(spark, tmp_path):
    path = str(tmp_path / "panel")
    sources.write_panel(panel(spark, 1200), path)
    assert len(glob.glob(f"{path}/month=*")) == 2
    part = sources.read_window(spark, path, datetime(2026, 1, 31), datetime(2026, 2, 2))
    assert part.count() == 2 * 48 and "month" not in part.columns
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(hour" in plan and "LessThan(hour" in plan and "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(Exception):
        sources.write_panel(panel(spark, 2), path)


def test_trip_files_carry_their_month(spark, tmp_path):
    for month in ("2026-01", "2026-02"):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / f"trips_{month}"))
        spark.range(4).write.parquet(str(tmp_path / "by" / f"month={month}"))
        part = glob.glob(f"{tmp_path}/trips_{month}/part-*")[0]
        shutil.copy(part, tmp_path / f"yellow_{month}.parquet")
    shutil.copy(part, tmp_path / "nameless.parquet")
    shutil.copy(part, tmp_path / "part-00000-3543-2026.parquet")
    months = lambda *paths: sorted(r["file_month"] for r in sources.read_trips(spark, *paths).collect())
    want = ["2026-01"] * 3 + ["2026-02"] * 3
    assert months(*glob.glob(f"{tmp_path}/trips_2026-0[12]")) == want
    assert months(*glob.glob(f"{tmp_path}/yellow_*")) == want
    assert months(*glob.glob(f"{tmp_path}/by/*")) == ["2026-01"] * 4 + ["2026-02"] * 4
    for name in ("nameless.parquet", "part-00000-3543-2026.parquet"):
        with pytest.raises(Exception, match="No month"):
            months(str(tmp_path / name))
    assert "file_month" not in sources.read_trips(spark, str(tmp_path / "nameless.parquet"), month_pattern=None).columns
    both = spark.createDataFrame([("2026-01",), ("2026-02",), (None,)], "file_month string")
    assert sources.trips_of_months(both, "2026-02", "2026-03").count() == 1


def test_zone_csv(spark, tmp_path):
    path = tmp_path / "zones.csv"
    path.write_text('LocationID,Borough,Zone,service_zone\n3,Bronx,"A, B",x\n2,Queens,C,x\n1,EWR,Newark,x\n264,Unknown,,x\n')
    raw = sources.read_zones_csv(spark, str(path))
    assert [tuple(r) for r in sources.load_zones(raw).collect()] == [(2, "Queens", "C"), (3, "Bronx", "A, B")]
    assert not any(checks(contracts.check_zones(raw, ("Bronx", "Queens"))).values())
    assert checks(contracts.check_zones(raw.unionByName(raw), ("Bronx",)))["duplicate_id"] == 4


def test_daily_csv_fails_fast(spark, tmp_path):
    path = tmp_path / "daily.csv"
    path.write_text("fold,date_nyc,model,rows,mae\nf,2026-01-01,m,48,1.5\n")
    assert sources.read_daily_errors(spark, str(path)).first().mae == 1.5
    path.write_text("fold,date_nyc,model,rows,mae\nf,2026-01-01,m,many,1.5\n")
    with pytest.raises(Exception):
        sources.read_daily_errors(spark, str(path)).collect()


def test_run_record_refuses_nan(spark, tmp_path):
    record = spark.createDataFrame([("run", 1.5, None)], "name string, mae double, r2 double")
    sources.write_run_record(record, str(tmp_path / "a"))
    text = open(glob.glob(f"{tmp_path}/a/*.json")[0]).read()
    assert '"r2":null' in text
    with pytest.raises(ValueError):
        sources.write_run_record(record.withColumn("mae", F.lit(float("nan"))), str(tmp_path / "b"))


def test_report_table(spark, tmp_path):
    sources.write_report_table(panel(spark, 2).coalesce(1), str(tmp_path / "r"))
    assert open(glob.glob(f"{tmp_path}/r/*.csv")[0]).readline().strip() == "zone_id,hour,demand,borough"


def test_quoted_csv(spark, tmp_path):
    rows = spark.createDataFrame([('A, "B"\nC', "x", 1.25)], "zone_name string, model string, estimate double")
    columns = ["zone_name", "model", "estimate"]
    assert sources.export_csv_quoted(rows, columns).first().line == '"A, ""B""\nC",x,1.25'
    sources.write_csv_quoted(rows.coalesce(1), str(tmp_path / "c"), columns)
    with open(glob.glob(f"{tmp_path}/c/*.txt")[0], newline="") as f:
        text = f.read()
    assert text.endswith("\r\n")
    assert list(csv.reader(io.StringIO(text))) == [columns, ['A, "B"\nC', "x", "1.25"]]


def test_station_files_of_two_years(spark, tmp_path):
    from test_weather import raw

    first, second = str(tmp_path / "2025"), str(tmp_path / "2026")
    raw(spark, DATE="2025-12-31T23:00:00").write.parquet(first)
    raw(spark).withColumn("extra", F.lit(1)).write.parquet(second)
    made = sources.read_station_files(spark, [first, second], "2025-12-31T00:00:00", "2026-01-01T06:10:00")
    assert [r.DATE for r in made.collect()] == ["2025-12-31T23:00:00"]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(DATE" in plan and "extra" not in plan


def test_zone_search(spark):
    zones = spark.createDataFrame([(7, "Queens", "Long  Island City"), (42, "Bronx", "Zone 7")], "zone_id int, borough string, Zone string")
    ids = lambda *a: [r.zone_id for r in explorer.zone_search(zones, *a).collect()]
    assert ids(explorer.ALL_BOROUGHS, " 007 ") == [7]
    assert ids(explorer.ALL_BOROUGHS, " long ISLAND") == [7]
    assert ids("Bronx", "7") == [] and ids("Bronx", "") == [42]


def test_empty_hour_is_zero(spark):
    rows = panel(spark, 2).withColumn("m", F.col("demand") + 1.0)
    long = explorer.long_rows(rows, ["m"])
    row = explorer.one_hour_summary(long, "2030-01-01 00:00:00", explorer.ALL_BOROUGHS, "m").first()
    assert tuple(row) == (0.0, 0.0, 0.0)


def test_checkpoint_is_reliable(spark):
    made = cut_lineage(panel(spark, 3))
    assert made.count() == 6
    assert spark.sparkContext.getCheckpointDir() is not None


def trip_file(spark, path, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return str(path)


def test_trip_files_of_differing_schemas(spark, tmp_path):
    old = trip_file(spark, tmp_path / "trips_2026-01", "id int, fee float, n int, tag string", [(1, 0.5, 3, "a")])
    new = trip_file(spark, tmp_path / "trips_2026-02", "ID bigint, n double, extra string, fee double", [(1 << 40, 2.5, "x", 0.25)])
    last = trip_file(spark, tmp_path / "trips_2026-03", "id int, fee float, n int, tag string", [(7, 1.5, None, None)])
    got = sources.read_trips(spark, old, new, last)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema.fields] == [
        ("id", "bigint"), ("fee", "double"), ("n", "double"), ("tag", "string"), ("extra", "string"), ("file_month", "string"),
    ]
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 0.5, 3.0, "a", None, "2026-01"),
        (7, 1.5, None, None, None, "2026-03"),
        (1 << 40, 0.25, 2.5, None, "x", "2026-02"),
    ]
    # Paths of one schema share a scan, and filters reach every scan.
    plan = got.where("id > 5")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("GreaterThan(") == 2


def test_conflicting_files_under_one_path(spark, tmp_path):
    for month, kind in (("2026-01", "int"), ("2026-02", "bigint")):
        trip_file(spark, tmp_path / "all" / f"month={month}", f"id {kind}, v string", [(1, month)])
    assert sources.file_schema(spark, str(tmp_path / "all")) is None
    got = sources.read_trips(spark, str(tmp_path / "all"))
    assert sorted((r["id"], r["v"], r["file_month"]) for r in got.collect()) == [(1, "2026-01", "2026-01"), (1, "2026-02", "2026-02")]
    text = trip_file(spark, tmp_path / "trips_2026-03", "id string", [("1",)])
    with pytest.raises(ValueError, match="id as int and as string"):
        sources.read_trips(spark, str(tmp_path / "all" / "month=2026-01"), text)
    with pytest.raises(Exception, match="nowhere"):
        sources.read_trips(spark, str(tmp_path / "nowhere"))


def test_schema_of_every_file_is_judged(spark, tmp_path):
    good = ", ".join(f"{c} {'timestamp_ntz' if c.endswith('datetime') else 'int'}" for c in contracts.TRIP_COLUMNS)
    paths = [
        trip_file(spark, tmp_path / "a_2026-01", good, []),
        trip_file(spark, tmp_path / "a_2026-02", good.replace("PULocationID int", "PULocationID double").replace("timestamp_ntz", "timestamp"), []),
        trip_file(spark, tmp_path / "a_2026-03", "fare_amount int", []),
    ]
    found = contracts.check_file_schemas(spark, sources.path_schemas(spark, paths))
    bad = {(r["file"][-7:], r["check"]): r["bad_columns"] for r in found.collect() if r["bad_columns"]}
    assert bad == {("2026-02", "fractional_id"): 1, ("2026-02", "zoned_time"): 2, ("2026-03", "missing_column"): 7}
