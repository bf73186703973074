"""The driver tables seen as trips, zones, weather and geometry. Definitions are in FIXTURES.md."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonecast.functions.clock import hours, month_text
from zonecast.operators.panel import prepare_panel
from zonecast.session import new_path

# Events are moved by 50 days so that the window holds a month change and the skipped hour of
# 2024-03-10. All dates are local midnights.
SHIFT_DAYS = 50
START, STOP = "2024-02-20", "2024-03-21"
BOUNDARIES = ("2024-03-06", "2024-03-10", "2024-03-14", "2024-03-18")
SEALED = BOUNDARIES[-1]
SPARSE_MAX = 0.1
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
STATIONS = {"clk": "click", "err": "error", "viw": "view"}
COORDINATES = {"click": (40.0, -73.0), "error": (40.0, -73.0), "view": (40.0, -73.0)}
MAX_AGE_HOURS = 12


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def regions(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "r_name"
    )


def lookup(spark, sf):
    """A raw lookup as large as ``customer``: ``LocationID, Borough, Zone``."""
    return (
        table(spark, sf, "customer")
        .join(regions(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").cast("int").alias("LocationID"),
            F.col("r_name").alias("Borough"),
            F.col("c_name").alias("Zone"),
        )
    )


def zones(spark, sf):
    """Panel zones are the suppliers: ``zone_id, borough, Zone``."""
    return (
        table(spark, sf, "supplier")
        .join(regions(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").cast("int").alias("zone_id"),
            F.col("r_name").alias("borough"),
            F.col("s_name").alias("Zone"),
        )
    )


def trips(spark, sf):
    """Events as trips. Users beyond the suppliers are outside the lookup."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    moved = F.col("ts") + F.make_dt_interval(F.lit(SHIFT_DAYS))
    return table(spark, sf, "events").select(
        F.when(k % 10 != 0, F.col("event_type")).alias("VendorID"),
        moved.alias("tpep_pickup_datetime"),
        (moved + F.make_dt_interval(mins=k - 5)).alias("tpep_dropoff_datetime"),
        F.col("user_id").cast("int").alias("PULocationID"),
        k.alias("DOLocationID"),
        F.when(k % 4 != 0, F.lit(1.0)).alias("passenger_count"),
        (k - 3).cast("double").alias("trip_distance"),
        (F.col("value") - 5).alias("fare_amount"),
        (k % 5).alias("payment_type"),
        month_text(moved + hours(1)).alias("file_month"),
    )


def doubled_trips(spark, sf):
    """All trips, a third of them recorded two or three times with every column alike."""
    k = F.col("DOLocationID")
    copies = F.when(k % 7 == 0, 3).when(k % 5 == 0, 2).otherwise(1)
    return trips(spark, sf).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")


def trip_files(spark, sf):
    """The trips as files of two schemas, as a source changes over the months: March has wider ids, whole passenger
    counts and one column more. Returns the paths by month."""
    rows = trips(spark, sf)
    wide = rows.withColumns(
        {
            "PULocationID": F.col("PULocationID").cast("long"),
            "passenger_count": F.col("passenger_count").cast("int"),
            "airport_fee": F.col("DOLocationID") / 4,
        }
    )
    root, paths = new_path(spark, "trips"), {}
    for month, frame in (("2024-02", rows), ("2024-03", wide)):
        paths[month] = f"{root}/trips_{month}"
        frame.where(F.col("file_month") == month).drop("file_month").write.parquet(paths[month])
    return paths


def faulty_trip_file(spark, sf):
    """A month whose file breaks four rules of the schema."""
    path = f"{new_path(spark, 'trips')}/trips_2024-04"
    k = F.col("DOLocationID")
    (
        trips(spark, sf)
        .withColumns({"tpep_pickup_datetime": F.col("tpep_pickup_datetime").cast("timestamp"), "PULocationID": k / 2, "tags": F.create_map(k, k)})
        .drop("file_month", "payment_type", "fare_amount")
        .write.parquet(path)
    )
    return path


def panel(spark, sf, stop=STOP):
    return prepare_panel(trips(spark, sf), zones(spark, sf), START, stop)


def doubled_panel(spark, sf):
    return prepare_panel(doubled_trips(spark, sf), zones(spark, sf), START, STOP)


def order_days(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderdate").alias("day")).distinct()


def local_hours(spark, sf):
    """Every hour of every order date, including skipped and repeated local hours."""
    clock = F.sequence(F.lit(0), F.lit(23))
    return order_days(spark, sf).select("day", F.explode(clock).alias("h")).select(
        (F.col("day") + hours(F.col("h"))).alias("hour")
    )


def raw_weather(spark, sf):
    """All events as weather readings: each type is a station, and so is each further reading of a second."""
    k = F.col("k")
    source = F.element_at(F.array(*[F.lit(v) for v in ("223", "412", "413", "999")]), k % 4 + 1)
    quality = F.element_at(F.array(*[F.lit(v) for v in ("1", "1", "1", "", "2")]), k % 5 + 1)
    report = F.element_at(
        F.array(*[F.lit(v) for v in ("FM15", "FM12", "FM16", "FM94_1", "SAO", "FM15")]), k % 6 + 1
    )
    plain = F.when(k % 7 == 0, F.lit("A")).otherwise(F.lit(""))
    wind = F.when(k % 7 == 0, F.lit("A")).when(k % 7 == 1, F.lit("N")).otherwise(F.lit(""))
    at = F.col("ts") + F.make_dt_interval(F.lit(SHIFT_DAYS))
    # Readings of one type and second are given to stations of their own, so that none is dropped.
    same = Window.partitionBy("event_type", "DATE").orderBy("event_id")
    first = (
        table(spark, sf, "events")
        .select(
            "event_type",
            F.replace(F.substring(at.cast("string"), 1, 19), F.lit(" "), F.lit("T")).alias("DATE"),
            F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
            "value",
            "event_id",
        )
        .withColumn("n", F.row_number().over(same))
        .select(
            F.concat("event_type", F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n"))).otherwise("")).alias("STATION"),
            "DATE",
            "k",
            "value",
        )
    )
    measured = {
        "temperature": F.when(k % 11 != 0, F.col("value") / 10 - 5),
        "dew_point_temperature": F.when(k % 13 != 0, F.col("value") / 10 - 9),
        "wind_speed": F.when(k % 17 != 0, k / 5 - 1),
        "precipitation": F.when(k % 3 == 0, k / 10),
    }
    cells = []
    for field, value in measured.items():
        cells += [
            value.alias(field),
            source.alias(f"{field}_Source_Code"),
            F.when(quality != "", quality).alias(f"{field}_Quality_Code"),
            (wind if field == "wind_speed" else plain).alias(f"{field}_Measurement_Code"),
            report.alias(f"{field}_Report_Type"),
        ]
    return first.select(
        "STATION",
        "DATE",
        (F.lit(40.0) + k / 20000).alias("LATITUDE"),
        (F.lit(-73.0) - k / 20000).alias("LONGITUDE"),
        *cells,
    )


def squares(spark, sf):
    """One 1000-unit square per customer on a grid 100 wide; every third column sits 400 higher.

    Vertex table ``zone_id, borough, ring, seq, x, y``; rings are closed.
    """
    zone = F.col("LocationID")
    column, row = zone % 100, F.floor(zone / 100)
    corners = F.array(
        *[
            F.struct(F.lit(i).alias("seq"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
            for i, (dx, dy) in enumerate(((0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0), (0.0, 0.0)))
        ]
    )
    return lookup(spark, sf).select(
        zone.alias("zone_id"), F.col("Borough").alias("borough"), F.lit(0).alias("ring"),
        column.alias("c"), row.alias("r"), F.explode(corners).alias("p"),
    ).select(
        "zone_id", "borough", "ring", "p.seq",
        (F.col("c") * 1000 + F.col("p.dx")).alias("x"),
        (F.col("r") * 1000 + (F.when(F.col("c") % 3 == 1, 400.0).otherwise(0.0)) + F.col("p.dy")).alias("y"),
    )


def square_zones(spark, sf):
    return lookup(spark, sf).select(
        F.col("LocationID").alias("zone_id"), F.col("Borough").alias("borough"), "Zone"
    )

