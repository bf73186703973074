"""Readers and writers: trips, lookup, panel windows, station files, error tables, exports."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast.functions.clock import instant, month_text
from zonecast.functions.tables import finite
from zonecast.settings import (
    ATTRIBUTE_SUFFIXES,
    AUDITED_FIELDS,
    BOROUGHS,
    EXPORT_COLUMNS,
)

ZONE_SCHEMA = "LocationID INT, Borough STRING, Zone STRING, service_zone STRING"
DAILY_SCHEMA = "fold STRING, date_nyc STRING, model STRING, rows BIGINT, mae DOUBLE"


FOLDER_MONTH = r"/(?:file_)?month=(\d{4}-(?:0[1-9]|1[0-2]))(?:-\d{2})?/"
NAMED_MONTH = r"(?:^|[^0-9])((?:19|20)\d{2}-(?:0[1-9]|1[0-2]))(?:[^0-9]|$)"


def file_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema of all files of a path, their footers read by a Spark job; None where types of one column conflict."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path).schema
    except Exception as error:  # Spark names this error differently by reader and version
        if "MERGE" in str(error).upper():
            return None
        raise


def path_schemas(spark: SparkSession, paths) -> list[tuple[str, T.StructType]]:
    """(path, schema) per path; a path whose files conflict is given file by file."""
    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(lambda path: file_schema(spark, path), paths))
    out = []
    for path, schema in zip(paths, found, strict=True):
        if schema is not None:
            out.append((path, schema))
            continue
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path")
        out += path_schemas(spark, sorted(row["path"] for row in listed.collect()))
    return out


WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]


def wider(name: str, a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds the values of both: of two whole ones the wider, a double for a fraction and a whole number."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if a in WHOLE and b in WHOLE:
        return max(a, b, key=WHOLE.index)
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        whole = max(a.precision - a.scale, b.precision - b.scale)
        if whole + scale <= 38:
            return T.DecimalType(whole + scale, scale)
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType) and T.DoubleType() in (a, b) or {a, b} <= {T.FloatType(), *WHOLE}:
        return T.DoubleType()
    raise ValueError(f"Trip files hold {name} as {a.simpleString()} and as {b.simpleString()}")


def common_columns(schemas: list[T.StructType]) -> dict[str, T.StructField]:
    """Every column of any schema by its lower-case name, as wide as all of them need; the first spelling stays."""
    common: dict[str, T.StructField] = {}
    for schema in schemas:
        for field in schema.fields:
            held = common.get(field.name.lower())
            kind = field.dataType if held is None else wider(held.name, held.dataType, field.dataType)
            common[field.name.lower()] = T.StructField(held.name if held else field.name, kind)
    return common


def read_reconciled(spark: SparkSession, *paths: str, derived: dict[str, Column] | None = None) -> DataFrame:
    """Parquet files of differing schemas as one table: columns meet by name, a file without one gives NULL.

    Spark alone takes one file's schema, so that a wider type fails and a further column is dropped without a word. Here paths of equal
    schema are one scan, and the scans, as few as there are schemas, are widened and united; filters and column selection
    still reach each of them. ``derived`` columns, of ``_metadata`` for example, are computed in each scan.
    """
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for path, schema in path_schemas(spark, paths):
        groups.setdefault(schema.json(), (schema, []))[1].append(path)
    common = common_columns([schema for schema, _ in groups.values()])
    parts = []
    for schema, own in groups.values():
        rows = spark.read.schema(schema).parquet(*own)
        held = {field.name.lower(): field.name for field in schema.fields}
        cells = [
            (F.col(f"`{held[key]}`") if key in held else F.lit(None)).cast(field.dataType).alias(field.name)
            for key, field in common.items()
        ]
        parts.append(rows.select(*cells, *[column.alias(name) for name, column in (derived or {}).items()]))
    return reduce(DataFrame.unionAll, parts)


def read_trips(spark: SparkSession, *paths: str, month_pattern: str | None = NAMED_MONTH) -> DataFrame:
    """Monthly trip files, whose schemas may differ, as one table with ``file_month``.

    The month stands in a ``month=`` folder or, delimited, in the file's own name; for the part files that Spark
    writes, whose names hold other numbers, it stands in the name of their folder. A file without a month
    is an error, because its rows could not be told from misfiled ones. With ``month_pattern`` None there is
    no such column and no check.
    """
    if month_pattern is None:
        return read_reconciled(spark, *paths)
    found = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    path, name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    own = F.when(name.startswith("part-"), F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)).otherwise(name)
    missing = F.raise_error(F.concat(F.lit("No month in the name of trip file "), path)).cast("string")
    month = F.coalesce(found(path, FOLDER_MONTH), found(own, month_pattern), missing)
    return read_reconciled(spark, *paths, derived={"file_month": month})


def trips_of_months(trips: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the files of an inclusive month range."""
    return trips.where(F.col("file_month").between(start, end))


def read_zones_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=ZONE_SCHEMA, header=True, enforceSchema=False)


def load_zones(raw: DataFrame, boroughs=BOROUGHS) -> DataFrame:
    """Lookup rows of the kept boroughs as ``zone_id, borough, Zone``, by id."""
    return (
        raw.where(F.col("Borough").isin(*boroughs))
        .select(
            F.col("LocationID").cast("int").alias("zone_id"),
            F.col("Borough").alias("borough"),
            "Zone",
        )
        .orderBy("zone_id")
    )


def window_of(panel: DataFrame, start, stop, column: str = "hour") -> DataFrame:
    """Half-open time window. On a Parquet scan both bounds reach the reader."""
    return panel.where((F.col(column) >= instant(start)) & (F.col(column) < instant(stop)))


def read_window(spark: SparkSession, path: str, start, stop) -> DataFrame:
    """A saved panel between two instants; labels beyond ``stop`` are never loaded."""
    panel = window_of(spark.read.parquet(path), start, stop)
    if "month" not in panel.columns:
        return panel
    # The partition column prunes folders; the row bounds stay exact.
    pruned = panel.where(
        F.col("month").cast("string").between(
            F.lit(str(start)[:7]), F.lit(str(stop)[:7])
        )
    )
    return pruned.drop("month")


def station_columns() -> list[str]:
    values = [field + suffix for field in AUDITED_FIELDS for suffix in ("", *ATTRIBUTE_SUFFIXES)]
    return ["STATION", "DATE", "LATITUDE", "LONGITUDE", *values]


def project_station_rows(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Needed columns and a half-open bound on the ISO text, which the reader can push down."""
    return raw.select(*station_columns()).where((F.col("DATE") >= start) & (F.col("DATE") < end))


def read_station_files(spark: SparkSession, paths: list[str], start: str, end: str) -> DataFrame:
    """Station-year files as one bounded table; extra columns may differ between years."""
    parts = [project_station_rows(spark.read.parquet(path), start, end) for path in paths]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def read_daily_errors(spark: SparkSession, path: str, schema: str = DAILY_SCHEMA) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def write_panel(panel: DataFrame, path: str) -> None:
    """Partitioned by UTC month, range-split by zone and hour inside it; never overwrites."""
    (
        panel.withColumn("month", month_text(F.col("hour")))
        .repartitionByRange("month", "zone_id", "hour")
        .sortWithinPartitions("month", "zone_id", "hour")
        .write.partitionBy("month")
        .mode("errorifexists")
        .parquet(path)
    )


def write_table(frame: DataFrame, path: str) -> None:
    """Features, observations, predictions, draws."""
    frame.write.mode("errorifexists").parquet(path)


def write_report_table(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").option("header", True).csv(path)


def write_run_record(record: DataFrame, path: str) -> None:
    """Parameters and scores as JSON. NaN and infinities are refused, NULL is kept."""
    doubles = [f.name for f in record.schema.fields if f.dataType.typeName() in ("double", "float")]
    if doubles:
        bad = F.lit(False)
        for name in doubles:
            bad = bad | F.coalesce(~finite(F.col(name)), F.lit(False))
        if not record.where(bad).isEmpty():
            raise ValueError("Run records must not contain NaN or infinities")
    # One row, so one file.
    record.coalesce(1).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def export_nested(predictions: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """``hour, values``: per hour one value array per zone, zones by id, columns as given."""
    values = F.array(*[F.round(F.col(c).cast("double"), digits) for c in columns])
    entry = F.struct(F.col("zone_id"), values.alias("cells"))
    return predictions.groupBy("hour").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["cells"]).alias("values")
    )


def csv_line(columns: list[str]):
    """One RFC-style line: quote a cell only when it holds a quote, comma or line break."""

    def cell(name):
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)

    return F.concat_ws(",", *[cell(name) for name in columns])


def export_csv_quoted(rows: DataFrame, columns=EXPORT_COLUMNS) -> DataFrame:
    """Data lines of the quoted export as ``line``."""
    return rows.select(csv_line(list(columns)).alias("line"))


def write_csv_quoted(rows: DataFrame, path: str, columns=EXPORT_COLUMNS) -> None:
    """CRLF lines under a header. One file per task; every file starts with the header."""
    header = F.lit(",".join(columns))
    lines = export_csv_quoted(rows, columns)
    numbered = lines.select(
        "line",
        (F.monotonically_increasing_id() % F.lit(1 << 33) == 0).alias("first"),
    )
    (
        numbered.select(
            F.explode(
                F.when(F.col("first"), F.array(header, F.col("line"))).otherwise(
                    F.array(F.col("line"))
                )
            ).alias("line")
        )
        .write.mode("errorifexists")
        .option("lineSep", "\r\n")
        .text(path)
    )
