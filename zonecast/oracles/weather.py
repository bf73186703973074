"""Check queries of observations, snapshots and bundles."""

from zonecast.oracles.parts import check, checks, cte, local, r

START, STOP = "2024-02-20 05:00:00", "2024-03-18 04:00:00"
FIELDS = {"temperature": "temperature_c", "dew_point_temperature": "dew_point_c", "wind_speed": "wind_speed_m_s"}
VALUES = tuple(FIELDS.values())
STATIONS = {"clk": "click", "err": "error", "viw": "view"}
DELAYS = (0, 1, 3, 6)
MAX_AGE = 12

cte(
    "x_sensor",
    """SELECT event_type || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS "STATION", "DATE", k, v FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type, "DATE" ORDER BY event_id) AS n FROM (
      SELECT event_type, event_id, strftime(p, '%Y-%m-%dT%H:%M:%S') AS "DATE", k, value AS v FROM x_moved))""",
)
SOURCE = "['223', '412', '413', '999'][k % 4 + 1]"
QUALITY = "['1', '1', '1', NULL, '2'][k % 5 + 1]"
REPORT = "['FM15', 'FM12', 'FM16', 'FM94_1', 'SAO', 'FM15'][k % 6 + 1]"
PLAIN = "CASE WHEN k % 7 = 0 THEN 'A' ELSE '' END"
WIND = "CASE k % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE '' END"
MEASURED = {
    "temperature": "CASE WHEN k % 11 <> 0 THEN v / 10 - 5 END",
    "dew_point_temperature": "CASE WHEN k % 13 <> 0 THEN v / 10 - 9 END",
    "wind_speed": "CASE WHEN k % 17 <> 0 THEN k / 5 - 1 END",
    "precipitation": "CASE WHEN k % 3 = 0 THEN k / 10 END",
}
columns = ", ".join(
    f"{value} AS {field}, {SOURCE} AS \"{field}_Source_Code\", {QUALITY} AS \"{field}_Quality_Code\", "
    f"{WIND if field == 'wind_speed' else PLAIN} AS \"{field}_Measurement_Code\", {REPORT} AS \"{field}_Report_Type\""
    for field, value in MEASURED.items()
)
cte(
    "x_raw",
    f"""SELECT "STATION", "DATE", 40.0::DOUBLE + k / 20000 AS "LATITUDE", -73.0::DOUBLE - k / 20000 AS "LONGITUDE", {columns} FROM x_sensor""",
)
FLOATS = ("LATITUDE", "LONGITUDE", *MEASURED)
check(
    "read_station_files",
    "SELECT * REPLACE (" + ", ".join(f'{r(chr(34) + c + chr(34))} AS "{c}"' for c in FLOATS) + """) FROM x_raw
  WHERE "DATE" >= '2024-02-25T05:00:00' AND "DATE" < '2024-03-05T05:00:00'""",
)
TEXTS = (START.replace(" ", "T"), STOP.replace(" ", "T"))
cte(
    "x_parsed",
    f"""SELECT "STATION" AS station_id, strptime("DATE", '%Y-%m-%dT%H:%M:%S') AS observed_at, * EXCLUDE ("STATION", "DATE")
  FROM x_raw WHERE "DATE" >= '{TEXTS[0]}' AND "DATE" < '{TEXTS[1]}'""",
)
check(
    "parse_observations",
    "SELECT station_id, observed_at, " + ", ".join(f"{r(f)} AS {f}" for f in MEASURED) + " FROM x_parsed",
)
bounded = f"""(SELECT * FROM x_raw WHERE "DATE" >= '{TEXTS[0]}' AND "DATE" < '{TEXTS[1]}')"""
check(
    "check_station",
    checks(
        ("malformed_date", """SELECT count(*) FROM x_raw WHERE length("DATE") <> 19"""),
        ("unknown_station", f"""SELECT count(*) FROM {bounded} WHERE "STATION" NOT IN ('click', 'error')"""),
        (
            "coordinates_off",
            f"""SELECT count(*) FROM {bounded} WHERE "STATION" IN ('click', 'error')
      AND (abs("LATITUDE" - 40.0) > 0.004 OR abs("LONGITUDE" + 73.0) > 0.004)""",
        ),
        ("infinite_value", "SELECT 0"),
        ("duplicate_time", f"""SELECT count(*) - count(DISTINCT ("STATION", "DATE")) FROM {bounded}"""),
    ),
)


def good(field):
    a = lambda s: f"coalesce(\"{field}{s}\", '')"
    extra = (
        f"{a('_Measurement_Code')} IN ('C', 'N', 'V') AND {field} >= 0"
        if field == "wind_speed"
        else f"{a('_Measurement_Code')} = ''"
    )
    if field == "precipitation":
        return "false"
    return (
        f"({field} IS NOT NULL AND {a('_Source_Code')} = '223' AND {a('_Quality_Code')} = '1' "
        f"AND {a('_Report_Type')} IN ('FM12', 'FM15', 'FM16') AND {extra})"
    )


def unverified(field):
    if field == "precipitation":
        return "false"
    a = lambda s: f"coalesce(\"{field}{s}\", '')"
    base = f"{field} IS NOT NULL AND {a('_Quality_Code')} = '' AND {a('_Measurement_Code')} = ''"
    hourly = f"({a('_Source_Code')} = '413' AND {a('_Report_Type')} IN ('FM15', 'FM16'))"
    if field == "wind_speed":
        return f"({base} AND {hourly} AND {field} >= 0)"
    other = f"({a('_Source_Code')} = '412' AND {a('_Report_Type')} IN ('FM12', 'FM94_1'))"
    return f"({base} AND ({hourly} OR {other}))"


check(
    "quality_good",
    "SELECT station_id, observed_at, "
    + ", ".join(f"coalesce({good(f)}, false) AS {v}_good" for f, v in FIELDS.items())
    + " FROM x_parsed",
)
check(
    "quality_unverified",
    "SELECT station_id, observed_at, "
    + ", ".join(f"coalesce({unverified(f)}, false) AS {v}_unverified" for f, v in FIELDS.items())
    + " FROM x_parsed",
)
status = ", ".join(
    f"CASE WHEN {good(f)} OR {unverified(f)} THEN {f} END AS {v}, "
    f"CASE WHEN {f} IS NULL THEN 'missing' WHEN {good(f)} THEN 'good' WHEN {unverified(f)} THEN 'unverified' ELSE 'rejected' END AS {v}_quality, "
    f"coalesce(\"{f}_Source_Code\", '') AS {v}_source"
    for f, v in FIELDS.items()
)
cte("x_status", f"SELECT station_id, observed_at, {status}, temperature IS NOT NULL OR dew_point_temperature IS NOT NULL OR wind_speed IS NOT NULL AS core FROM x_parsed")
cte("x_obs", "SELECT * EXCLUDE (core) FROM x_status WHERE core")
three = ", ".join(f"{r(v)} AS {v}" for v in VALUES)
check("quality_status", f"SELECT * EXCLUDE (core) REPLACE ({three}) FROM x_status")
check("core_rows", f"SELECT * REPLACE ({three}) FROM x_obs")
flat = "\nUNION ALL\n".join(
    f"""SELECT station_id, strftime({local('observed_at')}, '%Y-%m') AS month, '{f}' AS variable,
    coalesce("{f}_Source_Code", '') AS source, coalesce("{f}_Quality_Code", '') AS quality,
    coalesce("{f}_Measurement_Code", '') AS measurement, coalesce("{f}_Report_Type", '') AS report_type,
    {f} IS NOT NULL AS seen, coalesce({good(f)}, false) AS g, coalesce({unverified(f)}, false) AS u FROM x_parsed"""
    for f in MEASURED
)
check(
    "quality_flag_counts",
    f"""SELECT month, source, quality, measurement, report_type, station_id, variable, count(*) AS rows,
    count(*) FILTER (seen) AS present, count(*) FILTER (g OR u) AS accepted,
    count(*) FILTER (seen AND NOT (g OR u)) AS policy_excluded, count(*) FILTER (g) AS accepted_good,
    count(*) FILTER (u) AS accepted_unverified FROM ({flat}) GROUP BY ALL""",
)
check(
    "check_observations",
    checks(
        ("missing_station", "SELECT 0"),
        ("missing_time", "SELECT 0"),
        *[(f"infinite_{v}", "SELECT 0") for v in VALUES],
        ("duplicate_key", "SELECT count(*) - count(DISTINCT (station_id, date_trunc('minute', observed_at))) FROM x_obs"),
    ),
)
cte("x_targets", f"SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{STOP}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour")
cte(
    "x_asked",
    f"""SELECT station_id, hour, delay_hours FROM (SELECT DISTINCT station_id FROM x_obs) CROSS JOIN x_targets
  CROSS JOIN (SELECT unnest({list(DELAYS)}) AS delay_hours)""",
)
STATES = [f"{v}_{k}" for v in VALUES for k in ("quality", "source")]
valid = f"(o.observed_at + INTERVAL {MAX_AGE} HOUR >= a.hour)"
carried = ", ".join(f"CASE WHEN {valid} THEN o.{c} END AS {c}" for c in VALUES)
states = ", ".join(
    f"CASE WHEN {valid} THEN o.{v}_quality ELSE 'missing' END AS {v}_quality, CASE WHEN {valid} THEN o.{v}_source ELSE '' END AS {v}_source"
    for v in VALUES
)
cte(
    "x_snap",
    f"""SELECT a.hour, a.station_id, CASE WHEN {valid} THEN o.observed_at END AS observed_at,
    CASE WHEN {valid} THEN o.observed_at + to_hours(a.delay_hours) END AS assumed_available_at,
    CASE WHEN {valid} THEN epoch(a.hour - o.observed_at) / 3600 END AS age_hours, {carried}, {states}, a.delay_hours
  FROM (SELECT *, hour - to_hours(delay_hours) AS cut FROM x_asked) a
  ASOF LEFT JOIN x_obs o ON o.station_id = a.station_id AND a.cut > o.observed_at""",
)
age = f"{r('age_hours')} AS age_hours"
check(
    "asof_snapshot",
    f"""SELECT hour, station_id, observed_at, assumed_available_at, {age}, {three}, delay_hours FROM x_snap WHERE delay_hours = 1""",
)
check("delay_scenarios", f"SELECT * REPLACE ({age}, {three}) FROM x_snap")
check("snapshot_quality", f"SELECT station_id, hour, {', '.join(STATES)} FROM x_snap WHERE delay_hours = 3")
s3 = "(SELECT * FROM x_snap WHERE delay_hours = 3)"
named = f"(SELECT * FROM {s3} WHERE station_id IN ('click', 'error', 'view'))"
check(
    "check_snapshots",
    checks(
        ("metadata_not_missing_together", "SELECT 0"),
        ("wrong_availability", f"SELECT count(*) FROM {named} WHERE assumed_available_at <> observed_at + INTERVAL 1 HOUR"),
        ("not_strictly_past", f"SELECT count(*) FROM {named} WHERE assumed_available_at >= hour"),
        ("age_out_of_range", f"SELECT count(*) FROM {named} WHERE age_hours <= 0 OR age_hours > 12"),
        ("age_disagrees", "SELECT 0"),
        ("age_without_observation", "SELECT 0"),
        ("unknown_quality", "SELECT 0"),
        ("quality_disagrees_with_value", f"SELECT count(*) FROM {named} WHERE (temperature_c_quality IN ('good', 'unverified')) <> (temperature_c IS NOT NULL)"),
        ("unmatched_not_missing", "SELECT 0"),
        ("duplicate_key", "SELECT 0"),
        ("missing_snapshot", f"SELECT (SELECT count(*) * 3 FROM x_targets) - (SELECT count(*) FROM {named})"),
        ("unexpected_snapshot", "SELECT 0"),
    ),
)
cte(
    "x_values",
    "\nUNION ALL\n".join(
        f"SELECT station_id, '{v}' AS variable, date_trunc('hour', observed_at) AS hour, {v} AS value, {v}_quality AS quality FROM x_obs"
        for v in VALUES
    ),
)
cte(
    "x_present",
    """SELECT s.station_id, s.variable, t.hour, EXISTS (SELECT 1 FROM x_values x WHERE x.station_id = s.station_id
    AND x.variable = s.variable AND x.hour = t.hour AND x.value IS NOT NULL) AS present
  FROM (SELECT DISTINCT station_id, variable FROM x_values) s CROSS JOIN x_targets t""",
)


def runs(table, keys):
    return f"""SELECT {keys}, max(run)::BIGINT AS longest_missing_hours FROM (
    SELECT {keys}, g, count(*) FILTER (NOT present) AS run FROM (
      SELECT *, sum(present::INT) OVER (PARTITION BY {keys} ORDER BY hour) AS g FROM {table}) GROUP BY ALL) GROUP BY ALL"""


check(
    "native_coverage",
    f"""SELECT v.station_id, v.variable, (SELECT count(*) FROM {bounded} b WHERE b."STATION" = v.station_id) AS source_rows,
    count(*) AS core_observation_rows, count(DISTINCT hour) AS core_observed_hours, count(value) AS accepted_values,
    count(DISTINCT hour) FILTER (value IS NOT NULL) AS accepted_hours, (SELECT count(*) FROM x_targets) AS expected_hours,
    any_value(l.longest_missing_hours) AS longest_missing_hours, {r('min(value)')} AS min, {r('max(value)')} AS max,
    count(*) FILTER (quality = 'good') AS accepted_good_values, count(DISTINCT hour) FILTER (quality = 'good') AS accepted_good_hours,
    count(*) FILTER (quality = 'unverified') AS accepted_unverified_values,
    count(DISTINCT hour) FILTER (quality = 'unverified') AS accepted_unverified_hours
  FROM x_values v JOIN ({runs('x_present', 'station_id, variable')}) l ON l.station_id = v.station_id AND l.variable = v.variable
  GROUP BY v.station_id, v.variable""",
)
check(
    "longest_missing_run",
    runs("(SELECT station_id, delay_hours, hour, temperature_c IS NOT NULL AS present FROM x_snap WHERE delay_hours IN (1, 3))", "station_id, delay_hours"),
)
complete = " AND ".join(f"{v} IS NOT NULL" for v in VALUES)
check(
    "availability_coverage",
    f"""SELECT station_id, strftime({local('hour')}, '%Y-%m') AS month, delay_hours, count(*) AS target_hours,
    count(observed_at) AS matched_observation_hours, count(*) FILTER ({complete}) AS complete_hours,
    {r(f'avg(({complete})::INT)')} AS complete_fraction, """
    + ", ".join(
        f"count({v}) AS {v}_hours, count(*) FILTER ({v}_quality = 'good') AS {v}_good_hours, count(*) FILTER ({v}_quality = 'unverified') AS {v}_unverified_hours"
        for v in VALUES
    )
    + f""", count(*) FILTER ({' AND '.join(f"{v}_quality = 'good'" for v in VALUES)}) AS complete_good_hours,
    count(*) FILTER ({complete} AND ({' OR '.join(f"{v}_quality = 'unverified'" for v in VALUES)})) AS complete_unverified_hours
  FROM x_snap GROUP BY 1, 2, 3""",
)


def bundle_columns(aliases=STATIONS):
    out = []
    for alias, station in aliases.items():
        f = f"FILTER (station_id = '{station}')"
        out += [f"max({v}) {f} AS weather_{alias}_{v}" for v in VALUES]
        out += [f"(count({v}) {f} = 0)::INTEGER AS weather_{alias}_{v}_missing" for v in VALUES]
        out += [f"(count(*) FILTER (station_id = '{station}' AND {v}_quality = 'unverified') > 0)::INTEGER AS weather_{alias}_{v}_unverified" for v in VALUES]
        out.append(f"max(age_hours) {f} AS weather_{alias}_age_hours")
    return out


def feature_names(aliases=STATIONS):
    return [c.rsplit(" AS ", 1)[1] for c in bundle_columns(aliases)]


def is_double(name):
    return not name.endswith(("_missing", "_unverified"))


cte("x_bundle", f"SELECT delay_hours, hour, {', '.join(bundle_columns())} FROM x_snap GROUP BY 1, 2")


def replaced(names):
    return "* REPLACE (" + ", ".join(f"{r(n)} AS {n}" for n in names if is_double(n)) + ")"


check("weather_bundle", f"SELECT {replaced(feature_names())} FROM x_bundle WHERE delay_hours IN (1, 3)")
check(
    "bundle_summary",
    "\nUNION ALL\n".join(
        f"""SELECT delay_hours, '{n}' AS feature, count(*) AS rows, count(*) FILTER ({n} IS NULL) AS missing_rows, {r(f'min({n})')} AS min,
    {r(f'max({n})')} AS max, {r(f'avg({n})')} AS mean FROM x_bundle WHERE delay_hours IN (1, 3) GROUP BY 1"""
        for n in feature_names()
    ),
)
check(
    "append_weather",
    "SELECT a.zone_id, a.hour, a.demand, "
    + ", ".join(f"{r(f'b.{n}')} AS {n}" if is_double(n) else f"b.{n}" for n in feature_names())
    + " FROM (SELECT * FROM x_assigned WHERE role = 'validation') a LEFT JOIN x_bundle b ON b.hour = a.hour AND b.delay_hours = 3",
)
check(
    "check_append",
    checks(
        ("bad_key", "SELECT 0"),
        ("infinite_value", "SELECT 0"),
        ("column_clash", "SELECT 0"),
        ("duplicate_hour", "SELECT 0"),
        ("left_row_without_hour", "SELECT count(*) FROM x_assigned WHERE hour < TIMESTAMP '2024-03-01'"),
    ),
)
nulls = " + ".join(f"({n} IS NULL)::INT" for n in feature_names())
check(
    "weather_preflight",
    f"""SELECT fold, delay_hours AS weather_delay_hours, count(*) FILTER (role = 'train') AS training_rows,
    count(*) FILTER (role = 'validation') AS validation_rows, 0::BIGINT AS weather_filter_rows_removed,
    sum(m) FILTER (role = 'train')::BIGINT AS training_missing_weather_cells,
    sum(m) FILTER (role = 'validation')::BIGINT AS validation_missing_weather_cells
  FROM x_assigned a JOIN (SELECT delay_hours, hour, {nulls} AS m FROM x_bundle WHERE delay_hours IN (1, 3)) b ON b.hour = a.hour
  GROUP BY 1, 2""",
)
check("verify_asof", "SELECT side, 0::BIGINT AS rows FROM (VALUES ('left_only'), ('right_only')) AS t(side)")
purchases = "SELECT 'click' AS station_id, p AS hour, 1 AS delay_hours, p - INTERVAL 1 HOUR AS cut FROM x_moved WHERE event_type = 'purchase'"
check(
    "asof_any_target",
    f"""SELECT a.hour, a.station_id, CASE WHEN {valid} THEN o.observed_at END AS observed_at,
    CASE WHEN {valid} THEN o.observed_at + INTERVAL 1 HOUR END AS assumed_available_at,
    {r(f'CASE WHEN {valid} THEN epoch(a.hour - o.observed_at) / 3600 END')} AS age_hours,
    {', '.join(f'{r(f"CASE WHEN {valid} THEN o.{v} END")} AS {v}' for v in VALUES)}, a.delay_hours
  FROM ({purchases}) a ASOF LEFT JOIN x_obs o ON o.station_id = a.station_id AND a.cut > o.observed_at""",
)
