"""Check queries of sources, contracts, panel and audit."""

from zonecast.oracles.parts import check, checks, cte, local, r, strict, utc

cte(
    "x_zones",
    """SELECT s_suppkey::INTEGER AS zone_id, r_name AS borough, s_name AS "Zone"
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
cte(
    "x_lookup",
    """SELECT c_custkey::INTEGER AS "LocationID", r_name AS "Borough", c_name AS "Zone"
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
cte(
    "x_moved",
    """SELECT *, regexp_extract(props, '(\\d+)', 1)::INTEGER AS k, ts + INTERVAL 50 DAY AS p FROM events""",
)
cte(
    "x_trips",
    """SELECT CASE WHEN k % 10 <> 0 THEN event_type END AS "VendorID",
    p AS tpep_pickup_datetime, p + to_minutes(k - 5) AS tpep_dropoff_datetime,
    user_id::INTEGER AS "PULocationID", k AS "DOLocationID",
    CASE WHEN k % 4 <> 0 THEN 1.0::DOUBLE END AS passenger_count,
    (k - 3)::DOUBLE AS trip_distance, value - 5 AS fare_amount, (k % 5)::INTEGER AS payment_type,
    strftime(p + INTERVAL 1 HOUR, '%Y-%m') AS file_month
  FROM x_moved""",
)
cte(
    "x_eligible",
    """SELECT * FROM x_trips
  WHERE tpep_pickup_datetime >= TIMESTAMP '2024-02-20' AND tpep_pickup_datetime < TIMESTAMP '2024-03-21'
    AND strftime(tpep_pickup_datetime, '%Y-%m') = file_month
    AND "PULocationID" IN (SELECT zone_id FROM x_zones)""",
)
cte(
    "x_local_counts",
    """SELECT "PULocationID" AS zone_id, date_trunc('hour', tpep_pickup_datetime) AS hour, count(*) AS demand
  FROM x_eligible GROUP BY 1, 2""",
)
cte(
    "x_counts",
    f"""SELECT zone_id, u AS hour, demand FROM (SELECT zone_id, {strict('hour')} AS u, demand FROM x_local_counts)
  WHERE u IS NOT NULL""",
)
cte(
    "x_spine",
    """SELECT unnest(generate_series(TIMESTAMP '2024-02-20 05:00:00', TIMESTAMP '2024-03-21 03:00:00', INTERVAL 1 HOUR)) AS hour""",
)
cte(
    "x_panel",
    """SELECT z.zone_id, s.hour, coalesce(c.demand, 0)::INTEGER AS demand, z.borough, z."Zone"
  FROM x_zones z CROSS JOIN x_spine s LEFT JOIN x_counts c ON c.zone_id = z.zone_id AND c.hour = s.hour""",
)
cte(
    "x_all_counts",
    """SELECT "PULocationID" AS zone_id, date_trunc('hour', tpep_pickup_datetime) AS hour, count(*) AS demand
  FROM x_trips GROUP BY 1, 2""",
)
cte(
    "x_doubled",
    """SELECT t.* FROM x_trips t, (VALUES (1), (2), (3)) AS c(i)
  WHERE i <= CASE WHEN "DOLocationID" % 7 = 0 THEN 3 WHEN "DOLocationID" % 5 = 0 THEN 2 ELSE 1 END""",
)
cte(
    "x_doubled_eligible",
    """SELECT * FROM x_doubled
  WHERE tpep_pickup_datetime >= TIMESTAMP '2024-02-20' AND tpep_pickup_datetime < TIMESTAMP '2024-03-21'
    AND strftime(tpep_pickup_datetime, '%Y-%m') = file_month
    AND "PULocationID" IN (SELECT zone_id FROM x_zones)""",
)
cte(
    "x_doubled_counts",
    f"""SELECT zone_id, u AS hour, demand FROM (
    SELECT zone_id, {strict('hour')} AS u, demand FROM (
      SELECT "PULocationID" AS zone_id, date_trunc('hour', tpep_pickup_datetime) AS hour, count(*) AS demand
      FROM x_doubled_eligible GROUP BY 1, 2))
  WHERE u IS NOT NULL""",
)
cte(
    "x_doubled_panel",
    """SELECT z.zone_id, s.hour, coalesce(c.demand, 0)::INTEGER AS demand, z.borough, z."Zone"
  FROM x_zones z CROSS JOIN x_spine s LEFT JOIN x_doubled_counts c ON c.zone_id = z.zone_id AND c.hour = s.hour""",
)
cte(
    "x_repeated",
    """SELECT *, count(*) AS copies FROM x_doubled_eligible GROUP BY ALL HAVING count(*) > 1""",
)
cte(
    "x_rollup",
    f"""SELECT * FROM (SELECT "PULocationID" AS zone_id, {strict('tpep_pickup_datetime')} AS hour,
    sum(copies - 1)::BIGINT AS duplicate_excess, count(*) AS duplicate_groups,
    sum(copies)::BIGINT AS repeated_rows, max(copies) AS max_copies
  FROM (SELECT * REPLACE (date_trunc('hour', tpep_pickup_datetime) AS tpep_pickup_datetime) FROM x_repeated)
  GROUP BY 1, 2) WHERE hour IS NOT NULL""",
)
cte(
    "x_vendor_hours",
    f"""SELECT * FROM (SELECT coalesce("VendorID", 'missing') AS vendor,
    {strict("date_trunc('hour', tpep_pickup_datetime)")} AS hour, count(*) AS demand
  FROM x_eligible GROUP BY 1, 2) WHERE hour IS NOT NULL""",
)
cte("x_city", "SELECT hour, sum(demand)::BIGINT AS demand FROM x_panel GROUP BY 1")
cte(
    "x_volumes",
    """SELECT 'vendor_' || v.vendor AS series, s.hour, coalesce(h.demand, 0)::BIGINT AS demand
  FROM (SELECT DISTINCT vendor FROM x_vendor_hours) v CROSS JOIN x_spine s
  LEFT JOIN x_vendor_hours h ON h.vendor = v.vendor AND h.hour = s.hour
  UNION ALL SELECT 'city', hour, demand FROM x_city""",
)
cte(
    "x_prior",
    """SELECT *, [x::DOUBLE FOR x IN [lag(demand, 168) OVER w, lag(demand, 336) OVER w,
      lag(demand, 504) OVER w, lag(demand, 672) OVER w] IF x IS NOT NULL] AS prior
  FROM x_volumes WINDOW w AS (PARTITION BY series ORDER BY hour)""",
)
cte(
    "x_flags",
    """SELECT series, hour, demand, len(prior)::INTEGER AS reference_matches, m AS historical_median,
    CASE WHEN m > 0 THEN demand / m END AS coverage_ratio,
    coalesce(len(prior) >= 3 AND m >= 2 AND demand / nullif(m, 0) < 0.5, false) AS flag
  FROM (SELECT *, list_median(prior) AS m FROM x_prior)""",
)
cte(
    "x_alt",
    """SELECT p.zone_id, p.hour, (p.demand - coalesce(d.duplicate_excess, 0))::INTEGER AS demand, p.borough, p."Zone",
    coalesce(d.duplicate_excess, 0)::INTEGER AS duplicate_excess
  FROM x_doubled_panel p LEFT JOIN x_rollup d ON d.zone_id = p.zone_id AND d.hour = p.hour""",
)

check(
    "read_trips",
    f"""SELECT * REPLACE ("PULocationID"::BIGINT AS "PULocationID", {r('passenger_count')} AS passenger_count, {r('trip_distance')} AS trip_distance,
  {r('fare_amount')} AS fare_amount), CASE WHEN file_month = '2024-03' THEN {r('"DOLocationID" / 4.0')} END AS airport_fee FROM x_trips""",
)
check(
    "check_trip_schema",
    """SELECT 'trips_' || m AS file, c AS "check", CASE WHEN m = '2024-04' THEN bad ELSE 0 END::BIGINT AS bad_columns
  FROM (SELECT DISTINCT file_month AS m FROM x_trips UNION ALL SELECT '2024-04'),
    (VALUES ('missing_column', 2), ('zoned_time', 1), ('fractional_id', 1), ('map_column', 1)) AS t(c, bad)""",
)
check(
    "write_panel",
    """SELECT * FROM x_panel WHERE hour >= TIMESTAMP '2024-02-25 05:00:00' AND hour < TIMESTAMP '2024-03-15 04:00:00'""",
)
check(
    "trips_of_months",
    f"""SELECT * REPLACE ({r('passenger_count')} AS passenger_count, {r('trip_distance')} AS trip_distance,
  {r('fare_amount')} AS fare_amount) FROM x_trips WHERE file_month = '2024-03'""",
)
check(
    "load_zones",
    """SELECT "LocationID" AS zone_id, "Borough" AS borough, "Zone" FROM x_lookup
  WHERE "Borough" IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')""",
)
check(
    "read_window",
    """SELECT event_id, ts, user_id FROM events
  WHERE ts >= TIMESTAMP '2024-01-10 05:00:00' AND ts < TIMESTAMP '2024-01-20 05:00:00'""",
)
kept = """(SELECT * FROM x_lookup WHERE "Borough" IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE'))"""
check(
    "check_zones",
    checks(
        ("duplicate_id", 'SELECT count(*) - count(DISTINCT "LocationID") FROM x_lookup'),
        ("empty_lookup", f"SELECT (count(*) = 0)::INT FROM {kept}"),
        ("id_out_of_range", f'SELECT count(*) FROM {kept} WHERE "LocationID" NOT BETWEEN 1 AND 1000'),
    ),
)
check(
    "months",
    """SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(
    date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS m FROM orders)""",
)
spans = """(SELECT zone_id, date_diff('hour', min(hour), max(hour)) + 1 - count(DISTINCT hour) AS gap
  FROM x_counts GROUP BY 1)"""
check(
    "check_panel",
    checks(
        ("misaligned_hour", "SELECT count(*) FROM x_counts WHERE hour <> date_trunc('hour', hour)"),
        ("duplicate_key", "SELECT count(*) - count(DISTINCT (zone_id, hour)) FROM x_counts"),
        ("zone_out_of_range", "SELECT count(*) FROM x_counts WHERE zone_id NOT BETWEEN 2 AND 60"),
        ("missing_hour", f"SELECT sum(gap) FROM {spans}"),
        ("missing_demand", "SELECT count(*) FROM x_counts WHERE demand IS NULL"),
        ("invalid_demand", "SELECT count(*) FROM x_counts WHERE demand < 0"),
    ),
)
cover = """(SELECT z.zone_id AS listed, c.* FROM x_zones z FULL JOIN (SELECT zone_id, count(*) AS n, min(hour) AS low,
  max(hour) AS high FROM x_counts WHERE hour >= TIMESTAMP '2024-02-26 05:00:00'
  AND hour < TIMESTAMP '2024-03-01 05:00:00' GROUP BY 1) c ON c.zone_id = z.zone_id)"""
check(
    "check_complete_window",
    checks(
        ("missing_zone", f"SELECT count(*) FROM {cover} WHERE n IS NULL"),
        ("unknown_zone", f"SELECT count(*) FROM {cover} WHERE listed IS NULL"),
        ("wrong_hour_count", f"SELECT count(*) FROM {cover} WHERE n <> 96"),
        ("wrong_first_hour", f"SELECT count(*) FROM {cover} WHERE low <> TIMESTAMP '2024-02-26 05:00:00'"),
        ("wrong_last_hour", f"SELECT count(*) FROM {cover} WHERE high <> TIMESTAMP '2024-03-01 04:00:00'"),
        ("duplicate_key", "SELECT 0"),
        ("misaligned_hour", "SELECT 0"),
    ),
)
check(
    "check_counts",
    checks(
        ("missing_hour", "SELECT count(*) FROM x_all_counts WHERE hour IS NULL"),
        ("not_finite", "SELECT count(*) FROM x_all_counts WHERE demand IS NULL"),
        ("negative", "SELECT count(*) FROM x_all_counts WHERE demand < 0"),
        ("not_integral", "SELECT 0"),
        ("above_int32", "SELECT count(*) FROM x_all_counts WHERE demand > 2147483647"),
        ("outside_zones", "SELECT count(*) FROM x_all_counts WHERE zone_id NOT IN (SELECT zone_id FROM x_zones)"),
        (
            "outside_hours",
            "SELECT count(*) FROM x_all_counts WHERE hour < TIMESTAMP '2024-02-25' OR hour >= TIMESTAMP '2024-03-15'",
        ),
        ("duplicate_key", "SELECT count(*) - count(DISTINCT (zone_id, hour)) FROM x_all_counts"),
    ),
)
vgap = """(SELECT vendor, date_diff('hour', min(hour), max(hour)) + 1 - count(DISTINCT hour) AS gap
  FROM x_vendor_hours GROUP BY 1)"""
check(
    "check_volume_series",
    checks(
        ("missing_series", "SELECT count(*) FROM x_vendor_hours WHERE vendor IS NULL"),
        ("duplicate_key", "SELECT count(*) - count(DISTINCT (vendor, hour)) FROM x_vendor_hours"),
        ("misaligned_hour", "SELECT count(*) FROM x_vendor_hours WHERE hour <> date_trunc('hour', hour)"),
        ("missing_hour", f"SELECT sum(gap) FROM {vgap}"),
        ("invalid_demand", "SELECT count(*) FROM x_vendor_hours WHERE demand < 0"),
        ("empty_input", "SELECT (count(*) = 0)::INT FROM x_vendor_hours"),
    ),
)
check(
    "reconcile_tables",
    """SELECT 'left_only' AS side, count(*) AS rows FROM (SELECT zone_id, hour, demand FROM x_doubled_panel EXCEPT ALL
    SELECT zone_id, hour, demand FROM x_alt)
  UNION ALL SELECT 'right_only', count(*) FROM (SELECT zone_id, hour, demand FROM x_alt EXCEPT ALL
    SELECT zone_id, hour, demand FROM x_doubled_panel)""",
)
check(
    "table_fingerprint",
    """SELECT count(*) AS rows, sum(h)::VARCHAR AS hash_sum, bit_xor(h) AS hash_xor FROM (
    SELECT ('0x' || substr(md5(concat_ws('|', zone_id, hour, demand)), 1, 15))::BIGINT AS h FROM x_panel)""",
)
grid = "(SELECT zone_id, hour FROM x_zones CROSS JOIN x_spine WHERE hour < TIMESTAMP '2024-03-18 04:00:00')"
check(
    "check_keys",
    checks(
        ("missing_key", f"SELECT count(*) FROM {grid} g WHERE NOT EXISTS (SELECT 1 FROM x_counts c WHERE c.zone_id = g.zone_id AND c.hour = g.hour)"),
        ("unexpected_key", "SELECT count(*) FROM x_counts WHERE hour >= TIMESTAMP '2024-03-18 04:00:00'"),
        ("duplicate_key", "SELECT count(*) - count(DISTINCT (zone_id, hour)) FROM x_counts"),
    ),
)
check(
    "check_conservation",
    checks(
        ("total_difference", "SELECT abs((SELECT sum(demand) FROM x_local_counts) - (SELECT sum(demand) FROM x_panel))")
    ),
)
cte(
    "x_quality",
    """SELECT file_month AS month, count(*) AS raw_rows,
    count(*) FILTER (tpep_pickup_datetime IS NULL) AS null_pickups,
    count(*) FILTER (strftime(tpep_pickup_datetime, '%Y-%m') <> file_month) AS outside_file_month,
    count(*) FILTER ("PULocationID" IS NULL OR "PULocationID" NOT IN (SELECT zone_id FROM x_zones)) AS non_nyc_or_invalid_zone,
    count(*) FILTER (passenger_count IS NULL) AS missing_passenger_count,
    count(*) FILTER (trip_distance <= 0) AS nonpositive_distance,
    count(*) FILTER (fare_amount < 0) AS negative_fare,
    count(*) FILTER (tpep_dropoff_datetime <= tpep_pickup_datetime) AS nonpositive_duration
  FROM x_trips GROUP BY 1""",
)
check("monthly_quality", "SELECT * FROM x_quality")
check(
    "write_report_tables",
    """SELECT 'quality' AS report, month || ' ' || c AS key, v::BIGINT AS value FROM (UNPIVOT x_quality ON COLUMNS(* EXCLUDE (month)) INTO NAME c VALUE v)
  UNION ALL SELECT 'zones', "Zone", zone_id::BIGINT FROM x_zones""",
)
check(
    "eligible_trips",
    f"""SELECT * REPLACE ({r('passenger_count')} AS passenger_count, {r('trip_distance')} AS trip_distance,
  {r('fare_amount')} AS fare_amount) FROM x_eligible""",
)
check("hourly_counts", "SELECT * FROM x_local_counts")
cte(
    "x_local_hours",
    """SELECT d + to_hours(h) AS hour FROM (SELECT DISTINCT o_orderdate AS d FROM orders)
  CROSS JOIN (SELECT unnest(range(24)) AS h)""",
)
check("local_to_utc", f"SELECT hour, {strict('hour')} AS utc FROM x_local_hours")
check(
    "dst_dropped",
    f"""SELECT m.file_month AS month, coalesce(lost, 0)::BIGINT AS unresolvable_dst_pickups,
    coalesce(kept, 0)::BIGINT AS accepted_pickups, (m.n - coalesce(kept, 0))::BIGINT AS excluded_pickups
  FROM (SELECT file_month, count(*) AS n FROM x_trips GROUP BY 1) m LEFT JOIN (
    SELECT strftime(hour, '%Y-%m') AS month, sum(demand) FILTER ({strict('hour')} IS NULL) AS lost,
      sum(demand) FILTER ({strict('hour')} IS NOT NULL) AS kept FROM x_local_counts GROUP BY 1) c
  ON c.month = m.file_month""",
)
check(
    "hour_spine",
    f"""SELECT unnest(generate_series({utc('min(o_orderdate)::TIMESTAMP')}, {utc('max(o_orderdate)::TIMESTAMP')} - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour
  FROM orders""",
)
check(
    "month_spines",
    f"""SELECT strftime(f, '%Y-%m-%d') AS month_start, count(*) AS utc_hours, count(DISTINCT {local('h')}) AS local_hours
  FROM (SELECT f, unnest(generate_series((f AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC',
      ((f + INTERVAL 1 MONTH) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h
    FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS f FROM orders)) GROUP BY f""",
)
check("densify", "SELECT zone_id, hour, demand FROM x_panel")
check("attach_zone", 'SELECT c.zone_id, hour, demand, borough, "Zone" FROM x_counts c LEFT JOIN x_zones z ON z.zone_id = c.zone_id')
check(
    "panel_summary",
    f"""SELECT count(*) AS panel_rows, count(DISTINCT zone_id) AS nyc_zones, count(DISTINCT hour) AS utc_hours,
    sum(demand)::BIGINT AS total_pickups, {r('avg((demand = 0)::INT)')} AS zero_demand_fraction FROM x_panel""",
)
check(
    "write_run_record",
    f"""SELECT count(*) AS panel_rows, count(DISTINCT zone_id) AS nyc_zones, count(DISTINCT hour) AS utc_hours,
    sum(demand)::BIGINT AS total_pickups, {r('avg((demand = 0)::INT)')} AS zero_demand_fraction FROM x_panel""",
)
check("prepare_panel", "SELECT * FROM x_panel")
check("development_range", "SELECT file_month AS month, count(*) AS trips FROM x_trips WHERE file_month = '2024-02' GROUP BY 1")
check(
    "exact_duplicates",
    f"""SELECT * REPLACE ({r('passenger_count')} AS passenger_count, {r('trip_distance')} AS trip_distance,
  {r('fare_amount')} AS fare_amount) FROM x_repeated""",
)
check("duplicate_rollup", "SELECT * FROM x_rollup")
check("vendor_counts", "SELECT * FROM x_vendor_hours")
check("city_totals", "SELECT * FROM x_city")
check("series_grid", "SELECT * FROM x_volumes")
rounded_flags = f"* REPLACE ({r('historical_median')} AS historical_median, {r('coverage_ratio')} AS coverage_ratio)"
check("reporting_volume_flags", f"SELECT {rounded_flags} FROM x_flags")
check("flagged_hours", f"SELECT {rounded_flags}, {local('hour')} AS hour_nyc FROM x_flags WHERE flag")
check("dedup_panel", "SELECT * FROM x_alt")
check(
    "duplicates_by_month",
    f"""SELECT e.month, e.n::BIGINT AS eligible_pickups, coalesce(x, 0)::BIGINT AS exact_duplicate_excess,
    coalesce(g, 0)::BIGINT AS exact_duplicate_groups, coalesce(rr, 0)::BIGINT AS repeated_rows,
    coalesce(m, 1)::BIGINT AS max_copies, coalesce(cells, 0)::BIGINT AS affected_zone_hours
  FROM (SELECT strftime({local('hour')}, '%Y-%m') AS month, sum(demand) AS n FROM x_doubled_counts GROUP BY 1) e
  LEFT JOIN (SELECT strftime({local('hour')}, '%Y-%m') AS month, sum(duplicate_excess) AS x, sum(duplicate_groups) AS g,
    sum(repeated_rows) AS rr, max(max_copies) AS m, count(*) AS cells FROM x_rollup GROUP BY 1) d ON d.month = e.month""",
)
check(
    "duplicates_by_zone",
    """SELECT zone_id, "Zone", borough, sum(duplicate_excess)::BIGINT AS exact_duplicate_excess,
    count(*) FILTER (duplicate_excess > 0) AS affected_zone_hours FROM x_alt GROUP BY ALL""",
)
check(
    "series_summary",
    """SELECT series, sum(demand)::BIGINT AS pickups, count(*) FILTER (demand = 0) AS zero_hours,
    count(*) FILTER (flag) AS flags FROM x_flags GROUP BY 1""",
)
check(
    "duplicate_share",
    f"""SELECT sum(duplicate_excess)::BIGINT AS exact_duplicate_excess,
    {r('100.0 * sum(duplicate_excess) / sum(demand + duplicate_excess)')} AS exact_duplicate_excess_pct,
    max(duplicate_excess)::BIGINT AS max_zone_hour_reduction,
    count(*) FILTER (duplicate_excess > 0) AS affected_zone_hours FROM x_alt""",
)
