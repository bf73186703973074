"""Check queries of reports, analyst questions and exports."""

from zonecast.oracles.parts import check, checks, cte, local, r
from zonecast.oracles.study import METRICS

MODELS = ("previous_hour", "zone_hour_average", "previous_week_168h")
DAY = f"strftime({local('hour')}, '%Y-%m-%d')"

check("daily_totals", f"SELECT {DAY} AS date_nyc, sum(demand)::BIGINT AS demand FROM x_dev GROUP BY 1")
check(
    "hourly_profile",
    f"""SELECT (isodow({local('hour')}) > 5)::INTEGER AS weekend, hour({local('hour')})::INTEGER AS local_hour, {r('avg(demand)')} AS mean_demand
  FROM x_dev GROUP BY 1, 2""",
)
cte("x_totals", 'SELECT zone_id, "Zone", borough, sum(demand)::BIGINT AS pickups FROM x_dev GROUP BY ALL')
check("zone_totals", "SELECT * FROM x_totals")
check("top_zones", "SELECT * FROM x_totals ORDER BY pickups DESC, zone_id LIMIT 15")
check(
    "error_columns",
    f"""SELECT zone_id, hour, fold, {r('abs(zone_hour_average - demand)')} AS absolute_error, {r('zone_hour_average - demand')} AS residual
  FROM x_pred""",
)
cte(
    "x_edges",
    """SELECT list_sort(list_distinct(quantile_cont(demand::DOUBLE, [0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]))) AS e
  FROM x_dev WHERE hour < TIMESTAMP '2024-03-14 04:00:00'""",
)
cte(
    "x_banded",
    """SELECT p.*, f.weekday, '(' || CASE WHEN i = 0 THEN '-inf' ELSE inner_edges[i]::VARCHAR END || ', ' ||
    CASE WHEN i = len(inner_edges) THEN 'inf' ELSE inner_edges[i + 1]::VARCHAR END || ']' AS demand_band
  FROM (SELECT p.*, e[2:len(e) - 1] AS inner_edges, len(list_filter(e[2:len(e) - 1], lambda x: x < p.demand)) AS i FROM x_pred p CROSS JOIN x_edges) p
  JOIN x_feat f ON f.zone_id = p.zone_id AND f.hour = p.hour""",
)
check("demand_bands", "SELECT zone_id, hour, demand, demand_band FROM x_banded")
check(
    "error_slices",
    "\nUNION ALL\n".join(
        f"SELECT '{d}' AS dimension, {d}::VARCHAR AS value, count(*) AS rows, {METRICS} FROM (SELECT *, zone_hour_average AS p FROM x_banded) GROUP BY {d}"
        for d in ("zone_id", "borough", "local_hour", "weekday", "rush_hour", "demand_band")
    ),
)
check(
    "zone_map_table",
    f"""SELECT a.zone_id, {r('m')} AS mean_pickups, {r('e')} AS mae FROM (SELECT zone_id, avg(demand) AS m FROM x_dev GROUP BY 1) a
  FULL JOIN (SELECT zone_id, avg(abs(zone_hour_average - demand)) AS e FROM x_pred GROUP BY 1) b ON b.zone_id = a.zone_id""",
)
cte(
    "x_window",
    """SELECT p.*, z."Zone" FROM x_pred p JOIN x_zones z ON z.zone_id = p.zone_id WHERE fold = 'fold_3'
    AND hour >= TIMESTAMP '2024-03-16 04:00:00' AND hour < TIMESTAMP '2024-03-18 04:00:00'""",
)
names = ", ".join(f"{r(m)} AS {m}" for m in MODELS)
check("demo_window", f"SELECT zone_id, hour, demand, {names} FROM x_window")
check(
    "borough_summary",
    f"""SELECT borough, count(*) AS zone_hours, sum(demand)::BIGINT AS recorded_pickups, {r('avg(abs(demand - previous_hour))')} AS temporal_mae,
    {r('avg(abs(demand - zone_hour_average))')} AS borough_context_mae, {r('avg(abs(demand - previous_week_168h))')} AS weekly_mae
  FROM x_window GROUP BY 1""",
)
check(
    "zone_search",
    """SELECT "LocationID" AS zone_id, "Zone", "Borough" AS borough FROM x_lookup WHERE "Borough" = 'ASIA'
    AND lower("Zone") LIKE '%customer#0000000%'""",
)
check("zone_search_by_id", """SELECT "LocationID" AS zone_id, "Zone", "Borough" AS borough FROM x_lookup WHERE "LocationID" = 42""")
cte(
    "x_rows",
    "\nUNION ALL\n".join(
        f"""SELECT zone_id, "Zone", borough, hour, '{m}' AS model, demand::DOUBLE AS actual, {m} AS forecast, {m} - demand AS error FROM x_window"""
        for m in MODELS
    ),
)
BASIC = f"{r('sum(actual)')} AS actual, {r('sum(forecast)')} AS forecast, {r('avg(abs(error))')} AS mae"
check("hour_summary", f"SELECT hour, model, {BASIC} FROM x_rows GROUP BY 1, 2")
check(
    "one_hour_summary",
    f"""SELECT {BASIC} FROM x_rows WHERE hour = TIMESTAMP '2024-03-17 13:00:00' AND borough = 'ASIA' AND model = 'zone_hour_average'""",
)
check(
    "borough_comparison",
    f"SELECT hour, model, borough, count(*) AS zones, {BASIC}, {r('sum(abs(error))')} AS absolute_error FROM x_rows GROUP BY 1, 2, 3",
)
check(
    "forecast_misses",
    f"""SELECT hour, model, zone_id, {r('actual')} AS actual, {r('forecast')} AS forecast, {r('error')} AS error, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY hour, model ORDER BY abs(error) DESC, zone_id)::INTEGER AS rank FROM x_rows) WHERE rank <= 5""",
)
check(
    "zone_model_errors",
    f"SELECT zone_id, model, {r('avg(abs(error))')} AS mae, {r('avg(error)')} AS mean_error FROM x_rows GROUP BY 1, 2",
)
check("zone_daily_summaries", f"SELECT zone_id, model, {DAY} AS day, count(*) AS hours, {BASIC} FROM x_rows GROUP BY 1, 2, 3")
check(
    "zone_largest_miss",
    f"""SELECT zone_id, model, hour, {r('error')} AS error FROM (
    SELECT *, row_number() OVER (PARTITION BY zone_id, model ORDER BY abs(error) DESC, hour) AS n FROM x_rows) WHERE n = 1""",
)
STAMP = "strftime(hour, '%Y-%m-%dT%H:%M:%S') || '.000Z'"
check(
    "export_rows",
    f"""SELECT 'study-1' AS study_id, 'two days, local time' AS scope, {STAMP} AS time_utc, zone_id, "Zone" AS zone_name, borough, model,
    actual::BIGINT AS recorded_pickups, {r('forecast')} AS estimate, {r('error')} AS error_estimate_minus_recorded,
    {r('abs(error)')} AS absolute_error FROM x_rows""",
)
cte(
    "x_levels",
    """SELECT hour, zone_id, model, 'demand' AS measure, actual AS level FROM x_rows
  UNION ALL SELECT hour, zone_id, model, 'absolute_error', abs(error) FROM x_rows""",
)
check(
    "map_intensity",
    f"""SELECT hour, zone_id, model, measure, {r('CASE WHEN m > 0 THEN sqrt(least(1, greatest(0, level / m))) ELSE 0 END')} AS intensity
  FROM (SELECT *, max(level) OVER (PARTITION BY hour, model, measure) AS m FROM x_levels)""",
)
check(
    "zone_trace",
    f"""SELECT zone_id, hour, model, {r('actual')} AS actual, {r('forecast')} AS forecast,
    {r('greatest(1, max(greatest(actual, forecast)) OVER (PARTITION BY zone_id, model))')} AS peak FROM x_rows""",
)
millionths = " || ',' || ".join(f"round(round({c}::DOUBLE, 6) * 1000000)::BIGINT::VARCHAR" for c in ("demand", *MODELS))
check("export_nested", f"SELECT hour, string_agg({millionths}, ';' ORDER BY zone_id) AS cells FROM x_window GROUP BY 1")
check(
    "check_export",
    checks(
        ("duplicate_zone", "SELECT 0"),
        ("zone_count_mismatch", "SELECT 0"),
        ("column_count_mismatch", "SELECT 0"),
        ("invalid_cell", "SELECT count(DISTINCT hour) FROM x_window WHERE previous_hour < 0"),
        ("missing_hour", "SELECT 0"),
        ("repeated_hour", "SELECT 0"),
        ("wrong_hour_count", "SELECT 49 - count(DISTINCT hour) FROM x_window"),
    ),
)
check(
    "export_csv_quoted",
    f"""SELECT 'study-1,"a ""quoted"", scope",' || {STAMP} || ',' || zone_id || ',"' || "Zone" || ',' || borough || '",' || borough || ',' || model || ',' ||
    actual::BIGINT AS line FROM x_rows""",
)
