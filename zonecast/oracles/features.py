"""Check queries of temporal and borough features."""

from zonecast.oracles.parts import check, checks, cte, local, r

W = "OVER (PARTITION BY zone_id ORDER BY hour)"


def frame(width, skip):
    return f"OVER (PARTITION BY zone_id ORDER BY hour ROWS BETWEEN {skip + width - 1} PRECEDING AND {skip} PRECEDING)"


def lag_columns(delay=0):
    return ", ".join(
        f"lag(demand, {k + (delay if k <= 3 else 0)}) {W} AS lag_{k}" for k in (1, 2, 3, 24, 168)
    )


def gated(function, width, skip):
    f = frame(width, skip)
    return f"CASE WHEN count(*) {f} = {width} THEN {function}(demand) {f} END"


def mean_columns(delay=0):
    return ", ".join(
        f"{r(gated('avg', w, 1 + delay))} AS rolling_mean_{w}" for w in (3, 24, 168)
    )


def std_column(delay=0):
    return f"{r(gated('stddev_pop', 24, 1 + delay))} AS rolling_std_24"


def trend_column(delay=0):
    return f"lag(demand, {1 + delay}) {W} - lag(demand, {2 + delay}) {W} AS trend_1"


def history(delay=0):
    return f"{lag_columns(delay)}, {mean_columns(delay)}, {std_column(delay)}, {trend_column(delay)}"


L = local("hour")
DOW = f"(isodow({L}) - 1)"
CALENDAR = f"""hour({L})::INTEGER AS local_hour, {DOW}::INTEGER AS weekday, ({DOW} >= 5)::INTEGER AS weekend,
    month({L})::INTEGER AS month, ({DOW} < 5 AND hour({L}) IN (7, 8, 9, 16, 17, 18))::INTEGER AS rush_hour"""

cte("x_bare", "SELECT zone_id, hour, demand FROM x_panel")
check("lags", f"SELECT *, {lag_columns()} FROM x_bare")
check("rolling_means", f"SELECT *, {mean_columns()} FROM x_bare")
check("rolling_std", f"SELECT *, {std_column()} FROM x_bare")
check("trend", f"SELECT *, {trend_column()} FROM x_bare")
check("local_calendar", f"SELECT *, {CALENDAR} FROM x_bare")
check(
    "cyclic",
    f"""SELECT *, {r(f'sin(2 * pi() * hour({L}) / 24)')} AS hour_sin, {r(f'cos(2 * pi() * hour({L}) / 24)')} AS hour_cos,
    {r(f'sin(2 * pi() * {DOW} / 7)')} AS weekday_sin, {r(f'cos(2 * pi() * {DOW} / 7)')} AS weekday_cos FROM x_bare""",
)
check(
    "delayed_features",
    "\nUNION ALL\n".join(f"SELECT *, {d} AS delay_hours, {history(d)} FROM x_bare" for d in (0, 1, 3, 6)),
)
check(
    "future_target_rows",
    f"""SELECT * EXCLUDE (demand) FROM (SELECT *, {history()} FROM (SELECT * FROM x_bare
    UNION ALL SELECT zone_id, max(hour) + INTERVAL 1 HOUR, NULL FROM x_bare GROUP BY 1)) WHERE demand IS NULL""",
)
check("drop_warmup", f"SELECT zone_id, hour, demand, lag_168 FROM (SELECT *, {history()} FROM x_bare) WHERE lag_168 IS NOT NULL AND rolling_mean_168 IS NOT NULL")
names = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
flags = ", ".join(f"""("Borough" = '{n}')::INTEGER AS borough_{n.lower().replace(' ', '_')}""" for n in names)
check("borough_onehot", f'SELECT "LocationID" AS zone_id, "Borough" AS borough, "Zone", {flags} FROM x_lookup')
cte(
    "x_peers",
    """SELECT p.zone_id, p.hour, p.demand, p.borough,
    sum(p.demand) OVER b AS total, count(*) OVER b AS n FROM x_panel p WINDOW b AS (PARTITION BY borough, hour)""",
)
other = "CASE WHEN n > 1 THEN (total - demand) / (n - 1) ELSE 0.0::DOUBLE END"
check("peer_mean", f"SELECT zone_id, hour, demand, borough, {r(other)} AS borough_other_mean FROM x_peers")
check(
    "lagged_peers",
    f"""SELECT zone_id, hour, demand, borough, {r(f'lag(m, 4) {W}')} AS borough_other_mean_lag_1,
    {r(f'lag(m, 24) {W}')} AS borough_other_mean_lag_24 FROM (SELECT *, {other} AS m FROM x_peers)""",
)
check(
    "peer_count",
    """SELECT "LocationID" AS zone_id, "Borough" AS borough, "Zone",
    (count(*) OVER (PARTITION BY "Borough") - 1)::INTEGER AS borough_other_count FROM x_lookup""",
)
check(
    "check_lookup_available",
    checks(
        ("before_lookup", "SELECT count(*) FROM x_panel WHERE hour < TIMESTAMP '2024-02-21 05:00:00'"),
        ("borough_mismatch", """SELECT count(*) FROM x_panel p LEFT JOIN x_lookup l ON l."LocationID" = p.zone_id
          WHERE l."Borough" IS DISTINCT FROM p.borough"""),
        ("empty_input", "SELECT (count(*) = 0)::INT FROM x_panel"),
    ),
)
cte("x_history", f"SELECT * EXCLUDE (rolling_mean_24, rolling_mean_168, rolling_std_24), {gated('avg', 24, 1)} AS rolling_mean_24, {gated('avg', 168, 1)} AS rolling_mean_168, {gated('stddev_pop', 24, 1)} AS rolling_std_24 FROM (SELECT *, {history()} FROM x_bare)")
check(
    "describe_features",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS feature, count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std,
    {r(f'min({c})')} AS min, {r(f'quantile_cont({c}::DOUBLE, 0.25)')} AS p25, {r(f'quantile_cont({c}::DOUBLE, 0.5)')} AS p50,
    {r(f'quantile_cont({c}::DOUBLE, 0.75)')} AS p75, {r(f'max({c})')} AS max FROM x_history"""
        for c in ("lag_1", "rolling_mean_24", "rolling_mean_168", "rolling_std_24", "trend_1")
    ),
)
check("zones_per_borough", 'SELECT "Borough" AS borough, count(*) AS zones FROM x_lookup GROUP BY 1')
