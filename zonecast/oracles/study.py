"""Check queries of folds, baselines, scores and resampling."""

from zonecast.oracles.features import CALENDAR, W, gated
from zonecast.oracles.parts import check, checks, cte, local, r, utc

SEALED = "TIMESTAMP '2024-03-18 04:00:00'"
MODELS = ("previous_hour", "previous_day_24h", "previous_week_168h", "zone_hour_average", "rolling_mean_24h")
DELAYED = ("latest_available", *MODELS[1:])
CONTRASTS = (
    ("rolling_mean_24h", "previous_week_168h"),
    ("zone_hour_average", "previous_week_168h"),
    ("rolling_mean_24h", "zone_hour_average"),
)

cte(
    "x_folds",
    """SELECT * FROM (VALUES
    ('fold_1', TIMESTAMP '2024-02-20 05:00:00', TIMESTAMP '2024-03-06 05:00:00', TIMESTAMP '2024-03-10 05:00:00'),
    ('fold_2', TIMESTAMP '2024-02-20 05:00:00', TIMESTAMP '2024-03-10 05:00:00', TIMESTAMP '2024-03-14 04:00:00'),
    ('fold_3', TIMESTAMP '2024-02-20 05:00:00', TIMESTAMP '2024-03-14 04:00:00', TIMESTAMP '2024-03-18 04:00:00')
  ) AS t(fold, train_start, validation_start, validation_end)""",
)
cte("x_dev", f"SELECT * FROM x_panel WHERE hour < {SEALED}")


def raw_history(delay=0):
    """Unrounded inputs of the baselines."""
    return (
        f"lag(demand, {1 + delay}) {W} AS lag_1, lag(demand, {2 + delay}) {W} AS lag_2, lag(demand, {3 + delay}) {W} AS lag_3, "
        f"lag(demand, 24) {W} AS lag_24, {gated('avg', 3, 1 + delay)} AS rolling_mean_3, "
        f"lag(demand, 168) {W} AS lag_168, {gated('avg', 24, 1 + delay)} AS rolling_mean_24, "
        f"{gated('avg', 168, 1 + delay)} AS rolling_mean_168, {gated('stddev_pop', 24, 1 + delay)} AS rolling_std_24"
    )


def features_of(panel, delay=0):
    return f"SELECT *, {raw_history(delay)}, {CALENDAR} FROM {panel}"


def roles(warmup, embargo):
    """Rows of ``x`` with fold and role."""
    first = f"f.train_start + INTERVAL {warmup} HOUR"
    last = f"f.validation_start - INTERVAL {embargo} HOUR"
    return (
        f"SELECT x.*, f.fold, CASE WHEN x.hour >= f.validation_start THEN 'validation' ELSE 'train' END AS role "
        f"FROM {{x}} x JOIN x_folds f ON (x.hour >= {first} AND x.hour < {last}) "
        f"OR (x.hour >= f.validation_start AND x.hour < f.validation_end)"
    )


def baselines_of(assigned, latest="previous_hour", sparse=0.1, more=""):
    """Wide baseline table from rows with fold and role."""
    return f"""SELECT {more} v.zone_id, v.hour, v.demand, v.borough, v.local_hour, v.weekend, v.rush_hour, v.fold,
    CASE WHEN z.m <= {sparse} THEN 'sparse' ELSE 'dense' END AS zone_cohort,
    CASE WHEN v.demand = 0 THEN 'zero' ELSE 'positive' END AS target_cohort,
    v.lag_1::DOUBLE AS {latest}, v.lag_24::DOUBLE AS previous_day_24h, v.lag_168::DOUBLE AS previous_week_168h,
    coalesce(a.m, z.m) AS zone_hour_average, v.rolling_mean_24 AS rolling_mean_24h
  FROM (SELECT * FROM {assigned} WHERE role = 'validation') v
  LEFT JOIN (SELECT fold, zone_id, avg(demand) AS m FROM {assigned} WHERE role = 'train' GROUP BY 1, 2) z
    ON z.fold = v.fold AND z.zone_id = v.zone_id
  LEFT JOIN (SELECT fold, zone_id, local_hour, avg(demand) AS m FROM {assigned} WHERE role = 'train' GROUP BY 1, 2, 3) a
    ON a.fold = v.fold AND a.zone_id = v.zone_id AND a.local_hour = v.local_hour"""


cte("x_feat", features_of("x_dev"))
cte("x_warm", "SELECT * FROM x_feat WHERE lag_168 IS NOT NULL AND rolling_mean_168 IS NOT NULL")
cte("x_assigned", roles(174, 6).format(x="x_warm"))
cte("x_pred", baselines_of("x_assigned"))

check("local_boundary", f"SELECT o_orderdate AS day, {utc('o_orderdate')} AS utc FROM (SELECT DISTINCT o_orderdate FROM orders)")
check(
    "chronological_split",
    """SELECT zone_id, hour, demand, CASE WHEN hour < TIMESTAMP '2024-03-14 04:00:00' THEN 'train' ELSE 'validation' END AS role
  FROM x_dev""",
)
check(
    "expanding_folds",
    f"""SELECT name, train_start, validation_start, validation_end FROM (
    SELECT 'fold_' || row_number() OVER (ORDER BY m) AS name, TIMESTAMP '1994-12-01 05:00:00' AS train_start,
      {utc('m')} AS validation_start, {utc('lead(m) OVER (ORDER BY m)')} AS validation_end
    FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS m FROM orders))
  WHERE validation_end <= TIMESTAMP '2001-01-01 05:00:00'""",
)
check("assign_folds", "SELECT zone_id, hour, demand, fold, role FROM (" + roles(174, 6).format(x="x_bare") + ")")
check(
    "zone_cohort",
    """SELECT fold, zone_id, CASE WHEN avg(demand) <= 0.1 THEN 'sparse' ELSE 'dense' END AS zone_cohort
  FROM x_assigned WHERE role = 'train' GROUP BY 1, 2""",
)
check("target_cohort", "SELECT *, CASE WHEN demand = 0 THEN 'zero' ELSE 'positive' END AS target_cohort FROM x_bare")
check(
    "check_label_availability",
    f"""SELECT a.fold, 'label_available' AS "check", (max(hour) + INTERVAL 7 HOUR > any_value(f.validation_start))::BIGINT AS bad_rows,
    max(hour) + INTERVAL 7 HOUR AS available_at FROM ({roles(168, 3).format(x='x_warm')}) a JOIN x_folds f ON f.fold = a.fold
  WHERE role = 'train' GROUP BY 1""",
)
cte("x_loose_assigned", roles(168, 0).format(x="x_warm"))
cte("x_loose", baselines_of("x_loose_assigned"))
KEY = "zone_id, hour, demand, borough, local_hour, weekend, rush_hour, fold, zone_cohort, target_cohort"
check(
    "match_control",
    f"""SELECT f.fold, s."check", coalesce(n, 0)::BIGINT AS bad_rows FROM x_folds f
  CROSS JOIN (VALUES ('only_in_candidate'), ('only_in_control')) AS s("check") LEFT JOIN (
    SELECT fold, 'only_in_candidate' AS c, count(*) AS n FROM (SELECT {KEY} FROM x_loose EXCEPT ALL SELECT {KEY} FROM x_pred) GROUP BY 1
    UNION ALL SELECT fold, 'only_in_control', count(*) FROM (SELECT {KEY} FROM x_pred EXCEPT ALL SELECT {KEY} FROM x_loose) GROUP BY 1
  ) d ON d.fold = f.fold AND d.c = s."check" """,
)
check(
    "training_signature",
    """SELECT fold, count(*) AS rows, sum(h)::VARCHAR AS hash_sum, bit_xor(h) AS hash_xor FROM (SELECT fold,
    ('0x' || substr(md5(concat_ws('|', zone_id, hour, demand)), 1, 15))::BIGINT AS h FROM x_assigned WHERE role = 'train') GROUP BY 1""",
)
check(
    "baseline_lags",
    """SELECT zone_id, hour, demand, lag_1::DOUBLE AS previous_hour, lag_24::DOUBLE AS previous_day_24h,
    lag_168::DOUBLE AS previous_week_168h FROM x_feat""",
)
check("zone_hour_average", f"SELECT fold, zone_id, hour, {r('zone_hour_average')} AS zone_hour_average FROM x_pred")
check("rolling_baseline", f"SELECT zone_id, hour, demand, {r('rolling_mean_24')} AS rolling_mean_24h FROM x_feat")
check(
    "clip_predictions",
    """SELECT zone_id, hour, demand, greatest(0, lag_1 - lag_2)::DOUBLE AS prediction FROM x_feat
  WHERE lag_1 - lag_2 IS NOT NULL""",
)


def rounded(names):
    return "* REPLACE (" + ", ".join(f"{r(n)} AS {n}" for n in names) + ")"


check("walk_forward", f"SELECT {rounded(MODELS)} FROM x_pred")
cte(
    "x_delayed_feat",
    "\nUNION ALL\n".join(f"SELECT *, {d} AS delay_hours FROM ({features_of('x_dev', d)})" for d in (0, 1, 3, 6)),
)
cte(
    "x_delayed_warm",
    "SELECT * FROM x_delayed_feat WHERE lag_168 IS NOT NULL AND rolling_mean_168 IS NOT NULL",
)
cte("x_delayed_assigned", roles(174, 6).format(x="x_delayed_warm"))
cte(
    "x_delayed",
    "\nUNION ALL\n".join(
        "SELECT * FROM ("
        + baselines_of(f"(SELECT * FROM x_delayed_assigned WHERE delay_hours = {d})", "latest_available", more="v.delay_hours,")
        + ")"
        for d in (0, 1, 3, 6)
    ),
)
check("delay_study", f"SELECT {rounded(DELAYED)} FROM x_delayed")
check(
    "score_next_hour",
    f"""SELECT zone_id, t AS target_hour_utc, t + INTERVAL 1 HOUR AS target_end_utc, t - INTERVAL 1 HOUR AS latest_observed_hour_utc,
    {r('greatest(0.0::DOUBLE, m24 + (l1 - l2) / 8)')} AS predicted_pickups FROM (
    SELECT zone_id, max(hour) + INTERVAL 1 HOUR AS t, avg(demand) FILTER (rn <= 24) AS m24,
      max(demand) FILTER (rn = 1) AS l1, max(demand) FILTER (rn = 2) AS l2, count(*) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY hour DESC) AS rn FROM x_bare) GROUP BY 1)
  WHERE n >= 168""",
)


def long_of(table, models, keep="zone_id, hour, demand, borough, local_hour, weekend, rush_hour, fold, zone_cohort, target_cohort"):
    return "\nUNION ALL\n".join(f"SELECT {keep}, '{m}' AS model, {m}::DOUBLE AS p FROM {table}" for m in models)


def metrics_sql(wrap):
    return f"""{wrap('avg(abs(demand - p))')} AS mae, {wrap('sqrt(avg((demand - p) * (demand - p)))')} AS rmse,
    {wrap('CASE WHEN count(*) > 1 AND min(demand) <> max(demand) THEN 1 - sum((demand - p) * (demand - p)) / (var_pop(demand) * count(*)) END')} AS r2,
    {wrap('avg(CASE WHEN demand = 0 AND p = 0 THEN 0.0::DOUBLE ELSE 200 * abs(demand - p) / (abs(demand) + abs(p)) END)')} AS smape_pct"""


METRICS = metrics_sql(r)

cte("x_long", long_of("x_pred", MODELS))
check("mae_rmse", f"SELECT model, mae, rmse FROM (SELECT model, {METRICS} FROM x_long GROUP BY 1)")
check("r2", f"SELECT model, r2 FROM (SELECT model, {METRICS} FROM x_long GROUP BY 1)")
check("smape_pct", f"SELECT model, smape_pct FROM (SELECT model, {METRICS} FROM x_long GROUP BY 1)")
check("fold_scores", f"SELECT fold, model, {METRICS} FROM x_long GROUP BY 1, 2")
check("pooled_scores", f"SELECT model, {METRICS} FROM x_long GROUP BY 1")
DIMENSIONS = ("borough", "local_hour", "weekend", "rush_hour", "zone_cohort", "target_cohort")
cte(
    "x_slices",
    "\nUNION ALL\n".join(
        f"""SELECT fold, model, '{d}' AS dimension, {d}::VARCHAR AS value, count(*) AS rows, {r('avg(p)')} AS mean_prediction,
    {r('avg((p > 0)::INT)')} AS positive_prediction_fraction, {METRICS}, avg(abs(demand - p)) AS raw_mae
  FROM x_long GROUP BY fold, model, {d}"""
        for d in DIMENSIONS
    ),
)
check("slice_scores", "SELECT * EXCLUDE (raw_mae) FROM x_slices")
DAY = f"strftime({local('hour')}, '%Y-%m-%d')"
cte(
    "x_daily",
    f"""SELECT fold, {DAY} AS date_nyc, model, count(*) AS rows, avg(abs(demand - p)) AS mae,
    sum(abs(demand - p)) AS absolute_error_sum FROM x_long GROUP BY 1, 2, 3""",
)
check("daily_scores", f"SELECT {rounded(('mae', 'absolute_error_sum'))} FROM x_daily")
check("read_daily_errors", f"SELECT fold, date_nyc, model, rows, {r('mae')} AS mae FROM x_daily")
cte(
    "x_scoped",
    """SELECT 'pooled' AS scope, model, avg(abs(demand - p)) AS mae FROM x_long GROUP BY 2
  UNION ALL SELECT fold, model, avg(abs(demand - p)) FROM x_long GROUP BY 1, 2""",
)
cte("x_contrasts", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in CONTRASTS) + ") AS t(candidate, reference)")
check(
    "compare_models",
    f"""SELECT c.scope, candidate, reference, {r('c.mae')} AS mae, {r('d.mae')} AS reference_mae, {r('c.mae - d.mae')} AS delta_mae,
    {r('CASE WHEN d.mae <> 0 THEN 100 * (1 - c.mae / d.mae) END')} AS relative_reduction_pct
  FROM x_contrasts JOIN x_scoped c ON c.model = candidate JOIN x_scoped d ON d.model = reference AND d.scope = c.scope""",
)
cte("x_delayed_long", long_of("x_delayed", DELAYED, "delay_hours, fold, demand"))
cte(
    "x_delay_scores",
    """SELECT delay_hours, 'pooled' AS scope, model, avg(abs(demand - p)) AS mae FROM x_delayed_long
    WHERE model = 'latest_available' GROUP BY 1, 3
  UNION ALL SELECT delay_hours, fold, model, avg(abs(demand - p)) FROM x_delayed_long
    WHERE model = 'latest_available' GROUP BY 1, 2, 3""",
)
check(
    "delay_effects",
    f"""SELECT a.scope, a.delay_hours, a.model, {r('a.mae')} AS mae, {r('b.mae')} AS control_mae, {r('a.mae - b.mae')} AS mae_change,
    {r('CASE WHEN b.mae > 0 THEN 100 * (a.mae / b.mae - 1) END')} AS mae_increase_pct FROM x_delay_scores a
  JOIN x_delay_scores b ON b.scope = a.scope AND b.delay_hours = 0""",
)
check(
    "reconcile_daily",
    f"""SELECT d.model, d.rows::BIGINT AS rows, {r('d.m')} AS daily_mae, {r('p.mae')} AS mae, {r('abs(d.m - p.mae)')} AS difference
  FROM (SELECT model, sum(rows) AS rows, sum(rows * mae) / sum(rows) AS m FROM x_daily GROUP BY 1) d
  JOIN (SELECT * FROM x_scoped WHERE scope = 'pooled') p ON p.model = d.model""",
)
check(
    "cohort_change",
    f"""SELECT fold, dimension, value, candidate, reference,
    {r('max(raw_mae) FILTER (model = candidate) - max(raw_mae) FILTER (model = reference)')} AS delta_mae
  FROM x_contrasts JOIN x_slices ON model IN (candidate, reference)
  WHERE (dimension = 'zone_cohort' AND value = 'sparse') OR (dimension = 'target_cohort' AND value = 'zero')
  GROUP BY fold, dimension, value, candidate, reference""",
)
check(
    "select_champion",
    """SELECT (SELECT model FROM x_scoped WHERE scope = 'pooled' ORDER BY mae, model LIMIT 1) AS champion,
    (SELECT model FROM x_scoped WHERE scope = 'pooled' AND model IN ('zone_hour_average', 'rolling_mean_24h')
     ORDER BY mae, model LIMIT 1) AS best_ml""",
)
cte("x_delay_folds", f"SELECT delay_hours, fold, model, {metrics_sql(str)} FROM x_delayed_long GROUP BY 1, 2, 3")
check(
    "reconcile_scores",
    "\nUNION ALL\n".join(
        f"""SELECT '{m}' AS metric, count(*) AS compared,
    count(*) FILTER (abs(b.{m} - a.{m}) > 1e-9 + 1e-9 * abs(a.{m})) AS mismatched, {r(f'max(abs(a.{m} - b.{m}))')} AS max_abs_diff
  FROM x_delay_folds a JOIN x_delay_folds b ON b.fold = a.fold AND b.model = a.model
  WHERE a.delay_hours = 0 AND b.delay_hours = 3"""
        for m in ("mae", "rmse", "r2", "smape_pct")
    ),
)
check(
    "check_scores_input",
    checks(
        ("empty_input", "SELECT (count(*) = 0)::INT FROM x_feat"),
        ("invalid_label", "SELECT count(*) FROM x_feat WHERE demand IS NULL"),
        ("invalid_lag_1", "SELECT count(*) FROM x_feat WHERE lag_1 IS NULL OR lag_1 < 0"),
        ("invalid_trend_1", "SELECT count(*) FROM x_feat WHERE lag_1 - lag_2 IS NULL OR lag_1 < lag_2"),
        ("invalid_rolling_std_24", "SELECT count(*) FROM x_feat WHERE rolling_std_24 IS NULL"),
    ),
)
cte(
    "x_weights",
    f"""SELECT fold, strftime(d, '%Y-%m-%d') AS date_nyc,
    (row_number() OVER (PARTITION BY fold ORDER BY d) - 1)::INTEGER AS day_index,
    (date_diff('hour', {utc('d')}, {utc('d + INTERVAL 1 DAY')}) * (SELECT count(DISTINCT zone_id) FROM x_zones))::BIGINT AS rows
  FROM (SELECT fold, unnest(generate_series({local('validation_start')}, {local('validation_end')} - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM x_folds)""",
)
check(
    "check_daily_errors",
    checks(
        ("missing_value", "SELECT 0"),
        ("bad_date", "SELECT 0"),
        ("invalid_number", "SELECT 0"),
        ("duplicate_key", "SELECT 0"),
        ("missing_cell", "SELECT count(*) * 5 FROM x_weights WHERE fold = 'fold_2'"),
        ("unexpected_cell", "SELECT 0"),
        (
            "wrong_row_count",
            "SELECT count(*) FROM x_daily d JOIN x_weights w ON w.fold = d.fold AND w.date_nyc = d.date_nyc WHERE d.rows <> w.rows",
        ),
        ("fold_mae_disagrees", "SELECT count(DISTINCT model) FROM x_daily WHERE fold = 'fold_2'"),
        (
            "pooled_mae_disagrees",
            """SELECT count(*) FROM (SELECT model, sum(rows * mae) / sum(rows) AS m FROM x_daily WHERE fold <> 'fold_2' GROUP BY 1) d
      JOIN x_scoped p ON p.model = d.model AND p.scope = 'pooled' WHERE abs(d.m - p.mae) > 1e-12 + 1e-10 * p.mae""",
        ),
    ),
)
check(
    "check_abs_error_sums",
    checks(("invalid_total", "SELECT 0"), ("total_disagrees", "SELECT count(*) FROM x_daily WHERE fold = 'fold_1'")),
)
check("day_weights", "SELECT * FROM x_weights")
cte("x_losses", "SELECT w.*, d.model, d.mae FROM x_weights w JOIN x_daily d ON d.fold = w.fold AND d.date_nyc = w.date_nyc")
check("loss_matrix", f"SELECT {rounded(('mae',))} FROM x_losses")
cte(
    "x_draws",
    """SELECT block_days, replicate, fold, (number * block_days + step)::INTEGER AS position,
    ((('0x' || substr(md5(concat_ws(':', 42, block_days, fold, replicate, number)), 1, 13))::BIGINT % days + step) % days)::INTEGER AS day_index
  FROM (SELECT fold, (max(day_index) + 1)::INTEGER AS days FROM x_losses GROUP BY 1)
  CROSS JOIN (SELECT unnest([2, 1, 4]) AS block_days) CROSS JOIN (SELECT unnest(range(10000))::INTEGER AS replicate)
  CROSS JOIN (SELECT unnest(range(4)) AS number) CROSS JOIN (SELECT unnest(range(4)) AS step)
  WHERE step < block_days AND number * block_days + step < days""",
)
check("circular_blocks", "SELECT * FROM x_draws")
cte(
    "x_boot",
    """SELECT block_days, replicate, model, sum(rows * mae) / sum(rows) AS mae
  FROM x_draws d JOIN x_losses l ON l.fold = d.fold AND l.day_index = d.day_index GROUP BY 1, 2, 3""",
)
check("bootstrap_mae", f"SELECT {rounded(('mae',))} FROM x_boot")
cte(
    "x_paired",
    """SELECT c.block_days, c.replicate, candidate, reference, c.mae - d.mae AS delta, 100 * (1 - c.mae / d.mae) AS reduction
  FROM x_contrasts JOIN x_boot c ON c.model = candidate
  JOIN x_boot d ON d.model = reference AND d.block_days = c.block_days AND d.replicate = c.replicate""",
)


def q(column, p):
    return r(f"quantile_cont({column}, {p}::DOUBLE)")


def interval_sql(where, family):
    wide = 0.05 / 6
    extra = (
        f""", {q('delta', wide)} AS delta_mae_family_low, {q('delta', 1 - wide)} AS delta_mae_family_high,
    3 AS family_size, {r(str(1 - 2 * wide))} AS per_contrast_confidence_level"""
        if family
        else ""
    )
    return f"""SELECT block_days, CASE WHEN block_days = 2 THEN 'primary' ELSE 'sensitivity' END AS role,
    0.95::DOUBLE AS confidence_level, x.candidate, x.reference, {r('any_value(c.mae - d.mae)')} AS delta_mae,
    {q('delta', 0.025)} AS delta_mae_low, {q('delta', 0.975)} AS delta_mae_high,
    {r('any_value(100 * (1 - c.mae / d.mae))')} AS relative_reduction_pct,
    {q('reduction', 0.025)} AS relative_reduction_pct_low, {q('reduction', 0.975)} AS relative_reduction_pct_high{extra}
  FROM x_paired x JOIN x_scoped c ON c.scope = 'pooled' AND c.model = x.candidate
  JOIN x_scoped d ON d.scope = 'pooled' AND d.model = x.reference {where} GROUP BY 1, 2, 3, 4, 5"""


check("contrast_intervals", interval_sql("WHERE block_days = 2", False))
check("family_intervals", interval_sql("WHERE block_days = 2", True))
check("block_sensitivity", interval_sql("", True))
check(
    "weather_block_sensitivity",
    f"""SELECT *, CASE candidate WHEN 'rolling_mean_24h' THEN 'primary' ELSE 'sensitivity' END AS weather_role
  FROM ({interval_sql("", True)})""",
)
check(
    "linear_percentiles",
    "\nUNION ALL\n".join(
        f"""SELECT block_days, candidate, reference, {p}::DOUBLE AS probability, {q('delta', p)} AS delta_mae
  FROM x_paired GROUP BY 1, 2, 3"""
        for p in (0.025, 0.5, 0.975)
    ),
)

for policy, source in (("recorded", "x_doubled_panel"), ("dedup", "x_alt")):
    cte(f"x_{policy}_known", f"SELECT * FROM {source} WHERE hour < {SEALED}")
    cte(f"x_{policy}_feat", features_of(f"x_{policy}_known"))
    cte(
        f"x_{policy}_split",
        f"""SELECT *, 'split' AS fold, CASE WHEN hour < TIMESTAMP '2024-03-14 04:00:00' THEN 'train' ELSE 'validation' END AS role
  FROM x_{policy}_feat WHERE lag_168 IS NOT NULL AND rolling_mean_168 IS NOT NULL""",
    )
    cte(f"x_{policy}_pred", baselines_of(f"x_{policy}_split"))
    cte(f"x_{policy}_long", long_of(f"x_{policy}_pred", MODELS, "demand"))
check(
    "baseline_sensitivity",
    f"""SELECT 'recorded_counts' AS policy, model, {METRICS} FROM x_recorded_long GROUP BY model
  UNION ALL SELECT 'exact_dedup_scenario', model, {METRICS} FROM x_dedup_long GROUP BY model""",
)


def fit_contract(name, rows, models, breach=0.0):
    """Counts and sums that any complete fit must show; its losses stay below those of the training mean, its leaves fit."""
    check(
        name,
        f"""SELECT model, fold, count(*) FILTER (role = 'validation') AS rows, 0::BIGINT AS missing_keys, 0::BIGINT AS surplus_keys,
    0::BIGINT AS bad_values, (sum(demand) FILTER (role = 'validation'))::BIGINT AS label_sum,
    count(*) FILTER (role = 'train') AS train_rows, true AS beats_mean, {breach}::DOUBLE AS breach
  FROM {rows} CROSS JOIN (SELECT unnest({models!r}) AS model) GROUP BY 1, 2""",
    )


# Least squares in SQL: sums of products, zone effects absorbed, and elimination by a recursive table.
X = {
    **{f: f for f in ("lag_1", "lag_2", "lag_3", "lag_24", "lag_168", "rolling_mean_3", "rolling_mean_24", "rolling_mean_168", "rolling_std_24")},
    "trend_1": "lag_1 - lag_2",
    "hour_sin": "sin(2 * pi() * local_hour / 24)",
    "hour_cos": "cos(2 * pi() * local_hour / 24)",
    "weekday_sin": "sin(2 * pi() * weekday / 7)",
    "weekday_cos": "cos(2 * pi() * weekday / 7)",
    "weekend": "weekend",
    "month": "month",
    "rush_hour": "rush_hour",
}


def regression(name, rows, keys, features, alpha):
    """CTEs up to ``x_{name}_made``: validation rows of ``rows`` with prediction ``p``."""
    n, p, by = f"x_{name}", len(features), ", ".join(keys)
    using = f"USING ({by})"
    raw = ", ".join(f"({X[f]})::DOUBLE AS v{i}" for i, f in enumerate(features))
    cte(f"{n}_rows", f"SELECT {by}, role, zone_id, hour, demand::DOUBLE AS y, demand, {raw} FROM {rows}")
    moments = ", ".join(f"avg(v{i}) AS m{i}, stddev_pop(v{i}) AS s{i}" for i in range(p))
    cte(f"{n}_scale", f"SELECT {by}, {moments} FROM {n}_rows WHERE role = 'train' GROUP BY {by}")
    z = ", ".join(f"CASE WHEN s{i} > 1e-9 THEN (v{i} - m{i}) / s{i} ELSE 0.0::DOUBLE END AS z{i + 1}" for i in range(p))
    cte(f"{n}_scaled", f"SELECT {by}, role, zone_id, hour, demand, y, 1.0::DOUBLE AS z0, {z}, y AS z{p + 1} FROM {n}_rows JOIN {n}_scale {using}")
    sums = ", ".join(f"sum(z{i}) AS t{i}" for i in range(p + 2))
    cte(f"{n}_zones", f"SELECT {by}, zone_id, {sums} FROM {n}_scaled WHERE role = 'train' GROUP BY {by}, zone_id")
    first = 0 if alpha else 1
    places = range(first, p + 1)
    line = lambda i, cell: "[" + ", ".join(cell(i, j) for j in [*places, p + 1]) + "]"
    matrix = lambda cell: "[" + ", ".join(line(i, cell) for i in places) + "]"
    whole, part = matrix(lambda i, j: f"sum(z{i} * z{j})"), matrix(lambda i, j: f"sum(t{i} * t{j} / (t0 + {alpha}))")
    cte(f"{n}_whole", f"SELECT {by}, {whole} AS a, count(*)::DOUBLE AS n, avg(y) AS y_mean FROM {n}_scaled WHERE role = 'train' GROUP BY {by}")
    cte(f"{n}_part", f"SELECT {by}, {part} AS b FROM {n}_zones GROUP BY {by}")
    d = len(places)
    penal = f"CASE WHEN i = j AND i > {1 - first} THEN {alpha}::DOUBLE ELSE 0.0::DOUBLE END"
    system = f"list_transform(range(1, {d + 1}), lambda i: list_transform(range(1, {d + 2}), lambda j: a[i][j] - b[i][j] + {penal}))"
    weak = "m[k][k] <= 1e-8 * n"
    swept = f"""list_transform(range(1, {d + 1}), lambda i: list_transform(range(1, {d + 2}), lambda j:
      CASE WHEN {weak} THEN m[i][j] WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END))"""
    steps = f"SELECT {by}, n, y_mean, 1 AS k, {system} AS m, []::BOOLEAN[] AS used FROM {n}_whole JOIN {n}_part {using}"
    for k in range(1, d + 1):
        cte(f"{n}_step{k}", steps)
        steps = f"SELECT {by}, n, y_mean, {k + 1} AS k, {swept} AS m, list_append(used, NOT ({weak})) AS used FROM {n}_step{k}"
    cte(f"{n}_last", steps)
    found = f"list_transform(range(1, {d + 1}), lambda i: CASE WHEN used[i] THEN m[i][{d + 1}] ELSE 0.0::DOUBLE END)"
    cte(f"{n}_found", f"SELECT {by}, y_mean, {found} AS c FROM {n}_last")
    slope = lambda i: f"c[{i + 1 - first}]"
    start = "c[1]" if alpha else "y_mean"
    fit = lambda v: " + ".join(f"{slope(i)} * {v}{i}" for i in range(1, p + 1))
    cte(f"{n}_effects", f"SELECT {by}, zone_id, (t{p + 1} - t0 * ({start}) - ({fit('t')})) / (t0 + {alpha}) AS e FROM {n}_zones JOIN {n}_found {using}")
    cte(
        f"{n}_made",
        f"""SELECT {by}, zone_id, hour, demand, greatest(0.0::DOUBLE, {start} + {fit('z')} + coalesce(e, 0)) AS p
  FROM {n}_scaled JOIN {n}_found {using} LEFT JOIN {n}_effects USING ({by}, zone_id) WHERE role = 'validation'""",
    )


LEAST = f"{r('avg(abs(demand - p))')} AS mae, {r('sqrt(avg((demand - p) * (demand - p)))')} AS rmse, {r('1 - sum((demand - p) * (demand - p)) / (var_pop(demand) * count(*))')} AS r2"
PLAIN = [f for f in X if f != "trend_1"]
for model, features, alpha in (("linear", PLAIN, 0.0), ("ridge", list(X), 10.0)):
    regression(model, "x_assigned", ["fold"], features, alpha)
    regression(f"late_{model}", "x_delayed_assigned", ["delay_hours", "fold"], features, alpha)
NAMES = {"linear": "linear_regression", "ridge": "ridge"}
for model, name in NAMES.items():
    check(
        f"{model}_model",
        f"""SELECT '{name}' AS model, a.*, s.mae, s.rmse, s.r2, 0.0::DOUBLE AS breach FROM (
    SELECT fold, count(*) FILTER (role = 'validation') AS rows, 0::BIGINT AS missing_keys, 0::BIGINT AS surplus_keys,
      0::BIGINT AS bad_values, (sum(demand) FILTER (role = 'validation'))::BIGINT AS label_sum,
      count(*) FILTER (role = 'train') AS train_rows, true AS beats_mean FROM x_assigned GROUP BY 1) a
  JOIN (SELECT fold, {LEAST} FROM x_{model}_made GROUP BY 1) s ON s.fold = a.fold""".replace("a.*", "a.fold, a.rows, a.missing_keys, a.surplus_keys, a.bad_values, a.label_sum, a.train_rows, a.beats_mean"),
    )
check(
    "fitted_walk_forward",
    f"SELECT model, {LEAST}, NULL::DOUBLE AS breach FROM x_long GROUP BY model"
    + "".join(f"\n  UNION ALL SELECT '{name}', {LEAST}, 0.0::DOUBLE FROM x_{model}_made" for model, name in NAMES.items()),
)
check(
    "fitted_delay_study",
    "\n  UNION ALL ".join(
        f"SELECT delay_hours, '{name}' AS model, {LEAST}, 0.0::DOUBLE AS breach FROM x_late_{model}_made GROUP BY 1" for model, name in NAMES.items()
    ),
)

for name, models in {
    "poisson_model": ["poisson"],
    "boosted_model": ["boosted_squared"],
    "boosted_absolute": ["boosted_absolute"],
    "depth_grid": ["depth_4", "depth_6"],
    "borough_models": ["borough_static", "borough_context"],
    "weather_models": ["temporal_1h", "weather_1h", "temporal_3h", "weather_3h"],
}.items():
    fit_contract(name, "x_assigned", models)
fit_contract("loglinear_model", "x_assigned", ["loglinear"], "NULL")
