import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import START, checks, panel
from zonecast.operators import contracts, folds, forecasts, models, regressions, resample, scores, temporal
from zonecast.settings import BASELINES, NUMERIC_FEATURES

ZONES = (2, 3)
FOLDS = folds.study_folds("2026-01-01", ("2026-01-10", "2026-01-12", "2026-01-14"), "2026-01-14")


def study_panel(spark, poison=False):
    begin = folds.utc_midnight("2026-01-01")
    demand = lambda z, i: (i * 7 % 23 if z == 2 else i % 2)
    rows = panel(spark, 14 * 24, ZONES, demand, start=begin)
    if poison:
        late = F.col("hour") >= F.lit(str(folds.utc_midnight("2026-01-14"))).cast("timestamp_ntz")
        return rows.withColumn("demand", F.when(late, 10**6).otherwise(F.col("demand")))
    return rows


@pytest.mark.parametrize(
    "boundaries, sealed",
    [(("2026-01-10",), "2026-01-14"), (("2026-01-12", "2026-01-10"), "2026-01-14"), (("2026-01-10", "2026-01-15"), "2026-01-14"), (("2025-12-01", "2026-01-10"), "2026-01-14")],
)
def test_bad_folds(boundaries, sealed):
    with pytest.raises(ValueError):
        folds.study_folds("2026-01-01", boundaries, sealed)


def test_boundaries_follow_daylight_saving():
    assert folds.utc_midnight("2026-03-08") == datetime(2026, 3, 8, 5)
    assert folds.utc_midnight("2026-03-09") == datetime(2026, 3, 9, 4)


def test_roles_and_embargo(spark):
    rows = folds.assign_folds(study_panel(spark), FOLDS, 174, 6)
    spans = {(r["fold"], r["role"]): (r["a"], r["b"], r["n"]) for r in rows.groupBy("fold", "role").agg(F.min("hour").alias("a"), F.max("hour").alias("b"), F.count("*").alias("n")).collect()}
    start = folds.utc_midnight("2026-01-01")
    origin = folds.utc_midnight("2026-01-10")
    assert spans[("fold_1", "train")][:2] == (start + timedelta(hours=174), origin - timedelta(hours=7))
    assert spans[("fold_1", "validation")] == (origin, origin + timedelta(hours=47), 96)


def test_sealed_labels_change_nothing(spark):
    clean, poisoned = (
        forecasts.walk_forward(study_panel(spark, p), FOLDS, None, 168, 0).orderBy("zone_id", "hour").collect() for p in (False, True)
    )
    assert clean == poisoned and len(clean) == 2 * 96


def test_walk_forward_is_complete_and_consistent(spark):
    table = forecasts.walk_forward(study_panel(spark), FOLDS, None, 168, 0, 1.0)
    zones = spark.createDataFrame([(2,), (3,)], "zone_id int")
    part = table.where("fold = 'fold_1'")
    good = contracts.check_complete_window(part, zones, FOLDS[0].validation_start, FOLDS[0].validation_end)
    assert not any(checks(good).values())
    assert {(r.zone_id, r.zone_cohort) for r in table.select("zone_id", "zone_cohort").distinct().collect()} == {(2, "dense"), (3, "sparse")}
    assert not any(checks(contracts.check_scores_input(table, list(BASELINES))).values())


def test_delays_share_targets(spark):
    table = forecasts.delay_study(study_panel(spark), FOLDS)
    one = lambda d: table.where(F.col("delay_hours") == d).drop("delay_hours")
    matched = forecasts.match_control(one(6), one(0))
    assert all(r.bad_rows == 0 for r in matched.collect())
    plain = forecasts.walk_forward(study_panel(spark), FOLDS, None, 174, 6)
    same = one(0).withColumnRenamed("latest_available", "previous_hour")
    sides = {r["side"]: r["rows"] for r in contracts.reconcile_tables(plain, same, plain.columns).collect()}
    assert sides == {"left_only": 0, "right_only": 0}


def test_training_average_falls_back_to_the_zone(spark):
    rows = [("f", 2, 5, 4.0, "train"), ("f", 2, 5, 6.0, "train"), ("f", 2, 7, 0.0, "validation"), ("f", 2, 5, 0.0, "validation"), ("f", 9, 5, 0.0, "validation")]
    frame = spark.createDataFrame(rows, "fold string, zone_id int, local_hour int, demand double, role string")
    found = {(r.zone_id, r.local_hour): r.zone_hour_average for r in forecasts.with_zone_means(frame, 1.0).collect()}
    assert found == {(2, 7): 5.0, (2, 5): 5.0, (9, 5): None}


def wide(spark, rows):
    return spark.createDataFrame(rows, "fold string, zone_id int, hour timestamp_ntz, demand int, m double, n double")


def test_metrics(spark):
    rows = [("a", 2, START, 0, 0.0, 1.0), ("a", 3, START, 4, 2.0, 4.0), ("b", 2, START, 2, 2.0, 5.0)]
    pooled = {r.model: r for r in scores.pooled_scores(wide(spark, rows), ["m", "n"]).collect()}
    assert pooled["m"].mae == pytest.approx(2 / 3)
    assert pooled["m"].rmse == pytest.approx(math.sqrt(4 / 3))
    assert pooled["m"].r2 == pytest.approx(1 - 4 / 8)
    assert pooled["m"].smape_pct == pytest.approx((0 + 200 * 2 / 6 + 0) / 3)
    by_fold = {(r.fold, r.model): r for r in scores.fold_scores(wide(spark, rows), ["m", "n"]).collect()}
    assert by_fold[("b", "m")].r2 is None
    # Pooled RMSE is not the mean of fold RMSEs.
    assert pooled["n"].rmse == pytest.approx(math.sqrt((1 + 0 + 9) / 3))


def test_zero_reference_has_no_relative_reduction(spark):
    table = spark.createDataFrame([("pooled", "a", 1.0), ("pooled", "b", 0.0)], "scope string, model string, mae double")
    row = scores.compare_models(table, [("a", "b")]).first()
    assert row.delta_mae == 1.0 and row.relative_reduction_pct is None


def losses(spark):
    rows = [("f1", f"2026-01-0{i + 1}", i, 46 if i == 1 else 48, m, float((i + 1) * k)) for i in range(3) for m, k in (("a", 1), ("b", 2))]
    rows += [("f2", f"2026-01-1{i}", i, 48, m, float(i + k)) for i in range(2) for m, k in (("a", 1), ("b", 5))]
    return spark.createDataFrame(rows, "fold string, date_nyc string, day_index int, rows bigint, model string, mae double")


def test_circular_blocks(spark):
    days = resample.fold_days(losses(spark))
    made = resample.circular_blocks(days, (2, 1), 50, 7).collect()
    for block in (1, 2):
        for replicate in range(50):
            for fold, n in (("f1", 3), ("f2", 2)):
                mine = sorted((r.position, r.day_index) for r in made if (r.block_days, r.replicate, r.fold) == (block, replicate, fold))
                assert [p for p, _ in mine] == list(range(n))
                for (p, d), (_, e) in zip(mine, mine[1:]):
                    if block == 2 and p % 2 == 0:
                        assert e == (d + 1) % n
    with pytest.raises(Exception, match="exceed"):
        resample.circular_blocks(days, (3,), 5, 7).collect()


def test_block_sums_equal_day_by_day(spark):
    table = losses(spark)
    fast = {(r.block_days, r.replicate, r.model): r.mae for r in resample.bootstrap_mae(table, (2, 1), 40, 3).collect()}
    days = resample.circular_blocks(resample.fold_days(table), (2, 1), 40, 3)
    slow = days.join(table, ["fold", "day_index"]).groupBy("block_days", "replicate", "model").agg((F.sum(F.col("rows") * F.col("mae")) / F.sum("rows")).alias("mae"))
    assert len(fast) == 160
    for r in slow.collect():
        assert fast[(r.block_days, r.replicate, r.model)] == pytest.approx(r.mae)


def test_intervals_match_numpy(spark):
    table = losses(spark)
    draws = resample.bootstrap_mae(table, (1,), 300, 11)
    pooled = spark.createDataFrame([("a", 2.0), ("b", 4.0)], "model string, mae double")
    row = resample.family_intervals(draws, pooled, [("a", "b")], 1).first()
    paired = {}
    for r in draws.collect():
        paired.setdefault(r.replicate, {})[r.model] = r.mae
    delta = [p["a"] - p["b"] for p in paired.values()]
    assert row.delta_mae_low == pytest.approx(np.quantile(delta, 0.025))
    assert row.delta_mae_high == pytest.approx(np.quantile(delta, 0.975))
    assert (row.delta_mae, row.relative_reduction_pct, row.role) == (-2.0, 50.0, "primary")
    written = resample.linear_percentiles(draws, [("a", "b")], (0.025,)).first()
    assert written.delta_mae == pytest.approx(row.delta_mae_low)
    zero = draws.withColumn("mae", F.lit(0.0))
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
        resample.contrast_intervals(zero, pooled, [("a", "b")], 1).collect()
    with pytest.raises(ValueError):
        resample.check_contrasts([("a", "a")], ["a"])


def test_weather_role_marks_the_asked_delay(spark):
    pooled = spark.createDataFrame([("a", 2.0), ("b", 4.0)], "model string, mae double")
    both = [("a", "b"), ("b", "a")]
    plain = resample.block_sensitivity(losses(spark), pooled, both, (1, 2), 1, 20, 5)
    found = resample.block_sensitivity(losses(spark), pooled, both, (1, 2), 1, 20, 5, weather_candidate="a")
    assert found.columns == [*plain.columns, "weather_role"]
    assert {(r.candidate, r.block_days, r.role, r.weather_role) for r in found.collect()} == {
        ("a", 1, "primary", "primary"),
        ("a", 2, "sensitivity", "primary"),
        ("b", 1, "primary", "sensitivity"),
        ("b", 2, "sensitivity", "sensitivity"),
    }
    with pytest.raises(ValueError):
        resample.block_sensitivity(losses(spark), pooled, both, (1,), 1, 20, 5, weather_candidate="c")


def test_day_weights_follow_daylight_saving(spark):
    zones = spark.createDataFrame([(2,), (3,)], "zone_id int")
    fold = folds.study_folds("2026-02-01", ("2026-03-07", "2026-03-10"), "2026-03-10")
    made = {r.date_nyc: (r.day_index, r["rows"]) for r in resample.day_weights(zones, fold).collect()}
    assert made == {"2026-03-07": (0, 48), "2026-03-08": (1, 46), "2026-03-09": (2, 48)}


def daily_case(spark):
    table = forecasts.walk_forward(study_panel(spark), FOLDS, None, 168, 0)
    names = list(BASELINES)
    zones = spark.createDataFrame([(2,), (3,)], "zone_id int")
    daily = scores.daily_scores(table, names)
    return daily, resample.day_weights(zones, FOLDS), scores.fold_scores(table, names), scores.pooled_scores(table, names), names


@pytest.mark.parametrize(
    "name, change",
    [
        ("duplicate_key", lambda d: d.unionByName(d.limit(1))),
        ("missing_cell", lambda d: d.where("date_nyc <> '2026-01-11'")),
        ("wrong_row_count", lambda d: d.withColumn("rows", F.col("rows") + 1)),
        ("bad_date", lambda d: d.withColumn("date_nyc", F.lit("11/01/2026"))),
        ("invalid_number", lambda d: d.withColumn("mae", -F.col("mae"))),
        ("fold_mae_disagrees", lambda d: d.withColumn("mae", F.col("mae") * 1.01)),
        ("pooled_mae_disagrees", lambda d: d.withColumn("mae", F.col("mae") * 1.01)),
    ],
)
def test_daily_defects(spark, name, change):
    daily, weights, by_fold, pooled, names = daily_case(spark)
    daily = daily.persist()
    assert not any(checks(contracts.check_daily_errors(daily, weights, by_fold, pooled, names)).values())
    assert checks(contracts.check_daily_errors(change(daily), weights, by_fold, pooled, names))[name] > 0


def random_panel(spark):
    """Random counts, so that the features are independent and the solution is unique."""
    draw = np.random.default_rng(5).poisson(8, (2, 14 * 24)).tolist()
    return panel(spark, 14 * 24, ZONES, lambda z, i: draw[z - 2][i], start=folds.utc_midnight("2026-01-01"))


def model_frame(spark, regular=True):
    rows = random_panel(spark) if regular else study_panel(spark)
    made = temporal.drop_warmup(temporal.make_features(rows))
    cut = F.lit(str(FOLDS[-1].validation_start)).cast("timestamp_ntz")
    return made.where(F.col("hour") < cut), made.where(F.col("hour") >= cut)


def arrays(train, valid):
    frames = [f.select("zone_id", "hour", "demand", *NUMERIC_FEATURES).orderBy("zone_id", "hour").toPandas() for f in (train, valid)]
    x = [f[list(NUMERIC_FEATURES)].to_numpy(float) for f in frames]
    mean, std = x[0].mean(0), x[0].std(0)
    std[std == 0] = 1
    zone = [np.stack([(f.zone_id == z).to_numpy(float) for z in ZONES], 1) for f in frames]
    return [np.hstack([z, (v - mean) / std]) for z, v in zip(zone, x)], frames[0].demand.to_numpy(float)


def predicted(frame):
    return np.array([r.prediction for r in frame.orderBy("zone_id", "hour").collect()])


def test_linear_equals_least_squares(spark):
    train, valid = model_frame(spark)
    (a, b), y = arrays(train, valid)
    expected = np.maximum(0, b @ np.linalg.lstsq(a, y, rcond=None)[0])
    assert predicted(models.linear_model(train, valid)) == pytest.approx(expected, abs=1e-4)


def test_ridge_equals_closed_form(spark):
    train, valid = model_frame(spark)
    (a, b), y = arrays(train, valid)
    mean = a.mean(0)
    centred = a - mean
    w = np.linalg.solve(centred.T @ centred + 10 * np.eye(a.shape[1]), centred.T @ (y - y.mean()))
    expected = np.maximum(0, (b - mean) @ w + y.mean())
    assert predicted(models.ridge_model(train, valid)) == pytest.approx(expected, abs=1e-6)


def test_boosting_contract(spark):
    train, valid = model_frame(spark, regular=False)
    made = models.boosted_model(train, valid, rounds=20)
    values = predicted(made)
    assert len(values) == valid.count() and np.isfinite(values).all() and (values >= 0).all()
    actual = np.array([r.demand for r in valid.orderBy("zone_id", "hour").collect()])
    mean24 = np.array([r.rolling_mean_24 for r in valid.orderBy("zone_id", "hour").collect()])
    assert abs(values - actual).mean() < abs(mean24 - actual).mean()


def test_fits_of_all_folds_keep_their_contract(spark):
    assigned = folds.assign_folds(temporal.drop_warmup(temporal.make_features(study_panel(spark))), FOLDS, 168, 0)
    fits = {"linear": models.fit_linear, "poisson": models.Boosting(loss="poisson", options={"rounds": 8, "rate": 0.3}), **models.depth_fits((2, 3), rounds=5)}
    fits |= models.bundle_fits({"more": []}, rounds=3)
    made = models.fit_report(assigned, models.fit_folds(assigned, FOLDS, fits)).collect()
    assert {(r.model, r.fold) for r in made} == {(m, f.name) for m in fits for f in FOLDS}
    for r in made:
        mine = assigned.where(F.col("fold") == r.fold)
        assert r.rows == mine.where("role = 'validation'").count() and r.train_rows == mine.where("role = 'train'").count()
        assert (r.missing_keys, r.surplus_keys, r.bad_values, r.beats_mean) == (0, 0, 0, True)
    lost = models.fit_folds(assigned, FOLDS[:1], {"linear": models.fit_linear}).where("zone_id = 2")
    assert models.fit_report(assigned, lost).first().missing_keys == 48


def many_zones(spark, zones=5000, rows=6):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(zones * rows, 2))
    zone = np.repeat(np.arange(zones), rows)
    y = np.maximum(0, 40 + 3 * x[:, 0] - 2 * x[:, 1] + np.repeat(draw.normal(0, 5, zones), rows) + draw.normal(size=zones * rows))
    table = [(int(z), START + timedelta(hours=i), float(d), float(a), float(b)) for i, (z, d, (a, b)) in enumerate(zip(zone, y, x))]
    return spark.createDataFrame(table, "zone_id int, hour timestamp_ntz, demand double, lag_3 double, lag_24 double"), zone, x, y


def test_five_thousand_zones_equal_the_closed_form(spark):
    rows, zone, x, y = many_zones(spark)
    z = (x - x.mean(0)) / x.std(0)
    within = lambda v: v - (np.array([np.bincount(zone, c) for c in np.atleast_2d(v.T)]) / np.bincount(zone)).T[zone].reshape(v.shape)
    slopes = np.linalg.lstsq(within(z), within(y), rcond=None)[0]
    level = np.bincount(zone, y - z @ slopes) / np.bincount(zone)
    values = lambda made: np.array([r.prediction for r in made.orderBy("hour").collect()])
    features = ["lag_3", "lag_24"]
    assert values(models.linear_model(rows, rows, features)) == pytest.approx(np.maximum(0, z @ slopes + level[zone]), abs=1e-6)
    design = np.hstack([np.ones((len(y), 1)), z])
    alpha = 10.0
    # Ridge on one-hot zones: their block of the normal equations is diagonal.
    n = np.bincount(zone) + alpha
    cross = np.array([np.bincount(zone, c) for c in design.T]).T
    left = design.T @ design - cross.T @ (cross / n[:, None]) + alpha * np.diag([0, 1, 1])
    theta = np.linalg.solve(left, design.T @ y - cross.T @ (np.bincount(zone, y) / n))
    effect = (np.bincount(zone, y) - cross @ theta) / n
    assert values(models.ridge_model(rows, rows, features, alpha)) == pytest.approx(np.maximum(0, design @ theta + effect[zone]), abs=1e-6)


def test_unseen_zone_gets_the_common_level(spark):
    rows, zone, x, y = many_zones(spark, zones=40, rows=30)
    train, unseen = rows.where("zone_id > 0"), rows.where("zone_id = 0")
    for fit in (models.linear_model, models.ridge_model, models.loglinear_model):
        got = np.array([r.prediction for r in fit(train, unseen, ["lag_3", "lag_24"]).collect()])
        assert len(got) == 30 and abs(got.mean() - y[zone > 0].mean()) < 8


def test_next_hour_needs_a_week(spark):
    frame = panel(spark, 200).where((F.col("zone_id") == 2) | (F.col("hour") >= F.lit("2026-01-05 00:00:00").cast("timestamp_ntz")))
    scorer = lambda rows: rows.withColumn("prediction", F.col("lag_1") - 1000)
    rows = forecasts.score_next_hour(frame, scorer).collect()
    assert [(r.zone_id, r.predicted_pickups) for r in rows] == [(2, 0.0)]
    assert rows[0].target_hour_utc == START + timedelta(hours=200)
    assert forecasts.score_next_hour(frame, scorer, "2026-02-01 00:00:00").count() == 0
    seen = panel(spark, 200).select("zone_id").where("zone_id = 2")
    assert forecasts.score_next_hour(frame, scorer, trained_zones=seen).count() == 1
    with pytest.raises(Exception, match="No training rows"):
        forecasts.score_next_hour(frame, scorer, trained_zones=seen.where("zone_id = 3")).collect()


def test_r2_of_a_large_target_with_small_noise(spark):
    rng = np.random.default_rng(4)
    noise = rng.standard_normal(3000)
    target = 1e9 + noise
    guess = 1e9 + 0.5 * noise
    rows = [(f"fold_{i % 3}", i % 7, float(t), float(g)) for i, (t, g) in enumerate(zip(target, guess, strict=True))]
    frame = spark.createDataFrame(rows, "fold string, part int, demand double, m double")
    miss = np.array([t - g for _, _, t, g in rows])
    want = 1 - (miss**2).sum() / ((target - target.mean()) ** 2).sum()
    assert scores.pooled_scores(frame, ["m"]).first()["r2"] == pytest.approx(want, rel=1e-6)
    pooled = scores.all_scores(frame, ["m"]).where("scope = 'pooled'").first()["r2"]
    by_part = scores.slice_scores(frame, ["m"], ["part"], keys=()).collect()
    assert pooled == pytest.approx(want, rel=1e-6) and len(by_part) == 7
    for r in by_part:
        held = np.array([i % 7 == int(r["value"]) for i in range(len(rows))])
        assert r["r2"] == pytest.approx(1 - (miss[held] ** 2).sum() / ((target[held] - target[held].mean()) ** 2).sum(), rel=1e-6)


def test_r2_is_null_without_spread(spark):
    frame = spark.createDataFrame([("a", 2.0, 1.0), ("a", 2.0, 3.0), ("b", 5.0, 1.0)], "fold string, demand double, m double")
    got = {r["scope"]: r["r2"] for r in scores.all_scores(frame, ["m"]).collect()}
    assert got["a"] is None and got["b"] is None and got["pooled"] is not None


def test_fold_regressions_equal_the_single_fits(spark):
    rows = temporal.drop_warmup(temporal.make_features(random_panel(spark)))
    made, proofs = regressions.regression_study(rows, FOLDS, None, 168, 3)
    assigned = folds.assign_folds(rows, FOLDS, 168, 3)
    # The first fold trains on two days, which hold too few weekdays for one solution.
    for fold in FOLDS[1:]:
        mine = assigned.where(F.col("fold") == fold.name)
        train, valid = mine.where("role = 'train'"), mine.where("role = 'validation'")
        got = made.where(F.col("fold") == fold.name).orderBy("zone_id", "hour").toPandas()
        assert got["linear_regression"].to_numpy() == pytest.approx(predicted(models.linear_model(train, valid)), abs=1e-6)
        assert got["ridge"].to_numpy() == pytest.approx(predicted(models.ridge_model(train, valid)), abs=1e-6)
    held = proofs.collect()
    assert len(held) == 2 * len(FOLDS) and all(r["breach"] < 1e-9 for r in held)
    assert [r["train_rows"] for r in held if r["model"] == "ridge"] == [
        assigned.where((F.col("fold") == r["fold"]) & (F.col("role") == "train")).count() for r in held if r["model"] == "ridge"
    ]


def test_certificates_see_other_coefficients(spark):
    rows = temporal.drop_warmup(temporal.make_features(random_panel(spark)))
    fit = regressions.fit_regressions(rows, FOLDS, [("ridge", ["lag_1", "lag_24"], 10.0)], 168, 3)
    assigned = folds.assign_folds(rows, FOLDS, 168, 3)
    fit.solutions = fit.solutions.withColumn("m0_slopes", F.transform("m0_slopes", lambda s: s * 1.05))
    assert all(r["breach"] > 1e-4 for r in fit.certificate(assigned).collect())


def test_delays_are_fitted_apart(spark):
    made = temporal.cyclic(temporal.local_calendar(temporal.delayed_features(random_panel(spark), (0, 3))))
    rows = temporal.drop_warmup(made)
    both, _ = regressions.regression_study(rows, FOLDS, None, 174, 6, ["delay_hours"])
    late, _ = regressions.regression_study(rows.where("delay_hours = 3").drop("delay_hours"), FOLDS, None, 174, 6)
    key = ["fold", "zone_id", "hour"]
    x, y = (t.orderBy(*key).toPandas()["ridge"].to_numpy() for t in (both.where("delay_hours = 3"), late))
    assert x == pytest.approx(y, abs=1e-9)


def test_folds_that_do_not_expand_are_refused(spark):
    rows = temporal.drop_warmup(temporal.make_features(random_panel(spark)))
    other = [FOLDS[0], folds.Fold("x", FOLDS[0].validation_start, FOLDS[1].validation_start, FOLDS[1].validation_end)]
    with pytest.raises(ValueError, match="one training start"):
        regressions.fit_regressions(rows, other)


def test_only_sums_and_narrow_rows_meet_the_zones_effects(spark):
    """A certificate joins effects to sums per zone, not to training rows, and predictions carry no features into that join."""
    rows = spark.range(4000).selectExpr("int(id % 8) AS zone_id", "timestamp_ntz'2026-01-01' + make_dt_interval(0, int(id DIV 8)) AS hour", "int(pmod(hash(id), 7)) AS demand", "double(pmod(hash(id, 1), 50)) AS a")
    fold = folds.Fold("f", START, START + timedelta(hours=300), START + timedelta(hours=400))
    made = regressions.fit_regressions(rows, [fold], [("m", ["a"], 0.0)])
    split = folds.assign_folds(rows, [fold], 0)
    proof, predicted = made.certificate(split), made.predictions(split.where("role = 'validation'")).select("fold", "zone_id", "hour", "demand", "m")
    plans = [frame._jdf.queryExecution().optimizedPlan().toString() for frame in (proof, predicted)]
    # What stands below the outer join on its row side.
    sides = [plan[plan.index("LeftOuter") :].split("\n")[1:3] for plan in plans]
    assert any("Aggregate" in line for line in sides[0])
    assert any(" AS m0_base" in line for line in sides[1])
    told = proof.collect()[0]
    assert told["train_rows"] == 2400 and told["breach"] < 1e-9
    wrong = regressions.FoldRegressions(**(vars(made) | {"effects": made.effects.withColumn("m0_effect", F.col("m0_effect") + 1)}))
    assert wrong.certificate(split).collect()[0]["breach"] > 0.01


def test_rows_of_loglinear_steps_are_not_shuffled_to_their_effects(spark):
    """Effects are a table of known size, so that a step broadcasts them as long as they are few."""
    rows = spark.range(900).selectExpr("int(id % 9) AS zone_id", "timestamp_ntz'2026-01-01' + make_dt_interval(0, int(id DIV 9)) AS hour", "int(pmod(hash(id), 5)) AS demand", "double(pmod(hash(id, 1), 50)) AS a")
    score = models.fit_loglinear(rows, ["a"])
    plan = score(rows)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert score(rows).where("prediction > 0").count() == 900
