"""Series operators on hand-made data with known answers."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tideline.operators import selection, series


def obs(spark, rows):
    schema = "aoi_id int, transect_index int, scene_id string, datetime timestamp, ve double, wl double"
    return spark.createDataFrame(rows, schema)


def linear(spark, days=25):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return obs(spark, [(1, t, f"s{d}", start + dt.timedelta(days=d), 5 + t + 0.1 * d, 2 + t + 0.05 * d) for t in (0, 1) for d in range(days)])


def test_linear_series_stays_a_line(spark):
    rows = series.daily_series(linear(spark)).orderBy("transect_index", "day").collect()
    assert len(rows) == 50
    for i, r in enumerate(rows[:25]):
        assert abs(r.ve - (5 + 0.1 * i)) < 1e-9 and abs(r.wl - (2 + 0.05 * i)) < 1e-9


def test_drift_continues_the_line(spark):
    f = series.drift_forecast(series.daily_series(linear(spark)), 7).orderBy("transect_index", "step").collect()
    assert len(f) == 14
    assert abs(f[6].future_ve - (5 + 0.1 * 31)) < 1e-9 and str(f[0].date) == "2024-01-26"


def test_learned_model_follows_the_line_and_falls_back_when_short(spark):
    from tideline.plans import forecasting

    out, metrics = forecasting.forecast_distances(linear(spark, 40), 3, 5)
    row = metrics.first()
    assert row.model_type == "linear_ar" and row.rmse_ve_m < 1e-6
    got = out.filter("transect_index = 0").orderBy("step").collect()
    assert abs(got[2].future_ve - (5 + 0.1 * 42)) < 1e-5
    short, m = forecasting.forecast_distances(linear(spark, 4), 3, 5)
    assert m.first().model_type == "drift" and short.count() == 6


def test_every_run_has_its_own_model(spark):
    from tideline.operators import run_models

    rng = np.random.default_rng(7)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    walk = {(a, t): np.cumsum(rng.normal(size=(60, 2)), axis=0) + 10 * a for a in (1, 2) for t in (0, 1, 2)}
    rows = [(a, t, f"s{d}", start + dt.timedelta(days=d), *map(float, w[d])) for (a, t), w in walk.items() for d in range(60)]
    rows += [(3, 0, f"s{d}", start + dt.timedelta(days=d), 1.0 + d, 2.0) for d in range(2)]
    rows += [(4, 0, f"s{d}", start + dt.timedelta(days=d), 7.0, 8.0) for d in range(9)]
    out, metrics = run_models.forecast_runs(obs(spark, rows), 4, 5, "2024-02-10")
    m = {r.aoi_id: r for r in metrics.collect()}
    assert {a: r.model_type for a, r in m.items()} == {1: "linear_ar", 2: "linear_ar", 3: "drift", 4: "persistence"}
    got = {(r.aoi_id, r.transect_index, r.step): (r.future_ve, r.future_wl) for r in out.collect()}
    for a in (1, 2):
        xs, ys, fit = [], [], []
        for t in (0, 1, 2):
            w = walk[a, t]
            for d in range(5, 60):
                xs.append(np.append(w[d - 5 : d].ravel(), 1.0))
                ys.append(w[d])
                fit.append(d <= 40)
        xs, ys, fit = np.array(xs), np.array(ys), np.array(fit)
        coef = np.linalg.lstsq(xs[fit], ys[fit], rcond=None)[0]
        err = np.sqrt(np.mean((xs[~fit] @ coef - ys[~fit]) ** 2, axis=0))
        assert np.allclose(err, (m[a].rmse_ve_m, m[a].rmse_wl_m), atol=1e-6) and (m[a].train_samples, m[a].val_samples) == (fit.sum(), (~fit).sum())
        for t in (0, 1, 2):
            w = list(walk[a, t])
            for k in range(1, 5):
                w.append(np.append(np.ravel(w[-5:]), 1.0) @ coef)
                assert np.allclose(got[a, t, k], w[-1], atol=1e-5)
    assert got[3, 0, 2] == (4.0, 2.0) and got[4, 0, 4] == (7.0, 8.0)


def pchip(x, y, at):
    """Monotone cubic interpolation by its textbook formula, one point at a time."""
    h, m = np.diff(x), np.diff(y) / np.diff(x)
    d = np.zeros(len(x))
    if len(x) == 2:
        d[:] = m[0]
    else:
        for k in range(1, len(x) - 1):
            if m[k - 1] * m[k] > 0:
                w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
                d[k] = (w1 + w2) / (w1 / m[k - 1] + w2 / m[k])

        def end(h0, h1, m0, m1):
            e = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
            if np.sign(e) != np.sign(m0):
                return 0.0
            return 3 * m0 if np.sign(m0) != np.sign(m1) and abs(e) > 3 * abs(m0) else e

        d[0], d[-1] = end(h[0], h[1], m[0], m[1]), end(h[-1], h[-2], m[-1], m[-2])
    k = min(np.searchsorted(x, at, side="right") - 1, len(h) - 1)
    t = at - x[k]
    return y[k] + t * (d[k] + t * ((3 * m[k] - 2 * d[k] - d[k + 1]) / h[k] + t * (d[k] + d[k + 1] - 2 * m[k]) / h[k] ** 2))


def test_daily_values_over_chunk_borders(spark):
    rng = np.random.default_rng(3)
    start = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)
    hours = np.sort(rng.choice(24 * 1500, 120, replace=False)).astype(float)
    y = rng.normal(size=120)
    d = obs(spark, [(1, 7, str(i), start + dt.timedelta(hours=float(h)), float(v), float(-v)) for i, (h, v) in enumerate(zip(hours, y))])
    got = {r.day: r.ve for r in series.daily_series(d).collect()}
    x = np.array([start.timestamp() + h * 3600 for h in hours])
    days = range(int(x[0] // 86400), int(x[-1] // 86400) + 1)
    assert sorted(got) == list(days)
    for day in days:
        at = day * 86400.0 if day * 86400.0 >= x[0] else (day + 1) * 86400.0
        assert abs(got[day] - pchip(x, y, at)) < 1e-7


def test_single_and_repeated_times(spark):
    t = dt.datetime(2024, 5, 1, 10, tzinfo=dt.timezone.utc)
    d = obs(spark, [(1, 1, "a", t, 1.0, 2.0), (1, 2, "a", t, 1.0, 1.0), (1, 2, "b", t, 5.0, 1.0), (1, 3, "a", t, 4.0, 1.0), (1, 3, "b", t + dt.timedelta(hours=2), 8.0, 1.0), (1, 4, "a", t, None, 1.0)])
    got = {r.transect_index: r.ve for r in series.daily_series(d, tie="scene_id").collect()}
    assert got == {1: 1.0, 2: 5.0, 3: 4.0}


def test_windows_cross_chunk_borders(spark):
    d = spark.range(600).select(F.lit(1).alias("aoi_id"), F.lit(1).alias("transect_index"), F.col("id").cast("int").alias("day"), F.col("id").cast("double").alias("ve"), F.lit(0.0).alias("wl"))
    s = series.sequences(d, 4).orderBy("day").collect()
    assert len(s) == 596
    assert all([w.ve for w in r.window] == [r.day - 4.0, r.day - 3.0, r.day - 2.0, r.day - 1.0] for r in s)


def test_forecast_lines_invert_the_distance(spark):
    t = spark.createDataFrame([(1, i, i * 10.0, 0.0, i * 10.0, 100.0) for i in range(3)], "aoi_id int, transect_index int, x0 double, y0 double, x1 double, y1 double")
    f = spark.createDataFrame([(1, i, 1, dt.date(2024, 1, 1), 20.0, -500.0, "drift") for i in range(4)], "aoi_id int, transect_index int, step int, date date, future_ve double, future_wl double, model_type string")
    lines = {r.boundary: [(p.x, p.y) for p in r.line] for r in series.forecast_lines(series.forecast_points(f, t)).collect()}
    assert lines["vegetation_edge_forecast"] == [(0.0, 70.0), (10.0, 70.0), (20.0, 70.0)]
    assert lines["waterline_forecast"] == [(0.0, 0.0), (10.0, 0.0), (20.0, 0.0)]


def test_upsert_keeps_last_and_is_idempotent(spark):
    s = "aoi_id int, scene_id string, v double"
    old = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], s)
    new = spark.createDataFrame([(1, "b", 9.0), (1, "c", 3.0)], s)
    once = selection.upsert(old, new, ["aoi_id", "scene_id"])
    twice = selection.upsert(once, new, ["aoi_id", "scene_id"])
    want = [("a", 1.0), ("b", 9.0), ("c", 3.0)]
    assert sorted((r.scene_id, r.v) for r in once.collect()) == want == sorted((r.scene_id, r.v) for r in twice.collect())
