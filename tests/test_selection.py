"""Selection, validation and score rules on hand-made rows, with the answers written out."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import geometry, metrics, selection, spatial, thresholds
from tideline.sources import raster_io


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_run_names_belong_to_an_area_up_to_an_underscore(spark):
    runs = spark.createDataFrame(
        [(None, "aoi1_r1", day(1), True), (None, "aoi12_r9", day(9), True), (None, "north_bay_r2", day(3), True), (None, "aoi1x", day(8), True), ("aoi12", "own", day(2), True)],
        "aoi_id string, run_id string, generated_at timestamp_ntz, ready boolean",
    )
    areas = spark.createDataFrame([("aoi1",), ("aoi12",), ("north_bay",), ("aoi",)], "aoi_id string")
    got = {r.aoi_id: r.run_id for r in selection.latest_run(runs, areas, ["ready"]).collect()}
    assert got == {"aoi1": "aoi1_r1", "aoi12": "aoi12_r9", "north_bay": "north_bay_r2"}


def test_waterlines_match_names_with_their_case(spark):
    lines = spark.createDataFrame([(None, "run_Bay_1", day(1), 5.0), (None, "run_bay_2", day(2), 6.0), ("Bay", "x", day(3), 7.0)], "aoi_id string, run_id string, datetime timestamp_ntz, length double")
    latest = spark.createDataFrame([("Bay", None, day(4), 8.0)], "aoi_id string, run_id string, datetime timestamp_ntz, length double")
    got = selection.waterline_history(lines, latest, 100, F.lit(day(10))).collect()
    assert [(r.datetime, r.length) for r in got] == [(day(1), 5.0), (day(3), 7.0), (day(4), 8.0)]
    assert selection.waterline_history(lines, latest.where("false"), 100, F.lit(day(10))).count() == 0


def test_lookback_counts_from_now_and_keeps_an_all_old_area(spark):
    rows = spark.createDataFrame([(1, day(0)), (1, day(95)), (2, day(0)), (2, day(3))], "aoi_id int, datetime timestamp_ntz")
    got = sorted((r.aoi_id, r.datetime) for r in selection.lookback(rows, 10, now=F.lit(day(100))).collect())
    assert got == [(1, day(95)), (2, day(0)), (2, day(3))]


def test_an_uneven_bow_tie_crosses_itself(spark):
    d = spark.createDataFrame([(1, [[0.0, 0.0], [0.01, 0.01], [0.01, 0.0], [0.0, 0.01]]), (2, [[0.0, 0.0], [0.02, 0.02], [0.01, 0.0], [0.0, 0.01]]), (3, [[0.0, 0.0], [0.01, 0.01]])], "aoi_id int, vertices array<array<double>>")
    got = {r.aoi_id: r.reason for r in geometry.validate_aoi(d).collect()}
    assert got == {1: "self_intersection", 2: "self_intersection", 3: "too_few_vertices"}


def test_an_empty_mask_scores_null(spark):
    a = spark.createDataFrame([(1, 0, 0), (1, 3, 4), (2, 5, 5)], "scene_id int, row int, col int")
    b = spark.createDataFrame([(1, 0, 0), (3, 1, 1)], "scene_id int, row int, col int")
    got = {r.scene_id: (r.assd, r.hd95) for r in metrics.boundary_metrics(a, b, ["scene_id"]).collect()}
    assert got[1][0] == pytest.approx(1.25) and got[2] == (None, None) and got[3] == (None, None)
    px = spark.createDataFrame([(1, 0, 0, 0.9, True), (1, 1, 0, 0.1, False), (2, 0, 0, 0.9, False)], "scene_id int, row int, col int, p double, t boolean")
    err = {r.scene_id: (r.transect_mae, r.n_columns) for r in metrics.transect_error(px, "p", "t", ["scene_id"]).collect()}
    assert err == {1: (0.0, 1), 2: (None, 0)}


def test_nearest_segment_ends_without_a_coordinate_and_reaches_far(spark):
    q = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 0.0), (2, 1, None, 0.0, None, 0.0), (3, 1, float("nan"), 0.0, 1.0, 0.0), (4, 1, 90000.0, 0.0, 90000.0, 0.0)], "id int, k int, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame([(1, 3.0, 4.0, 3.0, 9.0, 0.0), (1, None, 1.0, 1.0, 1.0, 0.0)], "k int, x0 double, y0 double, x1 double, y1 double, cum0 double")
    got = {r.id: r.distance for r in spatial.nearest_segment(q, t, ["id", "k"], ["k"], 4.0).collect()}
    assert set(got) == {1, 4} and got[1] == pytest.approx(5.0) and got[4] == pytest.approx(np.hypot(89997.0, 4.0))


def test_density_is_the_same_in_one_part_and_in_many(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0.1, 0.03, 300), rng.normal(0.6, 0.05, 300), [9.0]])
    d = spark.createDataFrame([(1, float(x), 1 + int(x > 0.3)) for x in v], "scene_id int, v double, cls int")
    grid = np.linspace(v.min(), v.max(), thresholds.GRID)
    want = np.log(np.exp(-((grid[:, None] - v[None, :]) ** 2) / 0.0002).sum(axis=1) + 1e-300) - np.log(len(v) * 0.01 * np.sqrt(2 * np.pi))
    found = []
    for size in (20_000, 50):
        monkeypatch.setattr(thresholds, "PART_VALUES", size)
        y = np.array(thresholds.density_curves(d, ["scene_id"], "v").first()._y)
        near = want > -600
        assert np.allclose(y[near], want[near])
        found.append(thresholds.weighted_peaks(d, "v", "cls", 1, 2, ["scene_id"]).first().threshold)
    assert found[0] == pytest.approx(found[1])


def test_class_mode_takes_the_highest_rung_reached(spark):
    bump = lambda at, h: h * np.exp(-((thresholds.CLASS_BINS - at) ** 2) / 0.0005)
    one = np.log(0.01 + bump(0.2, 0.4) + bump(0.5, 0.2))
    assert thresholds.highest_rung(one) == pytest.approx(0.2)
    assert thresholds.highest_rung(np.log(0.01 + bump(-0.4, 0.6) + bump(0.3, 0.7))) == pytest.approx(0.3)
    assert thresholds.highest_rung(np.log(0.01 + bump(0.1, 0.6) + bump(0.3, 0.7))) == pytest.approx(0.1)
    assert thresholds.highest_rung(np.log(0.5 + 0.01 * thresholds.CLASS_BINS)) == pytest.approx(0.99)


def test_an_array_of_another_rank_is_reported(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((2, 2, 2, 2)))
    with pytest.raises(Exception, match="no raster"):
        raster_io.read_arrays(spark, str(tmp_path)).count()


def test_lines_of_any_length_come_back_from_feature_lines(spark, tmp_path):
    """Pieces of four vertices; lines end inside, at and one behind the end of a piece."""
    from tideline.sources import geojson_io

    sizes = {1: 1, 2: 2, 3: 4, 4: 5, 5: 12, 6: 23}
    rows = [(k, i * 10, float(i), float(k)) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "line_id bigint, seq bigint, x double, y double")
    pieces = geometry.lines_in_chunks(df, ["line_id"], F.floor(F.col("seq") / 30), 4)
    assert pieces.agg(F.max(F.size("line"))).first()[0] == 5
    geojson_io.write_feature_lines(geojson_io.to_features(pieces, "line", ["line_id", "chunk"]), f"{tmp_path}/out")
    back = geojson_io.read_feature_lines(spark, f"{tmp_path}/out").select("properties", F.posexplode("line").alias("k", "q")).collect()
    got = sorted((int(r.properties["line_id"]), int(r.properties["chunk"]) * 4 + r.k - (r.properties["chunk"] > "0"), r.q.x, r.q.y) for r in back if r.properties["chunk"] == "0" or r.k > 0)
    assert got == [(k, s // 10, x, y) for k, s, x, y in rows if sizes[k] > 1]


def test_least_cloud_equals_brute_force_and_forms_no_pairs(spark):
    rng = np.random.default_rng(3)
    micro, hours = dt.timedelta(microseconds=1), 12
    times = [day(0) + dt.timedelta(hours=int(h)) + micro * int(e) for h, e in zip(rng.integers(0, 96, 300), rng.integers(-1, 2, 300))]
    scenes = [(int(i % 3) if i % 41 else None, i, times[i] if i % 37 else None, float(rng.integers(0, 120)) if i % 5 else None) for i in range(300)]
    asked = [(int(i % 4) if i % 29 else None, i // 2, times[-i - 1] if i % 31 else None) for i in range(200)]
    s = spark.createDataFrame(scenes, "aoi_id int, scene_id int, datetime timestamp_ntz, cloud_pct double").withColumn("datetime", F.col("datetime").cast("timestamp"))
    r = spark.createDataFrame(asked, "aoi_id int, request_id int, at timestamp_ntz").withColumn("at", F.col("at").cast("timestamp"))
    want = {}
    for a, k, at in asked:
        near = [(100.0 if c is None else c, i) for b, i, t, c in scenes if None not in (a, at, t) and a == b and abs(t - at) <= dt.timedelta(hours=hours)]
        if near:
            want[a, k] = min([*near, want.get((a, k), (1e9, 0))])
    got = selection.least_cloud(s, r, hours)
    assert {(x.aoi_id, x.request_id): x.scene_id for x in got.collect()} == {k: v[1] for k, v in want.items()} and len(want) > 50
    # scenes and requests are joined on nothing but equal times, so no pair of them is formed
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins and all("at#" in x and "_b#" not in x for x in joins)


def test_shapes_are_worked_out_once_for_both_sides_of_a_join(spark):
    from tideline.operators import samples

    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString().lower()
    d = spark.createDataFrame([(1, [[0.0, 0.0], [0.01, 0.01], [0.01, 0.0]]), (2, [[0.0, 0.0], [0.02, 0.02], [0.01, 0.0], [0.0, 0.01]]), (3, None)], "aoi_id int, vertices array<array<double>>")
    areas = geometry.validate_aoi(d)
    # the tests of a ring are not part of the plan that joins the areas to their shapes
    assert "exists(" not in plan(areas) and {r.aoi_id: r.reason for r in areas.collect()} == {1: None, 2: "self_intersection", 3: "too_few_vertices"}
    shapes = spark.createDataFrame([(1, day(31 * k), 0, 0.1 * k, 0.5) for k in range(5)], "aoi_id int, datetime timestamp_ntz, seq int, u double, v double")
    rolled = samples.shape_forecast(shapes.withColumn("u", F.sin(F.asin("u"))), 1)
    assert "sin(" not in plan(rolled) and rolled.first().u == pytest.approx(0.5)
