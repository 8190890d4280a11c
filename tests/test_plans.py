"""Label operators and the composed plans on small rasters whose answer can be worked out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import geometry, labels, raster
from tideline.plans import extraction

SCENE = ["aoi_id", "scene_id"]


def foot(px, py, s):
    x0, y0, x1, y1 = s
    dx, dy = x1 - x0, y1 - y0
    l2 = dx * dx + dy * dy
    t = 0.0 if l2 == 0 else min(max(((px - x0) * dx + (py - y0) * dy) / l2, 0.0), 1.0)
    return np.hypot(px - x0 - t * dx, py - y0 - t * dy)


def test_rendered_lines_match_the_distance_to_each_segment(spark):
    segs = [(1.0, 1.0, 12.0, 7.0), (12.0, 7.0, 12.0, 0.0), (3.0, 8.0, 3.0, 8.0), (-4.0, 5.0, 30.0, 5.0)]
    d = spark.createDataFrame([(1, 1, *s, 10, 16) for s in segs], "aoi_id int, scene_id int, x0 double, y0 double, x1 double, y1 double, height int, width int")
    for width in (1.0, 3.0):
        got = {(r.row, r.col) for r in raster.render_lines(d, SCENE, width).collect()}
        assert got == {(r, c) for r in range(10) for c in range(16) if min(foot(c, r, s) for s in segs) <= width / 2}


def test_contour_profile_takes_medians_and_fills_columns(spark):
    pts = [(2.0, 3.2), (4.0, 3.4), (9.0, 3.1), (5.0, 6.0), (-3.0, 9.0), (7.0, 12.4), (1.0, 40.0)]
    d = spark.createDataFrame([(1, 1, 7, i, r, c, 8, 16) for i, (r, c) in enumerate(pts)] + [(1, 2, 7, i, 1.0, float(i), 8, 16) for i in (0, 1)], "aoi_id int, scene_id int, contour int, seq int, row double, col double, height int, width int")
    got = {(r.scene_id, r.x): r.y for r in labels.contour_profile(d).collect()}
    known = {}
    for r, c in pts:
        known.setdefault(int(np.rint(min(max(c, 0), 15))), []).append(min(max(r, 0), 7))
    xs = sorted(known)
    want = {(1, float(x)): np.interp(x, xs, [np.median(known[k]) for k in xs]) for x in range(xs[0], xs[-1] + 1)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def grid_pixels(spark, scenes, h=20, w=30):
    return spark.createDataFrame([(a, s, r, c, c + 0.5, r + 0.5, h, w) for a, s in scenes for r in range(h) for c in range(w)], "aoi_id int, scene_id int, row int, col int, x double, y double, height int, width int")


def test_reference_masks_by_source_and_cover(spark):
    px = grid_pixels(spark, [(1, 1), (2, 2), (3, 3), (4, 4)])
    refs = {1: ((0.0, 10.0, 30.0, 10.0), "manual"), 2: ((-3.5, 0.0, -3.5, 1.0), "manual"), 3: ((-3.5, 0.0, -3.5, 1.0), "auto")}
    d = spark.createDataFrame([(a, *s, src) for a, (s, src) in refs.items()], "aoi_id int, x0 double, y0 double, x1 double, y1 double, source string")
    got = {}
    for r in labels.ref_mask(px, d, 3.0).collect():
        got.setdefault(r.scene_id, set()).add((r.row, r.col))
    every = {(r, c) for r in range(20) for c in range(30)}
    near = lambda a, dist: {(r, c) for r, c in every if foot(c + 0.5, r + 0.5, refs[a][0]) <= dist}
    assert len(near(1, 3.0)) / 600 >= 0.01 > len(near(2, 3.0)) / 600
    assert got == {1: near(1, 3.0), 2: near(2, 6.0), 3: every, 4: every}


def test_corridor_applies_where_it_covers_enough(spark):
    px = grid_pixels(spark, [(1, 1), (1, 2)])
    strip = px.filter("(scene_id = 1 AND col < 3) OR (scene_id = 2 AND col = 0 AND row = 0)")
    n = {r.scene_id: r.n for r in labels.corridor_gate(px, strip).groupBy("scene_id").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 60, 2: 600}


def test_contours_at_the_border_or_far_from_the_reference_lose(spark):
    def line(k, row, length):
        return [(1, 1, k, i, float(row), float(c), float(c), float(row), length, 40, 40) for i, c in enumerate(range(8, 32))]

    d = spark.createDataFrame(line(1, 1, 100.0) + line(2, 12, 40.0) + line(3, 30, 60.0), "aoi_id int, scene_id int, contour int, seq int, row double, col double, x double, y double, length double, height int, width int")
    plain = {r.contour: r.score for r in labels.score_contours(d).collect()}
    assert plain == pytest.approx({1: 5.0, 2: 40.0, 3: 60.0})
    refs = spark.createDataFrame([(1, i, float(8 + i), 10.0) for i in range(24)], "aoi_id int, seq int, x double, y double")
    segs = geometry.measured_segments(refs, ["aoi_id"])
    guided = {r.contour: r.score for r in labels.score_contours(d, refs=segs, reach=4.0).collect()}
    assert guided == pytest.approx({1: 5.0 / 10 * 1.4, 2: 40.0 / 3 * 1.4, 3: 60.0 / 21 * 1.4})
    best = labels.best_contour(labels.score_contours(d, refs=segs, reach=4.0)).first()
    assert best.contour == 2


def test_two_passes_follow_a_straight_shore(spark):
    """Land above, water below; the shore moves two pixels between the scenes, and a far pond is outside the second pass."""
    h, w, rows = 30, 40, []
    for scene, shore in ((1, 14), (2, 16)):
        for r in range(h):
            for c in range(w):
                water = r >= shore or (scene == 2 and r < 4 and 10 <= c < 30)
                b = (0.05, 0.30, 0.05, 0.05, 0.05) if water else (0.05, 0.10, 0.20, 0.22, 0.30) if r > shore - 5 else (0.05, 0.10, 0.05, 0.50, 0.30)
                rows.append((1, scene, r, c, *b, h, w))
    px = spark.createDataFrame(rows, "aoi_id int, scene_id int, row int, col int, b02 double, b03 double, b04 double, b08 double, b11 double, height int, width int")
    frames = spark.createDataFrame([(1, s, 10.0, 0.0, -10.0, 300.0, s) for s in (1, 2)], "aoi_id int, scene_id int, gt_a double, gt_c double, gt_e double, gt_f double, position int").withColumn("datetime", F.timestamp_seconds(F.col("scene_id") * 86400))
    lines, level, baseline = extraction.extract_run(px, frames, max_distance=60.0, min_patch=10)
    level = {(r.scene_id, r.boundary): r for r in level.collect()}
    assert len(level) == 4 and all(-1 < r.threshold < 1 for r in level.values())
    y = {(r.scene_id, r.boundary): (r.lo, r.hi) for r in lines.groupBy("scene_id", "boundary").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).collect()}
    for scene, shore in ((1, 14), (2, 16)):
        edge = 300.0 - 10.0 * shore
        assert y[scene, "WL"][0] == pytest.approx(y[scene, "WL"][1]) and abs(y[scene, "WL"][0] - edge) <= 5.0
    _, obs = extraction.observe(lines, baseline, frames, spacing=100.0, length=100.0)
    wl = {}
    for r in obs.collect():
        wl.setdefault(r.scene_id, []).append(r.WL_distance_m)
    moved = {round(abs(a - b), 3) for a, b in zip(sorted(x for x in wl[1] if x is not None), sorted(x for x in wl[2] if x is not None))}
    assert len(wl[1]) == len(wl[2]) >= 3 and moved == {20.0}
