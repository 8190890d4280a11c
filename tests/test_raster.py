"""Pixel, contour and geometry operators on small rasters with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import components, contours, geometry, profiles, raster, skew, spatial, thresholds

KEYS = ["scene_id"]


def grid(spark, values, name="v"):
    h, w = len(values), len(values[0])
    rows = [(1, r, c, None if values[r][c] is None else float(values[r][c]), h, w) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, f"scene_id int, row int, col int, {name} double, height int, width int")


def test_normalised_difference(spark):
    d = spark.createDataFrame([(0.6, 0.2), (0.4, 0.2), (0.2, 0.1), (0.1, 0.1), (0.0, 0.0)], "a double, b double")
    got = [r[0] for r in d.select(raster.nd_index("a", "b")).collect()]
    assert np.allclose(got[:4], [0.5, 1 / 3, 1 / 3, 0.0]) and got[4] is None


def test_focal_std_matches_mirrored_windows(spark):
    rng = np.random.default_rng(1)
    a = rng.random((7, 5))
    for r in (1, 2):
        pad = np.pad(a, r, mode="symmetric")
        want = {(i, j): pad[i : i + 2 * r + 1, j : j + 2 * r + 1].std() for i in range(7) for j in range(5)}
        got = raster.focal_std(grid(spark, a.tolist()), ["v"], r, KEYS).collect()
        assert len(got) == 35 and all(abs(g.v_std - want[g.row, g.col]) < 1e-9 for g in got)


def test_components_by_connectivity(spark):
    m = [[1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 1, 0], [1, 0, 0, 0]]
    d = grid(spark, m).filter("v = 1")
    n = lambda c: components.components(d, KEYS, c).select("component").distinct().count()
    assert n(8) == 2 and n(4) == 3
    assert components.remove_small(d, KEYS, 2, 8).count() == 4
    kept = components.keep_largest(d, KEYS, 4).collect()
    assert sorted((r.row, r.col) for r in kept) == [(0, 0), (0, 1)]


def test_plane_has_a_straight_iso_line_and_a_peak_a_ring(spark):
    plane = grid(spark, [[0.01 * r] * 8 for r in range(8)])
    c = contours.stitch(contours.iso_segments(plane, KEYS, "v", F.lit(0.035)), KEYS).orderBy("seq").collect()
    assert len(c) == 8 and all(abs(r.row - 3.5) < 1e-9 for r in c) and not c[0].closed
    assert [r.col for r in c] in (list(range(8)), list(range(7, -1, -1)))
    hill = [[1.0 if (r, q) == (2, 2) else 0.0 for q in range(5)] for r in range(5)]
    ring = contours.stitch(contours.iso_segments(grid(spark, hill), KEYS, "v", F.lit(0.5)), KEYS).orderBy("seq").collect()
    assert len(ring) == 5 and ring[0].closed and (ring[0].row, ring[0].col) == (ring[-1].row, ring[-1].col)


def test_masked_cells_cut_the_line(spark):
    v = [[0.01 * r if c != 4 else None for c in range(9)] for r in range(6)]
    c = contours.stitch(contours.iso_segments(grid(spark, v), KEYS, "v", F.lit(0.025)), KEYS)
    assert c.select("contour").distinct().count() == 2


def test_fill_and_smoothing(spark):
    d = grid(spark, [[None, 1.0, None, None, 4.0, None]])
    known = d.filter("v IS NOT NULL")
    got = profiles.fill_linear(known, ["scene_id"], "col", ["v"], F.lit(0), F.lit(5)).orderBy("col").collect()
    assert [r.v for r in got] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    cubic = spark.range(40).select(F.lit(1).alias("scene_id"), F.col("id").alias("pos"), (F.col("id") * F.col("id") * 0.5 - F.col("id")).alias("v"))
    s = profiles.savgol(cubic, KEYS, "pos", ["v"], F.lit(40), 11, 3).collect()
    assert all(abs(r.v - (r.pos**2 * 0.5 - r.pos)) < 1e-6 for r in s)


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=3000), 2)
    d = spark.createDataFrame([(i % 3, float(x)) for i, x in enumerate(v)], "k int, v double")
    got = {r.k: (r.a, r.b, r.c) for r in skew.exact_quantiles(d, ["k"], "v", [0.02, 0.5, 0.98], ["a", "b", "c"]).collect()}
    for k in range(3):
        assert np.allclose(got[k], np.percentile(v[k::3], [2, 50, 98]))


def test_neighbours_and_sums_across_chunks(spark):
    d = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    n = skew.ordered_neighbours(d, ["k"], ["t"], F.floor(F.col("t") / 3), ["t"], 2, 2).collect()
    for r in n:
        assert [p.t for p in r.prev] == [x for x in (r.t - 2, r.t - 4) if x >= 0]
        assert [p.t for p in r.next] == [x for x in (r.t + 2, r.t + 4) if x < 100]
    s = skew.running_sum(d, ["k"], ["t"], F.floor(F.col("t") / 7), F.lit(1), "c").collect()
    assert all(r.c == r.t // 2 + 1 for r in s)


def test_two_modes_give_the_weighted_threshold(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0.6, 0.02, 400), rng.normal(-0.2, 0.02, 400)
    rows = [(1, 1, float(x)) for x in a] + [(1, 2, float(x)) for x in b]
    d = spark.createDataFrame(rows, "scene_id int, cls int, v double")
    t = thresholds.weighted_peaks(d, "v", "cls", 1, 2, KEYS).first()
    assert abs(t.threshold - (0.2 * -0.2 + 0.8 * 0.6)) < 0.03
    few = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0)], "scene_id int, cls int, v double")
    assert thresholds.weighted_peaks(few, "v", "cls", 1, 2, KEYS).first().threshold == 0.5


def test_intersection_cases(spark):
    t = spark.createDataFrame([(1, i, 10.0 * i, 0.0, 10.0 * i, 100.0) for i in range(4)], "aoi_id int, transect_index int, x0 double, y0 double, x1 double, y1 double")
    segs = [(1, 7, -5.0, 80.0, 5.0, 80.0), (1, 7, -5.0, 40.0, 5.0, 40.0), (1, 7, 10.0, 20.0, 10.0, 40.0), (1, 7, 25.0, 10.0, 25.0, 90.0)]
    s = spark.createDataFrame(segs, "aoi_id int, line int, x0 double, y0 double, x1 double, y1 double")
    got = {r.transect_index: r.distance_signed for r in spatial.intersect(t, s, ["line"], cell=30.0).collect()}
    assert sorted(got) == [0, 1] and abs(got[0] + 10) < 1e-9 and abs(got[1] + 20) < 1e-9


def test_transects_stand_on_the_line(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1000.0, 0.0)], "aoi_id int, seq long, x double, y double")
    t = geometry.generate_transects(v, ["aoi_id"], 100.0, 500.0, 0.7).orderBy("transect_index").collect()
    assert len(t) == 11 and all(abs(r.x0 - 100.0 * r.transect_index) < 1e-9 and abs(r.y0 + 150) < 1e-9 and abs(r.y1 - 350) < 1e-9 for r in t)
    b = geometry.baseline_transects(v, ["aoi_id"], 300.0).orderBy("transect_index").collect()
    assert [r.transect_label for r in b] == ["T001", "T002", "T003", "T004", "T005"]


def test_nearest_distances_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    p, q = rng.random((60, 2)) * 500, rng.random((7, 2)) * 500
    cols = "k int, i int, x0 double, y0 double, x1 double, y1 double, cum0 double"
    mk = lambda a: spark.createDataFrame([(1, i, float(x), float(y), float(x), float(y), 0.0) for i, (x, y) in enumerate(a)], cols)
    got = {r.i: r.distance for r in spatial.nearest_segment(mk(p), mk(q), ["k", "i"], ["k"], 10.0).collect()}
    want = np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1)).min(1)
    assert len(got) == 60 and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def brute_components(cells, reach):
    """Component ids (row << 32 | first column of the first run) by flood fill."""
    left, out = set(cells), {}
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (reach == 8 or not (i and j))]
    while left:
        todo = [left.pop()]
        found = []
        while todo:
            r, c = todo.pop()
            found.append((r, c))
            for i, j in steps:
                if (r + i, c + j) in left:
                    left.remove((r + i, c + j))
                    todo.append((r + i, c + j))
        r, c = min(found)
        out |= {x: (r << 32) + c for x in found}
    return out


@pytest.mark.parametrize("tile", [3, 5, 256])
def test_components_over_tile_borders_match_flood_fill(spark, monkeypatch, tile):
    import random

    from tideline.operators import components

    monkeypatch.setattr(components, "TILE", tile)
    rng = random.Random(5)
    scenes = {f"s{k}": {(r, c) for r in range(17) for c in range(19) if rng.random() < share} for k, share in enumerate((0.3, 0.45, 0.6, 0.9))}
    scenes["comb"] = {(r, c) for r in range(17) for c in range(19) if c % 2 == 0 or r == 16}
    scenes["steps"] = {(k, k) for k in range(16)} | {(k, 17 - k) for k in range(8)}
    rows = [(s, r, c) for s, cells in scenes.items() for r, c in cells]
    mask = spark.createDataFrame(rows + rows[:9], "scene_id string, row int, col int")
    for reach in (4, 8):
        want = {(s, *x): v for s, cells in scenes.items() for x, v in brute_components(cells, reach).items()}
        assert {(r.scene_id, r.row, r.col): r.component for r in components.components(mask, ["scene_id"], reach).collect()} == want
    sizes = {}
    for (s, *_), v in want.items():
        sizes[s, v] = sizes.get((s, v), 0) + 1
    big = {(s, r, c) for (s, r, c), v in want.items() if sizes[s, v] >= 5}
    assert {tuple(r) for r in components.remove_small(mask, ["scene_id"], 5).collect()} == big
    assert components.components(mask.where("false"), ["scene_id"]).count() == 0


def test_morphology_matches_brute_force(spark):
    import random

    from tideline.operators import raster

    rng = random.Random(6)
    h, w = 13, 15
    scenes = {f"s{k}": {(r, c) for r in range(h) for c in range(w) if rng.random() < share} for k, share in enumerate((0.03, 0.5, 0.97))}
    rows = [(1, s, r, c, h, w) for s, cells in scenes.items() for r, c in cells]
    mask = spark.createDataFrame(rows + rows[:5], "aoi_id int, scene_id string, row int, col int, height int, width int")
    square, cross = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    for offsets in (raster.disk(1), raster.disk(2), raster.disk(5), square, cross):
        for s, cells in scenes.items():
            frame = {(r, c) for r in range(h) for c in range(w)}
            one = mask.where(f"scene_id = '{s}'")
            got = lambda d: {(r.row, r.col) for r in d.collect()}
            assert got(raster.dilate(one, 0, offsets=offsets)) == {(r + i, c + j) for r, c in cells for i, j in offsets} & frame
            assert got(raster.erode(one, 0, offsets=offsets)) == {(r, c) for r, c in frame if all((r + i, c + j) in cells or (r + i, c + j) not in frame for i, j in offsets)}
            assert got(raster.erode(one, 0, offsets=offsets, outside=False)) == {(r, c) for r, c in frame if all((r + i, c + j) in cells for i, j in offsets)}
    with pytest.raises(ValueError):
        raster.half_widths([(0, 1), (0, 0)])


def test_contours_are_the_same_in_tiles_of_any_size(spark, monkeypatch):
    """Open lines and rings inside and across tiles, against a walk along the segments."""
    rng = np.random.default_rng(8)
    a = np.outer(np.sin(np.arange(23) * 0.55), np.sin(np.arange(31) * 0.45)) + rng.normal(0, 0.15, (23, 31))
    a[7, 9] = a[15, 20] = np.nan
    values = [[None if np.isnan(v) else float(v) for v in r] for r in a]
    segs = contours.iso_segments(grid(spark, values), KEYS, "v", F.lit(0.1)).cache()
    follows, at = {}, {}
    for r in segs.collect():
        follows[r.a], at[r.a], at[r.b] = r.b, (r.r0, r.c0), (r.r1, r.c1)
    want, left = {}, set(at)
    for head in [*sorted(set(at) - set(follows.values())), *sorted(at)]:
        if head in left:
            line = [head]
            while follows.get(line[-1]) in left and follows[line[-1]] != head:
                line.append(follows[line[-1]])
            left -= set(line)
            closed = follows.get(line[-1]) == head
            if len(line) + closed >= 3:
                want[head] = (closed, [at[x] for x in line + [head] * closed])
    assert {c for c, _ in want.values()} == {True, False}
    rounds = []
    double = contours._double
    monkeypatch.setattr(contours, "_double", lambda links, keys: rounds.append(links.count()) or double(links, keys))
    for size in (3, 256):
        monkeypatch.setattr(contours, "TILE", size)
        got = {}
        for r in contours.stitch(segs, KEYS).orderBy("seq").collect():
            got.setdefault(r.contour, (r.closed, []))[1].append((r.row, r.col))
            assert r.n_vertices == len(want[r.contour][1])
        assert got == want
    # a raster that fits in a tile is stitched without any doubling
    assert len(rounds) == 1 and 0 < rounds[0] < len(at)
