"""Scans and ranks in parts, against the plain way."""

import random
import re

from pyspark.sql import functions as F

from tideline.operators import metrics, samples, spatial


def test_best_so_far_in_chunks(spark):
    rng = random.Random(1)
    rows = [(run, s, rng.choice([None, 1.0, 2.0, 3.0, float(rng.randrange(9))])) for run in range(6) for s in rng.sample(range(-20, 80), 40)]
    log = spark.createDataFrame(rows, "run int, step int, score double")
    for higher in (True, False):
        for chunk in (7, 4096):
            got = {(r.run, r.step): (r.best, r.best_step, r.stale_steps) for r in metrics.best_so_far(log, "step", "score", ["run"], higher, chunk).collect()}
            for run in range(6):
                best, at, stale = None, None, 0
                for _, s, v in sorted(r for r in rows if r[0] == run):
                    prev = best
                    if v is not None:
                        best = v if best is None else (max if higher else min)(best, v)
                    if prev is None or best != prev:
                        at, stale = s, 0
                    else:
                        stale += 1
                    assert got[run, s] == (best, at, stale)
    assert metrics.best_so_far(log.where("false"), "step", "score", ["run"]).count() == 0


def test_kth_smallest_by_bits(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(500)] + [5] * 300 + [-7] * 40 + [(1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for few in (1, 50, 4096):
        for k in (1, 2, 250, 400, 841, 842):
            assert samples.kth_smallest(df, "v", k, few) == sorted(values)[k - 1]


def test_seeded_share_is_exact_and_keeps_copies_together(spark):
    df = spark.range(1000).select("id", (F.col("id") % 5).alias("aoi_id"), F.lit(2020).alias("year"))
    out = samples.split_by_year(df, None, 0.2, 3, ["id"], ["4"])
    assert {r.part: r["count"] for r in out.groupBy("part").count().collect()} == {"train": 640, "val": 160, "holdout": 200}
    twice = samples.split_by_year(df.unionByName(df), None, 0.2, 3, ["id"], ["4"])
    assert twice.groupBy("id").agg(F.count_distinct("part").alias("n")).where("n > 1").isEmpty()


def test_nearest_segment_leaves_out_infinite_coordinates(spark):
    inf = float("inf")
    q = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0), (2, inf, 0.0, inf, 0.0), (3, float("nan"), 0.0, 0.0, 0.0), (4, 900.0, 0.0, 900.0, 0.0)], "q int, x0 double, y0 double, x1 double, y1 double").withColumn("k", F.lit(1))
    t = spark.createDataFrame([(3.0, 4.0, 3.0, 4.0, 0.0), (-inf, 0.0, 1.0, 0.0, 0.0)], "x0 double, y0 double, x1 double, y1 double, cum0 double").withColumn("k", F.lit(1))
    assert {r.q: round(r.distance, 3) for r in spatial.nearest_segment(q, t, ["q", "k"], ["k"], 2.0).collect()} == {1: 5.0, 4: 897.009}


def test_cells_of_segments_are_those_of_the_array(spark):
    rng = random.Random(5)
    ends = [[rng.uniform(-90, 90) for _ in range(4)] for _ in range(60)]
    ends += [[0.0, 0.0, 0.0, 0.0], [5.0, -30.0, 5.0, 30.0], [-30.0, 10.0, 30.0, 10.0], [None, 1.0, 2.0, 3.0], [1.0, None, 40.0, 3.0], [1.0, None, 4.0, None], [None] * 4]
    d = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "i int, x0 double, y0 double, x1 double, y1 double")
    for pad in (0.0, 10.0):
        whole = d.select("i", F.explode(spatial.cells(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], 10.0, pad)).alias("c")).select("i", "c.cx", "c.cy")
        got = spatial._segment_cells(d, 10.0, pad).select("i", "cx", "cy")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_meetings_of_transects_run_as_compiled_code(spark, capsys):
    cols = "double, ".join(("x0 ", "y0 ", "x1 ", "y1 ")) + "double"
    t = spark.createDataFrame([("a", 0, 5.0, 0.0, 5.0, 10.0), ("a", 1, 50.0, 0.0, 50.0, 10.0)], f"aoi_id string, transect_index int, {cols}")
    s = spark.createDataFrame([("a", 1, 0.0, 5.0, 20.0, 5.0), ("a", 2, 5.0, 2.0, 5.0, 4.0), ("a", 3, 6.0, 0.0, 7.0, 9.0), ("a", 4, 0.0, None, 9.0, None)], f"aoi_id string, line int, {cols}")
    hits = spatial.transect_hits(t, s, ["line"], cell=10.0)
    assert sorted((r.line, r.transect_index, round(r.t, 9)) for r in hits.collect()) == [(1, 0, 0.5), (2, 0, 0.3)]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spatial.transect_hits(t, s, ["line"], cell=10.0).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    # the JVM interprets methods of more than 8000 bytes
    assert sizes and max(sizes) < 8000


TRANSECT = "aoi_id string, transect_index int, x0 double, y0 double, x1 double, y1 double"
SEGMENT = "aoi_id string, line string, x0 double, y0 double, x1 double, y1 double"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_hits_are_hashed_and_keep_transects_of_one_index_apart(spark, capsys):
    t = spark.createDataFrame(
        [("a", 0, 0.0, 0.0, 0.0, 100.0), ("a", 0, 0.0, 100.0, 0.0, 0.0), ("a", 1, 10.0, 0.0, 10.0, 100.0), ("a", 1, 10.0, 0.0, 10.0, 200.0), ("a", 1, 10.0, 0.0, 10.0, 200.0),
         ("a", None, 20.0, 0.0, 20.0, 100.0), ("b", 0, 0.0, 0.0, 0.0, 100.0), (None, 0, 0.0, 0.0, 0.0, 100.0)], TRANSECT)
    s = spark.createDataFrame(
        [("a", "p", -5.0, 25.0, 5.0, 25.0), ("a", "p", 5.0, 60.0, 25.0, 60.0), ("a", "p", 5.0, 95.0, 25.0, 95.0), ("a", None, -5.0, 80.0, 5.0, 80.0), (None, "p", -5.0, 25.0, 5.0, 25.0),
         ("a", "q", 20.0, 30.0, 20.0, 50.0), ("a", "q", 15.0, 58.0, 25.0, 58.0)], SEGMENT)
    near = spatial.intersect(t, s, ["line"], cell=100.0)
    got = {(r.aoi_id, r.line, r.transect_index): tuple(round(v, 6) for v in (r.distance_from_start, r.distance_signed, r.x, r.y)) for r in near.collect()}
    # a tie goes to the smaller share, and the share to the transect it was measured on
    assert got == {
        ("a", "p", 0): (25.0, -25.0, 0.0, 25.0), ("a", "p", 1): (95.0, -5.0, 10.0, 95.0), ("a", "p", None): (60.0, 10.0, 20.0, 60.0),
        ("a", None, 0): (20.0, -30.0, 0.0, 80.0), ("a", "q", None): (58.0, 8.0, 20.0, 58.0),
    }
    plan = _plan(near)
    assert "SortAggregate" not in plan and "knownnotcontainsnull" not in plan
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spatial.intersect(t, s, ["line"], cell=100.0).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert max(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)) < 8000


def test_reconstruction_counts_and_fills_in_one_pass(spark):
    t = spark.createDataFrame([("a", i, 10.0 * i, 0.0, 10.0 * i, 100.0) for i in (1, 2, 4, 5, 7)] + [("a", None, 90.0, 0.0, 90.0, 100.0)], TRANSECT)
    flat = lambda line, y, xs: [("a", line, x - 1.0, y, x + 1.0, y) for x in xs]
    # two hits are too few, three of six are under the ratio; a transect without an index counts, but has no place to fill from
    s = spark.createDataFrame(
        flat("p", 40.0, [10.0, 40.0, 50.0, 90.0]) + flat("p", 60.0, [20.0]) + flat("q", 40.0, [10.0, 20.0]) + flat("r", 40.0, [10.0, 20.0, 70.0]) + flat(None, 40.0, [10.0, 20.0, 40.0, 50.0]), SEGMENT)
    out = spatial.reconstruct(t, s, ["line"], 0.6, cell=100.0)
    rows = sorted((r.line, r.seq, round(r.x, 6), round(r.y, 6), r.known, r.hits, round(r.hit_ratio, 6)) for r in out.collect())
    want = [(0, 10.0, 40.0, False), (1, 10.0, 40.0, True), (2, 20.0, 60.0, True), (3, 30.0, 50.0, False), (4, 40.0, 40.0, True), (5, 50.0, 40.0, True), (6, 50.0, 40.0, False), (7, 50.0, 40.0, False)]
    assert rows == [("p", i, x, y, known, 5, round(5 / 6, 6)) for i, x, y, known in want]
    plan = _plan(spatial.reconstruct(t, s, ["line"], 0.6, cell=100.0))
    # places of the transects for both their uses, the count and the neighbours; no summary of chunk borders to join
    assert plan.count("Window [") == 4 and "SortAggregate" not in plan and "collect_list" not in plan
