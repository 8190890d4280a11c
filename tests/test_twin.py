"""State, feed and source behaviour."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.sources import geojson_io, raster_io, tables
from tideline.streaming import twin

S = "aoi_id bigint, scene_id string, transect_index int, datetime timestamp, ve double"


def scenes(spark, names, day0=0):
    t = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    return spark.createDataFrame([(1, n, i, t + dt.timedelta(days=day0 + k), float(k)) for k, n in enumerate(names) for i in (0, 1)], S)


def test_state_is_idempotent_and_ignores_known_and_late_scenes(spark, tmp_path):
    state, now = twin.TwinState(spark, str(tmp_path / "s")), F.current_timestamp()
    assert twin.upsert_batch(state, 0, scenes(spark, "ab"), now, "r0") == "updated"
    assert twin.upsert_batch(state, 0, scenes(spark, "ab"), now, "r0") == "replayed"
    assert twin.upsert_batch(state, 1, scenes(spark, "ab"), now, "r1") == "no_new_scenes"
    assert twin.upsert_batch(state, 2, scenes(spark, "cd", 5), now, "r2") == "updated"
    assert state.read("series", twin.KEYS).count() == 8
    meta = state.read("meta", ["aoi_id"]).first()
    assert meta.timeseries_rows == 8 and meta.last_run_id == "r2"
    # a batch without a commit is not visible
    scenes(spark, "e", 9).write.parquet(str(tmp_path / "s" / "series" / "batch_id=3"))
    assert state.read("series", twin.KEYS).count() == 8
    state.compact({"series": twin.KEYS, "meta": ["aoi_id"]})
    assert state.read("series", twin.KEYS).count() == 8


def test_cycles_report_replays_late_and_known_scenes(spark, tmp_path):
    state = twin.TwinState(spark, str(tmp_path / "c"))
    feed = lambda rows: spark.createDataFrame([(a, s, dt.datetime(2025, 1, d, tzinfo=dt.timezone.utc)) for a, s, d in rows], "aoi_id bigint, scene_id string, datetime timestamp")
    extract = lambda d: d.crossJoin(spark.range(2).select(F.col("id").cast("int").alias("transect_index"))).withColumn("ve", F.lit(1.0))
    t = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0)], "aoi_id bigint, transect_index int, x0 double")

    def run(batch, rows, day, shift=0.0):
        now = F.lit(f"2025-01-{day:02d} 12:00:00").cast("timestamp")
        out = twin.cycle(state, batch, feed(rows), extract, now, f"r{batch}", t.withColumn("x0", F.col("x0") + shift), feed(rows), min_rows=4, interval_days=30)
        return {r.aoi_id: (r.reason, r.new_scenes, r.late_scenes, r.known_scenes, r.timeseries_rows, r.retrain) for r in out.collect()}

    one = run(0, [(1, "a", 2), (1, "b", 3), (2, "z", 3)], 5)
    assert one == {1: ("updated", 2, 0, 0, 4, "due"), 2: ("updated", 1, 0, 0, 2, "insufficient_samples")}
    assert run(0, [(1, "q", 4)], 6) == one
    two = run(1, [(1, "b", 3), (1, "l", 1), (1, "c", 6), (2, "z", 3)], 7, 100.0)
    assert two == {1: ("updated", 1, 1, 1, 6, "due"), 2: ("no_new_scenes", 0, 0, 1, 2, None)}
    three = run(2, [(1, "x", 6)], 6)
    assert three[1] == ("up_to_date", 0, 1, 0, 6, None) and three[2][0] == "no_new_scenes"
    meta = {r.aoi_id: r for r in state.read("meta", ["aoi_id"]).collect()}
    assert meta[1].last_run_id == "r1" and meta[1].timeseries_rows == 6 and meta[2].last_run_id == "r0"
    assert sorted(r.x0 for r in state.read("transects", ["aoi_id", "transect_index"]).collect()) == [5.0, 6.0]
    assert {r.aoi_id: r.scene_id for r in state.read("latest", ["aoi_id"]).collect()} == {1: "c", 2: "z"}
    assert state.read("series", twin.KEYS).count() == 8


def test_retrain_rules_in_order(spark):
    now = F.lit("2025-06-01").cast("timestamp")
    meta = spark.createDataFrame([(1, None), (2, dt.datetime(2025, 5, 1)), (3, None), (4, None)], "aoi_id bigint, last_retrained_at timestamp")
    rows = spark.range(3).crossJoin(spark.createDataFrame([(1,), (2,), (3,)], "aoi_id bigint")).select("aoi_id")
    t = spark.createDataFrame([(1,), (2,), (4,)], "aoi_id bigint")
    got = {r.aoi_id: r.retrain for r in twin.retrain_due(meta, rows, t, now, 3).collect()}
    assert got == {1: "due", 2: "not_due", 3: "missing_transects", 4: "insufficient_samples"}


def test_geojson_reader_takes_longest_part(spark, tmp_path):
    doc = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":1},"geometry":{"type":"MultiLineString","coordinates":[[[0,0],[1,0]],[[0,0],[5,0],[6,0]]]}},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}},{"type":"Feature","properties":{},"geometry":{"type":"LineString","coordinates":[]}}]}'
    (tmp_path / "a.geojson").write_text(doc)
    (tmp_path / "b.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    rows = geojson_io.read_geojson(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and [p.x for p in rows[0].line] == [0.0, 5.0, 6.0] and rows[0].properties["id"] == "1"


def test_array_files(spark, tmp_path):
    a = np.arange(24, dtype="float32").reshape(4, 6)
    a[0, 0] = np.nan
    np.save(tmp_path / "x.npy", a)
    d = raster_io.read_index_arrays(spark, str(tmp_path))
    assert d.count() == 24 and d.filter("value IS NULL").count() == 1 and d.first().west == -1.0
    t = spark.createDataFrame([(0.0, 0.0, 10.0, 5.0)], "x0 double, y0 double, x1 double, y1 double")
    assert raster_io.read_index_arrays(spark, str(tmp_path), t).first().east == 11.0


def test_unknown_artifact_is_an_error(spark):
    with pytest.raises(ValueError):
        tables.load_artifact(spark, "/tmp", "r", "geojson", "nope")
    with pytest.raises(ValueError):
        tables.load_artifact(spark, "/tmp", "r", "xml", "forecast")


def test_bad_times_become_null(spark, tmp_path):
    (tmp_path / "s.csv").write_text("run_id,scene_id,datetime,transect_id,VE_distance_m,WL_distance_m,wl_lon,wl_lat,ve_lon,ve_lat\nr,a,2024-01-01T00:00:00Z,1,1,1,,,,\nr,b,oops,1,1,1,,,,\n")
    rows = tables.read_series(spark, str(tmp_path / "s.csv"), "csv").collect()
    assert [r.datetime is None for r in rows] == [False, True]
