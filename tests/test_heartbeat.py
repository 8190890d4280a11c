"""The assimilation cycle as a stream: windows, late and known scenes, timers, replays, retraining."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from tideline.streaming import heartbeat

FEED = "aoi_id bigint, scene_id string, datetime timestamp, polled_at timestamp, bands string"


def day(d, hour=0):
    return dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=d - 1, hours=hour)


@pytest.fixture
def feed(spark, tmp_path):
    place = str(tmp_path / "in")
    os.makedirs(place)
    ledger = heartbeat.Ledger(spark, str(tmp_path / "state"))
    extract = lambda d: d.withColumn("transect_index", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("ve", F.length("bands").cast("double"))

    def poll(rows, at, **rules):
        if rows:
            spark.createDataFrame([(a, s, day(d), day(at, 12), "abc") for a, s, d in rows], FEED).coalesce(1).write.mode("append").parquet(place)
        stream = spark.readStream.schema(FEED).parquet(place)
        heartbeat.follow(stream, ledger, str(tmp_path / "cp"), extract, **rules).awaitTermination()
        rows = ledger.read("status").where(F.col("at") == F.lit(day(at, 12))).orderBy("batch_id").collect()
        return {r.aoi_id: (r.reason, r.new_scenes, r.late_scenes, r.known_scenes, r.timeseries_rows, r.retrain) for r in rows}

    return poll, ledger, tmp_path


def test_late_known_and_repeated_scenes_over_batches(spark, feed):
    poll, ledger, place = feed
    t = spark.createDataFrame([(1,), (2,)], "aoi_id bigint")
    one = poll([(1, "a", 2), (1, "a", 2), (1, "b", 3), (2, "z", 3), (None, "q", 3), (3, None, 3), (4, "old", -60), (4, "ahead", 9)], 5, transects=t, min_rows=4)
    assert one == {1: ("updated", 2, 0, 0, 4, "due"), 2: ("updated", 1, 0, 0, 2, "insufficient_samples"), 4: ("no_new_scenes", 0, 1, 0, 0, None)}
    # what earlier batches stored is not read again
    for f in glob.glob(f"{place}/state/series/*/*.parquet"):
        with open(f, "wb") as out:
            out.write(b"unreadable")
    two = poll([(1, "b", 3), (1, "l", 1), (1, "c", 6), (2, "z", 3), (4, "ahead", 9)], 7, transects=t, min_rows=4)
    assert two == {1: ("updated", 1, 1, 1, 6, "due"), 2: ("no_new_scenes", 0, 0, 1, 2, None), 4: ("no_new_scenes", 0, 0, 0, 0, None)}
    three = poll([(1, "x", 6), (4, "ahead", 9)], 10, transects=t.where("aoi_id = 2"), min_rows=2)
    assert three == {1: ("no_new_scenes", 0, 1, 0, 6, None), 4: ("updated", 1, 0, 0, 2, "missing_transects")}
    same_day = poll([(1, "y", 10), (4, "w", 9)], 10)
    assert same_day[1] == ("updated", 1, 0, 0, 8, "insufficient_samples")
    four = poll([(1, "v", 10)], 10)
    assert four[1][0] in ("updated", "up_to_date")
    areas = {r.aoi_id: r for r in ledger.areas().collect()}
    assert areas[1].timeseries_rows == 8 and areas[1].last_scene_datetime.day == 10 and areas[2].last_scene_datetime.day == 3


def test_timers_answer_for_areas_without_a_poll(spark, feed):
    poll, ledger, _ = feed
    poll([(1, "a", 2), (2, "b", 2)], 3)
    poll([(1, "c", 12)], 13)
    poll([(1, "d", 14)], 20)
    rows = {(r.aoi_id, r["at"].astimezone(dt.timezone.utc).day): r.reason for r in ledger.read("status").collect()}
    # area 2 was due on the 8th and each five days after; of several at once the last is told
    assert rows[2, 8] == "no_new_scenes" and rows[2, 18] == "no_new_scenes" and rows[1, 13] == "updated" and rows[2, 3] == "updated"
    assert ledger.areas().where("aoi_id = 2").first().timeseries_rows == 2


def test_a_batch_that_comes_again_changes_nothing(spark, feed):
    poll, ledger, place = feed
    poll([(1, "a", 2), (1, "b", 3)], 5)
    before = sorted(map(str, ledger.read("series").collect()))
    # as after a failure between the sink and the stream's own commit
    for f in glob.glob(f"{place}/cp/commits/[0-9]*") + glob.glob(f"{place}/cp/commits/.[0-9]*"):
        os.rename(f, f"{place}/{os.path.basename(f)}.bak")
    poll([], 5)
    assert sorted(map(str, ledger.read("series").collect())) == before and ledger.read("status").count() == 1
    assert ledger.areas().first().timeseries_rows == 4


def test_areas_that_are_due_are_retrained_once_an_interval(spark, feed):
    poll, ledger, _ = feed
    t = spark.createDataFrame([(1,)], "aoi_id bigint")
    train = lambda due: due.select("aoi_id", F.lit("m7").alias("model_run_id"))
    assert poll([(1, "a", 2), (1, "b", 3)], 5, transects=t, min_rows=2, interval_days=30, retrain=train)[1][5] == "due"
    assert ledger.areas().first().active_model_run_id == "m7"
    assert poll([(1, "c", 9)], 10, transects=t, min_rows=2, interval_days=30, retrain=train)[1][5] == "not_due"
    assert poll([(1, "d", 40)], 41, transects=t, min_rows=2, interval_days=30, retrain=train)[1][5] == "due"


def test_an_area_is_held_as_columns(spark):
    """Earliest time, then smallest payload, as by brute force; memory holds neither payloads nor an object per scene."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    rows = [(f"s{a}", int(b), f"p{c}") for a, b, c in zip(rng.integers(0, 90, 600), rng.integers(0, 4, 600), rng.integers(0, 5, 600))]
    part = lambda r: pd.DataFrame({"scene_id": [x[0] for x in r], "scene_at": [x[1] for x in r], "payload": [x[2] for x in r], "mark": [hash(x[2]) for x in r], "poll_at": 7})
    want = {}
    for name, at, payload in rows:
        want[name] = min(want.get(name, (at, payload)), (at, payload))
    told = heartbeat.Told(part(rows[k : k + 70]) for k in range(0, 600, 70))
    half = np.arange(len(told.name)) % 2 == 0
    for chosen in (half, ~half):
        got = {n: (a, p) for names, at, payloads in told.scenes(chosen) for n, a, p in zip(names.to_pylist(), at.tolist(), payloads.to_pylist())}
        assert got == {n: want[n] for n, c in zip(told.name.to_pylist(), chosen) if c}
    index = heartbeat.pa.table([told.name, heartbeat.pa.array(told.at)], schema=heartbeat.INDEX)
    assert heartbeat.unpacked(heartbeat.packed(index)).equals(index) and heartbeat.unpacked(None).num_rows == 0
    n, before = 100_000, heartbeat.pa.total_allocated_bytes()
    feed = (pd.DataFrame({"scene_id": [f"scene{k + i}" for i in range(5000)], "scene_at": np.arange(k, k + 5000), "payload": [f"{k + i}" * 60 for i in range(5000)], "mark": k, "poll_at": 7}) for k in range(0, n, 5000))
    tracemalloc.start()
    told = heartbeat.Told(feed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # one payload has 360 bytes and a Python tuple of a scene 200 or so
    assert peak + heartbeat.pa.total_allocated_bytes() - before < 150 * n and len(told.name) == n
