"""State, streams, sources and the composed plans."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions import lines as ln
from tideline.functions.scoring import score_with
from tideline.lineage import cut, scratch_path
from tideline.operators import geometry, labels, metrics, raster, samples, selection, series
from tideline.plans import extraction, forecasting, labelling
from tideline.registry import proxies as p
from tideline.registry import query, r3, r6, s3, s6
from tideline.registry.raster import IDX, indexed, scene_frames
from tideline.registry.scalar import PLACES, places
from tideline.sources import geojson_io, raster_io, tables
from tideline.streaming import heartbeat, jobs, twin


def _meta(spark, sf):
    o = p.obs(spark, sf).groupBy("aoi_id").agg(F.max("datetime").alias("m"))
    return o.select(
        "aoi_id", F.col("m").alias("last_assimilation_at"), F.when(F.col("aoi_id") % 3 != 0, F.col("m")).alias("last_scene_datetime"),
        F.when(F.col("aoi_id") % 2 == 0, F.lit("2024-01-10").cast("timestamp")).alias("last_retrained_at"), F.when(F.col("aoi_id") % 2 == 0, "m1").alias("active_model_run_id"),
    )


@query("twin_summary", f"WITH {p.OBS} SELECT aoi_id, max(datetime) AS last_assimilation_at, CASE WHEN aoi_id % 2 = 0 THEN 'm1' END AS active_model_run_id, count(*) AS timeseries_rows, max(datetime) AS last_observation_at FROM obs GROUP BY aoi_id")
def twin_summary(spark, sf):
    return metrics.twin_summary(p.obs(spark, sf), _meta(spark, sf)).drop("last_retrained_at")


@query("poll_windows", f"WITH {p.OBS}, m AS (SELECT aoi_id, CASE WHEN aoi_id % 3 <> 0 THEN max(datetime) END AS l FROM obs GROUP BY aoi_id), w AS (SELECT aoi_id, coalesce(CAST(l AS DATE) + 1, DATE '2024-01-30' - 45) AS s FROM m) SELECT aoi_id, strftime(s, '%Y-%m-%d') AS poll_start, CASE WHEN s > DATE '2024-01-30' THEN 'up_to_date' ELSE 'poll' END AS poll_status FROM w")
def poll_windows(spark, sf):
    w = twin.poll_window(_meta(spark, sf), F.lit("2024-01-30").cast("date"))
    return w.select("aoi_id", F.col("poll_start").cast("string").alias("poll_start"), "poll_status")


@query("retrain_decisions", f"WITH {p.OBS} SELECT aoi_id, CASE WHEN count(*) < 1000 THEN 'insufficient_samples' WHEN aoi_id % 2 = 0 THEN 'not_due' WHEN aoi_id = 5 THEN 'missing_transects' ELSE 'due' END AS retrain FROM obs GROUP BY aoi_id")
def retrain_decisions(spark, sf):
    o = p.obs(spark, sf)
    d = twin.retrain_due(_meta(spark, sf), o, o.filter("aoi_id <> 5"), F.lit("2024-02-10").cast("timestamp"), 1000)
    return d.select("aoi_id", "retrain")


@query("rolled_metadata", f"WITH {p.OBS} SELECT aoi_id, CASE WHEN aoi_id < 5 THEN 'run9' END AS last_run_id, CASE WHEN aoi_id % 3 <> 0 OR aoi_id < 5 THEN max(datetime) END AS last_scene_datetime FROM obs GROUP BY aoi_id")
def rolled_metadata(spark, sf):
    m = _meta(spark, sf).withColumn("last_run_id", F.lit(None).cast("string"))
    batch = p.obs(spark, sf).filter("aoi_id < 5").groupBy("aoi_id").agg(F.max("datetime").alias("last_scene_datetime")).withColumn("last_run_id", F.lit("run9"))
    return twin.advance_meta(m, batch).select("aoi_id", "last_run_id", "last_scene_datetime")


@query("seeded_state", f"WITH {p.OBS}, r AS (SELECT aoi_id, max(kind) AS run_id FROM obs GROUP BY 1) SELECT aoi_id, scene_id FROM obs WHERE aoi_id < 4 UNION ALL SELECT obs.aoi_id, scene_id FROM obs JOIN r ON r.aoi_id = obs.aoi_id AND r.run_id = obs.kind WHERE obs.aoi_id >= 4")
def seeded_state(spark, sf):
    o = p.obs(spark, sf)
    runs = o.groupBy("aoi_id").agg(F.max("kind").alias("run_id"))
    have = {"series": o.filter("aoi_id < 4").select("aoi_id", "scene_id")}
    return twin.seed_state(have, {"series": o.withColumn("run_id", F.col("kind"))}, runs)["series"]


@query("monthly_candidates", f"WITH {p.SCENES} SELECT aoi_id, date_trunc('month', datetime)::TIMESTAMP AS month, count(*) AS candidates, arg_min(scene_id, (coalesce(cloud_pct, 100), scene_id)) AS best_scene, min(coalesce(cloud_pct, 100)) AS best_cloud FROM scenes GROUP BY ALL")
def monthly_candidates(spark, sf):
    return twin.monthly(p.scenes(spark, sf))


PHASE = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'completed' ELSE 'running' END"
JOBS = f"ev AS (SELECT user_id AS job_id, event_id % 4 AS phase, event_id AS seq, ts, {PHASE} AS state, event_type || event_id AS message FROM events), ph AS (SELECT job_id, phase, arg_max(state, seq) AS state, arg_max(message, seq) AS message, max(seq) AS seq FROM ev GROUP BY ALL)"


def _job_events(e):
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "completed").otherwise("running")
    return e.select(
        F.col("user_id").alias("job_id"), (F.col("event_id") % 4).alias("phase"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        state.alias("state"), F.concat("event_type", F.col("event_id").cast("string")).alias("message"),
    )


@query("job_status", f"WITH {JOBS} SELECT job_id, CASE WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_and(state = 'completed') THEN 'completed' ELSE 'running' END AS status, arg_max(message, seq) FILTER (state = 'failed') AS error, NOT bool_or(state = 'failed') AND NOT bool_and(state = 'completed') AS active, count(*) AS n_phases FROM ph GROUP BY 1")
def job_status(spark, sf):
    s = jobs.job_status(_job_events(p.table(spark, sf, "events")))
    return s.select("job_id", "status", "error", "active", F.size("phases").alias("n_phases"))


# --- streams: the event table as a file stream, run until its data is used up ---

def _stream(spark, sf, name):
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _obs_stream(spark, sf):
    e = _stream(spark, sf, "events")
    return e.select(
        (F.col("user_id") % 10).alias("aoi_id"), F.col("event_id").alias("scene_id"), F.col("user_id").alias("transect_index"), F.col("ts").cast("timestamp").alias("datetime"),
        F.col("value").alias("ve"), F.get_json_object("props", "$.k").cast("double").alias("wl"),
    )


@query("phase_stream", f"WITH {JOBS} SELECT job_id, phase, state, seq FROM ph")
def phase_stream(spark, sf):
    """Latest state per phase kept by a streaming aggregate in update mode."""
    out, cp = scratch_path(spark, "phases"), scratch_path(spark, "phases-cp")
    live = jobs.phase_status(_job_events(_stream(spark, sf, "events")))

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    live.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    return selection.best_per_key(rows, ["job_id", "phase"], [F.col("batch_id")]).select("job_id", "phase", "state", "seq")


@query("latest_line_stream", f"WITH {p.OBS} SELECT aoi_id, arg_max(scene_id, (datetime, scene_id)) AS scene_id, max(datetime) AS datetime FROM obs GROUP BY 1")
def latest_line_stream(spark, sf):
    out, cp = scratch_path(spark, "lines"), scratch_path(spark, "lines-cp")
    live = twin.latest_line(_obs_stream(spark, sf).select("aoi_id", "scene_id", "datetime"))

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    live.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    return selection.best_per_key(spark.read.parquet(out), ["aoi_id"], [F.col("batch_id")]).select("aoi_id", "scene_id", "datetime")


@query("deduplicated_stream", f"WITH {p.OBS} SELECT aoi_id, scene_id, datetime FROM obs")
def deduplicated_stream(spark, sf):
    """Every scene arrives twice in one feed and leaves once."""
    out, cp = scratch_path(spark, "dedup"), scratch_path(spark, "dedup-cp")
    s = _obs_stream(spark, sf).select("aoi_id", "scene_id", "datetime")
    twice = s.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    q = twin.dedup_scenes(twice, "40 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp)
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("assimilated_state", f"WITH {p.OBS} SELECT aoi_id, count(*) AS n_rows, {s6('sum(ve)')} AS sum_ve, max(datetime) AS last_scene_datetime, count(*) AS timeseries_rows FROM obs GROUP BY aoi_id")
def assimilated_state(spark, sf):
    """The whole feed assimilated by the stream in one poll."""
    ledger = heartbeat.Ledger(spark, scratch_path(spark, "twin"))
    feed = _obs_stream(spark, sf).withColumn("polled_at", F.lit("2024-02-01").cast("timestamp"))
    heartbeat.follow(feed, ledger, scratch_path(spark, "twin-cp"), lambda b: b).awaitTermination()
    rows = ledger.read("series").groupBy("aoi_id").agg(F.count("*").alias("n_rows"), r6(F.sum("ve")).alias("sum_ve"))
    return rows.join(ledger.areas().select("aoi_id", "last_scene_datetime", "timeseries_rows"), "aoi_id")


HELD = f"""WITH {p.OBS}, o AS (SELECT *, (day(datetime) - 1) // 8 AS b FROM obs),
  n AS (SELECT aoi_id, b, count(*) FILTER (scene_id % 97 <> 0) AS new_scenes, count(*) FILTER (scene_id % 97 = 0) AS held, count(*) FILTER (scene_id % 50 = 0 AND scene_id % 97 <> 0) AS again FROM o GROUP BY ALL)
  SELECT aoi_id, b AS cycle, 'updated' AS reason, new_scenes, coalesce(lag(held) OVER w, 0) AS late_scenes, coalesce(lag(again) OVER w, 0) AS known_scenes, sum(new_scenes) OVER w AS timeseries_rows FROM n WINDOW w AS (PARTITION BY aoi_id ORDER BY b)"""


def _feed(spark, sf, b):
    """Scenes of the ``b``-th eight days with what the days before held back or give again."""
    o = p.obs(spark, sf).withColumn("_b", F.floor((F.dayofmonth("datetime") - 1) / 8))
    held, again = F.col("scene_id") % 97 == 0, (F.col("scene_id") % 50 == 0) & (F.col("scene_id") % 97 != 0)
    return o.filter(((F.col("_b") == b) & ~held) | ((F.col("_b") == b - 1) & (held | again))).drop("_b")


@query("heartbeat_stream", HELD)
def heartbeat_stream(spark, sf):
    """Four polls of eight days each through one stream with its state; scenes held back come late, some come twice, and the stream starts once more without new files."""
    ledger, place, cp = heartbeat.Ledger(spark, scratch_path(spark, "heartbeat")), scratch_path(spark, "polls"), scratch_path(spark, "heartbeat-cp")
    schema = p.obs(spark, sf).withColumn("polled_at", F.col("datetime")).schema
    for b in (0, 1, None, 2, 3):
        if b is not None:
            _feed(spark, sf, b).withColumn("polled_at", F.lit(f"2024-01-{min(8 * b + 8, 31)} 23:59:59").cast("timestamp")).write.mode("append").parquet(place)
        heartbeat.follow(spark.readStream.schema(schema).parquet(place), ledger, cp, lambda d: d).awaitTermination()
    s = ledger.read("status").withColumn("cycle", F.floor((F.dayofmonth("at") - 1) / 8))
    return s.select("aoi_id", "cycle", "reason", "new_scenes", "late_scenes", "known_scenes", "timeseries_rows")


@query("assimilation_cycles", HELD)
def assimilation_cycles(spark, sf):
    """Four cycles of eight days each; scenes held back come late, some come twice, and one cycle is replayed."""
    state = twin.TwinState(spark, scratch_path(spark, "cycles"))
    for b in (0, 1, 1, 2, 3):
        twin.cycle(state, b, _feed(spark, sf, b), lambda d: d, F.lit(f"2024-01-{min(8 * b + 8, 31)} 23:59:59").cast("timestamp"), f"cycle{b}")
    s = state.read("status", ["aoi_id", "cycle"])
    return s.select("aoi_id", "cycle", "reason", "new_scenes", "late_scenes", "known_scenes", "timeseries_rows")


# --- sources and sinks: written to the shared folder and read back ---

@query("series_files", f"WITH {p.OBS} SELECT scene_id, datetime, {s6('ve')} AS ve, {s6('wl')} AS wl FROM obs")
def series_files(spark, sf):
    path = scratch_path(spark, "series")
    o = p.obs(spark, sf).select(
        F.lit("r").alias("run_id"), F.col("scene_id").cast("string").alias("scene_id"), "datetime", F.col("transect_index").cast("int").alias("transect_id"),
        F.col("ve").alias("VE_distance_m"), F.col("wl").alias("WL_distance_m"), *[F.lit(None).cast("double").alias(c) for c in ("wl_lon", "wl_lat", "ve_lon", "ve_lat")],
    )
    tables.write_series(o, path, "csv")
    d = tables.read_series(spark, path, "csv")
    return d.select(F.col("scene_id").cast("bigint").alias("scene_id"), "datetime", r6("VE_distance_m").alias("ve"), r6("WL_distance_m").alias("wl"))


@query("geojson_round_trip", f"WITH {p.VERTICES} SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY seq) - 1 AS i, x, y FROM vertices QUALIFY count(*) OVER (PARTITION BY line_id) >= 2")
def geojson_round_trip(spark, sf):
    """Lines in pieces of bounded size, one feature a row."""
    path, size = scratch_path(spark, "geojson"), geometry.CHUNK_VERTICES
    l = geometry.lines_in_chunks(p.vertices(spark, sf), ["line_id"], F.shiftright("seq", 40), size)
    geojson_io.write_feature_lines(geojson_io.to_features(l, "line", ["line_id", "chunk"]), path)
    prop = lambda c: F.element_at("properties", c).cast("bigint")
    v = geojson_io.read_feature_lines(spark, path).select(prop("line_id").alias("line_id"), prop("chunk").alias("chunk"), F.posexplode("line").alias("k", "q"))
    i = F.col("chunk") * size + F.col("k") - F.when(F.col("chunk") > 0, 1).otherwise(0)
    return v.where("chunk = 0 or k > 0").select("line_id", i.cast("int").alias("i"), "q.x", "q.y")


@query("annotation_round_trip", f"WITH {p.VERTICES}, m AS (SELECT line_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM vertices GROUP BY 1 HAVING count(*) >= 2) SELECT line_id, n, {s6('sx')} AS sx, {s6('sy')} AS sy FROM m WHERE line_id % 3 <> 0")
def annotation_round_trip(spark, sf):
    """Every third document is cut short and must be skipped."""
    l = geometry.lines_of(p.vertices(spark, sf), ["line_id"]).withColumns({
        "image_path": F.concat(F.lit("img"), F.col("line_id").cast("string"), F.lit(".png")), "image_width": F.lit(64), "image_height": F.lit(20), "description": F.lit("d")
    })
    docs = geojson_io.to_annotations(l, ["line_id"]).withColumn("value", F.when(F.col("line_id") % 3 == 0, F.expr("left(value, length(value) - 9)")).otherwise(F.col("value")))
    s = geojson_io.label_lines(geojson_io.parse_annotations(docs, "value"), "ve")
    total = lambda f: F.aggregate("line", F.lit(0.0), lambda a, q: a + q[f])
    return s.select("line_id", F.size("line").alias("n"), r6(total("x")).alias("sx"), r6(total("y")).alias("sy"))


@query("pixel_files", f"WITH {p.PIXELS} SELECT scene_id, row, col, {s6('b04')} AS b04, {s6('b08')} AS b08 FROM pixels WHERE row >= 5 AND row < 15 AND col >= 10 AND col < 40")
def pixel_files(spark, sf):
    """Pixels written as Parquet; two bands of a window read back."""
    path = scratch_path(spark, "pixels")
    p.pixels(spark, sf).write.parquet(path)
    d = raster_io.read_pixels(spark, path, ["b04", "b08"], (5, 10, 15, 40))
    return d.select("scene_id", "row", "col", r6("b04").alias("b04"), r6("b08").alias("b08"))


@query("exploded_tiles", f"WITH raw AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id AS scene_id, label * 8 + i // 8 AS row, i % 8 AS col, {s6('v')} AS b02 FROM raw")
def exploded_tiles(spark, sf):
    e = p.table(spark, sf, "embeddings").select(F.col("vec_id").alias("scene_id"), (F.col("label") * 8).alias("row_off"), F.lit(0).alias("col_off"), F.lit(8).alias("tile_width"), F.col("embedding").alias("b02"))
    return raster_io.explode_tiles(e, ["b02"]).select("scene_id", "row", "col", r6("b02").alias("b02"))


FEATS = f"{p.SCENES}, ft AS (SELECT CASE WHEN aoi_id % 2 = 0 THEN 'aoi' ELSE 'baseline' END AS kind, 'f' || aoi_id || '_' || status AS name, datetime AS created, scene_id FROM scenes)"


def _features(spark, sf):
    s = p.scenes(spark, sf)
    return s.select(
        F.when(F.col("aoi_id") % 2 == 0, "aoi").otherwise("baseline").alias("kind"), F.concat(F.lit("f"), F.col("aoi_id").cast("string"), F.lit("_"), "status").alias("name"),
        F.col("datetime").alias("created"), "scene_id", F.col("scene_id").alias("_seq"),
    )


@query("feature_catalog", f"WITH {FEATS} SELECT name, arg_max(scene_id, scene_id) AS scene_id, arg_max(created, scene_id) AS created FROM ft WHERE kind = 'aoi' AND name <> 'f2_O' GROUP BY 1")
def feature_catalog(spark, sf):
    f = _features(spark, sf)
    saved = tables.save_features(f.limit(0), f)
    kept = tables.drop_features(cut(saved), "aoi", "f2_O")
    return tables.list_features(kept, "aoi").select("name", "scene_id", "created")


@query("scene_catalog_files", f"WITH {p.SCENES} SELECT aoi_id, count(*) AS n, CASE WHEN aoi_id < 12 THEN 'second' ELSE 'first' END AS search_mode FROM scenes WHERE aoi_id >= 12 OR status = 'F' GROUP BY ALL")
def scene_catalog_files(spark, sf):
    path = scratch_path(spark, "catalog")
    s = p.scenes(spark, sf)
    tables.save_scene_catalog(spark, s, path, "first")
    tables.save_scene_catalog(spark, s.filter("aoi_id < 12 AND status = 'F'"), path, "second")
    return spark.read.parquet(path).groupBy("aoi_id", "search_mode").agg(F.count("*").alias("n"))


@query("artifact_rows", "SELECT user_id % 10 AS run, count(*) AS n FROM events WHERE user_id % 10 = 3 GROUP BY 1")
def artifact_rows(spark, sf):
    root = scratch_path(spark, "artifacts")
    tables.save_artifact(p.obs(spark, sf).withColumn("run_id", F.concat(F.lit("run"), F.col("aoi_id").cast("string"))), root, "parquet", "timeseries")
    return tables.load_artifact(spark, root, "run3", "parquet", "timeseries").groupBy(F.col("aoi_id").alias("run")).agg(F.count("*").alias("n"))


@query("report_files", f"WITH {p.SCENES} SELECT scene_id, CASE WHEN status = 'F' THEN cloud_pct END AS cloud_pct, CASE WHEN status <> 'F' THEN collection END AS collection FROM scenes")
def report_files(spark, sf):
    path = scratch_path(spark, "report")
    s = p.scenes(spark, sf)
    tables.write_report([s.filter("status = 'F'").select("scene_id", "cloud_pct"), s.filter("status <> 'F'").select("scene_id", "collection")], path)
    return spark.read.schema("scene_id bigint, cloud_pct double, collection string").json(f"{path}/json")


@query("run_reports", "SELECT o_custkey AS run, count(*) AS scenes, any_value(n) AS predictions FROM orders LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = o_custkey GROUP BY 1")
def run_reports(spark, sf):
    s = p.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.count("*").alias("scenes"))
    pr = p.table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("n"))
    return tables.run_report(s, pr).select(F.col("run_id").alias("run"), "scenes", F.col("prediction.n").alias("predictions"))


@query("run_summary", f"""WITH {p.SCENES}, o AS (SELECT user_id % 10 AS aoi_id, count(*) AS rows_, count(*) FILTER (value > 10) AS v FROM events GROUP BY 1)
  SELECT aoi_id, count(*) AS scenes_total, count(*) FILTER (status <> 'P') AS scenes_real, count(*) FILTER (status = 'P') AS scenes_demo, count(*) FILTER (cloud_pct IS NULL) AS scenes_fallback, count(*) FILTER (cloud_pct > 95) AS n_errors,
  count(*) FILTER (price > 200000) AS model_lines, any_value(rows_) AS timeseries_rows, any_value(v) AS valid_rows FROM scenes LEFT JOIN o USING (aoi_id) GROUP BY aoi_id""")
def run_summary(spark, sf):
    s = p.scenes(spark, sf).withColumns({
        "is_demo": F.col("status") == "P", "search_fallback_demo": F.col("cloud_pct").isNull(), "download_error": F.when(F.col("cloud_pct") > 95, "http 500"),
        "method": F.when(F.col("price") > 200000, "model").otherwise("weighted_peaks"), "boundary": F.lit("WL"),
    })
    o = p.obs(spark, sf).select("aoi_id", "datetime", F.when(F.col("ve") > 10, F.col("ve")).alias("WL_distance_m"), F.lit(None).cast("double").alias("VE_distance_m"))
    r = extraction.run_summary(s, s, o)
    return r.select("aoi_id", "scenes_total", "scenes_real", "scenes_demo", "scenes_fallback", F.size("download_errors").alias("n_errors"), "model_lines", "timeseries_rows", "valid_rows")


# --- composed plans: their operators have queries with SQL where the inventory allows; the plans themselves are tested in tests/test_plans.py ---

@query("extracted_lines")
def extracted_lines(spark, sf):
    lines, level = extraction.extract_lines(p.pixels(spark, sf), scene_frames(spark, sf), min_patch=4)
    n = lines.groupBy("scene_id", "boundary").agg(F.count("*").alias("n_vertices"), r3(F.max("length")).alias("length"))
    return level.select("scene_id", "boundary", r6("threshold").alias("threshold"), "n_a", "n_b").join(n, ["scene_id", "boundary"], "left")


@query("extracted_series")
def extracted_series(spark, sf):
    frames = scene_frames(spark, sf).withColumn("position", F.col("scene_id")).withColumn("datetime", F.timestamp_seconds(F.col("scene_id") * 86400))
    lines, _, baseline = extraction.extract_run(p.pixels(spark, sf), frames, max_distance=60.0, min_patch=4)
    _, obs = extraction.observe(lines, baseline, frames, spacing=20.0, length=100.0)
    return obs.select("aoi_id", "scene_id", "transect_index", "datetime", r3("WL_distance_m").alias("wl"), r3("VE_distance_m").alias("ve"))


def _refs(spark, sf):
    """A line through the middle of the mosaic: manual for even AOIs, automatic for odd ones."""
    a = scene_frames(spark, sf).select("aoi_id").distinct().withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(8))))
    return a.select("aoi_id", F.col("seq").cast("long").alias("seq"), (500000.0 + F.col("seq") * 80).alias("x"), F.lit(5999900.0).alias("y"), F.when(F.col("aoi_id") % 2 == 0, "manual").otherwise("auto").alias("source"))


@query("guided_labels")
def guided_labels(spark, sf):
    _, report = labelling.label_edges(p.pixels(spark, sf), scene_frames(spark, sf), _refs(spark, sf), max_distance=60.0, min_patch=4, transect_spacing=20.0, transect_length=160.0, corridor=20.0, low=10, high=50)
    return report.select("scene_id", "status", "reason", r6("threshold").alias("threshold"), "how", "points")


@query("gradient_labels")
def gradient_labels(spark, sf):
    runs = scene_frames(spark, sf).select("aoi_id", F.col("scene_id").alias("run_id"), "scene_id", F.lit(0).alias("position"), (F.col("scene_id") * 10.0).alias("cloud_pct"))
    points, report, _ = labelling.label_by_gradient(runs, p.pixels(spark, sf))
    n = points.groupBy("scene_id").agg(F.count("*").alias("points"), r6(F.avg("y")).alias("mean_row"))
    return report.select("scene_id", "status", "reason").join(n, "scene_id", "left")


@query("scored_edges")
def scored_edges(spark, sf):
    """A stand-in model: a soft ridge around the row where near infrared is strongest."""
    px = p.pixels(spark, sf).fillna(0.0, ["b08"])
    targets = scene_frames(spark, sf).select("aoi_id", "scene_id")
    points, report = labelling.score_edges(targets, px, lambda d: d["b08"] / (1.0 + abs(d["row"] - d["side"] / 2)), ["b08"], threshold=0.2)
    return points.select("scene_id", "seq", r6("x").alias("x"), r6("y").alias("y")).join(report.select("scene_id", "orientation", "conf_frac", "interp_frac", "status"), "scene_id")


@query("user_scores", f"WITH {IDX} SELECT scene_id, row, col, {s6('b08 * 2 + b04')} AS score FROM idx WHERE b08 IS NOT NULL AND b04 IS NOT NULL")
def user_scores(spark, sf):
    d = p.pixels(spark, sf).dropna(subset=["b08", "b04"])
    return score_with(d, lambda b: b["b08"] * 2 + b["b04"], ["b08", "b04"]).select("scene_id", "row", "col", r6("score").alias("score"))


@query("twin_forecast")
def twin_forecast(spark, sf):
    """Shape forecast for even users' areas that have lines, distances for the rest."""
    o = p.obs(spark, sf)
    v = p.vertices(spark, sf).filter("aoi_id % 2 = 0")
    lines = v.select("aoi_id", F.timestamp_seconds(F.floor(F.shiftright("seq", p.SEQ_SHIFT) / 365) * 31536000 + 788918400).alias("datetime"), F.col("seq"), "x", "y")
    boxes = o.select("aoi_id").distinct().withColumn("bbox", F.array(F.lit(0.0), F.lit(0.0), F.lit(25000.0), F.lit(500.0)))
    t = o.select("aoi_id", "transect_index").distinct().withColumns({"x0": F.col("transect_index") * 20.0, "y0": F.lit(0.0), "x1": F.col("transect_index") * 20.0, "y1": F.lit(500.0)})
    out, _ = forecasting.predict(o, lines, boxes, t, 0.1, n_points=32)
    return out.select("aoi_id", "seq", r3("x").alias("x"), r3("y").alias("y"), "model_type")


@query("augmented_samples")
def augmented_samples(spark, sf):
    e = p.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    d = e.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).cast("int").alias("col"), F.lit(8).alias("side"), F.abs(F.col("v").cast("double")).alias("b"), (F.col("v") > 0.1).cast("double").alias("mask"))
    a = labels.augment(d, ["vec_id"], ["b"], 5)
    return a.select("vec_id", "row", "col", "side", r6("b").alias("b"), "mask")
