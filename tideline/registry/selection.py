"""Scene search, matching, de-duplication and other table choices."""

from pyspark.sql import functions as F

from tideline.operators import samples, selection
from tideline.registry import proxies as p
from tideline.registry import query, r6, s6

S = p.SCENES


@query("scene_search", f"""WITH {S}, f AS (SELECT aoi_id, scene_id, datetime, coalesce(cloud_pct, 100) AS cloud_pct FROM scenes WHERE datetime >= TIMESTAMP '1997-01-01' AND datetime < TIMESTAMP '1999-07-01')
  SELECT aoi_id, scene_id, datetime, cloud_pct, row_number() OVER (PARTITION BY aoi_id ORDER BY datetime DESC, scene_id) AS rank FROM f WHERE cloud_pct <= 60 QUALIFY rank <= 6""")
def scene_search(spark, sf):
    return selection.search_scenes(p.scenes(spark, sf), "1997-01-01", "1999-06-30", 60.0, 6).select("aoi_id", "scene_id", "datetime", "cloud_pct", "rank")


@query("requested_scenes", "SELECT l_orderkey AS scene_id, count(*) AS n, bool_or(o_orderkey IS NOT NULL) AS found FROM (SELECT l_orderkey * 2 AS l_orderkey FROM lineitem) LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def requested_scenes(spark, sf):
    """Every second id is asked for, up to twice the largest known one."""
    req = p.table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") * 2).alias("scene_id")).agg(F.count("*").alias("n")).withColumn("position", F.col("scene_id"))
    cat = p.table(spark, sf, "orders").select(F.col("o_orderkey").alias("scene_id"))
    found, missing = selection.resolve_scenes(req, cat)
    return found.select("scene_id", "n", F.lit(True).alias("found")).unionByName(missing.select("scene_id", "n", F.lit(False).alias("found")))


STATE = "state AS (SELECT DISTINCT aoi_id, scene_id FROM scenes JOIN lineitem ON l_orderkey = scene_id WHERE l_returnflag = 'R')"


def _state(spark, sf):
    li = p.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("scene_id"))
    return p.scenes(spark, sf).join(li, "scene_id").select("aoi_id", "scene_id").distinct()


@query("new_scenes", f"WITH {S}, {STATE} SELECT aoi_id, scene_id, datetime FROM scenes ANTI JOIN state USING (aoi_id, scene_id)")
def new_scenes(spark, sf):
    return selection.new_scenes(p.scenes(spark, sf), _state(spark, sf)).select("aoi_id", "scene_id", "datetime")


@query("pending_jobs", f"WITH {S}, {STATE} SELECT scene_id, CASE WHEN state.scene_id IS NULL THEN 'pending' ELSE 'skipped' END AS status FROM scenes LEFT JOIN state USING (aoi_id, scene_id)")
def pending_jobs(spark, sf):
    return selection.pending(p.scenes(spark, sf).drop("status"), _state(spark, sf), ["aoi_id", "scene_id"]).select("scene_id", "status")


@query("job_grid", """SELECT c_custkey AS aoi_id, strftime(m, '%Y-%m') AS month, strftime(greatest(m, TIMESTAMP '2016-01-15'), '%Y-%m-%d') AS window_start, strftime(least(last_day(m), DATE '2017-03-10'), '%Y-%m-%d') AS window_end
  FROM customer, (SELECT unnest(generate_series(TIMESTAMP '2016-01-01', TIMESTAMP '2017-03-01', INTERVAL 1 MONTH)) AS m) WHERE c_mktsegment = 'BUILDING'""")
def job_grid(spark, sf):
    a = p.table(spark, sf, "customer").select(F.col("c_custkey").alias("aoi_id"), F.col("c_mktsegment").alias("role"))
    g = selection.job_grid(a, "2016-01-15", "2017-03-10", "BUILDING")
    return g.select("aoi_id", "month", F.col("window_start").cast("string").alias("window_start"), F.col("window_end").cast("string").alias("window_end"))


@query("matched_files", f"""WITH {S}, img AS (SELECT 'a/' || scene_id || '.png' AS path FROM scenes WHERE status = 'F' UNION ALL SELECT 'b/' || scene_id || '.png' FROM scenes WHERE cloud_pct < 50)
  SELECT scene_id AS label_id, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NOT NULL THEN 0 WHEN b.path IS NOT NULL THEN 1 END AS priority FROM scenes LEFT JOIN img a ON a.path = 'a/' || scene_id || '.png' LEFT JOIN img b ON b.path = 'b/' || scene_id || '.png'""")
def matched_files(spark, sf):
    s = p.scenes(spark, sf)
    path = lambda d: F.concat(F.lit(d), F.col("scene_id").cast("string"), F.lit(".png"))
    img = s.filter("status = 'F'").select(path("a/").alias("path")).unionByName(s.filter("cloud_pct < 50").select(path("b/").alias("path")))
    lab = s.select(F.col("scene_id").alias("label_id"), path("a/").alias("one"), path("b/").alias("two"))
    return selection.match_files(lab, img, [F.col("one"), F.col("two")]).select("label_id", "path", "priority")


CAND = f"""{S}, sel AS (SELECT aoi_id, strftime(datetime, '%Y-%m') AS month, scene_id + CASE WHEN status = 'P' THEN 100000000 ELSE 0 END AS scene_id, scene_id AS position FROM scenes), cand AS (SELECT aoi_id, strftime(datetime, '%Y-%m') AS month, scene_id, datetime, cloud_pct FROM scenes)"""


@query("selected_scenes", f"WITH {CAND} SELECT position, cand.datetime, cand.cloud_pct, CASE WHEN cand.scene_id IS NULL THEN 'minimal' ELSE 'candidate' END AS record_source FROM sel LEFT JOIN cand USING (aoi_id, month, scene_id)")
def selected_scenes(spark, sf):
    s = p.scenes(spark, sf).withColumn("month", F.date_format("datetime", "yyyy-MM"))
    sel = s.select("aoi_id", "month", (F.col("scene_id") + F.when(F.col("status") == "P", 100000000).otherwise(0)).alias("scene_id"), F.col("scene_id").alias("position"))
    return selection.selected_scene(sel, s).select("position", "datetime", "cloud_pct", "record_source")


@query("least_cloud", f"""WITH {S}, req AS (SELECT aoi_id, scene_id AS request_id, datetime + INTERVAL 6 HOUR AS at_time FROM scenes)
  SELECT request_id, arg_min(s.scene_id, (coalesce(cloud_pct, 100), s.scene_id)) AS scene_id FROM req JOIN scenes s ON s.aoi_id = req.aoi_id AND s.datetime BETWEEN at_time - INTERVAL 12 HOUR AND at_time + INTERVAL 12 HOUR GROUP BY 1""")
def least_cloud(spark, sf):
    s = p.scenes(spark, sf)
    req = s.select("aoi_id", F.col("scene_id").alias("request_id"), (F.col("datetime") + F.expr("INTERVAL 6 HOURS")).alias("at"))
    return selection.least_cloud(s, req).select("request_id", "scene_id")


@query("best_observation", f"WITH {p.OBS} SELECT transect_index, arg_max(scene_id, (ve, scene_id)) AS longest, arg_max(scene_id, (datetime, scene_id)) AS latest FROM obs GROUP BY 1")
def best_observation(spark, sf):
    o = p.obs(spark, sf).select("transect_index", "scene_id", "ve", "datetime")
    long = selection.best_per_key(o, ["transect_index"], [F.col("ve"), F.col("scene_id")]).select("transect_index", F.col("scene_id").alias("longest"))
    last = selection.best_per_key(o, ["transect_index"], [F.col("datetime"), F.col("scene_id")]).select("transect_index", F.col("scene_id").alias("latest"))
    return long.join(last, "transect_index")


@query("newest_sources", "SELECT o_custkey, arg_max(o_orderkey, (o_orderstatus = 'F', o_orderdate, o_orderkey)) AS file_id FROM orders GROUP BY 1")
def newest_sources(spark, sf):
    f = p.table(spark, sf, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("is_raw"), F.col("o_orderdate").alias("modified"), F.col("o_orderkey").alias("path"))
    return selection.newest_source(f, ["o_custkey"]).select("o_custkey", F.col("path").alias("file_id"))


RUNS = "runs AS (SELECT o_orderkey AS run_no, CASE WHEN o_orderkey % 3 <> 0 THEN 'aoi' || o_custkey END AS aoi_id, 'aoi' || o_custkey || '_' || o_orderkey AS run_id, o_orderdate AS generated_at, o_orderstatus <> 'P' AS has_series, o_totalprice > 100000 AS has_lines FROM orders), aois AS (SELECT 'aoi' || c_custkey AS aoi_id FROM customer)"


@query("latest_runs", f"WITH {RUNS}, m AS (SELECT aois.aoi_id, run_id, generated_at FROM runs JOIN aois ON runs.aoi_id = aois.aoi_id OR (runs.aoi_id IS NULL AND starts_with(run_id, aois.aoi_id || '_')) WHERE has_series AND has_lines) SELECT aoi_id, arg_max(run_id, (generated_at, run_id)) AS run_id FROM m GROUP BY 1")
def latest_runs(spark, sf):
    o = p.table(spark, sf, "orders")
    name = F.concat(F.lit("aoi"), F.col("o_custkey").cast("string"))
    runs = o.select(
        F.when(F.col("o_orderkey") % 3 != 0, name).alias("aoi_id"), F.concat(name, F.lit("_"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_orderdate").alias("generated_at"), (F.col("o_orderstatus") != "P").alias("has_series"), (F.col("o_totalprice") > 100000).alias("has_lines"),
    )
    aois = p.table(spark, sf, "customer").select(F.concat(F.lit("aoi"), F.col("c_custkey").cast("string")).alias("aoi_id"))
    return selection.latest_run(runs, aois, ["has_series", "has_lines"]).select("aoi_id", "run_id")


@query("waterline_history", """WITH l AS (SELECT CASE WHEN o_orderkey % 4 <> 0 THEN 'n' || c_nationkey || 'x' END AS aoi_id, 'run_' || CASE WHEN o_orderkey % 8 = 0 THEN 'N' ELSE 'n' END || c_nationkey || 'x_' || o_orderkey AS run_id, o_orderdate AS datetime, floor(o_totalprice) - 100000 AS length FROM orders JOIN customer ON c_custkey = o_custkey),
  a AS (SELECT DISTINCT 'n' || n_nationkey || 'x' AS aoi_id, n_nationkey FROM nation), m AS (SELECT coalesce(l.aoi_id, a.aoi_id) AS aoi_id, run_id, datetime, length FROM l JOIN a ON a.aoi_id = l.aoi_id OR (l.aoi_id IS NULL AND contains(run_id, a.aoi_id)) WHERE length > 0 AND datetime >= TIMESTAMP '2001-01-01' - INTERVAL 730 DAY
    UNION ALL SELECT aoi_id, NULL, CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '1996-05-05' ELSE TIMESTAMP '2001-01-01' END, n_nationkey + 1.0 FROM a)
  SELECT aoi_id, datetime, max(length) AS length FROM m GROUP BY ALL""")
def waterline_history(spark, sf):
    o, c = p.table(spark, sf, "orders"), p.table(spark, sf, "customer")
    n = F.col("c_nationkey").cast("string")
    lines = o.join(c, o.o_custkey == c.c_custkey).select(
        F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("n"), n, F.lit("x"))).alias("aoi_id"), F.concat(F.lit("run_"), F.when(F.col("o_orderkey") % 8 == 0, "N").otherwise("n"), n, F.lit("x_"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_orderdate").cast("timestamp").alias("datetime"), (F.floor("o_totalprice") - 100000).cast("double").alias("length"),
    )
    k = F.col("n_nationkey")
    latest = p.table(spark, sf, "nation").select(
        F.concat(F.lit("n"), k.cast("string"), F.lit("x")).alias("aoi_id"), F.when(k % 2 == 0, F.lit("1996-05-05").cast("timestamp")).alias("datetime"), (k + 1.0).alias("length")
    )
    return selection.waterline_history(lines, latest, 730, F.lit("2001-01-01").cast("timestamp")).select("aoi_id", "datetime", "length")


@query("target_images", f"WITH {S} SELECT scene_id FROM scenes WHERE CAST(scene_id AS VARCHAR) SIMILAR TO '.*[13579]' AND year(datetime) BETWEEN 1996 AND 1999 AND aoi_id NOT IN (7) AND aoi_id IN (5, 6, 7, 8)")
def target_images(spark, sf):
    s = p.scenes(spark, sf).withColumns({"name": F.col("scene_id").cast("string"), "year": F.year("datetime"), "aoi": F.col("aoi_id").cast("string")})
    return selection.select_targets(s, "name", r"[13579]$", (1996, 1999), ["5", "6", "7", "8"], ["7"]).select("scene_id")


@query("upserted_series", """WITH old AS (SELECT l_orderkey AS scene_id, l_suppkey AS transect_index, l_quantity AS v, 0 AS batch, l_linenumber AS s, l_partkey AS pk FROM lineitem), new AS (SELECT l_orderkey, l_suppkey, l_tax, 1, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'A')
  SELECT scene_id, transect_index, v FROM (SELECT * FROM old UNION ALL SELECT * FROM new) QUALIFY row_number() OVER (PARTITION BY scene_id, transect_index ORDER BY batch DESC, s DESC, v DESC, pk DESC) = 1""")
def upserted_series(spark, sf):
    li = p.table(spark, sf, "lineitem")
    cols = [F.col("l_orderkey").alias("scene_id"), F.col("l_suppkey").alias("transect_index"), F.col("l_linenumber").cast("long").alias("_seq")]
    old = li.select(*cols, F.col("l_quantity").cast("double").alias("v"))
    new = li.filter("l_returnflag = 'A'").select(*cols, F.col("l_tax").cast("double").alias("v"))
    return selection.upsert(old, new, ["scene_id", "transect_index"])


@query("first_wins", """WITH old AS (SELECT l_orderkey AS k, min(l_suppkey) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), new AS (SELECT l_orderkey AS k, min(l_partkey) AS v FROM lineitem GROUP BY 1) SELECT k, v FROM old UNION ALL SELECT k, v FROM new ANTI JOIN old USING (k)""")
def first_wins(spark, sf):
    li = p.table(spark, sf, "lineitem")
    old = li.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_suppkey").alias("v"))
    return selection.insert_if_absent(old, li.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("v")), ["k"])


@query("valid_observations", f"WITH {p.OBS}, n AS (SELECT scene_id, CASE WHEN ve > 20 THEN ve END AS ve, CASE WHEN wl > 50 THEN wl END AS wl FROM obs) SELECT scene_id, ve IS NOT NULL AND wl IS NOT NULL AS complete FROM n WHERE ve IS NOT NULL OR wl IS NOT NULL")
def valid_observations(spark, sf):
    o = p.obs(spark, sf).withColumns({"ve": F.when(F.col("ve") > 20, F.col("ve")), "wl": F.when(F.col("wl") > 50, F.col("wl"))})
    some = selection.valid_rows(o, "all", ["ve", "wl"]).select("scene_id")
    full = selection.valid_rows(o, "any", ["ve", "wl"]).select("scene_id", F.lit(True).alias("_f"))
    return some.join(full, "scene_id", "left").select("scene_id", F.coalesce("_f", F.lit(False)).alias("complete"))


@query("distinct_transects", "SELECT DISTINCT user_id AS transect_index FROM events")
def distinct_transects(spark, sf):
    return selection.distinct_ids(p.obs(spark, sf), "transect_index")


MONTH = f"""{S}, cur AS (SELECT aoi_id, strftime(datetime, '%Y-%m') AS month, min(scene_id) AS scene_id FROM scenes GROUP BY ALL), sel AS (SELECT aoi_id, CASE WHEN scene_id % 5 = 0 THEN 'bad' WHEN scene_id % 7 = 0 THEN '2031-01' ELSE strftime(datetime, '%Y-%m') END AS month, scene_id AS position, 'new' || scene_id AS new_scene_id FROM scenes WHERE status = 'F'),
  aud AS (SELECT sel.*, CASE WHEN sel.month = 'bad' THEN 'invalid' WHEN cur.scene_id IS NULL THEN 'error' ELSE 'replaced' END AS status FROM sel LEFT JOIN cur USING (aoi_id, month))"""


def _selection(spark, sf):
    s = p.scenes(spark, sf).withColumn("month", F.date_format("datetime", "yyyy-MM"))
    cur = s.groupBy("aoi_id", "month").agg(F.min("scene_id").cast("string").alias("scene_id"))
    month = F.when(F.col("scene_id") % 5 == 0, "bad").when(F.col("scene_id") % 7 == 0, "2031-01").otherwise(F.col("month"))
    sel = s.filter("status = 'F'").select("aoi_id", month.alias("month"), F.col("scene_id").alias("position"), F.concat(F.lit("new"), F.col("scene_id").cast("string")).alias("new_scene_id"))
    return selection.apply_selection(cur, sel)


@query("replaced_scenes", f"WITH {MONTH}, w AS (SELECT aoi_id, month, arg_max(new_scene_id, position) AS n FROM aud WHERE status = 'replaced' GROUP BY ALL) SELECT aoi_id, month, coalesce(n, CAST(scene_id AS VARCHAR)) AS scene_id FROM cur LEFT JOIN w USING (aoi_id, month)")
def replaced_scenes(spark, sf):
    return _selection(spark, sf)[0]


@query("replacement_audit", f"WITH {MONTH} SELECT position, status FROM aud")
def replacement_audit(spark, sf):
    return _selection(spark, sf)[2].select("position", "status")


@query("forecast_view", f"WITH {p.OBS}, f AS (SELECT aoi_id, scene_id, CAST(datetime AS DATE) AS d, CASE WHEN kind = 'view' AND aoi_id < 8 THEN 'Waterline_forecast' ELSE kind END AS b FROM obs), v AS (SELECT *, bool_or(contains(lower(b), 'waterline')) OVER (PARTITION BY aoi_id) AS any_wl FROM f) "
       "SELECT aoi_id, strftime(min(d), '%Y-%m-%d') AS first_date, strftime(max(d), '%Y-%m-%d') AS last_date, count(*) AS n_features FROM v WHERE (NOT any_wl OR contains(lower(b), 'waterline')) AND d BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1")
def forecast_view(spark, sf):
    b = F.when((F.col("kind") == "view") & (F.col("aoi_id") < 8), "Waterline_forecast").otherwise(F.col("kind"))
    f = p.obs(spark, sf).select("aoi_id", "scene_id", F.to_date("datetime").alias("date"), b.alias("boundary_type"))
    v = selection.view_range(selection.forecast_view(f, "2024-01-05", "2024-01-20"))
    return v.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@query("forecast_vertices", f"WITH {p.OBS} SELECT scene_id, 0 AS point_index, ve - 100 AS lon, wl AS lat, 'step ' || transect_index AS label FROM obs WHERE ve - 100 BETWEEN -180 AND 180 AND wl BETWEEN -90 AND 90 UNION ALL SELECT scene_id, 1, wl, wl - 50, 'step ' || transect_index FROM obs WHERE wl BETWEEN -180 AND 180 AND wl - 50 BETWEEN -90 AND 90")
def forecast_vertices(spark, sf):
    from tideline.functions import lines

    o = p.obs(spark, sf).withColumn("line", F.array(lines.point(F.col("ve") - 100, F.col("wl")), lines.point(F.col("wl"), F.col("wl") - 50))).withColumn("step", F.col("transect_index"))
    return selection.forecast_points(o).select("scene_id", "point_index", "lon", "lat", "label")


REFS = f"{S}, ref AS (SELECT aoi_id, scene_id, CASE WHEN status = 'P' AND aoi_id % 2 = 0 THEN 'manual' ELSE 'auto' END AS source, scene_id AS position, CASE WHEN collection LIKE '1%' AND aoi_id % 3 = 0 THEN 'WL' ELSE 'VE' END AS boundary FROM scenes)"


@query("reference_choice", f"WITH {REFS} SELECT aoi_id, arg_min(scene_id, (source <> 'manual', position)) AS reference, arg_min(scene_id, (boundary <> 'WL', position)) AS baseline FROM ref GROUP BY 1")
def reference_choice(spark, sf):
    s = p.scenes(spark, sf)
    r = s.select(
        "aoi_id", "scene_id", F.when((F.col("status") == "P") & (F.col("aoi_id") % 2 == 0), "manual").otherwise("auto").alias("source"), F.col("scene_id").alias("position"),
        F.when(F.col("collection").startswith("1") & (F.col("aoi_id") % 3 == 0), "WL").otherwise("VE").alias("boundary"),
    )
    a = selection.reference_lines(r).select("aoi_id", F.col("scene_id").alias("reference"))
    return a.join(selection.pick_baseline(r).select("aoi_id", F.col("scene_id").alias("baseline")), "aoi_id")


@query("scene_methods", f"WITH {S} SELECT scene_id, CASE WHEN status = 'F' THEN price WHEN cloud_pct IS NOT NULL THEN cloud_pct END AS line, CASE WHEN status = 'F' THEN 'model' WHEN cloud_pct IS NOT NULL THEN 'weighted_peaks' ELSE 'none' END AS method FROM scenes")
def scene_methods(spark, sf):
    s = p.scenes(spark, sf).withColumn("a", F.when(F.col("status") == "F", F.col("price"))).withColumn("b", F.col("cloud_pct"))
    return selection.line_method(s, "a", "b").select("scene_id", "line", "method")
