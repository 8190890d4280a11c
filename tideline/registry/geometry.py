"""Lines, transects and their intersections."""

from pyspark.sql import functions as F

from tideline.functions import geo, lines
from tideline.operators import geometry, spatial
from tideline.registry import proxies as p
from tideline.registry import query, r3, r6, s3, s6
from tideline.registry.scalar import PLACES, places

KEYS = ["aoi_id", "line_id"]


def segs(spark, sf):
    return geometry.measured_segments(p.vertices(spark, sf), KEYS, p.vertex_chunk())


@query("line_segments", f"WITH {p.MEASURED} SELECT line_id, seq, {s6('cum0')} AS cum0, {s6('cum1')} AS cum1, {s6('total')} AS total, x1, y1 FROM segs")
def line_segments(spark, sf):
    return segs(spark, sf).select("line_id", "seq", r6("cum0").alias("cum0"), r6("cum1").alias("cum1"), r6("total").alias("total"), "x1", "y1")


@query("line_lengths", f"WITH {p.VERTICES}, d AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM vertices WINDOW w AS (PARTITION BY line_id ORDER BY seq)) "
       f"SELECT line_id, {s6('coalesce(sum(d), 0)')} AS length, count(*) AS n_vertices FROM d GROUP BY 1")
def line_lengths(spark, sf):
    return geometry.line_lengths(p.vertices(spark, sf), KEYS, p.vertex_chunk()).select("line_id", r6("length").alias("length"), "n_vertices")


@query("distance_samples", f"""WITH {p.MEASURED}, t AS (SELECT line_id, max(total) AS total FROM segs GROUP BY 1), k AS (SELECT *, unnest(generate_series(0, CAST(ceil(total / 250) AS BIGINT))) AS k FROM t)
  SELECT line_id, k, {s6('CASE WHEN k = ceil(total / 250) THEN total ELSE k * 250.0 END')} AS d FROM k""")
def distance_samples(spark, sf):
    t = segs(spark, sf).groupBy("line_id").agg(F.max("total").alias("total"))
    return geometry.sample_distances(t, "total", 250.0).select("line_id", "k", r6("d").alias("d"))


def _lookup(name: str, base: str, pos: str) -> str:
    """CTE ``name``: the point of each line at position ``pos`` for the rows of ``base``."""
    return f"""{name} AS (SELECT q.line_id, q.k, first(s.x0 + ({pos} - s.cum0) / (s.cum1 - s.cum0) * (s.x1 - s.x0) ORDER BY s.cum0 DESC) AS x,
  first(s.y0 + ({pos} - s.cum0) / (s.cum1 - s.cum0) * (s.y1 - s.y0) ORDER BY s.cum0 DESC) AS y
  FROM {base} q JOIN segs s ON s.line_id = q.line_id AND {pos} >= s.cum0 AND ({pos} < s.cum1 OR ({pos} = s.cum1 AND s.cum1 = s.total)) GROUP BY ALL)"""


def _transect_sql(half: str) -> str:
    return f"""WITH {p.MEASURED}, t AS (SELECT aoi_id, line_id, max(total) AS total FROM segs GROUP BY ALL),
  k0 AS (SELECT *, unnest(generate_series(0, CAST(ceil(total / 1000) AS BIGINT))) AS k FROM t),
  k AS (SELECT *, CASE WHEN k = ceil(total / 1000) THEN total ELSE k * 1000.0 END AS d, {half} AS half FROM k0),
  {_lookup('c', 'k', 'q.d')}, {_lookup('a', 'k', 'greatest(q.d - q.half, 0)')}, {_lookup('b', 'k', 'least(q.d + q.half, q.total)')},
  n AS (SELECT k.aoi_id, line_id, k, k.d, c.x, c.y, b.x - a.x AS dx, b.y - a.y AS dy, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS norm FROM k JOIN c USING (line_id, k) JOIN a USING (line_id, k) JOIN b USING (line_id, k)),
  u AS (SELECT *, CASE WHEN norm = 0 THEN 0 ELSE -dy / norm END AS nx, CASE WHEN norm = 0 THEN 1 ELSE dx / norm END AS ny FROM n)"""


OUT = f""" SELECT line_id, k AS transect_index, {s6('x - nx * 150')} AS x0, {s6('y - ny * 150')} AS y0, {s6('x + nx * 350')} AS x1, {s6('y + ny * 350')} AS y1 FROM u"""


@query("transects_metric", _transect_sql("1.0") + OUT)
def transects_metric(spark, sf):
    t = geometry.generate_transects(p.vertices(spark, sf), KEYS, 1000.0, 500.0, 0.7, "metre", p.vertex_chunk())
    return t.select("line_id", "transect_index", *[r6(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("transects_baseline", _transect_sql("greatest(10, total * 0.01)") + OUT.replace(" SELECT line_id,", " SELECT line_id, 'T' || lpad(CAST(k + 1 AS VARCHAR), 3, '0') AS transect_label, 350.0 AS offshore_length_m,"))
def transects_baseline(spark, sf):
    t = geometry.baseline_transects(p.vertices(spark, sf), KEYS, 1000.0, 500.0, 0.7, p.vertex_chunk())
    return t.select("line_id", "transect_index", "transect_label", F.round("offshore_length_m", 6).alias("offshore_length_m"), *[r6(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("transects_degrees", f"""WITH {p.MEASURED}, t AS (SELECT line_id, max(total) AS total, CAST(floor(max(total) / (200000000.0 / 111320)) AS BIGINT) AS n FROM segs GROUP BY ALL),
  k0 AS (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM t WHERE n >= 1),
  k AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN k = n - 1 THEN total ELSE k * (total / (n - 1)) END AS d, total * 0.01 AS half FROM k0),
  {_lookup('c', 'k', 'q.d')}, {_lookup('a', 'k', 'greatest(q.d - q.half, 0)')}, {_lookup('b', 'k', 'least(q.d + q.half, q.total)')},
  u AS (SELECT line_id, k, c.x, c.y, -(b.y - a.y) / sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS nx, (b.x - a.x) / sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS ny
    FROM k JOIN c USING (line_id, k) JOIN a USING (line_id, k) JOIN b USING (line_id, k))
  SELECT line_id, k AS transect_index, {s3('x - nx * (500.0 / 111320 * 0.3)')} AS x0, {s3('y + ny * (500.0 / 111320 * 0.7)')} AS y1 FROM u""")
def transects_degrees(spark, sf):
    t = geometry.transects_degrees(p.vertices(spark, sf), KEYS, 200000000.0, 500.0, 0.7, p.vertex_chunk())
    return t.select("line_id", "transect_index", r3("x0").alias("x0"), r3("y1").alias("y1"))


@query("resampled_lines", f"""WITH {p.MEASURED}, t AS (SELECT line_id, max(total) AS total FROM segs GROUP BY ALL), k0 AS (SELECT *, unnest(generate_series(0, 15)) AS k FROM t),
  k AS (SELECT *, CASE WHEN k = 15 THEN total ELSE k * (total / 15) END AS d FROM k0), {_lookup('c', 'k', 'q.d')} SELECT line_id, k AS seq, {s6('x')} AS x, {s6('y')} AS y FROM c""")
def resampled_lines(spark, sf):
    r = geometry.resample(p.vertices(spark, sf), KEYS, 16, p.vertex_chunk())
    return r.select("line_id", "seq", r6("x").alias("x"), r6("y").alias("y"))


# the same lines with x folded back, so that sorting left to right changes the order
@query("sorted_vertices", f"""WITH {p.VERTICES} SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY x % 977, seq) - 1 AS seq, x % 977 AS x, y FROM vertices""")
def sorted_vertices(spark, sf):
    v = p.vertices(spark, sf).withColumn("x", F.col("x") % 977)
    return geometry.sort_left_to_right(v, KEYS, 64.0).select("line_id", "seq", "x", "y")


# short lines as arrays: a customer's first-quarter orders are few by construction of the array functions' tests,
# here every customer's orders of one month make one short line
MONTH_LINES = f"""WITH {p.VERTICES}, m AS (SELECT *, (seq >> 40) // 120 AS part FROM vertices), l AS (SELECT line_id, part, list(x ORDER BY seq) AS xs, list(y ORDER BY seq) AS ys, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 2)"""


def month_lines(spark, sf):
    v = p.vertices(spark, sf).withColumn("part", F.floor(F.shiftright("seq", p.SEQ_SHIFT) / 120))
    return geometry.lines_of(v, ["line_id", "part"]).filter(F.size("line") >= 2)


@query("short_line_shapes", MONTH_LINES + f""", e AS (SELECT line_id, part, xs, ys, unnest(generate_series(1, n - 1)) AS i FROM l),
  d AS (SELECT *, sqrt(pow(xs[i + 1] - xs[i], 2) + pow(ys[i + 1] - ys[i], 2)) AS d FROM e),
  c AS (SELECT line_id, part, sum(d) AS length, sum(d * (xs[i] + xs[i + 1]) / 2) / sum(d) AS cx, sum(d * (ys[i] + ys[i + 1]) / 2) / sum(d) AS cy FROM d GROUP BY ALL)
  SELECT line_id, part, {s6('length')} AS length, {s6('cx')} AS cx, {s6('cy')} AS cy, list_min(xs) AS west, list_max(xs) AS east, list_min(ys) AS south, list_max(ys) AS north, n AS n_vertices FROM l JOIN c USING (line_id, part)""")
def short_line_shapes(spark, sf):
    m = month_lines(spark, sf).withColumn("b", lines.envelope("line")).withColumn("c", lines.line_centroid("line"))
    return m.select(
        "line_id", "part", r6(lines.line_length("line")).alias("length"), r6("c.x").alias("cx"), r6("c.y").alias("cy"),
        F.col("b")[0].alias("west"), F.col("b")[2].alias("east"), F.col("b")[1].alias("south"), F.col("b")[3].alias("north"), F.size("line").alias("n_vertices"),
    )


@query("points_on_lines", MONTH_LINES + f""", e AS (SELECT line_id, part, xs, ys, n, unnest(generate_series(1, n - 1)) AS i FROM l),
  d AS (SELECT *, sqrt(pow(xs[i + 1] - xs[i], 2) + pow(ys[i + 1] - ys[i], 2)) AS d FROM e),
  c AS (SELECT *, sum(d) OVER (PARTITION BY line_id, part ORDER BY i) - d AS c0, sum(d) OVER (PARTITION BY line_id, part) AS total FROM d),
  h AS (SELECT *, (0.4 * total - c0) / d AS r FROM c WHERE d > 0),
  p AS (SELECT line_id, part, first(xs[i] + r * (xs[i + 1] - xs[i]) ORDER BY i) AS px, first(ys[i] + r * (ys[i + 1] - ys[i]) ORDER BY i) AS py FROM h WHERE r >= 0 AND r <= 1 GROUP BY ALL)
  SELECT line_id, part, {s6('px')} AS x, {s6('py')} AS y, {s6('0.4 * c.total')} AS along FROM p JOIN (SELECT DISTINCT line_id, part, total FROM c) c USING (line_id, part)""")
def points_on_lines(spark, sf):
    m = month_lines(spark, sf).withColumn("at", lines.interpolate("line", F.lit(0.4), normalized=True))
    return m.select("line_id", "part", r6("at.x").alias("x"), r6("at.y").alias("y"), r6(lines.project_on("line", F.col("at"))).alias("along"))


@query("flipped_vertices", f"WITH {p.VERTICES}, d AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM vertices WINDOW w AS (PARTITION BY line_id, (seq >> 40) // 120 ORDER BY seq)) "
       "SELECT line_id, (seq >> 40) // 120 AS part, y AS lon, x AS lat FROM d WHERE px IS NULL OR abs(x - px) + abs(y - py) > 1e-6")
def flipped_vertices(spark, sf):
    v = p.vertices(spark, sf).withColumn("part", F.floor(F.shiftright("seq", p.SEQ_SHIFT) / 120))
    m = geometry.lines_of(v, ["line_id", "part"]).withColumn("line", lines.dedupe_consecutive("line"))
    flipped = lines.flip_latlng(F.transform("line", lambda q: F.array(q["x"], q["y"])))
    return m.select("line_id", "part", F.explode(flipped).alias("q")).select("line_id", "part", F.col("q.x").alias("lon"), F.col("q.y").alias("lat"))


@query("target_counts", MONTH_LINES + """, e AS (SELECT line_id, part, xs, ys, n, unnest(generate_series(1, n - 1)) AS i FROM l),
  d AS (SELECT line_id, part, any_value(n) AS n, sum(sqrt(pow(xs[i + 1] - xs[i], 2) + pow(ys[i + 1] - ys[i], 2))) AS length FROM e GROUP BY ALL)
  SELECT line_id, part, CASE WHEN n < 3 THEN 3 ELSE least(greatest(CAST(round_even(length * 0.03, 0) AS BIGINT), 12), 40) END AS points FROM d""")
def target_counts(spark, sf):
    m = month_lines(spark, sf)
    return m.select("line_id", "part", lines.target_points(lines.line_length("line"), F.size("line"), 0, 12, 40, 3.0).alias("points"))


# a diamond around every customer's place; every seventh is a bow-tie, every eleventh has two vertices
def _aois(spark, sf):
    d = places(spark, sf)
    k, lat, lon = F.col("c_custkey"), F.col("lat"), F.col("lon")
    size = F.when(k % 13 == 0, 0.0001).otherwise(0.01)
    v = lambda a, b: F.array(lat + a * size, lon + b * size)
    ring = F.array(v(1, 0), v(0, 1), v(-1, 0), v(0, -1))
    # an uneven bow-tie: it crosses itself and yet has an area
    bow = F.array(v(0, 0), v(1, 1), v(0, 1), v(0.5, 0))
    return d.select("c_custkey", F.when(k % 11 == 0, F.slice(ring, 1, 2)).when(k % 7 == 0, bow).otherwise(ring).alias("vertices"))


@query("area_validation", f"""WITH {PLACES} SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'too_few_vertices'
  WHEN lon + CASE WHEN c_custkey % 13 = 0 THEN 0.0001 ELSE 0.01 END > 180 OR lat + CASE WHEN c_custkey % 13 = 0 THEN 0.0001 ELSE 0.01 END > 90 THEN 'out_of_range'
  WHEN c_custkey % 7 = 0 THEN 'self_intersection' WHEN c_custkey % 13 = 0 THEN 'too_small' END AS reason FROM places""")
def area_validation(spark, sf):
    return geometry.validate_aoi(_aois(spark, sf), "c_custkey").select("c_custkey", "reason")


@query("area_records", f"""WITH {PLACES}, a AS (SELECT *, CASE WHEN c_custkey % 13 = 0 THEN 0.0001 ELSE 0.01 END AS s FROM places WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND lon + 0.01 <= 180 AND lat + 0.01 <= 90)
  SELECT c_custkey, 'Area_' || c_custkey || '_20240131_120000' AS aoi_id, 4 AS vertex_count, {s6('lon - s')} AS west, {s6('lat + s')} AS north, {s6('lon')} AS cx, {s6('lat')} AS cy,
  CASE WHEN floor(lat * 1e6 + 0.5) >= 0 THEN 32600 ELSE 32700 END + least(greatest(CAST(floor((lon + 180.0) / 6.0) AS BIGINT) + 1, 1), 60) AS utm_epsg FROM a""")
def area_records(spark, sf):
    ok = geometry.validate_aoi(_aois(spark, sf), "c_custkey").filter("reason IS NULL").drop("utm_epsg")
    ok = ok.withColumn("name", F.concat(F.lit(" Area  "), F.col("c_custkey").cast("string")))
    rec = geometry.make_feature(ok, "ring", "name", F.lit("2024-01-31 12:00:00").cast("timestamp"), "aoi", True)
    return rec.select("c_custkey", "aoi_id", "vertex_count", r6(F.col("bbox_wgs84")[0]).alias("west"), r6(F.col("bbox_wgs84")[3]).alias("north"), r6("centroid.x").alias("cx"), r6("centroid.y").alias("cy"), "utm_epsg")


@query("baseline_validation", f"""WITH {PLACES} SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'too_few_vertices' WHEN lon > 180 OR (c_custkey % 3 <> 0 AND lat + 20 > 90) THEN 'out_of_range' WHEN c_custkey % 3 = 0 THEN 'zero_length' END AS reason FROM places""")
def baseline_validation(spark, sf):
    d, k = places(spark, sf), F.col("c_custkey")
    a = F.array("lat", "lon")
    far = F.array(F.when(k % 3 == 0, F.col("lat")).otherwise(F.col("lat") + 20), F.col("lon"))
    v = d.withColumn("vertices", F.when(k % 5 == 0, F.array(a)).otherwise(F.array(a, far)))
    return geometry.validate_baseline(v).select("c_custkey", "reason")


# --- intersections: vertical transects of an AOI across the lines of its customers ---

TRANSECTS = """transects AS (SELECT unnest(generate_series(0, 9)) AS aoi_id), tr AS (SELECT aoi_id, unnest(generate_series(0, 48)) AS transect_index FROM transects),
  tx AS (SELECT aoi_id, transect_index, transect_index * 500.0 + 3 AS tx0, 0.0 AS ty0, transect_index * 500.0 + 3.0 + aoi_id AS tx1, 500.0 AS ty1 FROM tr)"""

HITS = """hits AS (SELECT s.aoi_id, s.line_id, t.transect_index, tx0, ty0, tx1, ty1,
  (tx1 - tx0) * (y1 - y0) - (ty1 - ty0) * (x1 - x0) AS cr, ((x0 - tx0) * (y1 - y0) - (y0 - ty0) * (x1 - x0)) AS tn, ((x0 - tx0) * (ty1 - ty0) - (y0 - ty0) * (tx1 - tx0)) AS un
  FROM segs s JOIN tx t ON t.aoi_id = s.aoi_id AND least(x0, x1) <= greatest(tx0, tx1) AND greatest(x0, x1) >= least(tx0, tx1)),
  met AS (SELECT *, tn / cr AS t FROM hits WHERE cr <> 0 AND tn / cr BETWEEN 0 AND 1 AND un / cr BETWEEN 0 AND 1),
  near AS (SELECT aoi_id, line_id, transect_index, min_by(t, abs(t - 0.5)) AS t, any_value(tx0) AS tx0, any_value(tx1) AS tx1, sqrt(pow(any_value(tx1 - tx0), 2) + 250000) AS len FROM met GROUP BY ALL)"""


def transects(spark, sf):
    """49 slanted transects for each AOI met in the orders."""
    a = p.table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("aoi_id")).distinct()
    t = a.withColumn("transect_index", F.explode(F.sequence(F.lit(0), F.lit(48))))
    x = F.col("transect_index") * 500.0 + 3
    return t.select("aoi_id", "transect_index", x.alias("x0"), F.lit(0.0).alias("y0"), (x + F.col("aoi_id")).alias("x1"), F.lit(500.0).alias("y1"))


def line_segs(spark, sf):
    return geometry.segments(p.vertices(spark, sf), KEYS, p.vertex_chunk())


@query("transect_intersections", f"""WITH {p.MEASURED}, {TRANSECTS}, {HITS} SELECT line_id, transect_index, {s6('t * len')} AS distance_from_start, {s6('t * len - len / 2')} AS distance_signed, {s6('tx0 + t * (tx1 - tx0)')} AS x, {s6('t * 500')} AS y FROM near""")
def transect_intersections(spark, sf):
    h = spatial.intersect(transects(spark, sf), line_segs(spark, sf), ["line_id"])
    return h.select("line_id", "transect_index", r6("distance_from_start").alias("distance_from_start"), r6("distance_signed").alias("distance_signed"), r6("x").alias("x"), r6("y").alias("y"))


@query("observation_grid", f"""WITH {p.MEASURED}, {TRANSECTS}, {HITS}, ln AS (SELECT DISTINCT aoi_id, line_id // 20 AS scene_id FROM vertices), g AS (SELECT ln.aoi_id, scene_id, transect_index FROM ln JOIN tx USING (aoi_id)),
  v AS (SELECT aoi_id, line_id // 20 AS scene_id, transect_index, max(CASE WHEN (line_id // 10) % 2 = 0 THEN t * len - len / 2 END) AS wl, max(CASE WHEN (line_id // 10) % 2 = 1 THEN t * len - len / 2 END) AS ve FROM near GROUP BY ALL)
  SELECT g.aoi_id, g.scene_id, g.transect_index, {s6('wl')} AS wl, {s6('ve')} AS ve FROM g LEFT JOIN v USING (aoi_id, scene_id, transect_index)""")
def observation_grid(spark, sf):
    """Two customers' lines make the waterline and vegetation edge of one scene."""
    h = spatial.intersect(transects(spark, sf), line_segs(spark, sf), ["line_id"])
    h = h.withColumn("scene_id", F.floor(F.col("line_id") / 20)).withColumn("boundary", F.when(F.floor(F.col("line_id") / 10) % 2 == 0, "WL").otherwise("VE"))
    scenes = p.vertices(spark, sf).select("aoi_id", F.floor(F.col("line_id") / 20).alias("scene_id")).distinct()
    o = spatial.observation_series(scenes, transects(spark, sf), h, carry=[])
    return o.select("aoi_id", "scene_id", "transect_index", r6("WL_distance_m").alias("wl"), r6("VE_distance_m").alias("ve"))


@query("hit_statistics", f"""WITH {p.MEASURED}, {TRANSECTS}, {HITS}, g AS (SELECT line_id, count(*) AS hits, quantile_cont(abs(t * len - len / 2), 0.5) AS med FROM near GROUP BY 1)
  SELECT l.line_id, coalesce(hits, 0) AS hits, {s6('coalesce(hits / 49.0, 0)')} AS hit_ratio, {s6('med')} AS median_offset FROM (SELECT DISTINCT line_id FROM segs0 WHERE x1 IS NOT NULL) l LEFT JOIN g USING (line_id)""")
def hit_statistics(spark, sf):
    h = spatial.hit_stats(transects(spark, sf), line_segs(spark, sf), ["line_id"])
    return h.select("line_id", "hits", r6("hit_ratio").alias("hit_ratio"), r6("median_offset").alias("median_offset"))


@query("reconstructed_lines", f"""WITH {p.MEASURED}, {TRANSECTS}, {HITS}, ok AS (SELECT line_id, count(*) AS hits FROM near GROUP BY 1 HAVING count(*) >= 3 AND count(*) / 49.0 >= 0.2),
  g AS (SELECT near.line_id, transect_index AS i, tx0 + t * (tx1 - tx0) AS x, t * 500 AS y FROM near JOIN ok USING (line_id)),
  s AS (SELECT line_id, unnest(generate_series(0, 48)) AS i FROM ok),
  f AS (SELECT s.line_id, s.i, max(CASE WHEN g.i <= s.i THEN g.i END) AS a, min(CASE WHEN g.i >= s.i THEN g.i END) AS b FROM s JOIN g USING (line_id) GROUP BY ALL),
  w AS (SELECT f.line_id, f.i, coalesce(a, b) AS a, coalesce(b, a) AS b FROM f)
  SELECT w.line_id, w.i AS seq, {s6('CASE WHEN a = b THEN ga.x ELSE ga.x + (w.i - a) / CAST(b - a AS DOUBLE) * (gb.x - ga.x) END')} AS x, {s6('CASE WHEN a = b THEN ga.y ELSE ga.y + (w.i - a) / CAST(b - a AS DOUBLE) * (gb.y - ga.y) END')} AS y
  FROM w JOIN g ga ON ga.line_id = w.line_id AND ga.i = a JOIN g gb ON gb.line_id = w.line_id AND gb.i = b""")
def reconstructed_lines(spark, sf):
    r = spatial.reconstruct(transects(spark, sf), line_segs(spark, sf), ["line_id"], 0.2)
    return r.select("line_id", "seq", r6("x").alias("x"), r6("y").alias("y"))


@query("vertices_near_line", f"""WITH {p.VERTICES}, v AS (SELECT DISTINCT aoi_id, seq, x, y FROM vertices) SELECT seq FROM v WHERE abs(y - 250) <= 40""")
def vertices_near_line(spark, sf):
    """A horizontal reference per AOI at y = 250; the buffer of 40 m is tested by distance."""
    v = p.vertices(spark, sf)
    ref = v.select("aoi_id").distinct().select("aoi_id", F.lit(-100.0).alias("x0"), F.lit(250.0).alias("y0"), F.lit(40000.0).alias("x1"), F.lit(250.0).alias("y1"))
    return spatial.pixels_near(v, ref, ["aoi_id"], 40.0, 40.0).select("seq")


@query("vertices_in_polygon", f"""WITH {p.VERTICES} SELECT seq FROM vertices WHERE abs(x - 12000) / 10000.0 + abs(y - 250) / 200.0 < 1""")
def vertices_in_polygon(spark, sf):
    """A diamond around (12000, 250) for every AOI."""
    v = p.vertices(spark, sf)
    pt = lambda x, y: lines.point(F.lit(x), F.lit(y))
    ring = F.array(pt(12000.0, 50.0), pt(22000.0, 250.0), pt(12000.0, 450.0), pt(2000.0, 250.0), pt(12000.0, 50.0))
    areas = v.select("aoi_id").distinct().withColumn("ring", ring)
    return spatial.pixels_inside(v, areas, ["aoi_id"]).select("seq")


@query("nearest_reference", f"""WITH {p.VERTICES} SELECT line_id, seq, {s6('abs(y - 250)')} AS distance, {s6('x + 100')} AS along FROM vertices""")
def nearest_reference(spark, sf):
    v = p.vertices(spark, sf)
    ref = v.select("aoi_id").distinct().select("aoi_id", F.lit(-100.0).alias("x0"), F.lit(250.0).alias("y0"), F.lit(40000.0).alias("x1"), F.lit(250.0).alias("y1"), F.lit(0.0).alias("cum0"))
    q = v.select("aoi_id", "line_id", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    d = spatial.nearest_segment(q, ref, ["aoi_id", "line_id", "seq"], ["aoi_id"], 100.0)
    return d.select("line_id", "seq", r6("distance").alias("distance"), r6("along").alias("along"))


@query("metric_systems", f"WITH {PLACES} SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 32630 ELSE CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(greatest(CAST(floor((lon + 180.0) / 6.0) AS BIGINT) + 1, 1), 60) END AS epsg FROM places")
def metric_systems(spark, sf):
    own = F.when(F.col("c_custkey") % 2 == 0, 32630).otherwise(4326)
    return places(spark, sf).select("c_custkey", geo.metric_epsg(own, F.col("c_custkey") % 2 != 0, "lon", "lat").alias("epsg"))
