"""Class statistics, thresholds, sampling and gates on the embedding mosaic."""

from pyspark.sql import functions as F

from tideline.operators import raster, thresholds
from tideline.registry import proxies as p
from tideline.registry import query, r6, s6
from tideline.registry.raster import DISK, IDX, PX, indexed, raster_sample_rows, scene_transects

KEYS = ["aoi_id", "scene_id"]


def classed(spark, sf):
    return indexed(spark, sf).withColumn("cls", raster.classify_veg("ndvi"))


CLS = f"{IDX}, cls AS (SELECT *, CASE WHEN ndvi >= 0.2 THEN 1 WHEN ndvi < 0.2 THEN 2 END AS cls FROM idx)"


def density_sql(rows: str, prominence: float, grid: str, log: bool = True) -> str:
    """Log (or plain) density of ``rows(scene_id, v)`` on ``grid(scene_id, g, x)``, its peaks and their prominence."""
    value = "m + ln(s)" if log else "exp(m + ln(s))"
    return f"""e AS (SELECT g.scene_id, g.g, g.x, -pow(g.x - r.v, 2) / 0.0002 AS ex FROM {grid} g JOIN {rows} r USING (scene_id)),
  mx AS (SELECT scene_id, g, any_value(x) AS x, max(ex) AS m FROM e GROUP BY ALL),
  sz AS (SELECT scene_id, count(*) AS n FROM {rows} GROUP BY 1),
  sm AS (SELECT scene_id, g, any_value(mx.x) AS x, any_value(mx.m) AS m, sum(exp(e.ex - mx.m)) / (any_value(sz.n) * 0.01 * sqrt(2 * pi())) AS s FROM e JOIN mx USING (scene_id, g) JOIN sz USING (scene_id) GROUP BY ALL),
  curve AS (SELECT scene_id, g, x, {value} AS y FROM sm),
  nb AS (SELECT *, lag(y) OVER w AS py, lead(y) OVER w AS ny FROM curve WINDOW w AS (PARTITION BY scene_id ORDER BY g)),
  top AS (SELECT * FROM nb WHERE y > py AND y > ny),
  bound AS (SELECT t.scene_id, t.g, t.x, t.y, coalesce(max(CASE WHEN c.g < t.g AND c.y > t.y THEN c.g END), -1) AS lo, coalesce(min(CASE WHEN c.g > t.g AND c.y > t.y THEN c.g END), 100000) AS hi FROM top t JOIN curve c USING (scene_id) GROUP BY ALL),
  prom AS (SELECT b.scene_id, b.g, any_value(b.x) AS x, any_value(b.y) AS y, any_value(b.y) - greatest(min(CASE WHEN c.g > b.lo AND c.g <= b.g THEN c.y END), min(CASE WHEN c.g >= b.g AND c.g < b.hi THEN c.y END)) AS prom FROM bound b JOIN curve c ON c.scene_id = b.scene_id GROUP BY b.scene_id, b.g),
  peaks AS (SELECT * FROM prom WHERE prom >= {prominence})"""


def _wp_sql(prominence: float, min_class: int, min_total: int) -> str:
    return f"""WITH {CLS}, rows AS (SELECT scene_id, ndvi AS v, cls FROM cls WHERE cls IS NOT NULL),
  st AS (SELECT scene_id, count(*) FILTER (cls = 1) AS n_a, count(*) FILTER (cls = 2) AS n_b, avg(v) FILTER (cls = 1) AS ma, avg(v) FILTER (cls = 2) AS mb, min(v) AS lo, max(v) AS hi FROM rows GROUP BY 1),
  gr AS (SELECT scene_id, g, lo + (hi - lo) * g / 999.0 AS x FROM st, (SELECT unnest(generate_series(0, 999)) AS g)), {density_sql('rows', prominence, 'gr')},
  two AS (SELECT scene_id, x, row_number() OVER (PARTITION BY scene_id ORDER BY prom DESC, g DESC) AS rk, count(*) OVER (PARTITION BY scene_id) AS n FROM peaks),
  wp AS (SELECT scene_id, 0.2 * min(x) + 0.8 * max(x) AS t FROM two WHERE rk <= 2 AND n >= 2 GROUP BY 1)
  SELECT scene_id, n_a, n_b, {s6(f'''CASE WHEN n_a >= {min_class} AND n_b >= {min_class} AND n_a + n_b >= {min_total} THEN coalesce(t, (ma + mb) / 2) WHEN n_a = 0 OR n_b = 0 THEN 0 ELSE (ma + mb) / 2 END''')} AS threshold FROM st LEFT JOIN wp USING (scene_id)"""


@query("weighted_peaks", _wp_sql(0.2, 5, 20))
def weighted_peaks(spark, sf):
    t = thresholds.weighted_peaks(classed(spark, sf), "ndvi", "cls", 1, 2)
    return t.select("scene_id", "n_a", "n_b", r6("threshold").alias("threshold"))


@query("dense_value_peaks", f"""WITH rows AS (SELECT l_returnflag AS scene_id, l_extendedprice::DOUBLE / 100000 AS v, CASE WHEN l_quantity > 25 THEN 1 ELSE 2 END AS cls FROM lineitem),
  st AS (SELECT scene_id, count(*) FILTER (cls = 1) AS n_a, count(*) FILTER (cls = 2) AS n_b, avg(v) FILTER (cls = 1) AS ma, avg(v) FILTER (cls = 2) AS mb, min(v) AS lo, max(v) AS hi FROM rows GROUP BY 1),
  gr AS (SELECT scene_id, g, lo + (hi - lo) * g / 999.0 AS x FROM st, (SELECT unnest(generate_series(0, 999)) AS g)), {density_sql('rows', 0.02, 'gr')},
  two AS (SELECT scene_id, x, row_number() OVER (PARTITION BY scene_id ORDER BY prom DESC, g DESC) AS rk, count(*) OVER (PARTITION BY scene_id) AS n FROM peaks),
  wp AS (SELECT scene_id, 0.2 * min(x) + 0.8 * max(x) AS t FROM two WHERE rk <= 2 AND n >= 2 GROUP BY 1)
  SELECT scene_id AS l_returnflag, n_a, n_b, {s6('coalesce(t, (ma + mb) / 2)')} AS threshold FROM st LEFT JOIN wp USING (scene_id)""")
def dense_value_peaks(spark, sf):
    """Modes of tens of thousands of distinct values in one key, weighed in several parts."""
    d = p.table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_extendedprice").cast("double") / 100000).alias("v"), F.when(F.col("l_quantity") > 25, 1).otherwise(2).alias("cls"))
    t = thresholds.weighted_peaks(d, "v", "cls", 1, 2, ["l_returnflag"], prominence=0.02)
    return t.select("l_returnflag", "n_a", "n_b", r6("threshold").alias("threshold"))


@query("weighted_peaks_legacy", _wp_sql(0.5, 1, 10))
def weighted_peaks_legacy(spark, sf):
    t = thresholds.weighted_peaks(classed(spark, sf), "ndvi", "cls", 1, 2, min_class=1, min_total=10, prominence=0.5)
    return t.select("scene_id", "n_a", "n_b", r6("threshold").alias("threshold"))


def _class_peak_sql(cls: int) -> str:
    return f"""rows AS (SELECT scene_id, ndvi AS v FROM cls WHERE cls = {cls}), gr AS (SELECT scene_id, g, -1.0::DOUBLE + g * 0.01::DOUBLE AS x FROM (SELECT DISTINCT scene_id FROM rows), (SELECT unnest(generate_series(0, 199)) AS g)),
  {density_sql('rows', 0.05, 'gr', log=False)}"""


@query("class_peaks", f"""WITH {CLS}, a AS (WITH {_class_peak_sql(1)} SELECT scene_id, arg_min(x, (-y, g)) AS pa FROM curve GROUP BY 1),
  lv AS (WITH {_class_peak_sql(2)} SELECT c.scene_id, c.g, c.x, c.y, k.prom, k.x AS kx FROM curve c LEFT JOIN prom k USING (scene_id, g)),
  stp AS (SELECT unnest(generate_series(0, 9)) AS i),
  first_hit AS (SELECT scene_id, min(i) AS i FROM lv, stp WHERE prom >= 0.5 - i * 0.05 - 1e-12 GROUP BY 1),
  b AS (SELECT lv.scene_id, CASE WHEN any_value(f.i) IS NULL THEN arg_min(lv.x, (-lv.y, lv.g)) ELSE coalesce(CASE WHEN min(CASE WHEN prom >= 0.5 - f.i * 0.05 - 1e-12 THEN kx END) < 0 THEN max(CASE WHEN prom >= 0.5 - f.i * 0.05 - 1e-12 THEN kx END) ELSE min(CASE WHEN prom >= 0.5 - f.i * 0.05 - 1e-12 THEN kx END) END) END AS pb
    FROM lv LEFT JOIN first_hit f USING (scene_id) GROUP BY 1)
  SELECT scene_id, count(*) FILTER (cls = 1) AS n_a, count(*) FILTER (cls = 2) AS n_b, {s6('0.2 * any_value(pa) + 0.8 * any_value(pb)')} AS threshold FROM cls JOIN a USING (scene_id) JOIN b USING (scene_id) GROUP BY 1""")
def class_peaks(spark, sf):
    t = thresholds.class_peaks(classed(spark, sf), "ndvi", "cls", 1, 2)
    return t.select("scene_id", "n_a", "n_b", r6("threshold").alias("threshold"))


@query("transition_zone", f"WITH {CLS} SELECT scene_id, {s6('quantile_cont(ndvi, 0.005)')} AS tz_low, {s6('quantile_cont(ndvi, 0.1)')} AS tz_high FROM cls WHERE cls = 1 GROUP BY 1")
def transition_zone(spark, sf):
    t = thresholds.tz_values(classed(spark, sf).filter("cls = 1"), "ndvi")
    return t.select("scene_id", r6("tz_low").alias("tz_low"), r6("tz_high").alias("tz_high"))


@query("clipped_values", f"""WITH {CLS}, o AS ({DISK.format(4)}), m AS (SELECT DISTINCT scene_id, row + i AS row, col + j AS col FROM idx, o WHERE mndwi > 0.6) SELECT c.scene_id, c.row, c.col, c.cls, {s6('ndvi')} AS v FROM cls c JOIN m USING (scene_id, row, col) WHERE c.cls IS NOT NULL""")
def clipped_values(spark, sf):
    d = classed(spark, sf)
    c = thresholds.clip_index(d, d.filter("mndwi > 0.6"), "ndvi", "cls", grow=2)
    return c.select(*PX, "cls", r6("ndvi").alias("v"))


@query("balanced_classes", f"WITH {CLS}, n AS (SELECT scene_id, cls, count(*) AS n FROM cls WHERE cls IS NOT NULL GROUP BY ALL) SELECT scene_id, cls, min(n) OVER (PARTITION BY scene_id) AS kept FROM n")
def balanced_classes(spark, sf):
    b = thresholds.balance(classed(spark, sf).filter("cls IS NOT NULL"), "cls", 7)
    return b.groupBy("scene_id", "cls").agg(F.count("*").alias("kept"))


@query("sampled_values", f"WITH {IDX} SELECT scene_id, least(count(*), 300) AS n, true AS from_scene FROM idx WHERE ndvi IS NOT NULL GROUP BY 1")
def sampled_values(spark, sf):
    s = thresholds.sample_values(indexed(spark, sf).filter("ndvi IS NOT NULL"), "ndvi", 300, 11)
    return s.groupBy("scene_id").agg(F.count_distinct("row", "col").alias("n"), F.max(F.col("ndvi").isNotNull()).alias("from_scene"))


@query("median_classes", f"WITH {IDX}, m AS (SELECT scene_id, quantile_cont(ndvi, 0.5) AS m FROM idx WHERE ndvi IS NOT NULL GROUP BY 1) SELECT scene_id, row, col, CASE WHEN ndvi > m THEN 1 ELSE 2 END AS cls FROM idx JOIN m USING (scene_id) WHERE ndvi IS NOT NULL")
def median_classes(spark, sf):
    return thresholds.median_split(indexed(spark, sf), "ndvi", KEYS, "cls").select(*PX, "cls")


SAMPLES = f"""{IDX}, s AS (SELECT DISTINCT scene_id FROM idx), t AS (SELECT *, unnest(generate_series(0, 9)) AS tid FROM s), k AS (SELECT *, unnest(generate_series(0, 99)) AS k FROM t),
  f AS (SELECT *, 500013.0 + tid * 70 + k / 99.0 * 30.0 AS px, 6000007.0 + k / 99.0 * -217.0 AS py FROM k),
  smp AS (SELECT f.scene_id, tid, k, px, py, sqrt(pow(px - (500013.0 + tid * 70), 2) + pow(py - 6000007.0, 2)) AS dist, ndvi AS v FROM f JOIN idx i ON i.scene_id = f.scene_id AND i.row = CAST(floor((py - 6000000) / -10) AS BIGINT) AND i.col = CAST(floor((px - 500000) / 10) AS BIGINT) WHERE ndvi IS NOT NULL)"""


@query("transect_edges", f"""WITH {SAMPLES}, thr AS (SELECT scene_id, 0.5 + scene_id / 100.0 AS threshold FROM s), e AS (SELECT scene_id, tid, count(*) AS n, avg(v) AS mv, min(CASE WHEN v > threshold THEN dist END) AS d, arg_min(px, CASE WHEN v > threshold THEN dist END) AS ex, arg_min(py, CASE WHEN v > threshold THEN dist END) AS ey FROM smp JOIN thr USING (scene_id) GROUP BY ALL)
  SELECT t.scene_id, tid AS transect_index, {s6('coalesce(ex, 500028.0 + tid * 70)')} AS x, {s6('coalesce(ey, 5999898.5)')} AS y, {s6('d')} AS edge_distance, coalesce(n, 0) AS sample_count, {s6('mv')} AS mean_value, CASE WHEN d IS NOT NULL THEN 'threshold' WHEN n IS NULL THEN 'fallback_midpoint' ELSE 'midpoint' END AS method FROM t LEFT JOIN e USING (scene_id, tid)""")
def transect_edges(spark, sf):
    t = scene_transects(spark, sf)
    thr = t.select("aoi_id", "scene_id").distinct().withColumn("threshold", 0.5 + F.col("scene_id") / 100.0)
    e = thresholds.edge_points(raster_sample_rows(spark, sf), t, thr, "ndvi")
    return e.select("scene_id", "transect_index", *[r6(c).alias(c) for c in ("x", "y", "edge_distance", "mean_value")], "sample_count", "method")


@query("chosen_thresholds", f"""WITH {SAMPLES}, m AS (SELECT scene_id, tid, quantile_cont(v, 0.5) AS m FROM smp GROUP BY ALL), c AS (SELECT scene_id, count(*) FILTER (v > m) AS a, count(*) FILTER (v <= m) AS b FROM smp JOIN m USING (scene_id, tid) GROUP BY 1)
  SELECT scene_id, a AS n_a, b AS n_b, CASE WHEN a > 10 AND b > 10 THEN 'computed' ELSE 'default' END AS transects, CASE WHEN a + b > 900 AND a > 50 AND b > 50 THEN 'computed' WHEN a + b > 100 AND a > 50 AND b > 50 THEN 'computed' ELSE 'default' END AS raster, 0.25 AS manual FROM c""")
def chosen_thresholds(spark, sf):
    split = thresholds.median_split(raster_sample_rows(spark, sf), "ndvi", [*KEYS, "transect_index"], "cls")
    wp = thresholds.weighted_peaks(split, "ndvi", "cls", 1, 2, min_class=1, min_total=10, prominence=0.5)
    t = thresholds.choose_threshold(wp, "transects").select(*KEYS, "n_a", "n_b", F.col("threshold_source").alias("transects"))
    r = thresholds.choose_threshold(wp, "raster").select(*KEYS, F.col("threshold_source").alias("raster"))
    m = thresholds.choose_threshold(wp, "raster", "manual", 0.25).select(*KEYS, F.col("threshold").alias("manual"))
    return t.join(r, KEYS).join(m, KEYS).drop("aoi_id")


@query("scene_gates", f"""WITH {CLS}, q AS (SELECT scene_id, avg(CASE WHEN masked THEN 0.0 ELSE 1.0 END) AS valid, count(ndvi) AS n, quantile_cont(ndvi, 0.9) - quantile_cont(ndvi, 0.1) AS rng, avg(CASE WHEN cls = 1 THEN 1.0 ELSE 0 END) AS veg, avg(CASE WHEN cls = 2 THEN 1.0 ELSE 0 END) AS nonveg FROM cls GROUP BY 1)
  SELECT scene_id, {s6('valid')} AS valid_share, n AS n_index, {s6('rng')} AS index_range, CASE WHEN valid < 0.2 THEN 'mostly_cloud_or_nodata' WHEN veg < 0.01 OR nonveg < 0.01 THEN 'insufficient_class_separation' END AS label_reason,
  CASE WHEN scene_id * 30 > 70 THEN 'cloud' WHEN valid < 0.3 THEN 'mostly_masked' WHEN n < 100 THEN 'no_valid_ndvi' WHEN rng < 0.12 THEN 'ndvi_range' END AS gradient_reason FROM q""")
def scene_gates(spark, sf):
    d = classed(spark, sf)
    q = thresholds.scene_quality(d, F.col("masked"), "ndvi")
    share = lambda c: F.avg(F.when(F.col("cls") == c, 1.0).otherwise(0.0))
    q = q.join(d.groupBy(*KEYS).agg(share(1).alias("veg"), share(2).alias("nonveg")), KEYS)
    g = thresholds.gradient_gate(F.col("scene_id") * 30.0, F.col("valid_share"), F.col("n_index"), F.col("index_range"), F.lit(1.0), F.lit(64))
    return q.select(
        "scene_id", r6("valid_share").alias("valid_share"), "n_index", r6("index_range").alias("index_range"),
        thresholds.label_gate(F.col("valid_share"), F.col("veg"), F.col("nonveg")).alias("label_reason"), g.alias("gradient_reason"),
    )


@query("reason_breakdown", "SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1")
def reason_breakdown(spark, sf):
    return thresholds.reason_counts(p.obs(spark, sf).withColumnRenamed("kind", "reason"))
