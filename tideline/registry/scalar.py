"""Names, times, months, sizes and coordinates."""

from pyspark.sql import functions as F

from tideline.functions import geo, lines, text_time
from tideline.operators import raster
from tideline.registry import proxies as p
from tideline.registry import query, r6, s6


@query("slug_names", """SELECT page_id,
  CASE WHEN trim(regexp_replace(trim(url), '[^a-zA-Z0-9_-]+', '_', 'g'), '_') = '' THEN 'item'
       ELSE trim(regexp_replace(trim(url), '[^a-zA-Z0-9_-]+', '_', 'g'), '_') END AS slug,
  trim(regexp_replace(url, '[^a-zA-Z0-9_.-]+', '_', 'g'), '_') AS safe FROM pages""")
def slug_names(spark, sf):
    return p.table(spark, sf, "pages").select(
        "page_id", text_time.slugify("url").alias("slug"), text_time.safe_scene_id("url").alias("safe")
    )


@query("iso_times", """SELECT event_id, ts AS whole, date_trunc('second', ts) AS plain, ts - INTERVAL 2 HOUR AS shifted FROM events""")
def iso_times(spark, sf):
    e = p.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    iso = lambda fmt, tail="": F.concat(F.date_format("ts", fmt), F.lit(tail))
    return e.select(
        "event_id",
        text_time.parse_iso(iso("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "123Z")).alias("whole"),
        text_time.parse_iso(iso("yyyy-MM-dd HH:mm:ss")).alias("plain"),
        text_time.parse_iso(iso("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "+02:00")).alias("shifted"),
    )


@query("scene_time_window", f"""WITH {p.SCENES} SELECT scene_id, datetime - INTERVAL 12 HOUR AS win_start, datetime + INTERVAL 12 HOUR AS win_end FROM scenes""")
def scene_time_window(spark, sf):
    w = text_time.scene_window("datetime")
    return p.scenes(spark, sf).select("scene_id", w["start"].alias("win_start"), w["end"].alias("win_end"))


NAMES = f"""WITH {p.SCENES}, named AS (SELECT scene_id,
  'AOI_' || lpad(CAST(aoi_id AS VARCHAR), 2, '0') || CASE WHEN status = 'O' THEN '_holdout' ELSE '' END || '_' || strftime(datetime, '%Y%m') || '__S' || CAST(scene_id AS VARCHAR) || CASE WHEN status = 'P' THEN '.tif' ELSE '.png' END AS name FROM scenes)"""


def _names(spark, sf):
    name = F.concat(
        F.lit("AOI_"), F.lpad(F.col("aoi_id").cast("string"), 2, "0"), F.when(F.col("status") == "O", "_holdout").otherwise(""),
        F.lit("_"), F.date_format("datetime", "yyyyMM"), F.lit("__S"), F.col("scene_id").cast("string"),
        F.when(F.col("status") == "P", ".tif").otherwise(".png"),
    )
    return p.scenes(spark, sf).select("scene_id", name.alias("name"))


@query("image_names", NAMES + """ SELECT scene_id,
  CASE WHEN name LIKE '%.png' THEN split_part(name, '__', 1) END AS run_id,
  CASE WHEN name LIKE '%.png' THEN replace(split_part(name, '__', 2), '.png', '') END AS image_scene,
  CASE WHEN name LIKE '%.png' THEN lower(regexp_extract(name, '(?i)^(aoi_\\d+)', 1)) END AS aoi_key FROM named""")
def image_names(spark, sf):
    n = _names(spark, sf).withColumn("i", text_time.parse_image_name("name"))
    return n.select("scene_id", "i.run_id", F.col("i.scene_id").alias("image_scene"), "i.aoi_key")


@query("name_months", NAMES + """ SELECT scene_id, lower(regexp_extract(name, '(?i)(aoi_\\d+(?:_holdout)?)_(20\\d{2})(\\d{2})', 1)) AS aoi,
  CAST(regexp_extract(name, '(?i)(aoi_\\d+(?:_holdout)?)_(20\\d{2})(\\d{2})', 2) AS BIGINT) AS year,
  CAST(regexp_extract(name, '(?i)(aoi_\\d+(?:_holdout)?)_(20\\d{2})(\\d{2})', 3) AS BIGINT) AS month,
  lower(regexp_extract(name, '(?i)^(aoi_\\d+)', 1)) AS stem_aoi FROM named
  WHERE CAST(regexp_extract(name, '_(20\\d{2})(\\d{2})__', 1) AS VARCHAR) <> ''
  UNION ALL SELECT scene_id, NULL, NULL, NULL, lower(regexp_extract(name, '(?i)^(aoi_\\d+)', 1)) FROM named
  WHERE CAST(regexp_extract(name, '_(20\\d{2})(\\d{2})__', 1) AS VARCHAR) = ''""")
def name_months(spark, sf):
    n = _names(spark, sf)
    n = n.withColumn("m", text_time.parse_aoi_year_month("name")).withColumn("s", text_time.parse_stem_month("name"))
    return n.select("scene_id", "m.aoi", "m.year", "m.month", F.col("s.aoi").alias("stem_aoi"))


@query("month_arithmetic", f"""WITH {p.SCENES}, m AS (SELECT scene_id, year(datetime) * 12 + month(datetime) AS month_idx, year(datetime) AS year, month(datetime) AS month FROM scenes)
  SELECT scene_id, month_idx, year AS back_year, month AS back_month FROM m""")
def month_arithmetic(spark, sf):
    m = p.scenes(spark, sf).select("scene_id", text_time.month_index(F.year("datetime"), F.month("datetime")).alias("month_idx"))
    return m.withColumn("b", text_time.month_of_index("month_idx")).select(
        "scene_id", "month_idx", F.col("b.year").alias("back_year"), F.col("b.month").alias("back_month")
    )


@query("month_token_list", """SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders""")
def month_token_list(spark, sf):
    text = p.table(spark, sf, "orders").select(
        F.concat(F.lit("# months\n"), F.date_format("o_orderdate", "yyyy-MM"), F.lit(",  2020-13 ;"), F.date_format("o_orderdate", "yyyy-MM")).alias("text")
    )
    return text_time.month_tokens(text, "text")


@query("month_ranges", """WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders), d AS (SELECT month, CAST(month || '-01' AS DATE) AS s FROM m)
  SELECT month, CASE WHEN s <= DATE '2000-03-15' THEN strftime(s, '%Y-%m-%d') END AS range_start,
  CASE WHEN s <= DATE '2000-03-15' THEN strftime(least(last_day(s), DATE '2000-03-15'), '%Y-%m-%d') END AS range_end,
  CASE WHEN s <= DATE '2000-03-15' THEN 'ok' ELSE 'skipped_future' END AS status FROM d""")
def month_ranges(spark, sf):
    m = p.table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    m = m.withColumn("r", text_time.month_range("month", F.lit("2000-03-15").cast("date")))
    return m.select("month", F.col("r.start").cast("string").alias("range_start"), F.col("r.end").cast("string").alias("range_end"), "r.status")


@query("calendar_windows", """WITH c AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY 1),
  g AS (SELECT *, unnest(generate_series(date_trunc('month', s)::TIMESTAMP, date_trunc('month', e)::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM c)
  SELECT o_custkey, strftime(m, '%Y-%m') AS month, strftime(greatest(CAST(m AS DATE), s), '%Y-%m-%d') AS window_start,
  strftime(least(last_day(CAST(m AS DATE)), e), '%Y-%m-%d') AS window_end FROM g""")
def calendar_windows(spark, sf):
    c = p.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").cast("date").alias("s"), F.max("o_orderdate").cast("date").alias("e")
    )
    w = text_time.month_windows(c, "s", "e")
    return w.select("o_custkey", "month", F.col("window_start").cast("string").alias("window_start"), F.col("window_end").cast("string").alias("window_end"))


@query("horizons", """SELECT o_orderkey, greatest(1, CAST(round_even(o_totalprice / 100000 * 365.25, 0) AS BIGINT)) AS days,
  greatest(1, CAST(ceil(greatest(1, CAST(round_even(o_totalprice / 100000 * 365.25, 0) AS BIGINT)) / 30.0) AS BIGINT)) AS steps FROM orders""")
def horizons(spark, sf):
    o = p.table(spark, sf, "orders").select("o_orderkey", text_time.horizon_days(F.col("o_totalprice") / 100000).alias("days"))
    return o.withColumn("steps", text_time.horizon_steps("days"))


@query("scene_seeds")
def scene_seeds(spark, sf):
    s = p.scenes(spark, sf)
    return s.select("scene_id", text_time.scene_seed(F.concat(F.lit("run"), F.col("aoi_id").cast("string")), F.col("scene_id").cast("string")).alias("seed"))


# a customer's place on the globe: longitude and latitude from key and balance
PLACES = """places AS (SELECT c_custkey, c_nationkey * 14.9 - 179.0 + (c_custkey % 50) / 25.0 AS lon, ((c_custkey * 7) % 150) - 72 + c_acctbal / 16384.0 AS lat FROM customer)"""


def places(spark, sf):
    c = p.table(spark, sf, "customer")
    return c.select(
        "c_custkey",
        (F.col("c_nationkey") * F.lit(14.9) - 179.0 + (F.col("c_custkey") % 50) / 25.0).alias("lon"),
        ((F.col("c_custkey") * 7) % 150 - 72 + F.col("c_acctbal") / 16384.0).alias("lat"),
    )


ZONE = "least(greatest(CAST(floor((lon + 180.0) / 6.0) AS BIGINT) + 1, 1), 60)"


@query("utm_zones", f"WITH {PLACES} SELECT c_custkey, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + {ZONE} AS epsg FROM places")
def utm_zones(spark, sf):
    return places(spark, sf).select("c_custkey", geo.utm_epsg("lon", "lat").alias("epsg"))


COS = "greatest(abs(cos(radians(lat))), 0.1)"


@query("raster_sizes", f"""WITH {PLACES} SELECT c_custkey,
  {s6(f"100.0 / (111320.0 * {COS})")} AS units_geo, 100.0 AS units_metric, {s6("100.0 / 111320.0")} AS units_unknown,
  CAST(least(greatest(ceil(0.05 * 111320.0 * greatest(abs(cos(radians((lat + lat + 0.03) / 2.0))), 0.1) / 10.0), 64), 2500) AS BIGINT) AS width,
  CAST(least(greatest(ceil(abs(lat + 0.03 - lat) * 110540.0 / 10.0), 64), 2500) AS BIGINT) AS height,
  {s6(f"0.0001 * 111320.0 * {COS} * 0.0001 * 111320.0")} AS pixel_area,
  greatest(1, CAST(ceil(5000.0 / (0.0001 * 111320.0 * {COS} * 0.0001 * 111320.0)) AS BIGINT)) AS min_patch FROM places""")
def raster_sizes(spark, sf):
    d = places(spark, sf)
    area = geo.pixel_area(F.lit(0.0001), F.lit(-0.0001), F.lit(True), "lat")
    dims = geo.bbox_dims(F.lit(0.0), F.col("lat"), F.lit(0.05), F.col("lat") + 0.03)
    return d.select(
        "c_custkey",
        r6(geo.m_to_units(100.0, F.lit(True), "lat")).alias("units_geo"),
        geo.m_to_units(100.0, F.lit(False), "lat").alias("units_metric"),
        r6(geo.m_to_units(100.0, F.lit(None).cast("boolean"), "lat")).alias("units_unknown"),
        dims["width"].alias("width"), dims["height"].alias("height"),
        r6(area).alias("pixel_area"), geo.min_patch_px(5000.0, area).alias("min_patch"),
    )


@query("pixel_world", f"""WITH {p.PIXELS} SELECT scene_id, row, col, {s6("10.0 * (col + 0.5) + 500000")} AS x, {s6("-10.0 * (row + 0.5) + 6000000")} AS y,
  row + 0.5 AS back_row, col + 0.5 AS back_col, {s6("-3.0 + col / 64.0 * 2")} AS lin_x, {s6("57.0 - row / 20.0 * 2")} AS lin_y FROM pixels WHERE row < 19 AND col < 63
  UNION ALL SELECT scene_id, row, col, {s6("10.0 * (col + 0.5) + 500000")}, {s6("-10.0 * (row + 0.5) + 6000000")}, least(row + 0.5, 19), least(col + 0.5, 63),
  {s6("-3.0 + col / 64.0 * 2")}, {s6("57.0 - row / 20.0 * 2")} FROM pixels WHERE NOT (row < 19 AND col < 63)""")
def pixel_world(spark, sf):
    d = p.pixels(spark, sf)
    args = [F.lit(10.0), F.lit(500000.0), F.lit(-10.0), F.lit(6000000.0)]
    d = d.withColumn("w", geo.pix_to_world("row", "col", *args))
    d = d.withColumn("b", geo.world_to_pix("w.x", "w.y", *args, F.lit(64), F.lit(20)))
    d = d.withColumn("l", geo.linear_world("row", "col", F.lit(64), F.lit(20), F.lit(-3.0), F.lit(-1.0), F.lit(55.0), F.lit(57.0)))
    return d.select(
        "scene_id", "row", "col", r6("w.x").alias("x"), r6("w.y").alias("y"), F.col("b.row").alias("back_row"), F.col("b.col").alias("back_col"),
        r6("l.x").alias("lin_x"), r6("l.y").alias("lin_y"),
    )


@query("unit_coordinates", f"""WITH {p.VERTICES}, u AS (SELECT seq, least(greatest((x - 1000) / 20000.0, 0), 1) AS ux, least(greatest((y - 50) / 400.0, 0), 1) AS uy FROM vertices)
  SELECT seq, {s6("ux")} AS ux, {s6("uy")} AS uy, {s6("1000 + ux * 20000.0")} AS back_x, {s6("50 + uy * 400.0")} AS back_y FROM u""")
def unit_coordinates(spark, sf):
    v = p.vertices(spark, sf)
    box = F.array(F.lit(1000.0), F.lit(50.0), F.lit(21000.0), F.lit(450.0))
    v = v.withColumn("line", geo.line_to_unit(F.array(lines.point(F.col("x"), F.col("y"))), box))
    v = v.withColumn("back", geo.line_from_unit("line", box))
    a, b = F.col("line")[0], F.col("back")[0]
    return v.select("seq", r6(a["x"]).alias("ux"), r6(a["y"]).alias("uy"), r6(b["x"]).alias("back_x"), r6(b["y"]).alias("back_y"))


@query("rescaled_points", f"""WITH {p.VERTICES} SELECT seq, {s6("greatest(least(x * (100.0 / 400), 99), 0)")} AS x, {s6("greatest(least(y * (50.0 / 300), 49), 0)")} AS y FROM vertices""")
def rescaled_points(spark, sf):
    v = p.vertices(spark, sf)
    pts = geo.rescale_points(F.array(lines.point(F.col("x"), F.col("y"))), F.lit(400.0), F.lit(300.0), F.lit(100.0), F.lit(50.0))
    return v.withColumn("q", pts[0]).select("seq", r6("q.x").alias("x"), r6("q.y").alias("y"))


@query("index_from_8bit", f"""WITH {p.PIXELS} SELECT scene_id, row, col, {s6("CAST(floor(b03 * 255) AS DOUBLE) / 255.0 * 2 - 1")} AS v FROM pixels WHERE b03 IS NOT NULL""")
def index_from_8bit(spark, sf):
    d = p.pixels(spark, sf).filter("b03 IS NOT NULL")
    return d.select("scene_id", "row", "col", r6(raster.index_from_uint8(F.floor(F.col("b03") * 255))).alias("v"))


def _utm_sql() -> str:
    """The projection series written out as SQL from the same coefficients."""
    n = "".join(f" + {a!r} * sin({2*j} * xi) * cosh({2*j} * eta)" for j, a in enumerate(geo.ALPHA, 1))
    e = "".join(f" + {a!r} * cos({2*j} * xi) * sinh({2*j} * eta)" for j, a in enumerate(geo.ALPHA, 1))
    ecc, k = repr(geo._E), repr(geo.UTM_K0 * geo.RECTIFYING_RADIUS)
    return f"""WITH {PLACES}, z AS (SELECT *, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + {ZONE} AS epsg FROM places),
  a AS (SELECT *, sin(radians(lat)) AS s, radians(lon - (epsg % 100 * 6.0::DOUBLE - 183.0)) AS lam FROM z),
  b AS (SELECT *, sinh(atanh(s) - {ecc}::DOUBLE * atanh({ecc}::DOUBLE * s)) AS t FROM a),
  c AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM b)
  SELECT c_custkey, epsg, floor((500000.0 + {k}::DOUBLE * (eta{e})) * 1e3 + 0.5) / 1e3 AS x,
  floor((CASE WHEN epsg >= 32700 THEN 10000000.0 ELSE 0.0 END + {k}::DOUBLE * (xi{n})) * 1e3 + 0.5) / 1e3 AS y,
  floor(lon * 1e6 + 0.5) / 1e6 AS back_lon, floor(lat * 1e6 + 0.5) / 1e6 AS back_lat FROM c"""


@query("utm_projection", _utm_sql())
def utm_projection(spark, sf):
    d = places(spark, sf).withColumn("epsg", geo.utm_epsg("lon", "lat"))
    d = geo.unproject(geo.project(d, "lon", "lat", "epsg"), "x", "y", "epsg", "back_lon", "back_lat")
    mm = lambda c: F.floor(F.col(c) * 1e3 + 0.5) / 1e3
    return d.select("c_custkey", "epsg", mm("x").alias("x"), mm("y").alias("y"), r6("back_lon").alias("back_lon"), r6("back_lat").alias("back_lat"))
