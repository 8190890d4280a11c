"""Pixel operators on the embedding mosaic."""

from pyspark.sql import functions as F

from tideline.lineage import cut
from tideline.operators import components, contours, profiles, raster
from tideline.registry import proxies as p
from tideline.registry import query, r3, r6, s3, s6

NDVI, MNDWI = p.nd_sql("b08", "b04"), p.nd_sql("b03", "b11")
IDX = f"""{p.PIXELS}, idx AS (SELECT *, {p.MASK_SQL} AS masked, CASE WHEN NOT {p.MASK_SQL} THEN {NDVI} END AS ndvi, CASE WHEN NOT {p.MASK_SQL} THEN {MNDWI} END AS mndwi FROM pixels)"""
PX = ["scene_id", "row", "col"]


def indexed(spark, sf):
    d = p.pixels(spark, sf)
    m = raster.nodata_mask()
    return d.withColumns({"masked": m, "ndvi": raster.nd_index("b08", "b04", m), "mndwi": raster.nd_index("b03", "b11", m)})


@query("spectral_indices", f"""WITH {IDX} SELECT scene_id, row, col, masked, {s6('ndvi')} AS ndvi, {s6('mndwi')} AS mndwi, (b02 IS NULL OR b03 IS NULL OR b04 IS NULL OR b08 IS NULL OR b11 IS NULL OR b03 < 0.02) IS TRUE AS dark,
  {s6('CASE WHEN NOT masked AND b08 + b04 + 0.5 <> 0 THEN (b08 - b04) / (b08 + b04 + 0.5) * 1.5 END')} AS savi, {s6('CASE WHEN NOT masked THEN (b08 - (b04 + b02)) / (b08 + (b04 + b02)) END')} AS rbnd FROM idx""")
def spectral_indices(spark, sf):
    d = indexed(spark, sf)
    m = F.col("masked")
    # the green rule tests 1e-4; the mosaic's floor is 0.01, so green is scaled to meet it
    dark = raster.nodata_mask("green").alias("dark")
    low = d.withColumn("b03", (F.col("b03") - 0.02) + 1e-4)
    return d.join(low.select(*PX, dark), PX).select(
        *PX, "masked", r6("ndvi").alias("ndvi"), r6("mndwi").alias("mndwi"), "dark", r6(raster.savi(mask=m)).alias("savi"), r6(raster.rbnd(mask=m)).alias("rbnd")
    )


@query("scene_signal", f"WITH {p.PIXELS} SELECT scene_id, max(greatest(coalesce(b02, 0), coalesce(b03, 0), coalesce(b04, 0), coalesce(b08, 0), coalesce(b11, 0))) > 0.5 AS has_signal FROM pixels GROUP BY 1")
def scene_signal(spark, sf):
    return raster.has_signal(p.pixels(spark, sf), floor=0.5).select("scene_id", "has_signal")


def _std_sql(cols: list[str]) -> str:
    """3x3 deviations by joining each pixel to its mirrored neighbours."""
    aggs = ", ".join(f"CASE WHEN count(n.{c}) = 9 THEN sqrt(greatest(avg(n.{c} * n.{c}) - avg(n.{c}) * avg(n.{c}), 0)) END AS {c}_std" for c in cols)
    return f"""offs AS (SELECT unnest([-1, 0, 1]) AS i), off2 AS (SELECT a.i, b.i AS j FROM offs a, offs b),
  std AS (SELECT q.scene_id, q.row, q.col, {aggs} FROM base q, off2 o JOIN base n ON n.scene_id = q.scene_id AND n.row = least(greatest(q.row + o.i, 0), 19) AND n.col = least(greatest(q.col + o.j, 0), 63) GROUP BY ALL)"""


VEG_COLS = ["b02", "b03", "b04", "b08", "b11", "nir_red", "nir_green", "red_green", "savi", "rbnd"]
SHORE_COLS = ["b02", "b03", "b04", "b08", "b11", "swir_green", "swir_nir", "nir_green", "nir_red", "blue_red"]


def _feature_sql(cols, defs):
    return f"""WITH {p.PIXELS}, base AS (SELECT scene_id, row, col, b02, b03, b04, b08, b11, {defs} FROM pixels), {_std_sql(cols)}
  SELECT scene_id, row, col, {', '.join(f'{s6(c)} AS {c}' for c in cols)}, {', '.join(f'{s6(c + "_std")} AS {c}_std' for c in cols)} FROM base JOIN std USING (scene_id, row, col)"""


@query("vegetation_features", _feature_sql(VEG_COLS, f"{p.nd_sql('b08', 'b04')} AS nir_red, {p.nd_sql('b08', 'b03')} AS nir_green, {p.nd_sql('b04', 'b03')} AS red_green, (b08 - b04) / (b08 + b04 + 0.5) * 1.5 AS savi, (b08 - (b04 + b02)) / (b08 + (b04 + b02)) AS rbnd"))
def vegetation_features(spark, sf):
    d, names = raster.veg_features(p.pixels(spark, sf))
    return d.select(*PX, *[r6(c).alias(c) for c in names])


@query("shore_features", _feature_sql(SHORE_COLS, f"{p.nd_sql('b11', 'b03')} AS swir_green, {p.nd_sql('b11', 'b08')} AS swir_nir, {p.nd_sql('b08', 'b03')} AS nir_green, {p.nd_sql('b08', 'b04')} AS nir_red, {p.nd_sql('b02', 'b04')} AS blue_red"))
def shore_features(spark, sf):
    d, names = raster.shore_features(p.pixels(spark, sf))
    return d.select(*PX, *[r6(c).alias(c) for c in names])


@query("pixel_classifier")
def pixel_classifier(spark, sf):
    d, names = raster.veg_features(p.pixels(spark, sf))
    d = cut(d.withColumn("label", raster.classify_veg(raster.nd_index("b08", "b04"))))
    model = raster.fit_pixel_classifier(d, names, "label", hidden=(8,), max_iter=20)
    return raster.score_pixels(d, model, names).select(*PX, "class", "label")


@query("pixel_classes", f"""WITH {IDX} SELECT scene_id, row, col, CASE WHEN ndvi >= 0.2 THEN 1 WHEN ndvi < 0.2 THEN 2 END AS veg,
  CASE WHEN NOT masked THEN CASE WHEN mndwi > 0 THEN 3 WHEN ndvi < 0.2 THEN 1 ELSE 2 END END AS shore FROM idx""")
def pixel_classes(spark, sf):
    return indexed(spark, sf).select(*PX, raster.classify_veg("ndvi").alias("veg"), raster.classify_shore("mndwi", "ndvi", mask=F.col("masked")).alias("shore"))


def _component_sql(cond: str, conn: int) -> str:
    near = "abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1" if conn == 8 else "abs(a.row - b.row) + abs(a.col - b.col) = 1"
    return f"""WITH RECURSIVE {IDX}, fg AS (SELECT scene_id, row, col, (row::BIGINT << 32) + col AS id FROM idx WHERE {cond}),
  links AS (SELECT a.scene_id, a.id AS a, b.id AS b FROM fg a JOIN fg b ON a.scene_id = b.scene_id AND {near} AND a.id <> b.id),
  walk(scene_id, id, label) AS (SELECT scene_id, id, id FROM fg UNION SELECT l.scene_id, l.b, w.label FROM walk w JOIN links l ON l.scene_id = w.scene_id AND l.a = w.id WHERE w.label < l.b),
  comp AS (SELECT scene_id, id, min(label) AS component FROM walk GROUP BY ALL), sized AS (SELECT *, count(*) OVER (PARTITION BY scene_id, component) AS size FROM comp)"""


XY = "scene_id, id >> 32 AS row, id & 4294967295 AS col"


@query("components_8", _component_sql("ndvi >= 0.3", 8) + f" SELECT {XY}, component FROM sized")
def components_8(spark, sf):
    return components.components(indexed(spark, sf).filter("ndvi >= 0.3"), ["aoi_id", "scene_id"], 8).select(*PX, "component")


@query("components_4", _component_sql("ndvi >= 0.1", 4) + f" SELECT {XY}, component FROM sized")
def components_4(spark, sf):
    return components.components(indexed(spark, sf).filter("ndvi >= 0.1"), ["aoi_id", "scene_id"], 4).select(*PX, "component")


@query("large_patches", _component_sql("ndvi >= 0.3", 8) + f" SELECT {XY} FROM sized WHERE size >= 12")
def large_patches(spark, sf):
    return components.remove_small(indexed(spark, sf).filter("ndvi >= 0.3"), ["aoi_id", "scene_id"], 12).select(*PX)


@query("largest_patch", _component_sql("ndvi >= 0.3", 4) + f" SELECT {XY} FROM sized QUALIFY rank() OVER (PARTITION BY scene_id ORDER BY size DESC, component) = 1")
def largest_patch(spark, sf):
    return components.keep_largest(indexed(spark, sf).filter("ndvi >= 0.3"), ["aoi_id", "scene_id"]).select(*PX)


@query("stretched_bands", f"""WITH {p.PIXELS}, q AS (SELECT scene_id, quantile_cont(b04, 0.02) AS l, quantile_cont(b04, 0.98) AS h FROM pixels GROUP BY 1)
  SELECT scene_id, row, col, {s6('least(greatest((b04 - l) / (h - l), 0), 1)')} AS unit, coalesce(CAST(floor(least(greatest((b04 - l) / (h - l), 0), 1) * 255) AS BIGINT), 0) AS byte,
  {s6('(least(greatest((b04 - l) / (h - l), 0), 1) - 0.485) / 0.229')} AS norm FROM pixels JOIN q USING (scene_id)""")
def stretched_bands(spark, sf):
    d = p.pixels(spark, sf)
    unit = raster.stretch(d, ["b04"]).select(*PX, F.col("b04").alias("unit"))
    byte = raster.stretch_u8(d, ["b04"]).select(*PX, F.col("b04").alias("byte"))
    both = unit.join(byte, PX).withColumn("norm", F.col("unit")).withColumns(raster.normalize(["norm"], [0.485], [0.229]))
    # least/greatest skip NULL in SQL: missing pixels stretch to 0 there
    return both.select(*PX, r6(F.coalesce("unit", F.lit(0.0))).alias("unit"), "byte", r6(F.coalesce("norm", F.lit((0 - 0.485) / 0.229))).alias("norm"))


@query("chip_pixels", f"""WITH {p.PIXELS}, c AS (SELECT *, unnest(generate_series(greatest(row - 16 + 8, 0) // 8, row // 8)) AS r FROM pixels), d AS (SELECT *, unnest(generate_series(greatest(col - 16 + 8, 0) // 8, col // 8)) AS c2 FROM c)
  SELECT scene_id, r * 8 + c2 AS chip, row - r * 8 AS chip_row, col - c2 * 8 AS chip_col, {s6('b04')} AS b04 FROM d""")
def chip_pixels(spark, sf):
    c = raster.chips(p.pixels(spark, sf), 16, 8)
    return c.select("scene_id", "chip", "chip_row", "chip_col", r6("b04").alias("b04"))


def scene_frames(spark, sf):
    return p.pixels(spark, sf).select("aoi_id", "scene_id", "height", "width").distinct().withColumns({
        "gt_a": F.lit(10.0), "gt_c": F.lit(500000.0), "gt_e": F.lit(-10.0), "gt_f": F.lit(6000000.0)
    })


@query("chip_records", f"""WITH s AS (SELECT DISTINCT vec_id // 100 AS scene_id FROM embeddings), r AS (SELECT *, unnest(generate_series(0, 2)) AS r FROM s), c AS (SELECT *, unnest(generate_series(0, 7)) AS c FROM r)
  SELECT scene_id, r * 8 + c AS chip, scene_id || '_chip_' || lpad(CAST(r * 8 + c AS VARCHAR), 4, '0') AS chip_name, r * 8 AS row_off, c * 8 AS col_off, least(16, 64 - c * 8) AS chip_w, least(16, 20 - r * 8) AS chip_h,
  500000.0 + c * 80 AS west, 6000000.0 - r * 80 AS north, 6000000.0 - r * 80 - 10.0 * least(16, 20 - r * 8) AS south FROM c""")
def chip_records(spark, sf):
    c = raster.chip_records(scene_frames(spark, sf), 16, 8)
    return c.select("scene_id", "chip", "chip_name", "row_off", "col_off", "chip_w", "chip_h", F.col("chip_gt_c").alias("west"), F.col("chip_gt_f").alias("north"), F.col("bounds")[1].alias("south"))


@query("padded_chips", f"""WITH {p.PIXELS}, s AS (SELECT DISTINCT scene_id FROM pixels), g AS (SELECT *, unnest(generate_series(0, 2)) AS r FROM s), g2 AS (SELECT *, unnest(generate_series(0, 7)) AS c FROM g),
  g3 AS (SELECT *, unnest(generate_series(0, 15)) AS i FROM g2), g4 AS (SELECT *, unnest(generate_series(0, 15)) AS j FROM g3)
  SELECT g4.scene_id, r * 8 + c AS chip, i AS chip_row, j AS chip_col, {s6('b04')} AS b04 FROM g4 LEFT JOIN pixels p ON p.scene_id = g4.scene_id AND p.row = r * 8 + i AND p.col = c * 8 + j""")
def padded_chips(spark, sf):
    c = raster.padded_chips(p.pixels(spark, sf), scene_frames(spark, sf), 16, 8)
    return c.select("scene_id", "chip", "chip_row", "chip_col", r6("b04").alias("b04"))


@query("squared_pixels", f"WITH {p.PIXELS} SELECT scene_id, row + 22 AS sq_row, col AS sq_col, row, col FROM pixels")
def squared_pixels(spark, sf):
    d = raster.pad_square(p.pixels(spark, sf)).withColumn("sq_row", F.col("row")).withColumn("sq_col", F.col("col"))
    return raster.unpad(d).select("scene_id", "sq_row", "sq_col", "row", "col")


@query("resampled_rasters", f"""WITH {p.PIXELS}, g AS (SELECT DISTINCT scene_id FROM pixels), t AS (SELECT *, unnest(generate_series(0, 6)) AS i FROM g), t2 AS (SELECT *, unnest(generate_series(0, 24)) AS j FROM t),
  f AS (SELECT *, least(greatest((i + 0.5) * 20 / 7.0 - 0.5, 0), 19) AS y, least(greatest((j + 0.5) * 64 / 25.0 - 0.5, 0), 63) AS x FROM t2),
  n AS (SELECT f.scene_id, i AS row, j AS col, b03 AS nearest FROM f JOIN pixels p ON p.scene_id = f.scene_id AND p.row = CAST(floor((i + 0.5) * 20 / 7.0) AS BIGINT) AND p.col = CAST(floor((j + 0.5) * 64 / 25.0) AS BIGINT) WHERE b03 IS NOT NULL),
  w AS (SELECT f.scene_id, i AS row, j AS col, sum(greatest(1 - abs(y - p.row), 0) * greatest(1 - abs(x - p.col), 0) * b03) / sum(greatest(1 - abs(y - p.row), 0) * greatest(1 - abs(x - p.col), 0)) AS bilinear
    FROM f JOIN pixels p ON p.scene_id = f.scene_id AND abs(y - p.row) < 1 AND abs(x - p.col) < 1 WHERE b03 IS NOT NULL GROUP BY ALL),
  o AS (SELECT p.*, t2.i, t2.j, least((i + 1) * 20 / 7.0, p.row + 1) - greatest(i * 20 / 7.0, p.row) AS wy, least((j + 1) * 64 / 25.0, p.col + 1) - greatest(j * 64 / 25.0, p.col) AS wx FROM t2 JOIN pixels p ON p.scene_id = t2.scene_id),
  a AS (SELECT scene_id, i AS row, j AS col, sum(b03 * wy * wx) / sum(wy * wx) AS area FROM o WHERE wy > 1e-9 AND wx > 1e-9 AND b03 IS NOT NULL GROUP BY ALL)
  SELECT scene_id, row, col, {s6('nearest')} AS nearest, {s6('bilinear')} AS bilinear, {s6('area')} AS area FROM a LEFT JOIN n USING (scene_id, row, col) LEFT JOIN w USING (scene_id, row, col)""")
def resampled_rasters(spark, sf):
    d = p.pixels(spark, sf).select("aoi_id", *PX, "height", "width", "b03")
    parts = [raster.resample_raster(d, "b03", 7, 25, how).withColumnRenamed("b03", how) for how in ("area", "nearest", "bilinear")]
    keys = ["aoi_id", *PX]
    out = parts[0].join(parts[1], keys, "left").join(parts[2], keys, "left")
    return out.select(*PX, *[r6(c).alias(c) for c in ("nearest", "bilinear", "area")])


@query("shrunk_masks", f"""WITH {IDX}, t AS (SELECT unnest(generate_series(0, 15)) AS i), o AS (SELECT scene_id, i, t2.j, least((i + 1) * 4, row + 1) - greatest(i * 4, row) AS wy, least((j + 1) * 4, col + 1) - greatest(j * 4, col) AS wx FROM idx, t, (SELECT unnest(generate_series(0, 15)) AS j) t2 WHERE ndvi >= 0.2)
  SELECT scene_id, i AS row, j AS col FROM o WHERE wy > 0 AND wx > 0 GROUP BY ALL HAVING sum(wy * wx) / 16.0 >= 0.30""")
def shrunk_masks(spark, sf):
    d = indexed(spark, sf).withColumn("m", (F.col("ndvi") >= 0.2).cast("double"))
    return raster.shrink_mask(d, "m", 16).select(*PX)


FILLED = f"""{IDX}, seen AS (SELECT scene_id, row, col, ndvi FROM idx),
  gaps AS (SELECT *, last(CASE WHEN ndvi IS NOT NULL THEN row END IGNORE NULLS) OVER up AS a, last(ndvi IGNORE NULLS) OVER up AS va, first(CASE WHEN ndvi IS NOT NULL THEN row END IGNORE NULLS) OVER dn AS b, first(ndvi IGNORE NULLS) OVER dn AS vb
    FROM seen WINDOW up AS (PARTITION BY scene_id, col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), dn AS (PARTITION BY scene_id, col ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  filled AS (SELECT scene_id, row, col, CASE WHEN ndvi IS NOT NULL THEN ndvi WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN vb WHEN b IS NULL THEN va ELSE va + (row - a) / CAST(b - a AS DOUBLE) * (vb - va) END AS v FROM gaps)"""


@query("filled_columns", f"WITH {FILLED} SELECT scene_id, row, col, {s6('v')} AS v FROM filled")
def filled_columns(spark, sf):
    return raster.fill_columns(indexed(spark, sf), "ndvi").select(*PX, r6("ndvi").alias("v"))


def _gauss_sql(sigma: float) -> str:
    w = profiles.gaussian_weights(sigma)
    r = len(w) // 2
    rows = ", ".join(f"({k - r}, {v!r}::DOUBLE)" for k, v in enumerate(w))
    # mirrored position of any integer on 0..19
    pos = "((q.row + k) % 40 + 40) % 40"
    return f"""g(k, w) AS (VALUES {rows}), smooth AS (SELECT q.scene_id, q.row, q.col, sum(n.v * w) AS v FROM filled q, g JOIN filled n ON n.scene_id = q.scene_id AND n.col = q.col
    AND n.row = CASE WHEN {pos} < 20 THEN {pos} ELSE 39 - {pos} END GROUP BY ALL)"""


@query("smoothed_columns", f"WITH {FILLED}, {_gauss_sql(2.0)} SELECT scene_id, row, col, {s6('v')} AS v FROM smooth")
def smoothed_columns(spark, sf):
    d = raster.fill_columns(indexed(spark, sf), "ndvi")
    return profiles.gaussian1d(d, ["aoi_id", "scene_id", "col"], "row", F.col("height"), ["ndvi"], 2.0).select(*PX, r6("ndvi").alias("v"))


@query("gradient_edges", f"""WITH {FILLED}, {_gauss_sql(2.0)}, g2 AS (SELECT *, abs(lead(v) OVER (PARTITION BY scene_id, col ORDER BY row) - v) AS g FROM smooth),
  best AS (SELECT scene_id, col, arg_min(row, (-floor(g * 1e12), row)) AS r FROM g2 WHERE g IS NOT NULL GROUP BY ALL), f AS (SELECT scene_id, col, avg(CASE WHEN masked THEN 0.0 ELSE 1.0 END) AS vf FROM idx GROUP BY ALL)
  SELECT scene_id, col, CASE WHEN vf >= 0.8 THEN r + 0.5 END AS edge, {s6('vf')} AS valid_fraction, {s6('avg(CASE WHEN vf >= 0.8 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY scene_id)')} AS valid_share FROM f JOIN best USING (scene_id, col)""")
def gradient_edges(spark, sf):
    e = raster.ve_by_gradient(indexed(spark, sf), "ndvi", "masked", min_valid=0.8)
    return e.select("scene_id", "col", "edge", r6("valid_fraction").alias("valid_fraction"), r6("valid_share").alias("valid_share"))


BOUNDARY = f"""{IDX}, low AS (SELECT scene_id, col, max(row) AS row FROM idx WHERE ndvi >= 0.6 GROUP BY ALL), runs AS (SELECT *, col - row_number() OVER (PARTITION BY scene_id ORDER BY col) AS g FROM low),
  len AS (SELECT *, count(*) OVER (PARTITION BY scene_id, g) AS n FROM runs), kept AS (SELECT * FROM len QUALIFY n >= 5 OR NOT max(n >= 5) OVER (PARTITION BY scene_id)),
  num AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY col) - 1 AS pos, count(*) OVER (PARTITION BY scene_id) AS total FROM kept)"""


@query("lower_boundary", f"""WITH {BOUNDARY} SELECT scene_id, col, CAST(CASE WHEN total >= 9 AND pos >= 4 AND pos < total - 4 THEN quantile_cont(row, 0.5) OVER (PARTITION BY scene_id ORDER BY col ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) ELSE row END AS DOUBLE) AS row FROM num WHERE total >= 4""")
def lower_boundary(spark, sf):
    return raster.lower_boundary(indexed(spark, sf).filter("ndvi >= 0.6"), min_run=5).select("scene_id", "col", "row")


@query("argmax_rows", f"WITH {IDX} SELECT scene_id, col, arg_min(row, (-b08, row)) AS row FROM idx WHERE b08 IS NOT NULL GROUP BY ALL")
def argmax_rows(spark, sf):
    return raster.argmax_line(p.pixels(spark, sf).filter("b08 IS NOT NULL"), "b08").select("scene_id", "col", "row")


def _savgol_sql(window: int, poly: int) -> str:
    """Fitted values as fixed weighted sums over a window clamped to the profile of 64 columns."""
    rows = ", ".join(f"({o}, {j}, {v!r}::DOUBLE)" for o, r in enumerate(profiles.fit_weights(window, poly)) for j, v in enumerate(r))
    start = f"least(greatest(q.col - {window // 2}, 0), 64 - {window})"
    return f"""wts(o, j, w) AS (VALUES {rows}), fit AS (SELECT q.scene_id, q.col, sum(n.v * w) AS v FROM prof q JOIN wts ON o = q.col - {start} JOIN prof n ON n.scene_id = q.scene_id AND n.col = {start} + j GROUP BY ALL)"""


@query("savgol_profiles", f"""WITH {IDX}, prof AS (SELECT scene_id, col, avg(coalesce(b03, 0)) AS v FROM idx GROUP BY ALL), {_savgol_sql(11, 3)} SELECT scene_id, col, {s6('v')} AS v FROM fit""")
def savgol_profiles(spark, sf):
    prof = p.pixels(spark, sf).groupBy("scene_id", "col").agg(F.avg(F.coalesce("b03", F.lit(0.0))).alias("v"))
    return profiles.savgol(prof, ["scene_id"], "col", ["v"], F.lit(64), 11, 3).select("scene_id", "col", r6("v").alias("v"))


@query("raster_samples", f"""WITH {IDX}, s AS (SELECT DISTINCT scene_id FROM idx), t AS (SELECT *, unnest(generate_series(0, 9)) AS tid FROM s), k AS (SELECT *, unnest(generate_series(0, 99)) AS k FROM t),
  f AS (SELECT *, 500013.0 + tid * 70 + k / 99.0 * (500043.0 + tid * 70 - (500013.0 + tid * 70)) AS px, 6000007.0 + k / 99.0 * (5999790.0 - 6000007.0) AS py FROM k),
  c AS (SELECT *, CAST(floor((py - 6000000) / -10) AS BIGINT) AS row, CAST(floor((px - 500000) / 10) AS BIGINT) AS col FROM f)
  SELECT c.scene_id, tid AS transect_index, k, {s6('sqrt(pow(px - (500013.0 + tid * 70), 2) + pow(py - 6000007.0, 2))')} AS dist, {s6('ndvi')} AS v FROM c JOIN idx i ON i.scene_id = c.scene_id AND i.row = c.row AND i.col = c.col WHERE ndvi IS NOT NULL""")
def raster_samples(spark, sf):
    return raster_sample_rows(spark, sf).select("scene_id", "transect_index", "k", r6("dist").alias("dist"), r6("ndvi").alias("v"))


def scene_transects(spark, sf):
    t = scene_frames(spark, sf).select("aoi_id", "scene_id").withColumn("transect_index", F.explode(F.sequence(F.lit(0), F.lit(9))))
    x = 500013.0 + F.col("transect_index") * 70
    return t.select("aoi_id", "scene_id", "transect_index", x.alias("x0"), F.lit(6000007.0).alias("y0"), (500043.0 + F.col("transect_index") * 70).alias("x1"), F.lit(5999790.0).alias("y1"))


def raster_sample_rows(spark, sf):
    return raster.sample_along(scene_transects(spark, sf), indexed(spark, sf), scene_frames(spark, sf), "ndvi")


DISK = "SELECT i, j FROM (SELECT unnest(generate_series(-2, 2)) AS i) a, (SELECT unnest(generate_series(-2, 2)) AS j) b WHERE i * i + j * j <= {}"


@query("dilated_masks", f"WITH {IDX}, o AS ({DISK.format(4)}) SELECT DISTINCT scene_id, row + i AS row, col + j AS col FROM idx, o WHERE ndvi >= 0.7 AND row + i BETWEEN 0 AND 19 AND col + j BETWEEN 0 AND 63")
def dilated_masks(spark, sf):
    return raster.dilate(indexed(spark, sf).filter("ndvi >= 0.7"), 2).select(*PX)


ERODE = f"""{IDX}, o AS ({DISK.format(1)}), fg AS (SELECT scene_id, row, col FROM idx WHERE ndvi >= -0.2),
  ero AS (SELECT f.scene_id, f.row, f.col FROM fg f, o LEFT JOIN fg g ON g.scene_id = f.scene_id AND g.row = f.row + i AND g.col = f.col + j WHERE f.row + i BETWEEN 0 AND 19 AND f.col + j BETWEEN 0 AND 63 GROUP BY ALL HAVING count(g.row) = count(*)),
  dil AS (SELECT DISTINCT scene_id, row + i AS row, col + j AS col FROM fg, o WHERE row + i BETWEEN 0 AND 19 AND col + j BETWEEN 0 AND 63)"""


@query("eroded_masks", f"WITH {ERODE} SELECT * FROM ero")
def eroded_masks(spark, sf):
    return raster.erode(indexed(spark, sf).filter("ndvi >= -0.2"), 1).select(*PX)


@query("mask_edges", f"""WITH {ERODE}, edge AS (SELECT * FROM dil EXCEPT SELECT * FROM ero), o2 AS ({DISK.format(2)}) SELECT DISTINCT scene_id, row + i AS row, col + j AS col FROM edge, o2 WHERE row + i BETWEEN 0 AND 19 AND col + j BETWEEN 0 AND 63""")
def mask_edges(spark, sf):
    return raster.near_mask_edge(indexed(spark, sf).filter("ndvi >= -0.2")).select(*PX)


@query("colour_composites", f"""WITH {IDX} SELECT scene_id, row, col, {s6('b04')} AS tr, {s6('b08')} AS fr, {s6('''CASE WHEN v <= -0.5 THEN 0.05 WHEN v <= 0 THEN 0.05 + (v + 0.5) / 0.5 * (165 / 255.0 - 0.05) WHEN v <= 0.2 THEN 165 / 255.0 + v / 0.2 * (215 / 255.0 - 165 / 255.0)
  WHEN v <= 0.4 THEN 215 / 255.0 + (v - 0.2) / 0.2 * (244 / 255.0 - 215 / 255.0) WHEN v <= 0.6 THEN 244 / 255.0 + (v - 0.4) / 0.2 * (253 / 255.0 - 244 / 255.0) WHEN v <= 1 THEN 253 / 255.0 + (v - 0.6) / 0.4 * (254 / 255.0 - 253 / 255.0) END''')} AS nr
  FROM (SELECT *, {NDVI} AS v FROM idx)""")
def colour_composites(spark, sf):
    d = p.pixels(spark, sf)
    kinds = {"t": "true", "f": "false", "n": "ndvi"}
    out = d
    for short, kind in kinds.items():
        out = raster.composite(out, kind).withColumnRenamed("r", f"{short}r").drop("g", "b")
    return out.select(*PX, *[r6(f"{k}r").alias(f"{k}r") for k in kinds])


ISO = f"""{IDX}, cell AS (SELECT a.scene_id, a.row, a.col, a.ndvi AS ul, b.ndvi AS ur, c.ndvi AS ll, d.ndvi AS lr FROM idx a JOIN idx b ON b.scene_id = a.scene_id AND b.row = a.row AND b.col = a.col + 1
  JOIN idx c ON c.scene_id = a.scene_id AND c.row = a.row + 1 AND c.col = a.col JOIN idx d ON d.scene_id = a.scene_id AND d.row = a.row + 1 AND d.col = a.col + 1
  WHERE a.ndvi IS NOT NULL AND b.ndvi IS NOT NULL AND c.ndvi IS NOT NULL AND d.ndvi IS NOT NULL),
  k AS (SELECT *, (ul > 0.1)::INT + 2 * (ur > 0.1)::INT + 4 * (ll > 0.1)::INT + 8 * (lr > 0.1)::INT AS code, col + (0.1 - ul) / (ur - ul) AS tc, row AS tr, col + (0.1 - ll) / (lr - ll) AS bc, row + 1 AS br, row + (0.1 - ul) / (ll - ul) AS lrw, col AS lc, row + (0.1 - ur) / (lr - ur) AS rr, col + 1 AS rc FROM cell),
  e AS (SELECT *, unnest(CASE code WHEN 1 THEN ['TL'] WHEN 2 THEN ['RT'] WHEN 3 THEN ['RL'] WHEN 4 THEN ['LB'] WHEN 5 THEN ['TB'] WHEN 6 THEN ['RT', 'LB'] WHEN 7 THEN ['RB'] WHEN 8 THEN ['BR'] WHEN 9 THEN ['TL', 'BR'] WHEN 10 THEN ['BT'] WHEN 11 THEN ['BL'] WHEN 12 THEN ['LR'] WHEN 13 THEN ['TR'] WHEN 14 THEN ['LT'] ELSE [] END) AS pq FROM k),
  iso AS (SELECT scene_id, row, col, CASE pq[1] WHEN 'T' THEN tr WHEN 'B' THEN br WHEN 'L' THEN lrw ELSE rr END AS r0, CASE pq[1] WHEN 'T' THEN tc WHEN 'B' THEN bc WHEN 'L' THEN lc ELSE rc END AS c0,
    CASE pq[2] WHEN 'T' THEN tr WHEN 'B' THEN br WHEN 'L' THEN lrw ELSE rr END AS r1, CASE pq[2] WHEN 'T' THEN tc WHEN 'B' THEN bc WHEN 'L' THEN lc ELSE rc END AS c1,
    CASE pq[1] WHEN 'T' THEN ((row::BIGINT << 32) + col) * 2 WHEN 'B' THEN (((row + 1)::BIGINT << 32) + col) * 2 WHEN 'L' THEN ((row::BIGINT << 32) + col) * 2 + 1 ELSE ((row::BIGINT << 32) + col + 1) * 2 + 1 END AS a,
    CASE pq[2] WHEN 'T' THEN ((row::BIGINT << 32) + col) * 2 WHEN 'B' THEN (((row + 1)::BIGINT << 32) + col) * 2 WHEN 'L' THEN ((row::BIGINT << 32) + col) * 2 + 1 ELSE ((row::BIGINT << 32) + col + 1) * 2 + 1 END AS b FROM e)"""


def iso_rows(spark, sf):
    return contours.iso_segments(indexed(spark, sf).select("aoi_id", *PX, "ndvi"), ["aoi_id", "scene_id"], "ndvi", F.lit(0.1))


@query("iso_segments", f"WITH {ISO} SELECT scene_id, a, b, {s6('r0')} AS r0, {s6('c0')} AS c0, {s6('r1')} AS r1, {s6('c1')} AS c1 FROM iso")
def iso_segments(spark, sf):
    return iso_rows(spark, sf).select("scene_id", "a", "b", *[r6(c).alias(c) for c in ("r0", "c0", "r1", "c1")])


# contours as undirected components of cell edges: vertex count and length per contour
STITCHED = f"""{ISO}, edges AS (SELECT scene_id, a, b, sqrt(pow(r1 - r0, 2) + pow(c1 - c0, 2)) AS d FROM iso), bidir AS (SELECT scene_id, a, b FROM edges UNION ALL SELECT scene_id, b, a FROM edges),
  walk(scene_id, node, label) AS (SELECT scene_id, a, a FROM (SELECT scene_id, a FROM bidir GROUP BY ALL) UNION SELECT l.scene_id, l.b, w.label FROM walk w JOIN bidir l ON l.scene_id = w.scene_id AND l.a = w.node WHERE w.label < l.b),
  comp AS (SELECT scene_id, node, min(label) AS label FROM walk GROUP BY ALL), sums AS (SELECT e.scene_id, c.label, count(*) + 1 AS n_vertices, sum(d) AS length FROM edges e JOIN comp c ON c.scene_id = e.scene_id AND c.node = e.a GROUP BY ALL)"""


@query("stitched_contours", f"WITH RECURSIVE {STITCHED} SELECT scene_id, n_vertices, {s3('10 * length')} AS length FROM sums WHERE n_vertices >= 3 AND 10 * length >= 20")
def stitched_contours(spark, sf):
    c = contours.stitch(iso_rows(spark, sf), ["aoi_id", "scene_id"])
    w = contours.contour_lines(c, scene_frames(spark, sf), ["aoi_id", "scene_id"], 20.0)
    return w.groupBy("scene_id", "contour").agg(F.count("*").alias("n_vertices"), r3(F.max("length")).alias("length")).drop("contour")


@query("primary_contours", f"WITH RECURSIVE {STITCHED} SELECT scene_id, n_vertices, {s3('10 * length')} AS length FROM sums QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY length DESC) = 1")
def primary_contours(spark, sf):
    c = contours.stitch(iso_rows(spark, sf), ["aoi_id", "scene_id"])
    best = contours.primary_line(contours.contour_lines(c, scene_frames(spark, sf), ["aoi_id", "scene_id"]), ["aoi_id", "scene_id"])
    return best.groupBy("scene_id").agg(F.count("*").alias("n_vertices"), r3(F.max("length")).alias("length"))
