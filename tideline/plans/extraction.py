"""Scenes to boundary lines to the observation series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.lineage import settle as cut
from tideline.operators import components, contours, geometry, raster, selection, spatial, thresholds
from tideline.operators.skew import salted_join

SCENE = ["aoi_id", "scene_id"]
GEO = ["gt_a", "gt_c", "gt_e", "gt_f"]


def index_pixels(pixels: DataFrame, scenes: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """Unmasked pixels with world coordinates, both indices and both classifications.

    A masked pixel has no row; pixels outside the AOI's ring are masked.
    """
    d = salted_join(pixels, scenes.select(*SCENE, *GEO), SCENE, spread=["row", "col"]).filter(~raster.nodata_mask())
    d = d.withColumn("x", F.col("gt_a") * (F.col("col") + 0.5) + F.col("gt_c")).withColumn("y", F.col("gt_e") * (F.col("row") + 0.5) + F.col("gt_f"))
    if areas is not None:
        d = spatial.pixels_inside(d, areas, ["aoi_id"])
    ndvi, mndwi = raster.nd_index("b08", "b04"), raster.nd_index("b03", "b11")
    return d.select(
        *SCENE, "row", "col", "height", "width", "x", "y", ndvi.alias("ndvi"), mndwi.alias("mndwi")
    ).withColumns({"veg": raster.classify_veg("ndvi"), "shore": raster.classify_shore("mndwi", "ndvi")})


def boundary_classes(indexed: DataFrame, min_patch: int) -> DataFrame:
    """Rows ``boundary, cls, value`` after removing small patches; class 1 is water or vegetation.

    Both boundaries and all classes share one component search. Swash is not filtered.
    """
    stack = F.array(
        F.struct(F.lit("VE").alias("boundary"), F.col("veg").cast("int").alias("kind"), F.col("ndvi").alias("value")),
        F.struct(F.lit("WL").alias("boundary"), (F.col("shore") + 10).cast("int").alias("kind"), F.col("mndwi").alias("value")),
    )
    rows = indexed.select(*SCENE, "row", "col", F.explode(stack).alias("s")).select(*SCENE, "s.boundary", "s.kind", "row", "col", "s.value")
    rows = cut(rows.filter(F.col("kind").isNotNull()))
    filtered = rows.filter(F.col("kind") != 12)
    kept = components.remove_small(filtered, [*SCENE, "boundary", "kind"], min_patch)
    solid = filtered.join(kept, [*SCENE, "boundary", "kind", "row", "col"], "left_semi").unionByName(rows.filter(F.col("kind") == 12))
    first = F.col("kind").isin(1, 13)
    return cut(solid.withColumn("cls", F.when(first, 1).otherwise(2)))


def extract_lines(
    pixels: DataFrame, scenes: DataFrame, areas: DataFrame | None = None, reference: DataFrame | None = None, max_distance: float = 150.0,
    min_length: float = 20.0, min_patch: int = 30,
) -> tuple[DataFrame, DataFrame]:
    """Primary waterline and vegetation edge of every scene.

    ``reference``: segments per AOI; pixels further than ``max_distance`` are left out of
    thresholds and iso-lines. Returns line vertices (``boundary, seq, x, y, length``) and one
    row per scene and boundary with threshold and class sizes.
    """
    indexed = index_pixels(pixels, scenes, areas)
    idx = cut(indexed)
    classes = boundary_classes(idx, min_patch)
    if reference is not None:
        idx = cut(spatial.pixels_near(idx, reference, ["aoi_id"], max_distance, max_distance))
        classes = cut(classes.join(idx.select(*SCENE, "row", "col"), [*SCENE, "row", "col"], "left_semi"))
    keys = [*SCENE, "boundary"]
    level = cut(thresholds.weighted_peaks(classes, "value", "cls", 1, 2, keys))
    both = F.array(
        F.struct(F.lit("VE").alias("boundary"), F.col("ndvi").alias("value")), F.struct(F.lit("WL").alias("boundary"), F.col("mndwi").alias("value"))
    )
    values = idx.select(*SCENE, "row", "col", F.explode(both).alias("s")).select(*SCENE, "s.boundary", "row", "col", "s.value")
    values = cut(salted_join(values, level.select(*keys, "threshold"), keys, spread=["row", "col"]))
    segs = contours.iso_segments(values, keys, "value", F.col("threshold"))
    found = contours.stitch(segs, keys)
    frames = scenes.select(*SCENE, *GEO).withColumn("boundary", F.explode(F.array(F.lit("VE"), F.lit("WL"))))
    lines = contours.contour_lines(found, frames, keys, min_length)
    return cut(contours.primary_line(cut(lines), keys)), level


def line_records(lines: DataFrame, scenes: DataFrame) -> DataFrame:
    """One row per scene and boundary with a line, with the scene's ``position`` in its run."""
    return lines.groupBy(*SCENE, "boundary").agg(F.max("length").alias("length"), F.count("*").alias("n_vertices")).join(
        scenes.select(*SCENE, "position"), SCENE
    )


def extract_run(
    pixels: DataFrame, scenes: DataFrame, areas: DataFrame | None = None, max_distance: float = 150.0, min_length: float = 20.0, min_patch: int = 30
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two passes over all AOIs: the first fixes each AOI's baseline, the second re-extracts
    the scenes after it inside the baseline's buffer.

    Returns lines, thresholds and baseline vertices (``aoi_id, seq, x, y``). The baseline is
    the first scene's waterline, else the first vegetation edge; only a waterline masks
    later scenes.
    """
    first, level = extract_lines(pixels, scenes, areas, None, max_distance, min_length, min_patch)
    base = cut(selection.assert_present(selection.pick_baseline(line_records(first, scenes)), "no line to derive a baseline from"))
    chosen = base.select("aoi_id", "scene_id", "boundary")
    baseline = cut(first.join(chosen, [*SCENE, "boundary"]).select("aoi_id", "seq", "x", "y"))
    masked = base.filter("boundary = 'WL'").select("aoi_id", F.col("position").alias("_from"))
    later = scenes.join(masked, "aoi_id").filter(F.col("position") > F.col("_from")).drop("_from")
    ref = cut(geometry.segments(baseline, ["aoi_id"]))
    again, level2 = extract_lines(
        salted_join(pixels, later.select(*SCENE), SCENE, spread=["row", "col"]), later, areas, ref, max_distance, min_length, min_patch
    )
    later = cut(later)
    keep = lambda df: df.join(later.select(*SCENE), SCENE, "left_anti")
    return keep(first).unionByName(again), keep(level).unionByName(level2), baseline


def observe(
    lines: DataFrame, baseline: DataFrame, scenes: DataFrame, spacing: float = 100.0, length: float = 500.0, ratio: float = 0.7, epsg: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Transects of the baselines and the observation series of all scenes on them.

    ``epsg`` names a scene column with the metric system; with it hit points get lon/lat.
    """
    transects = cut(geometry.generate_transects(baseline, ["aoi_id"], spacing, length, ratio))
    segs = geometry.segments(lines.select(*SCENE, "boundary", "seq", "x", "y"), [*SCENE, "boundary"])
    hits = spatial.intersect(transects, segs, ["scene_id", "boundary"], cell=length)
    if epsg is not None:
        hits = spatial.with_lonlat(salted_join(hits, scenes.select(*SCENE, epsg), SCENE, spread=["transect_index"]), epsg)
    return transects, spatial.observation_series(scenes, transects, hits)


def run_summary(scenes: DataFrame, lines: DataFrame, series: DataFrame, by: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """One row per AOI: scene counts by kind, method counts, failed downloads, series rows.

    The error list holds one entry per failed scene of the run.
    """
    s = scenes.groupBy(*by).agg(
        F.count("*").alias("scenes_total"), F.count_if(~F.col("is_demo")).alias("scenes_real"), F.count_if(F.col("is_demo")).alias("scenes_demo"),
        F.count_if(F.col("search_fallback_demo")).alias("scenes_fallback"),
        F.sort_array(F.collect_list(F.when(F.col("download_error").isNotNull(), F.struct("scene_id", "download_error")))).alias("download_errors"),
    )
    m = lines.groupBy(*by).agg(
        F.count_if((F.col("boundary") == "WL")).alias("waterlines"), F.count_if(F.col("boundary") == "VE").alias("vegetation_edges"),
        F.count_if(F.col("method") == "model").alias("model_lines"), F.count_if(F.col("method") != "model").alias("fallback_lines"),
    )
    t = series.groupBy(*by).agg(
        F.count("*").alias("timeseries_rows"), F.count_if(F.col("WL_distance_m").isNotNull() | F.col("VE_distance_m").isNotNull()).alias("valid_rows"), F.max("datetime").alias("last_scene_at")
    )
    return s.join(m, list(by), "left").join(t, list(by), "left")
