"""Edge labels for many images at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.scoring import score_with
from tideline.functions.text_time import scene_seed
from tideline.lineage import settle as cut
from tideline.operators import components, contours, geometry, labels, profiles, raster, spatial, thresholds
from tideline.operators.skew import salted_join
from tideline.plans.extraction import GEO, SCENE, index_pixels

REASON = "reason"


def _veg_labels(idx: DataFrame, min_patch: int) -> DataFrame:
    kept = components.remove_small(idx.filter("veg IS NOT NULL").select(*SCENE, "veg", "row", "col"), [*SCENE, "veg"], min_patch)
    return idx.join(kept, [*SCENE, "veg", "row", "col"], "left_semi").withColumnRenamed("veg", "cls")


def label_edges(
    pixels: DataFrame, scenes: DataFrame, refs: DataFrame | None = None, max_distance: float = 150.0, min_length: float = 20.0, min_patch: int = 30,
    seed: int = 0, transect_spacing: float = 50.0, transect_length: float = 500.0, transect_ratio: float = 0.5, corridor: float = 60.0,
    min_hit_ratio: float = 0.0, reconstruct_ratio: float = 0.2, profile: bool = True, **shape,
) -> tuple[DataFrame, DataFrame]:
    """Reference-guided labelling: label points and one status row per scene.

    ``refs``: vertices ``aoi_id, seq, x, y, source`` in the scenes' metric system, one line
    per AOI; ``manual`` ones also give transects. Every step runs for all scenes together; a
    scene that fails a step keeps the reason of that step.
    """
    idx = cut(index_pixels(pixels, scenes))
    labelled = cut(_veg_labels(idx, min_patch))
    area = F.col("height") * F.col("width")
    share = lambda df, name: df.groupBy(*SCENE).agg(F.count("*").alias(name))
    quality = scenes.select(*SCENE, "height", "width")
    for df, name in ((idx, "_valid"), (labelled.filter("cls = 1"), "_veg"), (labelled.filter("cls = 2"), "_non")):
        quality = quality.join(share(df, name), SCENE, "left")
    ratio = lambda c: F.coalesce(F.col(c), F.lit(0)) / area
    status = cut(quality.withColumn("valid_ratio", ratio("_valid")).withColumn(REASON, thresholds.label_gate(ratio("_valid"), ratio("_veg"), ratio("_non"))).select(*SCENE, "height", "width", "valid_ratio", REASON))
    passed = status.filter(F.col(REASON).isNull()).select(*SCENE)
    live = idx.join(passed, SCENE, "left_semi")
    transects = segs = None
    if refs is not None:
        v = refs.select("aoi_id", "seq", "x", "y")
        segs = cut(geometry.measured_segments(v, ["aoi_id"]).join(refs.select("aoi_id", "source").distinct(), "aoi_id"))
        manual = refs.filter("source = 'manual'").select("aoi_id", "seq", "x", "y")
        transects = cut(geometry.generate_transects(manual, ["aoi_id"], transect_spacing, transect_length, transect_ratio, "percent"))

    def masks(rows: DataFrame, factor: float) -> tuple[DataFrame, DataFrame]:
        mask = rows if segs is None else labels.ref_mask(rows, segs, max_distance, factor=factor)
        mask = cut(mask)
        if transects is None:
            return mask, mask
        strip = spatial.pixels_near(mask, transects, ["aoi_id"], corridor, corridor)
        return mask, cut(labels.corridor_gate(mask, cut(strip)))

    def class_values(sampling: DataFrame) -> DataFrame:
        values = thresholds.clip_index(labelled.join(sampling.select(*SCENE).distinct(), SCENE, "left_semi"), sampling, "ndvi", "cls", grow=5)
        full = values.groupBy(*SCENE).agg(F.count_distinct("cls").alias("_k")).filter("_k = 2").select(*SCENE)
        return values.join(full, SCENE, "left_semi")

    mask, sampling = masks(live, 1.0)
    values = cut(class_values(sampling))
    # scenes left without one class: widen a manual buffer, drop an automatic one
    missing = cut(passed.join(values.select(*SCENE).distinct(), SCENE, "left_anti"))
    if segs is not None and not missing.isEmpty():
        again = live.join(missing, SCENE, "left_semi")
        by_hand = segs.filter("source = 'manual'").select("aoi_id").distinct()
        held, free = again.join(by_hand, "aoi_id", "left_semi"), again.join(by_hand, "aoi_id", "left_anti")
        wide, wide_sampling = masks(held, 3.0)
        mask = cut(mask.join(missing, SCENE, "left_anti").unionByName(wide).unionByName(free))
        values = cut(values.unionByName(class_values(wide_sampling.unionByName(free))))
    own_seed = scene_seed(F.col("aoi_id").cast("string"), F.col("scene_id").cast("string")) + seed
    balanced = cut(thresholds.balance(values, "cls", own_seed))
    level = cut(thresholds.class_peaks(balanced, "ndvi", "cls", 1, 2))
    frame = scenes.select(*SCENE, *GEO, "height", "width")

    def trace(area_mask: DataFrame) -> DataFrame:
        rows = salted_join(area_mask.select(*SCENE, "row", "col", "ndvi"), level.select(*SCENE, "threshold"), SCENE, spread=["row", "col"])
        found = contours.stitch(contours.iso_segments(cut(rows), SCENE, "ndvi", F.col("threshold")), SCENE, min_vertices=2)
        world = contours.contour_lines(found, frame, SCENE)
        return cut(salted_join(world, frame.select(*SCENE, "height", "width"), SCENE, spread=["contour", "seq"]))

    world = trace(mask)
    bare = cut(level.select(*SCENE).join(world.select(*SCENE).distinct(), SCENE, "left_anti"))
    if segs is not None and not bare.isEmpty():
        by_hand = segs.filter("source = 'manual'").select("aoi_id").distinct()
        retry = live.join(bare, SCENE, "left_semi").join(by_hand, "aoi_id", "left_semi")
        wider, _ = masks(retry, 3.0)
        mask = cut(mask.join(retry.select(*SCENE).distinct(), SCENE, "left_anti").unionByName(wider))
        world = cut(world.unionByName(trace(wider)))
    points = None
    rebuilt = None
    if transects is not None:
        line_segs = cut(geometry.segments(world.select(*SCENE, "contour", "seq", "x", "y"), [*SCENE, "contour"]))
        rebuilt = cut(spatial.reconstruct(transects, line_segs, ["scene_id"], reconstruct_ratio, cell=transect_length))
        pix = salted_join(rebuilt, frame, SCENE, spread=["seq"])
        inv = lambda w, a, c, n: raster.clip((F.col(w) - F.col(c)) / F.col(a), 0.0, F.col(n) - 1.0)
        points = pix.select(*SCENE, "seq", inv("x", "gt_a", "gt_c", "width").alias("x"), inv("y", "gt_e", "gt_f", "height").alias("y"), F.lit("reconstruct").alias("how"))
    done = None if rebuilt is None else rebuilt.select(*SCENE).distinct()
    rest = world if done is None else world.join(done, SCENE, "left_anti")
    rest = cut(rest.filter(F.col("length") >= min_length))
    edge = cut(raster.near_mask_edge(mask, SCENE))
    scores = cut(labels.score_contours(rest, SCENE, segs, edge, transects, transect_length, min_hit_ratio))
    best = cut(labels.best_contour(scores, SCENE))
    chosen = salted_join(rest, best, [*SCENE, "contour"], spread=["seq"])
    traced = labels.contour_profile(chosen, SCENE) if profile else labels.raw_points(chosen, SCENE)
    traced = traced.select(*SCENE, "seq", "x", "y", F.lit("contour").alias("how"))
    points = cut(traced if points is None else points.unionByName(traced))
    n = points.groupBy(*SCENE).agg(F.count("*").alias("_n"), F.max("how").alias("how"))
    ready = salted_join(points, n.filter("_n >= 3").select(*SCENE), SCENE, spread=["seq"]).drop("how")
    sized = salted_join(ready, frame.select(*SCENE, "height", "width"), SCENE, spread=["seq"])
    out = cut(labels.regularize(sized, SCENE, **shape))
    final = out.groupBy(*SCENE).agg(F.count("*").alias("points"), F.max("target_points").alias("target_points"))
    report = (
        status.join(level.select(*SCENE, "threshold"), SCENE, "left")
        .join(world.select(*SCENE).distinct().withColumn("_traced", F.lit(True)), SCENE, "left")
        .join(n, SCENE, "left").join(best.select(*SCENE, "score"), SCENE, "left").join(final, SCENE, "left")
    )
    why = F.coalesce(
        F.col(REASON),
        F.when(F.col("threshold").isNull(), F.lit("empty_class_vectors")).when(F.col("_traced").isNull(), F.lit("no_contours"))
        .when(F.col("how").isNull(), F.lit("no_primary_line")).when(F.col("_n") < 3, F.lit("too_few_points"))
        .when(F.coalesce("points", F.lit(0)) < 3, F.lit("too_few_points_after_regularize")),
    )
    report = report.withColumn(REASON, why).withColumn("status", F.when(F.col(REASON).isNull(), "ok").otherwise("skip"))
    return out, report.select(*SCENE, "status", REASON, "valid_ratio", "threshold", "how", "score", "points", "target_points")


def label_by_gradient(runs: DataFrame, pixels: DataFrame, sigma: float = 2.0, window: int = 21, poly: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gradient labelling of the first scene of each run: points, status rows, reason counts.

    ``runs``: ``aoi_id, run_id, scene_id, position, cloud_pct``.
    """
    from tideline.operators.selection import best_per_key

    first = best_per_key(runs, ["aoi_id", "run_id"], [F.col("position"), F.col("scene_id")], largest=False)
    picked = salted_join(pixels, first.select(*SCENE).distinct(), SCENE, spread=["row", "col"])
    mask = raster.nodata_mask("green")
    d = cut(picked.withColumn("masked", mask).withColumn("ndvi", raster.nd_index("b08", "b04", mask)))
    quality = thresholds.scene_quality(d, F.col("masked"), "ndvi")
    edges = cut(raster.ve_by_gradient(d, "ndvi", "masked", SCENE, sigma))
    cols = edges.groupBy(*SCENE).agg(F.max("valid_share").alias("column_share"), F.count("edge").alias("n_columns"))
    gate = thresholds.gradient_gate(F.coalesce("cloud_pct", F.lit(0.0)), F.col("valid_share"), F.col("n_index"), F.col("index_range"), F.col("column_share"), F.col("n_columns"))
    report = first.join(quality, SCENE, "left").join(cols, SCENE, "left").withColumn(REASON, F.when(F.col("valid_share").isNull(), "no_image").otherwise(gate))
    report = cut(report.withColumn("status", F.when(F.col(REASON).isNull(), "ok").otherwise("skip")))
    ok = report.filter("status = 'ok'").select(*SCENE).distinct()
    size = d.groupBy(*SCENE).agg(F.max("height").alias("height"), F.max("width").alias("width"))
    known = salted_join(edges.filter("edge IS NOT NULL").select(*SCENE, "col", "edge"), ok.join(size, SCENE), SCENE, spread=["col"])
    full = profiles.fill_linear(known, SCENE, "col", ["edge"], F.lit(0), F.col("width") - 1)
    smooth = profiles.savgol(full, SCENE, "col", ["edge"], F.col("width"), window, poly, rule="shrink")
    points = smooth.select(*SCENE, F.col("col").alias("seq"), F.col("col").cast("double").alias("x"), raster.clip(F.col("edge"), 0.0, F.col("height") - 1.0).alias("y"))
    return points, report, thresholds.reason_counts(report.withColumn(REASON, F.coalesce(REASON, F.lit("ok"))))


def score_edges(
    targets: DataFrame, pixels: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], inputs: Sequence[str], keys: Sequence[str] = SCENE, **line
) -> tuple[DataFrame, DataFrame]:
    """Score target images with a user model and turn the maps into label lines.

    Images are padded to squares for the model and its output is cropped back. Returns the
    points and one report row per target with orientation and confidence.
    """
    keys = list(keys)
    chosen = salted_join(pixels, targets.select(*keys).distinct(), keys, spread=["row", "col"])
    scored = raster.unpad(score_with(raster.pad_square(chosen), fn, [*inputs, "row", "col", "side"], "prob"))
    points, stats = labels.line_from_prob(cut(scored.select(*keys, "row", "col", "height", "width", "prob")), keys, **line)
    points = cut(points)
    n = points.groupBy(*keys).agg(F.count("*").alias("points"))
    report = targets.join(stats, keys, "left").join(n, keys, "left")
    return points, report.withColumn("status", F.when(F.col("points") >= 2, "ok").otherwise("no_line"))
