"""Label lines from contours and probability maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import lines
from tideline.functions.geo import clip
from tideline.lineage import cut
from tideline.operators import geometry, profiles, raster, spatial
from tideline.operators.skew import salted_join

SCENE = ["aoi_id", "scene_id"]


def contour_profile(contour: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Contour to one point per column: median row, linear between the first and last column.

    Needs ``height``, ``width``; contours meeting under 3 columns vanish. A contour crosses
    one raster column at most a few times its height, which bounds each median.
    """
    v = contour.withColumn("_x", clip(F.col("col"), 0.0, F.col("width") - 1.0)).withColumn("_y", clip(F.col("row"), 0.0, F.col("height") - 1.0))
    cols = v.groupBy(*keys, F.rint("_x").cast("long").alias("seq")).agg(F.percentile("_y", F.lit(0.5)).alias("y"), F.max("height").alias("height"))
    n = cols.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n >= 3")
    kept = cols.join(n, list(keys)).drop("_n")
    filled = profiles.fill_linear(kept, keys, "seq", ["y"], F.col("seq"), F.col("seq"))
    return filled.select(*keys, "seq", F.col("seq").cast("double").alias("x"), clip(F.col("y"), 0.0, F.col("height") - 1.0).alias("y"))


def raw_points(contour: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Contour vertices clipped to the image as ``seq, x, y``."""
    return contour.select(*keys, "seq", clip(F.col("col"), 0.0, F.col("width") - 1.0).alias("x"), clip(F.col("row"), 0.0, F.col("height") - 1.0).alias("y"))


def regularize(
    points: DataFrame, keys: Sequence[str], window: int = 11, poly: int = 2, passes: int = 1, fixed: int = 0, low: int = 40, high: int = 200, per_100px: float = 8.0
) -> DataFrame:
    """Label line of an image: clip, drop near-duplicates, smooth, resample, clip.

    ``points``: ``keys, seq, x, y, height, width``. One image's line is bounded by its
    contour, so near-duplicates are dropped on the array form.
    """
    keys = list(keys)
    size = points.groupBy(*keys).agg(F.max("height").alias("height"), F.max("width").alias("width"))
    inside = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        *keys, "seq", clip(F.col("x"), 0.0, F.col("width") - 1.0).alias("x"), clip(F.col("y"), 0.0, F.col("height") - 1.0).alias("y")
    )
    arr = geometry.lines_of(inside, keys).withColumn("line", lines.dedupe_consecutive("line"))
    arr = arr.withColumn("_count", F.size("line")).filter("_count >= 2")
    v = geometry.vertices_of(arr, "line", [*keys, "_count"])
    smooth = profiles.savgol(v, keys, "seq", ["x", "y"], F.col("_count"), window, poly, passes, keep_ends=True, rule="grow")
    smooth = cut(smooth)
    lengths = geometry.line_lengths(smooth.select(*keys, "seq", "x", "y"), keys)
    n = lengths.select(*keys, lines.target_points(F.col("length"), F.col("n_vertices"), fixed, low, high, per_100px).alias("_target"))
    tagged = salted_join(smooth.select(*keys, "seq", "x", "y"), n, keys, spread=["seq"])
    out = geometry.resample_ordered(tagged, [*keys, "_target"], F.col("_target"))
    out = salted_join(out, size, keys, spread=["seq"])
    return out.select(*keys, "seq", clip(F.col("x"), 0.0, F.col("width") - 1.0).alias("x"), clip(F.col("y"), 0.0, F.col("height") - 1.0).alias("y"), F.col("_target").alias("target_points"))


def line_from_prob(
    prob: DataFrame, keys: Sequence[str] = SCENE, value: str = "prob", threshold: float = 0.5, target: int = 60, min_points: int = 20, window: int = 11, poly: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Probability map to an ordered line along its longer axis.

    Returns the points (``seq, x, y``) and per scene ``orientation, conf_frac, interp_frac``.
    The axis with the larger weighted variance is the primary one; each slice takes the
    first maximum after smoothing across the line. Slices under the threshold are filled
    linearly; the threshold is relaxed to 40 % and then to the 90th percentile of the slice
    maxima where too few slices pass. Scenes with too few strong slices have no line.
    """
    keys = list(keys)
    p, y, x = F.col(value), F.col("row"), F.col("col")
    m = prob.groupBy(*keys).agg(
        F.sum(p).alias("_m"), F.sum(p * y).alias("_y"), F.sum(p * x).alias("_x"), F.sum(p * y * y).alias("_yy"), F.sum(p * x * x).alias("_xx"),
        F.max("height").alias("_h"), F.max("width").alias("_wd"),
    ).filter("_m >= 1e-6")
    var = lambda s, ss: F.col(ss) / F.col("_m") - (F.col(s) / F.col("_m")) * (F.col(s) / F.col("_m"))
    m = m.withColumn("_hor", var("_x", "_xx") >= var("_y", "_yy"))
    m = m.select(*keys, "_hor", F.when(F.col("_hor"), F.col("_wd")).otherwise(F.col("_h")).alias("n_slices"), F.when(F.col("_hor"), F.col("_h")).otherwise(F.col("_wd")).alias("_sec"))
    d = salted_join(prob.select(*keys, "row", "col", value), m, keys, spread=["row", "col"])
    d = d.withColumn("pos", F.when(F.col("_hor"), x).otherwise(y)).withColumn("sec", F.when(F.col("_hor"), y).otherwise(x)).withColumn("_s", p.cast("double"))
    soft = profiles.gaussian1d(d.select(*keys, "pos", "sec", "_sec", value, "_s"), [*keys, "pos"], "sec", F.col("_sec"), ["_s"], 1.5)
    slices = soft.groupBy(*keys, "pos").agg(F.max_by("sec", F.struct("_s", -F.col("sec"))).cast("double").alias("v"), F.max(value).alias("peak"))
    # at most one slice per row or column of the image
    per = slices.groupBy(*keys).agg(
        F.count_if(F.col("peak") >= threshold).alias("_c1"), F.count_if(F.col("peak") >= threshold * 0.4).alias("_c2"), F.percentile("peak", F.lit(0.9)).alias("_p90")
    )
    used = F.when(F.col("_c1") >= min_points, F.lit(threshold)).when(F.col("_c2") >= min_points, F.lit(threshold * 0.4)).otherwise(
        F.when(F.col("_p90") > 1e-4, F.col("_p90")).otherwise(1e-4)
    )
    per = per.join(m, keys).withColumn("_thr", used)
    strong = salted_join(slices, per, keys, spread=["pos"]).filter(F.col("peak") >= F.col("_thr"))
    n = strong.groupBy(*keys).agg(F.count("*").alias("_strong")).filter(F.col("_strong") >= max(4, min_points // 4))
    known = salted_join(strong.select(*keys, "pos", "v", "n_slices", "_sec", "_hor"), n, keys, spread=["pos"])
    full = profiles.fill_linear(known, keys, "pos", ["v"], F.lit(0), F.col("n_slices") - 1)
    smooth = profiles.savgol(full, keys, "pos", ["v"], F.col("n_slices"), max(5, window), poly, rule="shrink")
    smooth = smooth.withColumn("v", clip(F.col("v"), 0.0, F.col("_sec") - 1.0))
    head = per.join(n, keys).select(
        *keys, "n_slices", "_hor", F.when(F.col("_hor"), "H").otherwise("V").alias("orientation"),
        F.round(F.col("_strong") / F.col("n_slices"), 3).alias("conf_frac"), F.round(1 - F.col("_strong") / F.col("n_slices"), 3).alias("interp_frac"),
    )
    count = F.greatest(F.lit(min_points), F.least(F.lit(target), F.col("n_slices")))
    at = F.col("seq") * F.try_divide((F.col("n_slices") - 1).cast("double"), F.col("_n") - 1)
    picks = head.withColumn("_n", count).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_at", at)
    base = F.floor("_at")
    pair = F.array(F.struct(base.alias("pos"), (1 - (F.col("_at") - base)).alias("w")), F.struct((base + 1).alias("pos"), (F.col("_at") - base).alias("w")))
    parts = picks.withColumn("_q", F.explode(F.filter(pair, lambda q: q["w"] > 0))).select(*keys, "seq", "_at", "_hor", "_q.pos", "_q.w")
    got = parts.join(smooth.select(*keys, "pos", "v"), [*keys, "pos"]).groupBy(*keys, "seq").agg(
        F.max("_at").alias("_at"), F.max("_hor").alias("_hor"), F.sum(F.col("v") * F.col("w")).alias("_v")
    )
    pts = got.select(*keys, "seq", F.when(F.col("_hor"), F.col("_at")).otherwise(F.col("_v")).alias("x"), F.when(F.col("_hor"), F.col("_v")).otherwise(F.col("_at")).alias("y"))
    return pts, head.drop("_hor", "n_slices")


def score_contours(
    contours: DataFrame, keys: Sequence[str] = SCENE, refs: DataFrame | None = None, near_edge: DataFrame | None = None,
    transects: DataFrame | None = None, transect_length: float = 500.0, min_hit_ratio: float = 0.0, reach: float = 100.0,
) -> DataFrame:
    """Score of every candidate contour, from its length and where it lies.

    ``contours``: world vertices with ``contour, seq, row, col, x, y, length, height, width``.
    ``refs``: measured segments of the AOI's reference. ``near_edge``: pixels next to the
    mask's edge. Contours under ``min_hit_ratio`` are dropped.
    """
    ck = [*keys, "contour"]
    r, c, h, w = F.col("row"), F.col("col"), F.col("height"), F.col("width")
    border = (r <= 2) | (r >= h - 3) | (c <= 2) | (c >= w - 3)
    v = contours.withColumn("_r", clip(F.rint(r), 0.0, h - 1.0).cast("int")).withColumn("_c", clip(F.rint(c), 0.0, w - 1.0).cast("int"))
    if near_edge is not None:
        marks = near_edge.select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), F.lit(1.0).alias("_e"))
        v = v.join(marks, [*keys, "_r", "_c"], "left")
    else:
        v = v.withColumn("_e", F.lit(0.0))
    out = v.groupBy(*ck).agg(
        F.max("length").alias("length"), F.avg(border.cast("double")).alias("border_frac"), F.avg(F.coalesce("_e", F.lit(0.0))).alias("mask_edge_frac")
    )
    low = lambda f: F.greatest(F.lit(0.05), 1.0 - F.col(f))
    score = F.col("length") * low("border_frac") * low("mask_edge_frac")
    out = cut(out)
    seg = None
    if refs is not None or transects is not None:
        seg = cut(geometry.segments(contours.select(*ck, "seq", "x", "y"), ck))
    if refs is not None:
        gap = spatial.nearest_segment(seg, refs, [*ck, "seq"], ["aoi_id"], reach).groupBy(*ck).agg(F.min("distance").alias("ref_dist"))
        pts = contours.select(*ck, "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
        span = spatial.nearest_segment(pts, refs, [*ck, "seq"], ["aoi_id"], reach).groupBy(*ck).agg((F.max("along") - F.min("along")).alias("_span"))
        total = refs.groupBy("aoi_id").agg(F.max("total").alias("_total"))
        out = salted_join(out.join(gap, ck, "left").join(span, ck, "left"), total, ["aoi_id"], "left", spread=["contour"])
        out = out.withColumn("ref_cover_ratio", clip(F.try_divide("_span", "_total"), 0.0, 1.0)).drop("_span", "_total")
        guided = score / (1.0 + F.col("ref_dist")) * F.coalesce(0.6 + 0.8 * F.col("ref_cover_ratio"), F.lit(1.0))
        score = F.when(F.col("ref_dist").isNotNull(), guided).otherwise(score)
    if transects is not None:
        lk = [k for k in ck if k != "aoi_id"]
        stats = spatial.hit_stats(transects, seg, lk, cell=transect_length).select(*ck, "hits", "hit_ratio", "median_offset", "n_transects")
        out = out.join(stats, ck, "left")
        if min_hit_ratio > 0:
            out = out.filter(F.col("n_transects").isNull() | (F.col("hit_ratio") >= min_hit_ratio))
        off = F.when(F.col("median_offset").isNull(), 0.05).otherwise(1.0 / (1.0 + F.col("median_offset") / max(transect_length * 0.5, 1.0)))
        score = F.when(F.col("n_transects").isNotNull(), score * (1.0 + 3.0 * F.coalesce("hit_ratio", F.lit(0.0))) * off).otherwise(score)
    return out.withColumn("score", score)


def best_contour(scores: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Contour with the highest score per scene, the smallest id on ties."""
    return scores.groupBy(*keys).agg(F.max_by(F.struct("contour", "score"), F.struct("score", -F.col("contour"))).alias("_b")).select(
        *keys, "_b.contour", "_b.score"
    )


def ref_mask(pixels: DataFrame, refs: DataFrame, distance: float, keys: Sequence[str] = SCENE, factor: float = 1.0) -> DataFrame:
    """Valid pixels near the AOI's reference line.

    ``pixels``: valid pixels with ``x, y, height, width``; ``refs``: reference segments with
    ``source``. An AOI without a reference keeps all valid pixels. Where the buffer covers
    under 1 % of the scene, a manual reference is widened twofold and an automatic one gives
    way to all valid pixels.
    """
    keys = list(keys)
    d = distance * factor
    near = cut(spatial.pixels_near(pixels, refs, ["aoi_id"], d, 2 * d).select(*keys))
    size = pixels.groupBy(*keys).agg((F.max("height") * F.max("width")).alias("_size"))
    covered = near.groupBy(*keys).agg(F.count("*").alias("_n"))
    src = refs.groupBy("aoi_id").agg(F.min("source").alias("_source"))
    plan = salted_join(size.join(covered, keys, "left"), src, ["aoi_id"], "left", spread=["_size"])
    thin = F.coalesce(F.col("_n"), F.lit(0)) / F.col("_size") < 0.01
    plan = plan.withColumn("_mode", F.when(F.col("_source").isNull(), "all").when(~thin, "near").when(F.col("_source") == "manual", "wide").otherwise("all")).select(*keys, "_mode")
    marked = cut(salted_join(pixels, cut(plan), keys, spread=["row", "col"]))
    wide = spatial.pixels_near(marked.filter("_mode = 'wide'"), refs, ["aoi_id"], 2 * d, 2 * d)
    close = spatial.pixels_near(marked.filter("_mode = 'near'"), refs, ["aoi_id"], d, 2 * d)
    return marked.filter("_mode = 'all'").unionByName(wide).unionByName(close).drop("_mode")


def corridor_gate(mask: DataFrame, corridor: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Mask within the transect corridor where that still covers 0.2 % of the scene, else the mask."""
    both = mask.join(corridor.select(*keys, "row", "col"), [*keys, "row", "col"], "left_semi")
    size = mask.groupBy(*keys).agg((F.max("height") * F.max("width")).alias("_size"))
    ok = both.groupBy(*keys).agg(F.count("*").alias("_n")).join(size, list(keys)).filter(F.col("_n") / F.col("_size") >= 0.002).select(*keys)
    rest = mask.join(ok, list(keys), "left_anti")
    return both.join(ok, list(keys), "left_semi").unionByName(rest)


# --- augmentation ---

def _draw(sample: Sequence[str], seed: int, name: str) -> Column:
    """Reproducible number in [0,1) per sample and purpose."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *[F.col(c) for c in sample]), F.lit(1 << 40)) / float(1 << 40)


def augment(df: DataFrame, sample: Sequence[str], bands: Sequence[str], seed: int, mask: str = "mask") -> DataFrame:
    """Random flips, rotation within 15°, crop, brightness, contrast and blur of square samples.

    ``df``: ``sample, row, col, side, <bands>, <mask>``. Geometry moves image and mask alike
    (bilinear and nearest); light and blur change the image only. The draws depend on the
    seed and sample alone. The crop keeps 70-100 % of the side.
    """
    sample = list(sample)
    d = lambda n: _draw(sample, seed, n)
    between = lambda n, a, b: a + d(n) * (b - a)
    side = F.col("side")
    flipped = df.withColumn("col", F.when(d("h") < 0.5, side - 1 - F.col("col")).otherwise(F.col("col"))).withColumn(
        "row", F.when(d("v") < 0.5, side - 1 - F.col("row")).otherwise(F.col("row"))
    )
    angle = F.when(d("rot") < 0.7, F.radians(between("angle", -15.0, 15.0))).otherwise(0.0)
    mid = (side - 1) / 2.0
    # every target pixel asks for the source position under the inverse rotation
    grid = flipped.select(*sample, "side", "row", "col")
    dx, dy = F.col("col") - mid, F.col("row") - mid
    asked = grid.withColumn("_a", angle)
    asked = asked.withColumn("_sx", F.cos("_a") * dx + F.sin("_a") * dy + mid).withColumn("_sy", -F.sin("_a") * dx + F.cos("_a") * dy + mid)
    fx, fy = F.col("_sx") - F.floor("_sx"), F.col("_sy") - F.floor("_sy")
    corner = lambda i, j: F.struct(
        (F.floor("_sy") + i).cast("int").alias("r"), (F.floor("_sx") + j).cast("int").alias("c"),
        ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w"),
        ((F.floor(F.col("_sy") + 0.5) == F.floor("_sy") + i) & (F.floor(F.col("_sx") + 0.5) == F.floor("_sx") + j)).alias("near"),
    )
    asked = asked.withColumn("_q", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])))
    src = flipped.select(*sample, F.col("row").alias("_r"), F.col("col").alias("_c"), *bands, mask)
    got = asked.select(*sample, "side", "row", "col", F.col("_q.r").alias("_r"), F.col("_q.c").alias("_c"), F.col("_q.w").alias("_w"), F.col("_q.near").alias("_near"))
    got = got.join(src, [*sample, "_r", "_c"], "left")
    turned = got.groupBy(*sample, "side", "row", "col").agg(
        *[F.coalesce(F.sum(F.col(b) * F.col("_w")), F.lit(0.0)).alias(b) for b in bands],
        F.coalesce(F.max(F.when(F.col("_near"), F.col(mask).cast("double"))), F.lit(0.0)).alias(mask),
    )
    new = F.when(d("crop") < 0.8, F.greatest(F.least(F.lit(64), side), F.floor(side * between("scale", 0.7, 1.0)).cast("int"))).otherwise(side)
    room = side - new + 1
    kept = turned.withColumn("_new", new.cast("int")).withColumn("_x", F.floor(d("x") * room).cast("int")).withColumn("_y", F.floor(d("y") * room).cast("int"))
    kept = kept.withColumn("col", F.col("col") - F.col("_x")).withColumn("row", F.col("row") - F.col("_y"))
    kept = kept.filter((F.col("col") >= 0) & (F.col("col") < F.col("_new")) & (F.col("row") >= 0) & (F.col("row") < F.col("_new"))).withColumn("side", F.col("_new")).drop("_new", "_x", "_y")
    lit = d("light") < 0.8
    bright = kept.withColumns({b: F.when(lit, F.col(b) * between("bright", 0.7, 1.3)).otherwise(F.col(b)) for b in bands})
    means = bright.groupBy(*sample).agg(F.avg(sum((F.col(b) for b in bands), F.lit(0.0)) / len(bands)).alias("_mean"))
    toned = salted_join(bright, means, sample, spread=["row", "col"])
    toned = toned.withColumns({
        b: F.when(lit, F.col("_mean") + (F.col(b) - F.col("_mean")) * between("contrast", 0.7, 1.3)).otherwise(F.col(b)) for b in bands
    }).drop("_mean")
    hazy = d("blur") < 0.3
    soft = toned.filter(hazy)
    for axis, other in (("row", "col"), ("col", "row")):
        soft = profiles.gaussian1d(soft, [*sample, other], axis, F.col("side"), list(bands), 1.0)
    return toned.filter(~hazy).unionByName(soft)


def augment_history(frames: DataFrame, sample: Sequence[str], frame: str, seed: int) -> DataFrame:
    """Flips for all frames of a sample and growth or shrinkage of single history frames.

    ``frames``: foreground pixels ``sample, frame, row, col, height, width, is_target``. The
    target is flipped with its history but never grown or shrunk.
    """
    sample = list(sample)
    d = lambda n: _draw(sample, seed, n)
    f = frames.withColumn("col", F.when(d("h") < 0.5, F.col("width") - 1 - F.col("col")).otherwise(F.col("col")))
    f = f.withColumn("row", F.when(d("v") < 0.3, F.col("height") - 1 - F.col("row")).otherwise(F.col("row")))
    noisy = (d("noise") < 0.35) & ~F.col("is_target")
    grow = _draw([*sample, frame], seed, "grow") < 0.5
    twice = _draw([*sample, frame], seed, "twice") < 0.5
    cross = raster.disk(1)
    keys = [*sample, frame, "is_target"]
    cols = [*keys, "row", "col", "height", "width"]
    once = raster.dilate(f.filter(noisy & grow), 1, keys, cross)
    more = raster.dilate(once.filter(twice), 1, keys, cross)
    less = raster.erode(f.filter(noisy & ~grow), 1, keys, cross, outside=False)
    parts = [f.filter(~noisy), once.filter(~twice), more, less]
    out = parts[0].select(*cols)
    for part in parts[1:]:
        out = out.unionByName(part.select(*cols))
    return out
