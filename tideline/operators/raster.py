"""Pixel tables: one row per pixel ``(aoi_id, scene_id, row, col, b02, b03, b04, b08, b11, …)``.

NULL means masked everywhere. Scene size travels with the pixels as ``height`` and
``width``. Neighbourhood work runs in row tiles, so a window never holds a whole scene.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.geo import clip
from tideline.operators import profiles
from tideline.operators.skew import exact_quantiles, salted_join, tile_halo

BANDS = ["b02", "b03", "b04", "b08", "b11"]
SCENE = ["aoi_id", "scene_id"]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def null_nan(df: DataFrame, cols: Sequence[str] = BANDS) -> DataFrame:
    """NaN and infinities to NULL, so comparisons follow one rule."""
    return df.withColumns({
        c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)) for c in cols
    })


# --- indices ---

def _unmasked(value: Column, mask: Column | None) -> Column:
    return value if mask is None else F.when(~mask, value)


def nd_index(a: Column | str, b: Column | str, mask: Column | None = None) -> Column:
    """``(a-b)/(a+b)``; NULL when masked or the sum is 0."""
    total = _c(a) + _c(b)
    return _unmasked(F.when(total != 0, F.try_divide(_c(a) - _c(b), total)), mask)


def savi(nir: Column | str = "b08", red: Column | str = "b04", mask: Column | None = None) -> Column:
    """Soil-adjusted index with L = 0.5."""
    den = _c(nir) + _c(red) + 0.5
    return _unmasked(F.when(den != 0, F.try_divide(_c(nir) - _c(red), den) * 1.5), mask)


def rbnd(nir: Column | str = "b08", red: Column | str = "b04", blue: Column | str = "b02", mask: Column | None = None) -> Column:
    """``(nir-(red+blue))/(nir+red+blue)``."""
    both = _c(red) + _c(blue)
    den = _c(nir) + both
    return _unmasked(F.when(den != 0, F.try_divide(_c(nir) - both, den)), mask)


def nodata_mask(mode: str = "bands", bands: Sequence[str] = BANDS) -> Column:
    """``bands``: any band missing or all zero. ``green``: green under 1e-4 or any band missing."""
    missing = F.lit(False)
    for b in bands:
        missing = missing | F.col(b).isNull() | F.isnan(b) | (F.abs(F.col(b)) == float("inf"))
    if mode == "green":
        return missing | (F.col("b03") < 1e-4)
    zero = F.lit(True)
    for b in bands:
        zero = zero & F.coalesce(F.col(b) == 0, F.lit(False))
    return missing | zero


def has_signal(pixels: DataFrame, keys: Sequence[str] = SCENE, bands: Sequence[str] = BANDS, floor: float = 1e-8) -> DataFrame:
    """Per scene: does any finite value exceed ``floor`` in size."""
    top = F.greatest(*[F.coalesce(F.nanvl(F.abs(F.col(b)), F.lit(0.0)), F.lit(0.0)) for b in bands])
    top = F.when(top < float("inf"), top)
    return pixels.groupBy(*keys).agg(F.coalesce(F.max(top) > floor, F.lit(False)).alias("has_signal"))


# --- focal statistics and feature vectors ---

def focal_std(df: DataFrame, cols: Sequence[str], radius: int = 1, keys: Sequence[str] = SCENE, suffix: str = "_std") -> DataFrame:
    """Standard deviation over a ``(2r+1)²`` window with mirrored edges, variance floor 0.

    NULL when the window holds a NULL. Two one-dimensional passes: along each raster row,
    then down row tiles.
    """
    if radius < 1:
        return df.withColumns({c + suffix: F.lit(0.0) for c in cols})
    r, win = radius, (2 * radius + 1) ** 2
    wide = profiles.reflect_pad(df, "col", F.col("width"), r)
    wr = Window.partitionBy(*keys, "row").orderBy("col").rangeBetween(-r, r)
    sums: dict[str, Column] = {}
    for c in cols:
        v = F.col(c).cast("double")
        sums |= {f"_s_{c}": F.sum(v).over(wr), f"_q_{c}": F.sum(v * v).over(wr), f"_n_{c}": F.count(v).over(wr)}
    across = wide.withColumns(sums).filter("_real").drop("_real")
    tall = tile_halo(profiles.reflect_pad(across, "row", F.col("height"), r), "row", r, r)
    wc = Window.partitionBy(*keys, "_tile", "col").orderBy("row").rangeBetween(-r, r)
    out = {}
    for c in cols:
        mean, sq = F.sum(f"_s_{c}").over(wc) / win, F.sum(f"_q_{c}").over(wc) / win
        full = F.sum(f"_n_{c}").over(wc) == win
        out[c + suffix] = F.when(full, F.sqrt(F.greatest(sq - mean * mean, F.lit(0.0))))
    rows = tall.withColumns(out).filter(F.col("_real") & F.col("_home"))
    return rows.select(*df.columns, *[c + suffix for c in cols])


# Index pairs of the two feature vectors, in order.
VEG_PAIRS = {"nir_red": ("b08", "b04"), "nir_green": ("b08", "b03"), "red_green": ("b04", "b03")}
SHORE_PAIRS = {
    "swir_green": ("b11", "b03"), "swir_nir": ("b11", "b08"), "nir_green": ("b08", "b03"), "nir_red": ("b08", "b04"), "blue_red": ("b02", "b04"),
}


def _features(df: DataFrame, indices: dict[str, Column], keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    base = [*BANDS, *indices]
    return focal_std(df.withColumns(indices), base, 1, keys), [*base, *[c + "_std" for c in base]]


def veg_features(df: DataFrame, keys: Sequence[str] = SCENE, mask: Column | None = None) -> tuple[DataFrame, list[str]]:
    """20 features: bands, five vegetation indices and the 3x3 deviation of each."""
    ind = {n: nd_index(a, b, mask) for n, (a, b) in VEG_PAIRS.items()} | {"savi": savi(mask=mask), "rbnd": rbnd(mask=mask)}
    return _features(df, ind, keys)


def shore_features(df: DataFrame, keys: Sequence[str] = SCENE, mask: Column | None = None) -> tuple[DataFrame, list[str]]:
    """20 features: bands, five shore indices and the 3x3 deviation of each."""
    return _features(df, {n: nd_index(a, b, mask) for n, (a, b) in SHORE_PAIRS.items()}, keys)


def fit_pixel_classifier(df: DataFrame, features: Sequence[str], label: str, hidden: Sequence[int] = (16,), seed: int = 0, max_iter: int = 60):
    """Multilayer perceptron on rows with all features present; labels start at 1."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = df.dropna(subset=[*features, label]).withColumn("_label", F.col(label).cast("double") - 1.0)
    classes = int(rows.agg(F.max("_label")).first()[0]) + 1
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_vec", withMean=True, withStd=True),
        MultilayerPerceptronClassifier(
            layers=[len(features), *hidden, classes], featuresCol="_vec", labelCol="_label", predictionCol="_pred", seed=seed, maxIter=max_iter
        ),
    ]
    return Pipeline(stages=stages).fit(rows)


def score_pixels(df: DataFrame, model, features: Sequence[str], out: str = "class") -> DataFrame:
    """Classes of usable rows; rows with a missing feature keep a NULL class."""
    usable = F.lit(True)
    for f in features:
        usable = usable & F.col(f).isNotNull() & ~F.isnan(f)
    helper = ["_raw", "_vec", "_pred", "rawPrediction", "probability"]
    scored = model.transform(df.filter(usable)).withColumn(out, (F.col("_pred") + 1).cast("tinyint")).drop(*helper)
    return scored.unionByName(df.filter(~usable).withColumn(out, F.lit(None).cast("tinyint")))


def classify_veg(ndvi: Column | str, threshold: float = 0.2) -> Column:
    """1 vegetation, 2 other, NULL masked."""
    return F.when(_c(ndvi) >= threshold, 1).when(_c(ndvi) < threshold, 2).cast("tinyint")


def classify_shore(mndwi: Column | str, ndvi: Column | str, threshold: float = 0.0, mask: Column | None = None) -> Column:
    """3 water, 1 sand, 2 swash; NULL where masked. A pixel with an undefined index is not water."""
    cls = F.when(_c(mndwi) > threshold, 3).when(_c(ndvi) < 0.2, 1).otherwise(2)
    return (cls if mask is None else F.when(~mask, cls)).cast("tinyint")


# --- stretches ---

def stretch(df: DataFrame, cols: Sequence[str], low: float = 0.02, high: float = 0.98, keys: Sequence[str] = SCENE) -> DataFrame:
    """Percentile stretch to [0,1] per scene; min/max when the percentiles meet, flat is 0."""
    out = df
    for c in cols:
        q = exact_quantiles(df, keys, c, [low, high, 0.0, 1.0], ["_lo", "_hi", "_min", "_max"])
        joined = salted_join(out, q, keys, "left", spread=["row", "col"])
        pick = F.col("_hi") > F.col("_lo")
        lo, hi = F.when(pick, F.col("_lo")).otherwise(F.col("_min")), F.when(pick, F.col("_hi")).otherwise(F.col("_max"))
        scaled = F.when(hi > lo, F.try_divide(F.col(c) - lo, hi - lo)).otherwise(F.when(F.col(c).isNotNull(), 0.0))
        out = joined.withColumn(c, clip(scaled, 0.0, 1.0)).drop("_lo", "_hi", "_min", "_max")
    return out


def stretch_u8(df: DataFrame, cols: Sequence[str], low: float = 0.02, high: float = 0.98, keys: Sequence[str] = SCENE) -> DataFrame:
    """Percentile stretch to 0..255; missing pixels are 0."""
    out = df
    for c in cols:
        q = exact_quantiles(df, keys, c, [low, high], ["_lo", "_hi"])
        joined = salted_join(out, q, keys, "left", spread=["row", "col"])
        hi = F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 1e-6).otherwise(F.col("_hi"))
        x = clip((F.col(c) - F.col("_lo")) / (hi - F.col("_lo")), 0.0, 1.0)
        out = joined.withColumn(c, F.coalesce(F.floor(x * 255.0).cast("int"), F.lit(0))).drop("_lo", "_hi")
    return out


# Channel statistics of the image models.
RGB_MEAN = (0.485, 0.456, 0.406)
RGB_STD = (0.229, 0.224, 0.225)


def normalize(cols: Sequence[str], mean: Sequence[float] = RGB_MEAN, std: Sequence[float] = RGB_STD) -> dict[str, Column]:
    """Expressions for ``df.withColumns``: ``(x - mean) / std`` per channel."""
    return {c: (F.col(c) - m) / s for c, m, s in zip(cols, mean, std, strict=True)}


def index_from_uint8(col: Column | str) -> Column:
    """8-bit green channel to an index-like value in [-1,1]."""
    return _c(col).cast("double") / 255.0 * 2 - 1


# Band order of the composites and the knots of the index colour ramp.
COMPOSITES = {"true": ("b04", "b03", "b02"), "false": ("b08", "b04", "b03")}
NDVI_RAMP = [
    (-0.5, (0.05, 0.05, 0.05)), (0.0, (165 / 255, 0.0, 38 / 255)), (0.2, (215 / 255, 48 / 255, 39 / 255)),
    (0.4, (244 / 255, 109 / 255, 67 / 255)), (0.6, (253 / 255, 174 / 255, 97 / 255)), (1.0, (254 / 255, 224 / 255, 139 / 255)),
]


def ramp(value: Column | str, knots: Sequence[tuple[float, tuple[float, float, float]]] = NDVI_RAMP) -> dict[str, Column]:
    """Piecewise-linear colour of a value: expressions ``r``, ``g``, ``b``; ends are held."""
    v = _c(value)
    out = {}
    for i, name in enumerate("rgb"):
        expr = F.when(v <= knots[0][0], knots[0][1][i])
        for (k0, c0), (k1, c1) in zip(knots, knots[1:], strict=False):
            expr = expr.when(v <= k1, c0[i] + (v - k0) / (k1 - k0) * (c1[i] - c0[i]))
        out[name] = F.when(v.isNotNull(), expr.otherwise(knots[-1][1][i]))
    return out


def composite(df: DataFrame, kind: str, gain: float = 1.0) -> DataFrame:
    """``true`` or ``false`` colour, or ``ndvi`` through the colour ramp, as ``r, g, b``."""
    if kind == "ndvi":
        return df.withColumns(ramp(nd_index("b08", "b04")))
    return df.withColumns({n: F.col(b) * gain for n, b in zip("rgb", COMPOSITES[kind], strict=True)})


# --- grids ---

def chips(pixels: DataFrame, size: int, stride: int) -> DataFrame:
    """Each pixel in every chip that covers it: ``chip, row_off, col_off, chip_row, chip_col``."""
    axis = lambda v: F.sequence(
        F.greatest(F.floor((F.col(v) - size) / stride) + 1, F.lit(0)), F.floor(F.col(v) / stride)
    )
    across = F.ceil(F.col("width") / stride)
    out = pixels.withColumn("_r", F.explode(axis("row"))).withColumn("_c", F.explode(axis("col")))
    return (
        out.withColumn("chip", (F.col("_r") * across + F.col("_c")).cast("int"))
        .withColumn("row_off", (F.col("_r") * stride).cast("int"))
        .withColumn("col_off", (F.col("_c") * stride).cast("int"))
        .withColumn("chip_row", F.col("row") - F.col("row_off"))
        .withColumn("chip_col", F.col("col") - F.col("col_off"))
        .drop("_r", "_c")
    )


def chip_records(scenes: DataFrame, size: int, stride: int, keys: Sequence[str] = SCENE) -> DataFrame:
    """One record per chip with its window, georeference, bounds and safe name."""
    from tideline.functions.text_time import safe_scene_id

    steps = lambda n: F.sequence(F.lit(0), F.ceil(F.col(n) / stride).cast("int") - 1)
    c = scenes.withColumn("_r", F.explode(steps("height"))).withColumn("_c", F.explode(steps("width")))
    c = (
        c.withColumn("chip", F.col("_r") * F.ceil(F.col("width") / stride).cast("int") + F.col("_c"))
        .withColumn("row_off", F.col("_r") * stride)
        .withColumn("col_off", F.col("_c") * stride)
        .withColumn("chip_w", F.least(F.lit(size), F.col("width") - F.col("col_off")))
        .withColumn("chip_h", F.least(F.lit(size), F.col("height") - F.col("row_off")))
        .withColumn("chip_gt_c", F.col("gt_c") + F.col("col_off") * F.col("gt_a"))
        .withColumn("chip_gt_f", F.col("gt_f") + F.col("row_off") * F.col("gt_e"))
    )
    far_x = F.col("chip_gt_c") + F.col("chip_w") * F.col("gt_a")
    far_y = F.col("chip_gt_f") + F.col("chip_h") * F.col("gt_e")
    name = F.format_string("%s_chip_%04d", safe_scene_id(F.col("scene_id").cast("string")), F.col("chip"))
    return c.select(
        *keys, "chip", name.alias("chip_name"), "row_off", "col_off", "chip_w", "chip_h", "gt_a", "gt_e", "chip_gt_c", "chip_gt_f",
        F.array(
            F.least("chip_gt_c", far_x), F.least("chip_gt_f", far_y), F.greatest("chip_gt_c", far_x), F.greatest("chip_gt_f", far_y)
        ).alias("bounds"),
    )


def padded_chips(pixels: DataFrame, scenes: DataFrame, size: int, stride: int, bands: Sequence[str] = BANDS, keys: Sequence[str] = SCENE) -> DataFrame:
    """Full ``size × size`` chips; cells beyond the scene are NULL."""
    span = F.sequence(F.lit(0), F.lit(size - 1))
    grid = (
        chip_records(scenes, size, stride, keys).select(*keys, "chip")
        .withColumn("chip_row", F.explode(span)).withColumn("chip_col", F.explode(span))
    )
    filled = chips(pixels, size, stride).select(*keys, "chip", "chip_row", "chip_col", *bands)
    return grid.join(filled, [*keys, "chip", "chip_row", "chip_col"], "left")


def pad_square(df: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """Shift coordinates into the centred square of the longer side: adds ``pad_x, pad_y, side``."""
    side = F.greatest("width", "height")
    out = (
        df.withColumn("side", side)
        .withColumn("pad_x", F.floor((F.col("side") - F.col("width")) / 2).cast("int"))
        .withColumn("pad_y", F.floor((F.col("side") - F.col("height")) / 2).cast("int"))
    )
    return out.withColumn(row, F.col(row) + F.col("pad_y")).withColumn(col, F.col(col) + F.col("pad_x"))


def unpad(df: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """Back to image coordinates; cells of the padding are dropped."""
    out = df.withColumn(row, F.col(row) - F.col("pad_y")).withColumn(col, F.col(col) - F.col("pad_x"))
    inside = (F.col(row) >= 0) & (F.col(row) < F.col("height")) & (F.col(col) >= 0) & (F.col(col) < F.col("width"))
    return out.filter(inside).drop("pad_x", "pad_y", "side")


def resample_raster(df: DataFrame, value: str, height: int, width: int, how: str, keys: Sequence[str] = SCENE) -> DataFrame:
    """Scene to ``height × width``: ``nearest``, ``bilinear`` (half-pixel centres) or ``area``.

    Source pixels are sent to the targets they contribute to, so the cost follows the larger
    of the two grids. ``area`` is the mean weighted by overlap.
    """
    def targets(pos: str, size: str, n: int) -> Column:
        s, i = F.col(size) / F.lit(float(n)), F.col(pos).cast("double")
        if how == "nearest":
            lo, hi = F.ceil(i / s - 0.5), F.ceil((i + 1) / s - 0.5) - 1
            weigh = lambda t: F.lit(1.0)
        elif how == "bilinear":
            lo, hi = F.ceil((i - 0.5) / s - 0.5 + 1e-12), F.floor((i + 1.5) / s - 0.5)
            last = F.col(size) - 1

            def weigh(t: Column) -> Column:
                at = F.greatest(F.least((t + 0.5) * s - 0.5, last.cast("double")), F.lit(0.0))
                return F.greatest(1.0 - F.abs(at - i), F.lit(0.0))

            lo = F.when(F.col(pos) == 0, F.lit(0)).otherwise(lo)
            hi = F.when(F.col(pos) == last, F.lit(n - 1)).otherwise(hi)
        else:
            lo, hi = F.floor(i / s), F.ceil((i + 1) / s) - 1
            weigh = lambda t: F.least((t + 1) * s, i + 1) - F.greatest(t * s, i)
        lo, hi = F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, F.lit(n - 1)).cast("int")
        ts = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(ts, lambda t: F.struct(t.alias("t"), weigh(t).alias("w"))), lambda p: p["w"] > 0)

    sent = (
        df.filter(F.col(value).isNotNull())
        .withColumn("_r", F.explode(targets("row", "height", height)))
        .withColumn("_c", F.explode(targets("col", "width", width)))
    )
    w = F.col("_r.w") * F.col("_c.w")
    return sent.groupBy(*keys, F.col("_r.t").alias("row"), F.col("_c.t").alias("col")).agg(
        (F.sum(F.col(value) * w) / F.sum(w)).alias(value)
    )


def shrink_mask(df: DataFrame, value: str, size: int, keys: Sequence[str] = SCENE, threshold: float = 0.30) -> DataFrame:
    """Mask to ``size × size``: zero-padded to a square, area averaged, set at ``threshold``."""
    side = F.greatest("height", "width").cast("double")
    s = side / size

    def spread(pos: str) -> Column:
        i = F.col(pos).cast("double")
        ts = F.sequence(F.floor(i / s).cast("int"), F.least(F.ceil((i + 1) / s).cast("int") - 1, F.lit(size - 1)))
        return F.transform(ts, lambda t: F.struct(t.alias("t"), (F.least((t + 1) * s, i + 1) - F.greatest(t * s, i)).alias("w")))

    sent = df.filter(F.col(value) > 0).withColumn("_r", F.explode(spread("row"))).withColumn("_c", F.explode(spread("col")))
    share = F.sum(F.col(value) * F.col("_r.w") * F.col("_c.w") / (s * s))
    return (
        sent.groupBy(*keys, F.col("_r.t").alias("row"), F.col("_c.t").alias("col")).agg(share.alias("_share"))
        .filter(F.col("_share") >= threshold).drop("_share")
    )


# --- columns, boundaries, lines ---

def fill_columns(df: DataFrame, value: str, keys: Sequence[str] = SCENE) -> DataFrame:
    """Fill gaps down each raster column: linear, constant at the ends, all missing is 0."""
    known = df.filter(F.col(value).isNotNull()).select(*keys, "col", "row", value, "height")
    filled = profiles.fill_linear(known, [*keys, "col"], "row", [value], F.lit(0), F.col("height") - 1)
    base = df.select(*keys, "row", "col", "height", "width")
    return base.join(filled.select(*keys, "row", "col", value), [*keys, "row", "col"], "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(0.0))
    )


def ve_by_gradient(df: DataFrame, value: str, mask: str, keys: Sequence[str] = SCENE, sigma: float = 2.0, min_valid: float = 0.5) -> DataFrame:
    """Edge row per column: fill, smooth down the column, first largest step, plus 0.5.

    ``edge`` is NULL in columns with less than ``min_valid`` valid pixels; ``valid_share`` is
    the scene's share of usable columns.
    """
    seen = df.withColumn(value, F.when(~F.col(mask), F.col(value)))
    smooth = profiles.gaussian1d(fill_columns(seen, value, keys), [*keys, "col"], "row", F.col("height"), [value], sigma)
    tiles = tile_halo(smooth, "row", 0, 1)
    w = Window.partitionBy(*keys, "_tile", "col").orderBy("row")
    step = tiles.withColumn("_g", F.abs(F.lead(value).over(w) - F.col(value))).filter(F.col("_home") & F.col("_g").isNotNull())
    best = step.groupBy(*keys, "col").agg(F.max_by("row", F.struct("_g", -F.col("row"))).alias("_row"))
    valid = df.groupBy(*keys, "col").agg(F.avg(F.when(F.col(mask), 0.0).otherwise(1.0)).alias("valid_fraction"))
    share = valid.groupBy(*keys).agg(F.avg((F.col("valid_fraction") >= min_valid).cast("double")).alias("valid_share"))
    cols = valid.join(best, [*keys, "col"], "left").withColumn(
        "edge", F.when(F.col("valid_fraction") >= min_valid, F.col("_row") + 0.5)
    )
    return salted_join(cols.drop("_row"), share, keys, spread=["col"])


def lower_boundary(mask: DataFrame, keys: Sequence[str] = SCENE, min_run: int = 12, smooth: int = 9) -> DataFrame:
    """Lowest foreground row per column; runs of columns under ``min_run`` dropped.

    All runs stay when none is long enough; scenes left with under 4 columns vanish. The
    result is smoothed by a running median over the kept columns. One row per raster column
    and scene reaches the windows here.
    """
    low = mask.groupBy(*keys, "col").agg(F.max("row").alias("row"))
    by_scene = Window.partitionBy(*keys)
    runs = low.withColumn("_g", F.col("col") - F.row_number().over(by_scene.orderBy("col")))
    runs = runs.withColumn("_len", F.count("*").over(Window.partitionBy(*keys, "_g")))
    runs = runs.withColumn("_any", F.max(F.col("_len") >= min_run).over(by_scene))
    kept = runs.filter((F.col("_len") >= min_run) | ~F.col("_any"))
    kept = kept.withColumn("_n", F.count("*").over(by_scene)).withColumn("_pos", F.row_number().over(by_scene.orderBy("col")) - 1)
    kept = kept.filter(F.col("_n") >= 4).withColumn("row", F.col("row").cast("double"))
    return profiles.median_smooth(kept, keys, "_pos", "row", F.col("_n"), smooth).select(*keys, "col", "row")


def argmax_line(df: DataFrame, value: str, keys: Sequence[str] = SCENE) -> DataFrame:
    """Row of the largest value per column, the lowest row number on ties."""
    return df.groupBy(*keys, "col").agg(F.max_by("row", F.struct(value, -F.col("row"))).alias("row"))


def sample_along(
    transects: DataFrame, pixels: DataFrame, scenes: DataFrame, value: str, n: int = 100, keys: Sequence[str] = SCENE
) -> DataFrame:
    """``n`` evenly spaced samples per transect from the cell they fall in.

    ``transects`` and ``scenes`` share ``keys``; samples outside the raster or on a missing
    pixel are left out. ``dist`` is measured from the transect's start.
    """
    geo_cols = ["gt_a", "gt_c", "gt_e", "gt_f", "height", "width"]
    t = salted_join(transects, scenes.select(*keys, *geo_cols), keys, spread=["transect_index"])
    t = t.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    share = F.col("k") / float(n - 1)
    t = t.withColumn("px", F.col("x0") + share * (F.col("x1") - F.col("x0"))).withColumn("py", F.col("y0") + share * (F.col("y1") - F.col("y0")))
    t = t.withColumn("row", F.floor((F.col("py") - F.col("gt_f")) / F.col("gt_e")).cast("int"))
    t = t.withColumn("col", F.floor((F.col("px") - F.col("gt_c")) / F.col("gt_a")).cast("int"))
    t = t.filter((F.col("row") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") >= 0) & (F.col("col") < F.col("width")))
    t = t.withColumn("dist", F.hypot(F.col("px") - F.col("x0"), F.col("py") - F.col("y0"))).drop(*geo_cols)
    v = pixels.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, "row", "col", value)
    return t.join(v, [*keys, "row", "col"])


# --- morphology on foreground pixels ---

def disk(radius: int) -> list[tuple[int, int]]:
    r = range(-radius, radius + 1)
    return [(i, j) for i in r for j in r if i * i + j * j <= radius * radius]


def half_widths(offsets: Sequence[tuple[int, int]]) -> dict[int, int]:
    """Half width of a structuring element in each row; its rows must be unbroken and symmetric."""
    out: dict[int, int] = {}
    for i, j in offsets:
        out[i] = max(out.get(i, 0), abs(j))
    if sorted(set(offsets)) != sorted((i, j) for i, w in out.items() for j in range(-w, w + 1)):
        raise ValueError("rows of a structuring element must be unbroken and symmetric")
    return out


def _swept(mask: DataFrame, keys: Sequence[str], widths: dict[int, int], grow: bool, outside: bool) -> DataFrame:
    """Pixels that enough moved runs cover: any when growing, else one from every row of the element.

    Every run of a row is moved once per row of the element and widened or narrowed there; a sweep along each raster row counts the runs that
    lie over a place. Pixels are not copied. Runs of one row of the element never overlap when narrowed, so the count is that of the element's rows.
    """
    from tideline.operators.components import row_runs

    frame = mask.groupBy(*keys).agg(F.first("height").alias("height"), F.first("width").alias("width"))
    runs = salted_join(row_runs(mask, keys).drop("node"), frame, keys, spread=["row"])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in widths.items()])
    moved = runs.withColumn("_o", F.explode(rows)).withColumn("row", F.col("row") - F.col("_o.i")).filter((F.col("row") >= 0) & (F.col("row") < F.col("height")))
    last = F.col("width") - 1
    if grow:
        a, b, need = F.greatest(F.lit(0), F.col("c0") - F.col("_o.w")), F.least(last, F.col("c1") + F.col("_o.w")), F.lit(1)
    else:
        # beyond the frame lies foreground if ``outside``: runs that reach it are not narrowed there, and rows beyond it need no run
        a = F.when((F.col("c0") == 0) & F.lit(outside), 0).otherwise(F.col("c0") + F.col("_o.w"))
        b = F.when((F.col("c1") == last) & F.lit(outside), last).otherwise(F.col("c1") - F.col("_o.w"))
        beyond = [F.when((F.col("row") + i < 0) | (F.col("row") + i >= F.col("height")), 1).otherwise(0) for i in widths]
        need = F.lit(len(widths)) - (sum(beyond[1:], beyond[0]) if outside else F.lit(0))
    spans = moved.withColumns({"_a": a.cast("int"), "_b": b.cast("int")}).filter("_a <= _b")
    ends = F.explode(F.array(F.struct(F.col("_a").alias("at"), F.lit(1).alias("d")), F.struct((F.col("_b") + 1).alias("at"), F.lit(-1).alias("d"))))
    steps = spans.select(*keys, "row", "height", "width", ends.alias("_e")).groupBy(*keys, "row", "height", "width", F.col("_e.at").alias("_at")).agg(F.sum("_e.d").alias("_d"))
    w = Window.partitionBy(*keys, "row", "height", "width").orderBy("_at")
    over = steps.withColumns({"_n": F.sum("_d").over(w), "_to": F.lead("_at").over(w)}).filter(F.col("_to").isNotNull() & (F.col("_n") >= need))
    return over.select(*keys, "row", F.explode(F.sequence(F.col("_at"), F.col("_to") - 1)).alias("col"), "height", "width")


def dilate(mask: DataFrame, radius: int, keys: Sequence[str] = SCENE, offsets: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """Foreground grown by a disk and kept inside the scene (needs ``height``, ``width``)."""
    return _swept(mask, list(keys), half_widths(offsets or disk(radius)), True, True)


def erode(
    mask: DataFrame, radius: int, keys: Sequence[str] = SCENE, offsets: Sequence[tuple[int, int]] | None = None, outside: bool = True
) -> DataFrame:
    """Foreground whose whole disk is foreground; ``outside`` says what lies beyond the scene."""
    return _swept(mask, list(keys), half_widths(offsets or disk(radius)), False, outside)


def near_mask_edge(mask: DataFrame, keys: Sequence[str] = SCENE, distance: float = 1.5) -> DataFrame:
    """Pixels within ``distance`` of the mask's edge (dilation minus erosion by one)."""
    edge = dilate(mask, 1, keys).join(erode(mask, 1, keys), [*keys, "row", "col"], "left_anti")
    r = int(distance)
    reach = [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= distance * distance]
    return dilate(edge, r, keys, reach)


def render_lines(segs: DataFrame, keys: Sequence[str] = SCENE, width: float = 1.0) -> DataFrame:
    """Pixels whose centre lies within half a line width of a segment; shapes are merged.

    ``segs``: ``keys, x0, y0, x1, y1, height, width`` in pixel coordinates (x = column).
    Each segment looks at the rows of the columns it crosses only.
    """
    half = max(width, 1.0) / 2.0
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    from tideline.operators.spatial import _foot, cells

    cell = cells(x0, y0, x1, y1, 1.0, pad=half + 0.5)
    px = segs.withColumn("_p", F.explode(cell)).select("*", F.col("_p.cx").cast("int").alias("col"), F.col("_p.cy").cast("int").alias("row"))
    inside = (F.col("row") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") >= 0) & (F.col("col") < F.col("width"))
    near = _foot(F.col("col").cast("double"), F.col("row").cast("double"), [x0, y0, x1, y1])[0] <= half
    return px.filter(inside & near).select(*keys, "row", "col", "height", "width").distinct()
