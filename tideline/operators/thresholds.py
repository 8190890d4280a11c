"""Index thresholds from class statistics, class sampling and quality gates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.lineage import cut
from tideline.operators.skew import exact_quantiles, salted_join

SCENE = ["aoi_id", "scene_id"]
BANDWIDTH = 0.01
GRID = 1000
# Distinct values that one task weighs at a time; more of a key are dealt to more tasks.
PART_VALUES = 20000
# Bins of the per-class density and the falling prominences its peaks may have.
CLASS_BINS = np.arange(-1.0, 1.0, 0.01)
RUNGS = [0.5 - 0.05 * i for i in range(10)]


def find_peaks(y: np.ndarray, prominence: float) -> tuple[np.ndarray, np.ndarray]:
    """Local maxima (plateaus at their middle) with at least ``prominence``, and theirs."""
    turns = np.flatnonzero(np.diff(y) != 0)
    starts = np.concatenate(([0], turns + 1))
    stops = np.concatenate((turns, [len(y) - 1]))
    level = y[starts]
    inner = np.arange(1, len(level) - 1)
    top = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])]
    peaks, sizes = [], []
    for i in top:
        left, right = np.flatnonzero(level[:i] > level[i]), np.flatnonzero(level[i + 1 :] > level[i])
        low_left = level[(left[-1] + 1 if left.size else 0) : i + 1].min()
        low_right = level[i : (i + 1 + right[0] if right.size else len(level))].min()
        size = level[i] - max(low_left, low_right)
        if size >= prominence:
            peaks.append((starts[i] + stops[i]) // 2)
            sizes.append(size)
    return np.array(peaks, dtype=int), np.array(sizes, dtype=float)


def kernel_parts(values: np.ndarray, counts: np.ndarray, grid: np.ndarray, h: float = BANDWIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Per grid point the largest exponent of the weighted Gaussian kernels and the kernels' sum relative to it."""
    top, total = np.empty(len(grid)), np.empty(len(grid))
    logc = np.log(counts)
    for s in range(0, len(grid), 50):
        e = logc[None, :] - (grid[s : s + 50, None] - values[None, :]) ** 2 / (2 * h * h)
        top[s : s + 50] = e.max(axis=1)
        total[s : s + 50] = np.exp(e - top[s : s + 50, None]).sum(axis=1)
    return top, total


def density_curves(df: DataFrame, keys: Sequence[str], value: str, fixed: bool = False) -> DataFrame:
    """Per key the exact log density of ``value`` on ``GRID`` points of its range (or on ``CLASS_BINS``).

    Equal values are counted first; a key's distinct values are dealt to parts by hash, every part gives one
    (largest exponent, sum) pair a grid point, and the pairs are joined by log-sum-exp. Columns: keys, ``_lo``, ``_hi``, ``_y`` (the curve).
    """
    keys = list(keys)
    counts = cut(df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n")))
    span = cut(
        counts.groupBy(*keys).agg(F.count("*").alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
        .withColumn("_parts", F.ceil(F.col("_d") / PART_VALUES).cast("int"))
    )
    placed = salted_join(counts, span.drop("_d", "_all"), keys, spread=["_v"]).withColumn("_part", F.pmod(F.xxhash64("_v"), F.col("_parts")).cast("int"))

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = CLASS_BINS if fixed else np.linspace(pdf["_lo"].iloc[0], pdf["_hi"].iloc[0], GRID)
        top, total = kernel_parts(pdf["_v"].to_numpy(float), pdf["_n"].to_numpy(float), grid)
        out = pd.DataFrame({"_g": np.arange(len(grid)), "_m": top, "_s": total})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    schema = ", ".join(f"`{k}` {placed.schema[k].dataType.simpleString()}" for k in keys) + ", _g int, _m double, _s double"
    pairs = cut(placed.groupBy(*keys, "_part").applyInPandas(weigh, schema))
    peak = pairs.groupBy(*keys, "_g").agg(F.max("_m").alias("_top"))
    joined = pairs.join(peak, [*keys, "_g"]).groupBy(*keys, "_g", "_top").agg(F.sum(F.col("_s") * F.exp(F.col("_m") - F.col("_top"))).alias("_sum"))
    rows = joined.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_g", (F.col("_top") + F.log("_sum")).alias("_y")))).alias("_c"))
    norm = F.log(F.col("_all") * F.lit(BANDWIDTH * float(np.sqrt(2 * np.pi))))
    return rows.join(span, keys).select(*keys, "_lo", "_hi", F.transform("_c", lambda c: c["_y"] - norm).alias("_y"))


def two_peaks(y: np.ndarray, lo: float, hi: float, prominence: float) -> float | None:
    """``0.2*low + 0.8*high`` of the two most prominent modes of a log density between ``lo`` and ``hi``."""
    peaks, sizes = find_peaks(y, prominence)
    if len(peaks) < 2:
        return None
    low, high = np.sort(np.linspace(lo, hi, GRID)[peaks[np.argsort(sizes, kind="stable")[-2:]]])
    return float(0.2 * low + 0.8 * high)


def highest_rung(y: np.ndarray) -> float:
    """Mode of a class on ``CLASS_BINS``: of the peaks at or above the highest rung that any peak reaches, the last if any is negative, else the first.

    A curve whose peaks reach no rung gives its largest bin.
    """
    density = np.exp(y)
    peaks, sizes = find_peaks(density, 0.0)
    reached = [r for r in RUNGS if len(sizes) and sizes.max() >= r - 1e-12]
    if not reached:
        return float(CLASS_BINS[np.argmax(density)])
    at = CLASS_BINS[peaks[sizes >= reached[0] - 1e-12]]
    return float(at[-1] if at[0] < 0 else at[0])


def _curve_udf(fn):
    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for curves, lows, highs in parts:
            yield pd.Series([fn(np.asarray(y, dtype=float), lo, hi) for y, lo, hi in zip(curves, lows, highs, strict=True)], dtype="float64")

    return run


def weighted_peaks(
    df: DataFrame, value: str, cls: str, a: int, b: int, keys: Sequence[str] = SCENE, min_class: int = 5, min_total: int = 20, prominence: float = 0.2
) -> DataFrame:
    """Threshold between two classes per key from the modes of their joint density.

    A class under ``min_class`` values or a total under ``min_total`` gives the mean of the
    class means (0 when a class is empty), as does a density with under two modes. The older
    rule is ``min_class=1, min_total=10, prominence=0.5``. Adds ``threshold``, ``n_a, n_b``.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & F.col(cls).isin(a, b))
    in_a, in_b = F.col(cls) == a, F.col(cls) == b
    stats = rows.groupBy(*keys).agg(
        F.count_if(in_a).alias("n_a"), F.count_if(in_b).alias("n_b"),
        F.avg(F.when(in_a, F.col(value))).alias("_ma"), F.avg(F.when(in_b, F.col(value))).alias("_mb"),
    )
    enough = (F.col("n_a") >= min_class) & (F.col("n_b") >= min_class) & (F.col("n_a") + F.col("n_b") >= min_total)
    peak = _curve_udf(lambda y, lo, hi: two_peaks(y, lo, hi, prominence))
    stats = cut(stats)
    ready = salted_join(rows, stats.filter(enough).select(*keys), keys, spread=[value])
    modes = density_curves(ready, keys, value).select(*keys, peak("_y", "_lo", "_hi").alias("_peak"))
    middle = F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), 0.0).otherwise((F.col("_ma") + F.col("_mb")) / 2)
    return stats.join(modes, keys, "left").select(
        *keys, "n_a", "n_b", F.coalesce(F.nanvl("_peak", F.lit(None)), middle).alias("threshold")
    )


def class_peaks(df: DataFrame, value: str, cls: str, a: int, b: int, keys: Sequence[str] = SCENE) -> DataFrame:
    """Threshold ``0.2*A + 0.8*B`` from one density per class.

    ``A`` is the mode of class ``a``; ``B`` the peak of class ``b`` with prominence from 0.5
    down to 0.05: with several, the largest if any is negative, else the first; none gives
    the mode. Under 10 values in a class the medians stand in.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & F.col(cls).isin(a, b))
    n = rows.groupBy(*keys, cls).agg(F.count("*").alias("_n"))
    n = n.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col(cls) == a, F.col("_n"))), F.lit(0)).alias("n_a"),
        F.coalesce(F.max(F.when(F.col(cls) == b, F.col("_n"))), F.lit(0)).alias("n_b"),
    )
    med = exact_quantiles(rows, [*keys, cls], value, [0.5], ["_med"])
    curves = density_curves(rows, [*keys, cls], value, fixed=True)
    one, two = _curve_udf(lambda y, lo, hi: CLASS_BINS[np.argmax(y)]), _curve_udf(lambda y, lo, hi: highest_rung(y))
    first = curves.filter(F.col(cls) == a).select(*keys, one("_y", "_lo", "_hi").alias("_pa"))
    second = curves.filter(F.col(cls) == b).select(*keys, two("_y", "_lo", "_hi").alias("_pb"))
    pick = lambda c, name: med.filter(F.col(cls) == c).select(*keys, F.col("_med").alias(name))
    out = n
    for part in (first, second, pick(a, "_ma"), pick(b, "_mb")):
        out = out.join(part, keys, "left")
    few = (F.col("n_a") < 10) | (F.col("n_b") < 10)
    return out.select(
        *keys, "n_a", "n_b",
        F.when(few, 0.2 * F.col("_ma") + 0.8 * F.col("_mb")).otherwise(0.2 * F.col("_pa") + 0.8 * F.col("_pb")).alias("threshold"),
    )


def tz_values(df: DataFrame, value: str, keys: Sequence[str] = SCENE) -> DataFrame:
    """Percentiles 0.5 and 10 of a class: bounds of the transition zone."""
    return exact_quantiles(df.filter(~F.isnan(value)), keys, value, [0.005, 0.10], ["tz_low", "tz_high"])


def clip_index(df: DataFrame, reference: DataFrame, value: str, cls: str, grow: int = 0, keys: Sequence[str] = SCENE) -> DataFrame:
    """Classified index values inside the reference mask, grown by a disk of ``grow`` pixels."""
    from tideline.operators.raster import dilate

    mask = dilate(reference, grow, keys) if grow else reference
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & F.col(cls).isNotNull())
    return rows.join(mask.select(*keys, "row", "col"), [*keys, "row", "col"], "left_semi")


def balance(df: DataFrame, cls: str, seed: Column | int, ids: Sequence[str] = ("row", "col"), keys: Sequence[str] = SCENE) -> DataFrame:
    """Random subset of the larger class, as many rows as the smaller class has.

    Rows are ordered by a seeded hash. The hash space is split into 256 ranges per class, so
    the cut rank is found by sorting one range only, and a huge class is never in one task.
    """
    keys = list(keys)
    s = seed if isinstance(seed, Column) else F.lit(seed)
    h = F.xxhash64(s, *[F.col(c) for c in ids])
    hashed = df.withColumn("_h", h).withColumn("_part", F.pmod(F.shiftright(F.col("_h"), 56) + 128, F.lit(256)))
    per = hashed.groupBy(*keys, cls, "_part").agg(F.count("*").alias("_c"))
    wp = Window.partitionBy(*keys, cls).orderBy("_part")
    spans = per.withColumn("_before", F.coalesce(F.sum("_c").over(wp.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = spans.groupBy(*keys, cls).agg(F.sum("_c").alias("_size"))
    least = sizes.groupBy(*keys).agg(F.min("_size").alias("_keep"))
    plan = spans.join(least, keys).filter(F.col("_before") < F.col("_keep"))
    whole = plan.filter(F.col("_before") + F.col("_c") <= F.col("_keep")).select(*keys, cls, "_part")
    partial = plan.filter(F.col("_before") + F.col("_c") > F.col("_keep"))
    all_in = salted_join(hashed, whole, [*keys, cls, "_part"], spread=["_h"])
    edge = salted_join(hashed, partial.select(*keys, cls, "_part", "_before", "_keep"), [*keys, cls, "_part"], spread=["_h"])
    w = Window.partitionBy(*keys, cls, "_part").orderBy("_h", *ids)
    some = edge.withColumn("_rn", F.row_number().over(w)).filter(F.col("_before") + F.col("_rn") <= F.col("_keep"))
    return all_in.select(*df.columns).unionByName(some.select(*df.columns))


def sample_values(df: DataFrame, value: str, n: int, seed: int = 0, ids: Sequence[str] = ("row", "col"), keys: Sequence[str] = SCENE) -> DataFrame:
    """At most ``n`` finite values per key in seeded hash order (a top-n, so cut before the shuffle)."""
    rows = df.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(c) for c in ids]))
    w = Window.partitionBy(*keys).orderBy("_h", *ids)
    picked = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn", "_h")
    return picked.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))


def median_split(df: DataFrame, value: str, keys: Sequence[str], out: str = "class") -> DataFrame:
    """1 above the key's median, 2 at or below it."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    med = exact_quantiles(rows, keys, value, [0.5], ["_median"])
    spread = [c for c in rows.columns if c not in keys]
    return salted_join(rows, med, keys, spread=spread).withColumn(
        out, F.when(F.col(value) > F.col("_median"), 1).otherwise(2).cast("tinyint")
    ).drop("_median")


def choose_threshold(stats: DataFrame, how: str, mode: str = "weighted_peaks", manual: float | None = None) -> DataFrame:
    """Computed threshold, or 0.3 when the classes are too small, or the manual one.

    ``how='transects'`` needs over 10 values in both classes; ``'raster'`` over 100 in all and
    over 50 in both. ``stats`` has ``n_a, n_b, threshold``.
    """
    if mode != "weighted_peaks":
        return stats.withColumn("threshold", F.lit(float(manual))).withColumn("threshold_source", F.lit("manual"))
    a, b = F.col("n_a"), F.col("n_b")
    enough = (a > 10) & (b > 10) if how == "transects" else (a + b > 100) & (a > 50) & (b > 50)
    return stats.withColumn("threshold", F.when(enough, F.col("threshold")).otherwise(0.3)).withColumn(
        "threshold_source", F.when(enough, "computed").otherwise("default")
    )


# --- edge points along transects ---

def edge_points(samples: DataFrame, transects: DataFrame, thresholds: DataFrame, value: str, keys: Sequence[str] = SCENE) -> DataFrame:
    """First sample above the threshold on each transect, else its midpoint (flagged).

    Keeps every transect: ``sample_count`` and ``mean_value`` come with the point.
    """
    t_keys = [*keys, "transect_index"]
    joined = salted_join(samples, thresholds.select(*keys, "threshold"), keys, spread=["transect_index", "k"])
    over = F.col(value) > F.col("threshold")
    found = joined.groupBy(*t_keys).agg(
        F.min(F.when(over, F.struct("dist", "px", "py"))).alias("_e"), F.count("*").alias("_n"), F.avg(value).alias("mean_value")
    )
    base = transects.select(*t_keys, "x0", "y0", "x1", "y1")
    base = salted_join(base, thresholds.select(*keys, "threshold"), keys, "left", spread=["transect_index"])
    out = base.join(found, t_keys, "left")
    return out.select(
        *t_keys,
        F.coalesce("_e.px", (F.col("x0") + F.col("x1")) / 2).alias("x"),
        F.coalesce("_e.py", (F.col("y0") + F.col("y1")) / 2).alias("y"),
        F.col("_e.dist").alias("edge_distance"),
        "threshold",
        F.coalesce("_n", F.lit(0)).alias("sample_count"),
        "mean_value",
        F.when(F.col("_e").isNull(), F.when(F.col("_n").isNull(), "fallback_midpoint").otherwise("midpoint")).otherwise("threshold").alias("method"),
    )


# --- quality gates ---

# Limits of the quality gates.
GATES = {
    "min_valid": 0.2, "min_class_share": 0.01, "max_cloud": 70.0, "min_valid_gradient": 0.3, "min_index_count": 100,
    "min_index_range": 0.12, "min_valid_columns": 0.4, "min_columns": 5,
}


def label_gate(valid: Column, veg: Column, nonveg: Column) -> Column:
    """Reason a scene is skipped by the reference-guided labeller, NULL when it passes."""
    return F.when(valid < GATES["min_valid"], "mostly_cloud_or_nodata").when(
        (veg < GATES["min_class_share"]) | (nonveg < GATES["min_class_share"]), "insufficient_class_separation"
    )


def gradient_gate(cloud: Column, valid: Column, n_index: Column, index_range: Column, column_share: Column, n_columns: Column) -> Column:
    """Reason a scene is skipped by the gradient labeller, in order, NULL when it passes."""
    return (
        F.when(cloud > GATES["max_cloud"], "cloud")
        .when(valid < GATES["min_valid_gradient"], "mostly_masked")
        .when(n_index < GATES["min_index_count"], "no_valid_ndvi")
        .when(index_range < GATES["min_index_range"], "ndvi_range")
        .when(column_share < GATES["min_valid_columns"], "sparse_cols")
        .when(n_columns < GATES["min_columns"], "too_few_valid_cols")
    )


def scene_quality(df: DataFrame, mask: Column, index: str, keys: Sequence[str] = SCENE) -> DataFrame:
    """Shares and index spread per scene that the gates look at."""
    ok = ~mask & F.col(index).isNotNull()
    base = df.groupBy(*keys).agg(
        F.avg(F.when(mask, 0.0).otherwise(1.0)).alias("valid_share"), F.count_if(ok).alias("n_index"), F.count("*").alias("n_pixels")
    )
    spread = exact_quantiles(df.filter(ok), keys, index, [0.1, 0.9], ["_p10", "_p90"])
    return base.join(spread, list(keys), "left").withColumn("index_range", F.col("_p90") - F.col("_p10")).drop("_p10", "_p90")


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    """How often each reason occurs, most frequent first, then by name."""
    return df.groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), reason)
