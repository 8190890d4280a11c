"""Scores of masks, boundaries, transects and ensembles, and counts of batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.raster import argmax_line
from tideline.operators.skew import exact_quantiles, salted_join
from tideline.operators.spatial import nearest_segment

SMOOTH = 1e-6


def mask_counts(pixels: DataFrame, pred: Column, truth: Column, by: Sequence[str]) -> DataFrame:
    """True/false positives and false negatives per sample."""
    return pixels.groupBy(*by).agg(
        F.count_if(pred & truth).alias("tp"), F.count_if(pred & ~truth).alias("fp"), F.count_if(~pred & truth).alias("fn")
    )


def join_masks(pred: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two sets of foreground pixels side by side: ``in_pred``, ``in_truth``."""
    cols = [*keys, "row", "col"]
    p, t = pred.select(*cols, F.lit(True).alias("in_pred")), truth.select(*cols, F.lit(True).alias("in_truth"))
    return p.join(t, cols, "full_outer").fillna(False, ["in_pred", "in_truth"])


def sample_metrics(counts: DataFrame) -> DataFrame:
    """IoU, precision, recall and F1 per sample with 1e-6 smoothing."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "iou": (tp + SMOOTH) / (tp + fp + fn + SMOOTH),
        "precision": (tp + SMOOTH) / (tp + fp + SMOOTH),
        "recall": (tp + SMOOTH) / (tp + fn + SMOOTH),
        "f1": (2.0 * tp + SMOOTH) / (2.0 * tp + fp + fn + SMOOTH),
    })


def mean_metrics(samples: DataFrame, by: Sequence[str] = (), names: Sequence[str] = ("iou", "precision", "recall", "f1")) -> DataFrame:
    """Mean over samples; missing values do not count."""
    return samples.groupBy(*by).agg(*[F.avg(F.nanvl(F.col(n), F.lit(None))).alias(n) for n in names])


def dice_bce(pixels: DataFrame, logit: str, target: str, sample: Sequence[str], weight: float = 0.5, pos_weight: float = 1.0) -> DataFrame:
    """Mean over samples of Dice, and mean over pixels of cross entropy in its stable form."""
    z, y = F.col(logit), F.col(target).cast("double")
    soft = F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))
    bce = (1.0 - y) * z + (1.0 + (pos_weight - 1.0) * y) * soft
    p = 1.0 / (1.0 + F.exp(-z))
    per = pixels.groupBy(*sample).agg(
        F.sum(p * y).alias("_i"), (F.sum(p) + F.sum(y)).alias("_u"), F.sum(bce).alias("_b"), F.count("*").alias("_n")
    )
    dice = 1.0 - (2.0 * F.col("_i") + SMOOTH) / (F.col("_u") + SMOOTH)
    return per.agg(
        (weight * F.sum("_b") / F.sum("_n") + (1.0 - weight) * F.avg(dice)).alias("loss"), F.avg(dice).alias("dice_loss"), (F.sum("_b") / F.sum("_n")).alias("bce_loss")
    )


def metrics_by_horizon(samples: DataFrame, value: str = "iou", horizon: str = "horizon") -> DataFrame:
    """Mean per horizon in months and over all samples (horizon NULL), from one rollup."""
    return samples.rollup(horizon).agg(F.avg(F.nanvl(F.col(value), F.lit(None))).alias(value), F.count("*").alias("n"))


def horizon_columns(samples: DataFrame, years: Sequence[int], value: str = "iou", horizon: str = "horizon") -> DataFrame:
    """One row: overall mean and ``<value>_<y>yr`` for each requested horizon."""
    clean = F.nanvl(F.col(value), F.lit(None))
    return samples.agg(
        F.avg(clean).alias(value), *[F.avg(F.when(F.col(horizon) == y * 12, clean)).alias(f"{value}_{y}yr") for y in years]
    )


def _as_points(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    return mask.select(*keys, "row", "col", x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"), F.lit(0.0).alias("cum0"))


def boundary_metrics(pred: DataFrame, truth: DataFrame, keys: Sequence[str], start: float = 4.0) -> DataFrame:
    """ASSD and HD95 between two pixel sets; both are NULL for a sample where either set is empty."""
    keys = list(keys)
    p, t = _as_points(pred, keys), _as_points(truth, keys)
    sides = []
    for name, a, b in (("p", p, t), ("t", t, p)):
        d = nearest_segment(a, b, [*keys, "row", "col"], keys, start)
        mean = d.groupBy(*keys).agg(F.avg("distance").alias(f"_mean_{name}"))
        far = exact_quantiles(d, keys, "distance", [0.95], [f"_far_{name}"])
        sides.append(mean.join(far, keys))
    every = pred.select(*keys).unionByName(truth.select(*keys)).distinct()
    return every.join(sides[0].join(sides[1], keys), keys, "left").select(
        *keys, ((F.col("_mean_p") + F.col("_mean_t")) / 2).alias("assd"), F.greatest("_far_p", "_far_t").alias("hd95")
    )


def transect_error(pixels: DataFrame, prob: str, truth: str, keys: Sequence[str]) -> DataFrame:
    """MAE and RMSE of the row of the first maximum per column; columns without truth do not count, and a sample without any gets NULL."""
    has = pixels.groupBy(*keys, "col").agg(F.max(F.col(truth).cast("int")).alias("_any")).filter(F.col("_any") > 0)
    t = argmax_line(pixels.withColumn("_t", F.col(truth).cast("int")), "_t", keys).withColumnRenamed("row", "_tr")
    p = argmax_line(pixels, prob, keys).withColumnRenamed("row", "_pr")
    err = F.abs(F.col("_tr") - F.col("_pr"))
    found = (
        has.join(t, [*keys, "col"]).join(p, [*keys, "col"]).groupBy(*keys)
        .agg(F.avg(err).alias("transect_mae"), F.sqrt(F.avg(err * err)).alias("transect_rmse"), F.count("*").alias("n_columns"))
    )
    return pixels.select(*keys).distinct().join(found, list(keys), "left").withColumn("n_columns", F.coalesce("n_columns", F.lit(0)))


def ensemble_summary(samples: DataFrame, value: str, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Mean, population deviation, p10, p90 and binary per pixel; a pixel has one value per ensemble pass."""
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.9)))
    out = samples.groupBy(*keys, "row", "col").agg(
        F.avg(value).alias("central"), F.stddev_pop(value).alias("uncertainty"), q.alias("_q"), F.count("*").alias("n_samples")
    )
    return out.select(
        *keys, "row", "col", "central", "uncertainty", F.col("_q")[0].alias("env_low"), F.col("_q")[1].alias("env_high"),
        (F.col("central") >= threshold).alias("binary"), "n_samples",
    )


def ensemble_scene(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scene-level means, maxima, coverage and envelope width."""
    return summary.groupBy(*keys).agg(
        F.avg("central").alias("mean_prob"), F.max("central").alias("max_prob"), F.avg("uncertainty").alias("mean_uncertainty"),
        F.max("uncertainty").alias("max_uncertainty"), F.avg(F.col("binary").cast("double")).alias("coverage"),
        F.avg(F.col("env_high") - F.col("env_low")).alias("envelope_width"),
    )


def uncertainty_at_line(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean uncertainty at the row of the largest central value of each column."""
    best = summary.groupBy(*keys, "col").agg(F.max_by("uncertainty", F.struct("central", -F.col("row"))).alias("_u"))
    return best.groupBy(*keys).agg(F.avg("_u").alias("uncertainty_at_line"))


def best_so_far(log: DataFrame, step: str, metric: str, by: Sequence[str] = (), higher: bool = True, chunk: int = 4096) -> DataFrame:
    """Running best value, the step it was reached at and steps since.

    A scan in chunks of ``chunk`` step numbers: each chunk is scanned by itself, chunk results are scanned per run, and both are put together, so a
    run of any length is never sorted in one task. Steps are numbers and unique in their run.
    """
    by, sign = list(by), (1 if higher else -1)
    part, here = [*by, "_chunk"], F.col(metric) * sign
    rows = log.withColumn("_chunk", F.floor(F.col(step) / chunk))
    inner = Window.partitionBy(*part).orderBy(step)
    upto, before = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)

    def carried(df: DataFrame, aggs: dict[str, Column], scans: dict[str, Column]) -> DataFrame:
        """Per chunk what all chunks before it give; one row per chunk and run."""
        return df.groupBy(*part).agg(*[a.alias(n) for n, a in aggs.items()]).select(*part, *[c.over(earlier).alias(n) for n, c in scans.items()])

    first = carried(rows, {"_m": F.max(here), "_c": F.count("*")}, {"_top": F.max("_m"), "_rows": F.sum("_c")})
    seen = rows.withColumns({"_in": F.max(here).over(upto), "_prev": F.max(here).over(before), "_n": F.row_number().over(inner)}).join(first, part)
    prior = F.greatest("_prev", "_top")  # greatest passes over nulls
    best = F.greatest("_in", "_top")
    seen = seen.withColumns({"best": best * sign, "_n": F.col("_n") + F.coalesce("_rows", F.lit(0))})
    seen = seen.withColumn("_at", F.when(prior.isNull() | (best > prior), F.struct(F.col(step).alias("s"), F.col("_n").alias("n"))))
    seen = seen.drop("_in", "_prev", "_top", "_rows")
    late = carried(seen, {"_l": F.max("_at")}, {"_last": F.max("_l")})
    out = seen.withColumn("_own", F.max("_at").over(upto)).join(late, part).withColumn("_own", F.coalesce("_own", "_last"))
    return out.select(*log.columns, "best", F.col("_own.s").alias("best_step"), (F.col("_n") - F.col("_own.n")).cast("bigint").alias("stale_steps"))


def batch_counts(df: DataFrame, by: Sequence[str] = (), status: str = "status") -> DataFrame:
    """Counts of each outcome of a batch."""
    is_ = lambda s: F.count_if(F.col(status) == s)
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), *[is_(s).alias(f"n_{s}") for s in ("ok", "skipped", "failed", "dry_run")],
        *([F.count_if(F.col("warning").isNotNull()).alias("n_warnings")] if "warning" in df.columns else []),
    )


def split_stats(df: DataFrame, aoi: str = "aoi_id", year: str = "year", part: str = "part") -> DataFrame:
    """Sample counts per part by AOI and by year, in one pass."""
    sets = F.explode(F.array(
        F.struct(F.lit("aoi").alias("kind"), F.col(aoi).cast("string").alias("key")),
        F.struct(F.lit("year").alias("kind"), F.col(year).cast("string").alias("key")),
    ))
    rows = df.select(part, sets.alias("_s")).filter(F.col("_s.key").isNotNull())
    return rows.groupBy(part, "_s.kind", "_s.key").agg(F.count("*").alias("n"))


def dataset_inventory(files: DataFrame, expected: DataFrame, folder: str = "folder", min_total: int = 300) -> DataFrame:
    """File counts per expected folder with warnings for missing folders and a low total."""
    n = files.groupBy(folder).agg(F.count("*").alias("n_files"))
    out = expected.join(n, folder, "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    out = out.withColumn("warning", F.when(F.col("n_files") == 0, "missing_folder"))
    total = out.agg(F.sum("n_files").alias("n_files")).select(
        F.lit("TOTAL").alias(folder), "n_files", F.when(F.col("n_files") < min_total, "few_files").alias("warning")
    )
    return out.select(folder, "n_files", "warning").unionByName(total)


def twin_summary(state: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows and last observation per AOI beside the stored metadata."""
    agg = state.groupBy("aoi_id").agg(F.count("*").alias("timeseries_rows"), F.max("datetime").alias("last_observation_at"))
    kept = meta.select("aoi_id", "last_assimilation_at", "last_retrained_at", "active_model_run_id")
    return kept.join(agg, "aoi_id", "left").withColumn("timeseries_rows", F.coalesce("timeseries_rows", F.lit(0)))
