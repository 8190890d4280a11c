"""Forecasts from the observation series and from the twin state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import geo
from tideline.lineage import cut
from tideline.operators import geometry, run_models, samples, selection, series
from tideline.operators.skew import salted_join


def forecast_distances(obs: DataFrame, horizon: int, seq_len: int = 10, split_date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Distance forecast of every transect with the best model its area allows, and one metrics row per area; see ``run_models.forecast_runs``."""
    return run_models.forecast_runs(obs, horizon, seq_len, split_date)


def forecast_shapes(
    lines: DataFrame, boxes: DataFrame, steps: int, k: int = 5, n_points: int = 256, all_steps: bool = False, strips: int = 64
) -> DataFrame:
    """Forecast coastlines from the history of whole lines.

    ``lines``: ``aoi_id, datetime, seq, x, y`` in lon/lat; ``boxes``: ``aoi_id, bbox``. Each
    line is sorted left to right, resampled, put into the unit box, rolled out by month and
    put back. Returns ``aoi_id, step, datetime, seq, x, y``.
    """
    b = F.col("bbox")
    v = salted_join(lines, boxes, ["aoi_id"], spread=["seq", "x"])
    # sorting strips of a fixed share of the box, so the order needs no whole line in a task
    strip = F.floor((F.col("x") - b[0]) / (F.greatest(b[2] - b[0], F.lit(1e-9)) / strips))
    from tideline.operators.skew import running_sum

    v = running_sum(v, ["aoi_id", "datetime"], ["x", "seq"], strip, F.lit(1), "_rank").withColumn("seq", F.col("_rank").cast("long"))
    r = geometry.resample(v.select("aoi_id", "datetime", "seq", "x", "y"), ["aoi_id", "datetime"], n_points)
    r = salted_join(r, boxes, ["aoi_id"], spread=["seq", "datetime"])
    unit = r.select("aoi_id", "datetime", "seq", geo.to_unit("x", b[0], b[2]).alias("u"), geo.to_unit("y", b[1], b[3]).alias("v"))
    f = samples.shape_forecast(cut(unit), steps, k, all_steps)
    f = salted_join(f, boxes, ["aoi_id"], spread=["seq", "step"])
    return f.select("aoi_id", "step", "datetime", "seq", geo.from_unit("u", b[0], b[2]).alias("x"), geo.from_unit("v", b[1], b[3]).alias("y"))


def predict(
    obs: DataFrame, lines: DataFrame, boxes: DataFrame, transects: DataFrame, years: float, mode: str = "auto", lookback_days: int = 730,
    seq_len: int = 10, k: int = 5, n_points: int = 256, areas: Sequence[str] = ("aoi_id",), now: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Forecast lines per AOI from the state: shape forecast first, distances as fallback.

    ``mode``: ``auto`` falls back for AOIs without a line history, ``shape`` makes that an
    error. The lookback counts from ``now`` (the time of the run if not given). Returns vertices ``aoi_id, datetime, seq, x, y, model_type`` and one status row
    per AOI. Transects and lines share one coordinate system.
    """
    days = max(1, int(round(years * 365.25)))
    steps = max(1, -(-days // 30))
    recent = cut(selection.lookback(lines, lookback_days, now=now))
    everyone = boxes.select("aoi_id").distinct()
    shaped = cut(recent.groupBy("aoi_id", "datetime").agg(F.count("*").alias("_n")).filter("_n >= 2").select("aoi_id").distinct())
    missing = cut(everyone.join(shaped, "aoi_id", "left_anti"))
    if mode == "shape" and not missing.isEmpty():
        raise ValueError("no observed waterline history for some areas")
    by_shape = forecast_shapes(recent.join(shaped, "aoi_id", "left_semi").select("aoi_id", "datetime", "seq", "x", "y"), boxes, steps, k, n_points)
    by_shape = by_shape.select("aoi_id", "datetime", "seq", "x", "y", F.lit("shape_trend").alias("model_type"))
    if missing.isEmpty():
        out = by_shape
    else:
        rows = selection.lookback(obs.join(missing, "aoi_id", "left_semi"), lookback_days, now=now)
        forecast, _ = forecast_distances(rows, days, seq_len)
        last = forecast.groupBy("aoi_id").agg(F.max("date").alias("date"))
        final = forecast.join(last, ["aoi_id", "date"], "left_semi")
        pts = series.forecast_points(final, transects).filter("boundary = 'waterline_forecast'")
        out = by_shape.unionByName(pts.select("aoi_id", F.col("date").cast("timestamp").alias("datetime"), F.col("transect_index").cast("long").alias("seq"), "x", "y", "model_type"))
    status = everyone.join(shaped.withColumn("_s", F.lit(True)), "aoi_id", "left").select(
        "aoi_id", F.when(F.col("_s"), "shape_trend").otherwise("distance").alias("method"), F.when(F.col("_s").isNull(), "no_observed_waterline_history").alias("warning")
    )
    return out, status
