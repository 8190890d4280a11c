"""Observation series per transect: daily values, sequences, forecasts and scores.

Rows are keyed by ``(aoi_id, transect_index)``. After daily resampling a series has one row
per day without gaps, so ranks and frames are day arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.skew import nth, ordered_neighbours, salted_join, tile_halo

TRANSECT = ["aoi_id", "transect_index"]
VALUES = ["ve", "wl"]
# Days per sorting chunk of one transect.
CHUNK_DAYS = 256
DAY = 86400.0


def _seconds(ts: Column | str) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp")) / 1e6


def day_number(ts: Column | str) -> Column:
    return F.floor(_seconds(ts) / DAY).cast("int")


def _inner_slope(h0: str, h1: str, m0: str, m1: str) -> str:
    """Weighted harmonic mean of the two secants, 0 at a turn."""
    return f"CASE WHEN {m0} * {m1} <= 0 THEN 0D ELSE (3 * {h0} + 3 * {h1}) / ((2 * {h1} + {h0}) / {m0} + ({h1} + 2 * {h0}) / {m1}) END"


def _end_slope(d: str, m0: str, m1: str) -> str:
    """Three-point estimate ``d`` at an end, kept monotone."""
    return f"CASE WHEN signum({d}) <> signum({m0}) THEN 0D WHEN signum({m0}) <> signum({m1}) AND abs({d}) > 3 * abs({m0}) THEN 3 * {m0} ELSE {d} END"


def daily_series(obs: DataFrame, keys: Sequence[str] = TRANSECT, values: Sequence[str] = VALUES, ts: str = "datetime", tie: str | None = None) -> DataFrame:
    """One row per UTC day from the first to the last observed day, by monotone cubic (PCHIP).

    Only rows with every value count; equal times are averaged first. A series with one
    distinct time keeps its last value (by ``tie``). The first day, when its midnight lies
    before the first observation, takes the next day's value, or the first observed value
    when there is no next day. Adds ``day`` (days since 1970) and ``date``.
    """
    keys = list(keys)
    full = obs.dropna(subset=list(values)).withColumn("_x", _seconds(ts))
    order = F.struct("_x", *([tie] if tie else []))
    ends = full.groupBy(*keys).agg(
        F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), *[F.max_by(v, order).alias(f"_last_{v}") for v in values]
    )
    knots = full.groupBy(*keys, "_x").agg(*[F.avg(v).alias(v) for v in values])
    near = ordered_neighbours(knots, keys, ["_x"], F.floor(F.col("_x") / (DAY * CHUNK_DAYS)), ["_x", *values], before=1, after=2)
    near = salted_join(near, ends, keys, spread=["_x"])
    base = near.selectExpr(
        *keys, "_x", *values, "_x0", "_x1", *[f"_last_{v}" for v in values],
        "_x - get(prev, 0)._x AS hp", "get(next, 0)._x - _x AS h", "get(next, 1)._x - get(next, 0)._x AS hn", "get(next, 0)._x AS _xn",
        *[f"(get(next, 0).{v} - {v}) / (get(next, 0)._x - _x) AS m_{v}" for v in values],
        *[f"({v} - get(prev, 0).{v}) / (_x - get(prev, 0)._x) AS mp_{v}" for v in values],
        *[f"(get(next, 1).{v} - get(next, 0).{v}) / (get(next, 1)._x - get(next, 0)._x) AS mn_{v}" for v in values],
        f"CAST(floor(_x0 / {DAY}) AS INT) AS _a", f"CAST(floor(_x1 / {DAY}) AS INT) AS _z", f"CAST(ceil(_x / {DAY}) AS INT) AS _lo",
    )
    # three-point estimates at either end of the interval
    ends3 = [f"((2 * h + hn) * m_{v} - h * mn_{v}) / (h + hn) AS e0_{v}" for v in values]
    ends3 += [f"((2 * h + hp) * m_{v} - h * mp_{v}) / (h + hp) AS e1_{v}" for v in values]
    # the last knot's own midnight belongs to the interval that ends there
    hi = f"CAST(CASE WHEN _xn = _x1 THEN floor(_xn / {DAY}) ELSE ceil(_xn / {DAY}) - 1 END AS INT) AS _hi"
    base = base.selectExpr("*", *ends3, hi)
    tangents = []
    for v in values:
        m, mp, mn = f"m_{v}", f"mp_{v}", f"mn_{v}"
        tangents.append(
            f"CASE WHEN hp IS NOT NULL THEN {_inner_slope('hp', 'h', mp, m)} WHEN hn IS NOT NULL THEN {_end_slope(f'e0_{v}', m, mn)} ELSE {m} END AS d0_{v}"
        )
        tangents.append(
            f"CASE WHEN hn IS NOT NULL THEN {_inner_slope('h', 'hn', m, mn)} WHEN hp IS NOT NULL THEN {_end_slope(f'e1_{v}', m, mp)} ELSE {m} END AS d1_{v}"
        )
    # days of the interval; the first day looks at the next midnight when its own is too early;
    # a lone knot, or knots inside one day after its midnight, give one day without a time
    at = "array<struct<day:int,at:double>>"
    days = f"CASE WHEN _hi >= _lo THEN transform(sequence(_lo, _hi), d -> struct(d AS day, d * {DAY} AS at)) ELSE CAST(array() AS {at}) END"
    lead_in = f"CASE WHEN _x0 > _a * {DAY} AND _lo <= _a + 1 AND _hi >= _a + 1 THEN array(struct(_a AS day, (_a + 1) * {DAY} AS at)) ELSE CAST(array() AS {at}) END"
    flat = f"CASE WHEN _x0 = _x1 OR (_x0 > _a * {DAY} AND _a = _z AND hp IS NULL) THEN array(struct(_a AS day, CAST(NULL AS DOUBLE) AS at)) ELSE CAST(array() AS {at}) END"
    rows = base.selectExpr("*", *tangents, f"explode(concat({days}, {lead_in}, {flat})) AS g").selectExpr("*", "g.at - _x AS t")
    cubic = lambda v: f"{v} + t * (d0_{v} + t * ((3 * m_{v} - 2 * d0_{v} - d1_{v}) / h + t * (d0_{v} + d1_{v} - 2 * m_{v}) / (h * h)))"
    return rows.selectExpr(
        *keys, "g.day AS day", "date_add(DATE'1970-01-01', g.day) AS date",
        *[f"CASE WHEN g.at IS NOT NULL THEN {cubic(v)} WHEN _x0 = _x1 THEN _last_{v} ELSE {v} END AS {v}" for v in values],
    )


def series_span(daily: DataFrame, keys: Sequence[str] = TRANSECT) -> DataFrame:
    """First and last day and their count per series."""
    return daily.groupBy(*keys).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days"))


def eligible(daily: DataFrame, seq_len: int, keys: Sequence[str] = TRANSECT) -> DataFrame:
    """Series spans with ``modelled``: long enough to train on, else fallback only."""
    return series_span(daily, keys).withColumn("modelled", F.col("n_days") > seq_len + 2)


def sequences(daily: DataFrame, n: int, keys: Sequence[str] = TRANSECT, values: Sequence[str] = VALUES) -> DataFrame:
    """Each day with the ``n`` days before it as ``window`` (oldest first); days without a full window drop."""
    tiles = tile_halo(daily, "day", n, 0, CHUNK_DAYS)
    w = Window.partitionBy(*keys, "_tile").orderBy("day").rowsBetween(-n, -1)
    item = F.struct(*[F.col(v).alias(v) for v in values])
    return tiles.withColumn("window", F.collect_list(item).over(w)).filter(F.col("_home") & (F.size("window") == n)).drop("_tile", "_home")


def fit_scaler(seqs: DataFrame, values: Sequence[str] = VALUES, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over all elements of all windows, and of the targets.

    A zero deviation counts as 1. Columns ``mean_x_*``, ``std_x_*``, ``mean_y_*``, ``std_y_*``.
    """
    def pair(prefix: str, v: str, col: Column) -> list[Column]:
        dev = F.stddev_pop(col)
        return [F.avg(col).alias(f"mean_{prefix}_{v}"), F.when(dev == 0, 1.0).otherwise(dev).alias(f"std_{prefix}_{v}")]

    items = seqs.select(*by, F.explode("window").alias("w"))
    xs = items.groupBy(*by).agg(*[c for v in values for c in pair("x", v, F.col(f"w.{v}"))])
    ys = seqs.groupBy(*by).agg(*[c for v in values for c in pair("y", v, F.col(v))])
    return xs.join(ys, list(by)) if by else xs.crossJoin(ys)  # one row each


def scale_sequences(seqs: DataFrame, scaler: dict[str, float], values: Sequence[str] = VALUES) -> DataFrame:
    """Windows and targets to zero mean and unit deviation; ``scaler`` is one row as a dict."""
    window = F.transform(
        "window", lambda s: F.struct(*[((s[v] - scaler[f"mean_x_{v}"]) / scaler[f"std_x_{v}"]).alias(v) for v in values])
    )
    targets = {v: (F.col(v) - scaler[f"mean_y_{v}"]) / scaler[f"std_y_{v}"] for v in values}
    return seqs.withColumn("window", window).withColumns(targets)


def unscale(col: Column | str, scaler: dict[str, float], v: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c * scaler[f"std_y_{v}"] + scaler[f"mean_y_{v}"]


def split(seqs: DataFrame, date: str | None = None, run: Sequence[str] = ("aoi_id",), mode: str = "date", share: float = 0.8) -> DataFrame:
    """Add ``part``: ``train`` or ``val``.

    By date (days up to ``date`` train) when both sides of the run are non-empty, else the
    first ``share`` by position in transect-major order. Positions come from per-transect
    counts and day arithmetic, not from ranking all rows.
    """
    run = list(run)
    cut_day = F.datediff(F.lit(date).cast("date"), F.lit("1970-01-01").cast("date")) if date else F.lit(None).cast("int")
    per = seqs.groupBy(*run, "transect_index").agg(
        F.count("*").alias("_n"), F.min("day").alias("_d0"), F.count_if(F.col("day") <= cut_day).alias("_l"), F.count_if(F.col("day") > cut_day).alias("_r")
    )
    whole = Window.partitionBy(*run)
    upto = whole.orderBy("transect_index").rowsBetween(Window.unboundedPreceding, -1)
    info = per.select(
        *run, "transect_index", "_d0", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_total"), F.sum("_l").over(whole).alias("_left"), F.sum("_r").over(whole).alias("_right"),
    )
    rows = salted_join(seqs, info, [*run, "transect_index"], spread=["day"])
    position = F.col("_before") + F.col("day") - F.col("_d0")
    by_date = (F.lit(mode) == "date") & cut_day.isNotNull() & (F.col("_left") > 0) & (F.col("_right") > 0)
    first = F.when(by_date, F.col("day") <= cut_day).otherwise(position < F.floor(F.col("_total") * share))
    return rows.withColumn("part", F.when(first, "train").otherwise("val")).drop("_d0", "_before", "_total", "_left", "_right")


def _last_two(daily: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Last day and the day before, from one aggregation: they differ in parity."""
    item = F.struct("day", *values)
    even, odd = F.max(F.when(F.col("day") % 2 == 0, item)), F.max(F.when(F.col("day") % 2 != 0, item))
    return daily.groupBy(*keys).agg(even.alias("_e"), odd.alias("_o")).select(
        *keys, F.greatest("_e", "_o").alias("last"), F.when(F.col("_e").isNotNull() & F.col("_o").isNotNull(), F.least("_e", "_o")).alias("prev")
    )


def _steps(df: DataFrame, horizon: int) -> DataFrame:
    out = df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(int(horizon)))))
    return out.withColumn("date", F.date_add(F.lit("1970-01-01").cast("date"), F.col("last.day") + F.col("step")))


def drift_forecast(daily: DataFrame, horizon: int, keys: Sequence[str] = TRANSECT, values: Sequence[str] = VALUES) -> DataFrame:
    """``last + step * (last - previous)``; a one-day series stays flat."""
    rows = _steps(_last_two(daily, keys, values), horizon)
    slope = lambda v: F.coalesce(F.col(f"last.{v}") - F.col(f"prev.{v}"), F.lit(0.0))
    return rows.select(
        *keys, "step", "date", *[(F.col(f"last.{v}") + slope(v) * F.col("step")).alias(f"future_{v}") for v in values], F.lit("drift").alias("model_type")
    )


def persistence_forecast(daily: DataFrame, horizon: int, keys: Sequence[str] = TRANSECT, values: Sequence[str] = VALUES) -> DataFrame:
    """The last value repeated."""
    last = daily.groupBy(*keys).agg(F.max(F.struct("day", *values)).alias("last"))
    rows = _steps(last, horizon)
    return rows.select(
        *keys, "step", "date", *[F.col(f"last.{v}").alias(f"future_{v}") for v in values], F.lit("persistence").alias("model_type")
    )


def persistence_validation(seqs: DataFrame, values: Sequence[str] = VALUES) -> DataFrame:
    """Predicted = last day of the window, in raw metres."""
    last = F.element_at("window", -1)
    return seqs.withColumns({f"pred_{v}": last[v] for v in values})


def rmse(df: DataFrame, pairs: dict[str, tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Root mean square error per named (truth, prediction) pair; NULL without rows."""
    return df.groupBy(*by).agg(*[F.sqrt(F.avg(F.pow(F.col(t) - F.col(p), 2))).alias(n) for n, (t, p) in pairs.items()])


# --- learned autoregression ---

def fit_ar(scaled: DataFrame, n: int, values: Sequence[str] = VALUES, reg: float = 0.0) -> dict[str, list[float]]:
    """Next-day linear model on scaled windows: one fit per value, coefficients oldest day first.

    The result is ``{value: [coefficients…, intercept]}`` with ``n * len(values)`` coefficients.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    flat = F.flatten(F.transform("window", lambda s: F.array(*[s[v] for v in values])))
    rows = scaled.select(array_to_vector(flat).alias("x"), *values)
    fitted = {}
    for v in values:
        model = LinearRegression(featuresCol="x", labelCol=v, solver="normal", regParam=reg, maxIter=50).fit(rows)
        fitted[v] = [*map(float, model.coefficients), float(model.intercept)]
    return fitted


def _apply(model: dict[str, list[float]], window: Column, values: Sequence[str], n: int) -> Column:
    """Next scaled value from a window column of ``n`` structs."""
    out = []
    for v in values:
        weights = F.array(*[
            F.struct(*[F.lit(model[v][i * len(values) + j]).alias(u) for j, u in enumerate(values)]) for i in range(n)
        ])
        terms = F.zip_with(window, weights, lambda s, w: sum((s[u] * w[u] for u in values), F.lit(0.0)))
        out.append((F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) + model[v][-1]).alias(v))
    return F.struct(*out)


def predict_ar(scaled: DataFrame, model: dict[str, list[float]], n: int, values: Sequence[str] = VALUES) -> DataFrame:
    """One-step predictions on scaled windows as ``pred_*``."""
    out = scaled.withColumn("_p", _apply(model, F.col("window"), values, n))
    return out.withColumns({f"pred_{v}": F.col(f"_p.{v}") for v in values}).drop("_p")


def rollout(
    daily: DataFrame, model: dict[str, list[float]], scaler: dict[str, float], n: int, horizon: int, keys: Sequence[str] = TRANSECT, values: Sequence[str] = VALUES
) -> DataFrame:
    """Recursive forecast: each step's prediction joins the next window.

    One fold per transect, so transects run in parallel. Targets are un-scaled and scaled
    again as inputs, since inputs and targets have their own statistics.
    """
    ends = series_span(daily, keys).select(*keys, "last_day")
    tail = salted_join(daily, ends, keys, spread=["day"]).filter(F.col("day") > F.col("last_day") - n)
    items = F.sort_array(F.collect_list(F.struct("day", *[((F.col(v) - scaler[f"mean_x_{v}"]) / scaler[f"std_x_{v}"]).alias(v) for v in values])))
    start = tail.groupBy(*keys).agg(items.alias("_w")).filter(F.size("_w") == n).withColumn("last", F.struct(F.element_at("_w", -1)["day"].alias("day")))
    state = F.struct(
        F.transform("_w", lambda s: F.struct(*[s[v].alias(v) for v in values])).alias("w"),
        F.array().cast("array<struct<" + ",".join(f"{v}:double" for v in values) + ">>").alias("out"),
    )

    def step(acc: Column, _k: Column) -> Column:
        nxt = _apply(model, acc["w"], values, n)
        raw = F.struct(*[unscale(nxt[v], scaler, v).alias(v) for v in values])
        back = F.struct(*[((raw[v] - scaler[f"mean_x_{v}"]) / scaler[f"std_x_{v}"]).alias(v) for v in values])
        return F.struct(F.concat(F.slice(acc["w"], 2, n - 1), F.array(back)).alias("w"), F.concat(acc["out"], F.array(raw)).alias("out"))

    rolled = start.withColumn("_o", F.aggregate(F.sequence(F.lit(1), F.lit(int(horizon))), state, step, lambda acc: acc["out"]))
    rows = rolled.select(*keys, "last", F.posexplode("_o").alias("_k", "_v"))
    return rows.select(
        *keys, (F.col("_k") + 1).alias("step"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("last.day") + F.col("_k") + 1).alias("date"),
        *[F.col(f"_v.{v}").alias(f"future_{v}") for v in values], F.lit("linear_ar").alias("model_type"),
    )


# Fewest samples a learned model is trained and checked on.
MIN_TRAIN, MIN_VAL = 8, 2


def choose_model(counts: DataFrame) -> DataFrame:
    """Model per run from ``train_samples`` and ``val_samples``, with reason and warning."""
    few = (F.col("train_samples") < MIN_TRAIN) | (F.col("val_samples") < MIN_VAL)
    none = F.col("train_samples") + F.col("val_samples") == 0
    return (
        counts.withColumn("model_type", F.when(none, "drift").when(few, "persistence").otherwise("linear_ar"))
        .withColumn("reason", F.when(none, "no_sequences").when(few, "too_few_samples"))
        .withColumn("warning", F.when(none | few, F.concat(F.lit("fallback to "), F.col("model_type"))))
    )


# --- forecast lines ---

def forecast_points(forecast: DataFrame, transects: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Forecast distances to positions on their transect; rows without a transect drop.

    ``pos = L/2 + distance`` kept within the transect. One row per (date, boundary, transect).
    """
    t = transects.select(*keys, "transect_index", "x0", "y0", "x1", "y1")
    j = salted_join(forecast, t, [*keys, "transect_index"], spread=["step"])
    pair = F.array(
        F.struct(F.lit("waterline_forecast").alias("boundary"), F.col("future_wl").alias("d")),
        F.struct(F.lit("vegetation_edge_forecast").alias("boundary"), F.col("future_ve").alias("d")),
    )
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    j = j.withColumn("_b", F.explode(pair)).filter(F.col("_b.d").isNotNull()).withColumn("_l", length).filter(F.col("_l") > 0)
    share = F.greatest(F.least(F.col("_l") / 2 + F.col("_b.d"), F.col("_l")), F.lit(0.0)) / F.col("_l")
    j = j.withColumn("_s", share)
    return j.select(
        *keys, "date", "step", F.col("_b.boundary").alias("boundary"), "transect_index", "model_type",
        (F.col("x0") + F.col("_s") * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + F.col("_s") * (F.col("y1") - F.col("y0"))).alias("y"),
    )


def forecast_lines(points: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Points to one line per date and boundary, ordered by transect; needs 2 points and a length.

    A line has one vertex per transect of its AOI.
    """
    from tideline.functions import lines

    pts = F.sort_array(F.collect_list(F.struct("transect_index", "x", "y")))
    out = points.groupBy(*keys, "date", "boundary").agg(pts.alias("_p"), F.first("model_type").alias("model_type"))
    out = out.withColumn("line", F.transform("_p", lambda p: lines.point(p["x"], p["y"]))).drop("_p")
    return out.filter((F.size("line") >= 2) & (lines.line_length("line") > 0))


def forecast_summary(forecast: DataFrame, counts: DataFrame, horizon: int, seq_len: int, by: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Horizon, years, row counts and model per run joined with the sample counts and scores."""
    agg = forecast.groupBy(*by).agg(
        F.count("*").alias("forecast_rows"), F.count_distinct("transect_index").alias("forecast_transects"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    return (
        agg.join(counts, list(by), "left")
        .withColumn("forecast_days", F.lit(int(horizon)))
        .withColumn("forecast_years", F.round(F.lit(horizon / 365.25), 3))
        .withColumn("sequence_len_days", F.lit(int(seq_len)))
    )
