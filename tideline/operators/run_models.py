"""A next-day model of its own for every run: keyed sufficient statistics, one small solve a run, forecasts from joined coefficients.

Rows are folded into products of inputs and targets inside their task, the products are summed per run with a combine before the shuffle, and one group
of a few hundred numbers a run is solved. No run's rows meet in one place, so a run may hold any share of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.lineage import settle
from tideline.operators import series
from tideline.operators.skew import salted_join

RUN = ("aoi_id",)


def run_scaler(seqs: DataFrame, by: Sequence[str] = RUN, values: Sequence[str] = series.VALUES, scope: str = "all") -> DataFrame:
    """Means and deviations of inputs and targets per run, over all windows (``all``) or those of the training part (``train``).

    A run without training rows has no row in scope ``train``.
    """
    if scope not in ("all", "train"):
        raise ValueError(f"unknown scope {scope!r}")
    return series.fit_scaler(seqs.filter("part = 'train'") if scope == "train" else seqs, values, by)


def flat_inputs(values: Sequence[str]) -> Column:
    """A window as numbers in units of its run, oldest day first; needs the run's scaler columns."""
    one = lambda s: F.array(*[(s[v] - F.col(f"mean_x_{v}")) / F.col(f"std_x_{v}") for v in values])
    return F.flatten(F.transform("window", one))


def products(rows: DataFrame, by: Sequence[str], n_targets: int) -> DataFrame:
    """(by…, k, s): sums of the products of (inputs, 1) with (inputs, 1, targets), row by row. ``rows`` has ``x`` and ``y`` (arrays)."""
    by = list(by)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_targets)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.hstack([x, np.ones((batch.num_rows, 1))])
            keys = pa.Table.from_batches([batch]).select(by).append_column("_i", pa.array(np.arange(batch.num_rows)))
            groups = keys.group_by(by).aggregate([("_i", "list")])
            sums = [(x[i].T @ np.hstack([x[i], y[i]])).ravel() for i in (np.array(g) for g in groups["_i_list"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*(groups[c].combine_chunks() for c in by), pa.array(sums, pa.list_(pa.float64()))], names=[*by, "s"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    parts = rows.select(*by, "x", "y").mapInArrow(fold, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", s array<double>")
    return parts.select(*by, F.posexplode("s").alias("k", "s")).groupBy(*by, "k").agg(F.sum("s").alias("s"))


def fit_runs(seqs: DataFrame, scaler: DataFrame, by: Sequence[str] = RUN, values: Sequence[str] = series.VALUES, reg: float = 0.0) -> DataFrame:
    """(by…, coef): least squares per run on its training windows, ``coef`` one array of weights (oldest day first) and intercept per value.

    Of equally good solutions the smallest is taken. Targets are in their own units.
    """
    by, q = list(by), len(values)
    train = salted_join(seqs.filter("part = 'train'"), scaler, by, spread=["transect_index", "day"])
    sums = products(train.select(*by, flat_inputs(values).alias("x"), F.array(*[F.col(v).cast("double") for v in values]).alias("y")), by, q)

    def solve(part: pa.Table) -> pa.Table:
        part = part.sort_by("k")
        s = part["s"].to_numpy()
        size = int(round((-q + np.sqrt(q * q + 4 * len(s))) / 2))
        m = s.reshape(size, size + q)
        a = m[:, :size] + reg * np.diag([1.0] * (size - 1) + [0.0])
        coef = np.linalg.lstsq(a, m[:, size:], rcond=1e-12)[0].T
        return part.slice(0, 1).select(by).append_column("coef", pa.array([coef.tolist()], pa.list_(pa.list_(pa.float64()))))

    kinds = {f.name: f.dataType.simpleString() for f in seqs.schema.fields}
    return sums.groupBy(*by).applyInArrow(solve, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", coef array<array<double>>")


def _dot(coef: Column, x: Column) -> Column:
    terms = F.zip_with(F.slice(coef, F.lit(1), F.size(x)), x, lambda w, v: w * v)
    return F.aggregate(terms, F.element_at(coef, -1), lambda a, t: a + t)


def predict_runs(seqs: DataFrame, models: DataFrame, by: Sequence[str] = RUN, values: Sequence[str] = series.VALUES) -> DataFrame:
    """``seqs`` with one-step predictions ``pred_*``; ``models`` has a run's scaler columns and ``coef``."""
    rows = salted_join(seqs, models, list(by), spread=["transect_index", "day"]).withColumn("_x", flat_inputs(values))
    out = rows.withColumns({f"pred_{v}": _dot(F.get("coef", F.lit(i)), F.col("_x")) for i, v in enumerate(values)})
    return out.select(*seqs.columns, *[f"pred_{v}" for v in values])


def rollout_runs(daily: DataFrame, models: DataFrame, n: int, horizon: int, by: Sequence[str] = RUN, values: Sequence[str] = series.VALUES) -> DataFrame:
    """Recursive forecast of every transect with its run's model: each step's prediction joins the next window."""
    keys, q = list(series.TRANSECT), len(values)
    ends = series.series_span(daily, keys).select(*keys, "last_day")
    tail = salted_join(daily, ends, keys, spread=["day"]).filter(F.col("day") > F.col("last_day") - n)
    start = tail.groupBy(*keys, "last_day").agg(F.sort_array(F.collect_list(F.struct("day", *values))).alias("window")).filter(F.size("window") == n)
    rows = salted_join(start, models, list(by), spread=["transect_index"]).withColumn("_x", flat_inputs(values))
    unit = lambda y: F.array(*[(F.get(y, F.lit(i)) - F.col(f"mean_x_{v}")) / F.col(f"std_x_{v}") for i, v in enumerate(values)])
    state = F.struct(F.col("_x").alias("x"), F.array().cast("array<array<double>>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        made = F.array(*[_dot(F.get("coef", F.lit(i)), acc["x"]) for i in range(q)])
        # bound once, or every later step would compute it again
        return F.get(F.transform(F.array(made), lambda y: F.struct(F.concat(F.slice(acc["x"], q + 1, max(1, n * q - q)) if n > 1 else F.array().cast("array<double>"), unit(y)).alias("x"), F.concat(acc["out"], F.array(y)).alias("out"))), F.lit(0))

    rolled = rows.withColumn("_o", F.aggregate(F.sequence(F.lit(1), F.lit(int(horizon))), state, step, lambda acc: acc["out"]))
    long = rolled.select(*keys, "last_day", F.posexplode("_o").alias("_k", "_v"))
    return long.select(
        *keys, (F.col("_k") + 1).alias("step"), F.date_add(F.lit("1970-01-01").cast("date"), (F.col("last_day") + F.col("_k") + 1).cast("int")).alias("date"),
        *[F.get("_v", F.lit(i)).alias(f"future_{v}") for i, v in enumerate(values)], F.lit("linear_ar").alias("model_type"),
    )


def forecast_runs(
    obs: DataFrame, horizon: int, seq_len: int = 10, split_date: str | None = None, by: Sequence[str] = RUN, scope: str = "all",
) -> tuple[DataFrame, DataFrame]:
    """Distance forecast of every transect, and one row per run with its model, samples and errors.

    Runs without any window get drift for all their transects; runs with few samples persistence and the others a model of their own, both for the transects
    that are long enough. Errors are those of the model on the run's validation windows, null without any.
    """
    by = list(by)
    daily = settle(series.daily_series(obs))
    ok = series.eligible(daily, seq_len).filter("modelled").select(*series.TRANSECT)
    body = settle(salted_join(daily, ok, list(series.TRANSECT), spread=["day"]))
    seqs = settle(series.split(series.sequences(body, seq_len), split_date, by))
    found = seqs.groupBy(*by).agg(F.count_if(F.col("part") == "train").alias("train_samples"), F.count_if(F.col("part") == "val").alias("val_samples"))
    counts = daily.select(*by).distinct().join(found, by, "left").fillna(0, ["train_samples", "val_samples"])
    chosen = settle(series.choose_model(counts))
    of = lambda df, kind: salted_join(df, chosen.filter(F.col("model_type") == kind).select(*by), by, spread=["transect_index", "day"])
    learned = settle(of(seqs, "linear_ar"))
    scaler = settle(run_scaler(learned, by, scope=scope))
    models = settle(scaler.join(fit_runs(learned, scaler, by), by))
    pairs = {"rmse_ve_m": ("ve", "pred_ve"), "rmse_wl_m": ("wl", "pred_wl")}
    val = F.col("part") == "val"
    scored = predict_runs(learned.filter(val), models, by).select(*by, *[c for p in pairs.values() for c in p])
    kept = series.persistence_validation(of(seqs, "persistence").filter(val)).select(*by, *[c for p in pairs.values() for c in p])
    metrics = chosen.join(series.rmse(scored.unionByName(kept), pairs, by), by, "left")
    out = series.drift_forecast(of(daily, "drift"), horizon).unionByName(series.persistence_forecast(of(body, "persistence"), horizon))
    return out.unionByName(rollout_runs(of(body, "linear_ar"), models, seq_len, horizon, by)), metrics
