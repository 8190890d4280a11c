"""Irregular monthly series: history windows, targets, shape histories and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.lineage import cut, settle
from tideline.operators.skew import ordered_neighbours, salted_join

PAD_OFFSET = 999
# Months per sorting chunk.
MONTH_CHUNK = 240


def load_series(obs: DataFrame, min_count: int = 3, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Distinct months of series with at least ``min_count`` of them."""
    keys = list(keys)
    months = obs.select(*keys, "month_idx").distinct()
    n = months.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_count)
    return salted_join(months, n, keys, spread=["month_idx"]).drop("_n")


def irregular_history(series: DataFrame, n: int, min_history: int, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Each reference month with up to ``n`` latest months not after it, oldest first.

    ``offsets`` counts months before the reference and is padded in front with 999;
    ``valid`` marks real entries. References with under ``min_history`` months drop.
    """
    near = ordered_neighbours(series, keys, ["month_idx"], F.floor(F.col("month_idx") / MONTH_CHUNK), ["month_idx"], before=n - 1, after=0)
    real = F.concat(F.reverse(F.transform("prev", lambda s: s["month_idx"])), F.array("month_idx"))
    out = near.withColumn("history", real).filter(F.size("history") >= min_history)
    pad = F.lit(n) - F.size("history")
    return (
        out.withColumn("offsets", F.concat(F.array_repeat(F.lit(PAD_OFFSET), pad), F.transform("history", lambda m: (F.col("month_idx") - m).cast("int"))))
        .withColumn("valid", F.concat(F.array_repeat(F.lit(False), pad), F.array_repeat(F.lit(True), F.size("history"))))
        .drop("prev", "next")
    )


def match_targets(series: DataFrame, horizons: Sequence[int], tolerance: int, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Nearest later month to ``reference + h`` within ``tolerance``, the earliest on ties.

    Months are integers and the tolerance is small, so each reference probes the
    ``2*tolerance + 1`` candidate months by equality instead of a range join.
    """
    probes = (
        series.select(*keys, F.col("month_idx").alias("ref_month"))
        .withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
        .withColumn("_d", F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))))
        .withColumn("month_idx", F.col("ref_month") + F.col("horizon") + F.col("_d"))
        .filter(F.col("month_idx") > F.col("ref_month"))
    )
    met = probes.join(series.select(*keys, "month_idx"), [*keys, "month_idx"])
    return met.groupBy(*keys, "ref_month", "horizon").agg(
        F.min_by("month_idx", F.struct(F.abs(F.col("_d")), F.col("month_idx"))).alias("target_month")
    )


def forecast_samples(
    series: DataFrame, n: int, min_history: int, horizons: Sequence[int], tolerance: int,
    min_target: Column | None = None, max_target: Column | None = None, keys: Sequence[str] = ("aoi_id",),
) -> DataFrame:
    """History window × horizon × matched target, targets kept within the given months."""
    hist = irregular_history(series, n, min_history, keys).withColumnRenamed("month_idx", "ref_month")
    out = hist.join(match_targets(series, horizons, tolerance, keys), [*keys, "ref_month"])
    if min_target is not None:
        out = out.filter(F.col("target_month") >= min_target)
    if max_target is not None:
        out = out.filter(F.col("target_month") <= max_target)
    return out


def temporal_cutoff(series: DataFrame, val_fraction: float) -> int:
    """Month where validation targets begin: position ``max(1, int(n*(1-f)))`` of the distinct months.

    Calendar months over all series are few, so they are ranked together.
    """
    months = series.select("month_idx").distinct().orderBy("month_idx").collect()
    if len(months) < 4:
        raise ValueError("too few observations for a temporal split")
    return int(months[max(1, int(len(months) * (1.0 - val_fraction)))][0])


def split_by_aoi(df: DataFrame, holdout: Sequence[str] = (), val: Sequence[str] = (), key: str = "aoi_id") -> DataFrame:
    """``holdout``, ``val`` or ``train`` by AOI; a validation AOI that does not occur is an error."""
    name = F.lower(F.col(key).cast("string"))
    held, chosen = [a.lower() for a in holdout], [a.lower() for a in val]
    if chosen:
        there = {r[0] for r in df.select(name.alias("k")).filter(F.col("k").isin(chosen) & ~F.col("k").isin(held)).distinct().collect()}
        missing = sorted(set(chosen) - there)
        if missing:
            raise ValueError(f"validation AOIs not found: {missing}")
    part = F.when(name.isin(held), "holdout") if held else F.when(F.lit(False), "holdout")
    if chosen:
        part = part.when(name.isin(chosen), "val")
    return df.withColumn("part", part.otherwise("train"))


def split_by_year(
    df: DataFrame, val_start: int | None, val_ratio: float, seed: int, ids: Sequence[str], holdout: Sequence[str] = (), key: str = "aoi_id"
) -> DataFrame:
    """Validation from a year on, else a seeded share when one side would be empty.

    The seeded share cuts the hash order at ``int(n*(1-ratio))`` kept within 1..n-1, exactly; rows of the same ids
    stay on one side.
    """
    base = split_by_aoi(df, holdout, key=key)
    rest = base.filter(F.col("part") != "holdout")
    late = F.col("year").isNotNull() & (F.col("year") >= F.lit(val_start))
    n_val, n_all = rest.agg(F.count_if(late), F.count("*")).first() if val_start is not None else (0, rest.count())
    if val_start is not None and 0 < n_val < n_all:
        return base.withColumn("part", F.when(F.col("part") == "holdout", "holdout").when(late, "val").otherwise("train"))
    keep = max(1, min(int(n_all * (1.0 - val_ratio)), n_all - 1))
    hashed = base.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(c) for c in ids]))
    last = kth_smallest(hashed.filter(F.col("part") != "holdout"), "_h", keep)
    train = F.col("_h") <= F.lit(last)
    return hashed.withColumn("part", F.when(F.col("part") == "holdout", "holdout").when(train, "train").otherwise("val")).drop("_h")


def kth_smallest(df: DataFrame, value: str, k: int, few: int = 4096) -> int:
    """The ``k``-th smallest of 64-bit integers (from 1), found by descending their bits twelve at a time.

    Each round counts at most 4096 ranges, combined before the shuffle, and keeps one; once that one holds ``few`` rows or fewer they are fetched. No rows are sorted.
    """
    rest, left, shift = df.select(F.col(value).alias("_v")), k, 64
    while shift > 0:
        shift = max(0, shift - 12)
        counts = rest.groupBy(F.shiftright("_v", shift).alias("b")).agg(F.count("*").alias("c")).orderBy("b").collect()  # at most 4096 ranges
        for b, c in counts:
            if left <= c:
                break
            left -= c
        if shift == 0:
            return int(b)
        rest = rest.filter(F.shiftright("_v", shift) == F.lit(b))
        if c <= few:
            return sorted(r[0] for r in rest.collect())[left - 1]
    raise ValueError("no values")


def inference_history(series: DataFrame, reference: Column, n: int, fresh: DataFrame | None = None, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Last ``n`` months not after ``reference``, with an optional fresh observation added."""
    rows = series.select(*keys, "month_idx").filter(F.col("month_idx") <= reference)
    if fresh is not None:
        rows = rows.unionByName(fresh.select(*keys, "month_idx")).distinct()
    w = Window.partitionBy(*keys).orderBy(F.desc("month_idx"))
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


# --- whole-line shapes ---

def shape_history(shapes: DataFrame, k: int = 5, keys: Sequence[str] = ("aoi_id",), ts: str = "datetime") -> DataFrame:
    """Last ``k`` shapes per AOI as ``slot`` 0..k-1 (oldest first), padded in front with the earliest.

    ``shapes``: ``keys, datetime, seq, u, v`` with one shape per time. Works point by point.
    """
    times = shapes.select(*keys, ts).distinct()
    w = Window.partitionBy(*keys).orderBy(F.desc(ts))
    last = times.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    total = last.groupBy(*keys).agg(F.max("_rn").alias("_n"))
    slots = last.join(total, list(keys)).withColumn("_slot", F.lit(k) - F.col("_rn"))
    fill = F.when(F.col("_rn") == F.col("_n"), F.sequence(F.lit(0), F.col("_slot"))).otherwise(F.array("_slot"))
    placed = slots.withColumn("slot", F.explode(fill)).select(*keys, ts, "slot")
    return shapes.join(placed, [*keys, ts])


def shape_forecast(
    shapes: DataFrame, steps: int, k: int = 5, all_steps: bool = True, keys: Sequence[str] = ("aoi_id",), ts: str = "datetime"
) -> DataFrame:
    """Monthly roll-out of a coastline shape: per point a linear trend over the last ``k`` slots.

    Each step predicts the next slot, clips it to [0,1] and joins the window. Dates are the
    last observation plus ``step`` months.
    """
    # the shapes are read three times below
    shapes = settle(shapes)
    hist = shape_history(shapes, k, keys, ts)
    last = shapes.groupBy(*keys).agg(F.max(ts).alias("_last"))
    side = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("slot", c))), lambda s: s[c])
    wins = hist.groupBy(*keys, "seq").agg(side("u").alias("_u"), side("v").alias("_v"))
    mean_x = (k - 1) / 2.0
    sxx = sum((i - mean_x) ** 2 for i in range(k))
    # extrapolating the least-squares line one slot ahead is a fixed weighted sum
    weights = [1.0 / k + (k - mean_x) * (i - mean_x) / sxx if k > 1 else 1.0 for i in range(k)]
    table = F.array(*[F.lit(float(x)) for x in weights])

    def roll(window: Column) -> Column:
        start = F.struct(window.alias("w"), F.array().cast("array<double>").alias("out"))

        def step(acc: Column, _i: Column) -> Column:
            raw = F.aggregate(F.zip_with(acc["w"], table, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            nxt = F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0))
            return F.struct(F.concat(F.slice(acc["w"], 2, k - 1), F.array(nxt)).alias("w"), F.concat(acc["out"], F.array(nxt)).alias("out"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(int(steps))), start, step, lambda acc: acc["out"])

    rolled = wins.withColumn("_ou", roll(F.col("_u"))).withColumn("_ov", roll(F.col("_v")))
    pairs = F.arrays_zip(F.col("_ou").alias("u"), F.col("_ov").alias("v"))
    rows = rolled.select(*keys, "seq", F.posexplode(pairs).alias("_i", "_p")).select(
        *keys, "seq", (F.col("_i") + 1).alias("step"), F.col("_p.u").alias("u"), F.col("_p.v").alias("v")
    )
    out = salted_join(rows, last, keys, spread=["seq", "step"])
    # month arithmetic that keeps the time of day
    stamp = F.col("_last") + F.make_ym_interval(F.lit(0), F.col("step"))
    out = out.withColumn("datetime", stamp).drop("_last")
    return out if all_steps else out.filter(F.col("step") == int(steps))
