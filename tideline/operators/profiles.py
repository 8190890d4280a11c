"""One-dimensional profiles: rows ``(keys…, pos, value)`` with an integer ``pos``.

Used for raster columns, boundary rows and transect-ordered hits. Sorting happens in
chunks of ``pos``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.skew import TILE, nth, ordered_neighbours, tile_halo

CHUNK = 4096


def fill_linear(
    known: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Sequence[str],
    first: Column,
    last: Column,
    chunk: int | None = CHUNK,
) -> DataFrame:
    """Every integer ``pos`` from ``first`` to ``last``: linear between known rows, constant outside.

    A single known row is spread over the whole range. Adds ``known`` (false where filled).
    ``chunk`` positions are sorted together; None sorts a profile whole, for those known to be short.
    """
    near = ordered_neighbours(
        known.withColumn("_first", first.cast("long")).withColumn("_last", last.cast("long")),
        keys,
        [pos],
        None if chunk is None else F.floor(F.col(pos) / chunk),
        [pos, *values],
        before=1,
        after=1,
    )
    here, there = F.col(pos).cast("long"), nth("next", 0, pos).cast("long")
    start = F.when(F.size("prev") > 0, here).otherwise(F.least(F.col("_first"), here))
    stop = F.when(F.size("next") > 0, there - 1).otherwise(F.greatest(F.col("_last"), here))
    rows = near.withColumn("_k", F.explode(F.sequence(start, stop)))
    share = F.try_divide(F.col("_k") - here, there - here)
    between = (F.col("_k") > here) & (F.size("next") > 0)
    cols = [
        F.when(between, F.col(v) + share * (nth("next", 0, v) - F.col(v))).otherwise(F.col(v)).alias(v) for v in values
    ]
    rest = [c for c in known.columns if c not in {pos, *values, *keys}]
    return rows.select(*keys, F.col("_k").alias(pos), *cols, (F.col("_k") == here).alias("known"), *rest)


def reflect_pad(df: DataFrame, axis: str, size: Column, reach: int) -> DataFrame:
    """Add mirrored copies (``…b a | a b…``) of rows within ``reach`` of either end.

    ``_real`` is false for copies. Works for any ``reach``, also above the size.
    """
    n = size.cast("long")
    i = F.col(axis).cast("long")
    turns = F.floor(F.lit(reach) / n) + 1
    copies = F.flatten(
        F.transform(F.sequence(-turns, turns), lambda m: F.array(i + 2 * n * m, 2 * n * m - 1 - i))
    )
    near = F.filter(copies, lambda p: (p >= -reach) & (p < n + reach))
    return (
        df.withColumn("_src", i)
        .withColumn(axis, F.explode(near))
        .withColumn("_real", F.col(axis) == F.col("_src"))
        .drop("_src")
    )


def gaussian_weights(sigma: float) -> list[float]:
    """Normalised weights with radius ``int(4 sigma + 0.5)``."""
    radius = int(4.0 * sigma + 0.5)
    w = [float(np.exp(-0.5 * (k / sigma) ** 2)) for k in range(-radius, radius + 1)]
    total = sum(w)
    return [v / total for v in w]


def convolve(df: DataFrame, keys: Sequence[str], axis: str, size: Column, values: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Weighted moving sum along ``axis`` with mirrored ends; rows must be gap-free."""
    r = len(weights) // 2
    tiles = tile_halo(reflect_pad(df, axis, size, r), axis, r, r)
    w = Window.partitionBy(*keys, "_tile").orderBy(axis).rangeBetween(-r, r)
    item = F.struct(axis, *values)
    out = tiles.withColumn("_w", F.collect_list(item).over(w)).filter(F.col("_home") & F.col("_real"))
    table = F.array(*[F.lit(float(v)) for v in weights])

    def smooth(name: str) -> Column:
        return F.aggregate(
            "_w",
            F.lit(0.0),
            lambda acc, s: acc + s[name] * F.get(table, (s[axis] - F.col(axis) + r).cast("int")),
        )

    return out.withColumns({v: smooth(v) for v in values}).drop("_w", "_tile", "_home", "_real")


def gaussian1d(df: DataFrame, keys: Sequence[str], axis: str, size: Column, values: Sequence[str], sigma: float) -> DataFrame:
    """Gaussian filter along one axis, mirrored ends."""
    return convolve(df, keys, axis, size, values, gaussian_weights(sigma))


def median_smooth(df: DataFrame, keys: Sequence[str], pos: str, value: str, count: Column, k: int = 9) -> DataFrame:
    """Running median of ``k`` rows; the first and last ``k//2`` rows and short profiles stay.

    ``pos`` counts rows of the profile from 0 without gaps, ``count`` is their number.
    """
    if k < 3 or k % 2 == 0:
        return df
    r = k // 2
    tiles = tile_halo(df.withColumn("_count", count), pos, r, r)
    w = Window.partitionBy(*keys, "_tile").orderBy(pos).rowsBetween(-r, r)
    middle = F.element_at(F.sort_array(F.collect_list(value).over(w)), r + 1)
    inner = (F.col("_count") >= k) & (F.col(pos) >= r) & (F.col(pos) < F.col("_count") - r)
    return (
        tiles.withColumn("_m", F.when(inner, middle).otherwise(F.col(value)))
        .filter("_home")
        .withColumn(value, F.col("_m"))
        .drop("_m", "_tile", "_home", "_count")
    )


def fit_weights(window: int, poly: int) -> list[list[float]]:
    """Least-squares weights: row ``o`` gives the fitted value at offset ``o`` of a window."""
    x = np.arange(window, dtype=float) - window // 2
    basis = np.vander(x, poly + 1, increasing=True)
    return (basis @ np.linalg.pinv(basis)).tolist()


def savgol(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Sequence[str],
    count: Column,
    window: int,
    poly: int,
    passes: int = 1,
    keep_ends: bool = False,
    rule: str = "grow",
) -> DataFrame:
    """Savitzky-Golay smoothing of gap-free profiles (``pos`` from 0, ``count`` rows).

    The window shrinks to the largest odd length a short profile allows. ``rule='grow'``
    makes an even window one longer and leaves profiles under 5 rows alone; ``'shrink'``
    makes it one shorter, with 3 as the floor. End values come from the fit of the first
    and last full window; with ``keep_ends`` the two end rows are put back after each pass.
    """
    top = window if window % 2 else (window + 1 if rule == "grow" else window - 1)
    top = max(top, 5 if rule == "grow" else 3)
    sizes = list(range(3, top + 1, 2))
    tables = F.array(*[
        F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in fit_weights(s, min(max(1, poly), s - 1))])
        for s in sizes
    ])
    n = F.col("_count")
    odd = n - F.when(n % 2 == 0, 1).otherwise(0)
    size = F.least(F.lit(top), odd).cast("int")
    usable = (n >= 5) & (size >= (5 if rule == "grow" else 3))
    out = df.withColumn("_count", count.cast("long"))
    reach = top - 1
    for _ in range(max(0, passes)):
        tiles = tile_halo(out, pos, reach, reach)
        w = Window.partitionBy(*keys, "_tile").orderBy(pos).rangeBetween(-reach, reach)
        tiles = (
            tiles.withColumn("_w", F.collect_list(F.struct(pos, *values)).over(w))
            .filter("_home")
            .withColumn("_size", size)
            .withColumn("_from", F.greatest(F.least(F.col(pos) - F.floor(F.col("_size") / 2), n - F.col("_size")), F.lit(0)))
            .withColumn("_row", F.get(F.get(tables, ((F.col("_size") - 3) / 2).cast("int")), (F.col(pos) - F.col("_from")).cast("int")))
        )
        fixed = (F.col(pos) == 0) | (F.col(pos) == n - 1) if keep_ends else F.lit(False)

        def smooth(v: str) -> Column:
            inside = F.filter("_w", lambda s: (s[pos] >= F.col("_from")) & (s[pos] < F.col("_from") + F.col("_size")))
            fitted = F.aggregate(
                inside, F.lit(0.0), lambda acc, s: acc + s[v] * F.get(F.col("_row"), (s[pos] - F.col("_from")).cast("int"))
            )
            return F.when(usable & ~fixed, fitted).otherwise(F.col(v))

        out = tiles.withColumns({v: smooth(v) for v in values}).drop("_w", "_size", "_from", "_row", "_tile", "_home")
    return out.drop("_count")


def number_rows(df: DataFrame, keys: Sequence[str], order: str, chunk: Column, out: str = "pos") -> DataFrame:
    """Gap-free row number from 0 per key, in chunks."""
    from tideline.operators.skew import running_sum

    ranked = running_sum(df, keys, [order], chunk, F.lit(1), "_rank")
    return ranked.withColumn(out, F.col("_rank").cast("long") - 1).drop("_rank")
