"""Building blocks that keep work spread out when one key holds much of the data.

* ``salted_join``        equi-join whose big side may have a hot key
* ``ordered_neighbours`` lag/lead over any number of rows of one key, in time chunks
* ``running_sum``        prefix sum of one key, in chunks
* ``tile_halo``          bounded windows on an integer axis
* ``exact_quantiles``    exact interpolated quantiles without holding a group in one task
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 8
TILE = 256


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """Join on ``keys``; rows of one key in ``big`` go to ``salts`` partitions.

    ``small`` is copied once per salt, so it should hold few rows per key. ``how`` is
    ``inner`` or ``left``; the broadcast choice stays with Spark's size check.
    """
    cols = [F.col(c) for c in (spread or big.columns)]
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def ordered_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | None,
    fields: Sequence[str],
    before: int = 1,
    after: int = 1,
) -> DataFrame:
    """Add ``prev`` and ``next``: the nearest rows of the same key, nearest first.

    ``chunk`` is a non-decreasing function of ``order``; sorting happens inside one
    (key, chunk) only. Rows at a chunk border take the missing neighbours from a small
    per-chunk summary holding at most ``max(before, after)`` rows of each end. Rows without a
    place in the order (``chunk`` is NULL) have no neighbours and are left out, as are rows with a NULL key.
    Without a ``chunk`` the rows of a key are sorted whole, once; rows whose first ``order`` column is NULL are left out.
    """
    reach = max(before, after)
    part = [*keys, "_chunk"] if chunk is not None else list(keys)
    item = f"struct({', '.join(fields)})"
    by = f"PARTITION BY {', '.join(part)} ORDER BY {', '.join(order)}"
    shift = lambda fn: ", ".join(f"{fn}({item}, {k}) OVER ({by})" for k in range(1, reach + 1))
    if chunk is None:
        placed = df.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, order[0]]))
        near = lambda fn, n: f"slice(array_compact(array({shift(fn)})), 1, {n})"
        return placed.selectExpr("*", f"{near('lag', before)} AS prev", f"{near('lead', after)} AS next")
    # the explicit filter keeps both branches of the self-join identical, so one exchange serves both
    inside = df.withColumn("_chunk", chunk).filter("_chunk IS NOT NULL").selectExpr(
        "*", f"array_compact(array({shift('lag')})) AS _p", f"array_compact(array({shift('lead')})) AS _n"
    )
    ranked = f"struct({', '.join(order)}, {item} AS _item)"
    end = lambda side: f"transform(sort_array(collect_list(CASE WHEN size({side}) < {reach} THEN {ranked} END)), s -> s._item)"
    ends = (
        inside.filter(f"size(_p) < {reach} OR size(_n) < {reach}")
        .groupBy(*part)
        .agg(F.expr(end("_p")).alias("_heads"), F.expr(end("_n")).alias("_tails"))
    )
    near = f"PARTITION BY {', '.join(keys)} ORDER BY _chunk ROWS BETWEEN"
    ends = ends.selectExpr(
        *part,
        f"flatten(collect_list(_tails) OVER ({near} {reach} PRECEDING AND 1 PRECEDING)) AS _pt",
        f"flatten(collect_list(_heads) OVER ({near} 1 FOLLOWING AND {reach} FOLLOWING)) AS _nh",
    )
    return inside.join(ends, part).selectExpr(
        *[c for c in df.columns],
        f"slice(concat(_p, reverse(_pt)), 1, {before}) AS prev",
        f"slice(concat(_n, _nh), 1, {after}) AS next",
    )


def nth(array: Column | str, index: int, field: str) -> Column:
    """Field of the ``index``-th (0-based) neighbour, NULL when there is none."""
    col = F.col(array) if isinstance(array, str) else array
    return F.get(col, F.lit(index))[field]


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: Column, out: str
) -> DataFrame:
    """Inclusive prefix sum of ``value`` per key, computed chunk by chunk; rows whose ``chunk`` is NULL are left out."""
    part = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", chunk).filter("_chunk IS NOT NULL").withColumn("_v", value)
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        rows.groupBy(*part).agg(F.sum("_v").alias("_t")).select(*part, F.sum("_t").over(wc).alias("_before"))
    )
    return (
        rows.withColumn("_in", F.sum("_v").over(w))
        .join(totals, part)
        .withColumn(out, F.col("_in") + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_v", "_in", "_before", "_chunk")
    )


def tile_halo(df: DataFrame, axis: str, below: int, above: int, size: int = TILE) -> DataFrame:
    """Copy each row to every tile of ``axis`` whose frame ``[t-below, t+above]`` needs it.

    Adds ``_tile`` and ``_home`` (true in the tile that owns the row). Windows partitioned
    by ``_tile`` then hold at most ``size + below + above`` positions.
    """
    pos = F.col(axis)
    first = F.floor((pos - above) / size)
    last = F.floor((pos + below) / size)
    return df.withColumn("_tile", F.explode(F.sequence(first, last))).withColumn(
        "_home", F.floor(pos / size) == F.col("_tile")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], parts: int = 32
) -> DataFrame:
    """Exact linearly interpolated quantiles of ``value`` per key.

    Equal values are counted first, then spread over ``parts`` value ranges per key; only
    the ranges holding a wanted rank are sorted.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_q")).agg(F.count("*").alias("_c"))
    cuts = counts.groupBy(*keys).agg(
        F.percentile_approx("_q", [i / parts for i in range(1, parts)], 1000).alias("_cuts")
    )
    placed = (
        salted_join(counts, cuts, keys, spread=["_q"])
        .withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_q"))))
        .drop("_cuts")
    )
    wp = Window.partitionBy(*keys).orderBy("_part")
    spans = (
        placed.groupBy(*keys, "_part")
        .agg(F.sum("_c").alias("_pc"))
        .withColumn("_off", F.sum("_pc").over(wp.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_off", F.coalesce("_off", F.lit(0)))
        .withColumn("_total", F.sum("_pc").over(wp.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    rank = (F.col("_total") - 1) * F.col("_w.p")
    hits = (
        spans.withColumn("_w", F.explode(wanted))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(rank), F.ceil(rank)))))
        .filter((F.col("_rank") >= F.col("_off")) & (F.col("_rank") < F.col("_off") + F.col("_pc")))
        .select(*keys, "_part", "_off", "_rank", F.col("_w.i").alias("_i"), rank.alias("_h"))
    )
    need = hits.groupBy(*keys, "_part").agg(
        F.first("_off").alias("_off"), F.collect_list(F.struct("_i", "_rank", "_h")).alias("_want")
    )
    wv = Window.partitionBy(*keys, "_part").orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        placed.join(need, [*keys, "_part"])
        .withColumn("_end", F.sum("_c").over(wv) + F.col("_off"))
        .withColumn("_want", F.explode(F.filter("_want", lambda s: (s["_rank"] < F.col("_end")) & (s["_rank"] >= F.col("_end") - F.col("_c")))))
        .select(*keys, "_q", "_want.*")
    )
    weight = F.when(F.col("_rank") == F.ceil("_h"), F.col("_h") - F.floor("_h")).otherwise(F.ceil("_h") - F.col("_h"))
    weight = F.when(F.floor("_h") == F.ceil("_h"), F.lit(1.0)).otherwise(weight)
    return (
        found.withColumn("_part_value", F.col("_q") * weight)
        .groupBy(*keys)
        .agg(*[F.sum(F.when(F.col("_i") == i, F.col("_part_value"))).alias(n) for i, n in enumerate(names)])
    )
