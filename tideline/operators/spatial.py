"""Joins between transects, lines, pixels and areas."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import geo, lines
from tideline.lineage import cut, settle
from tideline.operators.profiles import fill_linear
from tideline.operators.skew import salted_join


def _columns_of_cells(ends: Sequence[Column], size: float, pad: float) -> Column:
    """Numbers of the grid columns touched by a segment inflated by ``pad``."""
    x0, _, x1, _ = ends
    pad = pad + size * 1e-9
    return F.sequence(F.floor((F.least(x0, x1) - pad) / size), F.floor((F.greatest(x0, x1) + pad) / size))


def _rows_of_cells(ends: Sequence[Column], ix: Column, size: float, pad: float) -> Column:
    """Numbers of the cells of grid column ``ix`` touched by a segment inflated by ``pad``."""
    x0, y0, x1, y1 = ends
    pad = pad + size * 1e-9
    xlo, xhi = F.least(x0, x1), F.greatest(x0, x1)
    ylo, yhi = F.least(y0, y1), F.greatest(y0, y1)
    at = lambda x: y0 + F.try_divide(x - x0, x1 - x0) * (y1 - y0)
    left, right = F.greatest(ix * size - pad, xlo), F.least((ix + 1) * size + pad, xhi)
    steep = (x1 == x0) | (left > right)
    a, b = at(left), at(right)
    lo = F.when(steep, ylo).otherwise(F.greatest(F.least(a, b), ylo))
    hi = F.when(steep, yhi).otherwise(F.least(F.greatest(a, b), yhi))
    return F.sequence(F.floor((lo - pad) / size), F.floor((hi + pad) / size))


def cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float, pad: float = 0.0) -> Column:
    """Grid cells touched by a segment inflated by ``pad``: about one per cell length."""
    ends = (x0, y0, x1, y1)

    def column_of_cells(ix: Column) -> Column:
        return F.transform(_rows_of_cells(ends, ix, size, pad), lambda j: F.struct(ix.alias("cx"), j.alias("cy")))

    return F.flatten(F.transform(_columns_of_cells(ends, size, pad), column_of_cells))


def _segment_cells(df: DataFrame, size: float, pad: float = 0.0, ends: Sequence[str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """A row per cell of ``cells`` as ``cx, cy``. Columns and rows are exploded one after the other, since
    a function inside ``transform`` is interpreted for every element."""
    q = [F.col(c) for c in ends]
    columns = df.withColumn("cx", F.explode(_columns_of_cells(q, size, pad)))
    return columns.withColumn("cy", F.explode(_rows_of_cells(q, F.col("cx"), size, pad)))


def meeting_point(p: Sequence[Column], q: Sequence[Column], keep: Callable[..., dict[str, Column]] = dict) -> Column:
    """Where segment ``q`` meets segment ``p``, as the share of ``p``'s length; NULL if nowhere.

    Collinear overlap gives the midpoint of the shared piece. ``keep`` may make columns of the
    terms that are used more than once; as one expression each use works its term out again.
    """
    px0, py0, px1, py1 = p
    qx0, qy0, qx1, qy1 = q
    rx, ry, sx, sy = px1 - px0, py1 - py0, qx1 - qx0, qy1 - qy0
    wx, wy = qx0 - px0, qy0 - py0
    k = keep(cross=rx * sy - ry * sx, side=wx * ry - wy * rx, len2=rx * rx + ry * ry)
    cross, side, len2 = k["cross"], k["side"], k["len2"]
    k = keep(t=F.try_divide(wx * sy - wy * sx, cross), u=F.try_divide(side, cross), a=F.try_divide(wx * rx + wy * ry, len2))
    t, u, a = k["t"], k["u"], k["a"]
    b = keep(b=a + F.try_divide(sx * rx + sy * ry, len2))["b"]
    k = keep(lo=F.greatest(F.least(a, b), F.lit(0.0)), hi=F.least(F.greatest(a, b), F.lit(1.0)))
    lo, hi = k["lo"], k["hi"]
    return F.when(
        cross != 0, F.when(t.between(0, 1) & u.between(0, 1), t)
    ).when((len2 > 0) & (side == 0) & (lo <= hi), (lo + hi) / 2)


def _placed(transects: DataFrame, area: Sequence[str]) -> DataFrame:
    """Transects with ends ``tx0 … ty1`` and their ``place`` in the area; equal transects share one."""
    ends = [f"t{c}" for c in ("x0", "y0", "x1", "y1")]
    tx = transects.select(*area, "transect_index", *[F.col(c[1:]).alias(c) for c in ends])
    return tx.withColumn("place", F.dense_rank().over(Window.partitionBy(*area).orderBy("transect_index", *ends)))


def transect_hits(
    transects: DataFrame, segs: DataFrame, line_keys: Sequence[str], area: Sequence[str] = ("aoi_id",), cell: float = 500.0
) -> DataFrame:
    """Every meeting of a transect with a line: ``t`` is the share of the transect's length.

    Both sides go to grid cells of about one transect length; the segment side, which holds
    the many scenes, is salted.
    """
    area = list(area)
    tx = _segment_cells(_placed(transects, area), cell, ends=("tx0", "ty0", "tx1", "ty1"))
    sg = _segment_cells(segs.select(*area, *line_keys, "x0", "y0", "x1", "y1"), cell)
    pairs = salted_join(sg, tx, [*area, "cx", "cy"], spread=["x0", "y0", "x1", "y1"])
    four = lambda pre: [F.col(f"{pre}{c}") for c in ("x0", "y0", "x1", "y1")]

    def keep(**terms: Column) -> dict[str, Column]:
        nonlocal pairs
        pairs = pairs.withColumns({f"_{name}": term for name, term in terms.items()})
        return {name: F.col(f"_{name}") for name in terms}

    # The JVM compiles methods of up to 8000 bytes: the formula's terms are columns, and it stands only once, since a filter on the
    # row of an array, unlike one on the formula, does not repeat it. All of it is generated; ``array_compact`` would be interpreted.
    met = keep(met=meeting_point(four("t"), four(""), keep))["met"]
    found = pairs.withColumn("t", F.explode(F.array(met))).filter("t IS NOT NULL")
    return found.select(*area, *line_keys, "transect_index", "t", "place", "tx0", "ty0", "tx1", "ty1")


def nearest_hits(hits: DataFrame, transects: DataFrame, line_keys: Sequence[str], area: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Per line and transect the hit nearest to the transect's midpoint.

    Distances are signed from the midpoint (``distance_signed``) and from the start. The nearest hit is the last
    of the first half or the first of the second: numbers only, so rows are hashed, where a struct would be sorted.
    """
    keys = [*area, *line_keys]
    low, high = F.when(F.col("t") <= 0.5, F.col("t")), F.when(F.col("t") > 0.5, F.col("t"))
    halves = hits.groupBy(*keys, "transect_index").agg(
        F.max(low).alias("_low"), F.max_by("place", low).alias("_low_place"), F.min(high).alias("_high"), F.min_by("place", high).alias("_high_place")
    )
    first = F.col("_high").isNull() | (0.5 - F.col("_low") <= F.col("_high") - 0.5)
    best = halves.select(
        *keys,
        "transect_index",
        F.when(first, F.col("_low")).otherwise(F.col("_high")).alias("t"),
        F.when(first, F.col("_low_place")).otherwise(F.col("_high_place")).alias("place"),
    )
    ends = _placed(transects, area).drop("transect_index").dropDuplicates([*area, "place"])
    best = salted_join(best, ends, [*area, "place"], spread=[*line_keys, "transect_index"])
    length = F.hypot(F.col("tx1") - F.col("tx0"), F.col("ty1") - F.col("ty0"))
    t = F.col("t")
    return best.select(
        *keys,
        "transect_index",
        (t * length).alias("distance_from_start"),
        (t * length - length / 2.0).alias("distance_signed"),
        (F.col("tx0") + t * (F.col("tx1") - F.col("tx0"))).alias("x"),
        (F.col("ty0") + t * (F.col("ty1") - F.col("ty0"))).alias("y"),
    )


def intersect(
    transects: DataFrame, segs: DataFrame, line_keys: Sequence[str], area: Sequence[str] = ("aoi_id",), cell: float = 500.0
) -> DataFrame:
    """Nearest hit per (line, transect); pairs without a hit have no row here."""
    return nearest_hits(transect_hits(transects, segs, line_keys, area, cell), transects, line_keys, area)


def observation_series(
    scenes: DataFrame, transects: DataFrame, hits: DataFrame, carry: Sequence[str] = ("datetime",)
) -> DataFrame:
    """A row for every scene and transect of an AOI, WL and VE side by side, NULL without a hit.

    ``hits``: output of ``intersect`` with a ``boundary`` column (``WL``/``VE``) and, where
    wanted, ``lon``/``lat``. The grid itself is the result, so it comes from an equi-join
    on the AOI with the scene side salted.
    """
    has_geo = "lon" in hits.columns
    picks = []
    for b in ("WL", "VE"):
        mine = F.col("boundary") == b
        picks.append(F.max(F.when(mine, F.col("distance_signed"))).alias(f"{b}_distance_m"))
        if has_geo:
            picks += [F.max(F.when(mine, F.col(c))).alias(f"{b.lower()}_{c}") for c in ("lon", "lat")]
    wide = hits.groupBy("aoi_id", "scene_id", "transect_index").agg(*picks)
    grid = salted_join(
        scenes.select("aoi_id", "scene_id", *carry), transects.select("aoi_id", "transect_index"), ["aoi_id"], spread=["scene_id"]
    )
    return grid.join(wide, ["aoi_id", "scene_id", "transect_index"], "left")


def with_lonlat(hits: DataFrame, epsg: str) -> DataFrame:
    """Add ``lon``/``lat`` of metric hit points."""
    return geo.unproject(hits, "x", "y", epsg)


def hit_stats(transects: DataFrame, segs: DataFrame, line_keys: Sequence[str], cell: float = 500.0) -> DataFrame:
    """Per line: hits, hit ratio over the AOI's transects and median absolute offset.

    A line has at most one nearest hit per transect of its AOI, which bounds each group.
    """
    segs = settle(segs.select("aoi_id", *line_keys, "x0", "y0", "x1", "y1"))
    transects = settle(transects.select("aoi_id", "transect_index", "x0", "y0", "x1", "y1"))
    near = cut(intersect(transects, segs, line_keys, cell=cell))
    n = transects.groupBy("aoi_id").agg(F.count("*").alias("n_transects"))
    got = near.groupBy("aoi_id", *line_keys).agg(
        F.count("*").alias("hits"), F.percentile(F.abs("distance_signed"), F.lit(0.5)).alias("median_offset")
    )
    all_lines = segs.select("aoi_id", *line_keys).distinct()
    out = salted_join(all_lines, n, ["aoi_id"], "left").join(got, ["aoi_id", *line_keys], "left")
    return out.withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn(
        "hit_ratio", F.coalesce(F.col("hits") / F.col("n_transects"), F.lit(0.0))
    )


def reconstruct(
    transects: DataFrame, segs: DataFrame, scene_keys: Sequence[str], min_ratio: float, cell: float = 500.0
) -> DataFrame:
    """Line through the nearest hit of every transect over all contours of a scene.

    Needs at least 3 hits and ``min_ratio`` of the transects; missing transects are filled
    linearly along the transect index, constant at the ends. Returns ``seq, x, y, known``.
    A line has at most one nearest hit per transect of its AOI, which bounds what is sorted in one piece.
    """
    keys = ["aoi_id", *scene_keys]
    transects = settle(transects.select("aoi_id", "transect_index", "x0", "y0", "x1", "y1"))
    near = nearest_hits(transect_hits(transects, segs, scene_keys, cell=cell), transects, scene_keys)
    n = transects.groupBy("aoi_id").agg(F.count("*").alias("n_transects"), F.max("transect_index").alias("last_index"))
    # counted and filled in one order of the rows
    whole = Window.partitionBy(*keys).orderBy("transect_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = near.select(*keys, "transect_index", "x", "y", F.count("*").over(whole).alias("hits")).filter("hits >= 3")
    known = (
        salted_join(counts, n, ["aoi_id"], spread=[*scene_keys, "transect_index"])
        .withColumn("hit_ratio", F.col("hits") / F.col("n_transects"))
        .filter(F.col("hit_ratio") >= min_ratio)
    )
    filled = fill_linear(
        known.select(*keys, "transect_index", "x", "y", "hits", "hit_ratio", "last_index"),
        keys,
        "transect_index",
        ["x", "y"],
        F.lit(0),
        F.col("last_index"),
        chunk=None,
    )
    return filled.withColumnRenamed("transect_index", "seq").drop("last_index")


def pixels_near(
    pixels: DataFrame, segs: DataFrame, keys: Sequence[str], distance: Column | float, cell: float, x: str = "x", y: str = "y"
) -> DataFrame:
    """Rows of ``pixels`` within ``distance`` of a segment sharing ``keys`` (a buffer).

    ``cell`` must be at least the largest distance; each segment reaches the cells it
    touches when inflated by that much.
    """
    d = distance if isinstance(distance, Column) else F.lit(float(distance))
    s = _segment_cells(segs.select(*keys, "x0", "y0", "x1", "y1"), cell, pad=cell)
    p = pixels.withColumn("cx", F.floor(F.col(x) / cell)).withColumn("cy", F.floor(F.col(y) / cell))
    dx, dy = F.col("s.x1") - F.col("s.x0"), F.col("s.y1") - F.col("s.y0")
    l2 = dx * dx + dy * dy
    raw = F.try_divide((F.col(f"p.{x}") - F.col("s.x0")) * dx + (F.col(f"p.{y}") - F.col("s.y0")) * dy, l2)
    t = F.when(l2 > 0, F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    ox, oy = F.col(f"p.{x}") - F.col("s.x0") - t * dx, F.col(f"p.{y}") - F.col("s.y0") - t * dy
    on = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in [*keys, "cx", "cy"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return p.alias("p").join(s.alias("s"), cond & (ox * ox + oy * oy <= d * d), "left_semi").drop("cx", "cy")


def pixels_inside(pixels: DataFrame, areas: DataFrame, keys: Sequence[str], ring: str = "ring", x: str = "x", y: str = "y") -> DataFrame:
    """Pixel centres inside the ring of their AOI; the envelope is tested first."""
    box = areas.select(*keys, F.col(ring).alias("_ring"), lines.envelope(ring).alias("_box"))
    p = salted_join(pixels, box, keys, spread=[x, y])
    px, py, b = F.col(x), F.col(y), F.col("_box")
    inside = px.between(b[0], b[2]) & py.between(b[1], b[3])
    return p.filter(inside).filter(lines.in_polygon(px, py, "_ring")).drop("_ring", "_box")


def corridor(pixels: DataFrame, transects: DataFrame, keys: Sequence[str], distance: float, valid: str) -> DataFrame:
    """Valid pixels within ``distance`` of any transect."""
    return pixels_near(pixels.filter(valid), transects, keys, distance, max(distance, 1e-9))


def _foot(px: Column, py: Column, seg: Sequence[Column]) -> tuple[Column, Column]:
    """Distance of a point to a segment and the share of the segment's length of its foot."""
    x0, y0, x1, y1 = seg
    dx, dy = x1 - x0, y1 - y0
    l2 = dx * dx + dy * dy
    raw = F.try_divide((px - x0) * dx + (py - y0) * dy, l2)
    t = F.when(l2 > 0, F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    return F.hypot(px - x0 - t * dx, py - y0 - t * dy), t


def nearest_segment(
    queries: DataFrame, targets: DataFrame, query_keys: Sequence[str], keys: Sequence[str], start: float
) -> DataFrame:
    """Distance of each query segment (``x0,y0,x1,y1``; a point has both ends equal) to the
    nearest target segment sharing ``keys``, and ``along``: where the query's start projects.

    The search radius grows fourfold until every query is settled: a query is settled once
    its nearest candidate lies within the radius that was searched in full, so no query
    meets all segments of its key unless they really are that close. Queries whose keys
    have no target are left out, as are queries and targets with a coordinate that is null, infinite or not a number. Targets carry ``cum0`` (distance from their line's start).
    """
    q_cols, t_cols = ["x0", "y0", "x1", "y1"], ["x0", "y0", "x1", "y1", "cum0"]
    def placed(df: DataFrame) -> DataFrame:
        whole = F.lit(True)
        for c in q_cols:
            # not a number counts as largest, so the comparison leaves it out with the infinite ones
            whole = whole & F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < F.lit(float("inf")))
        return df.filter(whole)

    queries, targets = placed(queries), placed(targets).select(*keys, *[F.col(c).alias(f"_{c}") for c in t_cols])
    waiting = cut(
        salted_join(queries.select(*query_keys, *q_cols), targets.select(*keys).distinct(), keys, spread=q_cols)
    )
    q = [F.col(c) for c in q_cols]
    t = [F.col(f"_{c}") for c in q_cols]
    d_start, foot = _foot(q[0], q[1], t)
    ends = F.least(d_start, _foot(q[2], q[3], t)[0], _foot(t[0], t[1], q)[0], _foot(t[2], t[3], q)[0])
    gap = F.when(meeting_point(q, t).isNotNull(), 0.0).otherwise(ends)
    along = F.col("_cum0") + foot * F.hypot(t[2] - t[0], t[3] - t[1])
    radius, done = float(start), []
    while True:
        tc = cells(t[0], t[1], t[2], t[3], radius, pad=radius)
        near = targets.withColumn("_cell", F.explode(tc)).select("*", "_cell.cx", "_cell.cy").drop("_cell")
        qc = waiting.withColumn("_cell", F.explode(cells(*q, radius))).select("*", "_cell.cx", "_cell.cy").drop("_cell")
        met = (
            salted_join(qc, near, [*keys, "cx", "cy"], spread=q_cols)
            .withColumn("distance", gap)
            .withColumn("_ds", d_start)
            .withColumn("along", along)
        )
        best = met.groupBy(*query_keys).agg(
            F.min("distance").alias("distance"), F.min_by("along", F.struct("_ds", "along")).alias("along"), F.min("_ds").alias("_ds")
        )
        # both the gap and the start's own foot must lie inside the searched radius
        settled = cut(best.filter((F.col("distance") <= radius) & (F.col("_ds") <= radius)).drop("_ds"))
        done.append(settled)
        waiting = cut(waiting.join(settled.select(*query_keys), list(query_keys), "left_anti"))
        if waiting.isEmpty():
            break
        radius *= 4.0
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
