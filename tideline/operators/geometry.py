"""Lines of any length as vertex tables ``(keys…, seq, x, y)`` and their segments.

``seq`` only has to be orderable (a long); it need not be contiguous. Sorting happens in
chunks of ``seq``, so one very long line does not land in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import geo, lines
from tideline.lineage import settle
from tideline.operators.skew import nth, ordered_neighbours, running_sum, salted_join

CHUNK = 4096
#: Vertices of a piece of a line.
CHUNK_VERTICES = 1024


def vertices_of(df: DataFrame, line: str, keys: Sequence[str]) -> DataFrame:
    """Array geometry to a vertex table."""
    return df.select(*keys, F.posexplode(line).alias("seq", "_p")).select(
        *keys, F.col("seq").cast("long").alias("seq"), "_p.x", "_p.y"
    )


def lines_of(vertices: DataFrame, keys: Sequence[str], name: str = "line") -> DataFrame:
    """Vertex table to array geometry; meant for short lines only."""
    pts = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    return vertices.groupBy(*keys).agg(F.transform(pts, lambda p: lines.point(p["x"], p["y"])).alias(name))


def lines_in_chunks(vertices: DataFrame, keys: Sequence[str], part: Column, size: int = CHUNK_VERTICES) -> DataFrame:
    """Vertex table to array geometry in numbered pieces of ``size`` vertices, for lines of any length; ``part`` cuts a line's sequence for the numbering.

    A later piece opens with the last vertex of the one before, so pieces join and hold two vertices at least, but where a line ends with a full
    piece: there a piece of that one vertex follows. Vertex ``k`` of piece ``chunk`` is the line's vertex ``chunk * size + k``, less one in later pieces.
    """
    numbered = running_sum(vertices, keys, ["seq"], part, F.lit(1).cast("bigint"), "_n")
    chunk = F.floor((F.col("_n") - 1) / size)
    both = F.when(F.col("_n") % size == 0, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    return lines_of(numbered.withColumn("chunk", F.explode(both)), [*keys, "chunk"])


def segments(vertices: DataFrame, keys: Sequence[str], chunk: Column | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """One row per consecutive vertex pair: ``seq, x0, y0, x1, y1`` (+ ``extra`` as ``<c>0, <c>1``)."""
    chunk = F.floor(F.col("seq") / CHUNK) if chunk is None else chunk
    near = ordered_neighbours(vertices, keys, ["seq"], chunk, ["x", "y", *extra], before=0, after=1)
    cols = ["x", "y", *extra]
    return near.filter(F.size("next") > 0).select(
        *keys,
        "seq",
        *[F.col(c).alias(f"{c}0") for c in cols],
        *[nth("next", 0, c).alias(f"{c}1") for c in cols],
    )


def measured_segments(vertices: DataFrame, keys: Sequence[str], chunk: Column | None = None) -> DataFrame:
    """Segments with distance from the start: ``cum0, cum1`` and the line's ``total``.

    Zero-length segments and lines are dropped. A segment's ``cum1`` is the very value the
    next one has as ``cum0``, so sample positions fall into exactly one segment.
    """
    chunk = F.floor(F.col("seq") / CHUNK) if chunk is None else chunk
    back = ordered_neighbours(vertices, keys, ["seq"], chunk, ["x", "y"], before=1, after=0)
    step = F.coalesce(F.hypot(F.col("x") - nth("prev", 0, "x"), F.col("y") - nth("prev", 0, "y")), F.lit(0.0))
    cum = running_sum(back.withColumn("_step", step), keys, ["seq"], chunk, F.col("_step"), "cum")
    # every join below reads both its sides from the same rows
    cum = settle(cum.select(*keys, "seq", "x", "y", "cum"))
    seg = segments(cum, keys, chunk, extra=["cum"])
    seg = seg.filter(F.col("cum1") > F.col("cum0"))
    totals = seg.groupBy(*keys).agg(F.max("cum1").alias("total"))
    return salted_join(seg, totals, keys, spread=["seq"])


def line_lengths(vertices: DataFrame, keys: Sequence[str], chunk: Column | None = None) -> DataFrame:
    """Length and vertex count per line; a one-vertex line has length 0."""
    chunk = F.floor(F.col("seq") / CHUNK) if chunk is None else chunk
    back = ordered_neighbours(vertices, keys, ["seq"], chunk, ["x", "y"], before=1, after=0)
    step = F.hypot(F.col("x") - nth("prev", 0, "x"), F.col("y") - nth("prev", 0, "y"))
    return back.groupBy(*keys).agg(
        F.coalesce(F.sum(step), F.lit(0.0)).alias("length"), F.count("*").alias("n_vertices")
    )


def _at(pos: Column) -> tuple[Column, Column]:
    r = (pos - F.col("cum0")) / (F.col("cum1") - F.col("cum0"))
    return F.col("x0") + r * (F.col("x1") - F.col("x0")), F.col("y0") + r * (F.col("y1") - F.col("y0"))


def _tagged(ks: Column, name: str, off: Column) -> Column:
    return F.transform(ks, lambda k: F.struct(F.lit(name).alias("tag"), k.alias("k"), off.cast("double").alias("off")))


def points_at(seg: DataFrame, keys: Sequence[str], count: Column, position, offsets: dict[str, Column]) -> DataFrame:
    """Points of each line at sampled positions, without an interval join.

    Sample ``k`` of ``0..count-1`` sits at ``position(k)``, non-decreasing in ``k`` with
    ``position(k) = k * step`` up to the end of the line. ``offsets`` maps a name to a shift
    along the line; shifted positions are clamped to it. Every segment works out which
    samples fall into it, so the work is linear in segments plus samples.

    Returns ``keys, k, d`` and ``<name>_x, <name>_y`` per offset. ``position`` is a pair
    ``(step, total)`` of Columns.
    """
    step, total = position
    pieces = []
    for name, off in offsets.items():
        first, last = F.col("cum0") == 0, F.col("cum1") == total
        low = F.when(first, F.lit(0)).otherwise(F.ceil((F.col("cum0") - off) / step))
        high = F.when(last, count - 1).otherwise(F.ceil((F.col("cum1") - off) / step) - 1)
        low, high = F.greatest(low, F.lit(0)), F.least(high, count - 2)
        body = F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(
            F.array().cast("array<bigint>")
        )
        end = F.greatest(F.least(total + off, total), F.lit(0.0))
        ends_here = ((end >= F.col("cum0")) & (end < F.col("cum1"))) | (last & (end >= total))
        ks = F.concat(body, F.when(ends_here, F.array((count - 1).cast("long"))).otherwise(F.array().cast("array<bigint>")))
        pieces.append(_tagged(ks, name, off))
    out = seg.withColumn("_step", step.cast("double")).withColumn("_total", total.cast("double")).withColumn("_n", count.cast("long"))
    out = out.withColumn("_s", F.explode(F.concat(*pieces)))
    d = F.when(F.col("_s.k") >= F.col("_n") - 1, F.col("_total")).otherwise(F.col("_s.k") * F.col("_step"))
    pos = F.greatest(F.least(d + F.col("_s.off"), F.col("_total")), F.lit(0.0))
    x, y = _at(F.greatest(F.least(F.col("_pos"), F.col("cum1")), F.col("cum0")))
    out = out.withColumn("_d", d).withColumn("_pos", pos).withColumn("_x", x).withColumn("_y", y)
    tag = F.col("_s.tag")
    return out.groupBy(*keys, F.col("_s.k").alias("k")).agg(
        F.max("_d").alias("d"),
        *[F.max(F.when(tag == n, F.col("_x"))).alias(f"{n}_x") for n in offsets],
        *[F.max(F.when(tag == n, F.col("_y"))).alias(f"{n}_y") for n in offsets],
    )


def sample_distances(df: DataFrame, length: str, spacing: float, strict: bool = False) -> DataFrame:
    """``0, s, 2s…`` below the length plus the end point.

    The end is added when the last step is not exactly the length; with ``strict`` only
    when the gap is above 1e-6. Adds ``k`` and ``d``.
    """
    total = F.col(length)
    n = F.ceil(total / spacing)
    ks = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.struct(k.alias("k"), (k * spacing).alias("d")))
    gap = total - (n - 1) * spacing
    end = F.array(F.struct(n.cast("long").alias("k"), total.cast("double").alias("d")))
    keep_end = gap > 1e-6 if strict else gap != 0
    return (
        df.filter(total > 0)
        .withColumn("_s", F.explode(F.when(keep_end, F.concat(ks, end)).otherwise(ks)))
        .select("*", "_s.k", "_s.d")
        .drop("_s")
    )


def generate_transects(
    vertices: DataFrame,
    keys: Sequence[str],
    spacing: float,
    length: float,
    ratio: float,
    window: str = "metre",
    chunk: Column | None = None,
) -> DataFrame:
    """Cross-shore transects from metric lines, ids from 0.

    ``window``: ``metre`` takes the tangent over ±1 m, ``percent`` over ±max(10 m, 1 %).
    The start lies ``length*(1-ratio)`` onshore, the end ``length*ratio`` offshore.
    """
    spacing, length, ratio = max(float(spacing), 1.0), max(float(length), 10.0), min(max(float(ratio), 0.0), 1.0)
    return _transects(vertices, keys, spacing, length, ratio, window, chunk, strict_end=(window == "percent"))


def _transects(vertices, keys, spacing, length, ratio, window, chunk, strict_end):
    seg = measured_segments(vertices, keys, chunk)
    if window == "metre":
        half = F.lit(1.0)
    else:
        half = F.when(F.col("total") < 1e-6, 0.5).otherwise(F.greatest(F.lit(10.0), F.col("total") * 0.01))
    whole = F.ceil(F.col("total") / spacing)
    short = F.col("total") - (whole - 1) * spacing <= 1e-6
    count = F.when(F.lit(strict_end) & short & (whole > 1), whole).otherwise(whole + 1)
    pts = points_at(seg, keys, count, (F.lit(spacing), F.col("total")), {"c": F.lit(0.0), "a": -half, "b": half})
    return _cross_lines(pts, keys, length * (1.0 - ratio), length * ratio)


def _cross_lines(pts: DataFrame, keys: Sequence[str], onshore: float, offshore: float) -> DataFrame:
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    norm = F.hypot(dx, dy)
    nx = F.coalesce(F.try_divide(-dy, norm), F.lit(0.0))
    ny = F.coalesce(F.try_divide(dx, norm), F.lit(1.0))
    p = pts.withColumn("_nx", nx).withColumn("_ny", ny)
    return p.select(
        *keys,
        F.col("k").cast("int").alias("transect_index"),
        F.col("d").alias("distance_along"),
        (F.col("c_x") - F.col("_nx") * onshore).alias("x0"),
        (F.col("c_y") - F.col("_ny") * onshore).alias("y0"),
        (F.col("c_x") + F.col("_nx") * offshore).alias("x1"),
        (F.col("c_y") + F.col("_ny") * offshore).alias("y1"),
    )


def baseline_transects(
    vertices: DataFrame, keys: Sequence[str], spacing: float = 20.0, length: float = 500.0, ratio: float = 0.7,
    chunk: Column | None = None,
) -> DataFrame:
    """Strict workflow: parameters are checked, transects carry labels and their settings."""
    if spacing <= 0:
        raise ValueError("spacing must be above zero")
    if length <= 0:
        raise ValueError("transect length must be above zero")
    if not 0.0 <= ratio <= 1.0:
        raise ValueError("offshore ratio must lie between 0 and 1")
    rows = _transects(vertices, keys, float(spacing), float(length), float(ratio), "percent", chunk, strict_end=True)
    return rows.withColumn("transect_label", F.format_string("T%03d", F.col("transect_index") + 1)).select(
        "*",
        F.lit(float(spacing)).alias("spacing_m"),
        F.lit(float(length)).alias("transect_length_m"),
        F.lit(float(ratio)).alias("offshore_ratio"),
        F.lit(float(length * ratio)).alias("offshore_length_m"),
        F.lit(float(length * (1.0 - ratio))).alias("onshore_length_m"),
    )


def transects_degrees(
    vertices: DataFrame, keys: Sequence[str], spacing_m: float = 100.0, length_m: float = 500.0, ratio: float = 0.7,
    chunk: Column | None = None,
) -> DataFrame:
    """Legacy form on unprojected lines: ``int(len/spacing)`` positions spread end to end."""
    spacing, length = spacing_m / geo.METRES_PER_DEGREE, length_m / geo.METRES_PER_DEGREE
    seg = measured_segments(vertices, keys, chunk)
    count = F.floor(F.col("total") / spacing)
    seg = seg.filter(count >= 1)
    window = F.col("total") * 0.01
    many = seg.filter(count > 1)
    pts = points_at(
        many, keys, count, (F.try_divide(F.col("total"), count - 1), F.col("total")), {"c": F.lit(0.0), "a": -window, "b": window}
    )
    # a single transect sits at the start of its line
    one = seg.filter((count == 1) & (F.col("cum0") <= window))
    wx, wy = _at(F.least(window, F.col("cum1")))
    single = one.groupBy(*keys).agg(
        F.lit(0).cast("long").alias("k"),
        F.lit(0.0).alias("d"),
        F.min_by("x0", "cum0").alias("c_x"),
        F.min_by("x0", "cum0").alias("a_x"),
        F.max_by(wx, "cum0").alias("b_x"),
        F.min_by("y0", "cum0").alias("c_y"),
        F.min_by("y0", "cum0").alias("a_y"),
        F.max_by(wy, "cum0").alias("b_y"),
    )
    return _cross_lines(pts.unionByName(single), keys, length * (1 - ratio), length * ratio)


def resample(vertices: DataFrame, keys: Sequence[str], n: int, chunk: Column | None = None) -> DataFrame:
    """``n`` points evenly spaced by arc length. Repeated vertices keep their first place."""
    first = vertices.groupBy(*keys, "x", "y").agg(F.min("seq").alias("seq"))
    return resample_ordered(first, keys, F.lit(int(n)), chunk)


def resample_ordered(vertices: DataFrame, keys: Sequence[str], n: Column, chunk: Column | None = None) -> DataFrame:
    """As ``resample`` without removing repeated vertices; ``n`` may depend on the keys and ``total``."""
    seg = measured_segments(vertices, keys, chunk)
    pts = points_at(seg, keys, n, (F.try_divide(F.col("total"), n - 1), F.col("total")), {"c": F.lit(0.0)})
    return pts.select(*keys, F.col("k").alias("seq"), F.col("c_x").alias("x"), F.col("c_y").alias("y"))


def sort_left_to_right(vertices: DataFrame, keys: Sequence[str], chunk_width: float) -> DataFrame:
    """Re-number vertices by x (then old order); sorted in strips of ``chunk_width``."""
    ranked = running_sum(vertices, keys, ["x", "seq"], F.floor(F.col("x") / chunk_width), F.lit(1), "_rank")
    return ranked.withColumn("seq", F.col("_rank").cast("long") - 1).drop("_rank")


def project_lines(vertices: DataFrame, epsg: str) -> DataFrame:
    """Vertex table lon/lat to metric: replaces ``x, y``."""
    v = vertices.withColumnsRenamed({"x": "_lon", "y": "_lat"})
    return geo.project(v, "_lon", "_lat", epsg, "x", "y").drop("_lon", "_lat")


def unproject_lines(vertices: DataFrame, epsg: str) -> DataFrame:
    v = vertices.withColumnsRenamed({"x": "_x", "y": "_y"})
    return geo.unproject(v, "_x", "_y", epsg, "x", "y").drop("_x", "_y")


# --- AOI and baseline records: hand-drawn shapes, a bounded number of vertices each ---

MIN_AOI_AREA_M2 = 1000.0


def _bad_vertex(pairs: Column) -> Column:
    return F.exists(pairs, lambda p: F.coalesce(F.size(p) != 2, F.lit(True)))


def _out_of_range(pairs: Column) -> Column:
    ok = lambda p: p[0].between(-90, 90) & p[1].between(-180, 180)
    return F.exists(pairs, lambda p: ~F.coalesce(ok(p), F.lit(False)))


def validate_aoi(df: DataFrame, key: str = "aoi_id", pairs: str = "vertices", close: bool = True) -> DataFrame:
    """Add ``ring``, ``utm_epsg``, ``area_m2`` and ``reason`` (NULL when accepted)."""
    p = F.col(pairs)
    base = df.withColumn(
        "_early",
        F.when(p.isNull() | (F.size(p) < 3), "too_few_vertices")
        .when(_bad_vertex(p), "bad_vertex")
        .when(_out_of_range(p), "out_of_range"),
    )
    ring = lines.flip_latlng(p)
    base = base.withColumn("ring", F.when(F.col("_early").isNull(), lines.close_ring(ring) if close else ring))
    base = base.withColumn("_closed", lines.close_ring("ring"))
    shape = F.col("_closed")
    base = base.withColumn(
        "_shape",
        F.when(F.col("ring").isNull(), None)
        .when(lines.self_crosses(shape), F.lit("self_intersection"))
        .when(F.abs(lines.signed_area(shape)) <= 0, F.lit("no_area")),
    )
    centre = lines.centroid(shape)
    base = base.withColumn("_centre", F.when(F.col("ring").isNotNull(), centre))
    # read by both sides of the join, and its tests of a shape are made once
    base = settle(base.withColumn("utm_epsg", geo.utm_epsg(F.col("_centre.x"), F.col("_centre.y"))))
    verts = vertices_of(base, "_closed", [key, "utm_epsg"])
    area = lines_of(project_lines(verts, "utm_epsg"), [key], "_metric").select(
        key, F.abs(lines.signed_area("_metric")).alias("area_m2")
    )
    out = base.join(area, key, "left")
    reason = F.coalesce("_early", "_shape", F.when(F.col("area_m2") < MIN_AOI_AREA_M2, F.lit("too_small")))
    return out.withColumn("reason", reason).drop("_early", "_shape", "_centre", "_closed")


def validate_baseline(df: DataFrame, pairs: str = "vertices") -> DataFrame:
    """Add ``line`` and ``reason`` (NULL when accepted)."""
    p = F.col(pairs)
    early = (
        F.when(p.isNull() | (F.size(p) < 2), "too_few_vertices")
        .when(_bad_vertex(p), "bad_vertex")
        .when(_out_of_range(p), "out_of_range")
    )
    out = df.withColumn("_early", early).withColumn("line", F.when(F.col("_early").isNull(), lines.flip_latlng(p)))
    zero = F.when(F.col("line").isNotNull() & (lines.line_length("line") <= 0), F.lit("zero_length"))
    return out.withColumn("reason", F.coalesce(F.col("_early"), zero)).drop("_early")


def make_feature(df: DataFrame, shape: str, name: str, now: Column, prefix: str, closed: bool) -> DataFrame:
    """Accepted shapes to catalog records: id = slug + time, envelope, centroid, vertex count."""
    from tideline.functions.text_time import slugify

    count = F.size(shape) - 1 if closed else F.size(shape)
    centre = lines.centroid(shape) if closed else lines.line_centroid(shape)
    stamped = F.concat_ws("_", slugify(name, prefix), F.date_format(now, "yyyyMMdd_HHmmss"))
    return (
        df.withColumn("_c", centre)
        .withColumn(f"{prefix}_id", stamped)
        .withColumn("created", now)
        .withColumn("bbox_wgs84", lines.envelope(shape))
        .withColumn("vertex_count", count)
        .withColumn("centroid", F.col("_c"))
        .withColumn("utm_epsg", geo.utm_epsg(F.col("_c.x"), F.col("_c.y")))
        .drop("_c")
    )
