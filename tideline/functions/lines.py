"""Short lines and rings as ``array<struct<x,y>>`` Column expressions.

For lines of any length use the vertex tables of ``operators.geometry``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def flip_latlng(pairs: Column | str) -> Column:
    """``[[lat, lng], …]`` to ``[{x: lon, y: lat}, …]``."""
    return F.transform(_c(pairs), lambda p: point(p[1], p[0]))


def to_latlng(line: Column | str) -> Column:
    """The way back: ``[[lat, lng], …]``."""
    return F.transform(_c(line), lambda p: F.array(p["y"], p["x"]))


def steps(line: Column | str) -> Column:
    """Consecutive vertex pairs as ``array<struct<a,b>>``."""
    line = _c(line)
    n = F.size(line)
    return F.zip_with(
        F.slice(line, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(line, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def _dist(a: Column, b: Column) -> Column:
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def line_length(line: Column | str) -> Column:
    return F.aggregate(steps(line), F.lit(0.0), lambda acc, s: acc + _dist(s["a"], s["b"]))


def cum_length(line: Column | str) -> Column:
    """Distance from the start at every vertex."""
    return F.aggregate(
        steps(line),
        F.array(F.lit(0.0)),
        lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + _dist(s["a"], s["b"]))),
    )


def interpolate(line: Column | str, distance: Column, normalized: bool = False) -> Column:
    """Point at ``distance`` from the start, clamped to the line."""
    line = _c(line)
    total = line_length(line)
    d = F.greatest(F.least(distance * total if normalized else distance, total), F.lit(0.0))
    start = F.struct(F.lit(0.0).alias("left"), F.get(line, F.lit(0)).alias("p"), F.lit(False).alias("done"))

    def walk(acc: Column, s: Column) -> Column:
        seg = _dist(s["a"], s["b"])
        rest = d - acc["left"]
        inside = (~acc["done"]) & (rest <= seg) & (seg > 0)
        r = F.try_divide(rest, seg)
        here = point(s["a"]["x"] + r * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + r * (s["b"]["y"] - s["a"]["y"]))
        return F.struct(
            (acc["left"] + seg).alias("left"),
            F.when(acc["done"], acc["p"]).when(inside, here).otherwise(s["b"]).alias("p"),
            (acc["done"] | inside).alias("done"),
        )

    return F.aggregate(steps(line), start, walk, lambda acc: acc["p"])


def project_on(line: Column | str, p: Column) -> Column:
    """Distance from the start of the point of ``line`` nearest to ``p`` (first on ties)."""
    start = F.struct(F.lit(0.0).alias("len"), F.lit(float("inf")).alias("best"), F.lit(0.0).alias("at"))

    def walk(acc: Column, s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        seg = F.hypot(dx, dy)
        raw = F.try_divide((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy, seg * seg)
        t = F.when(seg > 0, F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
        off = F.hypot(p["x"] - s["a"]["x"] - t * dx, p["y"] - s["a"]["y"] - t * dy)
        return F.struct(
            (acc["len"] + seg).alias("len"),
            F.least(acc["best"], off).alias("best"),
            F.when(off < acc["best"], acc["len"] + t * seg).otherwise(acc["at"]).alias("at"),
        )

    return F.aggregate(steps(line), start, walk, lambda acc: acc["at"])


def envelope(line: Column | str) -> Column:
    """``[min x, min y, max x, max y]``."""
    xs, ys = F.transform(_c(line), lambda p: p["x"]), F.transform(_c(line), lambda p: p["y"])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def close_ring(ring: Column | str) -> Column:
    """Repeat the first vertex at the end unless it is there already."""
    ring = _c(ring)
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(
        F.concat(ring, F.slice(ring, 1, 1))
    )


def signed_area(ring: Column | str) -> Column:
    """Shoelace area of a closed ring, positive counter-clockwise."""
    return F.aggregate(
        steps(ring), F.lit(0.0), lambda acc, s: acc + (s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]) / 2.0
    )


def centroid(ring: Column | str) -> Column:
    """Area centroid of a closed ring; mean of the vertices when the area is zero."""
    ring = _c(ring)
    x0, y0 = F.get(ring, F.lit(0))["x"], F.get(ring, F.lit(0))["y"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))

    def walk(acc: Column, s: Column) -> Column:
        ax, ay, bx, by = s["a"]["x"] - x0, s["a"]["y"] - y0, s["b"]["x"] - x0, s["b"]["y"] - y0
        k = ax * by - bx * ay
        return F.struct(
            (acc["a"] + k / 2).alias("a"), (acc["cx"] + (ax + bx) * k / 6).alias("cx"), (acc["cy"] + (ay + by) * k / 6).alias("cy")
        )

    n = F.size(ring)
    mean = lambda f: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[f]) / n
    return F.aggregate(
        steps(ring),
        zero,
        walk,
        lambda acc: F.when(acc["a"] != 0, point(x0 + F.try_divide(acc["cx"], acc["a"]), y0 + F.try_divide(acc["cy"], acc["a"]))).otherwise(
            point(mean("x"), mean("y"))
        ),
    )


def line_centroid(line: Column | str) -> Column:
    """Length-weighted mean of the segment midpoints."""
    zero = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))

    def walk(acc: Column, s: Column) -> Column:
        d = _dist(s["a"], s["b"])
        return F.struct(
            (acc["l"] + d).alias("l"),
            (acc["cx"] + d * (s["a"]["x"] + s["b"]["x"]) / 2).alias("cx"),
            (acc["cy"] + d * (s["a"]["y"] + s["b"]["y"]) / 2).alias("cy"),
        )

    return F.aggregate(steps(line), zero, walk, lambda acc: point(F.try_divide(acc["cx"], acc["l"]), F.try_divide(acc["cy"], acc["l"])))


def _side(a: Column, b: Column, p: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))


def _within(a: Column, b: Column, p: Column) -> Column:
    return (
        p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
        & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
    )


def segments_touch(a: Column, b: Column, c: Column, d: Column) -> Column:
    """True when segments ``ab`` and ``cd`` share a point."""
    s1, s2, s3, s4 = _side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)
    return (
        ((s1 != s2) & (s3 != s4))
        | ((s1 == 0) & _within(a, b, c))
        | ((s2 == 0) & _within(a, b, d))
        | ((s3 == 0) & _within(c, d, a))
        | ((s4 == 0) & _within(c, d, b))
    )


def self_crosses(ring: Column | str) -> Column:
    """True when two non-adjacent sides of a closed ring touch."""
    sides = F.transform(steps(ring), lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), i.alias("i")))

    def crossing(sides: Column) -> Column:
        n = F.size(sides)
        return F.exists(
            sides,
            lambda s: F.exists(
                sides,
                lambda t: (t["i"] > s["i"] + 1)
                & ~((s["i"] == 0) & (t["i"] == n - 1))
                & segments_touch(s["a"], s["b"], t["a"], t["b"]),
            ),
        )

    # bound to a name, the sides are worked out once and not once per side
    return F.get(F.transform(F.array(sides), crossing), F.lit(0))


def in_polygon(x: Column, y: Column, ring: Column | str) -> Column:
    """Crossing-number test of a point against a closed ring."""
    hits = F.aggregate(
        steps(ring),
        F.lit(0),
        lambda acc, s: acc
        + F.when(
            ((s["a"]["y"] > y) != (s["b"]["y"] > y))
            & (x < F.try_divide((s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]), s["b"]["y"] - s["a"]["y"]) + s["a"]["x"]),
            1,
        ).otherwise(0),
    )
    return F.pmod(hits, F.lit(2)) == 1


def sort_by_x(line: Column | str) -> Column:
    """Vertices left to right; equal x keep their order."""
    keyed = F.transform(_c(line), lambda p, i: F.struct(p["x"].alias("x"), i.alias("i"), p["y"].alias("y")))
    return F.transform(F.array_sort(keyed), lambda s: point(s["x"], s["y"]))


def dedupe_consecutive(line: Column | str, tol: float = 1e-6) -> Column:
    """Drop a vertex within L1 distance ``tol`` of the last kept one."""
    line = _c(line)
    first = F.slice(line, 1, 1)
    return F.aggregate(
        F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))),
        first,
        lambda kept, p: F.when(
            F.abs(p["x"] - F.element_at(kept, -1)["x"]) + F.abs(p["y"] - F.element_at(kept, -1)["y"]) > tol,
            F.concat(kept, F.array(p)),
        ).otherwise(kept),
    )


def target_points(length: Column, count: Column, fixed: int, low: int, high: int, per_100px: float) -> Column:
    """How many points a label line gets; ``round`` is half to even."""
    floor = max(3, low)
    guess = F.greatest(F.rint(length * max(per_100px / 100.0, 0.01)).cast("int"), F.lit(floor))
    if high > 0:
        guess = F.least(guess, F.lit(max(high, floor)))
    guess = F.lit(int(fixed)) if fixed > 1 else guess
    return F.when(count < 3, F.greatest(count.cast("int"), F.lit(3))).otherwise(guess)
