"""Coordinates, sizes and projections as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: Column | str | float) -> Column:
    if isinstance(col, str):
        return F.col(col)
    return col if isinstance(col, Column) else F.lit(col)


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    """Value kept within two bounds; NULL stays NULL (``least``/``greatest`` would skip it)."""
    low, high = _c(low), _c(high)
    return F.when(value < low, low).when(value > high, high).otherwise(value)


# Metres per degree used for scale estimates, and raster size limits.
METRES_PER_DEGREE = 111320.0
METRES_PER_DEGREE_LAT = 110540.0
MIN_COS_LAT = 0.1
RASTER_MIN, RASTER_MAX = 64, 2500


def utm_epsg(lon: Column | str, lat: Column | str) -> Column:
    """326zz north of (and on) the equator, 327zz south; zone kept within 1..60."""
    zone = clip(F.floor((_c(lon) + 180.0) / 6.0) + 1, 1, 60)
    return (F.when(_c(lat) >= 0, 32600).otherwise(32700) + zone).cast("int")


def metric_epsg(epsg: Column | str, is_geographic: Column | str, lon: Column | str, lat: Column | str) -> Column:
    """Keep a projected system, else the UTM zone of the centroid."""
    return F.when(~_c(is_geographic) & _c(epsg).isNotNull(), _c(epsg).cast("int")).otherwise(utm_epsg(lon, lat))


def cos_floor(lat: Column | str) -> Column:
    c = F.abs(F.cos(F.radians(_c(lat))))
    return F.when(c < MIN_COS_LAT, MIN_COS_LAT).otherwise(c)


def m_to_units(metres: Column | str | float, is_geographic: Column | str, lat: Column | str) -> Column:
    """Metres in raster units; ``is_geographic`` NULL means the system is unknown."""
    m, geo = _c(metres), _c(is_geographic)
    return (
        F.when(geo.isNull(), m / METRES_PER_DEGREE)
        .when(geo, m / (METRES_PER_DEGREE * cos_floor(lat)))
        .otherwise(m)
    )


def bbox_dims(west, south, east, north, metres: float = 10.0) -> Column:
    """``struct(width, height)`` of a degree box at ``metres`` per pixel, clamped to 64..2500."""
    lat = (_c(south) + _c(north)) / 2.0
    w = F.ceil(F.abs(_c(east) - _c(west)) * METRES_PER_DEGREE * cos_floor(lat) / metres)
    h = F.ceil(F.abs(_c(north) - _c(south)) * METRES_PER_DEGREE_LAT / metres)
    clamp = lambda v: clip(v, RASTER_MIN, RASTER_MAX).cast("int")
    return F.struct(clamp(w).alias("width"), clamp(h).alias("height"))


def pixel_area(a, e, is_geographic, lat) -> Column:
    """Pixel area in square metres; anything unusable counts as 1."""
    dx, dy = F.abs(_c(a)), F.abs(_c(e))
    geo = dx * METRES_PER_DEGREE * cos_floor(lat) * dy * METRES_PER_DEGREE
    area = F.when(F.coalesce(_c(is_geographic), F.lit(True)), geo).otherwise(dx * dy)
    return F.when((dx > 0) & (dy > 0) & (area > 0) & (area < float("inf")), area).otherwise(1.0)


def min_patch_px(min_area_m2: float, area: Column | str) -> Column:
    n = F.ceil(F.lit(float(min_area_m2)) / _c(area)).cast("int")
    return F.when(n < 1, 1).otherwise(n)


def pix_to_world(row, col, a, c, e, f) -> Column:
    """Pixel centre to world: ``x = a(col+.5)+c``, ``y = e(row+.5)+f``."""
    return F.struct(
        (_c(a) * (_c(col) + 0.5) + _c(c)).alias("x"), (_c(e) * (_c(row) + 0.5) + _c(f)).alias("y")
    )


def world_to_pix(x, y, a, c, e, f, width, height) -> Column:
    """Inverse affine (corner based), clipped to the image."""
    return F.struct(
        clip((_c(y) - _c(f)) / _c(e), 0.0, _c(height) - 1.0).alias("row"),
        clip((_c(x) - _c(c)) / _c(a), 0.0, _c(width) - 1.0).alias("col"),
    )


def linear_world(row, col, width, height, west, east, south, north) -> Column:
    """Fallback georeference from bounds: ``west + col/w * span``, rows from the north."""
    return F.struct(
        (_c(west) + _c(col) / _c(width) * (_c(east) - _c(west))).alias("x"),
        (_c(north) - _c(row) / _c(height) * (_c(north) - _c(south))).alias("y"),
    )


def rescale_points(points: Column | str, src_w, src_h, dst_w, dst_h, keep_inside: bool = True) -> Column:
    """Points from one image size to another."""
    def one(p: Column) -> Column:
        x, y = p["x"] * (_c(dst_w) / _c(src_w)), p["y"] * (_c(dst_h) / _c(src_h))
        if keep_inside:
            x, y = clip(x, 0.0, _c(dst_w) - 1.0), clip(y, 0.0, _c(dst_h) - 1.0)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(_c(points), one)


def to_unit(value, low, high) -> Column:
    """Coordinate to [0,1] of a box side; span floor 1e-9."""
    u = (_c(value) - _c(low)) / F.greatest(_c(high) - _c(low), F.lit(1e-9))
    return clip(u, 0.0, 1.0)


def from_unit(u, low, high) -> Column:
    """Clip to [0,1] and spread over a box side; span floor 1e-9."""
    return _c(low) + clip(_c(u), 0.0, 1.0) * F.greatest(_c(high) - _c(low), F.lit(1e-9))


def line_to_unit(line: Column | str, bbox: Column | str) -> Column:
    b = _c(bbox)
    return F.transform(
        _c(line),
        lambda p: F.struct(to_unit(p["x"], b[0], b[2]).alias("x"), to_unit(p["y"], b[1], b[3]).alias("y")),
    )


def line_from_unit(line: Column | str, bbox: Column | str) -> Column:
    b = _c(bbox)
    return F.transform(
        _c(line),
        lambda p: F.struct(from_unit(p["x"], b[0], b[2]).alias("x"), from_unit(p["y"], b[1], b[3]).alias("y")),
    )


# --- WGS84 <-> UTM: the transverse Mercator series of Krueger to sixth order (Karney 2011) ---

# WGS84 ellipsoid and UTM constants.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_EASTING = 500000.0
UTM_NORTHING_SOUTH = 10000000.0

_N = WGS84_F / (2 - WGS84_F)
_E = math.sqrt(WGS84_F * (2 - WGS84_F))
RECTIFYING_RADIUS = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)

# numerator/denominator of the power series in the third flattening n,
# one row per harmonic, terms in ascending powers starting at n**(harmonic).
_ALPHA_TERMS = [
    [(1, 2), (-2, 3), (5, 16), (41, 180), (-127, 288), (7891, 37800)],
    [(13, 48), (-3, 5), (557, 1440), (281, 630), (-1983433, 1935360)],
    [(61, 240), (-103, 140), (15061, 26880), (167603, 181440)],
    [(49561, 161280), (-179, 168), (6601661, 7257600)],
    [(34729, 80640), (-3418889, 1995840)],
    [(212378941, 319334400)],
]
_BETA_TERMS = [
    [(1, 2), (-2, 3), (37, 96), (-1, 360), (-81, 512), (96199, 604800)],
    [(1, 48), (1, 15), (-437, 1440), (46, 105), (-1118711, 3870720)],
    [(17, 480), (-37, 840), (-209, 4480), (5569, 90720)],
    [(4397, 161280), (-11, 504), (-830251, 7257600)],
    [(4583, 161280), (-108847, 3991680)],
    [(20648693, 638668800)],
]


def _harmonics(rows) -> list[float]:
    return [sum(p / q * _N ** (j + k) for k, (p, q) in enumerate(row)) for j, row in enumerate(rows, start=1)]


ALPHA = _harmonics(_ALPHA_TERMS)
BETA = _harmonics(_BETA_TERMS)
# Series from conformal to geodetic latitude, fixed-point refined below.
_REFINE = 5


def utm_central_meridian(epsg: Column | str) -> Column:
    return F.pmod(_c(epsg), F.lit(100)) * 6.0 - 183.0


def project(df: DataFrame, lon: str, lat: str, epsg: str, x: str = "x", y: str = "y") -> DataFrame:
    """WGS84 to UTM, one point per row. Intermediate columns keep the expressions short."""
    d = df.withColumn("_phi", F.radians(lat)).withColumn("_lam", F.radians(F.col(lon) - utm_central_meridian(epsg)))
    d = d.withColumn("_sin", F.sin("_phi"))
    d = d.withColumn("_t", F.sinh(F.atanh("_sin") - _E * F.atanh(_E * F.col("_sin"))))
    d = d.withColumn("_xi", F.atan2(F.col("_t"), F.cos("_lam"))).withColumn(
        "_eta", F.asinh(F.sin("_lam") / F.sqrt(F.col("_t") * F.col("_t") + F.cos("_lam") * F.cos("_lam")))
    )
    north, east = F.col("_xi"), F.col("_eta")
    for j, a in enumerate(ALPHA, start=1):
        north = north + a * F.sin(2 * j * F.col("_xi")) * F.cosh(2 * j * F.col("_eta"))
        east = east + a * F.cos(2 * j * F.col("_xi")) * F.sinh(2 * j * F.col("_eta"))
    shift = F.when(F.col(epsg) >= 32700, UTM_NORTHING_SOUTH).otherwise(0.0)
    return (
        d.withColumn(x, UTM_EASTING + UTM_K0 * RECTIFYING_RADIUS * east)
        .withColumn(y, shift + UTM_K0 * RECTIFYING_RADIUS * north)
        .drop("_phi", "_lam", "_sin", "_t", "_xi", "_eta")
    )


def unproject(df: DataFrame, x: str, y: str, epsg: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """UTM to WGS84, one point per row."""
    shift = F.when(F.col(epsg) >= 32700, UTM_NORTHING_SOUTH).otherwise(0.0)
    scale = UTM_K0 * RECTIFYING_RADIUS
    d = df.withColumn("_xi", (F.col(y) - shift) / scale).withColumn("_eta", (F.col(x) - UTM_EASTING) / scale)
    xi, eta = F.col("_xi"), F.col("_eta")
    for j, b in enumerate(BETA, start=1):
        xi = xi - b * F.sin(2 * j * F.col("_xi")) * F.cosh(2 * j * F.col("_eta"))
        eta = eta - b * F.cos(2 * j * F.col("_xi")) * F.sinh(2 * j * F.col("_eta"))
    d = d.withColumn("_xi1", xi).withColumn("_eta1", eta)
    # isometric latitude of the conformal latitude, then geodetic latitude by fixed point
    d = d.withColumn("_q", F.asinh(F.sin("_xi1") / F.sqrt(F.sinh("_eta1") * F.sinh("_eta1") + F.cos("_xi1") * F.cos("_xi1"))))
    d = d.withColumn("_s", F.tanh("_q"))
    for _ in range(_REFINE):
        d = d.withColumn("_s", F.tanh(F.col("_q") + _E * F.atanh(_E * F.col("_s"))))
    return (
        d.withColumn(lat, F.degrees(F.asin("_s")))
        .withColumn(lon, utm_central_meridian(epsg) + F.degrees(F.atan2(F.sinh("_eta1"), F.cos("_xi1"))))
        .drop("_xi", "_eta", "_xi1", "_eta1", "_q", "_s")
    )
