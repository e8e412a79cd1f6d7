"""Geographic expressions: distances, areas, projections, tiles and grids."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
# WGS84 ellipsoid
_A = 6378137.0
_FL = 1 / 298.257223563
_N = _FL / (2 - _FL)
_E2 = _FL * (2 - _FL)
_K0 = 0.9996

Num = Column | float | int


def c(x: Num | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def bbox_area_km2(west, south, east, north, kx: float = 111.32, ky: float = 110.574) -> Column:
    """F1. Box area with a fixed number of km per degree at the middle latitude."""
    west, south, east, north = map(c, (west, south, east, north))
    mid = F.radians((north + south) / 2)
    return F.abs(east - west) * kx * F.cos(mid) * F.abs(north - south) * ky


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_KM) -> Column:
    """F2. Great-circle distance, arcsine form."""
    lat1, lon1, lat2, lon2 = map(c, (lat1, lon1, lat2, lon2))
    h = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def great_circle_km(lat1, lon1, lat2, lon2, radius: float = 6371.0) -> Column:
    """F4. Great-circle distance, two-argument arctangent form, whole km."""
    lat1, lon1, lat2, lon2 = map(c, (lat1, lon1, lat2, lon2))
    h = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return F.round(2 * radius * F.atan2(F.sqrt(h), F.sqrt(1 - h)))


def bbox_intersects(a: tuple, b: tuple) -> Column:
    """B2. Closed boxes ``(west, south, east, north)`` share a point."""
    aw, as_, ae, an = map(c, a)
    bw, bs, be, bn = map(c, b)
    return (ae >= bw) & (aw <= be) & (an >= bs) & (as_ <= bn)


def bbox_contains(outer: tuple, inner: tuple) -> Column:
    """B3. ``inner`` lies wholly in ``outer``."""
    ow, os_, oe, on = map(c, outer)
    iw, is_, ie, in_ = map(c, inner)
    return (iw >= ow) & (ie <= oe) & (is_ >= os_) & (in_ <= on)


def bbox_ring(west, south, east, north) -> Column:
    """A12. The closed ring of a box, counter-clockwise from the lower left."""
    w, s, e, n = map(c, (west, south, east, north))
    return F.array(*[F.array(x, y) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))])


def utm_zone(lon) -> Column:
    lon = c(lon)
    return F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6).cast("int") + 1))


def _series(n: float, rows: tuple) -> list[float]:
    return [sum(k * n ** (i + j) for j, k in enumerate(row)) for i, row in enumerate(rows, 1)]


# Krueger series to fourth order in the third flattening (published by Karney, 2011)
_ALPHA = _series(_N, ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440),
                      (61 / 240, -103 / 140), (49561 / 161280,)))
_BETA = _series(_N, ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440),
                     (17 / 480, -37 / 840), (4397 / 161280,)))
_DELTA = _series(_N, ((2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45),
                      (56 / 15, -136 / 35), (4279 / 630,)))
_RECT = _A / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64)


def _total(cols: list[Column]) -> Column:
    out = cols[0]
    for x in cols[1:]:
        out = out + x
    return out


def to_utm(lon, lat, zone=None) -> Column:
    """E4. Longitude and latitude to UTM ``struct(x, y, zone, south)``.

    The zone is that of the longitude unless one is given, as when a whole
    area is pinned to one zone; south is that of the latitude.
    """
    lon, lat = c(lon), c(lat)
    zone = utm_zone(lon) if zone is None else c(zone)
    phi = F.radians(lat)
    dlam = F.radians(lon - (zone * 6 - 183))
    ecc = _E2 ** 0.5
    t = F.sinh(F.atanh(F.sin(phi)) - ecc * F.atanh(ecc * F.sin(phi)))
    xi = F.atan2(t, F.cos(dlam))
    eta = F.asinh(F.sin(dlam) / F.sqrt(t * t + F.cos(dlam) * F.cos(dlam)))
    x = eta + _total([a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1)])
    y = xi + _total([a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1)])
    south = lat < 0
    return F.struct(
        (500000 + _K0 * _RECT * x).alias("x"),
        (_K0 * _RECT * y + F.when(south, 1e7).otherwise(0.0)).alias("y"),
        zone.alias("zone"), south.alias("south"),
    )


def from_utm(x, y, zone, south) -> Column:
    """E4. UTM back to ``struct(lon, lat)``."""
    x, y, zone, south = map(c, (x, y, zone, south))
    xi = (y - F.when(south, 1e7).otherwise(0.0)) / (_K0 * _RECT)
    eta = (x - 500000) / (_K0 * _RECT)
    xi1 = xi - _total([b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1)])
    eta1 = eta - _total([b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_BETA, 1)])
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi + _total([d * F.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1)])
    lon = zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))
    return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))


def to_mercator(lon, lat) -> Column:
    """E4. Spherical web Mercator ``struct(x, y)`` in metres."""
    return F.struct((F.radians(c(lon)) * _A).alias("x"),
                    (F.log(F.tan(pi / 4 + F.radians(c(lat)) / 2)) * _A).alias("y"))


def reproject_bbox(west, south, east, north, zone) -> Column:
    """E4. A box in the given UTM zone: the extremes of its four corners."""
    pts = [to_utm(x, y, zone) for x in (west, east) for y in (south, north)]
    xs, ys = [p["x"] for p in pts], [p["y"] for p in pts]
    return F.struct(F.least(*xs).alias("x_min"), F.least(*ys).alias("y_min"),
                    F.greatest(*xs).alias("x_max"), F.greatest(*ys).alias("y_max"))


def authalic_sin(lat) -> Column:
    """Sine of the authalic latitude, for areas on the ellipsoid."""
    s = F.sin(F.radians(c(lat)))
    ecc = _E2 ** 0.5

    def q(x: Column | float) -> Column:
        x = c(x)
        return (1 - _E2) * (x / (1 - _E2 * x * x) + F.atanh(ecc * x) / ecc)

    return q(s) / q(1.0)


AUTHALIC_RADIUS_M = 6371007.1809


def authalic_edge_m2(lon1, lat1, lon2, lat2) -> Column:
    """F6. Signed area between an edge and the equator; a ring's edges sum to its area."""
    return (F.radians(c(lon2) - c(lon1)) * (authalic_sin(lat1) + authalic_sin(lat2)) / 2
            * AUTHALIC_RADIUS_M ** 2)


def tile_bounds(z, x, y) -> Column:
    """E8. Web-Mercator tile to its box in degrees."""
    z, x, y = map(c, (z, x, y))
    n = F.pow(F.lit(2.0), z)

    def lat(row: Column) -> Column:
        return F.degrees(F.atan(F.sinh(pi * (1 - 2 * row / n))))

    return F.struct((x / n * 360 - 180).alias("west"), lat(y + 1).alias("south"),
                    ((x + 1) / n * 360 - 180).alias("east"), lat(y).alias("north"))


def lonlat_to_tile(lon, lat, z, px: int = 256) -> Column:
    """E9. Tile of a point and the pixel inside it."""
    lon, lat, z = map(c, (lon, lat, z))
    n = F.pow(F.lit(2.0), z)
    fx = (lon + 180) / 360 * n
    rad = F.radians(lat)
    fy = (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / pi) / 2 * n
    x, y = F.floor(fx), F.floor(fy)
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"),
                    F.floor((fx - x) * px).cast("int").alias("px"),
                    F.floor((fy - y) * px).cast("int").alias("py"))


def tile_positions(dim, tile: int, overlap: float) -> Column:
    """E1. Tile starts along one axis, with a last tile flush to the edge."""
    dim = c(dim)
    stride = int(tile * (1 - overlap))
    steps = F.sequence(F.lit(0), F.greatest(dim - tile, F.lit(0)), F.lit(stride))
    return F.when(dim <= tile, F.array(F.lit(0))).otherwise(F.array_union(steps, F.array(dim - tile)))


def window_weight(y, x, size: int) -> Column:
    """F19. Cosine falloff from the tile centre, clipped to [0.1, 1]."""
    def axis(i) -> Column:
        return F.cos((c(i) * 2 / (size - 1) - 1) * pi / 2)

    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), axis(y) * axis(x)))


def lonlat_to_rc(lon, lat, west, north, dx, dy, height, width) -> Column:
    """E5. Inverse affine: nearest row and column, clamped, with an ``outside`` flag."""
    lon, lat, west, north, dx, dy, height, width = map(c, (lon, lat, west, north, dx, dy, height, width))
    col = F.bround((lon - west) / dx).cast("int")
    row = F.bround((north - lat) / dy).cast("int")
    outside = (col < 0) | (col >= width) | (row < 0) | (row >= height)

    def clamp(v: Column, n: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0)), n - 1).cast("int")

    return F.struct(clamp(row, height).alias("r"), clamp(col, width).alias("c"), outside.alias("outside"))
