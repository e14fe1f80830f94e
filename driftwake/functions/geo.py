"""Geodesy and planar geometry as pure column expressions (stay inside the JVM)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and the mean earth radius used for great-circle ranges.
WGS84_A = 6378137.0
WGS84_E2 = 0.00669437999014
EARTH_RADIUS_KM = 6371.0088
KN_TO_MS = 0.514444
COMPASS_POINTS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
                  "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def metres_per_deg_lat(lat: Column) -> Column:
    """Meridian arc length of one degree at a latitude."""
    s = F.sin(F.radians(lat))
    return F.lit(WGS84_A * (1.0 - WGS84_E2) * math.pi / 180.0) / F.pow(1.0 - WGS84_E2 * s * s, F.lit(1.5))


def metres_per_deg_lon(lat: Column) -> Column:
    """Parallel arc length of one degree at a latitude."""
    s = F.sin(F.radians(lat))
    return F.lit(WGS84_A * math.pi / 180.0) * F.cos(F.radians(lat)) / F.sqrt(1.0 - WGS84_E2 * s * s)


def local_x(lon: Column, lat0: Column, lon0: Column) -> Column:
    return (lon - lon0) * metres_per_deg_lon(lat0)


def local_y(lat: Column, lat0: Column) -> Column:
    return (lat - lat0) * metres_per_deg_lat(lat0)


def segment_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres with the radii taken at the mid latitude of the pair, the short way round the antimeridian."""
    mid, d = (lat1 + lat2) / 2.0, lon2 - lon1
    d = F.when(F.abs(d) > 180.0, d - 360.0 * F.signum(d)).otherwise(d)
    return F.hypot(d * metres_per_deg_lon(mid), (lat2 - lat1) * metres_per_deg_lat(mid))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cos1: Column | None = None, cos2: Column | None = None) -> Column:
    """Great-circle range; ``cos1`` and ``cos2`` are the cosines of the latitudes where they are at hand."""
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    cos1, cos2 = (F.cos(F.radians(v)) if c is None else c for v, c in ((lat1, cos1), (lat2, cos2)))
    a = F.pow(F.sin(dp / 2), F.lit(2.0)) + cos1 * cos2 * F.pow(F.sin(dl / 2), F.lit(2.0))
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cos2: Column | None = None) -> Column:
    """Initial great-circle bearing in [0, 360); ``cos2`` is the cosine of the second latitude where it is at hand."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    cos2 = F.cos(p2) if cos2 is None else cos2
    y = F.sin(dl) * cos2
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * cos2 * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def compass(deg: Column) -> Column:
    points = F.array(*[F.lit(p) for p in COMPASS_POINTS])
    return F.element_at(points, (F.floor(deg / 22.5 + 0.5) % 16).cast("int") + 1)


def dms(value: Column, is_lat: bool) -> Column:
    """Degrees and decimal minutes with hemisphere letter."""
    letter = F.when(value >= 0, F.lit("N" if is_lat else "E")).otherwise(F.lit("S" if is_lat else "W"))
    a = F.abs(value)
    d = F.floor(a)
    return F.format_string("%02d°%05.2f'%s", d, (a - d) * 60.0, letter)


def angular_delta(a: Column, b: Column) -> Column:
    """Smallest angle between two undirected axes, [0, 90]."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def angle_deviation(a: Column, b: Column) -> Column:
    """Smallest angle between two headings, [0, 180]."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def rotate_cw(u: Column, v: Column, deg: float) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
    return u * c + v * s, v * c - u * s


def mean_course(course: Column) -> Column:
    """Circular mean of a group (aggregate expression); null inputs are skipped."""
    r = F.radians(course)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), F.lit(360.0))


def grid_cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def _closed(ring: Column, fn) -> Column:
    """Fold fn(point, next_point) over the edges of an open ring."""
    n = F.size(ring)
    return F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0.0),
        lambda acc, i: acc + fn(F.get(ring, i), F.get(ring, (i + 1) % n)))


def ring_signed_area(ring: Column) -> Column:
    return _closed(ring, lambda p, q: p.x * q.y - q.x * p.y) / 2.0


def ring_area(ring: Column) -> Column:
    return F.abs(ring_signed_area(ring))


def ring_area_about(ring: Column, o: Column) -> Column:
    """Area from coordinates relative to a point near the ring, which keeps small rings well conditioned."""
    return F.abs(_closed(ring, lambda p, q: (p.x - o.x) * (q.y - o.y) - (q.x - o.x) * (p.y - o.y))) / 2.0


def ring_perimeter(ring: Column) -> Column:
    return _closed(ring, lambda p, q: F.hypot(q.x - p.x, q.y - p.y))


def ring_centroid(ring: Column) -> Column:
    """Area centroid; coordinates are taken relative to the first vertex to keep the sums well conditioned."""
    o = F.get(ring, F.lit(0))

    def twice_area(p, q):
        return (p.x - o.x) * (q.y - o.y) - (q.x - o.x) * (p.y - o.y)

    a = _closed(ring, twice_area) * 3.0
    cx = _closed(ring, lambda p, q: (p.x + q.x - 2.0 * o.x) * twice_area(p, q))
    cy = _closed(ring, lambda p, q: (p.y + q.y - 2.0 * o.y) * twice_area(p, q))
    return F.struct((o.x + F.try_divide(cx, a)).alias("x"), (o.y + F.try_divide(cy, a)).alias("y"))


def ring_bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def ring_to_metres(ring: Column, lat0: Column, lon0: Column) -> Column:
    kx, ky = metres_per_deg_lon(lat0), metres_per_deg_lat(lat0)
    return F.transform(ring, lambda p: F.struct(((p.x - lon0) * kx).alias("x"), ((p.y - lat0) * ky).alias("y")))


def point_in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Ray cast by crossing parity. Callers put a bounding-box conjunct beside it."""
    n = F.size(ring)

    def crosses(acc, i):
        p, q = F.get(ring, i), F.get(ring, (i + 1) % n)
        hit = ((p.y > y) != (q.y > y)) & (x < (q.x - p.x) * (y - p.y) / (q.y - p.y) + p.x)
        return acc + F.when(hit, 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), crosses) % 2 == 1


def ring_edges(ring: Column) -> Column:
    """Edges of a ring as structs, built once per polygon so that repeated tests read plain fields."""
    return F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1)), lambda p, q: F.struct(
        p.x.alias("x1"), p.y.alias("y1"), q.y.alias("y2"), ((q.x - p.x) / F.nullif(q.y - p.y, F.lit(0.0))).alias("g")))


def point_in_edges(edges: Column, x: Column, y: Column) -> Column:
    """Crossing parity over edges from ``ring_edges``; level edges never cross."""
    hits = F.filter(edges, lambda e: ((e.y1 > y) != (e.y2 > y)) & (x < e.g * (y - e.y1) + e.x1))
    return F.size(hits) % 2 == 1


def utm_to_wgs84(easting: Column, northing: Column, zone: Column) -> Column:
    """Inverse UTM (northern hemisphere) by the usual series expansion; struct<lat,lon>."""
    e2, a, k0 = WGS84_E2, WGS84_A, 0.9996
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = northing / k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    phi = (mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu)
           + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
           + (151 * e1**3 / 96) * F.sin(6 * mu))
    s, c, t = F.sin(phi), F.cos(phi), F.pow(F.tan(phi), F.lit(2.0))
    cc = ep2 * c * c
    w = 1 - e2 * s * s
    n, r = a / F.sqrt(w), a * (1 - e2) / F.pow(w, F.lit(1.5))
    d = (easting - 500000.0) / (n * k0)
    lat = phi - (n * F.tan(phi) / r) * (
        d * d / 2 - (5 + 3 * t + 10 * cc - 4 * cc * cc - 9 * ep2) * F.pow(d, F.lit(4.0)) / 24
        + (61 + 90 * t + 298 * cc + 45 * t * t - 252 * ep2 - 3 * cc * cc) * F.pow(d, F.lit(6.0)) / 720)
    lon = (d - (1 + 2 * t + cc) * F.pow(d, F.lit(3.0)) / 6
           + (5 - 2 * cc + 28 * t - 3 * cc * cc + 8 * ep2 + 24 * t * t) * F.pow(d, F.lit(5.0)) / 120) / c
    return F.struct(F.degrees(lat).alias("lat"), (F.degrees(lon) + zone * 6.0 - 183.0).alias("lon"))
