"""Exact overlay and shore distance against plain geometry: small, touching, nested and concave polygons, islands, limits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwake.operators import overlay, shore

RING = "ring array<struct<x:double,y:double>>"
EDGE = "incident_id long, hours_back long, x1 double, y1 double, x2 double, y2 double"
SEG = "seg_id long, x1 double, y1 double, x2 double, y2 double"


def square(x, y, w=1.0, h=1.0):
    return [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]


def blob(x, y, r, n=24, turn=0.0, squash=1.0):
    a = np.radians(np.arange(n) * 360 / n)
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    u, v = r * np.cos(a), squash * r * np.sin(a)
    return [(float(x + p * c - q * s), float(y + p * s + q * c)) for p, q in zip(u, v, strict=True)]


def area(ring):
    x, y = np.array(ring).T
    return abs(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y)) / 2


def clipped(a, b):
    """Convex clip of a by b (both counter-clockwise), edge by edge."""
    out = a
    for (x1, y1), (x2, y2) in zip(b, b[1:] + b[:1], strict=True):
        side = lambda p: (x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1)  # noqa: B023, E731
        new = []
        for p, q in zip(out, out[1:] + out[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                new.append(p)
            if (sp >= 0) != (sq >= 0):
                t = sp / (sp - sq)
                new.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = new
        if not out:
            return 0.0
    return area(out)


def overlaps(spark, pairs):
    a = spark.createDataFrame([(i, 0, p) for i, (p, _) in enumerate(pairs)], "incident_id long, a long, " + RING)
    b = spark.createDataFrame([(i, 0, q) for i, (_, q) in enumerate(pairs)], "incident_id long, b long, " + RING)
    return {r.incident_id: r for r in overlay.polygon_overlap(a, b, "incident_id", "a", "b").collect()}


def test_iou_is_exact_whatever_the_size(spark):
    small = blob(70.123456, 15.654321, 0.0036, n=36, squash=0.3)  # about 800 m long
    ell = [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)]
    pairs = [(small, small), (small, small[::-1]), (small, [(x + 0.5, y) for x, y in small]), (square(0, 0), square(0.5, 0)), (square(0, 0), square(1, 0)), (square(0, 0), square(0, 1)),
             (square(0, 0, 4, 4), square(1, 1)), (ell, square(0.5, 0.5, 2, 2)), ([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], square(0, 0)), (square(0, 0), [(0.0, 0.0), (1.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])]
    got = overlaps(spark, pairs)
    want = [1, 1, 0, 1 / 3, 0, 0, 1 / 16, (0.5 * 2 + 1.5 * 0.5) / (5 + 4 - 1.75), 0, 1]
    assert [got[i].iou for i in range(len(pairs))] == pytest.approx(want, abs=1e-9)
    assert got[0].inter_km2 == pytest.approx(area(small) * 111.32 * math.cos(math.radians(15.65)) * 110.65, rel=2e-3) and got[0].inter_km2 == got[0].union_km2


def test_iou_of_convex_pairs_equals_clipping(spark):
    rng = np.random.default_rng(4)
    pairs = [tuple(blob(70 + rng.uniform(0, 0.3), 15 + rng.uniform(0, 0.3), rng.uniform(0.02, 0.3), int(rng.integers(3, 40)), rng.uniform(0, 360), rng.uniform(0.1, 1)) for _ in range(2)) for _ in range(120)]
    got = overlaps(spark, pairs)
    for i, (a, b) in enumerate(pairs):
        inter = clipped(a, b)
        assert got[i].iou == pytest.approx(inter / (area(a) + area(b) - inter), abs=1e-9)


def test_best_detection_breaks_ties_and_keeps_lone_references(spark):
    det = spark.createDataFrame([(1, 1, square(0, 0)), (1, 2, square(0.2, 0)), (1, 3, square(5, 5)), (2, 4, square(9, 9, 2, 1)), (2, 5, square(9, 20)), (2, 6, square(30, 9, 2, 1))], "incident_id long, slick_id long, " + RING)
    ref = spark.createDataFrame([(1, square(0.2, 0.1)), (2, square(0, 0)), (3, square(0, 0))], "incident_id long, " + RING)
    got = {r.incident_id: r for r in overlay.best_detection(det, ref).collect()}
    assert (got[1].slick_id, got[1].n_detections) == (2, 3) and got[1].iou == pytest.approx(0.9 / 1.1)
    assert got[1].centroid_offset_km == pytest.approx(0.1 * 110.574, rel=1e-3)
    assert (got[2].slick_id, got[2].iou) == (4, 0.0)  # none overlaps: the largest, then the lesser id
    assert (got[3].slick_id, got[3].n_detections, got[3].best_area_km2) == (None, 0, None)


@pytest.mark.parametrize("rings,want", [
    ([square(0, 0)], [1]), ([square(0, 0)] * 3, [1]), ([square(0, 0), square(0, 0)[::-1]], [1]), ([square(0, 0), square(1, 0)], [2]), ([square(0, 0), square(0, 1)], [2]),
    ([square(0, 0), square(1, 1)], [1, 1]), ([square(0, 0), square(5, 5, 3, 3), square(0.5, 0.5)], [9, 1.75]), ([square(0, 0, 4, 4), square(1, 1)], [16]),
    ([square(0, 0, 3, 1), square(0, 2, 3, 1), square(0, 0, 1, 3), square(2, 0, 1, 3), square(1.4, 1.4, 0.2, 0.2)], [8, 0.04]), ([[(0, 0), (1, 1), (2, 2)]], [])])
def test_parts_of_unions(rings, want):
    assert overlay.part_areas([np.array(r, float) for r in rings]) == pytest.approx(np.array(want, float), abs=1e-9)


def test_parts_equal_a_fine_grid():
    rng = np.random.default_rng(8)
    rings = [np.array(blob(rng.uniform(0, 1), rng.uniform(0, 1), rng.uniform(0.05, 0.25), int(rng.integers(3, 30)), rng.uniform(0, 360), rng.uniform(0.3, 1))) for _ in range(12)]
    g = (np.arange(1000) + 0.5) / 1000 * 1.6 - 0.3
    x, y = np.meshgrid(g, g)
    hit = np.zeros(x.shape, bool)
    for r in rings:
        inside = np.zeros(x.shape, bool)
        for (x1, y1), (x2, y2) in zip(r, np.roll(r, -1, axis=0), strict=True):
            if y1 != y2:
                inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        hit |= inside
    assert overlay.part_areas(rings).sum() == pytest.approx(hit.mean() * 1.6**2, rel=2e-3)


def test_union_keeps_every_incident(spark):
    d = spark.createDataFrame([(1, square(0, 0)), (1, square(0.5, 0)), (1, square(5, 5, 1, 2)), (2, [(0.0, 0.0), (1.0, 1.0)]), (3, blob(70.0, 15.0, 0.002))], "incident_id long, " + RING)
    got = {r.incident_id: r for r in overlay.union_parts(d).collect()}
    assert (got[1].n_rings, got[1].n_parts) == (3, 2) and got[1].area_km2 == pytest.approx(2 * 111.19 * 111.0, rel=2e-2)
    assert (got[2].n_parts, got[2].area_km2) == (0, 0.0) and got[3].area_km2 > 0


def plain_distance(ring, segs):
    """Kilometres between a ring and segments in the ring's local metres; 0 where they cross or a segment lies inside."""
    from driftwake.functions.geo import WGS84_A, WGS84_E2

    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    mx, my = (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2
    s2 = math.sin(math.radians(my)) ** 2
    kx, ky = WGS84_A * math.radians(1) * math.cos(math.radians(my)) / math.sqrt(1 - WGS84_E2 * s2), WGS84_A * (1 - WGS84_E2) * math.radians(1) / (1 - WGS84_E2 * s2) ** 1.5
    m = lambda x, y: ((x - mx) * kx, (y - my) * ky)
    pts = [m(*p) for p in ring]
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def to_segment(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0.0
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    best = math.inf
    for x1, y1, x2, y2 in segs:
        c, d = m(x1, y1), m(x2, y2)
        inside = False
        for a, b in zip(pts, pts[1:] + pts[:1], strict=True):
            if (a[1] > c[1]) != (b[1] > c[1]) and c[0] < (b[0] - a[0]) * (c[1] - a[1]) / (b[1] - a[1]) + a[0]:
                inside = not inside
            if (cross(a, b, c) > 0) != (cross(a, b, d) > 0) and (cross(c, d, a) > 0) != (cross(c, d, b) > 0):
                return 0.0
            best = min(best, to_segment(a, c, d), to_segment(b, c, d), to_segment(c, a, b), to_segment(d, a, b))
        if inside:
            return 0.0
    return best / 1000


def edges_of(spark, rings):
    return spark.createDataFrame([(i, 1, *p, *q) for i, r in enumerate(rings) for p, q in zip(r, r[1:] + r[:1], strict=True)], EDGE)


def test_coast_distance_equals_every_pair(spark):
    rng = np.random.default_rng(12)
    rings = [blob(rng.uniform(68, 74), rng.uniform(14, 19), rng.choice([0.002, 0.05, 0.4, 1.5]), int(rng.integers(3, 25)), rng.uniform(0, 360), rng.uniform(0.2, 1)) for _ in range(40)]
    line = [(72 + 0.5 * math.sin(y), y) for y in np.linspace(14, 19, 260)]
    segs = [(*a, *b) for a, b in zip(line, line[1:], strict=False)]
    for _ in range(30):  # islands of a few hundred metres
        isle = blob(rng.uniform(68, 71), rng.uniform(14, 19), 0.003, 5)
        segs += [(*a, *b) for a, b in zip(isle, isle[1:] + isle[:1], strict=True)]
    got = {r.incident_id: r for r in shore.coast_distance(edges_of(spark, rings), spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(segs)], SEG)).collect()}
    for i, r in enumerate(rings):
        want = plain_distance(r, segs)
        assert got[i].distance_km == pytest.approx(want, abs=1e-6) and got[i].intersects == (want == 0.0) and got[i].covered


def test_island_inside_and_no_shore_in_reach(spark):
    isle = [(0, 70.5, 15.5, 70.501, 15.5), (1, 70.501, 15.5, 70.5, 15.501), (2, 70.5, 15.501, 70.5, 15.5)]
    coast = spark.createDataFrame(isle, SEG)
    rings = [square(70, 15), square(70.6, 15), square(100, -40), [(70.0, 15.0), (71.0, 15.0), (71.0, 16.0), (70.505, 15.51), (70.505, 15.49), (70.49, 15.49), (70.49, 15.51), (70.5, 15.52), (70.0, 16.0)]]
    got = {r.incident_id: r for r in shore.coast_distance(edges_of(spark, rings), coast).collect()}
    assert (got[0].distance_km, got[0].intersects) == (0.0, True)  # the whole island lies inside, no border is crossed
    assert got[1].distance_km == pytest.approx(10.6, rel=0.02) and not got[1].intersects
    assert (got[2].distance_km, got[2].covered, got[2].intersects) == (None, False, False)
    assert got[3].distance_km == pytest.approx(plain_distance(rings[3], [s[1:] for s in isle]), abs=1e-6)
    assert shore.coast_distance(edges_of(spark, rings), coast.limit(0)).filter(F.col("covered")).count() == 0
