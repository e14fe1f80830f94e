"""Exact polygon overlay: intersection areas in array expressions, best detections, and the parts of a union."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwake.functions import geo
from driftwake.operators.polygons import polygon_metrics
from driftwake.session import spread


def sweep_edges(ring: Column) -> Column:
    """Edges of a ring by rising x: from (x1, y1) to x2 with slope g, and s = +1 above the inside of a counter-clockwise ring, -1 below it.
    Upright edges bound no area."""
    n = F.size(ring)

    def edge(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, (i + 1) % n)
        back = p.x > q.x
        return F.struct(F.least(p.x, q.x).alias("x1"), F.greatest(p.x, q.x).alias("x2"), F.when(back, q.y).otherwise(p.y).alias("y1"),
                        F.try_divide(q.y - p.y, q.x - p.x).alias("g"), F.signum(p.x - q.x).alias("s"))

    return F.filter(F.transform(F.sequence(F.lit(0), n - 1), edge), lambda e: e.s != 0)


def intersection_area(a: Column, b: Column, floor: Column) -> Column:
    """Common area of two simple polygons given by their ``sweep_edges``, whatever their size; negative if they wind differently.

    A polygon is the signed sum of the strips under its edges, so the common area is the signed sum of the common strips: for two
    edges that is the integral of the lower line over the x range of both. ``floor`` is any y near the polygons.
    """
    def strip(e: Column, f: Column) -> Column:
        l, r = F.greatest(e.x1, f.x1), F.least(e.x2, f.x2)
        el, er, fl, fr = (v.y1 + v.g * (x - v.x1) for v in (e, f) for x in (l, r))
        hl, hr = el - fl, er - fr
        apart = F.when(hl * hr >= 0, F.abs(hl + hr) / 2).otherwise((hl * hl + hr * hr) / (2 * (F.abs(hl) + F.abs(hr))))
        return e.s * f.s * (r - l) * ((el + er + fl + fr) / 4 - floor - apart / 2)

    def under(e: Column) -> Column:
        met = F.filter(b, lambda f: (f.x1 < e.x2) & (e.x1 < f.x2))
        return F.aggregate(met, F.lit(0.0), lambda acc, f: acc + strip(e, f))

    return F.aggregate(a, F.lit(0.0), lambda acc, e: acc + under(e))


def polygon_overlap(a: DataFrame, b: DataFrame, on: str, a_key: str, b_key: str) -> DataFrame:
    """Exact overlap of every ring of ``a`` with every ring of ``b`` that shares ``on``: inter_km2, union_km2, iou, by the local scale at the
    centroid of a's ring. Rings may wind either way; every pair keeps a row, a ring without area has iou 0."""
    def prepared(d: DataFrame, key: str, p: str) -> DataFrame:
        ring, o = F.col("ring"), F.get(F.col("ring"), F.lit(0))
        d = spread(d.select(on, key, "ring"), on)  # little data, much work: not to be gathered by bytes into few tasks
        return d.select(on, key, sweep_edges(ring).alias(f"{p}_e"), geo.ring_bounds(ring).alias(f"{p}_b"), geo.ring_area_about(ring, o).alias(f"{p}_area"), geo.ring_centroid(ring).y.alias(f"{p}_lat"))

    d = prepared(a, a_key, "a").join(prepared(b, b_key, "b"), on)
    box, other = F.col("a_b"), F.col("b_b")
    meet = (box.x0 < other.x1) & (other.x0 < box.x1) & (box.y0 < other.y1) & (other.y0 < box.y1)
    common = F.when(meet, F.abs(intersection_area(F.col("a_e"), F.col("b_e"), F.least(box.y0, other.y0)))).otherwise(0.0)
    lat = F.coalesce("a_lat", box.y0)
    scale = geo.metres_per_deg_lat(lat) * geo.metres_per_deg_lon(lat) / 1e6
    d = d.select(on, a_key, b_key, "a_area", "b_area", scale.alias("_km2"), F.least(common, F.col("a_area"), F.col("b_area")).alias("_common"))
    union = F.col("a_area") + F.col("b_area") - F.col("_common")
    return d.select(on, a_key, b_key, (F.col("_common") * F.col("_km2")).alias("inter_km2"), (union * F.col("_km2")).alias("union_km2"),
                    F.coalesce(F.try_divide(F.col("_common"), union), F.lit(0.0)).alias("iou"))


def best_detection(detections: DataFrame, reference: DataFrame) -> DataFrame:
    """Detection that overlaps each incident's reference polygon most (ties: the larger, then the lesser id), with the deltas.

    ``detections`` (incident_id, slick_id, ring) and ``reference`` (incident_id, ring, one each). Areas, long-axis bearings and
    centroids of both, iou, centroid offset and angle between the axes. Without any detection the reference keeps its row.
    """
    ref = polygon_metrics(spread(reference.select("incident_id", "ring"), "incident_id")).select(
        "incident_id", F.col("area_km2").alias("planted_area_km2"), F.col("major_axis_deg").alias("planted_axis_deg"), F.col("centroid_lat").alias("_lat"), F.col("centroid_lon").alias("_lon"))
    # only the winner is measured, so each reference meets a handful of overlaps and one rectangle
    over = polygon_overlap(reference.withColumn("_one", F.lit(0)), detections, "incident_id", "_one", "slick_id")
    area = detections.select("incident_id", "slick_id", "ring", geo.ring_area(F.col("ring")).alias("_area"))
    won = over.join(area, ["incident_id", "slick_id"]).groupBy("incident_id").agg(F.max(F.struct("iou", "_area", (-F.col("slick_id")).alias("k"), "ring")).alias("w"), F.count(F.lit(1)).alias("n_detections"))
    best = polygon_metrics(spread(won, "incident_id").select("incident_id", (-F.col("w.k")).alias("slick_id"), F.col("w.iou").alias("iou"), "n_detections", F.col("w.ring").alias("ring")))
    d = ref.join(best, "incident_id", "left")
    mid = (F.col("_lat") + F.col("centroid_lat")) / 2
    offset = F.hypot((F.col("centroid_lon") - F.col("_lon")) * geo.metres_per_deg_lon(mid), (F.col("centroid_lat") - F.col("_lat")) * geo.metres_per_deg_lat(mid)) / 1000
    return d.select("incident_id", F.coalesce("n_detections", F.lit(0)).alias("n_detections"), "slick_id", "iou", "planted_area_km2", F.col("area_km2").alias("best_area_km2"), "planted_axis_deg",
                    F.col("major_axis_deg").alias("best_axis_deg"), offset.alias("centroid_offset_km"), (F.col("area_km2") - F.col("planted_area_km2")).alias("area_delta_km2"),
                    geo.angular_delta(F.col("major_axis_deg"), F.col("planted_axis_deg")).alias("axis_delta_deg"))


def part_areas(rings: list[np.ndarray]) -> np.ndarray:
    """Areas of the connected parts of the union of simple rings (arrays of x, y), largest first; holes are left out.

    The plane is cut at every vertex and crossing; in such a slab no edges cross, so the union is a stack of trapezoids. Trapezoids of
    neighbouring slabs are one part where their common upright has some length.
    """
    a, b, sign = [], [], []
    for xy in rings:
        nxt = np.roll(xy, -1, axis=0)
        turn = np.sign(np.sum(xy[:, 0] * nxt[:, 1] - nxt[:, 0] * xy[:, 1]))
        use = (xy[:, 0] != nxt[:, 0]) & (turn != 0)
        back = xy[use, 0] > nxt[use, 0]
        a.append(np.where(back[:, None], nxt[use], xy[use]))
        b.append(np.where(back[:, None], xy[use], nxt[use]))
        sign.append(np.where(back, -1, 1) * turn)  # +1 where the inside lies above
    a, b, sign = np.concatenate(a), np.concatenate(b), np.concatenate(sign).astype(int)
    if not len(a):
        return np.zeros(0)
    order = np.argsort(-sign, kind="stable")  # where two edges coincide the opening one comes first, so touching rings join
    a, b, sign = a[order], b[order], sign[order]
    g = (b[:, 1] - a[:, 1]) / (b[:, 0] - a[:, 0])
    xs = [a[:, 0], b[:, 0]]
    for i in range(len(a)):  # crossings of edge i with later ones
        d = g[i] - g[i + 1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (a[i + 1:, 1] - g[i + 1:] * a[i + 1:, 0] - a[i, 1] + g[i] * a[i, 0]) / d
        xs.append(x[(x > np.maximum(a[i, 0], a[i + 1:, 0])) & (x < np.minimum(b[i, 0], b[i + 1:, 0]))])
    x = np.unique(np.concatenate(xs))
    size = max(np.ptp(x), np.ptp(np.concatenate([a[:, 1], b[:, 1]])))
    tiny = 1e-11 * size
    x = x[np.concatenate([[True], np.diff(x) > tiny])]
    mids = (x[:-1] + x[1:]) / 2
    first, last = np.searchsorted(mids, a[:, 0]), np.searchsorted(mids, b[:, 0])
    edge = np.repeat(np.arange(len(a)), last - first)  # one entry for each edge and slab that it spans
    slab = np.arange(len(edge)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[edge]
    at = lambda e, v: a[e, 1] + g[e] * (v - a[e, 0])
    y = np.round(at(edge, mids[slab]) / tiny)
    order = np.lexsort((edge, y, slab))
    edge, slab = edge[order], slab[order]
    depth = np.cumsum(sign[edge])  # every slab's signs add up to 0
    opens, shuts = (depth > 0) & (depth == sign[edge]), (depth == 0) & (sign[edge] < 0)
    low, high, slab = edge[opens], edge[shuts], slab[opens]
    area = (at(high, mids[slab]) - at(low, mids[slab])) * (x[slab + 1] - x[slab])
    ends = [at(e, x[slab + k]).tolist() for k in (0, 1) for e in (low, high)]
    root = list(range(len(area)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    before, now, here = [], [], -1
    for i, (k, p, q, r, t) in enumerate(zip(slab.tolist(), *ends, strict=True)):
        if k != here:
            before, now, here = now if k == here + 1 else [], [], k
        now.append((r, t, i))
        for p0, q0, j in before:
            if min(q, q0) - max(p, p0) > tiny:
                root[find(j)] = find(i)
    total = np.zeros(len(area))
    np.add.at(total, [find(i) for i in range(len(area))], area)
    return np.sort(total[total > 0])[::-1]


def union_parts(rings: DataFrame, key: str = "incident_id") -> DataFrame:
    """Union of the rings of each key: n_rings, n_parts, and area_km2 of its largest part (the local scale at the union's middle).

    One key's rings (the steps of one incident) are one group, bounded by the steps and vertices of an incident; equal rings count once.
    A key whose rings have no area keeps its row with no parts.
    """
    kind = dict(rings.dtypes)[key]

    def largest(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = [np.array([(p["x"], p["y"]) for p in r]) for r in pdf["ring"]]
        every = np.concatenate(xy)
        parts = part_areas(list({r.tobytes(): r for r in xy}.values()))
        lat = (every[:, 1].min() + every[:, 1].max()) / 2
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n_rings": [len(xy)], "n_parts": [len(parts)], "lat": [lat], "area": [float(parts[0]) if len(parts) else 0.0]})

    d = spread(rings.select(key, F.transform("ring", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("ring")), key)
    d = d.groupBy(key).applyInPandas(largest, f"{key} {kind}, n_rings long, n_parts long, lat double, area double")
    scale = geo.metres_per_deg_lat(F.col("lat")) * geo.metres_per_deg_lon(F.col("lat")) / 1e6
    return d.select(key, "n_rings", "n_parts", (F.col("area") * scale).alias("area_km2"))
