"""Polygon operators: metrics, cell covers, land clipping. Exact overlays are in ``overlay``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwake.functions import geo

RECT = T.StructType([T.StructField("major_m", T.DoubleType()), T.StructField("minor_m", T.DoubleType()),
                     T.StructField("axis_deg", T.DoubleType())])


def convex_hull(xy: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by sorted half chains."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def min_rectangle(xy: np.ndarray) -> tuple[float, float, float]:
    """(long side, short side, long-axis bearing) of the smallest rectangle around points."""
    hull = convex_hull(xy)
    if len(hull) < 3:
        return 0.0, 0.0, 0.0
    edge = np.roll(hull, -1, axis=0) - hull
    theta = np.arctan2(edge[:, 1], edge[:, 0])
    c, s = np.cos(theta)[:, None], np.sin(theta)[:, None]
    u, v = hull[:, 0] * c + hull[:, 1] * s, hull[:, 1] * c - hull[:, 0] * s
    w, h = np.ptp(u, axis=1), np.ptp(v, axis=1)
    i = int(np.argmin(w * h))
    along = theta[i] if w[i] >= h[i] else theta[i] + np.pi / 2
    return float(max(w[i], h[i])), float(min(w[i], h[i])), float((90.0 - np.degrees(along)) % 180.0)


@F.pandas_udf(RECT)
def rectangle_of(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    """Smallest enclosing rectangle of each ring, given as metre coordinate arrays."""
    rows = [min_rectangle(np.column_stack([x, y])) for x, y in zip(xs, ys, strict=True)]
    return pd.DataFrame(rows, columns=["major_m", "minor_m", "axis_deg"])


def polygon_metrics(rings: DataFrame, ring: str = "ring") -> DataFrame:
    """Area, perimeter, centroid, rectangle axes, eccentricity and complexity of lon/lat rings."""
    c = geo.ring_centroid(F.col(ring))
    d = rings.withColumn("_c", c).withColumn("_m", geo.ring_to_metres(F.col(ring), F.col("_c.y"), F.col("_c.x")))
    d = d.withColumns({"area_m2": geo.ring_area(F.col("_m")), "perim_m": geo.ring_perimeter(F.col("_m")),
                       "_r": rectangle_of(F.transform("_m", lambda p: p.x), F.transform("_m", lambda p: p.y))})
    ecc = F.when(F.col("_r.major_m") > 0, F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.pow(F.col("_r.minor_m") / F.col("_r.major_m"), F.lit(2.0)))))
    return d.select(*[x for x in rings.columns if x != ring], (F.col("area_m2") / 1e6).alias("area_km2"), (F.col("perim_m") / 1000).alias("perimeter_km"),
                    F.col("_c.y").alias("centroid_lat"), F.col("_c.x").alias("centroid_lon"), F.col("_r.major_m").alias("major_axis_m"),
                    F.col("_r.minor_m").alias("minor_axis_m"), F.col("_r.axis_deg").alias("major_axis_deg"), F.coalesce(ecc, F.lit(0.0)).alias("eccentricity"),
                    F.when(F.col("area_m2") > 0, F.col("perim_m") / (2.0 * F.sqrt(F.lit(np.pi) * F.col("area_m2")))).otherwise(0.0).alias("shape_complexity"))


def cell_cover(rings: DataFrame, res: float, ring: str = "ring") -> DataFrame:
    """Grid cells whose centre lies inside each ring, as rows (cx, cy). One polygon's list is bounded by its box.

    A ring too small or thin to hold any centre is covered by the cell of its centroid, so no ring is lost.
    """
    keep = [c for c in rings.columns if c != ring]
    b = rings.select(*keep, geo.ring_bounds(F.col(ring)).alias("_b"), geo.ring_edges(F.col(ring)).alias("_e"), geo.ring_centroid(F.col(ring)).alias("_c"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / res), F.floor(F.col(hi) / res))
    cells = F.flatten(F.transform(span("_b.x0", "_b.x1"), lambda cx: F.transform(span("_b.y0", "_b.y1"), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
    b = b.withColumn("_in", F.filter(cells, lambda c: geo.point_in_edges(F.col("_e"), (c.cx + 0.5) * res, (c.cy + 0.5) * res)))
    own = F.struct(F.floor(F.coalesce("_c.x", "_b.x0") / res).alias("cx"), F.floor(F.coalesce("_c.y", "_b.y0") / res).alias("cy"))
    return b.select(*keep, F.explode(F.when(F.size("_in") > 0, F.col("_in")).otherwise(F.array(own))).alias("_p")).select(*keep, "_p.cx", "_p.cy")


def cell_area_km2(cy: Column, res: float) -> Column:
    lat = (cy + 0.5) * res
    return geo.metres_per_deg_lat(lat) * geo.metres_per_deg_lon(lat) * (res * res / 1e6)


def off_land(cover: DataFrame, land: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a cover that are not land; a cover lying wholly on land is returned unchanged."""
    tagged = cover.join(land.select("cx", "cy", F.lit(True).alias("_land")), ["cx", "cy"], "left").withColumn("_land", F.coalesce("_land", F.lit(False)))
    wet = tagged.groupBy(*keys).agg(F.count_if(~F.col("_land")).alias("_wet"))
    return tagged.join(wet, keys).filter(~F.col("_land") | (F.col("_wet") == 0)).select(*keys, "cx", "cy")


def on_land(points: DataFrame, land: DataFrame, res: float) -> DataFrame:
    """Flag points in land cells; anything outside the land grid is water."""
    p = points.withColumns({"cx": F.floor(F.col("lon") / res), "cy": F.floor(F.col("lat") / res)})
    return p.join(land.select("cx", "cy", F.lit(True).alias("on_land")), ["cx", "cy"], "left").withColumn(
        "on_land", F.coalesce("on_land", F.lit(False))).drop("cx", "cy")
