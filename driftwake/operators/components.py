"""Connected components of pixel masks of any size, and shape statistics of the regions.

Tiles label their own pixels in parallel; touching labels across tile borders form a small graph whose
components come from repeated min-label exchange (large-star / small-star, Kiveris et al. 2014).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.operators.raster import PIXEL
from driftwake.session import checkpoint

STEPS = {4: ((0, 1), (1, 0)), 8: ((0, 1), (1, 0), (1, 1), (1, -1))}


def _label_tile(rows: np.ndarray, cols: np.ndarray, ids: np.ndarray, connectivity: int) -> np.ndarray:
    """Smallest pixel id of each pixel's component within a tile, by sweeping minima until stable."""
    r, c = rows - rows.min() + 1, cols - cols.min() + 1
    big = np.iinfo(np.int64).max
    grid = np.full((r.max() + 2, c.max() + 2), big, dtype=np.int64)
    grid[r, c] = ids
    on = grid < big
    while True:
        new = grid.copy()
        for dy, dx in STEPS[connectivity]:
            for sy, sx in ((dy, dx), (-dy, -dx)):
                new = np.minimum(new, np.roll(grid, (sy, sx), axis=(0, 1)))
        new[~on] = big
        if np.array_equal(new, grid):
            return grid[r, c]
        grid = new


def resolve_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge table (a, b), root being the smallest reachable node."""
    e = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(low, "a")
        e = (small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        e = checkpoint(e)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def label(mask: DataFrame, connectivity: int = 8, tile: int = 256, width: int = 1 << 24) -> DataFrame:
    """Component label of every set pixel of (scene_id, row_id, col_id): the smallest row*width+col in it."""
    p = mask.select(*PIXEL).withColumns({"pid": F.col("row_id") * width + F.col("col_id"),
                                         "ty": F.floor(F.col("row_id") / tile), "tx": F.floor(F.col("col_id") / tile)})

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        lab = _label_tile(pdf["row_id"].to_numpy(), pdf["col_id"].to_numpy(), pdf["pid"].to_numpy(), connectivity)
        return pd.DataFrame({"scene_id": pdf["scene_id"], "row_id": pdf["row_id"], "col_id": pdf["col_id"], "local": lab})

    lab = checkpoint(p.groupBy("scene_id", "ty", "tx").applyInPandas(
        local, "scene_id long, row_id long, col_id long, local long"))
    at_border = ((F.col("row_id") % tile).isin(0, tile - 1)) | ((F.col("col_id") % tile).isin(0, tile - 1))
    rim = lab.filter(at_border)
    moves = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in STEPS[connectivity]]))
    reach = rim.withColumn("s", moves).select(
        "scene_id", (F.col("row_id") + F.col("s.dy")).alias("row_id"), (F.col("col_id") + F.col("s.dx")).alias("col_id"), F.col("local").alias("la"))
    touching = reach.join(rim, PIXEL).filter("la <> local")

    def node(c: str):
        return F.struct("scene_id", F.col(c).alias("id"))

    edges = touching.select(node("la").alias("a"), node("local").alias("b")).distinct()
    roots = resolve_labels(edges).select(F.col("node.scene_id").alias("scene_id"), F.col("node.id").alias("local"), F.col("root.id").alias("root"))
    return lab.join(roots, ["scene_id", "local"], "left").select(*PIXEL, F.coalesce("root", "local").alias("label"))


def drop_specks(labelled: DataFrame, min_pixels: int) -> DataFrame:
    keep = labelled.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pixels)
    return labelled.join(keep.select("scene_id", "label"), ["scene_id", "label"], "left_semi")


def shapes(labelled: DataFrame, weight: str | None = None) -> DataFrame:
    """Pixel count, centroid, axis lengths, eccentricity and bearing of each region from its second moments."""
    aggs = [F.count(F.lit(1)).alias("area_px"), F.avg("row_id").alias("row"), F.avg("col_id").alias("col"),
            F.var_samp("row_id").alias("vy"), F.var_samp("col_id").alias("vx"), F.covar_samp("row_id", "col_id").alias("vxy")]
    if weight:
        aggs.append(F.max(weight).alias("peak"))
    g = labelled.groupBy("scene_id", "label").agg(*aggs)
    g = g.fillna(0.0, ["vx", "vy", "vxy"])
    half, spread = (F.col("vx") + F.col("vy")) / 2, F.hypot((F.col("vx") - F.col("vy")) / 2, F.col("vxy"))
    g = g.withColumns({"l1": half + spread, "l2": F.greatest(half - spread, F.lit(0.0))})
    bearing = F.pmod(F.degrees(F.atan2(F.col("vx") - F.col("vy") + 2 * spread, 2 * F.col("vxy"))), F.lit(180.0))
    return g.select("scene_id", "label", "area_px", "row", "col",
                    F.greatest(4 * F.sqrt("l1"), F.sqrt("area_px")).alias("major_px"), (4 * F.sqrt("l2")).alias("minor_px"),
                    F.sqrt(1 - F.col("l2") / F.greatest("l1", F.lit(1e-9))).alias("eccentricity"),
                    F.when(spread > 1e-12, bearing).otherwise(0.0).alias("bearing_deg"), *(["peak"] if weight else []))
