"""Pixel-table operators: box filters, bright-target detection, morphology, gradients, tiles, zones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwake.config import DEFAULT, Config
from driftwake.functions import geo, radar

PIXEL = ["scene_id", "row_id", "col_id"]
LINES = {"h": (["scene_id", "row_id"], "col_id"), "v": (["scene_id", "col_id"], "row_id")}


def _line(axis: str) -> Window:
    keys, order = LINES[axis]
    return Window.partitionBy(*keys).orderBy(order)


def calibrated(pixels: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """dB and linear intensity. Unobserved pixels are null in dB and zero in intensity."""
    db = radar.dn_to_db(F.col("dn"), cfg)
    return pixels.withColumn("db", db).withColumn("lin", F.coalesce(radar.db_to_linear(F.col("db")), F.lit(0.0)))


def box_sums(pixels: DataFrame, cols: list[str], half: dict[str, int], axis: str) -> DataFrame:
    """Sum of each column over +-half positions along one axis, the end values repeated past the edge.

    A frame sum plus the missing positions times the end value; both axes together make a square box.
    """
    _, order = LINES[axis]
    w, whole = _line(axis), _line(axis).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lo, hi = F.min(order).over(whole), F.max(order).over(whole)
    out = {}
    for c in cols:
        k = half[c]
        before = F.greatest(F.lit(0), k - (F.col(order) - lo))
        after = F.greatest(F.lit(0), F.col(order) + k - hi)
        out[c] = (F.sum(c).over(w.rowsBetween(-k, k)) + before * F.first(c).over(whole) + after * F.last(c).over(whole))
    return pixels.withColumns(out)


def cfar(pixels: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Two-parameter detection against a square annulus: z of every pixel and the bright mask."""
    d = cfg.detection
    if d.cfar_background <= d.cfar_guard:
        raise ValueError("background window must exceed the guard window")
    lin = calibrated(pixels, cfg)
    sq = F.col("lin") * F.col("lin")
    p = lin.select(*PIXEL, "lin", F.col("lin").alias("so"), F.col("lin").alias("sg"), sq.alias("qo"), sq.alias("qg"))
    half = {"so": d.cfar_background, "qo": d.cfar_background, "sg": d.cfar_guard, "qg": d.cfar_guard}
    for axis in ("h", "v"):
        p = box_sums(p, list(half), half, axis)
    n = (2 * d.cfar_background + 1) ** 2 - (2 * d.cfar_guard + 1) ** 2
    mean = (F.col("so") - F.col("sg")) / n
    var = F.greatest((F.col("qo") - F.col("qg")) / n - mean * mean, F.lit(1e-12))
    z = (F.col("lin") - mean) / F.sqrt(var)
    return p.select(*PIXEL, "lin", z.alias("z")).withColumn("is_bright", F.col("z") > d.cfar_k)


def detector_summary(detected: DataFrame) -> DataFrame:
    return detected.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if("is_bright").alias("detected_pixels"),
        F.avg(F.col("is_bright").cast("double")).alias("false_alarm_rate"))


def _slide(df: DataFrame, axis: str, k: int, grow: bool) -> DataFrame:
    """One-dimensional dilation or erosion of integer column m; outside the scene counts as empty."""
    frame = _line(axis).rowsBetween(-k, k)
    if grow:
        return df.withColumn("m", F.max("m").over(frame))
    return df.withColumn("m", F.when(F.count(F.lit(1)).over(frame) == 2 * k + 1, F.min("m").over(frame)).otherwise(0))


def morphology(mask: DataFrame, k: int = 2, steps: str = "close,open") -> DataFrame:
    """Closing and/or opening of a full-grid mask (PIXEL, m in 0/1) with a (2k+1)-square.

    Passes alternate so that neighbouring ones share an axis, and with it one shuffle.
    """
    plan = {"close": (("h", True), ("v", True), ("v", False), ("h", False)),
            "open": (("h", False), ("v", False), ("v", True), ("h", True))}
    for step in steps.split(","):
        for axis, grow in plan[step]:
            mask = _slide(mask, axis, k, grow)
    return mask


def edge_gradient(pixels: DataFrame, value: str, inside: str, reach: int = 2) -> DataFrame:
    """Mean gradient magnitude on the band around a region's border, per scene.

    The band is the region grown by a diamond of ``reach`` minus the region shrunk by one.
    """
    p = pixels.select(*PIXEL, F.col(value).alias("f"), F.col(inside).cast("int").alias("g"), F.col(inside).cast("int").alias("s"))

    def slope(axis: str) -> Column:
        w, order = _line(axis), F.col(LINES[axis][1])
        hi, lo = F.coalesce(F.lead("f").over(w), F.col("f")), F.coalesce(F.lag("f").over(w), F.col("f"))
        span = (F.coalesce(F.lead(order).over(w), order) - F.coalesce(F.lag(order).over(w), order))
        return (hi - lo) / F.nullif(span, F.lit(0))

    for step in range(reach):
        near = {}
        for axis in ("h", "v"):
            w = _line(axis).rowsBetween(-1, 1)
            near[f"g{axis}"] = F.max("g").over(w)
            near[f"s{axis}"] = F.when(F.count(F.lit(1)).over(w) == 3, F.min("s").over(w)).otherwise(0)
            if step == 0:
                near[f"d{axis}"] = slope(axis)
        p = p.withColumns(near).withColumns({"g": F.greatest("gh", "gv"), "s": F.least("sh", "sv")})
    band = p.filter((F.col("g") == 1) & (F.col("s") == 0))
    return band.groupBy("scene_id").agg(F.avg(F.hypot("dv", "dh")).alias("edge_gradient"), F.count(F.lit(1)).alias("band_px"))


def scene_percentiles(pixels: DataFrame, value: str, ps: tuple[float, ...] = (0.01, 0.05, 0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles per scene from a (value, count) histogram; radar levels are quantised."""
    h = pixels.filter(F.col(value).isNotNull()).groupBy("scene_id", value).agg(F.count(F.lit(1)).alias("c"))
    q = h.groupBy("scene_id").agg(F.percentile(value, F.array(*[F.lit(p) for p in ps]), F.col("c")).alias("q"))
    return q.select("scene_id", *[F.col("q")[i].alias(f"p{round(p * 100):02d}") for i, p in enumerate(ps)])


def tile_grid(scenes: DataFrame, size: int = DEFAULT.detection.tile_px, overlap: int = DEFAULT.detection.tile_overlap_px) -> DataFrame:
    """Overlapping windows covering each scene (scene_id, ny, nx); the last ones slide back to full size."""
    if overlap >= size:
        raise ValueError(f"overlap ({overlap}) must be smaller than tile size ({size})")
    step = size - overlap

    def starts(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.greatest(F.col(n) - overlap, F.lit(1)).cast("int") - 1, F.lit(step)))

    t = scenes.withColumn("_y", starts("ny")).withColumn("_x", starts("nx"))
    y1, x1 = F.least(F.col("_y") + size, F.col("ny")), F.least(F.col("_x") + size, F.col("nx"))
    return t.select("scene_id", (F.col("_y") / step).cast("bigint").alias("ty"), (F.col("_x") / step).cast("bigint").alias("tx"),
                    F.greatest(y1 - size, F.lit(0)).cast("bigint").alias("y0"), y1.cast("bigint").alias("y1"),
                    F.greatest(x1 - size, F.lit(0)).cast("bigint").alias("x0"), x1.cast("bigint").alias("x1"))


def tile_pixels(pixels: DataFrame, grid: DataFrame, block: int) -> DataFrame:
    """Pixels with every tile covering them. Tiles list the blocks they touch, so the range join is a hash join."""
    g = grid.withColumn("by", F.explode(F.sequence(F.floor(F.col("y0") / block), F.floor((F.col("y1") - 1) / block)))).withColumn(
        "bx", F.explode(F.sequence(F.floor(F.col("x0") / block), F.floor((F.col("x1") - 1) / block))))
    p = pixels.withColumns({"by": F.floor(F.col("row_id") / block), "bx": F.floor(F.col("col_id") / block)})
    return p.join(g, ["scene_id", "by", "bx"]).filter(
        (F.col("row_id") >= F.col("y0")) & (F.col("row_id") < F.col("y1"))
        & (F.col("col_id") >= F.col("x0")) & (F.col("col_id") < F.col("x1"))).drop("by", "bx")


def stitch(tile_values: DataFrame, value: str) -> DataFrame:
    """Overlap average of tile outputs per pixel."""
    return tile_values.groupBy(*PIXEL).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("tiles"))


def zonal(pixels: DataFrame, zones: DataFrame, value: str, block: int = 16) -> DataFrame:
    """Statistics of the pixels inside each zone ring (scene_id, zone_id, ring of x=col, y=row)."""
    z = zones.withColumn("box", geo.ring_bounds(F.col("ring")))
    for axis, (lo, hi) in {"by": ("box.y0", "box.y1"), "bx": ("box.x0", "box.x1")}.items():
        z = z.withColumn(axis, F.explode(F.sequence(F.floor(F.col(lo) / block), F.floor(F.col(hi) / block))))
    p = pixels.select(*PIXEL, F.col(value).alias("_v")).withColumns(
        {"by": F.floor(F.col("row_id") / block), "bx": F.floor(F.col("col_id") / block)})
    x, y = F.col("col_id").cast("double"), F.col("row_id").cast("double")
    hit = p.join(z, ["scene_id", "by", "bx"]).filter(
        x.between(F.col("box.x0"), F.col("box.x1")) & y.between(F.col("box.y0"), F.col("box.y1")) & geo.point_in_ring(F.col("ring"), x, y))
    return hit.groupBy("scene_id", "zone_id").agg(
        F.count("_v").alias("pixels"), F.avg("_v").alias("mean_value"), F.percentile("_v", 0.5).alias("median_value"))


def local_contrast(labelled: DataFrame, pixels: DataFrame, value: str = "db", pad: int = 24, block: int = 32) -> DataFrame:
    """Mean of a padded ring around each region, all detected pixels left out, minus the region's mean."""
    inside = labelled.join(pixels.select(*PIXEL, F.col(value).alias("_v")), PIXEL)
    region = inside.groupBy("scene_id", "label").agg(
        F.count(F.lit(1)).alias("area_px"), F.avg("_v").alias("mean_db"), F.min("row_id").alias("r0"), F.max("row_id").alias("r1"),
        F.min("col_id").alias("c0"), F.max("col_id").alias("c1"))
    boxes = region.select("scene_id", "label", *[(F.col(c) + s * pad).alias(c) for c, s in (("r0", -1), ("r1", 1), ("c0", -1), ("c1", 1))])
    for axis, (lo, hi) in {"by": ("r0", "r1"), "bx": ("c0", "c1")}.items():
        boxes = boxes.withColumn(axis, F.explode(F.sequence(F.floor(F.col(lo) / block), F.floor(F.col(hi) / block))))
    free = pixels.select(*PIXEL, F.col(value).alias("_v")).join(labelled.select(*PIXEL), PIXEL, "left_anti").withColumns(
        {"by": F.floor(F.col("row_id") / block), "bx": F.floor(F.col("col_id") / block)})
    ring = free.join(boxes, ["scene_id", "by", "bx"]).filter(
        F.col("row_id").between(F.col("r0"), F.col("r1")) & F.col("col_id").between(F.col("c0"), F.col("c1")))
    background = ring.groupBy("scene_id", "label").agg(F.avg("_v").alias("ring_db"))
    return region.join(background, ["scene_id", "label"], "left").select(
        "scene_id", "label", "area_px", "mean_db", (F.col("ring_db") - F.col("mean_db")).alias("contrast_db"))


def score_tiles(tiles: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], schema: str) -> DataFrame:
    """Run a user's scoring function over pixel batches; it gets a frame and returns one score per row."""
    columns = tiles.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[columns].copy()
            out["score"] = scorer(pdf)
            yield out

    return tiles.mapInPandas(run, schema)


def darkness_score(cfg: Config = DEFAULT) -> Callable[[pd.DataFrame], pd.Series]:
    """Default scorer: how far a pixel lies below the sea level of the ramp, in [0, 1]; unobserved scores 0."""
    lo, hi = cfg.detection.db_min, cfg.detection.db_max

    def score(pdf: pd.DataFrame) -> pd.Series:
        return (1.0 - 2.0 * (pdf["db"].astype(float) - lo) / (hi - lo)).clip(0.0, 1.0).fillna(0.0)

    return score
