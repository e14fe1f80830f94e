"""Registered pixel-table queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.functions import radar
from driftwake.operators import baseline, components, raster
from driftwake.plans.fixtures import table
from driftwake.plans.queries_vessel import rounded


def _px(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pixels")


def _scenes(s: SparkSession, d: str) -> DataFrame:
    return _px(s, d).groupBy("scene_id").agg((F.max("row_id") + 1).alias("ny"), (F.max("col_id") + 1).alias("nx"))


def _stitched(s: SparkSession, d: str) -> DataFrame:
    p = raster.calibrated(_px(s, d)).select(*raster.PIXEL, F.coalesce("db", F.lit(-30.0)).alias("db"))
    t = raster.tile_pixels(p, raster.tile_grid(_scenes(s, d), 32, 8), 32)
    means = t.groupBy("scene_id", "ty", "tx").agg(F.avg("db").alias("m"))
    return raster.stitch(t.join(means, ["scene_id", "ty", "tx"]).withColumn("residual", F.col("db") - F.col("m")), "residual")


def _zones(s: SparkSession, d: str) -> DataFrame:
    def vertex(k: Column) -> Column:
        a, z = F.radians(30.0 * k), F.col("zone_id")
        return F.struct((28.0 + 10.0 * z + (9.0 + z) * F.cos(a)).alias("x"), (44.0 - 14.0 * z + (6.0 + z) * F.sin(a)).alias("y"))

    z = _px(s, d).select("scene_id").distinct().withColumn("zone_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    return z.withColumn("ring", F.transform(F.sequence(F.lit(0), F.lit(11)), vertex))


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return components.label(_px(s, d).filter("dn between 1 and 60 or dn > 200"), 8, tile=24)


def _scored(s: SparkSession, d: str) -> DataFrame:
    """Default darkness scorer over pixel batches, thresholded, specks dropped."""
    p = raster.calibrated(_px(s, d)).select(*raster.PIXEL, "db")
    hot = raster.score_tiles(p, raster.darkness_score(), "scene_id long, row_id long, col_id long, db double, score double").filter("score >= 0.5")
    return components.shapes(components.drop_specks(components.label(hot, 4), 64))


QUERIES = {
    "pixel_db": lambda s, d: rounded(raster.calibrated(_px(s, d))).drop("dn"),
    "strided_sample": lambda s, d: baseline.strided(_px(s, d)),
    "sigma0_calibration": lambda s, d: rounded(_px(s, d).select(
        *raster.PIXEL, radar.dn_to_sigma0_db(F.col("dn"), F.lit(45.0), F.lit(9.0)).alias("sigma0_db"))),
    "scene_percentiles": lambda s, d: rounded(raster.scene_percentiles(raster.calibrated(_px(s, d)), "db")),
    "cfar_windows": lambda s, d: rounded(raster.cfar(_px(s, d)), z=4).drop("lin"),
    "cfar_summary": lambda s, d: rounded(raster.detector_summary(raster.cfar(_px(s, d))), 9),
    "morphology": lambda s, d: raster.morphology(_px(s, d).select(
        *raster.PIXEL, (F.col("dn").between(1, 40) | (F.col("dn") > 150)).cast("bigint").alias("m"))).withColumn("m", F.col("m").cast("bigint")),
    "edge_gradient": lambda s, d: rounded(raster.edge_gradient(raster.calibrated(_px(s, d)).withColumns(
        {"f": F.coalesce("db", F.lit(-30.0)), "inside": F.col("dn").between(1, 60)}), "f", "inside")),
    "tile_grid": lambda s, d: raster.tile_grid(_scenes(s, d), 32, 8),
    "stitch": lambda s, d: rounded(_stitched(s, d)),
    "zonal_stats": lambda s, d: rounded(raster.zonal(raster.calibrated(_px(s, d)), _zones(s, d), "db")),
    "components": _labelled,
    "component_shapes": lambda s, d: rounded(components.shapes(components.drop_specks(_labelled(s, d), 5)), minor_px=5, bearing_deg=5).drop("eccentricity"),
    "local_contrast": lambda s, d: rounded(raster.local_contrast(_labelled(s, d), raster.calibrated(_px(s, d)))),
    "tile_scoring": lambda s, d: rounded(_scored(s, d), minor_px=5, bearing_deg=5).drop("eccentricity"),
}
