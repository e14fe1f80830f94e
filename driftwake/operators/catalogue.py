"""Observation catalogue: normalising, uniting, diffing and explaining products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def united(parts: dict[str, DataFrame]) -> DataFrame:
    """Replay, synthetic and live catalogues as one, told apart by ``mode``; absent fields stay null."""
    tagged = [df.withColumn("mode", F.lit(mode)) for mode, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def unseen(current: DataFrame, known: DataFrame) -> DataFrame:
    """Observations whose id has not been handled yet."""
    return current.join(known.select("observation_id").distinct(), "observation_id", "left_anti")


def known_ids(current: DataFrame, known: DataFrame) -> DataFrame:
    return known.select("observation_id").union(current.select("observation_id")).distinct()


def mode_summary(observations: DataFrame) -> DataFrame:
    return observations.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("acquired_us").isNull()).alias("undated"),
                                            F.count_if("pixels_local").alias("with_pixels"))


def normalise_granules(raw: DataFrame) -> DataFrame:
    """Provider pages (items or entries arrays) to granule rows; unpublished fields stay null."""
    g = raw.select(F.explode(F.coalesce("items", "entries")).alias("g")).select("g.*")
    have = set(g.columns)

    def pick(*names: str):
        found = [F.col(n) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return g.select(pick("id", "granule_id").alias("granule_id"), pick("identifier", "title").alias("identifier"),
                    pick("updated", "dcDate").alias("updated"), pick("size_mb", "size").alias("size_mb"))


def with_sidecars(rasters: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Attach sidecar metadata to rasters on the file stem; a raster without one keeps nulls."""
    def stem(c: str):
        return F.regexp_replace(F.element_at(F.split(F.col(c), "/"), -1), r"\.[^.]+$", "")

    s = sidecars.withColumn("stem", stem("path")).drop("path")
    return rasters.withColumn("stem", stem("path")).join(s, "stem", "left")


def scene_availability(observations: DataFrame, detections: DataFrame) -> DataFrame:
    """Every observation with its detections or the reason there are none."""
    n = detections.groupBy("observation_id").agg(F.count(F.lit(1)).alias("detections"))
    d = observations.join(n, "observation_id", "left").withColumn("detections", F.coalesce("detections", F.lit(0)))
    reason = (F.when(~F.col("pixels_local"), "no pixels on disk").when(F.col("acquired_us").isNull(), "acquisition time undeclared")
              .when(F.col("detections") == 0, "no detections"))
    return d.withColumn("reason", reason)
