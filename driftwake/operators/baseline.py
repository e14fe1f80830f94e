"""Per-cell backscatter statistics kept per scene, so folding is append-only and idempotent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwake.config import DEFAULT, Config
from driftwake.functions import radar
from driftwake.functions.vessel import wind_bin

CELL = ["cell", "wind_bin"]
#: Samples that one task sums. Hardly two share scene, cell and wind, so a task's memory is that of its samples.
TASK_SAMPLES = 500_000


def strided(pixels: DataFrame, step: int = DEFAULT.baseline.sample_step) -> DataFrame:
    """Every ``step``-th row and column: neighbouring radar pixels are not independent samples."""
    return pixels.filter((F.col("row_id") % step == 0) & (F.col("col_id") % step == 0))


def scene_partials(samples: DataFrame, wind: str = "wind_ms") -> DataFrame:
    """Mergeable sums per (scene, cell, wind bin) from (scene_id, cell, wind, v).

    A ``part`` column names the piece of a scene that a row came in; sums are then kept per piece. Samples are dealt before they are
    summed, over as many tasks as they need: sums before the exchange would save no rows and hold a whole input split in memory.
    """
    part = ["part"] if "part" in samples.columns else []
    tasks = max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), samples.count() // TASK_SAMPLES + 1)
    dealt = samples.select("scene_id", *part, "cell", wind_bin(F.col(wind)).alias("wind_bin"), "v").repartition(tasks, "scene_id", *CELL)
    return (dealt.groupBy("scene_id", *part, *CELL)
            .agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss")))


def fold(store: DataFrame | None, partials: DataFrame) -> DataFrame:
    """Scenes, or parts of scenes, not yet in the store, ready to append. Folding one twice adds nothing.

    Without a ``part`` column a scene counts as complete in one piece; a scene that arrives in several must name them.
    """
    if store is None:
        return partials
    keys = [c for c in ("scene_id", "part") if c in partials.columns]
    seen = store.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return partials.join(seen, same, "left_anti")


def statistics(store: DataFrame) -> DataFrame:
    """Mean and population deviation per cell and wind bin over everything folded so far."""
    g = store.groupBy(*CELL).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
                                 F.count_distinct("scene_id").alias("scenes"))
    mean = F.col("s") / F.col("n")
    return g.select(*CELL, "n", "scenes", mean.alias("mean"),
                    F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(1e-9))).alias("std"))


def robust_background(samples: DataFrame) -> DataFrame:
    """Median and scaled MAD per scene. Values collapse to (value, count) first, so a huge scene
    reaches the exact percentile as a histogram of its quantised levels."""
    hist = samples.groupBy("scene_id", "v").agg(F.count(F.lit(1)).alias("c"))
    med = hist.groupBy("scene_id").agg(F.percentile("v", 0.5, F.col("c")).alias("median_db"))
    return hist.join(med, "scene_id").groupBy("scene_id").agg(
        F.max("median_db").alias("median_db"),
        (F.percentile(F.abs(F.col("v") - F.col("median_db")), 0.5, F.col("c")) * 1.4826).alias("sigma_db"))


def anomaly_z(samples: DataFrame, stats: DataFrame, background: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """z against the cell's own history in the same wind bin when it has enough scenes, else against the scene."""
    local = stats.filter(F.col("scenes") >= cfg.baseline.min_scenes_for_local).select(
        *CELL, F.col("mean").alias("_m"), F.col("std").alias("_s"))
    d = samples.withColumn("wind_bin", wind_bin(F.col("wind_ms"))).join(local, CELL, "left").join(background, "scene_id")
    floor = F.lit(1e-6)
    z = F.when(F.col("_m").isNotNull(), (F.col("v") - F.col("_m")) / F.greatest("_s", floor)).otherwise(
        (F.col("v") - F.col("median_db")) / F.greatest("sigma_db", floor))
    mode = F.when(F.col("_m").isNotNull(), "local").otherwise("global_fallback")
    return d.select(*samples.columns, "wind_bin", z.alias("z"), mode.alias("mode"))


def fused(scored: DataFrame, prob: Column, cfg: Config = DEFAULT) -> DataFrame:
    d = cfg.detection
    gate = F.col("wind_ms").between(d.wind_gate_min_ms, d.wind_gate_max_ms)
    return scored.withColumn("confidence", radar.fused_confidence(prob, F.col("z"), gate, cfg))


def anomaly_summary(scored: DataFrame, threshold: float) -> DataFrame:
    """Masked share over observed samples, mean score inside the mask, peak score, per scene."""
    hit = F.col("confidence") >= threshold
    return scored.filter("v is not null").groupBy("scene_id").agg(
        F.avg(hit.cast("double")).alias("masked_share"), F.coalesce(F.avg(F.when(hit, F.col("confidence"))), F.lit(0.0)).alias("mean_in_mask"),
        F.max("confidence").alias("max_confidence"))
