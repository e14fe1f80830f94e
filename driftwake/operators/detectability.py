"""Can the sensors see it, and when? Every request is assessed in its own row: no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sensor name, pixel size (m), revisit (h), needs clear sky, needs daylight.
SENSORS = (("INSAT-3DS", 1000.0, 0.5, True, True), ("EOS-06", 360.0, 48.0, True, True), ("EOS-04", 18.0, 134.4, False, False))
MEASURED = "EOS-04"
MIN_PIXELS = 10
REPRESENTATIVE = (("large", 15.0), ("medium", 7.0), ("small", 1.0))


def measured_cells(surface: DataFrame) -> Column:
    """Cells of a measured surface (area_km2, contrast_db, detection_rate) for ``assess``: one array, as large as the grid of trials that was flown."""
    cell = F.struct(F.col("area_km2").cast("double").alias("a"), F.col("contrast_db").cast("double").alias("c"), F.col("detection_rate").cast("double").alias("r"))
    return surface.agg(F.array_sort(F.collect_list(cell))).scalar()


def measured_rate(cells: list[tuple[float, float, float]] | Column, area: Column, contrast: Column) -> Column:
    """Rate of the nearest measured cell: log area first, then contrast. Areas above the table use its largest."""
    if isinstance(cells, Column):
        table, top = cells, F.array_max(F.transform(cells, lambda t: t.a))
    else:
        top = F.lit(max(c[0] for c in cells))
        table = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(c)).alias("c"), F.lit(float(r)).alias("r")) for a, c, r in cells])
    la = F.log10(F.greatest(F.least(area, top), F.lit(1e-6)))
    # bound as a lambda's argument, or the largest area would be sought anew for every cell
    ranked = F.transform(F.array(la), lambda x: F.array_min(F.transform(table, lambda t: F.struct(
        F.abs(F.log10(F.greatest(t.a, F.lit(1e-6))) - x).alias("da"), F.abs(t.c - contrast).alias("dc"), t.a.alias("a"),
        t.c.alias("c"), t.r.alias("r")))))
    return F.get(ranked, F.lit(0))


def assess(requests: DataFrame, cells: list[tuple[float, float, float]] | Column) -> DataFrame:
    """One row per (request, sensor) with pixels, usable share, expected wait and catch probability."""
    columns = requests.columns
    if isinstance(cells, Column):
        requests, cells = requests.withColumn("_cells", cells), F.col("_cells")
    hit = measured_rate(cells, F.col("area_km2"), F.col("contrast_db"))
    sensors = F.array(*[F.struct(F.lit(n).alias("sensor"), F.lit(p).alias("pixel_m"), F.lit(r).alias("revisit_h"),
                                 F.lit(sky).alias("clear_sky"), F.lit(day).alias("daylight")) for n, p, r, sky, day in SENSORS])
    d = requests.withColumn("_hit", hit).withColumn("_s", F.explode(sensors)).select(
        *columns, "_hit", "_s.*")
    px = F.col("area_km2") * 1e6 / (F.col("pixel_m") * F.col("pixel_m"))
    usable = (F.when(F.col("clear_sky"), F.greatest(F.lit(0.0), 1.0 - F.col("cloud_fraction"))).otherwise(1.0)
              * F.when(F.col("daylight"), F.greatest(F.lit(0.0), F.col("daylight_fraction"))).otherwise(1.0))
    d = d.withColumns({"pixels_on_target": px, "usable": usable}).withColumn("resolves", F.col("pixels_on_target") >= MIN_PIXELS)
    p = F.when(F.col("sensor") == MEASURED, F.col("_hit.r")).otherwise(F.col("resolves").cast("double"))
    eff = F.col("usable") * p
    d = d.withColumn("wait_h", F.when(F.col("resolves") & (eff > 0), F.col("revisit_h") / 2.0 / eff))
    caught = F.col("wait_h") <= F.col("persistence_hours")
    verdict = (F.when(~F.col("resolves"), "CANNOT SEE IT").when(F.col("wait_h").isNull(), "BLOCKED")
               .when(caught, "DETECTS").otherwise("MISSES MOST"))
    return d.select("request_id", "sensor", "pixels_on_target", "resolves", F.col("usable").alias("usable_pass_fraction"),
                    F.when(F.col("sensor") == MEASURED, F.col("_hit.r")).alias("measured_rate"), "wait_h",
                    F.coalesce(caught, F.lit(False)).alias("caught"),
                    F.when(F.col("wait_h").isNotNull(), F.least(F.lit(1.0), F.col("persistence_hours") / F.col("wait_h"))).alias(
                        "catch_probability"),
                    verdict.alias("verdict"))


def first_detection(assessed: DataFrame) -> DataFrame:
    """The earliest sensor that catches the slick in time, else the one most likely to catch it at all."""
    g = assessed.groupBy("request_id").agg(
        F.min(F.when(F.col("caught"), F.struct("wait_h", "sensor"))).alias("w"),
        F.max_by(F.struct("sensor", "catch_probability"), F.struct("catch_probability", "sensor")).alias("b"))
    return g.select("request_id", F.col("w.sensor").alias("first_sensor"), F.col("w.wait_h").alias("first_wait_h"),
                    F.when(F.col("w").isNull() & F.col("b.catch_probability").isNotNull(), F.col("b.sensor")).alias("best_effort"),
                    F.when(F.col("w").isNull(), F.col("b.catch_probability")).alias("best_effort_probability"))


def compare_size_classes(requests: DataFrame, cells: list[tuple[float, float, float]] | Column) -> DataFrame:
    """What the sensors do with a large, a medium and a small slick under each request's conditions (``REPRESENTATIVE`` areas):
    request_id, size_class, area_km2, the first sensor and wait, or the best effort."""
    kinds = F.array(*[F.struct(F.lit(k).alias("size_class"), F.lit(a).alias("area_km2")) for k, a in REPRESENTATIVE])
    d = requests.withColumn("_k", F.explode(kinds)).withColumn("request_id", F.struct("request_id", "_k.size_class", "_k.area_km2")).withColumn("area_km2", F.col("_k.area_km2")).drop("_k")
    first = first_detection(assess(d, cells))
    return first.select("request_id.*", *[c for c in first.columns if c != "request_id"])
