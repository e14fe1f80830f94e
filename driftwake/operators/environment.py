"""Wind and current fields: fill, summary, point sampling and drift velocity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwake.config import DEFAULT, Config
from driftwake.functions import geo

VECTORS = ("wind_u", "wind_v", "curr_u", "curr_v")


def wind_statistics(env: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per-field speed statistics over retrieved cells only, taken before any fill."""
    speed = F.hypot("wind_u", "wind_v")
    gate = speed.between(cfg.detection.wind_gate_min_ms, cfg.detection.wind_gate_max_ms)
    return env.groupBy("field_id").agg(
        F.avg(speed).alias("mean_speed_ms"), F.min(speed).alias("min_speed_ms"), F.max(speed).alias("max_speed_ms"),
        F.avg(F.col("wind_u").isNull().cast("double")).alias("missing_fraction"),
        F.avg(gate.cast("double")).alias("fraction_in_band"))


def fill_wind(env: DataFrame) -> DataFrame:
    """Missing retrievals take their field's mean vector. Means aggregate map-side, then join back; a grid made by
    exploding fields looks small to Spark, so neither side is broadcast."""
    means = env.groupBy("field_id").agg(F.avg("wind_u").alias("_mu"), F.avg("wind_v").alias("_mv")).hint("merge")
    return env.join(means, "field_id").select(
        *[c for c in env.columns if c not in ("wind_u", "wind_v")],
        F.coalesce("wind_u", "_mu").alias("wind_u"), F.coalesce("wind_v", "_mv").alias("wind_v"))


def first_slice(env: DataFrame, instants: DataFrame) -> DataFrame:
    """For each (field_id, ts_us) the index of the first slice at or after it, clipped to the last slice."""
    axis = env.groupBy("field_id", "ti").agg(F.min("t_us").alias("t"))
    axis = axis.groupBy("field_id").agg(F.array_sort(F.collect_list(F.struct("t", "ti"))).alias("axis")).hint("merge")
    at_or_after = F.filter("axis", lambda s: s.t >= F.col("ts_us"))
    pick = F.coalesce(F.get(at_or_after, F.lit(0)), F.element_at("axis", -1))
    return instants.join(axis, "field_id").select(*instants.columns, pick.ti.alias("ti"))


def env_summary(env: DataFrame, instants: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Mean conditions of a field at an instant; directions are the way the flow goes."""
    d = cfg.detection
    at = first_slice(env, instants).join(fill_wind(env).hint("merge"), ["field_id", "ti"])
    g = at.groupBy(*instants.columns).agg(
        *[F.avg(c).alias(c) for c in VECTORS], F.avg(F.hypot("wind_u", "wind_v")).alias("mean_wind_speed_ms"),
        F.avg(F.hypot("curr_u", "curr_v")).alias("mean_current_speed_ms"))

    def toward(u: str, v: str) -> Column:
        return F.pmod(F.degrees(F.atan2(u, v)), F.lit(360.0))

    return g.select(*instants.columns, "mean_wind_speed_ms", toward("wind_u", "wind_v").alias("wind_toward_deg"),
                    "mean_current_speed_ms", toward("curr_u", "curr_v").alias("current_toward_deg"),
                    F.col("mean_wind_speed_ms").between(d.wind_gate_min_ms, d.wind_gate_max_ms).alias("wind_gate_pass"))


def slices_as_rows(env: DataFrame) -> DataFrame:
    """One row per (field, slice) with the grid as sorted arrays; a slice is bounded by its grid, not by the data volume."""
    cell = F.struct("yi", "xi", "lat", "lon", *VECTORS)
    g = env.groupBy("field_id", "ti").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    nx = F.size(F.filter("cells", lambda c: c.yi == F.get(F.col("cells"), F.lit(0)).yi))
    g = g.withColumn("nx", nx)
    lats = F.transform(F.sequence(F.lit(0), (F.size("cells") / F.col("nx")).cast("int") - 1),
                       lambda i: F.get(F.col("cells"), (i * F.col("nx")).cast("int")).lat)
    lons = F.transform(F.slice("cells", 1, F.col("nx")), lambda c: c.lon)
    return g.select("field_id", "ti", "cells", "nx", lats.alias("lats"), lons.alias("lons"))


def _axis_position(axis: Column, value: Column) -> tuple[Column, Column]:
    """(lower index, weight of the upper neighbour), clamped at both ends."""
    n = F.size(axis)
    below = F.size(F.filter(axis, lambda a: a <= value)) - 1
    i = F.greatest(F.lit(0), F.least(n - 2, below))
    lo, hi = F.get(axis, i), F.get(axis, i + 1)
    return i, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / (hi - lo)))


def sample_env(env: DataFrame, probes: DataFrame) -> DataFrame:
    """Bilinear wind and current at each probe (field_id, ts_us, lat, lon): one shuffle join on (field, slice)."""
    at = first_slice(env, probes).join(slices_as_rows(fill_wind(env)).hint("merge"), ["field_id", "ti"])
    y, wy = _axis_position(F.col("lats"), F.col("lat"))
    x, wx = _axis_position(F.col("lons"), F.col("lon"))
    at = at.select(*probes.columns, "cells", "nx", y.alias("_y"), wy.alias("_wy"), x.alias("_x"), wx.alias("_wx"))

    def corner(dy: int, dx: int) -> Column:
        return F.get(F.col("cells"), ((F.col("_y") + dy) * F.col("nx") + F.col("_x") + dx).cast("int"))

    wy, wx = F.col("_wy"), F.col("_wx")
    at = at.select(*probes.columns, "_wy", "_wx", corner(0, 0).alias("_a"), corner(1, 0).alias("_b"),
                   corner(0, 1).alias("_c"), corner(1, 1).alias("_d"))
    return at.select(*probes.columns, *[
        (F.col(f"_a.{v}") * (1 - wy) * (1 - wx) + F.col(f"_b.{v}") * wy * (1 - wx)
         + F.col(f"_c.{v}") * (1 - wy) * wx + F.col(f"_d.{v}") * wy * wx).alias(v) for v in VECTORS])


def drift_velocity(sampled: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Current plus a share of the wind turned clockwise, in m/s."""
    u, v = geo.rotate_cw(F.col("wind_u"), F.col("wind_v"), cfg.drift.wind_deflection_deg)
    return sampled.withColumns({"drift_u": F.col("curr_u") + cfg.drift.wind_factor * u,
                                "drift_v": F.col("curr_v") + cfg.drift.wind_factor * v})


def granules(scan: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float, fill: float = -999000000.0) -> DataFrame:
    """Wind granule rows (granule, t0, hours_since, lat, lon 0..360, u, v) cropped and cleaned.

    The box is matched in the grid's own 0..360 convention, with an OR branch when it straddles the antimeridian.
    """
    lo, hi = min_lon % 360.0, max_lon % 360.0
    east = (F.col("lon") >= lo) & (F.col("lon") <= hi) if lo <= hi else (F.col("lon") >= lo) | (F.col("lon") <= hi)

    def clean(c: str) -> Column:
        return F.when(F.abs(F.col(c) - fill) >= 1.0, F.col(c)).alias(c)

    return scan.filter(F.col("lat").between(min_lat, max_lat) & east).select(
        "granule", (F.col("t0_us") + (F.col("hours_since") * 3.6e9).cast("bigint")).alias("t_us"), "lat",
        F.when(F.col("lon") > 180.0, F.col("lon") - 360.0).otherwise(F.col("lon")).alias("lon"), clean("u"), clean("v"))


def thin_field(env: DataFrame, stride: int = 3, t_stride: int = 2) -> DataFrame:
    """Every n-th grid point and slice, rounded for display."""
    keep = (F.col("yi") % stride == 0) & (F.col("xi") % stride == 0) & (F.col("ti") % t_stride == 0)
    return env.filter(keep).select("field_id", "ti", "yi", "xi", *[F.round(c, 3).alias(c) for c in VECTORS])
