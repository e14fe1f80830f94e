"""Registered polygon, shore, alert and serving queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwake.operators import attribution as at
from driftwake.operators import overlay, polygons, serve, shore
from driftwake.plans import queries_attribution as qa
from driftwake.plans.fixtures import table
from driftwake.plans.queries_vessel import joined, rounded

RES = 0.02


def slick_rings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "slick_points").groupBy("slick_id", "incident_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("ring"))


def _land(s: SparkSession, d: str) -> DataFrame:
    """Land cells: everything east of the shore, row by row, to longitude 76."""
    row = F.floor(F.col("y1") / RES)
    c = table(s, d, "coast").groupBy(row.alias("cy")).agg(F.min("x1").alias("x"))
    return c.select("cy", F.explode(F.sequence(F.floor(F.col("x") / RES) + 1, F.lit(3800).cast("bigint"))).alias("cx"))


def planted_rings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "planted_points").groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("ring"))


def _iou(s: SparkSession, d: str) -> DataFrame:
    over = overlay.polygon_overlap(slick_rings(s, d), qa.step_rings(s, d), "incident_id", "slick_id", "hours_back")
    return rounded(over, inter_km2=4, union_km2=4)


def _best_detection(s: SparkSession, d: str) -> DataFrame:
    return rounded(overlay.best_detection(slick_rings(s, d), planted_rings(s, d)), 5, planted_axis_deg=4, best_axis_deg=4, axis_delta_deg=4)


def _scene_parts(s: SparkSession, d: str) -> DataFrame:
    return overlay.union_parts(slick_rings(s, d).select("incident_id", "ring").unionByName(planted_rings(s, d)))


def _land_share(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "incidents")
    for c in ("cx", "cy"):
        g = g.withColumn(f"g{c}", F.explode(F.sequence(F.floor((F.col(c) - 0.5) / RES), F.floor((F.col(c) + 0.5) / RES))))
    land = _land(s, d).select(F.col("cx").alias("gcx"), F.col("cy").alias("gcy"), F.lit(1.0).alias("l"))
    return g.join(land, ["gcx", "gcy"], "left").groupBy("incident_id").agg(F.avg(F.coalesce("l", F.lit(0.0))).alias("land_fraction"))


def _tiers(s: SparkSession, d: str) -> DataFrame:
    return shore.tier(shore.shore_eta(table(s, d, "horizons")))


def _recipients(s: SparkSession, d: str) -> DataFrame:
    i = F.col("incident_id")
    alerts = _tiers(s, d).withColumns({"lat": 8.0 + (i % 130) / 10.0, "lon": 66.0 + (i % 97) / 8.0})
    return shore.recipients(alerts, table(s, d, "stations"))


def _by_score(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("incident_id").orderBy(F.desc("score"), "mmsi")
    return qa.best(s, d).withColumn("rank", F.row_number().over(w).cast("bigint"))


def _roles(s: SparkSession, d: str) -> DataFrame:
    ais = table(s, d, "ais")
    return serve.track_roles(ais.select("mmsi").distinct(), at.in_scene(ais, table(s, d, "incidents")), qa.candidates(s, d), _by_score(s, d))


def _resolve(s: SparkSession, d: str) -> DataFrame:
    k = F.col("slick_id")
    det = table(s, d, "slick_points").select("slick_id", "incident_id").distinct().filter("incident_id % 5 <> 3").withColumn(
        "confidence", F.when(k % 4 == 0, 0.0).otherwise((k % 7) / 10.0))
    return serve.resolve_slick(det, table(s, d, "incidents"))


def _violations(s: SparkSession, d: str) -> DataFrame:
    from driftwake.sources.contracts import Rule, validate

    rules = (Rule("lat_range", "lat between -90 and 90"), Rule("lon_range", "lon between -180 and 180"), Rule("sog_range", "sog between 0 and 10"),
             Rule("cog_missing", "cog is not null"), Rule("flag_unknown", "flag in ('IN','LR','MH','SG','PA')"))
    return validate(table(s, d, "ais"), rules).filter(F.size("violations") > 0).select("event_id", joined("violations"))


def _alerts(s: SparkSession, d: str) -> DataFrame:
    i = F.col("incident_id")
    a = _tiers(s, d).withColumns({"lat": 8.0 + (i % 130) / 10.0, "lon": 66.0 + (i % 97) / 8.0, "acq_us": 1_704_067_200_000_000 + i * 60_000_000})
    return shore.alert_text(a).select("incident_id", "alert_id", "severity", "message")


def _affected(s: SparkSession, d: str) -> DataFrame:
    steps = qa.step_rings(s, d).select("incident_id", "hours_back", "ring")
    return rounded(shore.affected_shore(steps, table(s, d, "coast")), 4)


QUERIES = {
    "polygon_metrics": lambda s, d: rounded(polygons.polygon_metrics(slick_rings(s, d)), major_axis_m=3, minor_axis_m=3, major_axis_deg=4).drop("incident_id"),
    "polygon_iou": _iou,
    "polygon_iou_all": _iou,
    "best_detection": _best_detection,
    "origin_envelope": lambda s, d: rounded(overlay.union_parts(qa.step_rings(s, d)), 4),
    "scene_parts": lambda s, d: rounded(_scene_parts(s, d), 4),
    "slick_off_land": lambda s, d: polygons.off_land(polygons.cell_cover(slick_rings(s, d).select("slick_id", "ring"), RES), _land(s, d), ["slick_id"])
        .groupBy("slick_id").agg(F.count(F.lit(1)).alias("cells")),
    "on_land": lambda s, d: polygons.on_land(table(s, d, "ais").select("event_id", "mmsi", "lat", "lon"), _land(s, d), RES).drop("lat", "lon"),
    "land_share": lambda s, d: rounded(_land_share(s, d)),
    "coast_distance": lambda s, d: rounded(shore.coast_distance(table(s, d, "step_edges"), table(s, d, "coast")), 5),
    "coast_distance_all": lambda s, d: rounded(shore.coast_distance(table(s, d, "step_edges"), table(s, d, "coast")), 5),
    "affected_shore": _affected,
    "shore_eta": lambda s, d: rounded(shore.shore_eta(table(s, d, "horizons"))),
    "tier": lambda s, d: _tiers(s, d).select("incident_id", "tier", "severity", F.array_join("reasons", "; ").alias("reasons")),
    "recipients": _recipients,
    "stations_marked": lambda s, d: shore.stations_marked(table(s, d, "stations"), _recipients(s, d)).select(
        "station_id", "role", "region", "alerts", "nearest_km", "addressed"),
    "alert_messages": _alerts,
    "incident_list": lambda s, d: serve.incident_list(table(s, d, "incidents"), _by_score(s, d)),
    "track_roles": _roles,
    "coast_window": lambda s, d: serve.coast_window(table(s, d, "coast"), 72.0, 15.0, 73.0, 18.0),
    "resolve_slick": _resolve,
    "contract_violations": _violations,
}
