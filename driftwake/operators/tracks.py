"""Track operators: dedup, gaps, kinematics, feed summary, interpolation and decimation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwake.config import DEFAULT, Config
from driftwake.functions import geo
from driftwake.operators.ordered import HOUR_US, TRACK_BUCKET_US, neighbours, runs, time_bucket

FIX = ["t_us", "lat", "lon", "sog"]
SLOT_US = HOUR_US


def drop_duplicate_broadcasts(ais: DataFrame) -> DataFrame:
    """First row per (mmsi, t_us) by event_id; an aggregate, so a hot vessel combines map-side."""
    rest = [c for c in ais.columns if c not in ("mmsi", "t_us")]
    kept = ais.groupBy("mmsi", "t_us").agg(F.min_by(F.struct(*rest), F.col("event_id")).alias("r"))
    return kept.select("mmsi", "t_us", "r.*").select(*ais.columns)


def with_segments(ais: DataFrame, *carry: str) -> DataFrame:
    """Each fix with its predecessor(s): dt_s, dist_m and derived knots of the segment ending here."""
    base = ais.select("mmsi", *FIX, *carry)
    n = neighbours(base, ["mmsi"], ["t_us"], FIX, time_bucket("t_us"))

    def knots(a: str, b: str) -> tuple[Column, Column, Column]:
        lat, lon, t = (F.col(f"{b}lat"), F.col(f"{b}lon"), F.col(f"{b}t_us"))
        dt = (t - F.col(f"{a}.t_us")) / 1e6
        dist = geo.segment_m(F.col(f"{a}.lat"), F.col(f"{a}.lon"), lat, lon)
        return dt, dist, F.when(dt > 0, dist / dt / geo.KN_TO_MS).when(dt.isNotNull(), 0.0)

    dt, dist, kn = knots("prev", "")
    _, _, kn_before = knots("prev2", "prev.")
    return n.select("*", dt.alias("dt_s"), dist.alias("dist_m"), kn.alias("derived_kn"),
                    kn_before.alias("derived_kn_before"))


def segment_kinematics(ais: DataFrame) -> DataFrame:
    return with_segments(ais).filter("prev is not null").select(
        "mmsi", F.col("prev.t_us").alias("start_us"), F.col("t_us").alias("end_us"), "dt_s", "dist_m", "derived_kn")


def find_gaps(ais: DataFrame, gap_min: float = DEFAULT.trust.ais_gap_min) -> DataFrame:
    """Reporting silences strictly longer than ``gap_min`` minutes."""
    n = neighbours(ais.select("mmsi", "t_us", "lat", "lon"), ["mmsi"], ["t_us"], ["t_us", "lat", "lon"],
                   time_bucket("t_us"))
    minutes = (F.col("t_us") - F.col("prev.t_us")) / 6e7
    return n.filter(minutes > gap_min).select(
        "mmsi", F.col("prev.t_us").alias("start_us"), F.col("t_us").alias("end_us"), minutes.alias("duration_min"),
        F.col("prev.lat").alias("start_lat"), F.col("prev.lon").alias("start_lon"),
        F.col("lat").alias("end_lat"), F.col("lon").alias("end_lon"))


def feed_summary(ais: DataFrame, gap_min: float = DEFAULT.trust.ais_gap_min) -> DataFrame:
    """One row describing a feed. Every measure is a mergeable aggregate over per-vessel partials."""
    per_vessel = ais.groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("sog") > 1).alias("moving"),
        F.min("t_us").alias("t0"), F.max("t_us").alias("t1"),
        F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"),
        F.count_if(F.col("heading").isNull()).alias("no_heading"), F.count_if(F.col("imo_text").isNull()).alias("no_imo"),
        F.count_if(F.col("type_code").isNull()).alias("no_type"))
    body = per_vessel.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("vessels"),
        F.min("t0").alias("t_min_us"), F.max("t1").alias("t_max_us"),
        F.min("x0").alias("min_lon"), F.min("y0").alias("min_lat"),
        F.max("x1").alias("max_lon"), F.max("y1").alias("max_lat"),
        F.percentile("n", 0.5).alias("median_reports_per_vessel"),
        F.count_if(F.col("n") >= 200).alias("vessels_over_200_reports"),
        F.count_if(F.col("moving") > 0).alias("vessels_underway"),
        (100.0 * F.sum("moving") / F.sum("n")).alias("pct_rows_underway"),
        (100.0 * F.sum("no_heading") / F.sum("n")).alias("null_heading_pct"),
        (100.0 * F.sum("no_imo") / F.sum("n")).alias("null_imo_pct"),
        (100.0 * F.sum("no_type") / F.sum("n")).alias("null_type_pct"))
    gaps = find_gaps(ais, gap_min).groupBy("mmsi").agg(F.count(F.lit(1)).alias("g")).agg(
        F.coalesce(F.sum("g"), F.lit(0)).alias("gaps"), F.count(F.lit(1)).alias("vessels_with_gaps"))
    one = F.lit(1).alias("_one")
    return body.select("*", one).join(gaps.select("*", one), "_one").drop("_one")


def static_by_vessel(ais: DataFrame, *cols: str) -> DataFrame:
    """Static metadata from a vessel's first fix."""
    return ais.groupBy("mmsi").agg(F.min_by(F.struct(*cols), F.struct("t_us", "event_id")).alias("m")).select("mmsi", "m.*")


def top_values(ais: DataFrame, value: Column, k: int) -> DataFrame:
    """Most common static values over vessels: value, vessels, rank."""
    first = ais.withColumn("value", value).transform(lambda d: static_by_vessel(d, "value"))
    counts = first.filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("vessels"))
    return counts.orderBy(F.desc("vessels"), "value").limit(k)


def in_bbox(ais: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    return ais.filter(F.col("lon").between(min_lon, max_lon) & F.col("lat").between(min_lat, max_lat))


def dwell_in_bbox(ais: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    """Hours between the first and last fix inside, with the mean offset from the box centre."""
    cx, cy = (min_lon + max_lon) / 2, (min_lat + max_lat) / 2
    inside = in_bbox(ais, min_lon, min_lat, max_lon, max_lat)
    return inside.groupBy("mmsi").agg(
        ((F.max("t_us") - F.min("t_us")) / 3.6e9).alias("dwell_h"),
        F.min(F.pow(F.col("lon") - cx, F.lit(2.0)) + F.pow(F.col("lat") - cy, F.lit(2.0))).alias("centre_d2"),
        F.count(F.lit(1)).alias("fixes"))


def dwell_ranking(ais: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float, keep: int = 10, min_kn: float = 1.0) -> DataFrame:
    """Vessels by their time inside a box, longest first, ties to the nearer approach to its centre, then the lesser id: rank and the dwell columns.

    Vessels that never move there are left out; the sort keeps ``keep`` rows a task before they meet.
    """
    moving = in_bbox(ais, min_lon, min_lat, max_lon, max_lat).filter(F.col("sog") > min_kn).select("mmsi").distinct()
    d = dwell_in_bbox(ais, min_lon, min_lat, max_lon, max_lat).join(moving, "mmsi", "left_semi")
    top = d.orderBy(F.desc("dwell_h"), "centre_d2", "mmsi").limit(keep)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("dwell_h"), "centre_d2", "mmsi")).cast("long"))


def track_intervals(ais: DataFrame) -> DataFrame:
    """Linear pieces [t0, t1] of every track; a vessel's first fix is a zero-length piece."""
    n = neighbours(ais.select("mmsi", *FIX), ["mmsi"], ["t_us"], FIX, time_bucket("t_us"))
    first = F.coalesce("prev", F.struct(*FIX))
    return n.select("mmsi", first.t_us.alias("t0"), F.col("t_us").alias("t1"),
                    first.lat.alias("lat0"), F.col("lat").alias("lat1"),
                    first.lon.alias("lon0"), F.col("lon").alias("lon1"),
                    first.sog.alias("sog0"), F.col("sog").alias("sog1"))


def reports_for(ais: DataFrame, spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The reports that tracks need to be right inside the spans of time asked for (t_lo, t_hi; per vessel with ``by`` mmsi).

    Ranges of six hours that a span touches keep all their reports. Of every other range a vessel keeps its first and last report, found
    by map-side aggregation, since a silence may reach from there into a span. Vessels that nobody asks about are left out.
    What tracks say outside the spans is not meant to be read.
    """
    keys = [*by, "_bucket"]
    slots = F.sequence(F.floor(F.col("t_lo") / TRACK_BUCKET_US), F.floor(F.col("t_hi") / TRACK_BUCKET_US))
    asked = spans.select(*by, F.explode(slots).alias("_bucket")).distinct().withColumn("_asked", F.lit(True))
    d = ais.select("mmsi", *FIX).withColumn("_bucket", time_bucket("t_us"))
    if by:
        d = d.join(spans.select(*by).distinct(), list(by), "left_semi")
    # without vessels the list holds one row per six hours asked for; sorting all reports by so few keys would make hot tasks
    d = d.join(asked if by else F.broadcast(asked), keys, "left")
    fix = F.struct(*FIX)
    ends = d.filter("_asked is null").groupBy("mmsi", "_bucket").agg(F.min_by(fix, "t_us").alias("a"), F.max_by(fix, "t_us").alias("b"))
    ends = ends.select("mmsi", F.explode(F.array_distinct(F.array("a", "b"))).alias("f")).select("mmsi", "f.*")
    return d.filter("_asked").select("mmsi", *FIX).unionByName(ends)


def lerp(a: str, b: str, ts: Column) -> Column:
    f = F.when(F.col("t1") > F.col("t0"), (ts - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0)
    return F.col(a) + (F.col(b) - F.col(a)) * f


def covers(ts: Column) -> Column:
    """True for exactly one piece of a track: half-open on the left, plus the zero-length first piece."""
    return ((ts > F.col("t0")) & (ts <= F.col("t1"))) | ((ts == F.col("t0")) & (ts == F.col("t1")))


def position_at(ais: DataFrame, probes: DataFrame, ts: str = "ts_us", slot_us: int = SLOT_US) -> DataFrame:
    """Interpolated lat/lon/sog of each probe (mmsi, ts). Probes outside the track are dropped.

    Pieces are exploded to time slots, so the range join becomes a hash join on (mmsi, slot)
    and a hot vessel spreads over its slots.
    """
    spans = probes.select("mmsi", F.col(ts).alias("t_lo"), F.col(ts).alias("t_hi"))
    pieces = track_intervals(reports_for(ais, spans, ["mmsi"])).withColumn(
        "slot", F.explode(F.sequence(F.floor(F.col("t0") / slot_us), F.floor(F.col("t1") / slot_us))))
    t = F.col(ts)
    joined = probes.withColumn("slot", F.floor(t / slot_us)).join(pieces, ["mmsi", "slot"]).filter(covers(t))
    return joined.select(*probes.columns, lerp("lat0", "lat1", t).alias("lat"), lerp("lon0", "lon1", t).alias("lon"),
                         lerp("sog0", "sog1", t).alias("sog"))


def longest_transit(ais: DataFrame, min_kn: float = 5.0) -> DataFrame:
    """Longest sustained stretch above ``min_kn`` per vessel; ties keep the earliest."""
    r = runs(ais.select("mmsi", "t_us", "sog"), ["mmsi"], "t_us", F.col("sog") > min_kn,
             [F.avg("sog").alias("mean_sog")])
    dur = F.col("last_true") - F.col("run_start")
    best = r.groupBy("mmsi").agg(
        F.max_by(F.struct("run_start", "last_true", "mean_sog", "n_rows"), F.struct(dur, -F.col("run_start"))).alias("b"))
    return best.select("mmsi", F.col("b.run_start").alias("start_us"), F.col("b.last_true").alias("end_us"),
                       ((F.col("b.last_true") - F.col("b.run_start")) / 3.6e9).alias("hours"),
                       F.col("b.mean_sog").alias("mean_sog"), F.col("b.n_rows").alias("n_fixes"))


def decimate(ais: DataFrame, max_points: int = 240) -> DataFrame:
    """Every floor(n / max_points)-th vertex of each track, numbered without one task per vessel."""
    counts = ais.groupBy("mmsi", time_bucket("t_us").alias("_bucket")).agg(F.count(F.lit(1)).alias("n"))
    across = Window.partitionBy("mmsi").orderBy("_bucket")
    base = counts.select("mmsi", "_bucket",
                         (F.sum("n").over(across) - F.col("n")).alias("_before"),
                         F.sum("n").over(Window.partitionBy("mmsi")).alias("n_total"))
    local = Window.partitionBy("mmsi", "_bucket").orderBy("t_us", "event_id")
    numbered = (ais.withColumn("_bucket", time_bucket("t_us")).withColumn("_rn", F.row_number().over(local))
                .join(base, ["mmsi", "_bucket"])
                .withColumn("vertex", F.col("_before") + F.col("_rn") - 1))
    step = F.greatest(F.lit(1), F.floor(F.col("n_total") / max_points))
    return numbered.filter(F.col("vertex") % step == 0).select("mmsi", "vertex", "t_us", "lat", "lon")


def nearest_fix(ais: DataFrame, instant_us: Column, max_min: float = 30.0) -> DataFrame:
    """Per vessel the fix closest to an instant, if within ``max_min`` minutes."""
    d = F.abs(F.col("t_us") - instant_us)
    near = ais.filter(d <= max_min * 6e7)
    return near.groupBy("mmsi").agg(
        F.min_by(F.struct("event_id", "t_us", "lat", "lon"), F.struct(d, "event_id")).alias("f")).select("mmsi", "f.*")


def exposure_ranking(ais: DataFrame, bounds: tuple[float, float, float, float], min_fixes: int = 60,
                     min_run_h: float = 1.0, min_kn: float = 5.0, interior: float = 0.12,
                     cfg: Config = DEFAULT) -> DataFrame:
    """Oil-capable vessels whose longest transit stays in the interior, by duration x speed x (1 + length/100)."""
    x0, y0, x1, y1 = bounds
    dx, dy = (x1 - x0) * interior, (y1 - y0) * interior
    r = runs(ais.select("mmsi", "t_us", "sog", "lat", "lon"), ["mmsi"], "t_us", F.col("sog") > min_kn,
             [F.avg("sog").alias("mean_sog"), F.min("lat").alias("y0"), F.max("lat").alias("y1"),
              F.min("lon").alias("x0"), F.max("lon").alias("x1")])
    best = r.groupBy("mmsi").agg(F.max_by(
        F.struct("run_start", "last_true", "mean_sog", "x0", "y0", "x1", "y1"),
        F.struct(F.col("last_true") - F.col("run_start"), -F.col("run_start"))).alias("b")).select("mmsi", "b.*")
    meta = ais.groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("n_fixes"),
        F.min_by(F.struct("vessel_type", "length_m"), F.struct("t_us", "event_id")).alias("m")).select("mmsi", "n_fixes", "m.*")
    from driftwake.functions.vessel import oil_capable

    dur = F.col("last_true") - F.col("run_start")
    inside = (F.col("x0") > x0 + dx) & (F.col("x1") < x1 - dx) & (F.col("y0") > y0 + dy) & (F.col("y1") < y1 - dy)
    return (best.join(meta, "mmsi")
            .filter((F.col("n_fixes") >= min_fixes) & oil_capable(F.col("vessel_type"))
                    & (dur >= min_run_h * 3.6e9) & inside)
            .select("mmsi", "vessel_type", (dur / 3.6e9).alias("run_hours"), "mean_sog",
                    (dur / 1e6 * F.col("mean_sog") * (1.0 + F.coalesce("length_m", F.lit(0.0)) / 100.0)).alias("exposure")))
