"""Registered track, trust and behaviour queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.functions import vessel
from driftwake.operators import behaviour, tracks, trust
from driftwake.plans.fixtures import table


# Durations divide whole microseconds; these digits can never fall on a rounding tie.
_DURATIONS = {"hours": 10, "run_hours": 10, "dwell_h": 10, "age_hours": 10, "minutes": 9, "duration_min": 9}


def rounded(df: DataFrame, default: int = 6, **places: int) -> DataFrame:
    """Fix the printed precision of double columns."""
    places = {**_DURATIONS, **places}
    return df.select(*[F.round(c, places.get(c, default)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def joined(codes: str = "codes") -> Column:
    return F.array_join(codes, ",").alias(codes)


def _ais(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ais")


def _typed(ais: DataFrame) -> DataFrame:
    return ais.withColumn("vessel_type", vessel.vessel_type_label(F.col("type_code")))


def _mid_instant(ais: DataFrame) -> Column:
    return ais.agg(F.min("t_us") + 21_600_000_000).scalar()


QUERIES = {
    "ais_gaps": lambda s, d: rounded(tracks.find_gaps(tracks.drop_duplicate_broadcasts(table(s, d, "ais_raw")))),
    "dedup_broadcasts": lambda s, d: tracks.drop_duplicate_broadcasts(table(s, d, "ais_raw")),
    "feed_summary": lambda s, d: rounded(tracks.feed_summary(_ais(s, d))),
    "top_types": lambda s, d: tracks.top_values(_ais(s, d), vessel.vessel_type_label(F.col("type_code")), 8),
    "top_flags": lambda s, d: tracks.top_values(_ais(s, d), vessel.flag_from_mmsi(F.col("mmsi")), 5),
    "type_decode": lambda s, d: _typed(_ais(s, d)).select("event_id", "mmsi", "type_code", "vessel_type"),
    "flag_decode": lambda s, d: _ais(s, d).select(
        "event_id", "mmsi", vessel.flag_from_mmsi(F.col("mmsi")).alias("flag_iso"), vessel.imo_number(F.col("imo_text")).alias("imo")),
    "bbox_scan": lambda s, d: tracks.in_bbox(_ais(s, d), 69.0, 16.0, 71.5, 18.5).select("event_id", "mmsi", "t_us", "lat", "lon"),
    "segment_kinematics": lambda s, d: rounded(tracks.segment_kinematics(_ais(s, d)), dist_m=4, derived_kn=4),
    "teleports": lambda s, d: rounded(trust.teleports(_ais(s, d)), jump_km=4, derived_kn=4),
    "sog_disagreement": lambda s, d: rounded(trust.sog_disagreement(_ais(s, d)), 4),
    "impossible_acceleration": lambda s, d: rounded(trust.impossible_acceleration(_ais(s, d)), 4),
    "gap_flags": lambda s, d: rounded(trust.first_gap_flags(_ais(s, d))).withColumn("rn", F.col("rn").cast("bigint")),
    "duplicate_positions": lambda s, d: rounded(trust.duplicate_positions(table(s, d, "ais_raw")), 4),
    "mid_flag_check": lambda s, d: trust.mid_flag_check(_ais(s, d)),
    "trust_scores": lambda s, d: rounded(trust.trust_scores(_ais(s, d))).select(
        "mmsi", "n_fixes", "score", "classification", "trust_prior", joined()),
    "trust_summary": lambda s, d: trust.trust_summary(trust.trust_scores(_ais(s, d))),
    "speed_reduction_runs": lambda s, d: rounded(behaviour.speed_reduction_runs(_ais(s, d)), mean_sog=4, median_sog=4),
    "course_deviation_runs": lambda s, d: rounded(behaviour.course_deviation_runs(_ais(s, d)), mean_deviation=4),
    "longest_transit": lambda s, d: rounded(tracks.longest_transit(_ais(s, d)), mean_sog=4),
    "loiter": lambda s, d: rounded(behaviour.loiter(_ais(s, d)), mean_sog=4, net_km=4),
    "night_share": lambda s, d: rounded(behaviour.night_share(_ais(s, d))),
    "behaviour_priors": lambda s, d: rounded(behaviour.behaviour_priors(_ais(s, d), _gap_vessels(s, d))).select(
        "mmsi", "behaviour_prior", joined()),
    "low_speed_coverage": lambda s, d: rounded(behaviour.low_speed_coverage(_ais(s, d)), 4),
    "underway_predicate": lambda s, d: rounded(behaviour.vessel_norms(_ais(s, d))).select(
        "mmsi", "n_fixes", "underway_fraction",
        ((F.col("n_fixes") >= 12) & (F.col("underway_fraction") >= 0.05)).alias("is_eligible")),
    "track_decimate": lambda s, d: tracks.decimate(_ais(s, d), 20),
    "nearest_fix": lambda s, d: (lambda a: tracks.nearest_fix(a, _mid_instant(a)))(_ais(s, d)),
    "aoi_dwell": lambda s, d: rounded(tracks.dwell_in_bbox(_ais(s, d), 69.0, 16.0, 71.5, 18.5)),
    "exposure_ranking": lambda s, d: rounded(tracks.exposure_ranking(
        _typed(_ais(s, d)), (68.0, 15.0, 73.0, 20.0), min_fixes=30), mean_sog=4, exposure=2),
}


def _gap_vessels(spark: SparkSession, d: str) -> DataFrame:
    return trust.trust_scores(_ais(spark, d)).filter(F.array_contains("codes", "AIS_GAP")).select("mmsi")
