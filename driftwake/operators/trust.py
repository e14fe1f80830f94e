"""Trust flags: is a vessel's report consistent with itself and with physics?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwake.config import DEFAULT, Config
from driftwake.functions import geo, vessel
from driftwake.operators.ordered import neighbours, time_bucket
from driftwake.operators.tracks import static_by_vessel, with_segments


def checked_segments(ais: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Segments with the per-segment verdicts every vessel-level rule aggregates."""
    t = cfg.trust
    s = with_segments(ais)
    reported = (F.col("prev.sog") + F.col("sog")) / 2.0
    off = F.abs(F.col("derived_kn") - reported)
    steady = F.abs(F.col("sog") - F.col("prev.sog")) <= t.manoeuvre_sog_delta_kn
    accel = (F.abs(F.col("derived_kn") - F.col("derived_kn_before")) * geo.KN_TO_MS
             / F.greatest(F.col("dt_s"), F.lit(1.0)))
    return s.select(
        "mmsi", "t_us", "lat", "lon", "dt_s", "dist_m", "derived_kn",
        F.col("prev.t_us").alias("prev_us"), F.col("prev.lat").alias("prev_lat"), F.col("prev.lon").alias("prev_lon"),
        reported.alias("reported_kn"), off.alias("disagreement_kn"), accel.alias("accel_ms2"),
        F.coalesce((off > t.sog_disagreement_kn) & steady, F.lit(False)).alias("is_disagree"),
        F.coalesce(F.col("derived_kn") > t.teleport_kn, F.lit(False)).alias("is_teleport"),
        F.coalesce(accel > t.max_acceleration_ms2, F.lit(False)).alias("is_accel"),
        F.coalesce(F.col("dt_s") > t.ais_gap_min * 60.0, F.lit(False)).alias("is_gap"))


def sog_disagreement(ais: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    bad = checked_segments(ais, cfg).filter("is_disagree")
    return (bad.groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("segments"),
        F.max_by(F.struct("t_us", "reported_kn", "derived_kn"), F.struct("disagreement_kn", -F.col("t_us"))).alias("w"))
        .filter("segments >= 2").select("mmsi", "segments", "w.*"))


def teleports(ais: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    bad = checked_segments(ais, cfg).filter("is_teleport")
    return (bad.groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("segments"),
        F.max_by(F.struct("t_us", (F.col("dist_m") / 1000.0).alias("jump_km"), "dt_s", "derived_kn"),
                 F.struct("derived_kn", -F.col("t_us"))).alias("w")).select("mmsi", "segments", "w.*"))


def impossible_acceleration(ais: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    bad = checked_segments(ais, cfg).filter("is_accel")
    return (bad.groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("segments"),
        F.max_by(F.struct("t_us", "accel_ms2"), F.struct("accel_ms2", -F.col("t_us"))).alias("w"))
        .select("mmsi", "segments", "w.*"))


def first_gap_flags(ais: DataFrame, keep: int = 3, cfg: Config = DEFAULT) -> DataFrame:
    """The first ``keep`` silences of each vessel."""
    gaps = checked_segments(ais, cfg).filter("is_gap").select("mmsi", "prev_us", "prev_lat", "prev_lon", "dt_s")
    w = Window.partitionBy("mmsi").orderBy("prev_us")
    return (gaps.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)
            .select("mmsi", "rn", F.col("prev_us").alias("at_us"), (F.col("dt_s") / 60.0).alias("minutes"),
                    F.col("prev_lat").alias("lat"), F.col("prev_lon").alias("lon")))


def duplicate_positions(ais_raw: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Vessels whose first same-instant pair of fixes lies more than 1 km apart."""
    n = neighbours(ais_raw.select("mmsi", "t_us", "event_id", "lat", "lon"), ["mmsi"], ["t_us", "event_id"],
                   ["t_us", "lat", "lon"], time_bucket("t_us"))
    pairs = n.filter(F.col("t_us") <= F.col("prev.t_us")).select(
        "mmsi", "t_us", "event_id",
        (geo.segment_m(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon")) / 1000.0).alias("apart_km"))
    return (pairs.groupBy("mmsi").agg(F.min_by(F.struct("t_us", "apart_km"), F.struct("t_us", "event_id")).alias("p"))
            .select("mmsi", "p.*").filter(F.col("apart_km") > cfg.trust.duplicate_km))


def mid_flag_check(ais: DataFrame) -> DataFrame:
    """Declared flag against the identity digits, for vessels that declare one."""
    m = static_by_vessel(ais, "flag").filter("flag is not null")
    expected = vessel.registered_flag(F.col("mmsi"))
    code = (F.when(expected.isNotNull() & (expected != F.col("flag")), "MID_FLAG_MISMATCH")
            .when(expected.isNull() & vessel.mid_of(F.col("mmsi")).isNotNull(), "UNKNOWN_MID"))
    return m.select("mmsi", "flag", expected.alias("expected"), code.alias("code")).filter("code is not null")


def trust_scores(ais: DataFrame, duplicates: DataFrame | None = None, cfg: Config = DEFAULT, radar: DataFrame | None = None) -> DataFrame:
    """Per-vessel trust: codes, penalty score, classification and prior, in one aggregation over segments.

    ``duplicates`` (mmsi, see ``duplicate_positions``) raises DUPLICATE_MMSI; ``radar`` (mmsi, radar_matched, see ``matching.radar_evidence``)
    makes a vessel that its scenes do not show a PHANTOM, unless its identity is in conflict. Without them neither can come out.
    """
    t = cfg.trust
    seg = checked_segments(ais, cfg).groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("n_fixes"), F.count_if("is_disagree").alias("n_disagree"),
        F.count_if("is_teleport").alias("n_teleport"), F.count_if("is_accel").alias("n_accel"),
        F.count_if("is_gap").alias("n_gap"))
    mid = mid_flag_check(ais).select("mmsi", F.col("code").alias("mid_code"))
    joined = seg.join(mid, "mmsi", "left")
    if duplicates is None:
        joined = joined.withColumn("dup", F.lit(False))
    else:
        joined = joined.join(duplicates.select("mmsi", F.lit(True).alias("dup")), "mmsi", "left").withColumn(
            "dup", F.coalesce("dup", F.lit(False)))
    if radar is None:
        joined = joined.withColumn("radar_matched", F.lit(None).cast("boolean"))
    else:
        joined = joined.join(radar.select("mmsi", "radar_matched"), "mmsi", "left")
    full = F.col("n_fixes") >= 3

    def raised(cond, code):
        return F.when(cond, code)

    codes = F.array_compact(F.array(
        raised(~full, "SPARSE_TRACK"),
        raised(full & (F.col("n_disagree") >= 2), "SOG_DISAGREEMENT"),
        raised(full & (F.col("n_teleport") > 0), "POSITION_TELEPORT"),
        raised(full & (F.col("n_accel") > 0), "IMPOSSIBLE_ACCELERATION"),
        raised(full, F.col("mid_code")),
        raised(full & (F.col("n_gap") > 0), "AIS_GAP"),
        raised(F.col("dup"), "DUPLICATE_MMSI")))
    d = joined.withColumn("codes", codes)

    def has(code):
        return F.array_contains("codes", code).cast("int")

    n_info = has("SPARSE_TRACK") + has("UNKNOWN_MID")
    n_warn = has("SOG_DISAGREEMENT") + F.when(F.array_contains("codes", "AIS_GAP"), F.least("n_gap", F.lit(3))).otherwise(0)
    n_crit = (has("POSITION_TELEPORT") + has("IMPOSSIBLE_ACCELERATION") + has("MID_FLAG_MISMATCH")
              + has("DUPLICATE_MMSI"))
    penalty = n_info * t.cost_info + n_warn * t.cost_warn + n_crit * t.cost_critical
    identity = F.arrays_overlap(F.col("codes"), F.array(
        F.lit("MID_FLAG_MISMATCH"), F.lit("DUPLICATE_MMSI"), F.lit("POSITION_TELEPORT")))
    d = d.select("mmsi", "n_fixes", "codes", n_warn.alias("n_warn"), n_crit.alias("n_critical"),
                 F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - penalty)).alias("score"),
                 vessel.classify(identity, F.coalesce("radar_matched", F.lit(True))).alias("classification"))
    return d.withColumn("trust_prior",
                        vessel.trust_prior(F.col("classification"), F.col("n_critical"), F.col("n_warn"), cfg))


def identity_mismatches(scores: DataFrame) -> DataFrame:
    """The vessels whose identity is in conflict, with what was raised against them."""
    return scores.filter(F.col("classification") == "IDENTITY_MISMATCH").select("mmsi", "codes", "score", "trust_prior")


def unexpected_flags(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """(mmsi, code) raised but not among the ``expected`` ones."""
    return scores.select("mmsi", F.explode("codes").alias("code")).join(expected.select("mmsi", "code"), ["mmsi", "code"], "left_anti")


def trust_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(F.size("codes") > 0).alias("flagged"),
        F.count_if(F.col("classification") == "IDENTITY_MISMATCH").alias("identity_mismatches"))
