"""Registered baseline, evaluation, matching, custody, catalogue, calibration and detectability queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.functions import radar, vessel
from driftwake.operators import baseline, custody, detectability, evaluation, matching, tracks
from driftwake.plans.fixtures import table
from driftwake.plans.queries_vessel import rounded

AREAS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)
CONTRASTS = (1.0, 2.0, 3.0, 5.0, 8.0, 12.0)
LIMIT_CELLS = [(a, c, round(min(1.0, max(0.0, 0.1 * k + 0.08 * c - 0.35)), 3)) for k, a in enumerate(AREAS) for c in CONTRASTS]


def _samples(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sigma0")


def _scored(s: SparkSession, d: str) -> DataFrame:
    x = _samples(s, d)
    stats = baseline.statistics(baseline.fold(None, baseline.scene_partials(x)))
    return baseline.anomaly_z(x, stats, baseline.robust_background(x))


def _fused(s: SparkSession, d: str) -> DataFrame:
    return baseline.fused(_scored(s, d), (F.col("l_orderkey") % 100) / 100.0)


def _chips(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chips")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    def run(p: str) -> DataFrame:
        return _chips(s, d).select("chip_id", F.when(F.col("target") == 1, F.col(p)).otherwise(1.0 - F.col(p)).alias("iou"))

    return evaluation.paired_deltas(run("prob_a"), run("prob_b"))


def _positions(s: SparkSession, d: str) -> DataFrame:
    ais = table(s, d, "ais")
    at = ais.select("mmsi").distinct().withColumn("ts_us", ais.agg(F.min("t_us") + 21_600_000_000).scalar())
    return tracks.position_at(ais, at).select(F.col("mmsi").alias("id"), "lat", "lon")


def _trials(s: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(s, d, "part").select(size.alias("area_km2"), (k % 6 + 1.0).alias("contrast_db"),
                                      ((k * 7919) % 100 < size + 10 * (k % 6)).alias("hit"), ((k * 31) % 100 / 100.0).alias("iou"))


def _digests(s: SparkSession, d: str) -> DataFrame:
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    base = o.select(F.col("o_custkey").alias("incident_id"), k.cast("string").alias("name"), k.alias("k"),
                    F.sha2(F.concat(F.floor("o_totalprice").cast("string"), F.lit(".0")), 256).alias("sha256"))
    present = base.filter("k % 10 <> 2").withColumn("sha256", F.when(F.col("k") % 7 == 3, "x").otherwise(F.col("sha256")))
    return custody.verify_digests(base.filter("k % 10 <> 1"), present)


def _new(s: SparkSession, d: str) -> DataFrame:
    from driftwake.operators.catalogue import unseen

    seen = table(s, d, "pages").filter("length(html) % 2 = 0").select(F.concat(F.lit("obs-"), F.col("page_id").cast("string")).alias("observation_id"))
    return unseen(table(s, d, "observations"), seen)


def _modes(s: SparkSession, d: str) -> DataFrame:
    from driftwake.operators.catalogue import mode_summary

    return mode_summary(table(s, d, "observations"))


def _calibration(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "calibration")
    r = radar.calibration_residuals(*[F.col(x) for x in ("k_sigma", "k_beta", "k_gamma", "incidence_deg")])
    tol = radar.CALIBRATION_TOLERANCE_DB
    ok = (r["beta_residual_db"] <= tol) & (r["gamma_residual_db"] <= tol)
    return rounded(c.select("scene_id", *[v.alias(k) for k, v in r.items()], ok.alias("is_consistent"),
                            radar.nesz_db(F.col("noise_bias"), F.col("k_sigma")).alias("nesz_db")), beta_residual_db=4, gamma_residual_db=4)


def _zone(s: SparkSession, d: str) -> DataFrame:
    t, sun = F.col("acq_us"), F.col("sun_elevation")
    utc = radar.solar_elevation(F.col("lat"), F.col("lon"), t)
    ist = radar.solar_elevation(F.col("lat"), F.col("lon"), t - radar.IST_OFFSET_US)
    ok = (F.abs(utc - sun) <= radar.SUN_TOLERANCE_DEG) & (F.abs(utc - sun) < F.abs(ist - sun))
    return rounded(table(s, d, "calibration").select("scene_id", utc.alias("as_utc_deg"), ist.alias("as_ist_deg"), ok.alias("is_utc")), 4)


def _assessed(s: SparkSession, d: str) -> DataFrame:
    return detectability.assess(table(s, d, "requests"), LIMIT_CELLS)


QUERIES = {
    "baseline_fold": lambda s, d: rounded(baseline.scene_partials(_samples(s, d)), 4),
    "baseline_stats": lambda s, d: rounded(baseline.statistics(baseline.scene_partials(_samples(s, d))), std=5),
    "robust_background": lambda s, d: rounded(baseline.robust_background(_samples(s, d))),
    "baseline_z": lambda s, d: rounded(_scored(s, d), z=4).select("scene_id", "cell", "wind_bin", "v", "z", "mode"),
    "fused_confidence": lambda s, d: rounded(_fused(s, d), confidence=5).select("scene_id", "cell", "v", "confidence"),
    "anomaly_summary": lambda s, d: rounded(baseline.anomaly_summary(_fused(s, d), 0.3), mean_in_mask=5, max_confidence=5),
    "wind_gate_share": lambda s, d: rounded(_samples(s, d).groupBy("scene_id").agg(
        F.min("wind_ms").alias("wind_min_ms"), F.max("wind_ms").alias("wind_max_ms"), F.avg("wind_ms").alias("wind_mean_ms"),
        F.avg(F.col("wind_ms").between(3, 10).cast("double")).alias("fraction_in_band"))),
    "confusion_by_sensor": lambda s, d: evaluation.confusion_by_sensor(_chips(s, d)),
    "metrics_by_sensor": lambda s, d: rounded(evaluation.metrics(evaluation.confusion_by_sensor(_chips(s, d)))).drop("tn", "fp", "fn", "tp"),
    "threshold_sweep": lambda s, d: rounded(evaluation.threshold_sweep(_chips(s, d))).drop("tn", "fp", "fn", "tp"),
    "run_comparison": lambda s, d: rounded(evaluation.compare_runs(_chips(s, d))),
    "paired_delta_summary": lambda s, d: rounded(evaluation.delta_summary(_pairs(s, d))),
    "best_and_worst": lambda s, d: rounded(evaluation.extremes(_pairs(s, d))).select("chip_id", "delta", "side"),
    "band_report": lambda s, d: rounded(evaluation.band_report(_chips(s, d)), weight=9),
    "band_weights": lambda s, d: rounded(evaluation.band_weights(_chips(s, d)), weight=9).select("chip_id", "band", "weight"),
    "weighted_fraction": lambda s, d: rounded(evaluation.weighted_fraction(evaluation.band_weights(_chips(s, d)))),
    "split_bucket": lambda s, d: evaluation.splits(_chips(s, d)).select("chip_id", "sensor", "bucket", "split"),
    "split_overlap": lambda s, d: evaluation.split_overlap(evaluation.splits(_chips(s, d))),
    "stratified_subset": lambda s, d: evaluation.stratified_subset(_chips(s, d), 40).select("chip_id", "sensor"),
    "detection_surface": lambda s, d: rounded(evaluation.detection_rate_surface(_trials(s, d))),
    "headline_minima": lambda s, d: evaluation.headline_minima(evaluation.detection_rate_surface(
        _trials(s, d).withColumn("area_km2", F.col("area_km2").cast("bigint")))),
    "nearest_vessel": lambda s, d: rounded(matching.nearest_other(_positions(s, d)), km=4),
    "neighbour_distribution": lambda s, d: rounded(matching.neighbour_distribution(matching.nearest_other(_positions(s, d))), 4),
    "sar_ais_match": lambda s, d: rounded(matching.match_targets(table(s, d, "targets"), table(s, d, "ais")), 4),
    "track_separation": lambda s, d: rounded(matching.track_separation(table(s, d, "ais")), 4),
    "audit_links": lambda s, d: custody.broken_links(table(s, d, "audit"), genesis="0"),
    "audit_bodies": lambda s, d: custody.broken_bodies(table(s, d, "audit")),
    "audit_newest": lambda s, d: custody.newest_entries(table(s, d, "audit")),
    "digest_verify": _digests,
    "catalogue_new": _new,
    "catalogue_modes": _modes,
    "detectability": lambda s, d: rounded(_assessed(s, d), pixels_on_target=4),
    "first_detection": lambda s, d: rounded(detectability.first_detection(_assessed(s, d))),
    "size_classes": lambda s, d: table(s, d, "requests").select("request_id", vessel.size_class(F.col("area_km2")).alias("size_class")),
    "calibration_check": _calibration,
    "timestamp_zone_check": _zone,
}
