"""Registered queries on scenes and evidence: targets by scene, trust with radar and duplicates, measured detection limits, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.functions import hexgrid
from driftwake.operators import baseline, detectability, evaluation, matching, tracks, trust
from driftwake.plans import queries_quality as qq
from driftwake.plans.fixtures import table
from driftwake.plans.queries_vessel import joined, rounded
from driftwake.session import checkpoint


def _matches(s: SparkSession, d: str) -> DataFrame:
    return matching.match_scenes(table(s, d, "scene_targets"), table(s, d, "scenes"), table(s, d, "ais"))


def _trust(s: SparkSession, d: str) -> DataFrame:
    return trust.trust_scores(table(s, d, "ais"), trust.duplicate_positions(table(s, d, "ais_raw")), radar=matching.radar_evidence(_matches(s, d)))


def _unexpected(s: SparkSession, d: str) -> DataFrame:
    """Expected are the anomalies that the reports were given: one code for each kind of vessel."""
    i = F.col("mmsi") % 100_000
    code = F.when(i % 11 == 3, "POSITION_TELEPORT").when(i % 5 == 0, "SOG_DISAGREEMENT").otherwise("AIS_GAP")
    expected = table(s, d, "ais").select("mmsi").distinct().withColumn("code", code)
    return trust.unexpected_flags(_trust(s, d), expected)


def _cells(s: SparkSession, d: str):
    return detectability.measured_cells(checkpoint(evaluation.detection_rate_surface(qq._trials(s, d))))


def _reference_match(s: SparkSession, d: str) -> DataFrame:
    """Scene pixels of 0.002 degrees: detections are the targets, truths the vessels' positions in the footprints."""
    scenes = table(s, d, "scenes")
    det = table(s, d, "scene_targets").join(scenes, "scene_id").select("scene_id", F.col("target_id").alias("det_id"), ((F.col("y1") - F.col("lat")) * 500.0).alias("row"), ((F.col("lon") - F.col("x0")) * 500.0).alias("col"))
    truth = matching.footprint_positions(scenes, table(s, d, "ais")).join(scenes, "scene_id").select(
        "scene_id", F.col("mmsi").alias("truth_id"), ((F.col("y1") - F.col("lat")) * 500.0).alias("row"), ((F.col("lon") - F.col("x0")) * 500.0).alias("col"))
    return matching.greedy_reference_match(det, truth, 30.0)


LEVEL = 7


def _sea_cells(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sigma0_at").withColumn("cell", hexgrid.hex_cell(F.col("lat"), F.col("lon"), LEVEL))


def _cell_roll_up(s: SparkSession, d: str) -> DataFrame:
    """Reports per cell and per parent: fine cells are counted first, so the coarse count reads one row a cell."""
    c = hexgrid.hex_cell(F.col("lat"), F.col("lon"), LEVEL)
    fine = table(s, d, "ais").groupBy(c.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    parent = hexgrid.hex_parent(F.col("cell"), LEVEL)
    return fine.groupBy(parent.alias("parent")).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("reports"))


QUERIES = {
    "hex_index": lambda s, d: table(s, d, "ais").select("event_id", hexgrid.hex_cell(F.col("lat"), F.col("lon"), LEVEL).alias("cell")),
    "hex_parents": _cell_roll_up,
    "hex_baseline": lambda s, d: rounded(baseline.statistics(baseline.fold(None, baseline.scene_partials(_sea_cells(s, d)))).select("cell", "wind_bin", "n", "scenes", "mean", "std"), std=5),
    "scene_match": lambda s, d: rounded(_matches(s, d), 4),
    "scene_positions": lambda s, d: rounded(matching.footprint_positions(table(s, d, "scenes"), table(s, d, "ais")).drop("inside")),
    "radar_evidence": lambda s, d: matching.radar_evidence(_matches(s, d)),
    "reference_match": lambda s, d: rounded(_reference_match(s, d), 4),
    "strongest_targets": lambda s, d: matching.strongest_targets(table(s, d, "scene_targets")),
    "trust_evidence": lambda s, d: rounded(_trust(s, d)).select("mmsi", "n_fixes", "score", "classification", "trust_prior", joined()),
    "identity_mismatches": lambda s, d: rounded(trust.identity_mismatches(_trust(s, d))).select("mmsi", "score", "trust_prior", joined()),
    "unexpected_flags": _unexpected,
    "dwell_ranking": lambda s, d: rounded(tracks.dwell_ranking(table(s, d, "ais"), 69.0, 16.0, 71.5, 18.5)),
    "detectability_measured": lambda s, d: rounded(detectability.assess(table(s, d, "requests"), _cells(s, d)), pixels_on_target=4),
    "size_class_comparison": lambda s, d: rounded(detectability.compare_size_classes(table(s, d, "requests"), _cells(s, d))),
}
