"""Scenes, radar evidence and trust: two scenes, mutual nearest, phantoms only inside footprints, duplicates reaching the prior."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwake.operators import detectability, matching, tracks, trust

HOUR = 3_600_000_000
AIS = "mmsi long, t_us long, lat double, lon double, sog double, event_id long, flag string, cog double"
SCENE = "scene_id long, acq_us long, x0 double, y0 double, x1 double, y1 double"
TARGET = "scene_id long, target_id long, lat double, lon double"


def still(mmsi, lat, lon, hours=6, step=600_000_000):
    return [(mmsi, t, lat, lon, 0.0, mmsi * 1000 + i, None, None) for i, t in enumerate(range(0, hours * HOUR, step))]


def test_a_vessel_is_judged_anew_in_every_scene(spark):
    rows = still(1, 15.0, 70.0) + still(2, 15.5, 70.5) + still(3, 19.0, 75.0) + still(4, 15.0, 70.005)
    ais = spark.createDataFrame(rows, AIS)
    scenes = spark.createDataFrame([(10, HOUR, 69.5, 14.5, 71.0, 16.0), (11, 3 * HOUR, 69.5, 14.5, 70.2, 15.2), (12, 50 * HOUR, 69.5, 14.5, 71.0, 16.0)], SCENE)
    targets = spark.createDataFrame([(10, 100, 15.001, 70.0), (10, 101, 15.8, 70.8), (11, 102, 15.0, 70.006), (11, 103, 15.0, 70.0061), (12, 104, 15.0, 70.0), (13, 105, 15.0, 70.0)], TARGET)
    got = {(r.scene_id, r.target_id, r.mmsi, r.classification) for r in matching.match_scenes(targets, scenes, ais).collect()}
    assert got == {(10, 100, 1, "MATCHED"), (10, 101, None, "DARK"), (10, None, 2, "PHANTOM"), (10, None, 4, "PHANTOM"),
                   (11, 102, 4, "MATCHED"), (11, 103, None, "DARK"), (11, None, 1, "PHANTOM"), (12, 104, None, "DARK"), (13, 105, None, "DARK")}
    seen = {r.mmsi: (r.radar_matched, r.n_matched, r.n_phantom) for r in matching.radar_evidence(matching.match_scenes(targets, scenes, ais)).collect()}
    assert seen == {1: (True, 1, 1), 2: (False, 0, 1), 4: (True, 1, 1)}  # vessel 3 lies in no footprint and is not judged


def test_vessel_outside_the_footprint_can_match_but_is_no_phantom(spark):
    ais = spark.createDataFrame(still(1, 15.0, 69.99) + still(2, 15.0, 69.0), AIS)
    scenes = spark.createDataFrame([(1, HOUR, 70.0, 14.0, 71.0, 16.0)], SCENE)
    near = spark.createDataFrame([(1, 7, 15.0, 70.001)], TARGET)
    assert [tuple(r) for r in matching.match_scenes(near, scenes, ais).select("target_id", "mmsi", "classification").collect()] == [(7, 1, "MATCHED")]
    assert matching.match_scenes(near.limit(0), scenes, ais).count() == 0


def test_scenes_of_an_instant_share_the_positions(spark):
    ais = spark.createDataFrame(still(1, 15.0, 70.0) + still(2, 15.5, 70.5), AIS)
    scenes = spark.createDataFrame([(i, HOUR, 69.5, 14.5, 71.0, 16.0) for i in range(30)], SCENE)
    listed = matching.scene_cells(matching.scene_boxes(scenes))
    assert matching.positions_at(listed, ais).count() == 2 and matching.footprint_positions(scenes, ais).count() == 60


def test_scene_targets_equal_their_view(spark):
    from driftwake.plans import fixtures

    rng = np.random.default_rng(4)
    ais = [(int(i), None if i == 9 else 100 + int(rng.integers(0, 40)), int(rng.integers(0, 40)) * 60_000_000, 15 + float(rng.random()), None if i == 8 else 70 + float(rng.random())) for i in range(600)]
    ais = spark.createDataFrame(ais + ais[:50], "event_id long, mmsi long, t_us long, lat double, lon double")
    boxes = [(i, int(rng.integers(0, 40)) * 60_000_000, 70 + float(rng.random()) / 2, 15 + float(rng.random()) / 2) for i in range(40)]
    boxes = [(i, t, x, y, x + 0.4, y + 0.4) for i, t, x, y in boxes]
    scenes = spark.createDataFrame(boxes + boxes[:5] + [(6, 600_000_000, 70.0, 15.0, 71.0, 16.0), (50, None, 70.0, 15.0, 71.0, 16.0), (51, 0, 71.0, 15.0, 70.0, 16.0)], SCENE)
    want = spark.sql(fixtures._dialect(fixtures.VIEWS["scene_targets"], spark=True), ais=ais, scenes=scenes).collect()
    got = fixtures._scene_targets(ais, scenes)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and got.columns == list(want[0].asDict())


def test_reference_match_stores_no_pairs(spark, monkeypatch):
    rng, stored, keep = np.random.default_rng(5), [], matching.checkpoint
    det, truth = ([(1, int(i), float(r), float(c)) for i, (r, c) in enumerate(rng.random((8, 2)))] for _ in range(2))
    monkeypatch.setattr(matching, "checkpoint", lambda d: stored.append(keep(d)) or stored[-1])
    schema = "scene_id long, {} long, row double, col double"
    got = matching.greedy_reference_match(spark.createDataFrame(det, schema.format("det_id")), spark.createDataFrame(truth, schema.format("truth_id")), 30.0)
    free, want = {d[1]: d for d in det}, set()
    for _, t, r, c in truth:
        near = min(free.values(), key=lambda d: ((d[2] - r) ** 2 + (d[3] - c) ** 2, d[1]))
        want.add((t, near[1]))
        del free[near[1]]
    assert {(r.truth_id, r.det_id) for r in got.collect()} == want
    assert max(d.count() for d in stored) <= 16  # 64 pairs lie within the tolerance


def test_duplicates_and_radar_reach_the_prior(spark):
    base = [r for m in (419000001, 419000002, 419000003) for r in still(m, 15.0, 70.0)]
    raw = spark.createDataFrame(base + [(419000001, HOUR, 15.4, 70.0, 0.0, 9_999_999_999_999, None, None)], AIS)
    ais = spark.createDataFrame(base, AIS)
    radar = spark.createDataFrame([(419000001, False), (419000002, False), (419000003, True)], "mmsi long, radar_matched boolean")
    dup = trust.duplicate_positions(raw)
    got = {r.mmsi: r for r in trust.trust_scores(ais, dup, radar=radar).collect()}
    assert got[419000001].classification == "IDENTITY_MISMATCH" and "DUPLICATE_MMSI" in got[419000001].codes
    assert got[419000002].classification == "PHANTOM" and got[419000003].classification == "MATCHED"
    assert got[419000001].trust_prior > got[419000002].trust_prior == got[419000003].trust_prior
    assert [r.mmsi for r in trust.identity_mismatches(trust.trust_scores(ais, dup, radar=radar)).collect()] == [419000001]
    assert {r.classification for r in trust.trust_scores(ais).collect()} == {"MATCHED"}
    expected = spark.createDataFrame([(419000001, "DUPLICATE_MMSI")], "mmsi long, code string")
    assert trust.unexpected_flags(trust.trust_scores(ais, dup), expected).count() == 0
    assert trust.unexpected_flags(trust.trust_scores(ais, dup), expected.limit(0)).count() == 1


def test_targets_and_dwell_are_ordered(spark):
    t = spark.createDataFrame([(1, 5, 9.0, 4), (1, 6, 9.0, 7), (1, 7, 10.0, 1), (2, 8, 1.0, 1)], "scene_id long, target_id long, peak_intensity double, pixels long")
    assert [(r.scene_id, r.rank, r.target_id) for r in matching.strongest_targets(t, 2).orderBy("scene_id", "rank").collect()] == [(1, 1, 7), (1, 2, 6), (2, 1, 8)]
    rows = [(m, i * HOUR, 15.0, 70.0 + off, s, m * 100 + i, None, None) for m, n, off, s in ((1, 3, 0.1, 5.0), (2, 3, 0.0, 5.0), (3, 5, 0.4, 5.0), (4, 9, 0.0, 0.2)) for i in range(n)]
    got = tracks.dwell_ranking(spark.createDataFrame(rows, AIS), 69.5, 14.5, 70.5, 15.5).orderBy("rank")
    assert [r.mmsi for r in got.collect()] == [3, 2, 1]


def test_measured_surface_sets_the_rate(spark):
    surface = spark.createDataFrame([(1.0, 3.0, 0.2), (1.0, 8.0, 0.9), (7.0, 8.0, 1.0)], "area_km2 double, contrast_db double, detection_rate double")
    req = spark.createDataFrame([(1, 1.2, 7.0, 0.0, 1.0, 100.0)], "request_id long, area_km2 double, contrast_db double, cloud_fraction double, daylight_fraction double, persistence_hours double")
    cells = detectability.measured_cells(surface)
    assert detectability.assess(req, cells).filter(F.col("sensor") == "EOS-04").first().measured_rate == pytest.approx(0.9)
    classes = {r.size_class: r for r in detectability.compare_size_classes(req, cells).collect()}
    assert set(classes) == {"large", "medium", "small"} and classes["large"].first_sensor == "INSAT-3DS"


def test_offers_in_rounds_equal_one_by_one(spark):
    import math
    import random

    rng = random.Random(6)
    det = [(s, i, rng.uniform(0, 40), rng.uniform(0, 40)) for s in range(3) for i in range(40)]
    truth = [(s, i, rng.uniform(0, 40), rng.uniform(0, 40)) for s in range(3) for i in range(50)]
    want, used = set(), set()
    for s, t, r, c in sorted(truth):
        near = min(((math.hypot(r - y, c - x), i) for z, i, y, x in det if z == s and (s, i) not in used), default=(99.0, 0))
        if near[0] <= 6.0:
            used.add((s, near[1]))
            want.add((s, t, near[1]))
    schema = "scene_id long, {} long, row double, col double"
    got = matching.greedy_reference_match(spark.createDataFrame(det, schema.format("det_id")), spark.createDataFrame(truth, schema.format("truth_id")))
    assert {(r.scene_id, r.truth_id, r.det_id) for r in got.collect()} == want


def test_small_slicks_keep_a_cell(spark):
    from driftwake.operators import polygons

    ring = [(70.0001, 15.0001), (70.0011, 15.0001), (70.0011, 15.0011)]
    d = spark.createDataFrame([(1, ring), (2, [(0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1)])], "slick_id long, ring array<struct<x:double,y:double>>")
    got = polygons.cell_cover(d, 0.02).groupBy("slick_id").count().collect()
    assert {r.slick_id: r["count"] for r in got} == {1: 1, 2: 25}


def test_hex_cells_are_even_and_nest(spark):
    from driftwake.functions import hexgrid

    d = spark.range(200_000).select((F.asin(F.rand(1) * 2 - 1) * 57.29577951308232).alias("lat"), (F.rand(2) * 360 - 180).alias("lon"))
    n = d.groupBy(hexgrid.hex_cell(F.col("lat"), F.col("lon"), 1).alias("cell")).count()
    inner = n.filter(F.abs(hexgrid.hex_centre(F.col("cell"), 1)[0]) < 40).agg(F.avg("count")).first()[0]
    assert inner == pytest.approx(200_000 * hexgrid.cell_area_km2(1) / 510_065_000, rel=0.1)
    cell = hexgrid.hex_cell(F.col("lat"), F.col("lon"), 8)
    lat, lon = hexgrid.hex_centre(F.col("cell"), 8)
    c = d.limit(5000).select("lat", "lon", cell.alias("cell")).withColumns({"la": lat, "lo": lon})
    assert c.filter(hexgrid.hex_cell(F.col("la"), F.col("lo"), 8) != F.col("cell")).count() == 0
    assert c.select(hexgrid.hex_level(F.col("cell"))).distinct().first()[0] == 8
    up = c.select(hexgrid.hex_level(hexgrid.hex_parent(F.col("cell"), 8))).distinct().collect()
    assert [r[0] for r in up] == [7]
    assert c.filter(F.abs(F.sin(F.radians("lat")) - F.sin(F.radians("la"))) * 6371.0088 > hexgrid.edge_km(8) * 1.0001).count() == 0


def test_quantiles_by_refined_ranges(spark):
    import numpy as np

    from driftwake.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(3)
    groups = {0: rng.lognormal(0, 3, 3001), 1: np.array([5.0]), 2: np.full(50, -2.5), 3: np.array([1e-300, 1e300, -1e300, 0.0, 7.0]), 4: rng.normal(size=400)}
    d = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [(0, None), (9, None)], "g long, v double").repartition(5)
    probs = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = {r.g: r for r in exact_quantiles(d, "v", probs, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g].n == len(xs) and got[g]["max"] == xs.max()
        assert got[g].quantiles == pytest.approx(np.quantile(xs, probs).tolist(), rel=1e-12)
    assert exact_quantiles(d.limit(0), "v", probs).count() == 0
    assert matching.neighbour_distribution(d.limit(0).withColumnRenamed("v", "km")).first().n == 0


def test_separation_is_not_capped_and_needs_company(spark):
    def line(m, lat, n, lon=70.0, sog=9.0):
        return [(m, i * 60_000_000, lat + i * 0.004, lon, sog, m * 1000 + i, None, None) for i in range(n)]

    d = spark.createDataFrame(line(1, 10.0, 60) + line(2, 10.6, 60) + line(3, 10.0, 2, 75.0) + line(4, 40.0, 60, 10.0), AIS)
    got = {r.mmsi: r for r in matching.track_separation(d).collect()}
    assert 40 < got[1].separation_km < 67 and got[1].samples == 30
    assert (got[3].samples, got[3].separation_km) == (0, 0.0) and got[4].separation_km > 4000
    alone = matching.track_separation(spark.createDataFrame(line(1, 10.0, 60) + line(2, 10.6, 4), AIS)).collect()
    assert {r.mmsi: r.separation_km for r in alone}[1] == 999.0


def test_pruned_reports_give_the_same_positions(spark):
    """Probes far apart, silences that reach over whole ranges of time, and vessels nobody asks about."""
    import numpy as np

    rng = np.random.default_rng(14)
    rows, tracks_of = [], {}
    for m in range(8):
        t = np.unique(np.concatenate([rng.integers(0, 400 * HOUR, 40), rng.integers(100 * HOUR, 103 * HOUR, 30)]))
        lat, lon = np.cumsum(rng.normal(0, 0.05, len(t))) + 15, np.cumsum(rng.normal(0, 0.05, len(t))) + 70
        tracks_of[m] = (t, lat, lon)
        rows += [(m, int(a), float(b), float(c), 5.0, m * 1000 + i, None, None) for i, (a, b, c) in enumerate(zip(t, lat, lon, strict=True))]
    ais = spark.createDataFrame(rows, AIS)
    probes = [(m, int(x)) for m in range(6) for x in rng.integers(0, 400 * HOUR, 12)]
    got = {(r.mmsi, r.ts_us): (r.lat, r.lon) for r in tracks.position_at(ais, spark.createDataFrame(probes, "mmsi long, ts_us long")).collect()}
    want = {(m, x): (float(np.interp(x, tracks_of[m][0], tracks_of[m][1])), float(np.interp(x, tracks_of[m][0], tracks_of[m][2]))) for m, x in probes if tracks_of[m][0][0] <= x <= tracks_of[m][0][-1]}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)
    span = spark.createDataFrame([(101 * HOUR, 102 * HOUR)], "t_lo long, t_hi long")
    kept = tracks.reports_for(ais, span).count()
    inside = sum(96 * HOUR <= t < 102 * HOUR + 6 * HOUR for m in range(8) for t in tracks_of[m][0].tolist())
    assert kept < len(rows) and kept >= inside - 8 * 40
