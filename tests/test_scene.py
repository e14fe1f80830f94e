"""Rasters, polygons, baselines, metrics, alerts and custody on hand-made edge cases."""

import json
import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwake.config import Config, PriorConfig
from driftwake.functions import geo
from driftwake.operators import attribution, baseline, components, custody, evaluation, overlay, polygons, raster, shore
from driftwake.sources import contracts, readers, writers

XY = "array<struct<x:double,y:double>>"


def ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


def test_point_in_ring_handles_notches(spark):
    notch = ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))
    d = spark.createDataFrame([(notch, 2.0, 0.5), (notch, 2.0, 3.0), (notch, 0.5, 2.0), (notch, 9.0, 1.0), (ring((0, 0), (1, 1), (2, 2)), 1.0, 1.5)],
                              f"r {XY}, x double, y double")
    assert [r[0] for r in d.select(geo.point_in_ring(F.col("r"), F.col("x"), F.col("y"))).collect()] == [True, False, True, False, False]


@pytest.mark.parametrize("conn", [4, 8])
def test_components_equal_flood_fill(spark, conn):
    rnd = random.Random(conn)
    on = {(s, r, c) for s in range(2) for r in range(40) for c in range(40) if rnd.random() < 0.45}
    got = {(x.scene_id, x.row_id, x.col_id): x.label for x in components.label(
        spark.createDataFrame(sorted(on), "scene_id long, row_id long, col_id long"), conn, tile=7).collect()}
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    want, seen = {}, set()
    for p in sorted(on):
        if p in seen:
            continue
        seen.add(p)
        todo, comp = deque([p]), []
        while todo:
            s, r, c = todo.popleft()
            comp.append((s, r, c))
            for dr, dc in steps:
                q = (s, r + dr, c + dc)
                if q in on and q not in seen:
                    seen.add(q)
                    todo.append(q)
        low = min(r * (1 << 24) + c for _, r, c in comp)
        want.update({q: low for q in comp})
    assert got == want


def test_tiles_cover_every_pixel(spark):
    g = raster.tile_grid(spark.createDataFrame([(1, 700, 513), (2, 100, 100)], "scene_id long, ny long, nx long")).collect()
    cover = np.zeros((700, 513))
    for t in (t for t in g if t.scene_id == 1):
        assert t.y1 - t.y0 == 512 and t.x1 - t.x0 == 512
        cover[t.y0:t.y1, t.x0:t.x1] += 1
    assert cover.min() >= 1 and [(t.y0, t.y1) for t in g if t.scene_id == 2] == [(0, 100)]


def test_unpacked_tiles_keep_values(spark):
    t = spark.createDataFrame([(1, 0, 0, 2, 3, 10, 20, bytearray([0, 1, 2, 253, 254, 255]))], "scene_id long, ty long, tx long, h int, w int, y0 long, x0 long, data binary")
    assert [(r.row_id, r.col_id, r.dn) for r in readers.unpack_tiles(t).orderBy("row_id", "col_id").collect()] == [
        (10, 20, 0), (10, 21, 1), (10, 22, 2), (11, 20, 253), (11, 21, 254), (11, 22, 255)]


def test_baseline_needs_fifteen_scenes(spark):
    rows = [(s, cell, 4.0, -20.0) for cell, n in ((1, 14), (2, 15)) for s in range(n)]
    df = spark.createDataFrame(rows, "scene_id long, cell long, wind_ms double, v double")
    store = baseline.scene_partials(df)
    assert baseline.fold(store, store).count() == 0
    first, second = (baseline.scene_partials(df.withColumn("part", F.lit(p))) for p in (1, 2))
    assert baseline.fold(first, second).count() == second.count() and baseline.fold(first.unionByName(second), second).count() == 0
    stats = baseline.statistics(store)
    assert {r.cell: (r.scenes, round(r.std, 9)) for r in stats.collect()} == {1: (14, round(math.sqrt(1e-9), 9)), 2: (15, round(math.sqrt(1e-9), 9))}
    z = baseline.anomaly_z(df, stats, baseline.robust_background(df))
    assert {(r.cell, r["mode"]) for r in z.collect()} == {(1, "global_fallback"), (2, "local")}


@pytest.mark.parametrize("conf,want", [((10, 0, 0, 0), (0.0, 1.0, 1.0)), ((0, 0, 5, 0), (0.0, 0.0, 0.0)), ((5, 0, 0, 5), (1.0, 1.0, 1.0))])
def test_metrics_zero_over_zero(spark, conf, want):
    r = evaluation.metrics(spark.createDataFrame([conf], "tn long, fp long, fn long, tp long")).first()
    assert (r.oil_iou, r.background_iou, r.mean_iou) == want


def test_softmax_order_and_guards(spark):
    best = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.9), (2, 12, 0.4)], "incident_id long, mmsi long, score double")
    priors = spark.createDataFrame([(10, 1.0, 1.0, "Tanker"), (11, 1.0, 1.0, None)], "mmsi long, trust_prior double, behaviour_prior double, vessel_type string")
    gaps = spark.createDataFrame([], "incident_id long, mmsi long")
    off = spark.createDataFrame([], "mmsi long, n_offences long")
    r = {x.mmsi: x for x in attribution.rank_posteriors(best, priors, gaps, off).collect()}
    assert r[12].posterior == 1.0 and r[10].likelihood == r[11].likelihood == 0.5
    assert r[10].posterior == pytest.approx(1.4 / 2.4) and r[10]["rank"] == 1
    with pytest.raises(ValueError):
        attribution.rank_posteriors(best, priors, gaps, off, Config(priors=PriorConfig(temperature=0.0)))


@pytest.mark.parametrize("area,eta,want", [(24.99, None, 1), (25.0, None, 2), (149.99, None, 2), (150.0, None, 3), (1.0, 24.0, 3), (1.0, 24.01, 2), (1.0, 72.0, 2), (1.0, 72.01, 1)])
def test_tier_boundaries(spark, area, eta, want):
    d = spark.createDataFrame([(1, area, 5.0, eta is not None, eta)], "incident_id long, area_km2 double, closest_km double, shore_contact boolean, eta_hours double")
    assert shore.tier(d).first().tier == want


@pytest.mark.parametrize("series,want", [([0, 0], 0.0), ([10, 0], 9.0), ([20, 10, 0], 18.0), ([20, 14, 0], 18.0), ([20, 22, 0], 15.0), ([20, 10, 5], None), ([30, 20, 4, 0], 19.5)])
def test_shore_eta_rules(spark, series, want):
    d = spark.createDataFrame([(1, 6 * (i + 1), float(km), 1.0) for i, km in enumerate(series)], "incident_id long, horizon_hours long, distance_km double, area_km2 double")
    assert shore.shore_eta(d).first().eta_hours == (pytest.approx(want) if want is not None else None)


def test_affected_shore_cuts_at_the_border(spark):
    sq = spark.createDataFrame([(1, ring((0, 0), (1, 0), (1, 1), (0, 1)))], f"incident_id long, ring {XY}")
    coast = spark.createDataFrame([(1, -0.5, 0.5, 0.5, 0.5), (2, 0.5, 0.5, 0.75, 0.5), (3, 2.0, 0.5, 3.0, 0.5)], "seg_id long, x1 double, y1 double, x2 double, y2 double")
    assert shore.affected_shore(sq, coast).first().affected_km == pytest.approx(0.75 * 111.32, rel=2e-3)
    far = sq.unionByName(spark.createDataFrame([(2, ring((50, 50), (51, 50), (51, 51)))], sq.schema))
    assert {r.incident_id: r.affected_km > 0 for r in shore.affected_shore(far, coast).collect()} == {1: True, 2: False}


def test_iou_of_shifted_squares(spark):
    a = spark.createDataFrame([(1, ring((0, 0), (1, 0), (1, 1), (0, 1)))], f"i long, ring {XY}")
    b = spark.createDataFrame([(1, ring((0.5, 0), (1.5, 0), (1.5, 1), (0.5, 1)))], f"i long, ring {XY}")
    both = overlay.polygon_overlap(a.withColumn("j", F.lit(1)), b.withColumn("k", F.lit(1)), "i", "j", "k")
    assert both.first().iou == pytest.approx(1 / 3, rel=1e-12)


def test_land_clip_keeps_a_cover_that_would_vanish(spark):
    c = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 5, 5)], "i long, cx long, cy long")
    land = spark.createDataFrame([(0, 1), (5, 5)], "cx long, cy long")
    assert sorted((r.i, r.cx, r.cy) for r in polygons.off_land(c, land, ["i"]).collect()) == [(1, 0, 0), (2, 5, 5)]


def test_audit_chain_append_and_tamper(spark):
    new = spark.createDataFrame([(1, s, f"b{s}") for s in range(5)], "log_id long, seq long, body string")
    log = custody.append_entries(new, spark.createDataFrame([], "log_id long, chain_hash string")).withColumn("incident_id", F.lit(1)).cache()
    assert custody.broken_links(log, ("log_id",), bucket=2).count() == 0
    assert custody.broken_bodies(log).count() == 0
    assert [r.seq for r in custody.broken_bodies(log.withColumn("body", F.when(F.col("seq") == 3, "x").otherwise(F.col("body")))).collect()] == [3]
    bad = log.withColumn("chain_hash", F.when(F.col("seq") == 2, "0").otherwise(F.col("chain_hash")))
    assert [r.seq for r in custody.broken_links(bad, ("log_id",), bucket=2).collect()] == [3]


def test_canonical_hash_ignores_key_order(spark):
    d = spark.createDataFrame([('{"a":1,"b":[2,{"d":1,"c":2}]}',), ('{ "b": [2, {"c": 2, "d": 1}], "a": 1 }',), ("plain",)], "t string")
    h = [r[0] for r in d.select(custody.canonical_json_sha256("t")).collect()]
    assert h[0] == h[1] != h[2]


def test_files_read_and_written(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mmsi,base_date_time,longitude,latitude,sog,cog,heading,vessel_name,imo,vessel_type,length\n"
                                    "419000001,2024-01-01T00:00:05,70.5,15.5,3.0,,,X,IMO9000001,80,120\n419000001,2024-01-01 00:01:05,99.5,15.5,3.0,10,20,X,,31,\n")
    r = readers.read_report_csv(spark, str(tmp_path / "a.csv"), (70, 15, 71, 16)).collect()
    assert len(r) == 1 and (r[0].imo, r[0].vessel_type, r[0].flag, r[0].cog, r[0].t_us) == (9000001, "Tanker", "IN", None, 1_704_067_205_000_000)
    (tmp_path / "g").mkdir()
    sq = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    docs = {"f": {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [sq]}}, "c": {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [sq]]}}]}, "p": {"type": "Polygon", "coordinates": [sq]}}
    for k, v in docs.items():
        (tmp_path / "g" / f"{k}.geojson").write_text(json.dumps(v))
    areas = [x[0] for x in readers.read_polygons(spark, str(tmp_path / "g")).select(geo.ring_area(F.col("ring"))).collect()]
    assert areas == [4.0, 4.0, 4.0]
    (tmp_path / "g" / "audit.log").write_text("x")
    m = readers.file_manifest(spark, str(tmp_path / "g"))
    assert {x.name for x in m.collect()} == {"f.geojson", "c.geojson", "p.geojson"}
    line = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1], [2, 1]]}}]})
    assert readers.line_segments(spark.createDataFrame([(line,)], "value string")).count() == 2
    meta = readers.product_metadata(spark.createDataFrame([("p", "A=1"), ("p", "B = x=y"), ("p", "junk")], "path string, value string")).first().meta
    assert meta == {"A": "1", "B": "x=y"}
    t = spark.createDataFrame([("05-FEB-2025 13:11:02.250",)], "s string").select(F.unix_micros(readers.product_time(F.col("s")))).first()[0]
    assert t == 1_738_761_062_250_000
    ais = spark.createDataFrame([(1, 1, 1_704_067_205_000_000, 1.0, 2.0, 3.0)], "event_id long, mmsi long, t_us long, lat double, lon double, sog double")
    writers.write_reports(ais, str(tmp_path / "out"))
    back = readers.read_report_parquet(spark, str(tmp_path / "out")).collect()
    assert back[0].mmsi == 1 and str(back[0].day) == "2024-01-01"
    feats = writers.features(ais.withColumn("r", F.lit(None).cast("string")), writers.point_geometry(F.col("lon"), F.col("lat")), "mmsi", "r")
    assert json.loads(feats.first().value) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [2.0, 1.0]}, "properties": {"mmsi": 1, "r": None}}


def test_contracts_reject_and_quarantine(spark):
    d = spark.createDataFrame([(1, 0, 95.0, 0.0, 5.0, 10.0), (2, 0, 9.0, 0.0, None, None)], "mmsi long, t_us long, lat double, lon double, sog double, cog double")
    ok, bad = contracts.split_valid(d, contracts.AIS_RULES)
    assert [r.mmsi for r in ok.collect()] == [2] and bad.first().violations == ["lat_range"]
    with pytest.raises(ValueError, match="missing required columns"):
        contracts.require_columns(d, ["nope"])
    with pytest.raises(ValueError, match="outside its contract"):
        contracts.reject_unknown(d, ["mmsi"])


def test_overlap_of_every_pair(spark):
    def box(x0, x1):
        return [(0, x0, 0.0), (1, x1, 0.0), (2, x1, 1.0), (3, x0, 1.0)]

    ring = "ring array<struct<k:int,x:double,y:double>>"
    a = spark.createDataFrame([(1, 3, box(0.0, 1.0)), (1, 4, box(0.5, 1.5)), (2, 6, box(0.0, 1.0))], "incident_id long, slick_id long, " + ring)
    b = spark.createDataFrame([(1, 1, box(0.0, 1.0)), (1, 2, box(5.0, 6.0)), (2, 1, box(0.0, 2.0))], "incident_id long, hours_back long, " + ring)
    got = {(r.slick_id, r.hours_back): round(r.iou, 2) for r in overlay.polygon_overlap(a, b, "incident_id", "slick_id", "hours_back").collect()}
    assert got == {(3, 1): 1.0, (3, 2): 0.0, (4, 1): 0.33, (4, 2): 0.0, (6, 1): 0.5}


def test_all_steps_and_detections_are_registered(spark):
    from driftwake.plans import catalog
    from driftwake.plans.fixtures import table

    sf, q = "/root/testdata/sf0.001", catalog.queries()
    steps, slicks = (table(spark, sf, t).select(*k).distinct() for t, k in (("step_edges", ("incident_id", "hours_back")), ("slick_points", ("incident_id", "slick_id"))))
    assert q["coast_distance_all"](spark, sf).count() == steps.count() > 0
    assert q["polygon_iou_all"](spark, sf).count() == steps.join(slicks, "incident_id").count() > 0
