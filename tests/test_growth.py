"""Work that must not grow faster than the input: exploded rows are never broadcast, cells are not sought per cell."""

import datetime
import math
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from driftwake.config import Config
from driftwake.functions import geo
from driftwake.operators import attribution, baseline, custody, detectability, environment, matching, shore
from driftwake.plans import fixtures
from driftwake.plans import queries_attribution as qa

HOUR = 3_600_000_000
ENV = "field_id long, ti long, yi long, xi long, t_us long, lat double, lon double, wind_u double, wind_v double, curr_u double, curr_v double"
AIS = "mmsi long, t_us long, lat double, lon double, sog double"
RING = "incident_id long, hours_back long, t_us long, ring array<struct<k:long,x:double,y:double>>"


def stored(spark, folder, rows, schema):
    """Rows as a small file, whose size Spark knows."""
    spark.createDataFrame(rows, schema).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_fields_are_not_broadcast(spark, tmp_path):
    grid = [(1, 0, y, x, 0, float(y), float(x), 1.0 + x, 2.0, 0.1, 0.2) for y in range(3) for x in range(3)]
    env = stored(spark, tmp_path / "env", grid, ENV)
    probes = stored(spark, tmp_path / "probes", [(1, 0, 0.5, 0.5)], "field_id long, ts_us long, lat double, lon double")
    sampled = environment.sample_env(env, probes)
    assert "BroadcastHashJoin" not in plan(sampled)
    assert "BroadcastHashJoin" not in plan(environment.env_summary(env, probes.select("field_id", "ts_us")))
    assert [round(r.wind_u, 9) for r in sampled.collect()] == [1.5]


def test_exploded_probes_and_rings_are_not_broadcast(spark, tmp_path):
    ais = stored(spark, tmp_path / "ais", [(1, 0, 0.0, -1.0, 5.0), (1, 2 * HOUR, 0.0, 1.0, 5.0)], AIS)
    square = [(0, -0.5, -0.5), (1, 0.5, -0.5), (2, 0.5, 0.5), (3, -0.5, 0.5)]
    hits = attribution.envelope_hits(ais, stored(spark, tmp_path / "rings", [(7, 1, HOUR, square)], RING))
    assert not re.search(r"BroadcastHashJoin \[(slot|incident_id)", plan(hits))
    assert [(r.incident_id, r.mmsi) for r in hits.collect()] == [(7, 1)]


def brute_hits(tracks, rings):
    """First matching offset of every (incident, hour, vessel), by trying all."""
    def inside(ring, x, y):
        odd = False
        for (_, px, py), (_, qx, qy) in zip(ring, ring[1:] + ring[:1]):
            odd ^= (py > y) != (qy > y) and x < (qx - px) / (qy - py) * (y - py) + px
        return odd

    out = {}
    for inc, hours, t, ring in rings:
        for mmsi, fixes in tracks.items():
            for off in (-30, -15, 0, 15, 30):
                ts = t + off * 60_000_000
                at = next(((a, b) for a, b in zip([fixes[0], *fixes], fixes) if a[0] < ts <= b[0] or a[0] == b[0] == ts), None)
                if at is None:
                    continue
                (t0, lat0, lon0), (t1, lat1, lon1) = at
                f = (ts - t0) / (t1 - t0) if t1 > t0 else 0.0
                lat, lon = lat0 + (lat1 - lat0) * f, lon0 + (lon1 - lon0) * f
                if inside(ring, lon, lat):
                    out.setdefault((inc, hours, mmsi), ts)
                    break
    return out


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_hits_of_an_incident_are_found_in_one_task(spark, batch, monkeypatch):
    """Tracks that leap and stop, rings that are not convex, a vessel over many batches, incidents split over blocks; matches are never shuffled."""
    rnd = random.Random(11)
    tracks = {m: sorted((rnd.randrange(0, 30 * HOUR), rnd.uniform(14, 17), rnd.uniform(68, 71)) for _ in range(rnd.choice([1, 2, 9]))) for m in range(1, 40)}
    tracks[77] = sorted((rnd.randrange(0, 30 * HOUR), rnd.uniform(15, 16), rnd.uniform(69, 70)) for _ in range(150))
    rings = []
    for inc in range(12):
        cx, cy, t = rnd.uniform(68.5, 70.5), rnd.uniform(14.5, 16.5), rnd.randrange(20 * HOUR, 28 * HOUR)
        for h in range(1, 6):
            star = [(k, round(cx + rnd.uniform(0.1, 0.9) * math.cos(k * math.pi / 6), 6), round(cy + rnd.uniform(0.1, 0.9) * math.sin(k * math.pi / 6), 6)) for k in range(12)]
            rings.append((inc, h, t - h * HOUR, star))
    want = brute_hits(tracks, rings)
    odd = [(None, 1, HOUR, rings[0][3]), (99, None, HOUR, rings[0][3]), (99, 1, None, rings[0][3]), (99, 1, HOUR, None)]
    ais = [(m, t, lat, lon, None if t % 5 == 0 else float(t % 3)) for m, fixes in tracks.items() for t, lat, lon in fixes]
    ais, steps = spark.createDataFrame([*ais, (None, HOUR, 15.0, 69.0, 1.0), (500, None, 15.0, 69.0, 1.0), (501, HOUR, None, None, 1.0)], AIS), spark.createDataFrame(rings + odd, RING)
    monkeypatch.setattr(attribution.blocks, "__defaults__", (300,))
    monkeypatch.setattr(attribution.meeting, "PLACES", 200)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        hits = attribution.envelope_hits(ais, steps)
        got = [(r.incident_id, r.hours_back, r.mmsi, r.hit_us) for r in hits.collect()]
        rolled = attribution.candidate_rollup(hits, together=True)
        alone = sorted(map(tuple, attribution.candidate_rollup(hits).collect()))
        assert sorted(map(tuple, rolled.collect())) == alone and rolled.dtypes == attribution.candidate_rollup(hits).dtypes
        first = attribution.top_candidates(rolled, Config(max_candidates=3)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(got) == len(want) > 100 and {g[:3]: g[3] for g in got} == want
    assert sorted((r.incident_id, r.cand_rank, r.mmsi) for r in first) == [
        (inc, k + 1, r[1]) for inc in sorted({r[0] for r in alone}) for k, r in enumerate(sorted((r for r in alone if r[0] == inc), key=lambda r: (-r[3], -r[2], r[1]))[:3])]
    assert "Exchange" not in plan(rolled)[:plan(rolled).index("_block")]


def test_every_candidate_of_an_incident_is_ranked(spark):
    """Twenty vessels pass one incident's polygons and have a release each: all of them are ranked."""
    day = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    with tempfile.TemporaryDirectory() as d:
        _tables(spark, d, day)
        names = ("posterior_rank", "top_candidates", "gap_coincidence")
        got = {n: qa.QUERIES[n](spark, d).collect() for n in names}
    assert len({r.mmsi for r in got["posterior_rank"]}) == len(got["posterior_rank"]) > 12
    assert sorted(r["rank"] for r in got["posterior_rank"]) == list(range(1, len(got["posterior_rank"]) + 1))
    assert abs(sum(r.posterior for r in got["posterior_rank"]) - 1.0) < 1e-4
    assert len(got["top_candidates"]) == 12


def _tables(spark, d, day):
    """One supplier downdrift of where twenty vessels (a multiple of 4000 apart in number) start together, with an order line for each."""
    users = [4000 * v for v in range(20)]
    events = [(1000 * v + k, day + datetime.timedelta(minutes=60 * 20 * k), u) for v, u in enumerate(users) for k in range(40)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(0, 3, 100.0)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(u, 0, k) for u in users for k in (1, 2)], "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")


def test_fixes_meet_the_boxes_as_runs(spark):
    rnd = random.Random(5)
    fixes = [(rnd.randrange(8), rnd.randrange(0, 30 * HOUR), rnd.uniform(14, 17), rnd.uniform(68, 71), 1.0) for _ in range(400)]
    fixes += [(100, 10 * HOUR, 15.0, 68.9, 1.0), (101, 10 * HOUR, 15.0, 70.71, 1.0), (None, 10 * HOUR, 15.0, 70.0, 1.0), (102, None, 15.0, 70.0, 1.0)]
    boxes = [(k, 20 * HOUR + k * HOUR // 3, rnd.uniform(68.5, 70.5), rnd.uniform(14.5, 16.5)) for k in range(20)] + [(50, 20 * HOUR, 69.9, 15.0)]
    ais, inc = spark.createDataFrame(fixes, AIS), spark.createDataFrame(boxes, "incident_id long, acq_us long, cx double, cy double")
    got = attribution.in_scene(ais, inc)
    want = {(k, m) for k, t, x, y in boxes for m, u, lat, lon, _ in fixes
            if u is not None and x - 0.8 <= lon <= x + 0.8 and y - 0.8 <= lat <= y + 0.8 and t - 18 * HOUR <= u <= t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    logical = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in logical and logical.index("Join") < logical.index("collect_list")  # fixes are gathered below the join


def test_largest_area_is_not_sought_for_every_cell(spark):
    surface = spark.createDataFrame([(1.0, 1.0, 0.2), (5.0, 1.0, 0.6), (5.0, 3.0, 0.9)], "area_km2 double, contrast_db double, detection_rate double")
    asked = spark.createDataFrame([(4.0, 2.9), (900.0, 0.0), (0.0, 0.0)], "area double, contrast double")
    d = asked.withColumn("cells", detectability.measured_cells(surface)).select(
        "area", detectability.measured_rate(F.col("cells"), F.col("area"), F.col("contrast")).alias("m"))
    cell = re.search(r"struct\(da,.*?dc,", d._jdf.queryExecution().optimizedPlan().toString(), re.S).group()
    assert "array_max" not in cell
    assert [r.m.r for r in d.collect()] == [0.9, 0.6, 0.2]


def test_shore_is_met_by_cells_however_dense(spark):
    n, ring = 20_000, [(k, 0.02 + 0.9 * math.cos(k / 4), 0.31 + 0.7 * math.sin(k / 4)) for k in range(25)]
    coast = spark.range(n).select(F.col("id").alias("seg_id"), *[(0.05 * F.sin(9.0 * (F.col("id") + d) / n)).alias(f"x{i}") if a == "x" else (4.0 * (F.col("id") + d) / n - 2).alias(f"y{i}")
                                                                 for i, d in ((1, 0), (2, 1)) for a in "xy"])
    levels = shore.shore_levels(coast)
    assert len(levels) > len(shore.LEVELS)
    poly = spark.createDataFrame([(1, ring)], "incident_id long, ring array<struct<k:long,x:double,y:double>>")
    edges = [(x1, y1, x2, y2, (x2 - x1) / (y2 - y1)) for (_, x1, y1), (_, x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)]
    met = shore.shore_met(spark.createDataFrame([(1, edges, -0.9, 1.0, -0.4, 1.1)], "incident_id long, edges array<struct<x1:double,y1:double,x2:double,y2:double,g:double>>, "
                                                "x0 double, x9 double, y0 double, y9 double"), shore.shore_tree(coast, levels), ["incident_id"])
    assert 0 < met.filter("km is null").count() < 20 and met.count() < 200  # 7,000 segments lie inside
    inside = coast.withColumns({"x": F.col("x1") / 2 + F.col("x2") / 2, "y": F.col("y1") / 2 + F.col("y2") / 2}).crossJoin(poly).filter(
        geo.point_in_ring(F.col("ring"), F.col("x"), F.col("y"))).agg(F.sum(geo.segment_m(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")))).first()[0]
    assert shore.affected_shore(poly, coast).first().affected_km == pytest.approx(inside / 1000, abs=0.03)


def test_only_told_stations_get_a_bearing(spark):
    rnd = random.Random(3)
    told = [(i, role, f"R{i % 3}", rnd.uniform(8, 20), rnd.uniform(68, 80), tier) for i, (role, tier) in enumerate(
        [("NATIONAL_HQ", 3), ("REGION_HQ", 2), ("REGION_HQ", 1)] + [("STATION", 1 + i % 2) for i in range(12)])]
    told.append((99, *told[5][1:]))  # a tie goes to the lesser id
    stations = spark.createDataFrame(told, "station_id long, role string, region string, lat double, lon double, tier_min long")
    alerts = spark.createDataFrame([(k, rnd.uniform(8, 20), rnd.uniform(66, 78), 1 + k % 3) for k in range(9)], "incident_id long, lat double, lon double, tier long")
    d = shore.recipients(alerts, stations)
    lines = d._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("ATAN2" in line and "transform(" in line for line in lines)
    got = {(r.incident_id, r.station_id): r for r in d.collect()}
    assert all(sum(k == i for k, _ in got) <= 6 for i in range(9))
    pairs = alerts.crossJoin(stations.withColumnsRenamed({"lat": "slat", "lon": "slon"})).filter("tier_min <= tier").select(
        "incident_id", "station_id", "role", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")), 1).alias("km"),
        F.round(geo.bearing_deg(F.col("slat"), F.col("slon"), F.col("lat"), F.col("lon")), 1).alias("b")).collect()
    for i in range(9):
        near = sorted((r.km, r.station_id) for r in pairs if r.incident_id == i and r.role == "STATION")
        mine = sorted((r.distance_km, r.station_id) for (k, _), r in got.items() if k == i and r.role == "STATION")
        assert mine and mine == near[:len(mine)]
    want = {(r.incident_id, r.station_id): (r.km, r.b) for r in pairs}
    assert all((r.distance_km, r.bearing_deg) == want[k] for k, r in got.items())


def test_audit_view_is_linked_range_by_range(spark, tmp_path):
    rows = [(k, k % 7, "F" if k % 5 else None) for k in range(1, 900, 3)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    d = fixtures.table(spark, str(tmp_path), "audit")
    assert not re.search(r"lag\([^)]*\) windowspecdefinition\(seq", d._jdf.queryExecution().optimizedPlan().toString())  # as over all entries at once
    split = fixtures._audit(spark.sql("select o_orderkey seq, o_custkey incident_id, concat('body-', o_orderkey, '-', o_orderstatus) body from {o}",
                                      o=spark.read.parquet(str(tmp_path / "orders.parquet"))), 50)
    whole = spark.sql(fixtures._dialect(fixtures.VIEWS["audit"], spark=True), orders=spark.read.parquet(str(tmp_path / "orders.parquet")))
    for got in (d, split):
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(*got.columns).collect()))
    spark.createDataFrame([r for r in rows for _ in "12"], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "twice" / "orders.parquet"))
    twice = fixtures.table(spark, str(tmp_path / "twice"), "audit").filter("prev_hash <> 'broken' and body is not null")
    assert custody.broken_links(twice, genesis="0").count() < 150  # about the rows left out above and their like, not every repeated number


def test_samples_are_dealt_before_they_are_summed(spark, monkeypatch):
    monkeypatch.setattr(baseline, "TASK_SAMPLES", 10)
    rows = [(k % 9, k % 4, float(k % 11), float(k % 5)) for k in range(120)] + [(None, 1, None, 2.0), (3, None, 4.0, None)]
    samples = spark.createDataFrame(rows, "scene_id long, cell long, wind_ms double, v double")
    partials = baseline.scene_partials(samples)
    lines = partials._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert lines[0].startswith("Aggregate") and "RepartitionByExpression" in lines[1] and lines[1].rstrip().endswith(" 13")  # 122 samples, ten a task
    got = baseline.statistics(partials).collect()
    assert sum(r.n for r in got) == 121 and all(r.scenes <= 9 for r in got)
    want = {c: sum(1 for _, cell, _, v in rows if cell == c and v is not None) for c in (0, 1, 2, 3)}
    assert {c: sum(r.n for r in got if r.cell == c) for c in want} == want


def test_crowded_water_adds_finer_levels(spark):
    rnd = random.Random(11)
    rows = [(v * 100 + k, v, k * HOUR // 8, 15.0 + rnd.uniform(0, 0.01), 70.0 + rnd.uniform(0, 0.01), 9.0) for v in range(40) for k in range(20)]
    fixes = spark.createDataFrame(rows, "event_id long, mmsi long, t_us long, lat double, lon double, sog double")
    levels = matching.crowd_levels(fixes, (0.05, 1.0, 180.0), HOUR)
    assert levels[-3:] == (0.05, 1.0, 180.0) and levels[0] <= 0.002
    assert matching.crowd_levels(fixes.limit(5), (0.05, 1.0, 180.0), HOUR) == (0.05, 1.0, 180.0)
    assert matching.crowd_levels(fixes.limit(0), (0.05, 180.0), HOUR) == (0.05, 180.0)
    km = {r.mmsi: round(r.separation_km, 6) for r in matching.track_separation(fixes).collect()}
    coarse = {r.mmsi: round(r.separation_km, 6) for r in matching.track_separation(fixes, levels=(180.0,)).collect()}
    assert km == coarse and len(km) == 40
