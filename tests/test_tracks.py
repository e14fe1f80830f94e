"""Row-order operators against plain single-partition windows and sequential brute force, with a hot vessel."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftwake.functions import vessel
from driftwake.operators import behaviour, matching, ordered, tracks, trust

MIN = 60_000_000
T0 = 1_700_000_000_000_000


def fixes(spark, rows):
    """(mmsi, minute, lat, lon, sog) to a report table."""
    return spark.createDataFrame(
        [(i, m, T0 + int(t * MIN), float(la), float(lo), float(s)) for i, (m, t, la, lo, s) in enumerate(rows)],
        "event_id long, mmsi long, t_us long, lat double, lon double, sog double")


@pytest.fixture(scope="module")
def busy(spark):
    """One vessel with two thirds of all rows, irregular spacing, plus small ones."""
    rnd, rows = random.Random(3), []
    for m, n in ((111, 1500), (222, 400), (333, 1), (444, 2), (555, 300)):
        t = 0.0
        for _ in range(n):
            t += rnd.choice((0.5, 1, 2, 3, 20, 70))
            rows.append((m, t, 10 + rnd.random(), 70 + rnd.random(), rnd.choice((0.2, 1.0, 4.0, 9.0))))
    return fixes(spark, rows).cache()


def test_neighbours_equal_plain_windows(busy):
    w = Window.partitionBy("mmsi").orderBy("t_us")
    want = busy.select("mmsi", "t_us", F.lag("t_us", 1).over(w).alias("p"), F.lag("t_us", 2).over(w).alias("p2"), F.lead("t_us", 1).over(w).alias("n"))
    got = ordered.neighbours(busy, ["mmsi"], ["t_us"], ["t_us"], ordered.time_bucket("t_us", 25 * MIN)).select(
        "mmsi", "t_us", "prev.t_us", "prev2.t_us", "next.t_us")
    assert sorted(map(str, got.collect())) == sorted(str(r).replace("p2=", "t_us=").replace("p=", "t_us=").replace("n=", "t_us=") for r in want.collect())


@pytest.mark.parametrize("width", [25 * MIN, 6 * 60 * MIN])
def test_runs_equal_sequential(busy, width):
    got = {(r.mmsi, r.run_start, r.run_end, r.last_true, r.n_rows) for r in ordered.runs(
        busy.select("mmsi", "t_us", "sog"), ["mmsi"], "t_us", F.col("sog") > 3, width_us=width).collect()}
    want, by = set(), {}
    for r in busy.collect():
        by.setdefault(r.mmsi, []).append((r.t_us, r.sog > 3))
    for m, seq in by.items():
        seq.sort()
        i = 0
        while i < len(seq):
            if seq[i][1]:
                j = i
                while j + 1 < len(seq) and seq[j + 1][1]:
                    j += 1
                want.add((m, seq[i][0], seq[min(j + 1, len(seq) - 1)][0], seq[j][0], j - i + 1))
                i = j
            i += 1
    assert got == want


@pytest.mark.parametrize("chunk_h", [1, 6, 48])
def test_hop_chain_equals_sequential(busy, chunk_h):
    got = {(r.mmsi, r.node_us) for r in behaviour.hop_nodes(busy, chunk_us=chunk_h * 60 * MIN).collect()}
    want, by = set(), {}
    for r in busy.collect():
        by.setdefault(r.mmsi, []).append(r.t_us)
    for m, ts in by.items():
        ts.sort()
        i = 0
        while i is not None:
            want.add((m, ts[i]))
            i = next((j for j in range(i, len(ts)) if ts[j] >= ts[i] + 60 * MIN), None)
    assert got == want


def test_decimation_numbers_match(busy):
    w = Window.partitionBy("mmsi").orderBy("t_us", "event_id")
    n = busy.withColumn("v", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("mmsi")))
    want = {(r.mmsi, r.v) for r in n.filter("v % greatest(1, n div 50) = 0").collect()}
    assert {(r.mmsi, r.vertex) for r in tracks.decimate(busy, 50).collect()} == want


def test_gap_limit_is_strict(spark):
    ais = fixes(spark, [(1, 0, 0, 0, 5), (1, 15, 0, 0, 5), (1, 30 + 1 / 60, 0, 0, 5)])
    assert [round(r.duration_min, 4) for r in tracks.find_gaps(ais).collect()] == [15.0167]


def test_sparse_track_raises_only_one_flag(spark):
    ais = fixes(spark, [(419000001, 0, 0, 0, 5), (419000001, 100, 5, 5, 5)]).withColumn("flag", F.lit("US"))
    r = trust.trust_scores(ais).first()
    assert r.codes == ["SPARSE_TRACK"] and r.score == pytest.approx(0.97)


def test_gap_penalty_is_capped(spark):
    ais = fixes(spark, [(419000001, 20 * i, 0.02 * i, 0, 3.6) for i in range(8)]).withColumn("flag", F.lit("IN"))
    r = trust.trust_scores(ais).first()
    assert r.codes == ["AIS_GAP"] and r.score == pytest.approx(1 - 3 * 0.12) and r.trust_prior == 0.9


def test_duplicate_positions_need_a_kilometre(spark):
    near = fixes(spark, [(1, 0, 10, 70, 5), (1, 0, 10.0081, 70, 5), (2, 0, 10, 70, 5), (2, 0, 10.0100, 70, 5)])
    assert [r.mmsi for r in trust.duplicate_positions(near).collect()] == [2]


def test_identity_decoding(spark):
    d = spark.createDataFrame([(19.0, "IMO8941145", 419000001), (20.0, " imo123 ", 41900001), (29.0, "N/A", 352000000), (30.0, None, 636000000),
                               (99.0, "77", 1), (100.0, "", 2), (None, "IMO 5", 3)], "c double, i string, m long")
    r = d.select(vessel.vessel_type_label(F.col("c")).alias("t"), vessel.imo_number(F.col("i")).alias("i"), vessel.flag_from_mmsi(F.col("m")).alias("f")).collect()
    assert [x.t for x in r] == [None, "Wing In Ground", "Wing In Ground", "Fishing Vessel", "Other", None, None]
    assert [x.i for x in r] == [8941145, 123, None, None, 77, None, 5]
    assert [x.f for x in r] == ["IN", None, None, "LR", None, None, None]


def test_nearest_other_equals_brute_force(spark):
    rnd = random.Random(5)
    pts = [(i, 10 + rnd.random() * 0.02, 70 + rnd.random() * 0.02) for i in range(150)] + [(200 + i, rnd.uniform(-50, 50), rnd.uniform(-170, 170)) for i in range(25)]
    pts += [(300, 10.0, 70.0), (301, 10.0, 70.0)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {r.id: r.km for r in matching.nearest_other(df).collect()}
    from driftwake.functions import geo

    pairs = df.alias("a").join(df.alias("b"), F.col("a.id") != F.col("b.id")).groupBy("a.id").agg(
        F.min(geo.segment_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) / 1000).alias("km"))
    want = {r.id: r.km for r in pairs.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


def test_nearest_other_at_the_antimeridian_near_the_pole_and_alone(spark):
    ddl = "id long, lat double, lon double"
    pts = [(1, 0.0, 179.999), (2, 0.0, -179.999), (3, 80.0, 10.0), (4, 80.0, 15.0), (5, 82.0, 10.0), (6, 5.0, -180.0), (7, 5.0, 179.9)]
    got = {r.id: r.km for r in matching.nearest_other(spark.createDataFrame(pts, ddl)).collect()}
    assert got[1] == got[2] == pytest.approx(0.2226, rel=1e-3) and got[6] == got[7] == pytest.approx(11.09, rel=1e-2)
    assert got[3] == got[4] == pytest.approx(97, rel=2e-2) and got[5] == pytest.approx(223, rel=2e-2)
    alone = matching.nearest_other(spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0)], ddl)).collect()
    assert sorted((r.id, r.km) for r in alone) == [(1, None), (2, None)]


def test_greedy_match_keeps_truth_order(spark):
    det = spark.createDataFrame([(1, 1, 10.0, 10.0), (1, 2, 14.0, 10.0), (1, 3, 90.0, 90.0)], "scene_id long, det_id long, row double, col double")
    truth = spark.createDataFrame([(1, 1, 12.1, 10.0), (1, 2, 13.5, 10.0), (1, 3, 50.0, 50.0)], "scene_id long, truth_id long, row double, col double")
    assert {(r.truth_id, r.det_id) for r in matching.greedy_reference_match(det, truth).collect()} == {(1, 2), (2, 1)}


def test_track_separation(spark):
    rows = [(1, i, 10 + i * 0.004, 70, 9) for i in range(60)] + [(2, i, 10 + i * 0.004, 70.01, 9) for i in range(60)] + [(3, i, 30 + i * 0.004, 10, 9) for i in range(60)]
    got = {r.mmsi: r.separation_km for r in matching.track_separation(fixes(spark, rows)).collect()}
    assert got[1] == pytest.approx(1.1, abs=0.1) and got[3] > 5000  # the nearest other vessel is that far away; nothing caps it
