"""Streams run to completion on ordered files must give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from driftwake.operators import baseline, tracks
from driftwake.streaming import monitor

T0 = 1_700_000_000_000_000
MIN = 60_000_000
REPORT = "event_id long, mmsi long, t_us long, sog double"


@pytest.fixture
def reports(spark, tmp_path):
    """Two vessels, one with a 40-minute silence; every tenth report doubled; a far-future row moves the watermark on."""
    rows = []
    for m in (1, 2):
        for i in range(60):
            if m == 1 and 20 <= i < 60 - 20:
                continue
            rows.append((m * 1000 + i, m, T0 + i * 2 * MIN, 8.0 if i % 30 < 20 else 0.5))
    rows += [(r[0] + 500_000, *r[1:]) for r in rows[::10]]
    rows.sort(key=lambda r: r[2])
    half = len(rows) // 2
    for n, part in enumerate((rows[:half], rows[half:], [(9, 99, T0 + 10_000 * MIN, 0.0)])):
        spark.createDataFrame(part, REPORT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.createDataFrame(rows, REPORT), str(tmp_path / "in"), tmp_path


def run(spark, stream, tmp_path, name, mode="append"):
    q = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, path):
    return monitor.event_time(spark.readStream.schema(REPORT).option("maxFilesPerTrigger", 1).parquet(path))


def test_dedup_matches_batch(spark, reports):
    batch, path, tmp = reports
    got = run(spark, monitor.dedup_reports(source(spark, path)), tmp, "dedup").filter("mmsi < 99")
    want = tracks.drop_duplicate_broadcasts(batch)
    assert {tuple(r) for r in got.select("mmsi", "t_us").collect()} == {tuple(r) for r in want.select("mmsi", "t_us").collect()}
    assert got.count() == want.count()


def test_activity_windows_match_batch(spark, reports):
    batch, path, tmp = reports
    got = {r.window_us: r.reports for r in run(spark, monitor.vessel_activity(source(spark, path)), tmp, "act").collect()}
    want = {r.w: r.n for r in batch.groupBy(F.unix_micros(F.window(F.timestamp_micros("t_us"), "10 minutes").start).alias("w")).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_sessions(spark, reports):
    _, path, tmp = reports
    rows = run(spark, monitor.transits(source(spark, path)), tmp, "sess").collect()
    assert {r.mmsi for r in rows} == {1, 2}
    assert all(r.end_us >= r.start_us for r in rows)


def test_gap_alarms(spark, reports):
    batch, path, tmp = reports
    rows = run(spark, monitor.gap_alarms(source(spark, path)), tmp, "gaps").collect()
    seen = {(r.mmsi, r.start_us) for r in rows}
    w = batch.withColumns({"lat": F.lit(0.0), "lon": F.lit(0.0)})
    want = {(r.mmsi, r.start_us) for r in tracks.find_gaps(tracks.drop_duplicate_broadcasts(w)).collect()}
    assert want and want <= seen
    assert any(r.is_open for r in rows)


def test_baseline_fold_is_idempotent(spark, tmp_path):
    rows = [(s, c, 4.0, -20.0 + s + c) for s in range(3) for c in range(2) for _ in range(5)]
    df = spark.createDataFrame(rows, "scene_id long, cell long, wind_ms double, v double")
    for n in range(2):
        df.write.mode("append").parquet(str(tmp_path / "scenes"))
        monitor.fold_scenes(spark, str(tmp_path / "scenes"), df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "),
                            str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination(120)
    got = baseline.statistics(spark.read.parquet(str(tmp_path / "store"))).orderBy("cell").collect()
    want = baseline.statistics(baseline.scene_partials(df)).orderBy("cell").collect()
    assert got == want


def test_product_watch(spark, tmp_path):
    schema = "observation_id string, kind string"

    def process(df):
        return df.withColumn("error", F.when(F.col("kind") == "bad", "unreadable"))

    for n in range(2):
        (spark.createDataFrame([(f"o{i}", "bad" if i == 3 else "ok") for i in range(4 + n)], schema).coalesce(1)
         .write.mode("append").json(str(tmp_path / "in")))
        monitor.watch_products(spark, str(tmp_path / "in"), schema, str(tmp_path / "st"), str(tmp_path / "ck"), process).awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "st/done"))
    assert sorted(r.observation_id for r in done.collect()) == ["o0", "o1", "o2", "o4"]
    assert {r.observation_id for r in spark.read.parquet(str(tmp_path / "st/errors")).collect()} == {"o3"}
    s = monitor.status(spark.read.parquet(str(tmp_path / "st/status"))).first()
    assert s.processed == 4 and s.last_result == "PROCESSED NEW DATA"


def test_a_check_without_new_products_is_recorded(spark, tmp_path):
    schema, where = "observation_id string, kind string", [str(tmp_path / x) for x in ("in", "st", "ck")]
    spark.createDataFrame([("o1", "ok")], schema).coalesce(1).write.json(where[0])

    def check():
        monitor.check_products(spark, where[0], schema, where[1], where[2], lambda df: df.withColumn("error", F.lit(None).cast("string")))
        return monitor.status(spark.read.parquet(f"{where[1]}/status")).first()

    first, second = check(), check()
    assert (first.checks, first.processed, first.last_result) == (1, 1, "PROCESSED NEW DATA")
    assert (second.checks, second.processed, second.last_result) == (2, 1, "NO NEW DATA")
    assert second.last_check_at > first.last_check_at and second.last_new_data_at == first.last_new_data_at
