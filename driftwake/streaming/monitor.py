"""Continuous operators: product watch, incremental baseline, report dedup, gap alarms, activity and transits."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from driftwake.functions.vessel import monitor_result
from driftwake.operators import baseline
from driftwake.operators.catalogue import unseen
from driftwake.session import checkpoint as reliable

GAP_SCHEMA = "mmsi long, start_us long, end_us long, duration_min double, is_open boolean"
WATERMARK = "10 minutes"


def event_time(stream: DataFrame, delay: str = WATERMARK) -> DataFrame:
    return stream.withColumn("t", F.timestamp_micros("t_us")).withWatermark("t", delay)


def dedup_reports(stream: DataFrame) -> DataFrame:
    """One report per (mmsi, t_us); state is dropped once the watermark passes."""
    return stream.dropDuplicatesWithinWatermark(["mmsi", "t_us"])


def vessel_activity(stream: DataFrame, size: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Reports, active vessels (approximate count in bounded state) and share under way per window."""
    w = F.window("t", size, slide) if slide else F.window("t", size)
    return stream.groupBy(w).agg(
        F.count(F.lit(1)).alias("reports"), F.approx_count_distinct("mmsi").alias("vessels"),
        F.avg((F.col("sog") > 1).cast("double")).alias("underway_share")).select(
        F.unix_micros("window.start").alias("window_us"), "reports", "vessels", "underway_share")


def transits(stream: DataFrame, min_kn: float = 5.0, gap: str = "15 minutes") -> DataFrame:
    """Sessions of sustained movement per vessel."""
    moving = stream.filter(F.col("sog") > min_kn)
    return moving.groupBy("mmsi", F.session_window("t", gap)).agg(
        F.count(F.lit(1)).alias("fixes"), F.avg("sog").alias("mean_sog"), F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us")).select(
        "mmsi", "start_us", "end_us", "fixes", "mean_sog")


class GapDetector(StatefulProcessor):
    """Remembers each vessel's last report. A later report past the limit closes a gap; a timer raises an open one."""

    def __init__(self, gap_min: float = 15.0) -> None:
        self.gap_us = int(gap_min * 6e7)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t_us long")

    def handleInputRows(self, key, rows, timerValues):
        times = sorted(t for pdf in rows for t in pdf["t_us"].tolist())
        out = []
        prev = self.last.get()[0] if self.last.exists() else None
        for t in times:
            if prev is not None and t - prev > self.gap_us:
                out.append((key[0], prev, t, (t - prev) / 6e7, False))
            prev = t if prev is None else max(prev, t)
        self.last.update((prev,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((prev + self.gap_us) // 1000 + 1)
        yield pd.DataFrame(out, columns=["mmsi", "start_us", "end_us", "duration_min", "is_open"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        prev = self.last.get()[0]
        now = timerValues.getCurrentWatermarkInMs() * 1000
        yield pd.DataFrame([(key[0], prev, now, (now - prev) / 6e7, True)], columns=["mmsi", "start_us", "end_us", "duration_min", "is_open"])

    def close(self) -> None:
        pass


def gap_alarms(stream: DataFrame, gap_min: float = 15.0) -> DataFrame:
    """Closed and still-open silences per vessel. Needs the RocksDB state store."""
    return stream.select("mmsi", "t_us", "t").groupBy("mmsi").transformWithStateInPandas(
        GapDetector(gap_min), outputStructType=GAP_SCHEMA, outputMode="Append", timeMode="EventTime")


def watch_products(spark: SparkSession, folder: str, schema: str, store: str, checkpoint: str,
                   process: Callable[[DataFrame], DataFrame]):
    """Follow a folder of product records (observation_id, ...) and handle every new one exactly once.

    Products already in the store are skipped by anti join, so a replayed batch adds nothing. Rows whose
    processing reports an ``error`` go to a quarantine table and the stream goes on. Each batch appends one
    status row that keeps 'checked' apart from 'found'.
    """
    stream = spark.readStream.schema(schema).json(folder)

    def handle(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        known = _stored(s, f"{store}/done", "observation_id string")
        fresh = unseen(batch.dropDuplicates(["observation_id"]), known)
        done = reliable(process(fresh).withColumn("batch_id", F.lit(batch_id)))
        done.filter("error is null").drop("error").write.mode("append").parquet(f"{store}/done")
        done.filter("error is not null").select("observation_id", "error", "batch_id").write.mode("append").parquet(f"{store}/errors")
        status = done.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"),
                          F.count(F.lit(1)).alias("new_observations"))
        status.select(F.lit(batch_id).alias("batch_id"), F.current_timestamp().alias("last_check_at"),
                      F.when(F.col("new_observations") > 0, F.current_timestamp()).alias("last_new_data_at"), "*",
                      monitor_result(F.col("processed"), F.col("new_observations")).alias("last_result")).write.mode("append").parquet(f"{store}/status")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def record_idle(spark: SparkSession, store: str) -> None:
    """Append a status row of a check that found nothing."""
    zero, now = F.lit(0).cast("bigint"), F.current_timestamp()
    row = spark.range(1).select(F.lit(-1).alias("batch_id"), now.alias("last_check_at"), F.lit(None).cast("timestamp").alias("last_new_data_at"),
                                zero.alias("processed"), zero.alias("failed"), zero.alias("new_observations"), monitor_result(zero, zero).alias("last_result"))
    row.write.mode("append").parquet(f"{store}/status")


def check_products(spark: SparkSession, folder: str, schema: str, store: str, checkpoint: str, process: Callable[[DataFrame], DataFrame]) -> None:
    """One check of the product folder, recorded in the status table whether or not anything was new."""
    query = watch_products(spark, folder, schema, store, checkpoint, process)
    query.awaitTermination()
    if not any(p["numInputRows"] for p in query.recentProgress):
        record_idle(spark, store)


class IdleStatus(StreamingQueryListener):
    """For a watch that runs on: each time the stream ``query_id`` finds nothing to do, the check is recorded all the same."""

    def __init__(self, spark: SparkSession, store: str, query_id: str) -> None:
        self.spark, self.store, self.query_id = spark, store, query_id

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        if str(event.id) == self.query_id:
            record_idle(self.spark, self.store)

    def onQueryTerminated(self, event) -> None:
        pass


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not have been written yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def status(store: DataFrame) -> DataFrame:
    """Latest service state: last check, last new data and running totals."""
    return store.agg(F.count(F.lit(1)).alias("checks"), F.max("last_check_at").alias("last_check_at"),
                     F.max("last_new_data_at").alias("last_new_data_at"), F.sum("processed").alias("processed"),
                     F.sum("failed").alias("failed"), F.max_by("last_result", "last_check_at").alias("last_result"))


def fold_scenes(spark: SparkSession, folder: str, schema: str, store: str, checkpoint: str):
    """Incremental baseline: each micro-batch appends the partial sums of scenes the store lacks.

    A scene that is spread over files carries a ``part`` column; a part counts once, however files fall into batches.
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    part = [f"part {f.dataType.simpleString()}" for f in stream.schema if f.name == "part"]
    ddl = ", ".join(["scene_id long", *part, "cell long, wind_bin string, n long, s double, ss double"])

    def handle(batch: DataFrame, batch_id: int) -> None:
        fresh = baseline.fold(_stored(batch.sparkSession, store, ddl), baseline.scene_partials(batch))
        fresh.write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
