"""Session helpers: a tuned builder for local runs and the checkpoint directory rule."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "driftwake", partitions: int = 8) -> SparkSession:
    """Session for tests and benches. A cluster brings its own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_dir(spark: SparkSession) -> str:
    """Folder that the session names in ``spark.checkpoint.dir``; a local session without it gets a scratch folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
            shared = tempfile.mkdtemp(prefix="driftwake-ckpt-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, for tables written and read again."""
    return f"{_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage in reliable shared storage, so a lost executor costs no recompute from the start."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def release(spark: SparkSession) -> None:
    """Let the cluster drop the shuffle files of finished steps. Spark does so when the driver's objects for them are collected, which by
    itself may come long after the last use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition compute-heavy groups over all shuffle partitions. The rows are few but each costs
    seconds of work, so coalescing them by bytes would run them one after another."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
