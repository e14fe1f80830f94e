"""Jump consistent hashing of keyed records (a vessel's reports, an incident's files) to shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.session import checkpoint


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key by the published jump recurrence; going from n to n + 1 moves keys only to the new one."""
    if shards < 1:
        raise ValueError("at least one shard")
    k, b, j = keys.astype(np.uint64).copy(), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    live = np.ones(len(keys), bool)
    while live.any():
        b[live] = j[live]
        k[live] = k[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (b[live] + 1) * ((1 << 31) / ((k[live] >> np.uint64(33)).astype(np.float64) + 1.0))
        j[live] = np.floor(step).astype(np.int64)
        live = j < shards
    return b


def shard_records(records: DataFrame, key: str = "mmsi", shards: int = 24) -> DataFrame:
    """Adds ``shard``, ``grown_shard`` (with one shard more) and ``slot``, gapless from 0 in each shard.

    The key alone decides, so repeated rows share a shard and get slots of their own; a null key counts as key 0.
    Other columns pass through; columns of the result's names are replaced. Slots are counted per input partition and
    shifted by the partitions before it: no shard is sorted or collected.
    """
    @F.pandas_udf("shard int, grown_shard int")
    def place(h: pd.Series) -> pd.DataFrame:
        v = h.to_numpy().astype(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": jump_hash(v, shards).astype("int32"), "grown_shard": jump_hash(v, shards + 1).astype("int32")})

    kept = [c for c in records.columns if c not in ("shard", "grown_shard", "slot")]
    hashed = F.xxhash64(F.coalesce(F.col(key).cast("long"), F.lit(0)))
    placed = records.select(*kept, place(hashed).alias("_p")).select(*kept, "_p.shard", "_p.grown_shard", F.spark_partition_id().alias("_part"))

    def number(batches):
        seen = np.zeros(shards, np.int64)
        for pdf in batches:
            local = pdf.groupby("shard").cumcount().to_numpy() + seen[pdf["shard"].to_numpy()]
            seen += np.bincount(pdf["shard"], minlength=shards)
            yield pdf.assign(_local=local)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields) + ", _local long"
    d = checkpoint(placed.mapInPandas(number, schema))
    counts = d.groupBy("_part", "shard").agg(F.count(F.lit(1)).alias("n"))
    base = counts.selectExpr("_part", "shard", "sum(n) over (partition by shard order by _part rows between unbounded preceding and 1 preceding) _base")
    return d.join(base, ["_part", "shard"]).select(*kept, "shard", "grown_shard", (F.coalesce("_base", F.lit(0)) + F.col("_local")).alias("slot"))
