"""Exact dedup of bulletins: frequent digests by Misra-Gries are settled map-side, the rest by one ordinary shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwake.session import checkpoint

#: White space that counts as one blank.
SPACES = r"[\x20\x09-\x0D]+"
#: Counters of a summary, and so the most rows that are ever broadcast. No digest outside has over 1/(COUNTERS + 1) of all rows.
COUNTERS = 4096
#: Summaries that one merging task takes.
FAN_IN = 64


def _shrink(counts: dict, counters: int) -> dict:
    """The Misra-Gries step on a whole table of counts: takes the (counters + 1)-th largest count off every one."""
    if len(counts) <= counters:
        return counts
    n = np.fromiter(counts.values(), np.int64, len(counts))
    off = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])
    return {d: c - off for d, c in counts.items() if c > off}


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates for frequent digests of a table (digest binary): at most ``counters`` rows (digest, low), low a lower bound of its count.

    Every digest with more than rows / (counters + 1) rows is among them. Each partition keeps one summary; summaries
    are merged in a tree of fan-in ``FAN_IN``, so no task sees more than FAN_IN * counters entries.
    """
    def summarise(batches):
        kept: dict = {}
        for b in batches:
            for v in pc.value_counts(b.column(0)):
                d = v["values"].as_py()
                kept[d] = kept.get(d, 0) + v["counts"].as_py()
            kept = _shrink(kept, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["digest", "low"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = _shrink(pdf.groupby("digest")["low"].sum().to_dict(), counters)
        return pd.DataFrame({"part": pdf["part"].iloc[0], "digest": list(kept), "low": list(kept.values())})

    n = digests.rdd.getNumPartitions()
    s = digests.select("digest").mapInArrow(summarise, "digest binary, low long").select(F.spark_partition_id().alias("part"), "digest", "low")
    while True:
        s = s.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part").applyInPandas(merge, "part int, digest binary, low long")
        n = -(-n // FAN_IN)
        if n <= 1:
            return s.select("digest", "low")


def equal_bulletins(bulletins: DataFrame, key: str = "incident_id", text: str = "message", counters: int = COUNTERS) -> DataFrame:
    """Which bulletins are copies: one row (key, keep_id, group_size, kept, text_sha256) for each row of the input.

    Texts are equal when identical after every run of blank, tab, line feed, vertical tab, form feed or carriage return
    becomes one blank; equality is that of the SHA-256 of the normalised text. Of equal texts the row with the least key
    stays, nulls last; of rows with that key one stays. ``keep_id`` is its key, null only where all keys of a group are.
    Null text counts as empty. An empty table gives no rows; other columns are left out, whatever their names.

    Digests are stored once. Frequent ones (Misra-Gries) get their exact count and winner by map-side aggregation, and
    these winners, at most ``counters`` rows, are broadcast: their copies never travel. The other groups hold at most
    1/(counters + 1) of all rows and meet in one shuffle of digests, without the texts.
    """
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")
    d = bulletins.select(F.col(key).alias("key"), F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"))
    d = checkpoint(d.withColumn("row", F.monotonically_increasing_id()))
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row"))
    asked = F.broadcast(frequent_digests(d, counters).select("digest"))
    winners = checkpoint(d.join(asked, "digest").groupBy("digest").agg(least.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    group = Window.partitionBy("digest")
    rest = d.join(F.broadcast(winners.select("digest")), "digest", "left_anti").withColumns({"first": least.over(group), "n": F.count(F.lit(1)).over(group)})
    both = d.join(F.broadcast(winners), "digest").select(rest.columns).unionByName(rest)
    return both.select(F.col("key").alias(key), F.col("first.key").alias("keep_id"), F.col("n").alias("group_size"),
                       (F.col("first.row") == F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
