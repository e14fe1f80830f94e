"""Row-order operators that survive one key holding a third of the rows.

A plain ``lag() over (partition by vessel)`` sends a hot vessel to one task. Here each window
runs on (key, time bucket); only one summary row per bucket travels across the key, and the
result is joined back on the same (key, bucket) partitioning, so the fact side shuffles once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
TRACK_BUCKET_US = 6 * HOUR_US


def time_bucket(col: str, width_us: int = TRACK_BUCKET_US) -> Column:
    return F.floor(F.col(col) / F.lit(width_us))


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str],
               bucket: Column) -> DataFrame:
    """Add structs ``prev``, ``prev2`` and ``next`` (null at the ends) holding the payload columns."""
    part = [*keys, "_bucket"]
    row = F.struct(*payload)
    at = F.struct(*order)
    local = Window.partitionBy(*part).orderBy(*order)
    d = (df.withColumn("_bucket", bucket)
         .withColumn("_p1", F.lag(row, 1).over(local))
         .withColumn("_p2", F.lag(row, 2).over(local))
         .withColumn("_n1", F.lead(row, 1).over(local)))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    edges = (d.groupBy(*part)
             .agg(F.max_by(F.struct(row.alias("r"), F.col("_p1").alias("p")), at).alias("_last"),
                  F.min_by(row, at).alias("_first"))
             .select(*part,
                     F.lag("_last.r").over(across).alias("_c1"),
                     F.coalesce(F.lag("_last.p").over(across), F.lag("_last.r", 2).over(across)).alias("_c2"),
                     F.lead("_first").over(across).alias("_cn")))
    p1, p2 = F.col("_p1"), F.col("_p2")
    return d.join(edges, part).select(
        *df.columns, "_bucket",
        F.coalesce(p1, F.col("_c1")).alias("prev"),
        F.when(p2.isNotNull(), p2).when(p1.isNotNull(), F.col("_c1")).otherwise(F.col("_c2")).alias("prev2"),
        F.coalesce("_n1", "_cn").alias("next"))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], mark: str, out: str) -> DataFrame:
    """Latest non-null ``mark`` at or before each row. Needs ``_bucket`` and a mark that grows with the order."""
    part = [*keys, "_bucket"]
    local = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = df.groupBy(*part).agg(F.max(mark).alias("_m")).select(*part, F.max("_m").over(across).alias("_carry"))
    return (df.withColumn("_here", F.max(mark).over(local)).join(edges, part)
            .withColumn(out, F.coalesce("_here", "_carry")).drop("_here", "_carry"))


def runs(df: DataFrame, keys: Sequence[str], time: str, flag: Column, aggs: Sequence[Column] = (),
         width_us: int = TRACK_BUCKET_US) -> DataFrame:
    """Contiguous true stretches of ``flag``: start, end (first false row after it, else the last row), rows."""
    extra = [c for c in df.columns if c not in (*keys, time)]
    d = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    n = neighbours(d.select(*keys, time, "_flag", *extra), keys, [time], [time, "_flag"],
                   time_bucket(time, width_us))
    on = (n.filter("_flag")
          .withColumn("_start", F.when(F.coalesce(~F.col("prev._flag"), F.lit(True)), F.col(time))))
    on = carry_forward(on, keys, [time], "_start", "run_start")
    return on.groupBy(*keys, "run_start").agg(
        F.max(F.coalesce(F.col(f"next.{time}"), F.col(time))).alias("run_end"),
        F.max(time).alias("last_true"),
        F.count(F.lit(1)).alias("n_rows"), *aggs)
