"""Exact quantiles of any doubles without one buffer: ranges are refined by distributed histograms until each holds one value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwake.session import checkpoint

#: Bins of a round. Ranges that travel to every task at most; more are joined by key.
BINS, BROADCAST_ROWS = 4096, 100_000


def exact_quantiles(values: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles of each group: by..., n, quantiles (array in the order of ``probs``), max. Nulls are left out.

    The wanted ranks start with the range [least, largest] of their group. Each round counts the range's values in ``BINS`` bins, by
    map-side sums, and keeps for every rank the bin that holds it, with the bin's own least and largest value.
    A range shrinks by the number of bins at least, so a few rounds reach single values; no task sees more than bins.
    """
    keys = [*by, "_g"]
    v = checkpoint(values.select(*by, F.lit(0).alias("_g"), F.col(value).cast("double").alias("_v")).filter("_v is not null"))
    size = checkpoint(v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    place = size.select(*keys, "n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("i", "p")).withColumn("pos", F.col("p") * (F.col("n") - 1))
    ends = F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))
    ranks = place.select(*keys, F.explode(ends).alias("rank")).distinct()
    state = checkpoint(ranks.join(size.drop("n"), keys).withColumn("k", F.col("rank")))
    done = state.filter("lo = hi")
    todo = state.filter("lo < hi")
    while not todo.isEmpty():
        ranges = checkpoint(todo.select(*keys, "lo", "hi").distinct())
        asked = F.broadcast(ranges) if ranges.count() <= BROADCAST_ROWS else ranges
        inside = v.join(asked, keys).filter(F.col("_v").between(F.col("lo"), F.col("hi")))
        # halves first: a range of very large numbers must not overflow
        share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bins = inside.groupBy(*keys, "lo", "hi", F.least(F.lit(BINS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * BINS)).alias("bin")).agg(
            F.count(F.lit(1)).alias("c"), F.min("_v").alias("a"), F.max("_v").alias("z"))
        upto = bins.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bin")))
        state = todo.join(upto, [*keys, "lo", "hi"]).filter((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("c")))
        state = checkpoint(state.select(*keys, F.col("a").alias("lo"), F.col("z").alias("hi"), "rank", (F.col("k") - F.col("upto") + F.col("c")).alias("k")))
        done, todo = done.unionByName(state.filter("lo = hi")), state.filter("lo < hi")
    found = done.select(*keys, "rank", F.col("lo").alias("x"))
    low, high = (found.withColumnsRenamed({"rank": f"r{s}", "x": f"x{s}"}) for s in "01")
    q = place.withColumns({"r0": F.floor("pos"), "r1": F.ceil("pos")}).join(low, [*keys, "r0"]).join(high, [*keys, "r1"])
    at = F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("pos") - F.col("r0"))
    out = q.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", at.alias("q")))).alias("_q"))
    return size.join(out, keys).select(*by, "n", F.transform("_q", lambda s: s.q).alias("quantiles"), F.col("hi").alias("max"))
