"""Removal of repeated line runs from bulletins by prefix doubling over line ids, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MIN_LINES = 2
#: Words from which on a single line counts as a run of its own; as long as the windows of ``span_dedup``.
LONG_LINE = 35


def strip_repeated_lines(bulletins: DataFrame, key: str = "incident_id", text: str = "message", min_lines: int = MIN_LINES,
                         min_words: int | None = None) -> DataFrame:
    """Bulletins without later copies of runs of at least ``min_lines`` lines; adds n_lines and n_removed.

    With ``min_words``, a single line of at least so many words is a run too, whatever stands around it, also where it
    is the whole text.

    A line goes when a run of ``min_lines`` lines that covers it also starts earlier, by (key, row, line). Names of the
    run that starts at each line double in length per step (the ranks of a suffix array cut at the run length); equal
    names are its common-prefix intervals, and covering the later ones covers every maximal repeated run. Only the
    smallest start of each name is aggregated, so a line that stands everywhere is one row per task in the shuffle.
    ``min_lines`` is a power of two. Null texts have no lines and stay null; repeated rows count as later copies; null
    keys sort first; other columns pass through; the input must read alike twice (files do).
    """
    d = bulletins.drop("n_lines", "n_removed").withColumn("_row", F.monotonically_increasing_id())
    lines = d.filter(F.col(text).isNotNull()).select("_row", F.col(key).alias("_k"), F.posexplode(F.split(text, "\n")).alias("_i", "_line"))
    by_row = W.partitionBy("_row").orderBy("_i")
    line = F.struct(F.xxhash64("_line"), F.xxhash64(F.length("_line"), "_line"))
    alone = [] if min_words is None else [F.when(F.regexp_count("_line", F.lit(r"\S+")) >= min_words, line).alias("_one")]
    named, step = lines.select("_row", "_k", "_i", line.alias("_n"), *alone), 1
    while step < min_lines:
        nxt = F.lead("_n", step).over(by_row)
        named = named.withColumn("_n", F.when(nxt.isNotNull(), F.struct(F.xxhash64("_n", nxt), F.xxhash64(nxt, "_n"))))
        step *= 2
    runs = [F.struct(F.lit(min_lines).alias("l"), F.col("_n").alias("n"))] + [F.struct(F.lit(1).alias("l"), F.col("_one").alias("n")) for _ in alone]
    starts = named.select("_row", "_k", "_i", F.explode(F.filter(F.array(*runs), lambda r: r.n.isNotNull())).alias("_n"))
    at = F.struct(F.col("_k"), F.col("_row"), F.col("_i"))
    first = starts.groupBy("_n").agg(F.min(at).alias("_f"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_n", "_f")
    later = starts.join(first, "_n").filter(~at.eqNullSafe(F.col("_f"))).select("_row", "_i", F.col("_n.l").alias("_l"))
    gone = later.select("_row", F.explode(F.sequence(F.col("_i"), F.col("_i") + F.col("_l") - 1)).alias("_i")).distinct()
    gone = gone.groupBy("_row").agg(F.collect_list("_i").alias("_gone"))
    out = d.join(gone, "_row", "left")
    parts = F.split(text, "\n")
    flagged = F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    keep = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(
        F.filter(flagged, lambda s: ~F.map_contains_key(F.map_from_arrays(F.col("_gone"), F.col("_gone")), s.i)), lambda s: s.x), "\n"))
    return out.withColumn("n_lines", F.coalesce(F.size(parts), F.lit(0)).cast("long") * F.col(text).isNotNull().cast("long")).withColumn(
        "n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long")).withColumn(text, keep).drop("_row", "_gone")
