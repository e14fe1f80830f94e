"""Detection quality: confusion counts, metrics, sweeps, run comparison, sampling and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
# Oil-fraction bands (name, upper bound, share of draws).
BANDS = (("empty", 0.0, 0.08), ("tiny", 0.01, 0.18), ("small", 0.05, 0.24), ("medium", 0.15, 0.24),
         ("large", 0.35, 0.16), ("huge", 1.01, 0.10))
METRICS = ("oil_iou", "oil_dice", "oil_precision", "oil_recall", "oil_f1", "background_iou", "mean_iou", "mean_dice", "pixel_accuracy")


def confusion_aggs(pred: Column, target: Column) -> list[Column]:
    return [F.count_if((target == t) & (pred == p)).alias(name)
            for name, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]


def confusion_by_sensor(chips: DataFrame, score: str = "prob_a", threshold: float = 0.5) -> DataFrame:
    """2x2 counts overall and per sensor in one pass; 'ALL' marks the grand total."""
    d = chips.withColumn("pred", (F.col(score) >= threshold).cast("int"))
    g = d.groupingSets([[], ["sensor"]], "sensor").agg(*confusion_aggs(F.col("pred"), F.col("target")), F.grouping("sensor").alias("_g"))
    return g.select(F.when(F.col("_g") == 1, "ALL").otherwise(F.col("sensor")).alias("sensor"), "tn", "fp", "fn", "tp")


def metrics(conf: DataFrame) -> DataFrame:
    """Per-class and mean metrics; 0/0 reads 0 per class and is left out of the means."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    def mean2(a: Column, b: Column) -> Column:
        known = F.array_compact(F.array(a, b))
        return F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known))

    iou, iou0 = F.try_divide(tp, tp + fp + fn), F.try_divide(tn, tn + fn + fp)
    dice, dice0 = F.try_divide(2 * tp, 2 * tp + fp + fn), F.try_divide(2 * tn, 2 * tn + fn + fp)
    prec, rec = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return conf.withColumns({
        "oil_iou": zero(iou), "oil_dice": zero(dice), "oil_precision": zero(prec), "oil_recall": zero(rec),
        "oil_f1": zero(F.try_divide(2 * prec * rec, prec + rec)), "background_iou": zero(iou0),
        "mean_iou": mean2(iou, iou0), "mean_dice": mean2(dice, dice0),
        "pixel_accuracy": (tp + tn) / F.greatest(tp + tn + fp + fn, F.lit(1))})


def threshold_sweep(chips: DataFrame, score: str = "prob_a") -> DataFrame:
    """Metrics at every threshold from one scan: rows combine to (sensor-free) counts before any shuffle."""
    d = chips.select("target", F.col(score).alias("_s"), F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("threshold"))
    g = d.groupBy("threshold").agg(*confusion_aggs((F.col("_s") >= F.col("threshold")).cast("int"), F.col("target")))
    w = Window.orderBy(F.desc("oil_iou"), "threshold")
    return metrics(g).withColumn("is_best", F.row_number().over(w) == 1)


def unpivoted(conf: DataFrame, label: str) -> DataFrame:
    pairs = ", ".join(f"'{m}', {m}" for m in METRICS)
    return metrics(conf).selectExpr(f"stack({len(METRICS)}, {pairs}) as (metric, {label})", "tn + fp + fn + tp as n_px")


def compare_runs(chips: DataFrame, a: str = "prob_a", b: str = "prob_b", threshold: float = 0.5) -> DataFrame:
    """Metric by metric difference of two runs; refuses runs scored on different pixel counts."""
    def run(score: str, label: str) -> DataFrame:
        pred = (F.col(score) >= threshold).cast("int")
        return unpivoted(chips.filter(F.col(score).isNotNull()).agg(*confusion_aggs(pred, F.col("target"))), label)

    ra, rb = run(a, "before").withColumnRenamed("n_px", "_na"), run(b, "after").withColumnRenamed("n_px", "_nb")
    guard = F.assert_true(F.col("_na") == F.col("_nb"), F.lit("runs were scored on different test sets"))
    return ra.join(rb, "metric").withColumn("_ok", guard).filter("_ok is null").select(
        "metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def paired_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two runs (chip_id, iou) chip by chip."""
    return a.withColumnRenamed("iou", "iou_a").join(b.withColumnRenamed("iou", "iou_b"), "chip_id").withColumn(
        "delta", F.col("iou_b") - F.col("iou_a"))


def delta_summary(pairs: DataFrame, tol: float = 0.01) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("chips"), F.count_if(F.col("delta") > tol).alias("improved"),
                     F.count_if(F.col("delta") < -tol).alias("regressed"), F.count_if(F.abs("delta") <= tol).alias("unchanged"),
                     F.avg("iou_a").alias("mean_before"), F.avg("iou_b").alias("mean_after"))


def extremes(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The k best and k worst chips. Each side is a top-k sort, never a full ordering."""
    best = pairs.orderBy(F.desc("delta"), "chip_id").limit(k).withColumn("side", F.lit("best"))
    worst = pairs.orderBy("delta", "chip_id").limit(k).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def band_of(fraction: Column) -> Column:
    expr = F.lit(None).cast("string")
    for name, upper, _ in reversed(BANDS):
        expr = F.when(fraction == 0 if upper == 0.0 else fraction <= upper, name).otherwise(expr)
    return F.when(fraction >= 0, expr)


def band_report(chips: DataFrame) -> DataFrame:
    """Natural and sampled share per band present, with the boost and the weight each chip gets."""
    target = reduce(lambda acc, b: acc.when(F.col("band") == b[0], b[2]), BANDS[1:], F.when(F.col("band") == BANDS[0][0], BANDS[0][2]))
    g = (chips.withColumn("band", band_of(F.col("oil_fraction"))).groupBy("band").agg(F.count(F.lit(1)).alias("chips"))
         .withColumn("_t", target))
    every = Window.partitionBy()
    natural = F.col("chips") / F.sum("chips").over(every)
    share = F.col("_t") / F.sum("_t").over(every)
    return g.filter("_t is not null").select("band", "chips", natural.alias("natural_share"), share.alias("sampled_share"),
                                             (share / F.greatest(natural, F.lit(1e-9))).alias("boost"),
                                             (share / F.col("chips")).alias("weight"))


def band_weights(chips: DataFrame) -> DataFrame:
    """Per-chip draw weight. The report has at most one row per band, so the join side is bounded by the band list."""
    return chips.withColumn("band", band_of(F.col("oil_fraction"))).join(
        F.broadcast(band_report(chips).select("band", "weight")), "band")


def weighted_fraction(weighted: DataFrame) -> DataFrame:
    """Class fraction under the sampler, beside the plain mean."""
    return weighted.agg((F.sum(F.col("oil_fraction") * F.col("weight")) / F.sum("weight")).alias("weighted_fraction"),
                        F.avg("oil_fraction").alias("mean_fraction"))


def split_bucket(sensor: Column, name: Column) -> Column:
    """Stable 0-999 bucket from an item's identity."""
    digest = F.sha1(F.concat_ws("/", sensor, name))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 1000


def splits(chips: DataFrame, cut: int = 800) -> DataFrame:
    b = split_bucket(F.col("sensor"), F.col("chip_id").cast("string"))
    return chips.withColumn("bucket", b).withColumn("split", F.when(F.col("bucket") < cut, "train").otherwise("val"))


def split_overlap(split: DataFrame) -> DataFrame:
    """Items that ended up on both sides; must be zero."""
    side = {k: split.filter(F.col("split") == k).select("chip_id") for k in ("train", "val")}
    both = side["train"].intersect(side["val"]).agg(F.count(F.lit(1)).alias("overlap"))
    sizes = split.agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))
    return sizes.withColumn("_1", F.lit(1)).join(both.withColumn("_1", F.lit(1)), "_1").drop("_1")


def stratified_subset(chips: DataFrame, limit: int) -> DataFrame:
    """Equal quota per sensor in hash order: the rank filter is limited before the shuffle."""
    n = chips.agg(F.count_distinct("sensor")).scalar()
    quota = F.greatest(F.lit(1), F.floor(F.lit(limit) / n))
    w = Window.partitionBy("sensor").orderBy(F.sha2(F.col("chip_id").cast("string"), 256), "chip_id")
    ranked = chips.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)
    return ranked.filter(F.col("rn") <= quota).drop("rn")


def detection_rate_surface(trials: DataFrame) -> DataFrame:
    """Hit rate and mean overlap per (area, contrast) from trial rows (area_km2, contrast_db, hit, iou)."""
    return trials.groupBy("area_km2", "contrast_db").agg(
        F.count(F.lit(1)).alias("trials"), F.avg(F.col("hit").cast("double")).alias("detection_rate"), F.avg("iou").alias("mean_iou"))


def headline_minima(surface: DataFrame, rate: float = 0.8) -> DataFrame:
    ok = F.col("detection_rate") >= rate
    return surface.agg(F.min(F.when(ok, F.col("area_km2"))).alias("smallest_area_km2"),
                       F.min(F.when(ok, F.col("contrast_db"))).alias("faintest_contrast_db"))
