"""Pipeline over ``documents``: quality, repeated lines, near duplicates, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwake.llm import decontaminate, line_dedup, near_duplicates, packing, quality
from driftwake.llm.queries import held_out
from driftwake.session import shared_folder

ORACLE_SQL = None


def keep_usable(spark, docs, sf_dir):
    """Drops documents that the classifier, fitted on the labelled ones, rejects."""
    d = docs.select(F.col("doc_id").alias("incident_id"), F.col("text").alias("message"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("incident_id"), F.col("quality").alias("usable"))
    model = quality.fit_quality(d, labels.filter(~held_out(F.col("incident_id"))))
    return quality.score_bulletins(docs, model, "text").filter("predicted = 1").select(*docs.columns)


def drop_lines(spark, docs, sf_dir):
    """Removes later copies of repeated line runs and of long lines from the texts and documents that nothing is left of."""
    d = line_dedup.strip_repeated_lines(docs, "doc_id", "text", min_words=line_dedup.LONG_LINE)
    return d.filter((F.col("n_removed") == 0) | (F.length("text") > 0)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each(spark, docs, sf_dir):
    """Keeps one row of each group of near duplicates: the least doc_id, nulls last, and of its rows the first one.

    Groups are formed over row ids, so rows with null or equal doc_ids and unlike texts are documents of their own.
    Row ids repeat because the stage reads files.
    """
    d = docs.withColumn("_row", F.monotonically_increasing_id())
    ids = d.select("_row", F.col("doc_id").isNull().alias("_null"), "doc_id")
    g = near_duplicates.near_duplicates(d, "_row", "text").select("_row", "component_id").join(ids, "_row")
    kept = g.groupBy("component_id").agg(F.min(F.struct("_null", "doc_id", "_row")).alias("_least")).select("_least._row")
    return d.join(kept, "_row", "left_semi").select(*docs.columns)


def without_benchmark(spark, docs, sf_dir):
    """Drops documents that hold a benchmark passage."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("exercise_id"), F.col("text").alias("message"))
    return decontaminate.exercise_overlap(docs, items, "text").filter("n_hit = 0").select(*docs.columns)


def pack(spark, docs, sf_dir):
    """Packs the documents into sequences."""
    return packing.pack_bulletins(docs, key="doc_id", text="text")


STAGES = [("quality", keep_usable), ("line dedup", drop_lines), ("near duplicates", one_of_each), ("decontamination", without_benchmark), ("packing", pack)]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage-{i}")
        docs = spark.read.parquet(f"{folder}/stage-{i}")
    return docs
