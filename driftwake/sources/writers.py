"""Sinks: partitioned parquet, nested JSON documents and GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_reports(ais: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Reports by day, clustered by vessel and time so that row-group statistics prune; a hot vessel's
    day still splits, because the range partitioning includes the time."""
    day = F.to_date(F.timestamp_micros("t_us"))
    d = ais.withColumn("day", day).repartitionByRange("day", "mmsi", "t_us").sortWithinPartitions("day", "mmsi", "t_us")
    d.write.mode(mode).partitionBy("day").option("maxRecordsPerFile", 5_000_000).parquet(path)


def append_baseline(partials: DataFrame, path: str) -> None:
    partials.write.mode("append").parquet(path)


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row, nested structs kept."""
    df.write.mode(mode).json(path)


def write_snapshots(results: dict[str, DataFrame], root: str) -> None:
    """One JSON folder per query result, partitioned by incident."""
    for name, df in results.items():
        df.write.mode("overwrite").partitionBy("incident_id").json(f"{root}/{name}")


def ring_geometry(ring: Column) -> Column:
    """GeoJSON Polygon struct, longitude first, ring closed."""
    xy = F.transform(ring, lambda p: F.array(p.x, p.y))
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.concat(xy, F.slice(xy, 1, 1))).alias("coordinates"))


def point_geometry(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def features(df: DataFrame, geometry: Column, *properties: str) -> DataFrame:
    """One GeoJSON Feature per row, as text."""
    doc = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("value"))


def track_features(points: DataFrame) -> DataFrame:
    """One LineString per vessel from decimated vertices (mmsi, vertex, t_us, lat, lon); decimation bounds each line."""
    v = F.array_sort(F.collect_list(F.struct("vertex", "t_us", "lon", "lat")))
    g = points.groupBy("mmsi").agg(v.alias("v")).filter("size(v) > 1")
    line = F.struct(F.lit("LineString").alias("type"), F.transform("v", lambda p: F.array(p.lon, p.lat)).alias("coordinates"))
    return features(g.withColumn("t", F.transform("v", lambda p: p.t_us / 1e6)), line, "mmsi", "t")


def write_features(feats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Newline-delimited GeoJSON features."""
    feats.write.mode(mode).text(path)


def trust_documents(scores: DataFrame) -> DataFrame:
    """Per-vessel trust records as (mmsi, json) rows: a keyed document store rather than one map on the driver."""
    return scores.select("mmsi", F.to_json(F.struct("score", "classification", "codes", "trust_prior")).alias("value"))


def provenance(stats: DataFrame, inputs: dict[str, str]) -> DataFrame:
    """Which inputs were measured and which were assumed, beside the field statistics."""
    kinds = F.create_map(*[x for k, v in inputs.items() for x in (F.lit(k), F.lit(v))])
    return stats.withColumn("inputs", kinds)
