"""Readers: vessel reports, fields, polygons, stations, product metadata, tiles and file manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake import schemas
from driftwake.functions import vessel
from driftwake.sources.contracts import require_columns


def _clean(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def normalise_reports(raw: DataFrame, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Provider columns to the report schema; NaN becomes null, naive times are UTC, nothing is made up.

    ``bbox`` (min_lon, min_lat, max_lon, max_lat) filters first, so it reaches a columnar scan as pushed predicates.
    """
    require_columns(raw, schemas.AIS_REQUIRED, "vessel report file")
    if bbox is not None:
        raw = raw.filter(F.col("longitude").between(bbox[0], bbox[2]) & F.col("latitude").between(bbox[1], bbox[3]))
    have = set(raw.columns)

    def opt(c: str, expr: Column, kind: str) -> Column:
        return (expr if c in have else F.lit(None)).cast(kind)

    t = F.to_timestamp(F.regexp_replace("base_date_time", "T", " "))
    return raw.select(
        F.col("mmsi").cast("bigint").alias("mmsi"), F.unix_micros(t).alias("t_us"), _clean("latitude").alias("lat"), _clean("longitude").alias("lon"),
        _clean("sog").alias("sog"), *[opt(c, _clean(c) if c in have else F.lit(None), "double").alias(c) for c in ("cog", "heading")],
        opt("vessel_name", F.col("vessel_name"), "string").alias("vessel_name"),
        (vessel.imo_number(F.col("imo")) if "imo" in have else F.lit(None).cast("bigint")).alias("imo"),
        (vessel.vessel_type_label(F.col("vessel_type")) if "vessel_type" in have else F.lit(None).cast("string")).alias("vessel_type"),
        opt("length", F.col("length") if "length" in have else F.lit(None), "double").alias("length_m"),
        vessel.flag_from_mmsi(F.col("mmsi")).alias("flag"))


def read_report_csv(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Vessel reports from CSV. A .zst file reads too but does not split: convert it to parquet once."""
    raw = require_columns(spark.read.csv(path, header=True), schemas.AIS_REQUIRED, path)
    typed = [F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) for f in schemas.AIS_CSV.fields if f.name in raw.columns]
    return normalise_reports(raw.select(*typed), bbox)


def read_report_parquet(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), schemas.FIX_REQUIRED, path)


def read_field(spark: SparkSession, path: str) -> DataFrame:
    """A wind and current field in long form."""
    return require_columns(spark.read.schema(schemas.ENV).parquet(path), schemas.ENV.fieldNames(), path)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station register from a multi-line JSON document with a ``stations`` list."""
    doc = spark.read.schema(f"stations array<struct<{_struct(schemas.STATION)}>>").json(path, multiLine=True)
    return doc.select(F.explode("stations").alias("s")).select(
        F.col("s.id").alias("station_id"), "s.name", "s.role", "s.region", "s.lat", "s.lon", F.col("s.nosdcp_tier_min").alias("tier_min"))


def _struct(ddl: str) -> str:
    return ",".join(":".join(f.strip().split(" ", 1)) for f in ddl.split(","))


def polygon_ring(document: Column) -> Column:
    """Outer ring of a GeoJSON Feature, FeatureCollection or bare geometry; a MultiPolygon gives its largest part."""
    geometry = F.coalesce(F.get_json_object(document, "$.features[0].geometry"), F.get_json_object(document, "$.geometry"), document)
    kind = F.get_json_object(geometry, "$.type")
    coords = F.get_json_object(geometry, "$.coordinates")
    single = F.from_json(coords, "array<array<array<double>>>")
    parts = F.when(kind == "MultiPolygon", F.from_json(coords, "array<array<array<array<double>>>>")).otherwise(F.array(single))

    def outer(part: Column) -> Column:
        closed = F.transform(F.get(part, F.lit(0)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
        return F.when(F.element_at(closed, 1) == F.element_at(closed, -1), F.slice(closed, F.lit(1), F.size(closed) - 1)).otherwise(closed)

    from driftwake.functions.geo import ring_area

    ranked = F.transform(F.transform(parts, outer), lambda r: F.struct(ring_area(r).alias("a"), r.alias("r")))
    return F.array_max(ranked).r


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """One ring per GeoJSON file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), polygon_ring(F.col("value")).alias("ring"))


def line_segments(documents: DataFrame) -> DataFrame:
    """Coastline GeoJSON text (value) to segment rows: every line and polygon border, pair by pair."""
    feature = F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>"))
    f = documents.select(feature.alias("f")).select(F.get_json_object("f", "$.geometry.type").alias("kind"), F.get_json_object("f", "$.geometry.coordinates").alias("c"))
    lines = F.when(F.col("kind") == "LineString", F.array(F.from_json("c", "array<array<double>>"))).when(
        F.col("kind") == "MultiPolygon", F.flatten(F.from_json("c", "array<array<array<array<double>>>>"))).otherwise(F.from_json("c", "array<array<array<double>>>"))
    line = f.select(F.explode(lines).alias("l")).filter("size(l) > 1")
    i = F.explode(F.sequence(F.lit(0), F.size("l") - 2))
    p = line.select("l", i.alias("i")).select(F.get("l", F.col("i")).alias("a"), F.get("l", F.col("i") + 1).alias("b"))
    return p.select(F.col("a")[0].alias("x1"), F.col("a")[1].alias("y1"), F.col("b")[0].alias("x2"), F.col("b")[1].alias("y2"))


def product_metadata(lines: DataFrame) -> DataFrame:
    """KEY=value text lines (path, value) to one map per product."""
    kv = lines.filter(F.col("value").contains("=")).select(
        "path", F.trim(F.substring_index("value", "=", 1)).alias("k"), F.trim(F.expr("substring(value, instr(value, '=') + 1)")).alias("v"))
    once = kv.groupBy("path", "k").agg(F.min("v").alias("v"))
    return once.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("meta"))


def product_time(text: Column) -> Column:
    """Timestamps written with month names, e.g. 05-FEB-2025 13:11:02.250, read as UTC."""
    return F.to_timestamp(F.initcap(text), "dd-MMM-yyyy HH:mm:ss.SSS")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a folder with its name, size and SHA-256; JSON is hashed in canonical form.

    Content is read in the tasks that hash it and never collected.
    """
    from driftwake.operators.custody import auditable, canonical_json_sha256

    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = auditable(f.withColumn("name", F.element_at(F.split("path", "/"), -1)))
    as_json = F.col("name").rlike(r"\.(geo)?json$")

    def hashed(files: DataFrame, digest: Column) -> DataFrame:
        return files.select("path", "name", F.col("length").alias("bytes"), digest.alias("sha256"))

    # Two branches, so that only JSON files reach Python.
    return hashed(named.filter(as_json), canonical_json_sha256(F.col("content").cast("string"))).union(
        hashed(named.filter(~as_json), F.sha2("content", 256)))


def drop_in_catalogue(spark: SparkSession, rasters: str, sidecars: str) -> DataFrame:
    """Dropped-in rasters with their sidecar metadata, joined on file stem; absent fields stay null."""
    from driftwake.operators.catalogue import with_sidecars

    r = spark.read.format("binaryFile").load(rasters).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    s = spark.read.schema(schemas.SIDECAR.removeprefix("path string, ")).json(sidecars, multiLine=True).withColumn("path", F.input_file_name())
    return with_sidecars(r, s).withColumn("mode", F.lit("LIVE_DROPIN"))


def unpack_tiles(tiles: DataFrame) -> DataFrame:
    """Tile rows (scene_id, ty, tx, h, w, y0, x0, data binary of uint8) to pixel rows."""
    i = F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1))
    hexed = tiles.withColumn("hex", F.hex("data"))
    p = hexed.select("scene_id", "y0", "x0", "w", "hex", i.alias("i"))
    dn = F.conv(F.substring(F.col("hex"), F.col("i") * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
    return p.select("scene_id", (F.col("y0") + F.floor(F.col("i") / F.col("w"))).alias("row_id"),
                    (F.col("x0") + F.col("i") % F.col("w")).alias("col_id"), dn.alias("dn"))
