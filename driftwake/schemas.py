"""Explicit schemas of the tables this package reads."""

from __future__ import annotations

from pyspark.sql import types as T

AIS_CSV = T.StructType([
    T.StructField("mmsi", T.LongType()), T.StructField("base_date_time", T.StringType()),
    T.StructField("longitude", T.DoubleType()), T.StructField("latitude", T.DoubleType()), T.StructField("sog", T.DoubleType()),
    T.StructField("cog", T.DoubleType()), T.StructField("heading", T.DoubleType()), T.StructField("vessel_name", T.StringType()),
    T.StructField("imo", T.StringType()), T.StructField("vessel_type", T.DoubleType()), T.StructField("length", T.DoubleType())])
AIS_REQUIRED = ("mmsi", "base_date_time", "longitude", "latitude", "sog")
FIX_REQUIRED = ("mmsi", "t_us", "lat", "lon", "sog")
AIS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("mmsi", T.LongType()), T.StructField("t_us", T.LongType()),
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("sog", T.DoubleType()),
    T.StructField("cog", T.DoubleType()), T.StructField("heading", T.DoubleType())])
ENV = T.StructType([
    T.StructField("field_id", T.LongType()), T.StructField("ti", T.LongType()), T.StructField("yi", T.LongType()),
    T.StructField("xi", T.LongType()), T.StructField("t_us", T.LongType()), T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()), T.StructField("wind_u", T.DoubleType()), T.StructField("wind_v", T.DoubleType()),
    T.StructField("curr_u", T.DoubleType()), T.StructField("curr_v", T.DoubleType())])
STATION = ("id string, name string, role string, region string, lat double, lon double, mrcc boolean, nosdcp_tier_min long")
GEOMETRY = "type string, coordinates string"
SIDECAR = ("path string, satellite string, sensor string, product string, acquired_at string, polarisations array<string>, "
           "calibration_constant_db map<string,double>")
GRANULE_PAGE = ("items array<struct<id:string,identifier:string,updated:string,dcDate:string,size_mb:string>>, "
                "entries array<struct<id:string,identifier:string,updated:string,dcDate:string,size_mb:string>>")
EVENT_STREAM = AIS
SCENE_SAMPLE = "scene_id long, cell long, wind_ms double, v double"
