"""Vessel identity decoding and rule tables as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwake.config import DEFAULT, Config

# AIS ship-type codes, maritime identification digits at ingest, and the
# smaller register the trust check uses. The two digit tables differ on purpose.
TYPE_EXACT = {
    30: "Fishing Vessel", 31: "Towing", 32: "Towing Large", 33: "Dredger", 34: "Diving Support",
    35: "Military", 36: "Sailing Vessel", 37: "Pleasure Craft", 50: "Pilot Vessel",
    51: "Search And Rescue", 52: "Tug", 53: "Port Tender", 54: "Anti-Pollution",
    55: "Law Enforcement", 58: "Medical Transport", 59: "Non-Combatant",
}
TYPE_RANGES = (
    (20, 29, "Wing In Ground"), (40, 49, "High Speed Craft"), (60, 69, "Passenger"),
    (70, 79, "Cargo"), (80, 89, "Tanker"), (90, 99, "Other"),
)
MID_INGEST = {
    205: "BE", 211: "DE", 218: "DE", 219: "DK", 220: "DK", 224: "ES", 227: "FR", 228: "FR",
    232: "GB", 235: "GB", 236: "GI", 240: "GR", 241: "GR", 244: "NL", 245: "NL", 246: "NL",
    247: "IT", 248: "MT", 249: "MT", 257: "NO", 258: "NO", 259: "NO", 265: "SE", 266: "SE",
    273: "RU", 305: "AG", 306: "CW", 316: "CA", 338: "US", 339: "KY", 341: "KN", 345: "MX",
    366: "US", 367: "US", 368: "US", 369: "US", 370: "PA", 371: "PA", 372: "PA", 373: "PA",
    374: "PA", 403: "SA", 412: "CN", 419: "IN", 422: "IR", 431: "JP", 440: "KR", 461: "OM",
    463: "PK", 470: "AE", 477: "HK", 525: "ID", 533: "MY", 538: "MH", 548: "PH", 563: "SG",
    567: "TH", 574: "VN", 636: "LR", 710: "BR", 725: "CL", 761: "VE",
}
MID_REGISTER = {
    232: "GB", 235: "GB", 240: "GR", 249: "MT", 316: "CA", 338: "US", 366: "US", 367: "US",
    368: "US", 369: "US", 371: "PA", 403: "SA", 412: "CN", 419: "IN", 422: "IR", 461: "OM",
    463: "PK", 470: "AE", 477: "HK", 525: "ID", 538: "MH", 563: "SG", 636: "LR",
}
OIL_CAPABLE = "Tanker|Cargo|Towing"


def _lookup(table: dict[int, str], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, key)


def vessel_type_label(code: Column) -> Column:
    c = code.cast("int")
    by_range = F.lit(None).cast("string")
    for lo, hi, label in TYPE_RANGES:
        by_range = F.when(c.between(lo, hi), label).otherwise(by_range)
    return F.coalesce(_lookup(TYPE_EXACT, c), by_range)


def mid_of(mmsi: Column) -> Column:
    """First three digits of a full-length identity, else null."""
    s = mmsi.cast("string")
    return F.when(F.length(s) >= 9, F.substring(s, 1, 3).cast("int"))


def flag_from_mmsi(mmsi: Column) -> Column:
    return _lookup(MID_INGEST, mid_of(mmsi))


def registered_flag(mmsi: Column) -> Column:
    return _lookup(MID_REGISTER, mid_of(mmsi))


def imo_number(text: Column) -> Column:
    digits = F.trim(F.regexp_replace(F.upper(F.trim(text)), "^IMO", ""))
    return F.when(digits.rlike("^[0-9]+$"), digits.cast("bigint"))


def oil_capable(vessel_type: Column) -> Column:
    return F.coalesce(vessel_type.rlike(OIL_CAPABLE), F.lit(False))


def type_risk(vessel_type: Column, cfg: Config = DEFAULT) -> Column:
    low = F.lower(vessel_type)
    expr = F.lit(cfg.priors.type_risk_default)
    for key, value in reversed(cfg.priors.type_risk):
        expr = F.when(F.coalesce(low.contains(key), F.lit(False)), value).otherwise(expr)
    return expr


def trust_prior(classification: Column, n_critical: Column, n_warn: Column, cfg: Config = DEFAULT) -> Column:
    p = cfg.priors
    return (F.when(classification == "IDENTITY_MISMATCH", p.trust_identity)
            .when(n_critical > 0, p.trust_major).when(n_warn > 0, p.trust_minor).otherwise(p.trust_clean))


def classify(identity_conflict: Column, radar_matched: Column | None = None) -> Column:
    out = F.when(identity_conflict, "IDENTITY_MISMATCH")
    if radar_matched is not None:
        out = out.when(~radar_matched, "PHANTOM")
    return out.otherwise("MATCHED")


def wind_bin(speed: Column) -> Column:
    return (F.when(speed < 0, "10+").when(speed < 3, "0-3").when(speed < 5, "3-5").when(speed < 7, "5-7")
            .when(speed < 10, "7-10").otherwise("10+"))


def size_class(area_km2: Column) -> Column:
    return F.when(area_km2 >= 10, "large").when(area_km2 >= 5, "medium").otherwise("small")


def monitor_result(n_processed: Column, n_new: Column) -> Column:
    return (F.when(n_processed > 0, "PROCESSED NEW DATA").when(n_new > 0, "NEW DATA FOUND")
            .otherwise("NO NEW DATA"))


def provider_result(error: Column) -> Column:
    """A provider's way of saying 'nothing matched' is not an outage."""
    empty = F.lower(error).contains("unavailable for given parameters")
    return F.when(error.isNull(), "OK").when(empty, "NO DATA").otherwise("ERROR")


def refuse_label_paths(path: Column) -> Column:
    """Null for an acceptable input path; raises for one that looks like ground truth."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.assert_true(~(p.contains("ground_truth.json") | p.contains("/label/")),
                         F.concat(F.lit("refusing a label-like input: "), path))
