"""Row contracts: boolean rules to a list of violations, and a split into valid and quarantined rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    holds: str


AIS_RULES = (
    Rule("mmsi_missing", "mmsi is not null"), Rule("time_missing", "t_us is not null"),
    Rule("lat_range", "lat between -90 and 90"), Rule("lon_range", "lon between -180 and 180"),
    Rule("cog_range", "cog is null or (cog >= 0 and cog < 360.0001)"), Rule("sog_negative", "sog is null or sog >= 0"))


def require_columns(df: DataFrame, required: Sequence[str], what: str = "input") -> DataFrame:
    """Fail before any work when columns are missing, listing what was found."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns {missing}; found {df.columns}")
    return df


def reject_unknown(df: DataFrame, allowed: Sequence[str], what: str = "input") -> DataFrame:
    extra = sorted(set(df.columns) - set(allowed))
    if extra:
        raise ValueError(f"{what} has fields outside its contract: {extra}")
    return df


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``violations``: the names of the rules a row breaks. An undecided rule counts as broken."""
    broken = [F.when(~F.coalesce(F.expr(r.holds), F.lit(False)), r.name) for r in rules]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    v = validate(df, rules)
    return v.filter(F.size("violations") == 0).drop("violations"), v.filter(F.size("violations") > 0)
