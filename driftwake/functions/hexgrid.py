"""Equal-area hexagonal grid: cells of one size everywhere, as axial indices on a cylindrical equal-area plane, with parents."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwake.functions.geo import EARTH_RADIUS_KM

#: Edge of a cell of level 0; each level has a seventh of the area of the one before.
EDGE_KM = 1100.0
ROOT3 = math.sqrt(3.0)
_HALF, _BITS = 1 << 27, 28


def edge_km(level: int) -> float:
    return EDGE_KM / 7.0 ** (level / 2)


def cell_area_km2(level: int) -> float:
    return 1.5 * ROOT3 * edge_km(level) ** 2


def _rounded(q: Column, r: Column) -> tuple[Column, Column]:
    """Nearest hexagon centre of fractional axial coordinates: of the three rounded ones, the worst is derived from the others."""
    s = -q - r
    half_up = lambda v: F.floor(v + 0.5)
    dq, dr, ds = (F.abs(half_up(v) - v) for v in (q, r, s))
    return (F.when((dq > dr) & (dq > ds), -half_up(r) - half_up(s)).otherwise(half_up(q)),
            F.when((dr >= dq) & (dr > ds), -half_up(q) - half_up(s)).otherwise(half_up(r)))


def hex_cell(lat: Column, lon: Column, level: int) -> Column:
    """Index of the cell around a position, as one long: level, then the two axial numbers. Longitudes are taken into [-180, 180)."""
    size = edge_km(level)
    x = F.radians(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0) * EARTH_RADIUS_KM
    y = F.sin(F.radians(lat)) * EARTH_RADIUS_KM
    q, r = _rounded((x * (ROOT3 / 3.0) - y / 3.0) / size, y * (2.0 / 3.0) / size)
    return F.lit(level << 2 * _BITS) + (q + _HALF) * (1 << _BITS) + (r + _HALF)


def hex_level(cell: Column) -> Column:
    return F.shiftright(cell, 2 * _BITS).cast("int")


def hex_centre(cell: Column, level: int) -> tuple[Column, Column]:
    """(lat, lon) of a cell's centre."""
    size, mask = edge_km(level), (1 << _BITS) - 1
    q = F.shiftright(cell, _BITS).bitwiseAND(mask) - _HALF
    r = cell.bitwiseAND(mask) - _HALF
    x, y = (q + r / 2.0) * (ROOT3 * size), r * (1.5 * size)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y / EARTH_RADIUS_KM)))), F.degrees(x / EARTH_RADIUS_KM)


def hex_parent(cell: Column, level: int) -> Column:
    """Cell of the level above that holds this cell's centre."""
    lat, lon = hex_centre(cell, level)
    return hex_cell(lat, lon, level - 1)
