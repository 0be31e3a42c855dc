"""Grid cells and great-circle distance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells along latitude and longitude, and the earth's radius in kilometres.
LAT_CELLS, LNG_CELLS = 136, 100
EARTH_KM = 6371.0


@dataclass(frozen=True)
class GridBounds:
    lat_min: float
    lat_max: float
    lng_min: float
    lng_max: float
    lat_cells: int = LAT_CELLS
    lng_cells: int = LNG_CELLS


def grid_index(value: Column, low: float | Column, high: float | Column, cells: int) -> Column:
    """Truncated position of ``value`` between the bounds; below them, or without extent, 0."""
    low, high = (F.lit(float(x)) if isinstance(x, (int, float)) else x for x in (low, high))
    at = F.try_divide(value - low, high - low) * F.lit(float(cells - 1))
    return F.greatest(F.lit(0), F.coalesce(F.floor(at), F.lit(0))).cast("long")


def cell_id(lat: Column, lng: Column, b: GridBounds) -> Column:
    return grid_index(lng, b.lng_min, b.lng_max, b.lng_cells) * F.lit(b.lat_cells) + grid_index(lat, b.lat_min, b.lat_max, b.lat_cells)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng / 2) * F.sin(dlng / 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))
