"""Distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6378.137


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2))
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def within_km(lat: Column, lon: Column, centre: tuple[float, float], km: float) -> Column:
    """Whether a place is at most `km` away; false without a place. A latitude band prunes first."""
    band = km / 110.0
    near = lat.between(centre[0] - band, centre[0] + band)
    return F.coalesce(near & (haversine_km(lat, lon, F.lit(centre[0]), F.lit(centre[1])) <= km), F.lit(False))
