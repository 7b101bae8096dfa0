"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.19492664455873


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    x = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (half_lng * half_lng)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(x), F.sqrt(1 - x))
