"""Column functions of gridded geography."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
# WGS84 and the standard parallel of the equal-area cylindrical projection EPSG:6933.
WGS84_A, WGS84_E2, LAT_TS = 6378137.0, 0.0066943799901413165, math.radians(30.0)


def wrap_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def bin_index(x: Column, size: float | Column, offset: float) -> Column:
    return F.floor((x + offset) / size).cast("int")


def bin_centre(index: Column, size: float | Column, offset: float) -> Column:
    return index * size - offset + size / 2.0


def log_intensity(value: Column) -> Column:
    return F.log10(value + 1.0)


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance; the argument of asin is clamped to 1. Null where a coordinate is."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))  # least() would pass over a null


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    lo, la = F.radians(lon), F.radians(lat)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def equal_area_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:6933 in metres: Lambert's cylinder on the ellipsoid (Snyder 1987)."""
    e = math.sqrt(WGS84_E2)
    k0 = math.cos(LAT_TS) / math.sqrt(1 - WGS84_E2 * math.sin(LAT_TS) ** 2)
    s = F.sin(F.radians(lat))
    q = (1 - WGS84_E2) * (s / (1 - WGS84_E2 * s * s) - (1 / (2 * e)) * F.log((1 - e * s) / (1 + e * s)))
    return WGS84_A * k0 * F.radians(lon), WGS84_A * q / (2 * k0)


def lisa_label(quadrant: Column, p: Column) -> Column:
    """HH, LH, LL, HL for quadrants 1 to 4 where p is at most 0.05, else NS."""
    names = F.when(quadrant == 1, "HH").when(quadrant == 2, "LH").when(quadrant == 3, "LL").when(quadrant == 4, "HL").otherwise("NS")
    return F.when(p > 0.05, "NS").otherwise(names)


def display_label(name: Column) -> Column:
    """The first underscore as an ampersand."""
    return F.regexp_replace(name, "^([^_]*)_", "$1 & ")


def area_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def resolution_of(zoom: Column) -> Column:
    return F.when(zoom < 3.5, "low").when(zoom < 5.5, "mid").otherwise("high")
