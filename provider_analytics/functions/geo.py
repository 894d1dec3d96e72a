"""Coordinates and great-circle distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
RADIUS_STEPS_KM = (10, 20, 30, 50, 100)
# Fixed values: (south, north, west, east) limits for showing a point and for accepting a geocode.
DISPLAY_BOX = (35.0, 48.0, 6.0, 19.5)
GEOCODE_BOX = (35.0, 47.2, 6.0, 19.3)


def as_coord(value: Column) -> Column:
    """Text with a decimal point or comma to double; anything else to null."""
    number = F.replace(F.trim(value.cast("string")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def has_coords(lat: Column, lng: Column) -> Column:
    """Both present and not the 0/0 placeholder."""
    return lat.isNotNull() & lng.isNotNull() & ~((lat == 0) & (lng == 0))


def in_bbox(lat: Column, lng: Column, box: tuple[float, float, float, float] = DISPLAY_BOX) -> Column:
    south, north, west, east = box
    return lat.between(south, north) & lng.between(west, east)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(1.0) - h, F.lit(0.0))))


def acos_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    cosine = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2) - F.radians(lng1)) + F.sin(
        F.radians(lat1)
    ) * F.sin(F.radians(lat2))
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))) * EARTH_KM


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine to a millimetre: the rounding makes equal distances compare as equal."""
    return F.round(haversine_km(lat1, lng1, lat2, lng2), 6)


def parse_radius(value: Column, fallback: int | None = None) -> Column:
    """A requested radius counts only if it is one of the offered steps."""
    number = value.cast("string").try_cast("double")
    return F.when(number.isin(*[float(s) for s in RADIUS_STEPS_KM]), number.cast("int")).otherwise(
        F.lit(fallback).cast("int")
    )


def snap_to_cell(lat: Column, lng: Column, digits: int = 2) -> tuple[Column, Column]:
    """Coordinates rounded to a coarse cell, the key under which reverse lookups are shared."""
    return F.round(lat, digits), F.round(lng, digits)
