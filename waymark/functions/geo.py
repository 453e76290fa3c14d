"""Distances and coordinate rules. Three distance formulas exist side by side and must not be mixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
DEGREE_M = 111_000.0


def _half(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    return a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres, arctangent form."""
    h = _half(lat1, lng1, lat2, lng2)
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def haversine_arcsine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres, arcsine form."""
    return 2 * EARTH_M * F.asin(F.sqrt(_half(lat1, lng1, lat2, lng2)))


def planar(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on a plane of degrees, without the narrowing of meridians."""
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lng1 - lng2) * (lng1 - lng2)) * DEGREE_M


def distance_step(metres: Column, step: int = 50, limit: int = 500) -> Column:
    """The smallest multiple of ``step`` that holds the distance; null beyond ``limit``."""
    up = F.greatest(F.ceil(metres / step) * step, F.lit(step))
    return F.when(up <= limit, up)


def coordinate_problem(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    """What is wrong with a point: null if nothing or if both parts are null. ``box``: lat and lng limits."""
    lo_lat, hi_lat, lo_lng, hi_lng = box
    return (
        F.when(lat.isNull() & lng.isNull(), None)
        .when(lat.isNull() | lng.isNull(), "incomplete")
        .when((lat == 0) | (lng == 0), "zero")
        .when(lat.between(lo_lng, hi_lng) & lng.between(lo_lat, hi_lat), "swapped")
        .when(~(lat.between(lo_lat, hi_lat) & lng.between(lo_lng, hi_lng)), "outside")
    )


def shortfall(goal: Column, total: Column, done: Column) -> Column:
    """How many more of ``total`` must be done to reach ``goal`` percent."""
    return F.greatest(F.lit(0), F.ceil(goal * total / 100 - done - 1e-9))
