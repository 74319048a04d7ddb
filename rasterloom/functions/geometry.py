"""Sun and satellite as seen from a place: angles as column expressions, all in radians.

Azimuths count from the south, positive towards the west; nulls stay null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import physics as P

#: fixed values: the earth's equatorial radius over the distance of a geostationary satellite from its centre (kilometres)
RADIUS, ORBIT = 6378.137, 42164.0
#: fixed values: the gates of glint, mirror and satellite angles in degrees
GLINT, GLINT_SEA, MIRROR_SEA, MIRROR_LOW, MIRROR_HIGH, SATELLITE, MIRROR = 25, 40, 50, 25, 50, 70, (15, 70)


def _acos(x: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def declination(day: Column) -> Column:
    """Of the sun on a day of the year, by the formula of the European Solar Radiation Atlas."""
    j = F.radians(day / 365.0 * 360)
    return F.asin(0.3978 * F.sin(j - math.radians(80.2) + math.radians(1.92) * F.sin(j - math.radians(2.8))))


def sun_altitude(lat: Column, dec: Column, hour: Column) -> Column:
    """Above the horizon, at an hour angle."""
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(hour))))


def sun_azimuth(lat: Column, dec: Column, hour: Column, altitude: Column) -> Column:
    """East (negative) while the hour angle's sine is negative; null where the direction is undefined."""
    angle = _acos(F.try_divide(F.sin(lat) * F.sin(altitude) - F.sin(dec), F.cos(lat) * F.cos(altitude)))
    return F.when(F.sin(hour) < 0, -angle).otherwise(angle)


def satellite_elevation(lat: Column, lon: Column, over: float) -> Column:
    """Of a geostationary satellite over the longitude `over`; negative where it is not seen."""
    cosine = F.cos(lat) * F.cos(lon - over)
    return F.atan2(cosine - RADIUS / ORBIT, F.sqrt(F.greatest(F.lit(0.0), 1 - cosine * cosine)))


def satellite_azimuth(lat: Column, lon: Column, over: float) -> Column:
    return F.atan2(F.sin(lon - over), F.sin(lat) * F.cos(lon - over))


def between(azimuth: Column, elevation: Column, azimuth_2: Column, elevation_2: Column, mirrored: bool = False) -> Column:
    """Angle between two directions; `mirrored`: the second and the mirror image of the first on level ground."""
    along = F.cos(elevation) * F.cos(elevation_2) * F.cos(azimuth - azimuth_2)
    return _acos(F.sin(elevation) * F.sin(elevation_2) + (-along if mirrored else along))


def glint_angle(zen: Column, sat_zen: Column, scatter: Column) -> Column:
    return _acos(P.glint_angle_cosine(zen, sat_zen, scatter))


def glint_gate(is_land: Column, mirror: Column, glint: Column) -> Column:
    wide, sea = glint > math.radians(GLINT), (glint > math.radians(GLINT_SEA)) & ~is_land & (mirror > math.radians(MIRROR_SEA))
    return P.test(wide | sea)


def satellite_gate(mirror: Column, sat_zen: Column) -> Column:
    return P.test((sat_zen < math.radians(SATELLITE)) & ((mirror < math.radians(MIRROR_LOW)) | (mirror > math.radians(MIRROR_HIGH))))


def mirror_gate(mirror: Column) -> Column:
    """Neither severe glint nor the edge of the mirror's disk."""
    return P.between_degrees(mirror, *MIRROR)


def seed_gates(is_land: Column, zen: Column, mirror: Column, sat_zen: Column, glint: Column) -> Column:
    """All angular gates of seeds hold."""
    return mirror_gate(mirror) & P.gate(zen, "temporal") & glint_gate(is_land, mirror, glint) & satellite_gate(mirror, sat_zen)
