"""Solar geometry and layout arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FT = 0.3048
DECLINATION = -23.44
# Module densities below these wattages, and above them all.
DENSITIES = [(250, 150.0), (300, 170.0), (350, 190.0), (400, 205.0), (480, 210.0)]
DENSITY_ABOVE = 215.0
# Clearances in feet by kind of obstruction.
CLEARANCES_FT = {"hatch": 4.0, "standpipe": 4.0, "smoke_vent": 4.0, "skylight": 4.0, "hvac": 3.0, "equipment": 3.0, "small_equipment": 1.0, "vent": 1.0, "other": 1.0}


def winter_profile_angle(lat: Column, hour_angle: float = 30.0) -> Column:
    """The sun's profile angle at the winter solstice in degrees; null where the sun is down."""
    phi, dec, h = F.radians(F.abs(lat)), F.radians(F.lit(DECLINATION)), F.radians(F.lit(hour_angle))
    altitude = F.asin(F.least(F.greatest(F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(h), F.lit(-1.0)), F.lit(1.0)))
    azimuth = F.acos(F.least(F.greatest((F.sin(altitude) * F.sin(phi) - F.sin(dec)) / (F.cos(altitude) * F.cos(phi)), F.lit(-1.0)), F.lit(1.0)))
    return F.when(altitude > 0, F.degrees(F.atan(F.tan(altitude) / F.cos(azimuth))))


def south_row_pitch(slant: Column, tilt: Column, lat: Column) -> Column:
    t = F.radians(tilt)
    return slant * F.cos(t) + slant * F.sin(t) / F.tan(F.radians(winter_profile_angle(lat)))


def flat_row_pitch(racking: Column, slant: Column, tilt: Column, lat: Column, coverage: float | None, gap: float = 0.02) -> Column:
    """Distance of row starts by racking, never less than a row's depth."""
    depth = F.when(racking == "flush", slant).otherwise(slant * F.cos(F.radians(tilt)))
    south = slant / coverage if coverage else south_row_pitch(slant, tilt, lat)
    pitch = F.when(racking == "flush", slant + gap).when(racking == "east_west", slant / (coverage or 0.9)).otherwise(south)
    return F.greatest(pitch, depth)


def module_density(watts: Column) -> Column:
    out = F
    for limit, density in DENSITIES:
        out = out.when(watts < limit, density)
    return out.otherwise(DENSITY_ABOVE)


def perimeter_m(short_axis_m: Column, small_ft: float = 4.0, large_ft: float = 6.0, threshold_ft: float = 250.0) -> Column:
    return F.when(short_axis_m <= threshold_ft * FT, small_ft * FT).otherwise(large_ft * FT)


def clearance_m(kind: Column) -> Column:
    out = F
    for k, v in CLEARANCES_FT.items():
        out = out.when(kind == k, v * FT)
    return out.otherwise(CLEARANCES_FT["other"] * FT)


def residential_rules(occupancy: Column, pitched: Column, alternative: bool = True) -> Column:
    return (occupancy == "R-3") | (pitched & (occupancy == "R-2") & F.lit(alternative))


def poleward(azimuth: Column, lat: Column, cone: float = 45.0) -> Column:
    """Whether a slope faces the pole of its hemisphere within a cone."""
    pole = F.when(lat >= 0, 0.0).otherwise(180.0)
    return F.abs(F.pmod(azimuth - pole + 180, F.lit(360.0)) - 180) < cone


def community_radius(units: Column) -> Column:
    return F.greatest(F.lit(150.0), F.least(F.lit(1000.0), 1.6 * F.sqrt(units * 450 / F.pi())))


def agreement_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)
