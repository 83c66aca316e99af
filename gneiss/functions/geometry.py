"""Areas, weights and projections on the sphere."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

RADIUS = 6_371_000.0


def cell_area(lon0: Column, lon1: Column, lat0: Column, lat1: Column, radius: float = RADIUS) -> Column:
    """The area of a cell between two meridians and two parallels, in degrees: a difference of caps."""
    return radius * radius * F.abs(F.radians(lon1 - lon0)) * F.abs(F.sin(F.radians(lat1)) - F.sin(F.radians(lat0)))


def central_angle(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """The haversine distance on the unit sphere."""
    h = F.pow(F.sin(F.radians(lat1 - lat0) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def triangle_area(a: Column, b: Column, c: Column, radius: float = RADIUS) -> Column:
    """The area of a spherical triangle from its sides (angles): L'Huilier's excess."""
    s = (a + b + c) / 2
    t = F.tan(s / 2) * F.tan((s - a) / 2) * F.tan((s - b) / 2) * F.tan((s - c) / 2)
    return radius * radius * 4 * F.atan(F.sqrt(F.greatest(t, F.lit(0.0))))


def equal_weight(record: Window) -> Column:
    return F.lit(1.0) / F.count("*").over(record)


def renormalised(weight: Column, valid: Column, record: Window) -> Column:
    """``weight`` scaled so that the valid cells of a record weigh 1 together; null for invalid cells."""
    return F.when(valid, F.try_divide(weight, F.sum(F.when(valid, weight)).over(record)))


def unrotated(rlon: Column, rlat: Column, pole_lon: float, pole_lat: float) -> Column:
    """(lon, lat) of a point given on a rotated grid whose north pole stands at (pole_lon, pole_lat)."""
    a, b = F.radians(rlon), F.radians(rlat)
    p = F.radians(F.lit(pole_lat))
    lat = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(p) * F.sin(b) + F.cos(p) * F.cos(b) * F.cos(a))))
    y = F.cos(b) * F.sin(a)
    x = F.sin(p) * F.cos(b) * F.cos(a) - F.cos(p) * F.sin(b)
    lon = F.lit(pole_lon) + 180.0 + F.degrees(F.atan2(y, x)) - 180.0 - 180.0
    return F.struct((F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).alias("lon"), F.degrees(lat).alias("lat"))


def rotated(lon: Column, lat: Column, pole_lon: float, pole_lat: float) -> Column:
    """(lon, lat) on the rotated grid: the inverse of ``unrotated``."""
    a, b = F.radians(lon - pole_lon), F.radians(lat)
    p = F.radians(F.lit(pole_lat))
    rlat = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(b) * F.sin(p) + F.cos(b) * F.cos(p) * F.cos(a))))
    y = -F.cos(b) * F.sin(a)
    x = -F.cos(b) * F.sin(p) * F.cos(a) + F.sin(b) * F.cos(p)
    return F.struct(F.degrees(F.atan2(y, x)).alias("lon"), F.degrees(rlat).alias("lat"))


def vertices(centre: Column, order: Window) -> Column:
    """(lower, upper) bounds of a cell halfway to its neighbours; the outer ones mirror the inner."""
    up, down = F.lead(centre).over(order), F.lag(centre).over(order)
    return F.struct((centre - F.coalesce(centre - down, up - centre) / 2).alias("lower"), (centre + F.coalesce(up - centre, centre - down) / 2).alias("upper"))


def planck(wavelength: Column, temperature: Column) -> Column:
    """Spectral radiance of a black body, SI units."""
    c1, c2 = 1.191042972e-16, 1.438776877e-2
    return F.lit(c1) / F.pow(wavelength, 5) / (F.exp(F.lit(c2) / (wavelength * temperature)) - 1)


def from_dms(degrees: Column, minutes: Column, seconds: Column) -> Column:
    return F.when(degrees < 0, -1.0).otherwise(1.0) * (F.abs(degrees) + minutes / 60 + seconds / 3600)
