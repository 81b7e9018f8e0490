"""Wind, geometry and radar arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, BEAM_KM, KM_PER_DEG, RADAR_KM_PER_DEG, MS_PER_KT = 6371.0, 8495.0, 111.32, 111.139, 0.51444
TVS_NEAR, TVS_FAR, TVS_RANGE = 30.0, 20.0, 100.0


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_dir(u: Column, v: Column) -> Column:
    """Direction the wind comes from, 0 to 360 degrees."""
    return F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))


def rotate_wind(u: Column, v: Column, sin: Column, cos: Column) -> tuple[Column, Column]:
    """Earth-relative parts of a grid-relative wind."""
    return u * cos - v * sin, v * cos + u * sin


def section_wind(u: Column, v: Column, bearing: Column) -> tuple[Column, Column]:
    """Parts along and to the left of a bearing."""
    b = F.radians(bearing)
    return u * F.sin(b) + v * F.cos(b), -u * F.cos(b) + v * F.sin(b)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return 2 * radius * F.asin(F.sqrt(F.when(a.isNotNull(), F.least(a, F.lit(1.0)))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing, 0 to 360 degrees."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def intermediate(lat1: Column, lon1: Column, lat2: Column, lon2: Column, f: Column) -> tuple[Column, Column]:
    """Point at a fraction of the great circle."""
    a, b, o, q = F.radians(lat1), F.radians(lat2), F.radians(lon1), F.radians(lon2)
    d = haversine(lat1, lon1, lat2, lon2, 1.0)
    s = F.sin(d)
    wa, wb = F.try_divide(F.sin((1 - f) * d), s), F.try_divide(F.sin(f * d), s)
    x = wa * F.cos(a) * F.cos(o) + wb * F.cos(b) * F.cos(q)
    y = wa * F.cos(a) * F.sin(o) + wb * F.cos(b) * F.sin(q)
    z = wa * F.sin(a) + wb * F.sin(b)
    return F.coalesce(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), lat1), F.coalesce(F.degrees(F.atan2(y, x)), lon1)


def norm_lon(x: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(x + 180, F.lit(360.0)) - 180


def norm_lon_360(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def dlon(x: Column) -> Column:
    """Longitude difference in (-180, 180]."""
    return 180 - F.pmod(180 - x, F.lit(360.0))


def lon_bucket(lon: Column) -> Column:
    """Whole degree of a longitude, 0 to 359, the same for -125 and 235."""
    return F.pmod(F.floor(lon), F.lit(360))


def lon_buckets(west: Column, east: Column) -> Column:
    """Whole degrees from ``west`` to ``east`` (360 degrees on at most), each once, across the date line too."""
    return F.array_distinct(F.transform(F.sequence(F.floor(west), F.least(F.floor(east), F.floor(west) + 359)), lambda x: F.pmod(x, F.lit(360))))


def _shrink(lat: Column, least: float) -> Column:
    """Cosine of a latitude, ``least`` or more; null stays null."""
    return F.when(lat.isNotNull(), F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(least)))


def distance_score(lat: Column, lon: Column, plat: Column, plon: Column) -> Column:
    """Squared degrees, longitudes shrunk by the cosine of the point's latitude (0.2 or more)."""
    east = dlon(lon - plon) * _shrink(plat, 0.2)
    return (lat - plat) * (lat - plat) + east * east


def az_to_latlon(lat: Column, lon: Column, az: Column, range_km: Column) -> tuple[Column, Column]:
    return lat + range_km * F.cos(F.radians(az)) / RADAR_KM_PER_DEG, lon + range_km * F.sin(F.radians(az)) / (RADAR_KM_PER_DEG * F.cos(F.radians(lat)))


def az_diff(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360 - d)


def beam_height(range_km: Column, elev_deg: Column) -> Column:
    """Height of the beam over the radar in km, on an earth of four thirds the radius."""
    return F.sqrt(range_km * range_km + BEAM_KM * BEAM_KM + 2 * range_km * BEAM_KM * F.sin(F.radians(elev_deg))) - BEAM_KM


def unfold(v: Column, ref: Column, nyquist: Column) -> Column:
    """Velocity plus the whole number of Nyquist intervals (8 at most) that brings it nearest to ``ref``."""
    turns = F.round((ref - v) / (2 * nyquist))
    return v + 2 * nyquist * F.when(turns.isNotNull(), F.greatest(F.lit(-8.0), F.least(F.lit(8.0), turns)))


def dealias_delta(d: Column, nyquist: Column) -> Column:
    """A difference brought into one Nyquist interval."""
    folded = F.when(d > nyquist, d - 2 * nyquist * F.ceil((d - nyquist) / (2 * nyquist))).when(d < -nyquist, d + 2 * nyquist * F.ceil((-nyquist - d) / (2 * nyquist))).otherwise(d)
    return F.when(nyquist.isNotNull(), folded)


def storm_relative(v: Column, az: Column, storm_dir: Column, storm_kt: Column) -> Column:
    """Radial velocity without the part of a storm motion (from ``storm_dir``) along the beam."""
    speed, d, a = storm_kt * MS_PER_KT, F.radians(storm_dir), F.radians(az)
    return v - (-speed * F.sin(d) * F.sin(a) - speed * F.cos(d) * F.cos(a))


def tvs_threshold(range_km: Column) -> Column:
    far = F.when(range_km.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), range_km / TVS_RANGE)))
    return TVS_NEAR + far * (TVS_FAR - TVS_NEAR)


def rotation_strength(shear: Column) -> Column:
    return F.when(shear >= 0.012, "strong").when(shear >= 0.008, "moderate").otherwise(F.when(shear.isNotNull(), "weak"))


def centered_bounds(lon: Column, lat: Column, half_height: Column, aspect: float) -> tuple[Column, Column, Column, Column]:
    """west, east, south, north."""
    w = half_height * aspect / _shrink(lat, 0.25)
    return lon - w, lon + w, lat - half_height, lat + half_height


def bounds_area(west: Column, east: Column, south: Column, north: Column) -> Column:
    return F.abs(east - west) * _shrink((south + north) / 2, 0.25) * KM_PER_DEG * F.abs(north - south) * KM_PER_DEG


def overlap_fraction(a: tuple, b: tuple) -> Column:
    """Shared area over the smaller of two bounds."""
    w, e, s, n = F.greatest(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.least(a[3], b[3])
    part = bounds_area(w, e, s, n) / F.greatest(F.least(bounds_area(*a), bounds_area(*b)), F.lit(1.0))
    whole = sum((*a[1:], *b), a[0]).isNotNull()
    return F.when(whole, F.when((e <= w) | (n <= s), 0.0).otherwise(F.least(part, F.lit(1.0))))


def edge_margin(lon: Column, lat: Column, bounds: tuple) -> Column:
    c = _shrink(lat, 0.25) * KM_PER_DEG
    sides = [F.abs(lon - bounds[0]) * c, F.abs(bounds[1] - lon) * c, F.abs(lat - bounds[2]) * KM_PER_DEG, F.abs(bounds[3] - lat) * KM_PER_DEG]
    return F.when(sum(sides[1:], sides[0]).isNotNull(), F.least(*sides))


def expand_to_aspect(west: Column, east: Column, south: Column, north: Column, pad: float, least_half: float, aspect: float) -> tuple[Column, Column, Column, Column]:
    lon, lat = (west + east) / 2, (south + north) / 2
    c = _shrink(lat, 0.25)
    tall = F.when((north - south).isNotNull(), F.greatest((north - south) / 2, F.lit(least_half))) * KM_PER_DEG
    wide = (east - west) / 2 * KM_PER_DEG * c
    half = F.when((tall + wide).isNotNull(), F.greatest(F.greatest(tall, wide / max(aspect, 0.25)) * (1 + max(pad, 0.0)) / KM_PER_DEG, F.lit(least_half)))
    w = half * max(aspect, 0.25) / c
    return lon - w, lon + w, lat - half, lat + half
