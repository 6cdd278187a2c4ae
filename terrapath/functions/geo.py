"""Geodesic column expressions on a sphere (degrees in, metres / degrees out)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapath.config import ARCSEC_PER_DEGREE, COMPASS, EARTH_RADIUS_M, KEY_DECIMALS, MAX_TURN_DEG


def num(x: Column | float | int) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; arguments are latitude first."""
    lat1, lon1, lat2, lon2 = map(num, (lat1, lon1, lat2, lon2))
    half_phi = F.radians(lat2 - lat1) / 2
    half_lam = F.radians(lon2 - lon1) / 2
    a = F.sin(half_phi) * F.sin(half_phi) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lam) * F.sin(
        half_lam
    )
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing_deg(lon1, lat1, lon2, lat2) -> Column:
    """Initial bearing, clockwise from north in [0, 360)."""
    lon1, lat1, lon2, lat2 = map(num, (lon1, lat1, lon2, lat2))
    dlam = F.radians(lon2 - lon1)
    y = F.sin(dlam) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlam)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def destination(lon, lat, bearing, distance_m) -> Column:
    """Point reached from (lon, lat) on a bearing, as struct<lon, lat>."""
    lon, lat, bearing, distance_m = map(num, (lon, lat, bearing, distance_m))
    delta = distance_m / EARTH_RADIUS_M
    phi1, theta = F.radians(lat), F.radians(bearing)
    sin_phi2 = F.sin(phi1) * F.cos(delta) + F.cos(phi1) * F.sin(delta) * F.cos(theta)
    phi2 = F.asin(sin_phi2)
    lam2 = F.radians(lon) + F.atan2(
        F.sin(theta) * F.sin(delta) * F.cos(phi1), F.cos(delta) - F.sin(phi1) * F.sin(phi2)
    )
    return F.struct(F.degrees(lam2).alias("lon"), F.degrees(phi2).alias("lat"))


def point_distance_m(a: Column, b: Column) -> Column:
    """Distance of two point structs; elevation is ignored."""
    return haversine_m(a["lat"], a["lon"], b["lat"], b["lon"])


def compass(bearing) -> Column:
    sector = F.floor(F.pmod(num(bearing) + 22.5, F.lit(360.0)) / 45.0).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), sector + 1)


def utm_code(lon, lat) -> Column:
    zone = (F.floor((num(lon) + 180.0) / 6.0) + 1).cast("int")
    return F.format_string("EPSG:%d%02d", F.when(num(lat) >= 0, F.lit(326)).otherwise(F.lit(327)), zone)


def wrap_turn(delta) -> Column:
    """Signed turn in [-180, 180]; both ends are kept as they are."""
    delta = num(delta)
    wrapped = F.pmod(delta + 180.0, F.lit(360.0)) - 180.0
    return F.when((wrapped == -180.0) & (delta > 0), F.lit(180.0)).otherwise(wrapped)


def clamp_turn(delta, limit: float = MAX_TURN_DEG) -> Column:
    turn = wrap_turn(delta)
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), turn))


def circular_mean_deg(bearings: Column) -> Column:
    """Circular mean of an array of bearings."""
    total = F.aggregate(
        bearings,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")),
        lambda acc, b: F.struct(
            (acc["s"] + F.sin(F.radians(b))).alias("s"), (acc["c"] + F.cos(F.radians(b))).alias("c")
        ),
    )
    return let(total, lambda t: F.pmod(F.degrees(F.atan2(t["s"], t["c"])), F.lit(360.0)))


def raster_col(lon, x0: float, dx: float, scale: float = 1.0) -> Column:
    """Column index; truncates toward zero like the raster reader does."""
    return ((num(lon) * scale - x0) / dx).cast("int")


def raster_row(lat, y0: float, dy: float, scale: float = 1.0) -> Column:
    return ((F.lit(y0) - num(lat) * scale) / dy).cast("int")


def to_arcsec(deg) -> Column:
    return num(deg) * ARCSEC_PER_DEGREE


def coord_key(value, decimals: int = KEY_DECIMALS) -> Column:
    return F.format_string(f"%.{decimals}f", num(value))
