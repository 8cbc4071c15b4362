"""Geodesy, angles, vectors and unit conversions as column expressions. Angles are radians unless a name says degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: equatorial radius of the earth in metres.
EARTH_RADIUS = 6378137.0
TWO_PI = 2.0 * math.pi


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def east_north(lat: Column, lon: Column, lat0: Column | float, lon0: Column | float) -> tuple[Column, Column]:
    """Local east and north of a position in degrees, about an origin in degrees (equirectangular)."""
    lat0, lon0 = _c(lat0), _c(lon0)
    return F.radians(_c(lon) - lon0) * EARTH_RADIUS * F.cos(F.radians(lat0)), F.radians(_c(lat) - lat0) * EARTH_RADIUS


def lat_lon(east: Column, north: Column, lat0: Column | float, lon0: Column | float) -> tuple[Column, Column]:
    """Inverse of east_north()."""
    lat0, lon0 = _c(lat0), _c(lon0)
    return lat0 + F.degrees(_c(north) / EARTH_RADIUS), lon0 + F.degrees(_c(east) / (F.lit(EARTH_RADIUS) * F.cos(F.radians(lat0))))


def heading_to_yaw(heading_deg: Column) -> Column:
    """Compass heading (degrees clockwise from north) to yaw (counter-clockwise from east)."""
    return F.radians(F.lit(90.0) - _c(heading_deg))


def wrap(angle: Column) -> Column:
    """An angle in [-pi, pi), by floored modulo."""
    a = _c(angle)
    return a - F.lit(TWO_PI) * F.floor((a + math.pi) / TWO_PI)


def rotate_xy(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """A plane vector turned counter-clockwise by an angle: takes an azimuth-rotated accelerometer back to the body frame."""
    x, y, a = _c(x), _c(y), _c(angle)
    return F.cos(a) * x - F.sin(a) * y, F.sin(a) * x + F.cos(a) * y


def norm(*parts: Column | str) -> Column:
    """Euclidean length of a vector."""
    total = F.lit(0.0)
    for p in parts:
        total = total + _c(p) * _c(p)
    return F.sqrt(total)


def clip(x: Column, limit: float) -> Column:
    """x within plus or minus limit; null stays null."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(limit))), F.lit(-float(limit))))


def at_least(x: Column, floor: float) -> Column:
    """x or floor, whichever is more; null stays null."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(floor))))


def angle_between_deg(a: list[Column], b: list[Column]) -> Column:
    """Angle of two vectors in degrees, null for one without length; rounding never leaves the domain of the arc cosine."""
    dot = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        dot = dot + _c(x) * _c(y)
    cosine = F.try_divide(dot, norm(*a) * norm(*b))
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def rotation_to_up(x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rows of the least rotation that takes a vector to +z; straight down turns about x."""
    n = norm(x, y, z)
    ux, uy, uz = F.try_divide(_c(x), n), F.try_divide(_c(y), n), F.try_divide(_c(z), n)
    down = uz <= -1.0 + 1e-12
    k = F.when(down, F.lit(0.0)).otherwise(1.0 / (1.0 + uz))
    flat = lambda normal, straight: F.when(down, F.lit(straight)).otherwise(normal)
    return [
        [flat(1.0 - ux * ux * k, 1.0), flat(-ux * uy * k, 0.0), flat(-ux, 0.0)],
        [flat(-ux * uy * k, 0.0), flat(1.0 - uy * uy * k, -1.0), flat(-uy, 0.0)],
        [flat(ux, 0.0), flat(uy, 0.0), flat(uz, -1.0)],
    ]


def rotate(matrix: list[list[Column]], v: list[Column]) -> list[Column]:
    """A 3 x 3 matrix of columns times a vector of columns."""
    return [sum((m * _c(x) for m, x in zip(row[1:], v[1:], strict=True)), row[0] * _c(v[0])) for row in matrix]


def heading_error(yaw: Column, road_yaw: Column, oneway: Column) -> tuple[Column, Column]:
    """(error, direction used) of a heading against a road that may be driven both ways unless oneway."""
    forward, backward = F.abs(wrap(_c(yaw) - _c(road_yaw))), F.abs(wrap(_c(yaw) - _c(road_yaw) - math.pi))
    reverse = (backward < forward) & ~_c(oneway)
    return F.when(reverse, backward).otherwise(forward), F.when(reverse, _c(road_yaw) + math.pi).otherwise(_c(road_yaw))


def softplus(x: Column) -> Column:
    x = _c(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def std_from_logvar(logvar: Column, scale: float = 1.0, low: float = -6.0, high: float = 6.0) -> Column:
    """Standard deviation of a clamped log-variance, times a calibration factor."""
    return F.exp(0.5 * F.greatest(F.least(_c(logvar), F.lit(high)), F.lit(low))) * scale


def ar1_inflation(spacing_s: float, tau_s: float) -> float:
    """Variance factor of samples spacing_s apart of an error with correlation time tau_s."""
    rho = math.exp(-spacing_s / tau_s) if tau_s > 0 else 0.0
    return (1 + rho) / (1 - rho)


def kmh_to_ms(x: Column) -> Column:
    return _c(x) / 3.6


def time_of_day_s(text: Column) -> Column:
    """Seconds of the day of a wall clock written Y-m-d H:M:S:fraction; null where it is not one."""
    text = F.trim(_c(text))
    pattern = r"^\d{4}-\d{2}-\d{2} (\d{2}):(\d{2}):(\d{2}):(\d{1,6})$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    number = lambda i: part(i).try_cast("double")
    stamp = F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    seconds = number(1) * 3600 + number(2) * 60 + number(3) + F.concat(F.lit("0."), part(4)).try_cast("double")
    return F.when((part(1) != "") & stamp.isNotNull(), seconds)
