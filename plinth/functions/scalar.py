"""Scalar expressions: angles, transfers, 2 x 2 covariances, quaternions, tangent planes. All are plain columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(a: Column) -> Column:
    """Angle in (-pi, pi]."""
    return F.atan2(F.sin(a), F.cos(a))


def clamp01(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def smooth_step(v: Column, low: float, high: float) -> Column:
    t = clamp01((v - low) / max(high - low, 1e-12))
    return t * t * (3 - 2 * t)


def above(v: Column, threshold: float, width: float) -> Column:
    """Probability that rises from 0 at the threshold to 1 one width on."""
    return clamp01((v - threshold) / max(width, 1e-12))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def quantised(x: Column, steps: float = 1e8) -> Column:
    """Half-up to 1 / steps."""
    return F.floor(x * steps + 0.5) / steps


def spd_clip(xx: Column, xy: Column, yy: Column, low: float, high: float) -> dict[str, Column]:
    """Eigenvalues clipped to [low, high], and the matrix, its inverse, determinant and log normaliser that they give."""
    mid, diff = (xx + yy) / 2, (xx - yy) / 2
    r = F.sqrt(diff * diff + xy * xy)
    one, two = (F.least(F.greatest(e, F.lit(low)), F.lit(high)) for e in (mid + r, mid - r))
    safe = F.when(r > 0, r).otherwise(1.0)
    c2, s2 = F.when(r > 0, diff / safe).otherwise(1.0), F.when(r > 0, xy / safe).otherwise(0.0)
    m, d = (one + two) / 2, (one - two) / 2
    cxx, cxy, cyy = m + d * c2, d * s2, m - d * c2
    det = one * two
    return {"cxx": cxx, "cxy": cxy, "cyy": cyy, "ixx": cyy / det, "ixy": -cxy / det, "iyy": cxx / det, "det": det, "log_norm": -math.log(2 * math.pi) - 0.5 * F.ln(det)}


def principal_axis(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column]:
    """Direction of the greater eigenvector and the anisotropy (l1 - l2) / (l1 + l2)."""
    r = F.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    return 0.5 * F.atan2(2 * xy, xx - yy), F.when(xx + yy > 0, 2 * r / F.when(xx + yy > 0, xx + yy)).otherwise(0.0)


def shape(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column, Column, Column]:
    """Trace, anisotropy, minor and major eigenvalue."""
    r = F.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    return xx + yy, principal_axis(xx, xy, yy)[1], F.greatest((xx + yy) / 2 - r, F.lit(0.0)), (xx + yy) / 2 + r


def bhattacharyya(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Shape distance of two covariances (xx, xy, yy) with equal means."""
    det = lambda s: s[0] * s[2] - s[1] * s[1]
    m = tuple((x + y) / 2 for x, y in zip(a, b))
    return 0.5 * F.ln(det(m) / F.sqrt(det(a) * det(b)))


def log_gaussian(dx: Column, dy: Column, xx: Column, xy: Column, yy: Column) -> Column:
    det = xx * yy - xy * xy
    return -math.log(2 * math.pi) - 0.5 * F.ln(det) - 0.5 * (yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy) / det


def quaternion(roll: Column, pitch: Column, yaw: Column) -> tuple[Column, Column, Column, Column]:
    """w, x, y, z of the rotation yaw * pitch * roll."""
    cr, sr, cp, sp, cy, sy = (f(a / 2) for a in (roll, pitch, yaw) for f in (F.cos, F.sin))
    return cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy


def rotation(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def moved(r: list[list[Column]], t: list[Column], p: list[Column], inverse: bool = False) -> list[Column]:
    """r p + t, or its inverse."""
    if inverse:
        q = [a - b for a, b in zip(p, t)]
        return [sum((r[k][i] * q[k] for k in range(3)), F.lit(0.0)) for i in range(3)]
    return [sum((r[i][k] * p[k] for k in range(3)), F.lit(0.0)) + t[i] for i in range(3)]


def slerp(a: list[Column], b: list[Column], f: Column, linear_from: float = 0.9995) -> list[Column]:
    """Along the shorter arc; normalised linear where the quaternions nearly agree."""
    dot = sum((x * y for x, y in zip(a, b)), F.lit(0.0))
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    d = F.least(F.abs(dot), F.lit(1.0))
    near = d >= linear_from
    theta = F.acos(F.when(near, 0.0).otherwise(d))
    wa = F.when(near, 1 - f).otherwise(F.sin((1 - f) * theta) / F.sin(theta))
    wb = F.when(near, f).otherwise(F.sin(f * theta) / F.sin(theta)) * sign
    q = [wa * x + wb * y for x, y in zip(a, b)]
    norm = F.sqrt(sum((x * x for x in q), F.lit(0.0)))
    return [x / norm for x in q]


#: WGS 84, fixed values.
EARTH_A, EARTH_F = 6378137.0, 1 / 298.257223563


def ecef(lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    e2 = EARTH_F * (2 - EARTH_F)
    n = EARTH_A / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return (n + h) * F.cos(lat) * F.cos(lon), (n + h) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + h) * F.sin(lat)


def enu(lat: Column, lon: Column, h: Column, lat0: float, lon0: float, h0: float) -> tuple[Column, Column, Column]:
    """East, north and up of a geodetic place (radians, metres) in the tangent plane at another."""
    e2 = EARTH_F * (2 - EARTH_F)
    n0 = EARTH_A / math.sqrt(1 - e2 * math.sin(lat0) ** 2)
    o = ((n0 + h0) * math.cos(lat0) * math.cos(lon0), (n0 + h0) * math.cos(lat0) * math.sin(lon0), (n0 * (1 - e2) + h0) * math.sin(lat0))
    d = [a - b for a, b in zip(ecef(lat, lon, h), o)]
    s, c, sl, cl = math.sin(lat0), math.cos(lat0), math.sin(lon0), math.cos(lon0)
    return -sl * d[0] + cl * d[1], -s * cl * d[0] - s * sl * d[1] + c * d[2], c * cl * d[0] + c * sl * d[1] + s * d[2]


def utm(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing of the northern hemisphere, by the sixth-order transverse Mercator series."""
    n = EARTH_F / (2 - EARTH_F)
    a = EARTH_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    dl = lon - math.radians(6 * zone - 183)
    sin = F.sin(lat)
    atanh = lambda v: 0.5 * F.ln((1 + v) / (1 - v))
    t = F.sinh(atanh(sin) - e * atanh(e * sin))
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east = eta + sum((alpha[j] * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j in range(3)), F.lit(0.0))
    north = xi + sum((alpha[j] * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j in range(3)), F.lit(0.0))
    return 500000 + 0.9996 * a * east, 0.9996 * a * north


def gps_seconds(week: Column, seconds: Column, week0: int, seconds0: float) -> Column:
    """Seconds since a reference epoch, over week changes."""
    return (week - week0) * 604800 + (seconds - seconds0)


def converted_time(stamp: Column, scale: float, shift: float, first: float, last: float) -> Column:
    """Affine clock conversion; null outside the fitted range, never clamped."""
    return F.when(stamp.between(first, last), scale * stamp + shift)
