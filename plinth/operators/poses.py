"""Poses and sensor geometry: interpolated poses, deskew, tilt, line residuals, output points, map projection, sigma points.

Rotations are unit quaternions or 3 x 3 column matrices of ``functions.scalar``; as-of brackets come from ``operators.asof``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import scalar
from plinth.operators import asof

QUATERNION = ("qw", "qx", "qy", "qz")


def interpolated_pose(left: DataFrame, poses: DataFrame, keys: list[str], time: str, position: list[str], widest: float) -> DataFrame:
    """Left rows with the pose at their time between the rows around it: position linear, quaternion along the shorter arc; rows without a bracket of at most ``widest`` go (nothing is extrapolated)."""
    out = asof.bracket(left, poses, keys, time, [*position, *QUATERNION]).where(F.col("lo").isNotNull() & F.col("hi").isNotNull())
    width = F.col("hi.t") - F.col("lo.t")
    out = out.where(width <= widest).withColumn("__w", F.when(width > 0, (F.col(time) - F.col("lo.t")) / F.when(width > 0, width)).otherwise(0.0))
    q = scalar.slerp([F.col(f"lo.{c}") for c in QUATERNION], [F.col(f"hi.{c}") for c in QUATERNION], F.col("__w"))
    at = {p: (1 - F.col("__w")) * F.col(f"lo.{p}") + F.col("__w") * F.col(f"hi.{p}") for p in position}
    return out.withColumns(at | dict(zip(QUATERNION, q))).drop("lo", "hi", "__w")


def deskewed(points: DataFrame, poses: DataFrame, keys: list[str], time: str, point: list[str], position: list[str], widest: float) -> DataFrame:
    """Points with gx, gy, gz in the fixed frame. Poses are found once per distinct time and joined back."""
    times = points.select(*keys, time).distinct()
    at = interpolated_pose(times, poses, keys, time, position, widest)
    r = scalar.rotation(*(F.col(c) for c in QUATERNION))
    g = scalar.moved(r, [F.col(p) for p in position], [F.col(p) for p in point])
    return points.join(at, [*keys, time]).withColumns(dict(zip(("gx", "gy", "gz"), g)))


def planar_and_tilt(r: list[list[Column]]) -> tuple[Column, list[list[Column]]]:
    """The heading of a rotation, and the rotation that is left when it is taken out."""
    yaw = F.atan2(r[1][0], r[0][0])
    c, s = F.cos(yaw), F.sin(yaw)
    return yaw, [[c * r[0][j] + s * r[1][j] for j in range(3)], [c * r[1][j] - s * r[0][j] for j in range(3)], [r[2][j] for j in range(3)]]


def leveling(roll: Column, pitch: Column, rates: tuple[Column, Column, Column]) -> tuple[list[list[Column]], list[list[Column]]]:
    """The yaw-free rotation pitch * roll and its time derivative under body rates; null near a vertical pitch."""
    cr, sr, cp, sp = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch)
    usable = F.abs(cp) > 1e-6
    roll_rate = F.when(usable, rates[0] + sp / F.when(usable, cp) * (sr * rates[1] + cr * rates[2]))
    pitch_rate = F.when(usable, cr * rates[1] - sr * rates[2])
    zero = F.lit(0.0)
    rotation = [[cp, sp * sr, sp * cr], [zero, cr, -sr], [-sp, cp * sr, cp * cr]]
    by_pitch = [[-sp, cp * sr, cp * cr], [zero, zero, zero], [-cp, -sp * sr, -sp * cr]]
    by_roll = [[zero, sp * cr, -sp * sr], [zero, -sr, -cr], [zero, cp * cr, -cp * sr]]
    return rotation, [[by_pitch[i][j] * pitch_rate + by_roll[i][j] * roll_rate for j in range(3)] for i in range(3)]


def line_measurement(x: Column, y: Column, mx: Column, my: Column, nx: Column, ny: Column, pose: tuple[Column, Column, Column]) -> tuple[Column, tuple[Column, Column, Column]]:
    """Residual of a scan point against a map line (a point of it and its unit normal) at a pose, and its gradient by the pose."""
    c, s = F.cos(pose[2]), F.sin(pose[2])
    rx, ry = c * x - s * y, s * x + c * y
    return nx * (rx + pose[0] - mx) + ny * (ry + pose[1] - my), (nx, ny, ny * rx - nx * ry)


def output_point(x: Column, y: Column, information: tuple[Column, Column, Column], yaw: Column, offset: tuple[float, float], spread: tuple[float, float, float], yaw_std: float) -> tuple[Column, Column, tuple[Column, Column, Column]]:
    """A receiver's position moved to the vehicle's output point, and its information with the offset's and heading's uncertainty added."""
    c, s = F.cos(yaw), F.sin(yaw)
    ox, oy = c * offset[0] - s * offset[1], s * offset[0] + c * offset[1]
    det = information[0] * information[2] - information[1] * information[1]
    cxx, cxy, cyy = spread
    xx = information[2] / det + c * c * cxx - 2 * c * s * cxy + s * s * cyy + yaw_std**2 * oy * oy
    xy = -information[1] / det + c * s * (cxx - cyy) + (c * c - s * s) * cxy - yaw_std**2 * ox * oy
    yy = information[0] / det + s * s * cxx + 2 * c * s * cxy + c * c * cyy + yaw_std**2 * ox * ox
    whole = xx * yy - xy * xy
    return x - ox, y - oy, (yy / whole, -xy / whole, xx / whole)


def utm_factors(lat: Column, lon: Column, zone: int) -> tuple[Column, Column, Column, Column]:
    """Easting, northing (southern ones from 10,000,000 down), meridian convergence and point scale, by the series of ``scalar.utm``."""
    n = scalar.EARTH_F / (2 - scalar.EARTH_F)
    a = scalar.EARTH_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    dl = lon - math.radians(6 * zone - 183)
    atanh = lambda v: 0.5 * F.ln((1 + v) / (1 - v))
    t = F.sinh(atanh(F.sin(lat)) - e * atanh(e * F.sin(lat)))
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    p = 1 + sum((2 * (j + 1) * alpha[j] * F.cos(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j in range(3)), F.lit(0.0))
    q = sum((2 * (j + 1) * alpha[j] * F.sin(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j in range(3)), F.lit(0.0))
    convergence = F.atan(t * F.tan(dl) / F.sqrt(1 + t * t)) + F.atan2(q, p)
    tan = F.tan(lat)
    scale = 0.9996 * a / scalar.EARTH_A * F.sqrt(p * p + q * q) * F.sqrt(1 + tan * tan) * F.sqrt(1 - e * e * F.sin(lat) ** 2) / F.sqrt(t * t + F.cos(dl) ** 2)
    east, north = scalar.utm(lat, lon, zone)
    return east, F.when(lat < 0, north + 10_000_000).otherwise(north), convergence, scale


def sigma_points(components: DataFrame, spread: float = 2.5) -> DataFrame:
    """Five points a component (mx, my, sxx, sxy, syy): its mean, and both ways along its axes; with spread 2.5 they have its mean and covariance."""
    turn, _ = scalar.principal_axis(F.col("sxx"), F.col("sxy"), F.col("syy"))
    _, _, minor, major = scalar.shape(F.col("sxx"), F.col("sxy"), F.col("syy"))
    a, b = F.sqrt(major * spread), F.sqrt(minor * spread)
    c, s = F.cos(turn), F.sin(turn)
    ways = [(F.lit(0.0), F.lit(0.0)), (a * c, a * s), (-a * c, -a * s), (-b * s, b * c), (b * s, -b * c)]
    spots = F.array(*(F.struct(F.lit(i).alias("i"), (F.col("mx") + x).alias("x"), (F.col("my") + y).alias("y")) for i, (x, y) in enumerate(ways)))
    return components.withColumn("__p", F.explode(spots)).select(*components.columns, F.col("__p.i").alias("sigma"), F.col("__p.x").alias("x"), F.col("__p.y").alias("y"))


def running_track(df: DataFrame, keys: list[str], order: list[str], weight: Column | None = None) -> DataFrame:
    """Running mean and scatter of a track's components (mx, my, sxx, sxy, syy), row by row: the scatters' mean and the means' own covariance.

    With a weight (the view's kernel) both are weighted; weights of 1 give the plain running update.
    """
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__w", F.lit(1.0) if weight is None else weight)
    total = F.sum("__w").over(run)
    mean = {a: F.sum(F.col("__w") * F.col(f"m{a}")).over(run) / total for a in "xy"}
    # about the track's first mean, so that squares of large coordinates don't cancel
    first = {a: F.first(f"m{a}").over(run) for a in "xy"}
    off = {a: F.col(f"m{a}") - first[a] for a in "xy"}
    d = d.withColumns({f"__{a}": off[a] for a in "xy"})
    part = lambda e: F.sum(F.col("__w") * e).over(run) / total
    cov = {a + b: part(F.col(f"s{a}{b}")) + part(F.col(f"__{a}") * F.col(f"__{b}")) - part(F.col(f"__{a}")) * part(F.col(f"__{b}")) for a, b in ("xx", "xy", "yy")}
    return d.withColumns({"track_n": F.count("*").over(run)} | {f"track_m{a}": m for a, m in mean.items()} | {f"track_s{p}": c for p, c in cov.items()}).drop("__w", "__x", "__y")


def braking_profile(df: DataFrame, keys: list[str], along: str, limit: Column, braking: float) -> DataFrame:
    """Adds speed: the greatest that keeps every limit ahead within reach of the brakes; the backward recursion is a running least of v^2 + 2 a s."""
    ahead = Window.partitionBy(*keys).orderBy(F.col(along).desc()).rowsBetween(Window.unboundedPreceding, 0)
    energy = limit * limit + 2 * braking * F.col(along)
    return df.withColumn("speed", F.sqrt(F.greatest(F.min(energy).over(ahead) - 2 * braking * F.col(along), F.lit(0.0))))


def covered_join(left: DataFrame, right: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Equi-join in which every left row must have its match: the first one without is an error."""
    found = left.join(right.select(*keys, F.struct(*payload).alias("__p")), keys, "left")
    name = F.concat_ws(":", *(F.col(k).cast("string") for k in keys))
    whole = F.when(F.col("__p").isNotNull(), F.col("__p")).otherwise(F.raise_error(F.concat(F.lit("no match for "), name)))
    return found.withColumn("__p", whole).select(*left.columns, *(F.col(f"__p.{p}").alias(p) for p in payload))


def polynomial_slopes(window: int, order: int):
    """window x window weights: row i has the derivative at place i of the least-squares polynomial over the window."""
    import numpy as np

    t = np.arange(window) - window // 2
    fit = np.linalg.pinv(np.vander(t / (window // 2), order + 1, increasing=True))
    rate = np.zeros((window, order + 1))
    for k in range(1, order + 1):
        rate[:, k] = k * (t / (window // 2)) ** (k - 1) / (window // 2)
    return rate @ fit


def smooth_derivative(df: DataFrame, keys: list[str], time: str, value: str, window: int = 51, order: int = 3, name: str = "slope") -> DataFrame:
    """Derivative per row of the polynomial fitted over a centred window; near a key's ends, of that over its first or last window. Null for keys with fewer rows."""
    weights, half = polynomial_slopes(window, order), window // 2
    w, by = Window.partitionBy(*keys).orderBy(time), Window.partitionBy(*keys)
    # each row's place in its window: half inside, less or more at the ends
    d = df.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count("*").over(by)})
    table = F.array(*(F.array(*map(F.lit, map(float, row))) for row in weights))
    rows = F.collect_list(value).over(w.rowsBetween(-half, half))
    middle = F.aggregate(F.zip_with(rows, F.lit([float(x) for x in weights[half]]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    # the polynomial of an end: sums of its window's values by the fit's weights, the same for all rows of the end
    import numpy as np

    fit = np.linalg.pinv(np.vander((np.arange(window) - half) / half, order + 1, increasing=True))
    ends = {}
    for side, place in (("a", F.col("__i")), ("z", F.col("__i") - F.col("__n") + window)):
        inside = (place >= 0) & (place < window)
        for k in range(1, order + 1):
            weight = F.element_at(F.array(*(F.lit(float(x)) for x in fit[k])), F.when(inside, place + 1).otherwise(1).cast("int"))
            ends[f"__{side}{k}"] = F.sum(F.when(inside, weight * F.col(value))).over(by)
    d = d.withColumn("__m", middle).withColumns(ends)
    u = lambda place: (place - half) / half
    slope = lambda side, place: sum((F.col(f"__{side}{k}") * k * u(place) ** (k - 1) / half for k in range(1, order + 1)), F.lit(0.0))
    last = F.col("__i") - F.col("__n") + window
    out = F.when(F.col("__n") < window, F.lit(None)).when(F.col("__i") < half, slope("a", F.col("__i"))).when(last > half, slope("z", last)).otherwise(F.col("__m"))
    return d.withColumn(name, out).drop("__i", "__n", "__m", *ends)
