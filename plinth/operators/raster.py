"""Measures on occupied cells of a frame's lattice: pooled moments, energies of height steps, shape scores, nearest filled cells.

Cells are rows (keys, bx, by). Box sums are two one-dimensional passes; what needs single neighbours explodes the offsets on
one side and joins on cells. No raster is ever dense, and nothing crosses a key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.scalar import clamp01, smooth_step
from plinth.operators.binning import neighbours


def cropped(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rx, ry: the bins counted from 1 at the first occupied row and column of the key."""
    by = Window.partitionBy(*keys)
    return cells.withColumns({"rx": F.col("bx") - F.min("bx").over(by) + 1, "ry": F.col("by") - F.min("by").over(by) + 1})


def mapped_cells(cells: DataFrame, keys: list[str], spacing: tuple[float, float], origin: tuple[float, float], to_spacing: tuple[float, float], to_shape: tuple[int, int]) -> DataFrame:
    """keys, cell: the column-major ids, on another lattice, of the cells' centres; centres outside it go, each id comes once."""
    x, y = (F.col("bx") + 0.5) * spacing[0], (F.col("by") + 0.5) * spacing[1]
    bx, by = F.floor((x - origin[0]) / to_spacing[0]) + 1, F.floor((y - origin[1]) / to_spacing[1]) + 1
    inside = cells.withColumns({"__x": bx, "__y": by}).where(F.col("__x").between(1, to_shape[0]) & F.col("__y").between(1, to_shape[1]))
    return inside.select(*keys, ((F.col("__x") - 1) * to_shape[1] + F.col("__y")).alias("cell")).distinct()


def box_sums(cells: DataFrame, keys: list[str], values: dict[str, Column], reach: int) -> DataFrame:
    """keys, bx, by and the sums of the values over all cells within a Chebyshev reach: one pass along columns, one along rows."""
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    spread = cells.select(*keys, "bx", "by", *(v.alias(n) for n, v in values.items())).withColumn("__d", F.explode(offsets))
    along = spread.groupBy(*keys, "bx", (F.col("by") + F.col("__d")).alias("by")).agg(*(F.sum(n).alias(n) for n in values))
    up = along.withColumn("__d", F.explode(offsets)).groupBy(*keys, (F.col("bx") + F.col("__d")).alias("bx"), "by").agg(*(F.sum(n).alias(n) for n in values))
    return cells.select(*keys, "bx", "by").join(up, [*keys, "bx", "by"])


def pooled_spread(cells: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Of the merged populations (n, m*, s** of x, y, z) within reach: vertical, the share of the variance that is vertical, and radial, the horizontal variance that is left after linear dependence on z."""
    n = F.col("n")
    sums: dict[str, Column] = {"__n": n} | {f"__{a}": n * F.col(f"m{a}") for a in "xyz"}
    pairs = ("xx", "yy", "zz", "xz", "yz")
    sums |= {f"__{p}": n * (F.col(f"s{p}") + F.col(f"m{p[0]}") * F.col(f"m{p[1]}")) for p in pairs}
    g = box_sums(cells, keys, sums, reach)
    mean = {a: F.col(f"__{a}") / F.col("__n") for a in "xyz"}
    cov = {p: F.col(f"__{p}") / F.col("__n") - mean[p[0]] * mean[p[1]] for p in pairs}
    vz = F.greatest(cov["zz"], F.lit(0.0))
    vertical = vz / F.greatest(cov["xx"] + cov["yy"] + vz, F.lit(1e-15))
    radial = F.greatest(cov["xx"] + cov["yy"] - (cov["xz"] ** 2 + cov["yz"] ** 2) / F.greatest(vz, F.lit(1e-15)), F.lit(0.0))
    return g.select(*keys, "bx", "by", vertical.alias("vertical"), radial.alias("radial"))


def nearest_filled(targets: DataFrame, known: DataFrame, keys: list[str], value: str, reach: int) -> DataFrame:
    """The target cells with the value of their own, or of the nearest known cell within a Euclidean reach; ties by the lesser bx, by; null beyond."""
    other = known.select(*keys, "bx", "by", F.col("bx").alias("__ox"), F.col("by").alias("__oy"), F.col(value).alias("__v"))
    near = neighbours(targets.select(*keys, "bx", "by"), other, keys, reach)
    d2 = F.col("dx") ** 2 + F.col("dy") ** 2
    best = near.where(d2 <= reach * reach).groupBy(*keys, "bx", "by").agg(F.min_by(F.struct(F.col("__v").alias("v"), d2.alias("d2")), F.struct(d2, "__ox", "__oy")).alias("__b"))
    return targets.select(*keys, "bx", "by").join(best, [*keys, "bx", "by"], "left").select(*keys, "bx", "by", F.col("__b.v").alias(value), F.col("__b.d2").alias("d2"))


def target_score(v: Column, target: float, sigma: float) -> Column:
    return F.exp(-((v - target) ** 2) / (2 * max(sigma, 1e-12) ** 2))


def curb_energy(cells: DataFrame, keys: list[str], spacing: tuple[float, float], setup: dict) -> DataFrame:
    """Energies of raised edges on ground cells (n, height, roughness, relief) and their weighted sum.

    Heights lose their local mean. step: the greatest difference to a valid neighbour; slope: the angle of the central
    differences, where all four sides are there; bend: |hxx| + |hyy| + 2 |hxy|, where all eight are. Each is scored by its
    distance to a target, height above the local minimum and relief by a smooth step. The sum counts where enough
    neighbours are valid.
    """
    c, w = setup, setup["weights"]
    valid = cells.where((F.col("n") >= c["least_points"]) & F.col("height").isNotNull())
    mean = box_sums(valid, keys, {"__h": F.col("height"), "__c": F.lit(1)}, c["mean_reach"])
    flat = valid.join(mean, [*keys, "bx", "by"]).withColumn("d", F.col("height") - F.col("__h") / F.col("__c")).drop("__h", "__c")
    around = neighbours(flat.select(*keys, "bx", "by", "d"), flat.select(*keys, "bx", "by", F.col("d").alias("o")), keys, 1, centre=False)
    at = lambda i, j: F.max(F.when((F.col("dx") == i) & (F.col("dy") == j), F.col("o")))
    sides = around.groupBy(*keys, "bx", "by").agg(F.count("*").alias("k"), F.max(F.abs(F.col("o") - F.col("d"))).alias("step"), *(at(i, j).alias(f"s{i + 1}{j + 1}") for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    low = neighbours(valid.select(*keys, "bx", "by"), valid.select(*keys, "bx", "by", F.col("height").alias("o")), keys, c["low_reach"]).groupBy(*keys, "bx", "by").agg(F.min("o").alias("low"))
    g = flat.join(sides, [*keys, "bx", "by"], "left").join(low, [*keys, "bx", "by"])
    sx, sy = spacing
    east, west, north, south = F.col("s21"), F.col("s01"), F.col("s12"), F.col("s10")
    angle = F.atan(F.sqrt(((east - west) / (2 * sx)) ** 2 + ((north - south) / (2 * sy)) ** 2))
    bend = F.abs((east - 2 * F.col("d") + west) / sx**2) + F.abs((north - 2 * F.col("d") + south) / sy**2) + 2 * F.abs((F.col("s22") - F.col("s20") - F.col("s02") + F.col("s00")) / (4 * sx * sy))
    step = F.coalesce(F.col("step"), F.lit(0.0))
    supported = F.coalesce(F.col("k"), F.lit(0)) >= c["least_neighbours"]
    rise = F.when(supported, F.col("height") - F.col("low")).otherwise(0.0)
    scores = {
        "step_energy": F.when(step.between(*c["step_band"]), target_score(step, *c["step"])).otherwise(0.0),
        "slope_energy": F.when(angle.isNotNull(), target_score(angle, *c["slope"])).otherwise(0.0),
        "bend_energy": F.when(bend.isNotNull(), target_score(bend, *c["bend"])).otherwise(0.0),
        "rough_energy": target_score(F.col("roughness"), *c["roughness"]),
        "rise_energy": smooth_step(rise, *c["rise"]),
        "relief_energy": smooth_step(F.col("relief"), *c["relief"]),
    }
    total = F.when(supported, sum((w[n] * s for n, s in scores.items()), F.lit(0.0))).otherwise(0.0)
    return g.select(*keys, "bx", "by", step.alias("step"), *(s.alias(n) for n, s in scores.items()), total.alias("energy"))


def line_scores(cells: DataFrame, keys: list[str], evidence: str, spacing: tuple[float, float], reach: int, seeds: tuple[float, float]) -> DataFrame:
    """Second moments of the evidence within a square: line, the anisotropy where enough cells support it, and normal, the line's normal in degrees."""
    other = cells.select(*keys, "bx", "by", F.col(evidence).alias("__e"))
    near = neighbours(cells.select(*keys, "bx", "by"), other, keys, reach).where("__e > 0")
    x, y, e = F.col("dx") * spacing[0], F.col("dy") * spacing[1], F.col("__e")
    sums = {"m": e, "mx": e * x, "my": e * y, "xx": e * x * x, "yy": e * y * y, "xy": e * x * y}
    g = near.groupBy(*keys, "bx", "by").agg(F.count("*").alias("seeds"), *(F.sum(v).alias(n) for n, v in sums.items()))
    mx, my = F.col("mx") / F.col("m"), F.col("my") / F.col("m")
    cxx, cyy, cxy = F.greatest(F.col("xx") / F.col("m") - mx * mx, F.lit(0.0)), F.greatest(F.col("yy") / F.col("m") - my * my, F.lit(0.0)), F.col("xy") / F.col("m") - mx * my
    apart = F.sqrt((cxx - cyy) ** 2 + 4 * cxy * cxy)
    line = clamp01(F.when(cxx + cyy > 0, F.least(apart, cxx + cyy) / F.when(cxx + cyy > 0, cxx + cyy)).otherwise(0.0) * smooth_step(F.col("seeds"), *seeds))
    line = F.when(F.col("seeds") >= seeds[0], line).otherwise(0.0)
    turn = F.degrees(0.5 * F.atan2(2 * cxy, cxx - cyy))
    return g.select(*keys, "bx", "by", "seeds", line.alias("line"), F.when(line > 1e-7, F.pmod(turn + 180, F.lit(180.0)) - 90).alias("normal"))


def point_scores(cells: DataFrame, keys: list[str], evidence: str, reach: int) -> DataFrame:
    """Drops of the evidence to both sides in four directions: point, the least of them over the greatest. Beyond the key's occupied box its border counts, empty cells are 0."""
    box = cells.groupBy(*keys).agg(F.min("bx").alias("__x0"), F.max("bx").alias("__x1"), F.min("by").alias("__y0"), F.max("by").alias("__y1"))
    ways = ((0, 1, 0), (1, 0, 1), (2, 1, 1), (3, 1, -1))
    steps = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(r).alias("r"), F.lit(s * r * i).alias("i"), F.lit(s * r * j).alias("j")) for o, i, j in ways for r in range(1, reach + 1) for s in (1, -1)))
    spread = cells.select(*keys, "bx", "by", F.col(evidence).alias("__e")).join(box, keys).withColumn("__s", F.explode(steps))
    clip = lambda v, a, b: F.least(F.greatest(v, F.col(a)), F.col(b))
    spread = spread.select(*keys, "bx", "by", "__e", "__s.o", "__s.r", clip(F.col("bx") + F.col("__s.i"), "__x0", "__x1").alias("__nx"), clip(F.col("by") + F.col("__s.j"), "__y0", "__y1").alias("__ny"))
    other = cells.select(*keys, F.col("bx").alias("__nx"), F.col("by").alias("__ny"), F.col(evidence).alias("__o"))
    pairs = spread.join(other, [*keys, "__nx", "__ny"], "left").groupBy(*keys, "bx", "by", "__e", "o", "r").agg(F.sum(F.coalesce("__o", F.lit(0))).alias("__o"))
    drops = pairs.groupBy(*keys, "bx", "by", "o").agg(F.max(F.greatest(2 * F.col("__e") - F.col("__o"), F.lit(0))).alias("__d"))
    g = drops.groupBy(*keys, "bx", "by").agg(F.max("__d").alias("__a"), F.min("__d").alias("__b"))
    return g.select(*keys, "bx", "by", F.when(F.col("__a") > 0, F.col("__b") / F.col("__a")).otherwise(0.0).alias("point"))


def oriented_votes(points: DataFrame, keys: list[str], weight: Column, normal: Column, tolerance: float, thetas: int, step: float) -> DataFrame:
    """Hough votes of points in those (rho, theta) bins only whose normal lies within tolerance (degrees) of their own."""
    width = 180.0 / thetas
    first, last = F.ceil((normal - tolerance) / width).cast("int"), F.floor((normal + tolerance) / width).cast("int")
    spread = points.withColumn("__w", weight).withColumn("__t", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn("theta_bin", F.pmod("__t", F.lit(thetas)))
    angle = F.col("theta_bin") * (math.pi / thetas)
    rho = F.floor((F.col("x") * F.cos(angle) + F.col("y") * F.sin(angle)) / step + 0.5).cast("long")
    return spread.withColumn("rho_bin", rho).groupBy(*keys, "theta_bin", "rho_bin").agg(F.sum("__w").alias("votes"))


def line_extents(cells: DataFrame, lines: DataFrame, keys: list[str], line_id: str, least_cells: int, least_length: float, most_lines: int) -> DataFrame:
    """Segments of lines (rho, theta, votes) by the extent of their assigned cells (x, y, line_id) along the line; the strongest ones of each key."""
    j = cells.join(lines, [*keys, line_id])
    along = F.col("y") * F.cos("theta") - F.col("x") * F.sin("theta")
    g = j.groupBy(*keys, line_id, "rho", "theta", "votes").agg(F.min(along).alias("__a"), F.max(along).alias("__b"), F.count("*").alias("cells"))
    g = g.withColumn("length", F.col("__b") - F.col("__a")).where((F.col("cells") >= least_cells) & (F.col("length") >= least_length))
    end = lambda t: (F.col("rho") * F.cos("theta") - t * F.sin("theta"), F.col("rho") * F.sin("theta") + t * F.cos("theta"))
    (x1, y1), (x2, y2) = end(F.col("__a")), end(F.col("__b"))
    ranked = g.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), line_id)))
    return ranked.where(F.col("__r") <= most_lines).select(*keys, line_id, "cells", "length", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
