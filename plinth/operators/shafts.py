"""Upright and flat shapes in point sets: principal axes, density peaks, height runs, context around an axis, obstacle cylinders.

Pairs of points and places come from hash grids (``spatial.radius_pairs``); the measures are aggregates and windows over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators.moments import cell_moments, midpoint_quantiles
from plinth.operators.spatial import radius_pairs


def eigen_zz(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> tuple[Column, Column]:
    """Of a symmetric 3 x 3 matrix: the greatest eigenvalue over the trace, and the squared z part of its unit eigenvector.

    Eigenvalues by the trigonometric form, the eigenvector's part by the cofactor of the shifted matrix; a matrix with equal
    greatest eigenvalues has no such axis and gives null.
    """
    q = (xx + yy + zz) / 3
    a, b, c = xx - q, yy - q, zz - q
    p = F.sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    safe = F.when(p > 0, p)
    det = (a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)) / (safe * safe * safe)
    phi = F.acos(F.least(F.greatest(det / 2, F.lit(-1.0)), F.lit(1.0))) / 3
    one, three = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2.0943951023931953)
    two = 3 * q - one - three
    slope = (one - two) * (one - three)
    part = ((one - xx) * (one - yy) - xy * xy) / F.when(slope > 0, slope)
    return one / F.when(xx + yy + zz > 0, xx + yy + zz), F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))


def height_runs(points: DataFrame, keys: list[str], z: str, gap: float) -> DataFrame:
    """keys, runs, longest and widest: runs of heights without gaps beyond ``gap``, the longest run and the widest gap."""
    w = Window.partitionBy(*keys).orderBy(z)
    step = F.col(z) - F.lag(z).over(w)
    run = F.sum(F.when(step > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    spans = points.select(*keys, z, step.alias("__g"), run.alias("__r")).groupBy(*keys, "__r").agg((F.max(z) - F.min(z)).alias("__s"), F.max("__g").alias("__g"))
    return spans.groupBy(*keys).agg(F.count("*").alias("runs"), F.max("__s").alias("longest"), F.coalesce(F.max("__g"), F.lit(0.0)).alias("widest"))


def shaft_shape(points: DataFrame, keys: list[str], gap: float, least_points: int, least_height: float, least_share: float, most_tilt: float) -> DataFrame:
    """Of each group: count, longest run of heights, share of the first principal axis, its tilt from the vertical in degrees, and whether it stands like a pole."""
    m = cell_moments(points, keys).join(height_runs(points, keys, "z", gap), keys)
    share, part = eigen_zz(*(F.col(f"s{p}") for p in ("xx", "xy", "xz", "yy", "yz", "zz")))
    tilt = F.degrees(F.acos(F.sqrt(part)))
    ok = (F.col("n") >= least_points) & (F.col("longest") >= least_height) & (share >= least_share) & (tilt <= most_tilt)
    return m.select(*keys, "n", "longest", "runs", share.alias("share"), tilt.alias("tilt"), F.coalesce(ok, F.lit(False)).alias("accepted"))


def peak_evidence(points: DataFrame, peaks: DataFrame, keys: list[str], peak_id: str, core: float, context: float, least_height: float, least_points: int) -> DataFrame:
    """Shaft evidence of each peak (x, y): mass near it over mass around it, heights without a dominant gap, robust height and count."""
    pairs = radius_pairs(peaks.select(*keys, peak_id, "x", "y"), points.select(*keys, "x", "y", "z"), keys, context)
    group = [*keys, peak_id]
    near = pairs.withColumn("__core", F.col("d2") <= core * core)
    total = near.groupBy(*group).agg(F.count("*").alias("around"), F.count(F.when(F.col("__core"), 1)).alias("core"))
    inner = near.where("__core").select(*group, F.col("r_z").alias("z"))
    runs = height_runs(inner, group, "z", float("inf")).select(*group, "longest", "widest")
    q = midpoint_quantiles(inner, group, "z", [0.05, 0.95]).select(*group, (F.col("q95") - F.col("q5")).alias("height"))
    g = total.join(runs, group, "left").join(q, group, "left")
    usable = (F.col("core") >= 3) & (F.col("longest") > 0)
    concentration = F.when(usable, F.col("core") / F.col("around")).otherwise(0.0)
    continuity = F.when(usable, F.greatest(1 - F.col("widest") / F.when(usable, F.col("longest")), F.lit(0.0))).otherwise(0.0)
    height = F.when(usable, F.col("height")).otherwise(0.0)
    score = concentration * continuity * F.least(height / least_height, F.lit(1.0)) * F.least(F.col("core") / least_points, F.lit(1.0))
    return g.select(*group, F.col("core").alias("core_points"), concentration.alias("concentration"), continuity.alias("continuity"), height.alias("height"), score.alias("score"))


def axis_context(points: DataFrame, context: DataFrame, keys: list[str], group: str, core: float, reach: float, contact: float, margin: float, slice_height: float) -> DataFrame:
    """Context points in an annulus around each group's fitted axis x(z), y(z), by height slices between its ends: slices, crowded and touched ones.

    points: keys, group, x, y, z; context the same, whose rows of the group itself don't count. A slice is crowded with two
    points, touched with one within ``contact``.
    """
    fit = points.groupBy(*keys, group).agg(
        F.count("*").alias("n"), F.regr_slope("x", "z").alias("ax"), F.regr_intercept("x", "z").alias("cx"), F.regr_slope("y", "z").alias("ay"), F.regr_intercept("y", "z").alias("cy"),
        (F.min("z") + margin).alias("low"), (F.max("z") - margin).alias("high"),
    )
    fit = fit.where((F.col("high") > F.col("low")) & F.col("ax").isNotNull()).withColumn("slices", F.ceil((F.col("high") - F.col("low")) / slice_height))
    other = context.select(*keys, F.col(group).alias("__g"), F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("z").alias("__z"))
    j = fit.join(other, keys).where((F.col("__g") != F.col(group)) & F.col("__z").between(F.col("low"), F.col("high")))
    away = F.sqrt((F.col("__x") - F.col("ax") * F.col("__z") - F.col("cx")) ** 2 + (F.col("__y") - F.col("ay") * F.col("__z") - F.col("cy")) ** 2)
    j = j.withColumn("__d", away).where((F.col("__d") > core) & (F.col("__d") <= reach))
    place = F.least(F.floor((F.col("__z") - F.col("low")) / slice_height) + 1, F.col("slices"))
    sliced = j.groupBy(*keys, group, place.alias("__s")).agg(F.count("*").alias("__c"), F.count(F.when(F.col("__d") <= contact, 1)).alias("__t"))
    g = sliced.groupBy(*keys, group).agg(F.sum("__c").alias("around"), F.count(F.when(F.col("__c") >= 2, 1)).alias("crowded"), F.count(F.when(F.col("__t") >= 1, 1)).alias("touched"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return fit.select(*keys, group, "n", "slices").join(g, [*keys, group], "left").select(*keys, group, "n", "slices", zero("around"), zero("crowded"), zero("touched"))


def blocked(candidates: DataFrame, points: DataFrame, keys: list[str], radius: float, low: float, high: float, bin_height: float, least_points: int, least_bins: int) -> DataFrame:
    """Adds obstacle: whether the points within radius of a candidate (x, y, z) that stand between low and high above it are many and fill enough height bins."""
    pairs = radius_pairs(candidates.select(*keys, "__id", "x", "y", "z"), points.select(*keys, "x", "y", "z"), keys, radius)
    above = F.col("r_z") - F.col("z")
    g = pairs.where(above.between(low, high)).groupBy("__id").agg(F.count("*").alias("__c"), F.count_distinct(F.floor((above - low) / bin_height)).alias("__b"))
    hit = g.where((F.col("__c") >= least_points) & (F.col("__b") >= least_bins)).select("__id", F.lit(True).alias("obstacle"))
    return candidates.join(hit, "__id", "left").withColumn("obstacle", F.coalesce("obstacle", F.lit(False)))


def mixture_support(points: DataFrame, keys: list[str], core: Column, context: Column, half: float, least: int, share: float) -> DataFrame:
    """Heights where, within half of each, at least ``least`` core points stand and make more than ``share`` of the context's: total height, longest stretch, mean share."""
    rows = points.where(context).select(*keys, "z", core.cast("int").alias("__a"))
    ends = F.array(F.struct((F.col("z") - half).alias("t"), F.lit(1).alias("s")), F.struct((F.col("z") + half).alias("t"), F.lit(-1).alias("s")))
    at = rows.withColumn("__e", F.explode(ends)).groupBy(*keys, F.col("__e.t").alias("t")).agg(F.sum(F.col("__e.s") * F.col("__a")).alias("__c"), F.sum("__e.s").alias("__t"))
    w = Window.partitionBy(*keys).orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    seg = at.select(*keys, "t", (F.lead("t").over(w) - F.col("t")).alias("w"), F.sum("__c").over(run).alias("c"), F.sum("__t").over(run).alias("n"))
    ok = (F.col("c") >= least) & (F.col("c") / F.greatest(F.col("n"), F.lit(1)) > share) & F.col("w").isNotNull()
    seg = seg.withColumn("ok", ok).withColumn("__r", F.sum(F.when(ok, 0).otherwise(1)).over(run))
    stretches = seg.where("ok").groupBy(*keys, "__r").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("c") / F.col("n")).alias("s"))
    return stretches.groupBy(*keys).agg(F.sum("w").alias("height"), F.max("w").alias("longest"), (F.sum("s") / F.sum("w")).alias("mean_share"))
