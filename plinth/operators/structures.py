"""Structures from cells and points: shaft hypotheses and their support, split shafts, footprints, boundary places, batched fits, callbacks.

Hypotheses come from hash-grid joins within one frame and are judged by aggregates; picks are arg-max aggregates with stated
ties. Parts are joined by components, which never leave a frame.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators import graph
from plinth.operators.binning import neighbours
from plinth.operators.spatial import radius_pairs


def batched_fits(df: DataFrame, keys: list[str], x: str, y: str, z: str, least_condition: float) -> DataFrame:
    """keys, n, a, b, c, accepted: least squares z = a + b x + c y of every group at once; a badly conditioned group is rejected and has no coefficients.

    The condition is the lesser over the greater eigenvalue of the centred normal matrix.
    """
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(v).alias(f"m{i}") for i, v in enumerate((x, y, z))), *(F.covar_pop(u, v).alias(n) for n, u, v in (("xx", x, x), ("xy", x, y), ("yy", y, y), ("xz", x, z), ("yz", y, z))))
    r = F.sqrt(((F.col("xx") - F.col("yy")) / 2) ** 2 + F.col("xy") ** 2)
    mid = (F.col("xx") + F.col("yy")) / 2
    ok = F.coalesce((mid + r > 0) & ((mid - r) / F.when(mid + r > 0, mid + r) >= least_condition), F.lit(False))
    det = F.when(ok, F.col("xx") * F.col("yy") - F.col("xy") ** 2)
    b = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det
    c = (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det
    return g.select(*keys, "n", (F.col("m2") - b * F.col("m0") - c * F.col("m1")).alias("a"), b.alias("b"), c.alias("c"), ok.alias("accepted"))


def best_hypotheses(points: DataFrame, keys: list[str], cell: str, radius: float, least: int) -> DataFrame:
    """keys, cell, x, y, support, height: of each cell the place among its own points that most points within radius support, ties by height and place; cells with too little support go.

    Support may come from beyond the cell. points: keys, cell, x, y, z.
    """
    places = points.groupBy(*keys, cell, "x", "y").agg(F.count("*").alias("__own"))
    pairs = radius_pairs(places.select(*keys, cell, "x", "y"), points.select(*keys, "x", "y", "z"), keys, radius)
    g = pairs.groupBy(*keys, cell, "x", "y").agg(F.count("*").alias("support"), (F.max("r_z") - F.min("r_z")).alias("height")).where(F.col("support") >= least)
    best = g.groupBy(*keys, cell).agg(F.max(F.struct("support", "height", (-F.col("x")).alias("__x"), (-F.col("y")).alias("__y"))).alias("__b"))
    return best.select(*keys, cell, (-F.col("__b.__x")).alias("x"), (-F.col("__b.__y")).alias("y"), "__b.support", "__b.height")


def shaft_features(points: DataFrame, axes: DataFrame, keys: list[str], axis: str, radii: list[float]) -> DataFrame:
    """Probes of each axis (x, y): points within each radius, mean distance, height and the least filled quarter of it. points: keys, x, y, z."""
    widest = max(radii)
    pairs = radius_pairs(axes.select(*keys, axis, "x", "y"), points.select(*keys, "x", "y", "z"), keys, widest)
    span = pairs.groupBy(*keys, axis).agg(F.min("r_z").alias("__a"), F.max("r_z").alias("__b"))
    j = pairs.join(span, [*keys, axis])
    quarter = F.least(F.lit(3), F.floor(4 * (F.col("r_z") - F.col("__a")) / F.greatest(F.col("__b") - F.col("__a"), F.lit(1e-9))))
    counts = [F.count(F.when(F.col("d2") <= r * r, 1)).alias(f"within{i}") for i, r in enumerate(radii)]
    quarters = [F.count(F.when(quarter == q, 1)) for q in range(4)]
    return j.groupBy(*keys, axis).agg(*counts, F.avg(F.sqrt("d2")).alias("spread"), (F.first("__b") - F.first("__a")).alias("height"), F.least(*quarters).alias("least_quarter"))


def near_axis(points: DataFrame, axes: DataFrame, keys: list[str], axis: str, point_id: str, radius: float) -> DataFrame:
    """keys, point id and the nearest axis within radius of each point that has one; ties by the lesser axis."""
    pairs = radius_pairs(points.select(*keys, point_id, "x", "y"), axes.select(*keys, axis, "x", "y"), keys, radius)
    return pairs.groupBy(*keys, point_id).agg(F.min(F.struct("d2", f"r_{axis}")).alias("__b")).select(*keys, point_id, F.col(f"__b.r_{axis}").alias(axis))


def joined_shafts(shafts: DataFrame, keys: list[str], radius: float, gap: float) -> DataFrame:
    """id, label: shafts (id, x, y, low, high) that stand over one another within radius, with at most ``gap`` between, as one: the least id."""
    s = shafts.select(*keys, "id", "x", "y", "low", "high")
    p = radius_pairs(s, s, keys, radius).where(F.col("id") < F.col("r_id"))
    apart = F.greatest(F.col("low"), F.col("r_low")) - F.least(F.col("high"), F.col("r_high"))
    edges = p.where(apart <= gap).select(F.col("id").alias("a"), F.col("r_id").alias("b"))
    return graph.components(graph.cut(s.select("id"), "shafts"), edges)


def footprints(cells: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """Of each cell the better footprint, itself or itself with one neighbour: its mean value less the mean of the other neighbours; contrasts below ``least`` go.

    keys, bx, by, dx, dy (0, 0: the cell alone), contrast. Ties: the lesser offset.
    """
    other = cells.select(*keys, "bx", "by", F.col(value).alias("__o"))
    near = neighbours(cells.select(*keys, "bx", "by", value), other, keys, 1, centre=False)
    total = near.groupBy(*keys, "bx", "by", value).agg(F.sum("__o").alias("__s"), F.count("*").alias("__n"), F.collect_list(F.struct("dx", "dy", "__o")).alias("__l"))  # eight at most
    alone = F.struct((F.col(value) - F.col("__s") / F.col("__n")).cast("double").alias("c"), F.lit(0).alias("dx"), F.lit(0).alias("dy"))
    pair = F.transform(F.filter("__l", lambda r: F.col("__n") > 1), lambda r: F.struct(((F.col(value) + r["__o"]) / 2 - (F.col("__s") - r["__o"]) / (F.col("__n") - 1)).cast("double").alias("c"), r["dx"].alias("dx"), r["dy"].alias("dy")))
    ranked = F.array_min(F.transform(F.concat(F.array(alone), pair), lambda r: F.struct((-F.round(r["c"], 9)).alias("c"), r["dx"].alias("dx"), r["dy"].alias("dy"))))
    best = total.select(*keys, "bx", "by", ranked.alias("__b"))
    return best.select(*keys, "bx", "by", "__b.dx", "__b.dy", (-F.col("__b.c")).alias("contrast")).where(F.col("contrast") >= least)


def beside_mask(cells: DataFrame, mask: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """The cells with a masked cell within reach, not being one themselves."""
    near = neighbours(cells.select(*keys, "bx", "by"), mask.select(*keys, "bx", "by").distinct(), keys, reach, centre=False).select(*keys, "bx", "by").distinct()
    return cells.join(near, [*keys, "bx", "by"], "left_semi").join(mask.select(*keys, "bx", "by").distinct(), [*keys, "bx", "by"], "left_anti")


def dominant_band(points: DataFrame, keys: list[str], half: float) -> DataFrame:
    """Adds along, across and in_band: the place of each point on its group's principal line, and whether it lies within half of it."""
    m = points.groupBy(*keys).agg(F.avg("x").alias("__x"), F.avg("y").alias("__y"), (0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.covar_pop("x", "x") - F.covar_pop("y", "y"))).alias("__t"))
    j = points.join(m, keys)
    dx, dy = F.col("x") - F.col("__x"), F.col("y") - F.col("__y")
    j = j.withColumns({"along": dx * F.cos("__t") + dy * F.sin("__t"), "across": dy * F.cos("__t") - dx * F.sin("__t")})
    return j.withColumn("in_band", F.abs("across") <= half).drop("__x", "__y", "__t")


def step_places(points: DataFrame, keys: list[str], x: str, z: str, least_share: float) -> DataFrame:
    """keys, place, step, share, accepted: where a step in z best splits a group ordered by x, and whether it explains enough of the variance to take the mean's place."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(x, z)
    run, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    n, total = F.count("*").over(whole), F.sum(z).over(whole)
    d = points.select(*keys, F.col(x).alias("__x"), F.lead(x).over(w).alias("__next"), F.count("*").over(run).alias("__k"), F.sum(z).over(run).alias("__s"), n.alias("__n"), total.alias("__t"), (F.var_pop(z).over(whole) * n).alias("__v"))
    low, high = F.col("__s") / F.col("__k"), (F.col("__t") - F.col("__s")) / (F.col("__n") - F.col("__k"))
    gain = F.col("__k") * (F.col("__n") - F.col("__k")) / F.col("__n") * (high - low) ** 2
    cuts = d.where((F.col("__k") < F.col("__n")) & (F.col("__next") > F.col("__x"))).select(*keys, F.round(gain, 9).alias("g"), ((F.col("__x") + F.col("__next")) / 2).alias("p"), (high - low).alias("h"), "__v")
    best = cuts.groupBy(*keys).agg(F.max(F.struct("g", (-F.col("p")).alias("p"), "h", "__v")).alias("b"))
    share = F.when(F.col("b.__v") > 0, F.col("b.g") / F.when(F.col("b.__v") > 0, F.col("b.__v"))).otherwise(0.0)
    return best.select(*keys, (-F.col("b.p")).alias("place"), F.col("b.h").alias("step"), share.alias("share"), (share >= least_share).alias("accepted"))


def grouped(df: DataFrame, keys: list[str], value: str, f: Callable[[pd.Series], float], name: str) -> DataFrame:
    """Any function of a group's values, as a grouped Arrow aggregate; groups are gathered, so they must be bounded. Built-in aggregates are faster where they say the same."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> float:
        return float(f(v))

    return df.groupBy(*keys).agg(run(F.col(value).cast("double")).alias(name))


def per_frame(df: DataFrame, frame: str, f: Callable[[pd.DataFrame], pd.DataFrame], columns: str) -> DataFrame:
    """A consumer that is called once for every frame with all its rows, and gives rows of the columns."""
    return df.groupBy(frame).applyInPandas(f, columns)


#: Kernels by name: the built-in form of each is the one that runs.
KERNELS: dict[str, Callable[[Column], Column]] = {
    "count": F.count, "mean": F.avg, "spread": F.stddev_pop, "median": F.median, "low": F.min, "high": F.max,
}


def dispatched(df: DataFrame, keys: list[str], value: str, names: list[str]) -> DataFrame:
    """Aggregates chosen by name; an unknown name is an error before anything runs."""
    unknown = [n for n in names if n not in KERNELS]
    if unknown:
        raise ValueError(f"unknown kernels: {', '.join(unknown)}")
    return df.groupBy(*keys).agg(*(KERNELS[n](F.col(value)).alias(n) for n in names))


def synthetic_walk(df: DataFrame, keys: list[str], order: list[str], seed: int, step: float, noise: float, quantum: float) -> DataFrame:
    """Adds bias and measured: a random walk by seeded hashes of the rows (uniform steps of variance step^2), white noise and quantisation on top of ``truth``; the same rows always give the same signal."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    uniform = lambda salt: (F.pmod(F.xxhash64(*keys, *order, F.lit(seed), F.lit(salt)), F.lit(1 << 40)) / float(1 << 40) - 0.5) * 12**0.5
    d = df.withColumns({"__u": uniform(1), "__v": uniform(2)}).withColumn("bias", step * F.sum("__u").over(w))
    raw = F.col("truth") + F.col("bias") + noise * F.col("__v")
    return d.withColumn("measured", F.floor(raw / quantum + 0.5) * quantum).drop("__u", "__v")
