"""Neighbour joins, kernels and field indexes on a hash grid: equi-joins on cells, then the exact test."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cells(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumns({"__cx": F.floor(F.col(x) / size).cast("long"), "__cy": F.floor(F.col(y) / size).cast("long")})


def radius_pairs(left: DataFrame, right: DataFrame, keys: list[str], radius: float, x: str = "x", y: str = "y", prefix: str = "r_") -> DataFrame:
    """Pairs of equal keys within radius, with d2, the squared distance."""
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    probes = _cells(left, x, y, radius).withColumn("__d", F.explode(around))
    probes = probes.withColumns({"__cx": F.col("__cx") + F.col("__d.i"), "__cy": F.col("__cy") + F.col("__d.j")}).drop("__d")
    other = _cells(right, x, y, radius).select(*keys, *(F.col(c).alias(prefix + c) for c in right.columns if c not in keys), "__cx", "__cy")
    d2 = (F.col(x) - F.col(prefix + x)) ** 2 + (F.col(y) - F.col(prefix + y)) ** 2
    return probes.join(other, [*keys, "__cx", "__cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop("__cx", "__cy")


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """The nearest right row of each left one within radius (ties: the lesser id); left rows without one have nulls."""
    best = radius_pairs(left.select(*keys, left_id, x, y), right.select(*keys, right_id, x, y), keys, radius, x, y).groupBy(*keys, left_id).agg(F.min(F.struct(F.col("d2"), F.col(f"r_{right_id}").alias("i"))).alias("__b"))
    return left.select(*keys, left_id).join(best, [*keys, left_id], "left").select(*keys, left_id, F.col("__b.i").alias("nearest_id"), F.col("__b.d2").alias("d2"))


def knn_vote(queries: DataFrame, bank: DataFrame, query_id: str, bank_id: str, features: list[str], label: str, k: int, most_bank: int = 100_000) -> DataFrame:
    """Share of label 1 among the k nearest of a bounded training bank; distances are Euclidean, ties go to the lesser id.

    The bank is a model: its size is checked, then it goes to the executors once; queries meet it in blocks of 64, of which
    only k rows each are ordered.
    """
    rows = bank.select(bank_id, label, *features).limit(most_bank + 1).collect()
    if len(rows) > most_bank:
        raise ValueError(f"the training bank has more than {most_bank} rows; sample it or use an index")
    rows.sort(key=lambda r: r[bank_id])
    held = queries.sparkSession.sparkContext.broadcast((np.array([float(r[label]) for r in rows]), np.array([[float(r[f]) for f in features] for r in rows]).reshape(len(rows), len(features))))
    kind = dict(queries.dtypes)[query_id]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, places = held.value
        for batch in batches:
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))], axis=1)
            scores = np.full(len(x), np.nan)
            for first in range(0, len(x), 64) if len(labels) else ():
                d = np.zeros((len(x[first : first + 64]), len(labels)))
                for i in range(len(features)):
                    d += (x[first : first + 64, i, None] - places[None, :, i]) ** 2
                edge = np.partition(d, min(k, len(labels)) - 1, axis=1)[:, min(k, len(labels)) - 1]
                for row in range(len(d)):
                    near = np.flatnonzero(d[row] <= edge[row])  # in order of ids
                    scores[first + row] = labels[near[np.argsort(d[row][near], kind="stable")][:k]].mean()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, mask=np.isnan(scores))], names=[query_id, "score"])

    return queries.select(query_id, *(F.col(f).cast("double") for f in features)).mapInArrow(vote, f"`{query_id}` {kind}, score double")


#: A Gaussian is below the last bit of a double, relative to its peak, at so many standard deviations.
VANISHES = 8.8


def full_reach(fixed: DataFrame, moving: DataFrame) -> float:
    """The distance beyond which no pair of components adds a bit to a sum: one aggregate row, of the widest components."""
    wide = lambda df: df.agg(F.max(F.col("sxx") + F.col("syy")).alias("w")).first()["w"] or 0.0
    return VANISHES * math.sqrt(wide(fixed) + wide(moving)) or 1.0


def kernel_overlap(fixed: DataFrame, moving: DataFrame, cls: str, reach: float | None = None) -> DataFrame:
    """Class-wise sum of w_i w_j N(m_i - m_j; 0, S_i + S_j) over all pairs (components mx, my, sxx, sxy, syy, weight).

    Pairs that are so far apart that their density is nil in double precision are left out by a hash grid of that reach.
    """
    reach = reach or full_reach(fixed, moving)
    a = fixed.select(cls, F.col("mx").alias("x"), F.col("my").alias("y"), "sxx", "sxy", "syy", "weight")
    b = moving.select(cls, F.col("mx").alias("x"), F.col("my").alias("y"), "sxx", "sxy", "syy", "weight")
    p = radius_pairs(a, b, [cls], reach)
    xx, xy, yy = F.col("sxx") + F.col("r_sxx"), F.col("sxy") + F.col("r_sxy"), F.col("syy") + F.col("r_syy")
    det, dx, dy = xx * yy - xy * xy, F.col("x") - F.col("r_x"), F.col("y") - F.col("r_y")
    m = (yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy) / det
    return p.groupBy(cls).agg(F.sum(F.col("weight") * F.col("r_weight") * F.exp(-0.5 * m) / (2 * math.pi * F.sqrt(det))).alias("overlap"))


def xy_marginal(components: DataFrame) -> DataFrame:
    """XYZ components without their height: means and covariances of x and y, all else unchanged."""
    return components.drop("mz", "sxz", "syz", "szz")


def xyz_overlap(fixed: DataFrame, moving: DataFrame, cls: str, pose: tuple[float, float, float]) -> DataFrame:
    """Class-wise overlap of XYZ mixtures, the moving one at a planar pose, and its gradient by the pose (overlap, gx, gy, gyaw).

    Components are (cls, mx, my, mz, sxx, sxy, sxz, syy, syz, szz, weight). The moving ones and their derivatives by the yaw
    are columns before the join; pairs of no density in double precision are left out by the grid of ``full_reach``.
    """
    c, s = math.cos(pose[2]), math.sin(pose[2])
    mx, my, xx, xy, xz, yy, yz = (F.col(n) for n in ("mx", "my", "sxx", "sxy", "sxz", "syy", "syz"))
    turned = moving.select(
        cls, "weight", "mz", "szz",
        (c * mx - s * my + pose[0]).alias("x"), (s * mx + c * my + pose[1]).alias("y"), (-s * mx - c * my).alias("ux"), (c * mx - s * my).alias("uy"),
        (c * c * xx - 2 * c * s * xy + s * s * yy).alias("sxx"), (c * s * (xx - yy) + (c * c - s * s) * xy).alias("sxy"), (c * xz - s * yz).alias("sxz"), (s * s * xx + 2 * c * s * xy + c * c * yy).alias("syy"), (s * xz + c * yz).alias("syz"),
    )
    still = fixed.select(cls, "weight", "mz", "szz", F.col("mx").alias("x"), F.col("my").alias("y"), "sxx", "sxy", "sxz", "syy", "syz")
    p = radius_pairs(still, turned, [cls], full_reach(fixed, moving))
    add = lambda n: F.col(n) + F.col(f"r_{n}")
    less = lambda n: F.col(n) - F.col(f"r_{n}")
    p = p.select(
        cls, (F.col("weight") * F.col("r_weight")).alias("w"), *(add(f"s{n}").alias(n) for n in ("xx", "xy", "xz", "yy", "yz", "zz")), less("x").alias("dx"), less("y").alias("dy"), less("mz").alias("dz"),
        F.col("r_ux").alias("ux"), F.col("r_uy").alias("uy"), (-2 * F.col("r_sxy")).alias("txx"), (F.col("r_sxx") - F.col("r_syy")).alias("txy"), (-F.col("r_syz")).alias("txz"), (2 * F.col("r_sxy")).alias("tyy"), F.col("r_sxz").alias("tyz"),
    )
    # cofactors, the solved difference and the density
    p = p.selectExpr("*", "yy*zz - yz*yz AS axx", "xz*yz - xy*zz AS axy", "xy*yz - xz*yy AS axz", "xx*zz - xz*xz AS ayy", "xy*xz - xx*yz AS ayz", "xx*yy - xy*xy AS azz")
    p = p.selectExpr("*", "xx*axx + xy*axy + xz*axz AS det").selectExpr("*", "(axx*dx + axy*dy + axz*dz)/det AS qx", "(axy*dx + ayy*dy + ayz*dz)/det AS qy", "(axz*dx + ayz*dy + azz*dz)/det AS qz")
    p = p.selectExpr("*", "w * exp(-0.5 * (dx*qx + dy*qy + dz*qz)) / (pow(2*pi(), 1.5) * sqrt(det)) AS k")
    turn = "k * (qx*ux + qy*uy + 0.5*(qx*qx*txx + 2*qx*qy*txy + 2*qx*qz*txz + qy*qy*tyy + 2*qy*qz*tyz - (axx*txx + 2*axy*txy + 2*axz*txz + ayy*tyy + 2*ayz*tyz)/det))"
    return p.groupBy(cls).agg(F.sum("k").alias("overlap"), F.expr("sum(k*qx)").alias("gx"), F.expr("sum(k*qy)").alias("gy"), F.expr(f"sum({turn})").alias("gyaw"))


def field_index(components: DataFrame, cell: float, sigmas: float, most_cells: int = 10_000) -> DataFrame:
    """cell_x, cell_y (null: the global list) of each component whose ellipse box touches them."""
    rx, ry = sigmas * F.sqrt("sxx"), sigmas * F.sqrt("syy")
    lo_x, hi_x = F.floor((F.col("mx") - rx) / cell).cast("long"), F.floor((F.col("mx") + rx) / cell).cast("long")
    lo_y, hi_y = F.floor((F.col("my") - ry) / cell).cast("long"), F.floor((F.col("my") + ry) / cell).cast("long")
    big = (hi_x - lo_x + 1) * (hi_y - lo_y + 1) > most_cells
    none = F.array(F.lit(None).cast("long"))
    spread = components.withColumn("cell_x", F.explode(F.when(big, none).otherwise(F.sequence(lo_x, F.when(big, lo_x).otherwise(hi_x)))))
    return spread.withColumn("cell_y", F.explode(F.when(F.col("cell_x").isNull(), none).otherwise(F.sequence(lo_y, F.when(big, lo_y).otherwise(hi_y)))))


def field_query(points: DataFrame, index: DataFrame, point_id: str, cls: str, cell: float, sigmas: float) -> DataFrame:
    """Sum of weighted Gaussian densities at each point over the components whose ellipse holds it; 0 where none does."""
    p = points.withColumns({"cell_x": F.floor(F.col("x") / cell).cast("long"), "cell_y": F.floor(F.col("y") / cell).cast("long")})
    local = p.join(index.where("cell_x is not null"), [cls, "cell_x", "cell_y"])
    whole = p.drop("cell_x", "cell_y").join(index.where("cell_x is null").drop("cell_x", "cell_y"), [cls])
    keep = [point_id, "x", "y", "mx", "my", "sxx", "sxy", "syy", "weight"]
    both = local.select(*keep).unionByName(whole.select(*keep))
    det, dx, dy = F.col("sxx") * F.col("syy") - F.col("sxy") ** 2, F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    m = (F.col("syy") * dx * dx - 2 * F.col("sxy") * dx * dy + F.col("sxx") * dy * dy) / det
    value = F.col("weight") * F.exp(-0.5 * m) / (2 * math.pi * F.sqrt(det))
    hits = both.withColumn("__m", m).where(F.col("__m") <= sigmas * sigmas).groupBy(point_id).agg(F.sum(value).alias("intensity"), F.count("*").alias("components"))
    return points.select(point_id).join(hits, point_id, "left").select(point_id, F.coalesce("intensity", F.lit(0.0)).alias("intensity"), F.coalesce("components", F.lit(0)).alias("components"))


def covered(points: DataFrame, tiles: DataFrame, point_id: str, tile: float, keys: list[str] | None = None) -> DataFrame:
    """in_coverage: whether a point lies in one of its key's tiles (tx, ty), closed bounds: a point on an edge counts for both."""
    keys = keys or []
    near = F.array_distinct(F.array(F.floor(F.col("x") / tile).cast("long"), (F.ceil(F.col("x") / tile) - 1).cast("long")))
    near_y = F.array_distinct(F.array(F.floor(F.col("y") / tile).cast("long"), (F.ceil(F.col("y") / tile) - 1).cast("long")))
    spread = points.select(*keys, point_id, F.explode(near).alias("tx"), near_y.alias("__y")).select(*keys, point_id, "tx", F.explode("__y").alias("ty"))
    hit = spread.join(tiles.select(*keys, "tx", "ty").distinct(), [*keys, "tx", "ty"], "left_semi").select(point_id).distinct().withColumn("in_coverage", F.lit(True))
    return points.select(point_id).join(hit, point_id, "left").select(point_id, F.coalesce("in_coverage", F.lit(False)).alias("in_coverage"))


def nearest_line(points: DataFrame, lines: DataFrame, keys: list[str], point_id: str, line_id: str, most_lines: int = 10_000) -> DataFrame:
    """The line (rho, theta; score) nearest to each point, ties by the greater score, then the lesser id. Lines are a bounded list per key."""
    listed = lines.groupBy(*keys).agg(F.collect_list(F.struct(F.col("rho"), F.col("theta"), F.col("score"), F.col(line_id).alias("i"))).alias("__l"))
    listed = listed.withColumn("__l", F.when(F.size("__l") <= most_lines, F.col("__l")).otherwise(F.raise_error(F.lit(f"a key has more than {most_lines} lines"))))
    j = points.join(listed, keys)
    d = F.transform("__l", lambda r: F.struct(F.round(F.abs(F.col("x") * F.cos(r["theta"]) + F.col("y") * F.sin(r["theta"]) - r["rho"]), 9).alias("d"), (-r["score"]).alias("s"), r["i"].alias("i")))
    return j.select(*keys, point_id, F.array_min(d).alias("__b")).select(*keys, point_id, F.col("__b.i").alias(line_id), F.col("__b.d").alias("distance"))


def hough(points: DataFrame, keys: list[str], weight: Column, thetas: int, step: float) -> DataFrame:
    """Weighted votes of points in (rho, theta) bins: keys, theta_bin, rho_bin, votes."""
    spread = points.withColumn("__w", weight).withColumn("theta_bin", F.explode(F.sequence(F.lit(0), F.lit(thetas - 1))))
    angle = F.col("theta_bin") * (math.pi / thetas)
    rho = F.floor((F.col("x") * F.cos(angle) + F.col("y") * F.sin(angle)) / step + 0.5).cast("long")
    return spread.withColumn("rho_bin", rho).groupBy(*keys, "theta_bin", "rho_bin").agg(F.sum("__w").alias("votes"))


def peaks(votes: DataFrame, keys: list[str], reach: int, least: float, k: int) -> DataFrame:
    """The k highest bins of each key that no neighbour within reach exceeds (equal ones: the lesser bin stays), with their rank."""
    v = votes.select(*keys, F.col("theta_bin").alias("bx"), F.col("rho_bin").alias("by"), "votes").where(F.col("votes") >= least)
    from plinth.operators.binning import neighbours

    other = v.select(*keys, "bx", "by", F.col("votes").alias("nv"))
    beaten = neighbours(v, other, keys, reach, centre=False).where((F.col("nv") > F.col("votes")) | ((F.col("nv") == F.col("votes")) & ((F.col("dx") < 0) | ((F.col("dx") == 0) & (F.col("dy") < 0)))))
    top = v.join(beaten.select(*keys, "bx", "by").distinct(), [*keys, "bx", "by"], "left_anti")
    w = Window.partitionBy(*keys).orderBy(F.desc("votes"), "bx", "by")
    return top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, F.col("bx").alias("theta_bin"), F.col("by").alias("rho_bin"), "votes", "rank")
