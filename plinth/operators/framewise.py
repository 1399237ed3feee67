"""Order-dependent work inside one frame or group: bridging of ground parts, ridges, plane tests, clearance, gated association.

Each runs in one Arrow batch of a frame (a lattice or scan of bounded size) or of a group that is split further first;
frames are dealt out over the executors and nothing crosses them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators import graph, greedy
from plinth.operators.spatial import radius_pairs


# ---- ground

def bridge(bx: np.ndarray, by: np.ndarray, height: np.ndarray, flat: np.ndarray, ground: np.ndarray, slope: float, reach: float, tolerance: float, size: tuple[int, int], most_range: float, rounds: int) -> np.ndarray:
    """Ground cells after whole flat parts join: those that hold ground, then compact ones whose median height fits the nearest ground cell within reach, round by round."""
    out = ground.copy()
    at = np.flatnonzero(flat)
    if not len(at):
        return out
    a, b = graph._touching(bx[at], by[at])
    near = np.abs(height[at][a] - height[at][b]) <= slope
    part = np.unique(graph._least_labels(len(at), a[near], b[near]), return_inverse=True)[1]
    number = part.max() + 1
    count = np.bincount(part)
    low, high = np.full(number, np.inf), np.full(number, -np.inf)
    np.minimum.at(low, part, height[at])
    np.maximum.at(high, part, height[at])
    middle = np.array([np.median(height[at][part == k]) for k in range(number)])
    joined = np.bincount(part, weights=out[at], minlength=number) > 0
    out[at[joined[part]]] = True
    fit = (count >= size[0]) & (count <= size[1]) & (high - low <= most_range)
    for _ in range(rounds):
        known = np.flatnonzero(out)
        open_ = np.flatnonzero(fit & ~joined)
        if not len(known) or not len(open_):
            break
        new = []
        for k in open_:
            mine = at[part == k]
            d2 = (bx[mine][:, None] - bx[known]) ** 2 + (by[mine][:, None] - by[known]) ** 2
            # the nearest pair; of equally near ones the first ground cell in order of bins
            order = np.lexsort((by[known], bx[known]))
            i, j = np.unravel_index(np.argmin(d2[:, order]), d2.shape)
            distance = float(np.sqrt(d2[i, order[j]]))
            if distance <= reach and abs(middle[k] - height[known[order[j]]]) <= tolerance + slope * distance:
                new.append(k)
        if not new:
            break
        joined[new] = True
        out[at[joined[part]]] = True
    return out


def bridged_ground(cells: DataFrame, frame: str, height: str, slope: float, reach: float, tolerance: float, size: tuple[int, int], most_range: float, rounds: int = 8) -> DataFrame:
    """frame, bx, by, is_ground of cells (bx, by, height, flat, ground) with the flat parts promoted and bridged."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["bx", "by"])
        found = bridge(*(g[c].to_numpy() for c in ("bx", "by", height)), g["flat"].to_numpy(bool), g["ground"].to_numpy(bool), slope, reach, tolerance, size, most_range, rounds)
        return pd.DataFrame({frame: g[frame], "bx": g["bx"], "by": g["by"], "is_ground": found})

    return cells.select(frame, "bx", "by", height, "flat", "ground").groupBy(frame).applyInPandas(run, f"{frame} long, bx long, by long, is_ground boolean")


# ---- curbs

def ridge(x: np.ndarray, y: np.ndarray, score: np.ndarray, nx: np.ndarray, ny: np.ndarray, across: float, along: float, gap: float, band: float, cosine: float) -> np.ndarray:
    """The chain of each point, -1 for those that a better one beside them stands for. By falling score each point left suppresses its like around it; chains join points along compatible tangents."""
    order = np.lexsort((y, x, -score))
    gone, nodes = np.zeros(len(x), bool), []
    for k in order:
        if gone[k]:
            continue
        nodes.append(k)
        dx, dy = x - x[k], y - y[k]
        like = (np.abs(dx * nx[k] + dy * ny[k]) < across) & (np.abs(dy * nx[k] - dx * ny[k]) < along) & (nx * nx[k] + ny * ny[k] > cosine)
        gone |= like
    n = np.array(nodes)
    dx, dy = x[n][None, :] - x[n][:, None], y[n][None, :] - y[n][:, None]
    far = np.hypot(dx, dy)
    fits = (far > 0) & (far <= gap) & (np.abs(dx * nx[n][:, None] + dy * ny[n][:, None]) < band) & (np.abs(dx * nx[n][None, :] + dy * ny[n][None, :]) < band) & (nx[n][:, None] * nx[n][None, :] + ny[n][:, None] * ny[n][None, :] > cosine)
    a, b = np.nonzero(np.triu(fits, 1))
    chain = np.full(len(x), -1)
    chain[n] = n[graph._least_labels(len(n), a, b)]
    return chain


def ridges(points: DataFrame, frame: str, across: float, along: float, gap: float, band: float, cosine: float, least: int) -> DataFrame:
    """frame, x, y, chain of the ridge points (x, y, score, nx, ny) whose chain has ``least`` points or more."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["x", "y", "score"]).reset_index(drop=True)
        chain = ridge(*(g[c].to_numpy() for c in ("x", "y", "score", "nx", "ny")), across, along, gap, band, cosine)
        number = np.bincount(chain[chain >= 0], minlength=len(g))
        keep = (chain >= 0) & (number[np.maximum(chain, 0)] >= least)
        return pd.DataFrame({frame: g[frame], "x": g["x"], "y": g["y"], "chain": chain})[keep]

    return points.select(frame, "x", "y", "score", "nx", "ny").groupBy(frame).applyInPandas(run, f"{frame} long, x double, y double, chain long")


# ---- planes and clearance

def plane_support(p: np.ndarray, tangent: np.ndarray, most: float, rounds: int = 3, least: int = 12, least_scale: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Inliers of a vertical plane along a line's tangent, refitted by the inliers' least axis and cut at three spreads of their distances; its normal."""
    normal = np.array([-tangent[1], tangent[0], 0.0])
    inside = np.abs((p - np.median(p, axis=0)) @ normal) <= most
    for _ in range(rounds):
        if inside.sum() < least:
            break
        centre = p[inside].mean(axis=0)
        normal = np.linalg.eigh(np.cov((p[inside] - centre).T, bias=True))[1][:, 0]
        off = np.abs((p - centre) @ normal)
        middle = np.median(off[inside])
        spread = max(least_scale, 1.4826 * np.median(np.abs(off[inside] - middle)))
        inside = off <= min(most, middle + 3 * spread)
    return inside, normal


def plane_tests(points: DataFrame, keys: list[str], most: float, angle: float, least: int, height: float, length: float) -> DataFrame:
    """keys, n, support, accepted of the points (x, y, z) of each line (theta): whether they make an upright plane along it, tall and long enough."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        p = g[["x", "y", "z"]].to_numpy(float)
        turn = float(g["theta"].iloc[0])
        tangent, seed = np.array([-np.sin(turn), np.cos(turn)]), np.array([np.cos(turn), np.sin(turn), 0.0])
        inside, normal = plane_support(p, tangent, most, least=least)
        s, limit = p[inside], np.radians(angle)
        ok = len(s) >= least and abs(normal[2]) <= np.sin(limit) and abs(normal @ seed) >= np.cos(limit)
        ok = bool(ok and np.ptp(s[:, 2]) >= height and np.ptp(s[:, :2] @ tangent) >= length)
        return pd.DataFrame([(*(g[k].iloc[0] for k in keys), len(p), int(inside.sum()), ok)], columns=[*keys, "n", "support", "accepted"])

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    return points.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long, support long, accepted boolean"]))


def trimmed_plane(x: np.ndarray, y: np.ndarray, z: np.ndarray, tolerance: float, rounds: int, least: int) -> tuple[np.ndarray | None, np.ndarray]:
    """Coefficients (x, y, 1) of a plane refitted over cells within tolerance of the median residual, and these cells; None without enough."""
    design, inside, model = np.stack([x, y, np.ones(len(x))], axis=1), np.ones(len(x), bool), None
    for _ in range(rounds + 1):
        if inside.sum() < least or np.linalg.matrix_rank(design[inside]) < 3:
            return None, inside
        model = np.linalg.lstsq(design[inside], z[inside], rcond=None)[0]
        rest = z - design @ model
        near = np.abs(rest - np.median(rest[inside])) <= tolerance
        if (near == inside).all():
            break
        inside = near
    return model, inside


def clearance(signs: DataFrame, ground: DataFrame, keys: list[str], sign: str, radius: float, cell: float, quantile: float, tolerance: float, least: int) -> DataFrame:
    """keys, sign, cells, inliers, lowest: the least height of each sign's points (x, y, z) above a local ground plane; null without one.

    Ground points within radius of the sign's median place are balanced by cells, each with a low quantile of its heights.
    """
    centre = signs.groupBy(*keys, sign).agg(F.median("x").alias("x"), F.median("y").alias("y"))
    near = radius_pairs(centre, ground.select(*keys, "x", "y", "z"), keys, radius)
    cells = near.groupBy(*keys, sign, F.col("x").alias("cx"), F.col("y").alias("cy"), F.floor(F.col("r_x") / cell).alias("i"), F.floor(F.col("r_y") / cell).alias("j")).agg(F.median("r_x").alias("x"), F.median("r_y").alias("y"), F.percentile("r_z", F.lit(quantile)).alias("z"))
    own = signs.select(*(F.col(c).alias(c) for c in signs.columns)).groupBy(*keys, sign).agg(F.collect_list(F.struct("x", "y", "z")).alias("p"))

    def run(key: tuple, g: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(s):
            return pd.DataFrame(columns=[*keys, sign, "cells", "inliers", "lowest"])
        model = inside = None
        if len(g):
            g = g.sort_values(["i", "j"])
            cx, cy = g["cx"].iloc[0], g["cy"].iloc[0]
            model, inside = trimmed_plane((g["x"] - cx).to_numpy(), (g["y"] - cy).to_numpy(), g["z"].to_numpy(), tolerance, 5, least)
        lowest = None
        if model is not None:
            p = np.array([(q["x"], q["y"], q["z"]) for q in s["p"].iloc[0]])
            lowest = float((p[:, 2] - np.stack([p[:, 0] - cx, p[:, 1] - cy, np.ones(len(p))], axis=1) @ model).min())
        return pd.DataFrame([(*key, len(g), int(inside.sum()) if inside is not None else 0, lowest)], columns=[*keys, sign, "cells", "inliers", "lowest"])

    kinds = {f.name: f.dataType.simpleString() for f in signs.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in (*keys, sign)), "cells long, inliers long, lowest double"])
    return cells.groupBy(*keys, sign).cogroup(own.groupBy(*keys, sign)).applyInPandas(run, schema)


# ---- association

def gated_association(left: DataFrame, right: DataFrame, cls: str, reach: float, most_mahalanobis: float, most_shape: float, floor: float) -> DataFrame:
    """One-to-one pairs (id, other, score) of components (cls, id, mx, my, sxx, sxy, syy) within distance, Mahalanobis and shape gates, the best scores first, ties by the ids.

    No pair is listed before it is picked: partners are looked for one by one, by ``greedy.associated``.
    """
    shape = ["sxx", "sxy", "syy"]
    side = lambda df: df.where(F.col(cls).isNotNull()).select(cls, "id", F.col("mx").alias("x"), F.col("my").alias("y"), *shape)

    def scored(a: pd.DataFrame, b: pd.DataFrame):
        ax, ay, axx, axy, ayy = (a[c].to_numpy() for c in ("x", "y", *shape))
        bx, by, bxx, bxy, byy = (b[c].to_numpy() for c in ("x", "y", *shape))
        own = [(xx + floor) * (yy + floor) - xy**2 for xx, xy, yy in ((axx, axy, ayy), (bxx, bxy, byy))]

        def score(i: int, j: np.ndarray) -> np.ndarray:
            dx, dy = ax[i] - bx[j], ay[i] - by[j]
            d2 = dx**2 + dy**2
            xx, xy, yy = axx[i] + bxx[j], axy[i] + bxy[j], ayy[i] + byy[j]
            with np.errstate(all="ignore"):
                m = np.sqrt((yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy) / (xx * yy - xy * xy))
                mixed = ((xx + 2 * floor) * (yy + 2 * floor) - xy * xy) / 4
                unlike = 0.5 * (np.log(mixed) - 0.5 * (np.log(own[0][i]) + np.log(own[1][j])))
            # shapes without a determinant above 0 can't be told apart
            unlike = np.where((mixed > 0) & (own[0][i] > 0) & (own[1][j] > 0), np.maximum(unlike, 0.0), 0.0)
            return np.where((d2 <= reach * reach) & (m <= most_mahalanobis) & (unlike <= most_shape), np.sqrt(d2) + 4 * unlike, np.inf)

        return score

    return greedy.associated(side(left), side(right), cls, reach, scored).select(F.col("a").alias("id"), F.col("b").alias("other"), "score")
