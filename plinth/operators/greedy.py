"""Order-dependent picks, one group at a time in Arrow batches: canonical components, one-to-one association, propagation.

Each group is a class of components or a frame's cells: bounded by the sensor, not by the corpus. Association has the regions
of a class as groups, between which nothing is within reach; a region takes memory by its components, not by its pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators import graph

#: Best partners that a component keeps at a time; it looks again when all of them are gone.
KEPT = 8
#: Cells and horizons allow for the rounding of distances.
SLACK = 1e-9


def canonicalise(components: DataFrame, cls: str, radius: float) -> DataFrame:
    """By descending weight, each component left takes all that are left within radius: merged mass, mean and members."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["weight", "mx", "my"], ascending=[False, True, True]).reset_index(drop=True)
        xy, w = g[["mx", "my"]].to_numpy(), g["weight"].to_numpy()
        free, out = np.ones(len(g), bool), []
        for i in range(len(g)):
            if not free[i]:
                continue
            near = free & (((xy - xy[i]) ** 2).sum(axis=1) <= radius * radius)
            free &= ~near
            mass = w[near].sum()
            centre = (w[near, None] * xy[near]).sum(axis=0) / mass if mass > 0 else xy[near].mean(axis=0)
            out.append((g[cls].iloc[0], len(out), int(near.sum()), float(mass), float(centre[0]), float(centre[1])))
        return pd.DataFrame(out, columns=[cls, "canonical", "members", "mass", "mx", "my"])

    return components.groupBy(cls).applyInPandas(run, f"{cls} string, canonical long, members long, mass double, mx double, my double")


class Untaken:
    """Places on a grid that is dealt anew whenever half of them are taken; ``score(i, places)`` is a distance or more, infinite where gates refuse the pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, reach: float, score: Callable[[int, np.ndarray], np.ndarray]):
        self.x, self.y, self.ids, self.reach, self.score = x, y, ids, reach, score
        self.taken, self.number = np.zeros(len(x), bool), len(x)
        self._deal()

    def _deal(self) -> None:
        at = np.flatnonzero(~self.taken)
        x, y = self.x[at], self.y[at]
        self.dealt, self.x0, self.y0 = len(at), x.min(), y.min()
        # about four places a cell in the middle half, not much more cells than places in all
        middle = [np.subtract(*np.percentile(v, (75, 25))) for v in (x, y)]
        span = max(np.ptp(x), np.ptp(y))
        self.size = min(self.reach * (1 + SLACK), max(4 * np.sqrt(middle[0] * middle[1] / len(at)), span / (4 * np.sqrt(len(at))))) or self.reach
        cx, cy = (np.floor((v - v0) / self.size).astype(np.int64) for v, v0 in ((x, self.x0), (y, self.y0)))
        self.nx, self.ny = int(cx.max()) + 1, int(cy.max()) + 1
        code = cx * self.ny + cy
        order = np.argsort(code, kind="stable")
        self.code, self.at = code[order], at[order]

    def take(self, j: int) -> None:
        self.taken[j] = True
        self.number -= 1
        if 0 < self.number <= self.dealt // 2:
            self._deal()

    def best(self, x: float, y: float, i: int) -> tuple[list[float], list[int], bool]:
        """Scores and places of the best partners of (x, y) that aren't taken, KEPT at most, by score and id; whether these are all."""
        ux, uy = (x - self.x0) / self.size, (y - self.y0) / self.size
        cx, cy = int(np.floor(ux)), int(np.floor(uy))
        edge = min(ux - cx, cx + 1 - ux, uy - cy, cy + 1 - uy)
        rings = 1
        while True:
            # what isn't within the rings scores the horizon or more
            horizon = (rings + edge) * self.size * (1 - SLACK)
            whole = horizon > self.reach
            rows = np.arange(max(cx - rings, 0), min(cx + rings, self.nx - 1) + 1) * self.ny
            low, high = max(cy - rings, 0), min(cy + rings, self.ny - 1)
            first, last = np.searchsorted(self.code, rows + low), np.searchsorted(self.code, rows + high, side="right")
            near = np.concatenate([self.at[:0], *(self.at[f:t] for f, t in zip(first, last))]) if low <= high else self.at[:0]
            near = near[~self.taken[near]]
            scores = self.score(i, near)
            use = scores < (np.inf if whole else horizon)
            if whole or use.any():
                near, scores = near[use], scores[use]
                order = np.lexsort((self.ids[near], scores))[:KEPT]
                return scores[order].tolist(), near[order].tolist(), whole and len(near) <= KEPT
            rings *= 2


def one_to_one(x: np.ndarray, y: np.ndarray, ids: np.ndarray, others: Untaken) -> list[tuple[int, int, float]]:
    """Index, place and score of the pairs that are picked by (score, id, other's id), each side once.

    A heap holds the best partner of each, as it was when last looked for; a pair whose place is taken by then gives way to the
    next one. So no list of all pairs is made: memory goes by the numbers of both sides.
    """
    heap, lists, out = [], [None] * len(x), []

    def offer(i: int) -> None:
        while others.number:
            if lists[i] is None:
                lists[i] = [*others.best(x[i], y[i], i), 0]
            scores, places, whole, at = lists[i]
            while at < len(places) and others.taken[places[at]]:
                at += 1
            if at < len(places):
                lists[i][3] = at
                heapq.heappush(heap, (scores[at], int(ids[i]), int(others.ids[places[at]]), i, places[at]))
                return
            lists[i] = None
            if whole:
                return

    for i in range(len(x)):
        offer(i)
    while heap and others.number:
        score, _, _, i, j = heapq.heappop(heap)
        if others.taken[j]:
            offer(i)
        else:
            others.take(j)
            lists[i] = None
            out.append((i, j, score))
    return out


def associated(left: DataFrame, right: DataFrame, cls: str, reach: float, scored: Callable[[pd.DataFrame, pd.DataFrame], Callable[[int, np.ndarray], np.ndarray]]) -> DataFrame:
    """cls, a, b, score of the one-to-one pairs of a class (id, x, y and further numbers), the best scores first, ties by the ids.

    ``scored`` makes the score of two tables; it is never less than the distance. Regions are the connected parts of the cells
    of size ``reach`` that a class holds: pairs never cross them, so each is one group, in one task.
    """
    kind, numbers = dict(left.dtypes)[cls], [c for c in left.columns if c not in (cls, "id")]
    usable = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    both = left.withColumn("__right", F.lit(False)).unionByName(right.withColumn("__right", F.lit(True))).where(usable("x") & usable("y"))
    size = reach * (1 + SLACK)
    cell = lambda i, j: F.xxhash64(F.col(cls), F.col("__cx") + i, F.col("__cy") + j)
    both = graph.cut(both.withColumns({"__cx": F.floor(F.col("x") / size), "__cy": F.floor(F.col("y") / size)}), "sides")
    cells = both.groupBy(cls, "__cx", "__cy").agg(F.count("*").alias("n"))
    nodes = graph.cut(cells.select(cell(0, 0).alias("id"), F.array(cell(1, -1), cell(1, 0), cell(1, 1), cell(0, 1)).alias("to")), "cells")
    edges = nodes.select(F.col("id").alias("a"), F.explode("to").alias("b")).join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    regions = graph.components(nodes.select("id").distinct(), edges.select("a", "b"))
    rows = both.withColumn("__cell", cell(0, 0)).join(regions.select(F.col("id").alias("__cell"), F.col("label").alias("__region")), "__cell")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a, b = (group[group["__right"] == side].sort_values("id").reset_index(drop=True) for side in (False, True))
        out = []
        if len(a) and len(b):
            others = Untaken(b["x"].to_numpy(), b["y"].to_numpy(), b["id"].to_numpy(), reach, scored(a, b))
            picks = one_to_one(a["x"].to_numpy(), a["y"].to_numpy(), a["id"].to_numpy(), others)
            out = [(key[0], a["id"].iat[i], b["id"].iat[j], score) for i, j, score in picks]
        return pd.DataFrame(out, columns=[cls, "a", "b", "score"])

    # a region may be what it will: its rows are few numbers each
    chosen = rows.select(cls, "__region", "__right", F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in numbers))
    return chosen.groupBy(cls, "__region").applyInPandas(run, f"{cls} {kind}, a long, b long, score double")


def associate(left: DataFrame, right: DataFrame, cls: str, left_id: str, right_id: str, reach: float) -> DataFrame:
    """One-to-one pairs of a class within reach, the nearest pairs first, ties by the ids."""
    side = lambda df, own: df.select(cls, F.col(own).alias("id"), F.col("mx").alias("x"), F.col("my").alias("y"))

    def scored(a: pd.DataFrame, b: pd.DataFrame) -> Callable[[int, np.ndarray], np.ndarray]:
        ax, ay, bx, by = (g[c].to_numpy() for g in (a, b) for c in "xy")

        def score(i: int, j: np.ndarray) -> np.ndarray:
            d = np.hypot(ax[i] - bx[j], ay[i] - by[j])
            return np.where(d <= reach, d, np.inf)

        return score

    return associated(side(left, left_id), side(right, right_id), cls, reach, scored).select(cls, F.col("a").alias(left_id), F.col("b").alias(right_id), F.col("score").alias("distance"))


def propagate(cells: DataFrame, frame: str, value: str, step: float) -> DataFrame:
    """Ground cells, near to far: a cell is ground if its value is within step of the mean of its ground neighbours; the nearest cell seeds."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.assign(__d=group["bx"] ** 2 + group["by"] ** 2).sort_values(["__d", "bx", "by"])
        ground: dict[tuple[int, int], float] = {}
        flags = []
        for bx, by, v in zip(g["bx"], g["by"], g[value]):
            near = [ground[c] for c in ((bx + i, by + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if c in ground]
            ok = not ground or (bool(near) and abs(v - sum(near) / len(near)) <= step)
            if ok:
                ground[bx, by] = v
            flags.append(ok)
        return pd.DataFrame({frame: g[frame], "bx": g["bx"], "by": g["by"], "is_ground": flags})

    return cells.groupBy(frame).applyInPandas(run, f"{frame} long, bx long, by long, is_ground boolean")
