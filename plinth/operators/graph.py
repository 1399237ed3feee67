"""Components, closures and growth on lattices: joins to a fixpoint, each round a written table, nothing on the driver but counts."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.binning import neighbours


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and all is one process (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not hasattr(shared_dir, "own"):
            shared_dir.own = f"file://{tempfile.mkdtemp(prefix='plinth-')}"
        found = shared_dir.own
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lattice_edges(cells: DataFrame, keys: list[str], reach: int = 1, value: str | None = None, most: float | None = None) -> DataFrame:
    """a < b: ids of cells that touch (and whose values differ by at most most)."""
    other = cells.select(*keys, "bx", "by", F.col("id").alias("other"), *([F.col(value).alias("__ov")] if value else []))
    pairs = neighbours(cells, other, keys, reach, centre=False).where(F.col("id") < F.col("other"))
    if value:
        pairs = pairs.where(F.abs(F.col(value) - F.col("__ov")) <= most)
    return pairs.select(F.col("id").alias("a"), F.col("other").alias("b"))


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """id, label: the least id that an id is connected with. Labels spread by one join a round, with a jump to the label's own label."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = cut(nodes.select("id", F.col("id").alias("label")), "labels")
    for _ in range(most_rounds):
        offered = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("__m"))
        step = labels.join(offered, labels["id"] == offered["a"], "left").select("id", F.col("label").alias("__old"), F.least("label", F.coalesce("__m", "label")).alias("__l"))
        jump = step.select(F.col("id").alias("__j"), F.col("__l").alias("__jl"))
        new = cut(step.join(jump, step["__l"] == jump["__j"]).select("id", "__old", F.least("__l", "__jl").alias("label")), "labels")
        changed = new.where("label <> __old").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels
    raise RuntimeError("labels haven't settled")


def _touching(bx: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the cells that touch, each once."""
    width = int(by.max() - by.min()) + 3
    code = (bx - bx.min()) * width + (by - by.min()) + 1
    order = np.argsort(code, kind="stable")
    found = code[order]
    one, other = [], []
    for step in (1, width - 1, width, width + 1):
        at = np.minimum(np.searchsorted(found, code + step), len(found) - 1)
        hit = np.flatnonzero(found[at] == code + step)
        one.append(hit)
        other.append(order[at[hit]])
    return np.concatenate(one), np.concatenate(other)


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n nodes the least node that it is connected with."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all() and (label[a] == label[b]).all():
            return label


def frame_components(cells: DataFrame, frame: str, value: str | None = None, most: float | None = None) -> DataFrame:
    """id, label of all cells (frame, bx, by, id): the least id of the touching cells that a cell hangs together with; with ``value``, over steps of ``most`` at most.

    A component never leaves its frame, and a frame is a lattice of bounded size, so each is labelled in one task, with one
    exchange for all. Edges that cross keys, or graphs without bound, take ``components``.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("id")
        ids = g["id"].to_numpy()
        a, b = _touching(g["bx"].to_numpy(), g["by"].to_numpy())
        if value:
            v = g[value].to_numpy()
            near = np.abs(v[a] - v[b]) <= most
            a, b = a[near], b[near]
        return pd.DataFrame({"id": ids, "label": ids[_least_labels(len(ids), a, b)]})

    return cells.select(frame, "bx", "by", "id", *([value] if value else [])).groupBy(frame).applyInPandas(run, "id long, label long")


def frame_growth(cells: DataFrame, frame: str, value: str, local: float, total: float) -> DataFrame:
    """Cells of each frame reached from its seeds (seed: boolean) over touching cells whose values differ by ``local`` at most, and by ``total`` from the seeds' median."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        v, seed = group[value].to_numpy(), group["seed"].to_numpy(bool)
        empty = group[[frame, "bx", "by"]].iloc[:0]
        if not seed.any():
            return empty
        allowed = np.abs(v - np.median(v[seed])) <= total
        a, b = _touching(group["bx"].to_numpy(), group["by"].to_numpy())
        near = allowed[a] & allowed[b] & (np.abs(v[a] - v[b]) <= local)
        label = _least_labels(len(v), a[near], b[near])
        return group.loc[np.isin(label, label[seed & allowed]) & allowed, [frame, "bx", "by"]]

    return cells.select(frame, "bx", "by", value, "seed").groupBy(frame).applyInPandas(run, f"{frame} long, bx long, by long")
