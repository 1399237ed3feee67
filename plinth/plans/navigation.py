"""Queries of sequential filters and frame-wise, order-dependent work. SQL can't state these; tests hold them against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plinth.operators import framewise, navigate
from plinth.plans.catalog import points, query, stream, table
from plinth.plans.curbs import edge
from plinth.plans.geometry import comps3
from plinth.plans.space import grid, marked


def drive(spark, sf):
    """Events as rows of a drive: one row every tenth of a second, the value as the measured signal."""
    return stream(spark, sf).select("user_id", "event_id", "us", "value")


def clock(g: pd.DataFrame) -> np.ndarray:
    return np.arange(len(g)) * 0.1


@query("tilt_filter")
def tilt_filter(spark, sf):
    def run(g):
        tilt, out = navigate.Tilt(), []
        for t, v in zip(clock(g), g["value"]):
            moving = len(out) > 25
            rate = np.array([0.02 * np.sin(v), 0.01 * np.cos(v), 0.1]) if moving else np.array([0.001, -0.002, 0.0005])
            force = 9.80665 * np.array([np.sin(0.05), 0.03, np.cos(0.05)]) + (np.array([v / 200, 0, 0]) if moving else 0)
            out.append(tilt.step(t, force, rate, v / 20 if moving else 0.0))
        return dict(zip(("roll", "pitch", "aligned", "accepted"), map(list, zip(*out))))

    return navigate.by_key(drive(spark, sf), ["user_id"], ["us", "event_id"], run, ["event_id"], "roll double, pitch double, aligned boolean, accepted boolean")


@query("gyro_orientations")
def gyro_orientations(spark, sf):
    def run(g):
        t, v = clock(g), g["value"].to_numpy()
        rates = np.stack([np.sin(v) / 5, np.cos(v) / 7, v / 500], axis=1)
        q = np.concatenate([[[1.0, 0, 0, 0]], navigate.gyro_rotations(t, t, rates, np.array([0.01, 0.0, -0.01]))]) if len(g) > 1 else np.array([[1.0, 0, 0, 0]])
        return dict(zip(("qw", "qx", "qy", "qz"), q.T))

    return navigate.by_key(drive(spark, sf), ["user_id"], ["us", "event_id"], run, ["event_id"], "qw double, qx double, qy double, qz double")


@query("lateral_observer")
def lateral_observer(spark, sf):
    def run(g):
        state = navigate.Lateral()
        out = [state.step(t, v / 10, 0.02 * np.sin(t), 0.3 * np.sin(t), 0.05 * np.sin(t)) for t, v in zip(clock(g), g["value"])]
        return dict(zip(("lateral", "rate", "valid"), map(list, zip(*out))))

    return navigate.by_key(drive(spark, sf), ["user_id"], ["us", "event_id"], run, ["event_id"], "lateral double, rate double, valid boolean")


@query("motion_observer")
def motion_observer(spark, sf):
    """Position fixes every tenth row, motion rows otherwise."""

    def run(g):
        state, out = navigate.Motion(np.array([0.0, 5, 0, 0, 0, 0, 0, 0])), []
        for i, (t, v) in enumerate(zip(clock(g), g["value"])):
            fix = np.array([5 * t, v / 100]) if i % 10 == 0 else None
            out.append(state.step(t, np.array([5.0, 0.01, v / 500, 0.02]), fix))
        return {n: [float(s[i]) for s in out] for i, n in enumerate(("x", "vx", "ax", "y", "vy", "ay", "heading", "rate"))}

    return navigate.by_key(drive(spark, sf), ["user_id"], ["us", "event_id"], run, ["event_id"], "x double, vx double, ax double, y double, vy double, ay double, heading double, rate double")


@query("lidar_correction")
def lidar_correction(spark, sf):
    """Of each component's own information as a pose information: rank, effective dimension, and the increment of an implicit correction."""
    c = comps3(spark, sf).select("cls", "frame", "mx", "my", "sxx", "sxy", "syy")

    def run(g):
        out = []
        for r in g.itertuples(index=False):
            info = np.zeros((3, 3))
            info[:2, :2] = np.linalg.inv([[r.sxx, r.sxy], [r.sxy, r.syy]])
            info[2, 2] = (r.mx / 30) ** 2
            f = navigate.pose_filter(info, np.array([1.0, 1.0, 0.05]), 0.5)
            step = navigate.pose_correction(np.array([r.mx - 25, r.my - 50, 0.1]), info, np.array([1.0, 1.0, 0.05]), 0.5, 2.0, 0.1)
            out.append((f["rank"], f["dimension"], *map(float, step)))
        return dict(zip(("rank", "dimension", "dx", "dy", "dyaw"), map(list, zip(*out))))

    return navigate.by_key(c, ["cls"], ["frame"], run, ["frame"], "rank int, dimension double, dx double, dy double, dyaw double")


@query("wheel_speed")
def wheel_speed(spark, sf):
    def run(g):
        state, out = navigate.Wheels(), []
        for i, (t, v) in enumerate(zip(clock(g), g["value"])):
            rates = np.array([v / 10, v / 10 + 0.1, v / 10 - 0.1, np.nan if i % 7 == 0 else v / 10 + (3.0 if i % 5 == 0 else 0.0)]) if i % 2 == 0 else None
            out.append(state.step(t, rates, 0.02, 0.03, 0.1))
        return dict(zip(("speed", "used", "valid"), map(list, zip(*out))))

    return navigate.by_key(drive(spark, sf), ["user_id"], ["us", "event_id"], run, ["event_id"], "speed double, used int, valid boolean")


@query("clock_segments")
def clock_segments(spark, sf):
    """Each user's stamps as one segment, every seventeenth late."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["us", "event_id"])
        t = np.arange(len(g)) * 0.1
        late = np.where(g["event_id"].to_numpy() % 17 == 0, g["value"].to_numpy() / 2e4, 0.0)
        return pd.DataFrame([{"user_id": g["user_id"].iloc[0], **navigate.clock_line(t + late, t * 1.00002 + 3.5)}])

    return drive(spark, sf).groupBy("user_id").applyInPandas(fit, "user_id long, scale double, offset double, rows long, share double, p95 double, reason string")


@query("route_cover")
def route_cover(spark, sf):
    """A walk along the roads of a graph: nations beside each other, as a bounded plan on the driver."""
    roads = [(int(r.n_nationkey), int((r.n_nationkey * 7 + s) % 25), 1.0 + (r.n_nationkey + s) % 5) for r in table(spark, sf, "nation").orderBy("n_nationkey").collect() for s in (3, 4)]
    walk = navigate.cover_route([e for e in roads if e[0] != e[1]], 0)
    return spark.createDataFrame(list(enumerate(walk)), "step long, place long")


@query("ground_bridging")
def ground_bridging(spark, sf):
    m = marked(spark, sf)
    cells = m.select("frame", "bx", "by", (F.col("v") / 10).alias("h"), (F.col("n") <= 2).alias("flat"), (F.col("n") >= 3).alias("ground"))
    return framewise.bridged_ground(cells, "frame", "h", 0.25, 3.0, 0.3, (1, 12), 1.0)


@query("curb_ridges")
def curb_ridges(spark, sf):
    b, _ = edge(spark, sf)
    p = b.select("frame", "x", "y", F.col("strength").alias("score"), F.col("gx").alias("nx"), F.col("gy").alias("ny"))
    return framewise.ridges(p, "frame", 1.5, 1.0, 8.0, 2.0, 0.8, 3)


@query("facade_planes")
def facade_planes(spark, sf):
    """The points of five upright strips of each frame as candidate planes."""
    p = points(spark, sf).select("frame", F.floor(F.col("x") / 10).alias("strip"), (F.col("x") / 100).alias("x"), "y", (F.col("z") * 50).alias("z"), F.lit(0.0).alias("theta"))
    return framewise.plane_tests(p, ["frame", "strip"], 0.2, 20.0, 12, 1.0, 1.0)


@query("sign_clearance")
def sign_clearance(spark, sf):
    p = points(spark, sf)
    signs = p.where("inten >= 0.08 AND cls = 'R'").select("frame", F.floor(F.col("x") / 10).alias("sign"), "x", "y", (F.col("z") * 20 + 3).alias("z"))
    ground = p.where("cls = 'N'").select("frame", "x", "y", F.col("z").alias("z"))
    return framewise.clearance(signs, ground, ["frame"], "sign", 15.0, 5.0, 0.2, 0.05, 6)


@query("gated_association")
def gated_association(spark, sf):
    c = comps3(spark, sf).select("cls", F.col("frame").alias("id"), "mx", "my", "sxx", "sxy", "syy")
    k = F.when(F.col("cls") == "A", 0).when(F.col("cls") == "N", 1).otherwise(2)
    c = c.withColumn("id", F.col("id") * 3 + k)
    return framewise.gated_association(c.where("id % 2 = 0"), c.where("id % 2 = 1"), "cls", 1.5, 3.0, 0.5, 0.01)


@query("doubles_digest")
def doubles_digest(spark, sf):
    """SHA-256 of each component's numbers as packed little-endian doubles."""
    from plinth.functions.packed import doubles_sha256

    c = comps3(spark, sf)
    return c.select("cls", "frame", doubles_sha256("mx", "my", "sxx").alias("digest"), "mx", "my", "sxx")


@query("farthest_seeds")
def farthest_seeds(spark, sf):
    """Three spread-out seeds of each frame's cells."""
    from plinth.operators.mixture import starts

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["bx", "by"])
        p = g[["bx", "by"]].to_numpy(float)
        s = starts(p, min(3, len(g)))
        return pd.DataFrame({"frame": g["frame"].iloc[0], "seed": np.arange(len(s)), "x": np.asarray(s)[:, 0], "y": np.asarray(s)[:, 1]})

    return grid(spark, sf).select("frame", "bx", "by").groupBy("frame").applyInPandas(run, "frame long, seed long, x double, y double")
