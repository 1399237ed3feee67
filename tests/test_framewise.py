"""Sequential filters and frame-wise picks against brute force, known motions and exact cases."""

import hashlib
import itertools
import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plinth.operators import binning, curbs, framewise, graph, moments, navigate, poses, raster, shafts, signal, spatial


def rotation(q):
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def test_tilt_keeps_gravity_through_a_turn():
    roll, pitch, g = 0.1, -0.05, 9.80665
    up = np.array([-math.sin(pitch), math.cos(pitch) * math.sin(roll), math.cos(pitch) * math.cos(roll)])
    tilt, bias = navigate.Tilt(), np.array([0.01, -0.02, 0.005])
    for i in range(40):
        r, p, aligned, accepted = tilt.step(i * 0.1, g * up, bias, 0.0)
    assert aligned and accepted and r == pytest.approx(roll, abs=1e-9) and p == pytest.approx(pitch, abs=1e-9)
    # turning about the vertical changes nothing, and force of a wrong size isn't believed
    for i in range(40, 60):
        r, p, _, accepted = tilt.step(i * 0.1, 3 * g * up, bias + 0.2 * up, 1.0)
    assert not accepted and r == pytest.approx(roll, abs=1e-6) and p == pytest.approx(pitch, abs=1e-6)
    with pytest.raises(ValueError):
        tilt.step(5.0, g * up, bias, 0.0)
    with pytest.raises(ValueError):
        navigate.Tilt().step(0.0, g * up, bias, 5.0)


def test_gyro_rotations():
    t = np.linspace(0, 4, 81)
    rates = np.tile([0.0, 0.0, 0.5], (81, 1)) + 0.1
    q = navigate.gyro_rotations(np.array([0.33, 1.71, 3.9]), t, rates, np.full(3, 0.1))
    for one, dt in zip(q, (1.38, 2.19)):
        assert rotation(one) == pytest.approx(rotation([math.cos(dt / 4), 0, 0, math.sin(dt / 4)]), abs=1e-12)
    # products of many small steps against the matrix exponential
    rates = np.stack([np.sin(t), np.cos(2 * t), 0.3 * t], axis=1)
    whole = np.eye(3)
    for a, b in zip(rates, rates[1:]):
        w = (a + b) / 2 * 0.05
        whole = whole @ navigate.exponential(np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]]))
    assert rotation(navigate.gyro_rotations(t[[0, -1]], t, rates, np.zeros(3))[0]) == pytest.approx(whole, abs=1e-9)
    with pytest.raises(ValueError):
        navigate.gyro_rotations(np.array([-1.0, 2.0]), t, rates, np.zeros(3))


def test_lateral_observer_finds_a_steady_turn():
    state = navigate.Lateral()
    speed, steer = 15.0, 0.02
    drift, steered = navigate.Lateral(gain=(0, 0, 0, 0)).flow(speed, steer, 0.0, 0.0)
    steady = np.linalg.solve(drift, -steered)  # lateral speed and rate that stand still
    acceleration = speed * steady[1]
    for i in range(400):
        lateral, rate, valid = state.step(i * 0.01, speed, steer, acceleration, steady[1])
    assert valid and (lateral, rate) == pytest.approx(tuple(steady), rel=1e-6)
    assert not state.step(4.0, 1.0, steer, 0.0, 0.0)[2]
    one = np.array([[0.3, -2.0], [1.0, 0.1]])
    assert navigate.exponential(one) @ navigate.exponential(-one) == pytest.approx(np.eye(2))


def test_motion_observer_follows_a_circle_and_its_jacobian_is_right():
    state, w = navigate.Motion(np.array([9.0, 0.5, 0.0, 1.0, 4.0, 0.0, 1.4, 0.0])), 0.5
    for i in range(1, 4000):
        t = i * 0.01
        c, s = math.cos(w * t), math.sin(w * t)
        got = state.step(t, np.array([5.0, 0.0, 0.0, 5 * w]), np.array([10 * c, 10 * s]), weight=20.0)
    assert got[[0, 3]] == pytest.approx([10 * c, 10 * s], abs=0.2) and math.hypot(got[1], got[4]) == pytest.approx(5, abs=0.2)
    assert (got[1] * got[5] - got[4] * got[2]) / 25 == pytest.approx(w, abs=0.1)
    value, rows = state.outputs()
    for k in range(8):
        one, two = navigate.Motion(state.state.copy()), navigate.Motion(state.state.copy())
        one.state[k] += 1e-6
        two.state[k] -= 1e-6
        assert rows[:, k] == pytest.approx((one.outputs()[0] - two.outputs()[0]) / 2e-6, abs=1e-5)
    with pytest.raises(ValueError):
        state.step(0.0, None, None)


def test_pose_information():
    info, scales = np.diag([4.0, 4.0, 100.0]), np.array([1.0, 1.0, 0.1])
    f = navigate.pose_filter(info, scales, 1.0, 0.5, np.array([1.0, 0.2, 1.0]))
    assert f["values"] == pytest.approx([1, 4, 4]) and f["strengths"] == pytest.approx([0.5 * 0.5, 0.5 * 0.8 * 0.2, 0.5 * 0.8 * 0.2])
    assert navigate.pose_filter(np.diag([1.0, 0, 0]), np.ones(3), 1.0)["rank"] == 1
    gradient = np.array([1.0, -2.0, 3.0])
    slow = navigate.pose_correction(gradient, info, scales, 1.0, 2.0, 1e-6, "continuous")
    for mode in ("implicit", "explicit"):
        assert navigate.pose_correction(gradient, info, scales, 1.0, 2.0, 1e-6, mode) == pytest.approx(1e-6 * slow, rel=1e-4)
    # an implicit step of any length doesn't overshoot the minimum of a quadratic cost
    far = np.array([3.0, -1.0, 0.2])
    left = far + navigate.pose_correction(info @ far, info, scales, 1.0, 2.0, 1e6)
    assert left @ info @ left < far @ info @ far
    for bad in (np.array([[1, 2, 0], [0, 1, 0], [0, 0, 1.0]]), -np.eye(3)):
        with pytest.raises(ValueError):
            navigate.pose_filter(bad, scales, 1.0)


def test_wheels():
    w = navigate.Wheels(lag=0.0)
    true, yaw = 8.0, 0.3
    rates = (true - yaw * w.place) / w.radius
    assert w.step(0.0, rates, yaw, 0.0, 0.0) == (pytest.approx(true), 4, True)
    slipped = rates + np.array([9.0, 0, 0, 0])
    assert navigate.Wheels(lag=0.0).step(0.0, slipped, yaw, 0.0, 0.0) == (pytest.approx(true), 3, True)
    assert navigate.Wheels().step(0.0, np.array([1.0, np.nan, np.nan, 30.0]), 0.0, 0.0, 0.0) == (None, 0, False)
    assert navigate.Wheels().step(0.0, np.full(4, 0.01), 0.0, 0.0, 0.0) == (0.0, 4, True)
    w.step(0.1, None, yaw, 0.0, 1.0)
    assert w.speed == pytest.approx(true + 0.1 * (1 + 1.4 * yaw**2)) and not w.step(0.5, None, 0.0, 0.0, 0.0)[2]


def test_clock_line():
    rng = np.random.default_rng(1)
    t = np.arange(300) * 0.1
    late = np.where(rng.random(300) < 0.2, rng.random(300) * 0.05, 0)
    fit = navigate.clock_line(t + late, 1.0001 * t + 7)
    assert fit["reason"] == "" and fit["scale"] == pytest.approx(1.0001, abs=1e-7) and fit["offset"] == pytest.approx(7 + 0.0001 * 0, abs=1e-4) and fit["share"] > 0.75
    assert navigate.clock_line(t[:10], t[:10])["reason"] == "few rows"
    assert navigate.clock_line(np.sort(t)[::-1], t)["reason"] == "times don't grow"
    bent = np.where(t < 15, t, 15 + 1.5 * (t - 15))
    assert navigate.clock_line(t, bent)["reason"] == "no stable line"


def test_cover_route():
    edges = [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 5.0), (1, 3, 2.0), (3, 1, 1.0), (9, 8, 1.0)]
    walk = navigate.cover_route(edges, 0)
    steps = set(zip(walk, walk[1:]))
    assert steps == {(a, b) for a, b, _ in edges[:-1]}
    assert navigate.cover_route([], 4) == [4]


def slow_bridge(cells, slope, reach, tolerance, size, most_range):
    """Sets and loops. cells: (x, y): (height, flat, ground)."""
    ground = {c for c, (_, _, g) in cells.items() if g}
    flat, parts, seen = {c for c, (_, f, _) in cells.items() if f}, [], set()
    for c in sorted(flat):
        if c in seen:
            continue
        part, todo = set(), [c]
        while todo:
            a = todo.pop()
            if a in part:
                continue
            part.add(a)
            todo += [b for b in ((a[0] + i, a[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if b in flat and abs(cells[a][0] - cells[b][0]) <= slope]
        seen |= part
        parts.append(part)
    for p in parts:
        if p & {c for c, (_, _, g) in cells.items() if g}:
            ground |= p
    left = [p for p in parts if not p & ground]
    for _ in range(8):
        new = []
        for p in left:
            h = [cells[c][0] for c in p]
            if not (size[0] <= len(p) <= size[1] and max(h) - min(h) <= most_range) or not ground:
                continue
            d, _, near = min((((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2, a, b) for a in sorted(p) for b in sorted(ground)))
            if d**0.5 <= reach and abs(np.median(h) - cells[near][0]) <= tolerance + slope * d**0.5:
                new.append(p)
        if not new:
            break
        for p in new:
            ground |= p
        left = [p for p in left if p not in new]
    return ground


def test_bridging_against_sets(spark):
    rng, rows, expected = np.random.default_rng(3), [], {}
    for frame in range(12):
        cells = {}
        for x, y in itertools.product(range(9), range(9)):
            if rng.random() < 0.5:
                cells[x, y] = (float(rng.integers(0, 12)) / 10, bool(rng.random() < 0.7), bool(rng.random() < 0.08))
        expected[frame] = slow_bridge(cells, 0.2, 2.5, 0.3, (1, 6), 0.5)
        rows += [(frame, x, y, *v) for (x, y), v in cells.items()]
    df = spark.createDataFrame(rows, "frame long, bx long, by long, h double, flat boolean, ground boolean")
    got = framewise.bridged_ground(df, "frame", "h", 0.2, 2.5, 0.3, (1, 6), 0.5).collect()
    assert len(got) == len(rows)
    assert {(r.frame, r.bx, r.by) for r in got if r.is_ground} == {(f, *c) for f, s in expected.items() for c in s}
    assert framewise.bridged_ground(df.where("false"), "frame", "h", 0.2, 2.5, 0.3, (1, 6), 0.5).count() == 0


def test_ridge_chains():
    x = np.array([0, 1, 2, 3, 0.1, 10.0])
    y = np.array([0, 0, 0, 0, 0.2, 5.0])
    score = np.array([5, 4, 3, 2, 1, 1.0])
    chain = framewise.ridge(x, y, score, np.zeros(6), np.ones(6), 1.0, 0.5, 1.5, 0.5, 0.8)
    assert chain.tolist() == [0, 0, 0, 0, -1, 5]


def test_plane_support():
    rng = np.random.default_rng(2)
    wall = np.stack([rng.normal(0, 0.02, 200), rng.random(200) * 6, rng.random(200) * 3], axis=1)
    clutter = rng.random((40, 3)) * [3, 6, 3] + [0.3, 0, 0]
    inside, normal = framewise.plane_support(np.concatenate([wall, clutter]), np.array([0.0, 1.0]), 0.2)
    assert inside[:200].mean() > 0.95 and not inside[200:].any() and abs(normal[0]) > 0.999
    model, kept = framewise.trimmed_plane(wall[:, 1], wall[:, 2], np.where(np.arange(200) % 9 == 0, 5.0, 2 + wall[:, 1] / 10), 0.1, 5, 10)
    assert model == pytest.approx([0.1, 0, 2], abs=1e-9) and kept.sum() == 177
    assert framewise.trimmed_plane(np.zeros(3), np.zeros(3), np.zeros(3), 0.1, 5, 10)[0] is None


def test_clearance(spark):
    ground = [(1, float(x), float(y), 0.1 * x) for x in range(-10, 11) for y in range(-10, 11)]
    signs = [(1, 5, 0.0, 0.0, 2.5), (1, 5, 1.0, 0.0, 2.7), (1, 6, 500.0, 0.0, 2.0)]
    got = framewise.clearance(spark.createDataFrame(signs, "frame long, sign long, x double, y double, z double"), spark.createDataFrame(ground, "frame long, x double, y double, z double"), ["frame"], "sign", 8.0, 2.0, 0.5, 0.2, 6)
    rows = {r.sign: r for r in got.collect()}
    assert rows[5].lowest == pytest.approx(2.5, abs=0.1) and rows[5].cells > 20 and rows[6].lowest is None


def test_gated_association_is_greedy(spark):
    rng = np.random.default_rng(5)
    make = lambda n, first: [("a" if i % 2 else "b", int(first + i), *map(float, rng.random(2) * 8), 0.5, 0.1, 0.4) for i in range(n)]
    schema = "cls string, id long, mx double, my double, sxx double, sxy double, syy double"
    left, right = make(60, 0), make(60, 1000)
    got = {(r.id, r.other) for r in framewise.gated_association(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "cls", 1.0, 3.0, 0.5, 0.01).collect()}
    pairs = sorted((math.hypot(a[2] - b[2], a[3] - b[3]), a[1], b[1]) for a in left for b in right if a[0] == b[0] and math.hypot(a[2] - b[2], a[3] - b[3]) <= 1)
    used, expected = set(), set()
    for _, i, j in pairs:
        if not {i, j} & used:
            used |= {i, j}
            expected.add((i, j))
    assert got == expected


def test_gated_association_writes_no_pairs(spark, monkeypatch):
    written = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: written.append(real(df, name)) or written[-1])
    near = spark.range(600).selectExpr("'a' AS cls", "id", "id * 1e-6D AS mx", "0D AS my", "0.5D AS sxx", "0.1D AS sxy", "0.4D AS syy")
    got = framewise.gated_association(near.where("id < 300"), near.where("id >= 300"), "cls", 1.0, 3.0, 0.5, 0.01)
    assert {(r.id, r.other) for r in got.collect()} == {(k, 599 - k) for k in range(300)}
    # 90,000 pairs are within the gates
    assert written and max(df.count() for df in written) <= 600


def test_digest_of_doubles(spark):
    from plinth.functions.packed import doubles_sha256

    rows = spark.createDataFrame([(1.5, -2.0), (0.0, None)], "a double, b double").select(doubles_sha256("a", "b").alias("d")).collect()
    assert rows[0].d == hashlib.sha256(struct.pack("<2d", 1.5, -2.0)).hexdigest() and rows[1].d is None


def test_frame_components_against_joins(spark):
    rng = np.random.default_rng(7)
    cells = [(f, int(x), int(y), f * 1000 + x * 30 + y, float(rng.integers(0, 5))) for f in range(3) for x in range(20) for y in range(20) if rng.random() < 0.45]
    df = spark.createDataFrame([(f, x, y, int(i), v) for f, x, y, i, v in cells], "frame long, bx long, by long, id long, v double")
    for value, most in ((None, None), ("v", 1.0)):
        nodes = graph.cut(df, "cells")
        slow = {tuple(r) for r in graph.components(nodes.select("id"), graph.lattice_edges(nodes, ["frame"], 1, value, most)).select("id", "label").collect()}
        assert {tuple(r) for r in graph.frame_components(df, "frame", value, most).collect()} == slow
    assert graph.frame_components(df.where("false"), "frame").count() == 0


def test_errors_where_rows_have_no_match(spark):
    one = spark.createDataFrame([(1,), (2,)], "k long")
    two = spark.createDataFrame([(1, "x")], "k long, v string")
    assert [tuple(r) for r in poses.covered_join(one.where("k = 1"), two, ["k"], ["v"]).collect()] == [(1, "x")]
    with pytest.raises(Exception, match="no match for 2"):
        poses.covered_join(one, two, ["k"], ["v"]).collect()
    with pytest.raises(Exception, match="no constant for spacing"):
        one.select(binning.spacing_constant(F.lit(0.7), {0.6: 1})).collect()


def test_smooth_derivative_of_a_cubic_is_exact(spark):
    rows = [(1, i, 0.01 * i**3 - i) for i in range(70)] + [(2, i, float(i)) for i in range(10)]
    got = poses.smooth_derivative(spark.createDataFrame(rows, "k long, t long, v double"), ["k"], "t", "v").collect()
    assert all(r.slope == pytest.approx(0.03 * r.t**2 - 1, abs=1e-6) for r in got if r.k == 1) and all(r.slope is None for r in got if r.k == 2)


def test_principal_axis_of_points(spark):
    rng = np.random.default_rng(4)
    axis = np.array([0.2, 0.1, 1.0]) / np.linalg.norm([0.2, 0.1, 1.0])
    p = rng.random((200, 1)) * 4 * axis + rng.normal(0, 0.05, (200, 3))
    r = shafts.shaft_shape(spark.createDataFrame([(1, *map(float, q)) for q in p], "k long, x double, y double, z double"), ["k"], 1.0, 10, 2.0, 0.9, 15.0).collect()[0]
    values, vectors = np.linalg.eigh(np.cov(p.T, bias=True))
    assert r.share == pytest.approx(values[2] / values.sum()) and r.tilt == pytest.approx(math.degrees(math.acos(abs(vectors[2, 2]))), abs=1e-4) and r.accepted


def test_spatial_overlap_gradient(spark):
    rng = np.random.default_rng(6)

    def some(n):
        out = []
        for _ in range(n):
            a = rng.normal(size=(3, 3))
            c = a @ a.T + 0.3 * np.eye(3)
            out.append(("k", *map(float, rng.normal(size=3)), *(float(c[i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))), 0.5))
        return spark.createDataFrame(out, "cls string, mx double, my double, mz double, sxx double, sxy double, sxz double, syy double, syz double, szz double, weight double").cache()

    a, b, pose = some(5), some(4), np.array([0.3, -0.2, 0.1])
    at = lambda p: spatial.xyz_overlap(a, b, "cls", tuple(map(float, p))).collect()[0]
    whole = at(pose)
    for k, name in enumerate(("gx", "gy", "gyaw")):
        step = np.eye(3)[k] * 1e-4
        assert whole[name] == pytest.approx((at(pose + step).overlap - at(pose - step).overlap) / 2e-4, rel=1e-3, abs=1e-7)


def test_empty_cells(spark):
    none = spark.createDataFrame([], "frame long, bx long, by long, n long, v double, id long")
    assert raster.box_sums(none, ["frame"], {"s": F.col("n")}, 2).count() == 0
    assert raster.point_scores(none, ["frame"], "n", 2).count() == 0
    assert raster.nearest_filled(none, none, ["frame"], "v", 3).count() == 0
    assert signal.filled_holes(none, ["frame"], "v", 1, 3).count() == 0
    assert graph.frame_growth(none.withColumn("seed", F.lit(True)), "frame", "v", 1.0, 1.0).count() == 0


def test_long_spans_stay_few(spark):
    from plinth.operators import ranges

    rng = np.random.default_rng(9)
    spans = [(int(rng.integers(0, 2)), float(b), float(b + w)) for b, w in zip(rng.random(60) * 1000, 10 ** (rng.random(60) * 9 - 2))] + [(0, -1e9, 1e9), (1, 5.0, 5.0)]
    points = [(int(rng.integers(0, 2)), float(t)) for t in rng.random(300) * 1200] + [(1, 5.0)]
    got = ranges.interval_join(spark.createDataFrame(points, "k long, t double"), spark.createDataFrame(spans, "k long, b double, e double"), ["k"], "t", "b", "e", 1.0)
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, t, b, e) for k, t in points for j, b, e in spans if j == k and b <= t <= e)
    none = spark.createDataFrame([], "k long, b double, e double")
    assert ranges.interval_join(spark.createDataFrame(points, "k long, t double"), none, ["k"], "t", "b", "e", 1.0).count() == 0


def test_votes_of_tied_neighbours(spark):
    bank = spark.createDataFrame([(5, 1.0, 0.0, 1), (2, 0.0, 1.0, 0), (9, -1.0, 0.0, 1), (1, 3.0, 3.0, 1)], "id long, x double, y double, l int")
    one = spark.createDataFrame([(7, 0.0, 0.0)], "q long, x double, y double")
    assert [tuple(r) for r in spatial.knn_vote(one, bank, "q", "id", ["x", "y"], "l", 2).collect()] == [(7, 0.5)]
    assert [tuple(r) for r in spatial.knn_vote(one, bank, "q", "id", ["x", "y"], "l", 9).collect()] == [(7, 0.75)]
    assert [tuple(r) for r in spatial.knn_vote(one, bank.where("false"), "q", "id", ["x", "y"], "l", 2).collect()] == [(7, None)]
    with pytest.raises(ValueError):
        spatial.knn_vote(one, bank, "q", "id", ["x", "y"], "l", 2, most_bank=3)
