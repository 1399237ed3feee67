"""Edge cases of the operators: empty tables, single rows, nulls and NaN, ties, and known values."""

import json
import math
import struct
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.functions import scalar
from plinth.operators import asof, binning, evaluate, graph, greedy, islands, mixture, moments, ranges, rules, schedule, signal, spatial, stateful, trees


def one(df):
    return df.collect()[0]


def test_large_offset_moments_keep_their_digits(spark):
    df = spark.createDataFrame([(1, 700000.0, 4300000.0, 100.0), (1, 700000.002, 4300000.004, 100.006), (2, 1.0, 2.0, 3.0)], "cell int, x double, y double, z double")
    rows = {r.cell: r for r in moments.cell_moments(df, ["cell"]).collect()}
    assert rows[1].sxx == pytest.approx(1e-6, rel=1e-3) and rows[1].sxy == pytest.approx(2e-6, rel=1e-3)
    assert rows[2].sxx == 0 and rows[2].n == 1
    assert moments.cell_moments(df.where("false"), ["cell"]).count() == 0


def test_finite_extremes_ignore_nan_and_null(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, None), (1, float("inf")), (2, None)], "k int, v double")
    rows = {r.k: r for r in moments.finite_extremes(df, ["k"], "v").collect()}
    assert (rows[1].n, rows[1].least, rows[1].greatest) == (1, 1.0, 1.0)
    assert rows[2].n == 0 and rows[2].median is None


def test_rules_fail_on_missing_values(spark):
    df = spark.createDataFrame([(3.0, 0.1), (1.0, 0.1), (3.0, 0.5), (3.0, float("nan")), (3.0, None)], "height double, fraction double")
    rule = {"allOf": [{"alternatives": [[{"feature": "height", "operator": ">=", "threshold": 2}]]}, {"alternatives": [[{"feature": "fraction", "operator": "<=", "threshold": 0.2}]]}]}
    assert [r.ok for r in df.select(rules.compile_rules(rule).alias("ok")).collect()] == [True, False, False, False, False]
    with pytest.raises(ValueError):
        rules.atom("height", "<", 1)
    with pytest.raises(ValueError):
        rules.validated(["a", "a"], ["a", "b"])


def test_asof_ties_and_ends(spark):
    left = spark.createDataFrame([(1, 10, 5.0), (1, 11, 15.0), (1, 12, 99.0), (2, 13, 1.0)], "k int, id int, t double")
    right = spark.createDataFrame([(1, 0.0, 1.0), (1, 10.0, 2.0), (1, 20.0, 3.0)], "k int, t double, v double")
    got = lambda tie: {r.id: (r.match.v if r.match else None, r.dt) for r in asof.nearest(left, right, ["k"], "t", ["v"], tie).collect()}
    assert got("earlier") == {10: (1.0, -5.0), 11: (2.0, -5.0), 12: (3.0, -79.0), 13: (None, None)}
    assert got("later")[10] == (2.0, 5.0)
    exact = asof.interpolated(right.select("k", F.lit(1).alias("id"), "t"), right, ["k"], "t", ["v"], 100.0).collect()
    assert all(r.ok and r.w == 0 for r in exact)
    assert asof.backward(left.where("false"), right, ["k"], "t", ["v"]).count() == 0
    assert {r.match for r in asof.backward(left, right.where("false"), ["k"], "t", ["v"]).collect()} == {None}


def test_interval_merge_and_sweep(spark):
    s = spark.createDataFrame([(1, 0.0, 5.0), (1, 1.0, 2.0), (1, 4.0, 8.0), (1, 10.0, 11.0)], "k int, b double, e double")
    assert sorted((r.b, r.e, r.n) for r in ranges.merge_intervals(s, ["k"], "b", "e").collect()) == [(0.0, 8.0, 3), (10.0, 11.0, 1)]
    assert sorted((r.begin, r.end, r.cover) for r in ranges.sweep(s, ["k"], "b", "e").collect()) == [(0.0, 1.0, 1), (1.0, 2.0, 2), (2.0, 4.0, 1), (4.0, 5.0, 2), (5.0, 8.0, 1), (10.0, 11.0, 1)]


def test_runs_and_ranges(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([True, True, False, None, None, True])], "k int, t int, v boolean")
    assert [(r.begin, r.end, r.label) for r in islands.runs(df, ["k"], ["t"], F.col("v")).orderBy("run").collect()] == [(0, 1, True), (2, 2, False), (3, 4, None), (5, 5, True)]
    n = spark.createDataFrame([(1, i) for i in (1, 2, 3, 7, 9, 10, 10)], "k int, i int")
    assert one(islands.compressed_ranges(n, ["k"], "i")).ranges == "1-3,7,9-10"


def test_neighbour_difference_raster(spark):
    values = [[math.nan, 1, 3], [0, math.inf, 2]]
    cells = spark.createDataFrame([(1, i, j, float(v)) for i, r in enumerate(values) for j, v in enumerate(r)], "frame int, bx long, by long, v double").where(binning.finite(F.col("v")))
    near = binning.neighbours(cells, cells.withColumnRenamed("v", "nv"), ["frame"], 1, False).groupBy("bx", "by").agg(F.max(F.abs(F.col("v") - F.col("nv"))).alias("d"))
    assert {(r.bx, r.by): r.d for r in near.collect()} == {(0, 1): 2.0, (0, 2): 2.0, (1, 0): 1.0, (1, 2): 1.0}


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))]
    nodes = spark.createDataFrame([(i,) for i in range(60)], "id long")
    got = {r.id: r.label for r in graph.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    root = list(range(60))

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in range(60)}


def test_schedule_forces_the_last_window(spark):
    got = schedule.schedule(spark.createDataFrame([(i,) for i in range(10)], "f int"), "f", 4, 3).collect()
    by = {}
    for r in got:
        by.setdefault(r.first_row, []).append(r.f)
    assert {k: sorted(v) for k, v in by.items()} == {0: [0, 1, 2, 3], 3: [3, 4, 5, 6], 6: [6, 7, 8, 9]}
    with pytest.raises(ValueError):
        schedule.schedule(spark.createDataFrame([(1,)], "f int"), "f", 2, 3)


def test_dead_reckoning_of_a_circle(spark):
    n, turn = 36, 2 * math.pi / 36
    df = spark.createDataFrame([(1, float(i), 1.0, turn) for i in range(n + 1)], "k int, t double, v double, r double")
    last = signal.dead_reckon(df, ["k"], "t", "v", "r").orderBy(F.desc("t")).first()
    assert abs(last.px) < 1e-9 and abs(last.py) < 1e-9 and last.yaw == pytest.approx(2 * math.pi)


def test_gradient_of_a_parabola_is_exact_inside(spark):
    t = [0.0, 1.0, 2.5, 3.0, 5.0]
    df = spark.createDataFrame([(1, x, x * x) for x in t], "k int, t double, v double")
    got = [r.gradient for r in signal.gradient(df, ["k"], "t", "v").orderBy("t").collect()]
    assert got[1:-1] == pytest.approx([2 * x for x in t[1:-1]])


def test_spd_clipping_matches_numpy(spark):
    m = np.array([[3.0, 1.2], [1.2, 0.7]])
    c = scalar.spd_clip(F.lit(3.0), F.lit(1.2), F.lit(0.7), 0.5, 2.0)
    r = one(spark.range(1).select(*(v.alias(k) for k, v in c.items())))
    e, v = np.linalg.eigh(m)
    w = v @ np.diag(np.clip(e, 0.5, 2.0)) @ v.T
    assert [r.cxx, r.cxy, r.cyy] == pytest.approx([w[0, 0], w[0, 1], w[1, 1]])
    assert [r.ixx, r.ixy, r.iyy] == pytest.approx([np.linalg.inv(w)[i] for i in ((0, 0), (0, 1), (1, 1))])


def test_slerp_keeps_the_norm_and_the_short_arc(spark):
    a, b = [F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)], [F.lit(x) for x in (-math.cos(0.5), 0.0, 0.0, -math.sin(0.5))]
    r = one(spark.range(1).select(*(c.alias(k) for k, c in zip("wxyz", scalar.slerp(a, b, F.lit(0.5))))))
    assert (r.w, r.z) == pytest.approx((math.cos(0.25), math.sin(0.25)))


def test_utm_of_a_known_place(spark):
    r = one(spark.range(1).select(*(c.alias(k) for k, c in zip("en", scalar.utm(F.radians(F.lit(0.0)), F.radians(F.lit(-93.0)), 15)))))
    assert (r.e, r.n) == pytest.approx((500000.0, 0.0), abs=1e-6)


def test_tree_paths_agree(spark):
    from plinth.plans.logic import FOREST

    df = spark.createDataFrame([(1.0, 60.0, 0.1), (30.0, 10.0, 0.0), (None, 1.0, 1.0)], "x double, y double, z double")
    got = trees.score(df, FOREST, ["x", "y", "z"]).withColumn("c", trees.score_column(FOREST, ["x", "y", "z"])).collect()
    assert got[0].score == pytest.approx(got[0].c) and got[1].score == pytest.approx(got[1].c) and got[2].score == pytest.approx(got[2].c)
    scaled = FOREST | {"scale": 10}
    near = spark.createDataFrame([(25.04, 60.0, 0.1), (25.06, 60.0, float("inf"))], "x double, y double, z double")
    rows = trees.score(near, scaled, ["x", "y", "z"]).withColumn("c", trees.score_column(scaled, ["x", "y", "z"])).collect()
    assert [r.score for r in rows] == pytest.approx([r.c for r in rows]) and rows[0].score < rows[1].score


def test_mixture_bound_never_falls():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(8, 1, (60, 2))])
    bounds = [mixture.fit(x, 2, r)[3] for r in range(1, 15)]
    assert all(b >= a - 1e-9 for a, b in zip(bounds, bounds[1:]))
    assert mixture.select(x, np.arange(120) % 3, 3) == 2


def test_greedy_order(spark):
    c = spark.createDataFrame([("a", 1, 0.0, 0.0, 1.0), ("a", 2, 0.5, 0.0, 2.0), ("a", 3, 1.4, 0.0, 1.5)], "cls string, frame long, mx double, my double, weight double")
    got = greedy.canonicalise(c, "cls", 1.0).orderBy("canonical").collect()
    assert [(r.members, r.mass) for r in got] == [(3, 4.5)]
    pairs = greedy.associate(c.where("frame < 3"), c.where("frame = 3").withColumnRenamed("frame", "other"), "cls", "frame", "other", 2.0).collect()
    assert [(r.frame, r.other) for r in pairs] == [(2, 3)]


def test_json_lists_that_share_a_partition_are_all_read(spark, tmp_path):
    from plinth.plans import catalog

    spark.range(140_000).selectExpr("id AS c_custkey", "id / 8D AS c_acctbal").repartition(8).write.parquet(f"{tmp_path}/customer.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for parts in ("1", "24"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = catalog.QUERIES["json_list_scan"](spark, str(tmp_path))
            assert tuple(got.selectExpr("count(*)", "count(DISTINCT utime)", "sum(linear)").first()) == (140_000, 140_000, sum(range(140_000)) / 8)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_association_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    # halves make ties; copies share a place; two clouds and a class without partners
    place = lambda i: (float(rng.integers(0, 12)) / 2 + 100 * (i % 2), float(rng.integers(0, 12)) / 2)
    left = [("ab"[i % 3 == 0], i, *place(i)) for i in range(150)] + [("c", 900, 0.0, 0.0), ("a", 901, float("nan"), 0.0)]
    right = [("ab"[i % 3 == 0], i, *place(i)) for i in range(200, 330)] + [("a", 400, 1.0, 1.0), ("a", 401, 1.0, 1.0)]
    pairs = sorted((np.hypot(a[2] - b[2], a[3] - b[3]), a[1], b[1]) for a in left for b in right if a[0] == b[0] and np.hypot(a[2] - b[2], a[3] - b[3]) <= 1.5)
    used, expected = set(), set()
    for d, i, j in pairs:
        if not {i, j} & used:
            used |= {i, j}
            expected.add((i, j, d))
    a, b = spark.createDataFrame(left, "cls string, frame long, mx double, my double"), spark.createDataFrame(right, "cls string, other long, mx double, my double")
    assert {(r.frame, r.other, r.distance) for r in greedy.associate(a, b, "cls", "frame", "other", 1.5).collect()} == expected
    assert greedy.associate(a.where("false"), b, "cls", "frame", "other", 1.5).count() == 0


def test_association_takes_memory_by_components_not_by_pairs():
    n = 3000
    x, y = (np.random.default_rng(k).normal(0, 1e-9, 2 * n) for k in (1, 2))
    d = lambda i, j: np.hypot(x[i] - x[n + j], y[i] - y[n + j])
    tracemalloc.start()
    found = greedy.one_to_one(x[:n], y[:n], np.arange(n), greedy.Untaken(x[n:], y[n:], np.arange(n), 2.0, d))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(i for i, *_ in found) == sorted(j for _, j, _ in found) == list(range(n))
    # a matrix of all pairs takes 72 MB
    assert peak < 12e6


def test_horizon_and_wheel_states():
    h = stateful.Horizon(3, 1.0)
    assert [h.step(t, t, 1)[0] for t in (0.0, 0.5, 0.9, 1.2)] == [1, 2, 3, 3]
    assert h.step(1.3, 1.0, 2)[0] == 1
    assert h.step(1.3, 5.0, 2) == (1, 5.0, False)
    with pytest.raises(ValueError):
        h.step(1.2, 1.0, 2)
    w = stateful.WheelSpeed(1.0, 0.5, 1.0)
    w.step(0.0, "a", 1.0), w.step(0.0, "b", 1.2)
    assert w.step(0.0, "c", 9.0) == (pytest.approx(1.1), 2)
    assert w.step(5.0, "a", 2.0) == (2.0, 1)


def test_kalman_track_follows_a_straight_line():
    k = stateful.KalmanTrack(0.05)
    for i in range(200):
        x, y = 5 + 0.5 * i * 0.1, 2.0
        k.step(i * 0.1, "range", math.hypot(x, y))
        out = k.step(i * 0.1, "heading", 0.0)
    assert math.hypot(out[0], out[1]) == pytest.approx(math.hypot(x, y), abs=0.1) and out[2] == pytest.approx(0.0, abs=0.05)


def test_streaming_low_pass_equals_the_batch(spark, sf, tmp_path):
    from plinth.plans.catalog import stream
    from plinth.streaming import replay

    rows = stream(spark, sf).select("user_id", "event_id", "t", "value").where("user_id < 3")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    try:
        got = replay.run_to_end(replay.streaming_low_pass(events, 3600.0)).toPandas()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    expected = stateful.low_pass(rows, "user_id", "t", "value", 3600.0).toPandas()
    a, b = (d.sort_values("event_id").reset_index(drop=True) for d in (got, expected))
    assert np.allclose(a["filtered"], b["filtered"]) and len(a) == len(b)


def test_frame_source_round_trip(spark, tmp_path):
    from plinth.sources.packets import FIELDS, HEADER, FrameSource, decode, IMU

    data = np.arange(10, dtype="<f4").reshape(2, 5)
    (tmp_path / "a.bin").write_bytes(HEADER.pack(7, 1.5, 0.0, 2) + data.tobytes() + HEADER.pack(8, 2.5, 0.0, 0))
    spark.dataSource.register(FrameSource)
    got = spark.read.format("frames").load(str(tmp_path)).orderBy("point").collect()
    assert [(r.frame, r.point, *(r[f] for f in FIELDS)) for r in got] == [(7, i + 1, *map(float, data[i])) for i in range(2)]
    packet = struct.pack("<QQQ6f", 1, 2, 3, *range(6))
    df = spark.createDataFrame([(1, bytearray(packet))], "id int, raw binary")
    assert one(decode(df, "raw", IMU)).gz == 5.0


def test_sources(spark, tmp_path):
    from plinth.sources import frames

    pts = spark.createDataFrame([("d", 1, 1, 0.5), ("d", 2, 1, 0.7)], "drive string, frame int, point int, x double")
    frames.write_frames(pts, str(tmp_path / "f"))
    only = frames.read_frame(spark, str(tmp_path / "f"), "d", 2)
    assert one(only).x == 0.7 and "PartitionFilters" in only._jdf.queryExecution().toString()
    (tmp_path / "p.csv").write_text("frame_index,pose_x,odom_x\n1,,2.5\n2,3.5,9\n")
    wanted = spark.createDataFrame([(2,), (1,)], "frame_index int")
    got = frames.read_poses(spark, str(tmp_path / "p.csv"), wanted, "frame_index int, pose_x double, odom_x double").collect()
    assert {r.frame_index: r.x for r in got} == {1: 2.5, 2: 3.5}
    with pytest.raises(ValueError):
        frames.read_csv(spark, str(tmp_path / "p.csv"), "frame_index int", ["frame_index", "none"])
    nested = spark.createDataFrame([((1, (2, 3)),)], "a struct<b:int,c:struct<d:int,e:int>>")
    assert frames.flattened(nested).columns == ["a.b", "a.c.d", "a.c.e"]
    (tmp_path / "j.json").write_text(json.dumps([{"k": 1}, {"k": 2}]))
    assert frames.read_json_lists(spark, str(tmp_path / "j.json"), "k int").count() == 2
    ns = one(spark.createDataFrame([("1970-01-01 00:00:01.123456789",)], "s string").select(frames.parse_nanos(F.col("s")).alias("n"))).n
    assert ns == 1123456789
    assert frames.publish(pts, f"file://{tmp_path}/pub", ["point", "x"]) == frames.publish(pts, f"file://{tmp_path}/pub", ["point", "x"])


def test_confusion_of_empty_sides(spark):
    a = spark.createDataFrame([("r", 1)], "cls string, cell int")
    r = one(evaluate.confusion(a, a.where("false"), ["cell"], ["cls"]))
    assert (r.tp, r.fp, r.fn, r.recall, r.precision) == (0, 0, 1, 0.0, None)


def test_nearest_without_a_partner(spark):
    a = spark.createDataFrame([("c", 1, 0.0, 0.0)], "cls string, id int, x double, y double")
    far = spark.createDataFrame([("c", 2, 9.0, 9.0)], "cls string, mark int, x double, y double")
    assert one(spatial.nearest_within(a, far, ["cls"], "id", "mark", 1.0)).nearest_id is None
