"""Queries: sorts, top-k, set operations, relational joins, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plinth.functions import scalar
from plinth.plans.catalog import EV, PTS, points, query, rnd, stream, table


@query("lexical_sort", f"{PTS} SELECT frame, ok, ln, x, row_number() OVER (PARTITION BY frame ORDER BY x, y, z, ok, ln, inten) AS pos FROM pts")
def lexical_sort(spark, sf):
    w = Window.partitionBy("frame").orderBy("x", "y", "z", "ok", "ln", "inten")
    return points(spark, sf).select("frame", "ok", "ln", "x", F.row_number().over(w).cast("long").alias("pos"))


@query("near_to_far", f"{PTS}, d AS (SELECT frame, cls, round(min(sqrt(x*x + y*y)), 6) AS rng FROM pts GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY frame ORDER BY rng, cls) AS pos FROM d")
def near_to_far(spark, sf):
    d = points(spark, sf).groupBy("frame", "cls").agg(rnd(F.min(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)), 6).alias("rng"))
    return d.withColumn("pos", F.row_number().over(Window.partitionBy("frame").orderBy("rng", "cls")).cast("long"))


@query("k_smallest", f"{PTS}, k AS (SELECT frame, y, row_number() OVER (PARTITION BY frame ORDER BY y, x, ok, ln) AS i FROM pts) SELECT frame, i, y FROM k WHERE i <= 3")
def k_smallest(spark, sf):
    w = Window.partitionBy("frame").orderBy("y", "x", "ok", "ln")
    return points(spark, sf).withColumn("i", F.row_number().over(w).cast("long")).where("i <= 3").select("frame", "i", "y")


@query("first_best", f"{EV}, k AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, us, event_id) AS i FROM ev) SELECT user_id, event_id, value FROM k WHERE i = 1")
def first_best(spark, sf):
    best = F.min(F.struct((-F.col("value")).alias("v"), F.col("us"), F.col("event_id")))
    return stream(spark, sf).groupBy("user_id").agg(best.alias("b")).select("user_id", "b.event_id", (-F.col("b.v")).alias("value"))


@query("head_limit", f"{EV} SELECT event_id, us FROM ev ORDER BY us, event_id LIMIT 100")
def head_limit(spark, sf):
    return stream(spark, sf).orderBy("us", "event_id").limit(100).select("event_id", "us")


@query("even_sample", "WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM orders), s AS (SELECT DISTINCT CAST(floor(1 + g * ((SELECT count(*) FROM orders) - 1) / 49.0::DOUBLE + 0.5) AS BIGINT) AS i FROM generate_series(0, 49) t(g)) SELECT o_orderkey FROM k WHERE i IN (SELECT i FROM s)")
def even_sample(spark, sf):
    from plinth.operators.schedule import numbered

    o = table(spark, sf, "orders").select("o_orderkey")
    n = o.count()
    picks = sorted({int(1 + g * (n - 1) / 49 + 0.5) - 1 for g in range(50)})
    return numbered(o, "o_orderkey").where(F.col("row").isin(picks)).select("o_orderkey")


@query("distinct_rows", f"{PTS} SELECT DISTINCT cls, x, z FROM pts")
def distinct_rows(spark, sf):
    return points(spark, sf).select("cls", "x", "z").distinct()


@query("union_all", "SELECT 'customer' AS side, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def union_all(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("side"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, sf, "supplier").select(F.lit("supplier").alias("side"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def intersect(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(li.where("l_returnflag = 'A'").select("l_partkey"))


@query("except_ordered", "WITH d AS (SELECT DISTINCT l_orderkey AS k FROM lineitem EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT k FROM d")
def except_ordered(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().join(done, "k", "left_anti").orderBy("k")


@query("semi_join", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount = 0.1)")
def semi_join(spark, sf):
    li = table(spark, sf, "lineitem").where("l_discount = 0.1").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(li, "o_orderkey", "left_semi")


@query("anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("requested_order", "WITH q AS (SELECT * FROM (VALUES (1, 77), (2, 5), (3, 1234), (4, 40)) t(pos, k)) SELECT pos, o_orderkey, o_custkey FROM q JOIN orders ON o_orderkey = k")
def requested_order(spark, sf):
    q = spark.createDataFrame([(1, 77), (2, 5), (3, 1234), (4, 40)], "pos int, o_orderkey long")
    return table(spark, sf, "orders").join(F.broadcast(q), "o_orderkey").orderBy("pos").select("pos", "o_orderkey", "o_custkey")


@query("shared_classes", "SELECT p_type AS cls, count(*) AS n FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_size < 10 INTERSECT SELECT p_type FROM part WHERE p_size > 40) GROUP BY p_type")
def shared_classes(spark, sf):
    p = table(spark, sf, "part")
    both = p.where("p_size < 10").select("p_type").distinct().join(p.where("p_size > 40").select("p_type").distinct(), "p_type")
    return p.join(both, "p_type").groupBy(F.col("p_type").alias("cls")).agg(F.count("*").alias("n"))


@query("tagged_recovery", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity = 50")
def tagged_recovery(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return table(spark, sf, "lineitem").where("l_quantity = 50").join(s, "l_suppkey").select("l_orderkey", "l_linenumber", "s_name")


@query("scalar_transfers", f"{EV}, s AS (SELECT *, least(greatest((value - 10) / 50, 0), 1) AS u FROM ev) SELECT event_id, round(atan2(sin(value), cos(value)), 6) AS wrapped, round(least(greatest(value / 50, 0), 1), 6) AS clamped, round(u * u * (3 - 2 * u), 6) AS smooth, round(least(greatest((value - 20) / 5, 0), 1), 6) AS above, round(1 / (1 + exp(-value / 30)), 6) AS logistic, floor(value * 7 / 3 * 1e4 + 0.5) / 1e4 AS quantised FROM s")
def scalar_transfers(spark, sf):
    v = F.col("value")
    return stream(spark, sf).select("event_id", rnd(scalar.wrap(v), 6).alias("wrapped"), rnd(scalar.clamp01(v / 50), 6).alias("clamped"), rnd(scalar.smooth_step(v, 10, 60), 6).alias("smooth"), rnd(scalar.above(v, 20, 5), 6).alias("above"), rnd(scalar.logistic(v / 30), 6).alias("logistic"), scalar.quantised(v * 7 / 3, 1e4).alias("quantised"))


_COV = f"{PTS}, c AS (SELECT frame, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy FROM pts GROUP BY frame)"


def covariances(spark, sf):
    return points(spark, sf).groupBy("frame").agg(F.covar_pop("x", "x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("y", "y").alias("yy"))


@query("spd_clipping", f"{_COV}, e AS (SELECT *, sqrt(((xx-yy)/2)**2 + xy*xy) AS r FROM c), l AS (SELECT *, least(greatest((xx+yy)/2 + r, 1), 600) AS a, least(greatest((xx+yy)/2 - r, 1), 600) AS b FROM e) SELECT frame, round((a+b)/2 + (a-b)/2 * (xx-yy)/2/r, 4) AS cxx, round((a-b)/2 * xy/r, 4) AS cxy, round((a+b)/2 - (a-b)/2 * (xx-yy)/2/r, 4) AS cyy, round(a*b, 2) AS det, round(-ln(2*pi()) - 0.5*ln(a*b), 6) AS log_norm FROM l")
def spd_clipping(spark, sf):
    c = covariances(spark, sf)
    s = scalar.spd_clip(F.col("xx"), F.col("xy"), F.col("yy"), 1.0, 600.0)
    return c.select("frame", *(rnd(s[k], d).alias(k) for k, d in (("cxx", 4), ("cxy", 4), ("cyy", 4), ("det", 2), ("log_norm", 6))))


@query("principal_shape", f"{_COV}, e AS (SELECT *, sqrt(((xx-yy)/2)**2 + xy*xy) AS r FROM c) SELECT frame, round(0.5 * atan2(2*xy, xx-yy), 6) AS axis, round(2*r/(xx+yy), 6) AS anisotropy, round(greatest((xx+yy)/2 - r, 0), 4) AS minor, round((xx+yy)/2 + r, 4) AS major FROM e")
def principal_shape(spark, sf):
    a = [F.col(k) for k in ("xx", "xy", "yy")]
    axis, anisotropy = scalar.principal_axis(*a)
    _, _, minor, major = scalar.shape(*a)
    return covariances(spark, sf).select("frame", rnd(axis, 6).alias("axis"), rnd(anisotropy, 6).alias("anisotropy"), rnd(minor, 4).alias("minor"), rnd(major, 4).alias("major"))


@query("shape_distance", f"{_COV}, p AS (SELECT a.frame, a.xx*a.yy - a.xy**2 AS da, b.xx*b.yy - b.xy**2 AS db, (a.xx+b.xx)/2*(a.yy+b.yy)/2 - ((a.xy+b.xy)/2)**2 AS dm FROM c a JOIN c b ON b.frame = a.frame + 1) SELECT frame, round(0.5 * ln(dm / sqrt(da * db)), 7) AS distance FROM p")
def shape_distance(spark, sf):
    c = covariances(spark, sf)
    n = c.select((F.col("frame") - 1).alias("frame"), F.col("xx").alias("nxx"), F.col("xy").alias("nxy"), F.col("yy").alias("nyy"))
    d = scalar.bhattacharyya((F.col("xx"), F.col("xy"), F.col("yy")), (F.col("nxx"), F.col("nxy"), F.col("nyy")))
    return c.join(n, "frame").select("frame", rnd(d, 7).alias("distance"))


@query("log_sum_exp", f"{EV}, m AS (SELECT user_id, value, max(value) OVER (PARTITION BY user_id) AS m FROM ev) SELECT user_id, round(m + ln(sum(exp(value - m))), 6) AS lse FROM m GROUP BY user_id, m")
def log_sum_exp(spark, sf):
    m = stream(spark, sf).withColumn("m", F.max("value").over(Window.partitionBy("user_id")))
    return m.groupBy("user_id", "m").agg(F.sum(F.exp(F.col("value") - F.col("m"))).alias("s")).select("user_id", rnd(F.col("m") + F.ln("s"), 6).alias("lse"))


@query("euler_quaternion", f"{EV}, a AS (SELECT event_id, value / 100 AS r, value / 200 AS p, value / 50 AS y FROM ev) SELECT event_id, round(cos(r/2)*cos(p/2)*cos(y/2) + sin(r/2)*sin(p/2)*sin(y/2), 6) AS qw, round(sin(r/2)*cos(p/2)*cos(y/2) - cos(r/2)*sin(p/2)*sin(y/2), 6) AS qx, round(cos(r/2)*sin(p/2)*cos(y/2) + sin(r/2)*cos(p/2)*sin(y/2), 6) AS qy, round(cos(r/2)*cos(p/2)*sin(y/2) - sin(r/2)*sin(p/2)*cos(y/2), 6) AS qz FROM a")
def euler_quaternion(spark, sf):
    v = F.col("value")
    q = scalar.quaternion(v / 100, v / 200, v / 50)
    return stream(spark, sf).select("event_id", *(rnd(c, 6).alias(k) for k, c in zip(("qw", "qx", "qy", "qz"), q)))


@query("rigid_transform", f"{PTS}, p AS (SELECT s_suppkey AS frame, s_acctbal / 10000 AS a, s_nationkey AS tx, s_nationkey * 2 AS ty FROM supplier) SELECT ok, ln, x, y, round(cos(a)*x - sin(a)*y + tx, 5) AS gx, round(sin(a)*x + cos(a)*y + ty, 5) AS gy, round(a, 6) AS yaw FROM pts JOIN p USING (frame)")
def rigid_transform(spark, sf):
    zero = F.lit(0.0)
    q = scalar.quaternion(zero, zero, F.col("s_acctbal") / 10000)
    rot = scalar.rotation(*q)
    pose = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("frame"), *(rot[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)), F.col("s_nationkey").cast("double").alias("tx"), (F.col("s_nationkey") * 2.0).alias("ty"))
    m = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    p = points(spark, sf).join(pose, "frame")
    g = scalar.moved(m, [F.col("tx"), F.col("ty"), F.lit(0.0)], [F.col("x"), F.col("y"), F.col("z")])
    return p.select("ok", "ln", "x", "y", rnd(g[0], 5).alias("gx"), rnd(g[1], 5).alias("gy"), rnd(F.atan2("r10", "r00"), 6).alias("yaw"))


@query("reprojection", f"{PTS}, p AS (SELECT s_suppkey AS frame, s_acctbal / 10000 AS a, s_nationkey AS t FROM supplier) SELECT ok, ln, x, y, round(cos(a + 0.1 - a)*(x) - sin(0.1)*(y) + 0, 4) AS gx FROM pts JOIN p USING (frame)")
def reprojection(spark, sf):
    zero = F.lit(0.0)
    a = F.col("s_acctbal") / 10000
    old, new = scalar.rotation(*scalar.quaternion(zero, zero, a)), scalar.rotation(*scalar.quaternion(zero, zero, a + 0.1))
    t = [F.col("s_nationkey").cast("double"), F.lit(0.0), F.lit(0.0)]
    p = points(spark, sf).join(table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "frame"), "frame")
    world = scalar.moved(old, t, [F.col("x"), F.col("y"), F.col("z")])
    held = p.select("ok", "ln", "x", "y", "s_acctbal", "s_nationkey", *(c.alias(f"w{i}") for i, c in enumerate(world)))
    local = scalar.moved(old, t, [F.col(f"w{i}") for i in range(3)], inverse=True)
    back = held.select("ok", "ln", "x", "y", "s_acctbal", "s_nationkey", *(c.alias(f"l{i}") for i, c in enumerate(local)))
    again = scalar.moved(new, t, [F.col(f"l{i}") for i in range(3)])
    return back.select("ok", "ln", "x", "y", rnd(again[0] - F.col("s_nationkey") - (F.cos(a + 0.1) - F.cos(F.lit(0.1))) * F.col("x") + (F.sin(a + 0.1) - F.sin(F.lit(0.1))) * F.col("y"), 4).alias("gx"))


@query("slerp", f"{EV}, a AS (SELECT event_id, value / 100 AS b, value / 40 AS e, (event_id % 11) / 10.0::DOUBLE AS f FROM ev), s AS (SELECT event_id, b + f * (e - b - 2 * pi() * floor((e - b) / (2 * pi()) + 0.5)) AS g FROM a) SELECT event_id, round(CASE WHEN cos(g / 2) < 0 THEN -cos(g / 2) ELSE cos(g / 2) END, 6) AS qw, round(CASE WHEN cos(g / 2) < 0 THEN -sin(g / 2) ELSE sin(g / 2) END, 6) AS qz FROM s")
def slerp(spark, sf):
    zero, v = F.lit(0.0), F.col("value")
    a, b = scalar.quaternion(zero, zero, v / 100), scalar.quaternion(zero, zero, v / 40)
    q = scalar.slerp(list(a), list(b), (F.col("event_id") % 11) / 10.0, 0.9999999)
    # of a rotation's two quaternions the one with the positive first part
    s = F.when(q[0] < 0, -1.0).otherwise(1.0)
    return stream(spark, sf).select("event_id", rnd(s * q[0], 6).alias("qw"), rnd(s * q[3], 6).alias("qz"))


@query("tangent_plane", "WITH s AS (SELECT s_suppkey, radians(45 + s_acctbal / 1e6) AS la, radians(-93 + s_nationkey / 1000.0) AS lo, s_acctbal / 100 AS h FROM supplier), e AS (SELECT *, 6378137.0 / sqrt(1 - 0.0066943799901413165 * sin(la)**2) AS n, 6378137.0 / sqrt(1 - 0.0066943799901413165 * sin(radians(45))**2) AS n0 FROM s), d AS (SELECT *, (n + h)*cos(la)*cos(lo) - (n0 + 250)*cos(radians(45))*cos(radians(-93)) AS dx, (n + h)*cos(la)*sin(lo) - (n0 + 250)*cos(radians(45))*sin(radians(-93)) AS dy, (n*(1 - 0.0066943799901413165) + h)*sin(la) - (n0*(1 - 0.0066943799901413165) + 250)*sin(radians(45)) AS dz FROM e) SELECT s_suppkey, round(-sin(radians(-93))*dx + cos(radians(-93))*dy, 3) AS east, round(-sin(radians(45))*cos(radians(-93))*dx - sin(radians(45))*sin(radians(-93))*dy + cos(radians(45))*dz, 3) AS north, round(cos(radians(45))*cos(radians(-93))*dx + cos(radians(45))*sin(radians(-93))*dy + sin(radians(45))*dz, 3) AS up FROM d")
def tangent_plane(spark, sf):
    import math

    la, lo = F.radians(45 + F.col("s_acctbal") / 1e6), F.radians(-93 + F.col("s_nationkey") / 1000.0)
    e = scalar.enu(la, lo, F.col("s_acctbal") / 100, math.radians(45), math.radians(-93), 250.0)
    return table(spark, sf, "supplier").select("s_suppkey", *(rnd(c, 3).alias(k) for k, c in zip(("east", "north", "up"), e)))


@query("utm_projection")
def utm_projection(spark, sf):
    la, lo = F.radians(45 + F.col("s_acctbal") / 1e6), F.radians(-93 + F.col("s_nationkey") / 1000.0)
    east, north = scalar.utm(la, lo, 15)
    return table(spark, sf, "supplier").select("s_suppkey", rnd(east, 3).alias("easting"), rnd(north, 3).alias("northing"))


@query("gps_week_seconds", "SELECT o_orderkey, (2317 + o_orderkey % 3 - 2317) * 604800 + (o_totalprice - 604797.0) AS seconds FROM orders")
def gps_week_seconds(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalar.gps_seconds(2317 + F.col("o_orderkey") % 3, F.col("o_totalprice"), 2317, 604797.0).alias("seconds"))


@query("clock_conversion", f"{EV} SELECT event_id, round(CASE WHEN t BETWEEN 3600 AND 1000000 THEN 1.09 * t - 17.5 END, 5) AS receiver FROM ev")
def clock_conversion(spark, sf):
    return stream(spark, sf).select("event_id", rnd(scalar.converted_time(F.col("t"), 1.09, -17.5, 3600, 1000000), 5).alias("receiver"))


@query("key_concat", f"{PTS} SELECT DISTINCT frame || ':' || cls || ':' || ln AS key FROM pts")
def key_concat(spark, sf):
    return points(spark, sf).select(F.concat_ws(":", "frame", "cls", "ln").alias("key")).distinct()


@query("regex_classes", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^(PROMO|STANDARD)') THEN 'drop' WHEN regexp_matches(p_type, 'BRASS$') THEN 'metal' ELSE 'keep' END AS reason, regexp_replace(p_name, '[^a-z]+', '_', 'g') AS slug FROM part")
def regex_classes(spark, sf):
    t = F.col("p_type")
    return table(spark, sf, "part").select("p_partkey", F.when(t.rlike("^(PROMO|STANDARD)"), "drop").when(t.rlike("BRASS$"), "metal").otherwise("keep").alias("reason"), F.regexp_replace("p_name", "[^a-z]+", "_").alias("slug"))


@query("json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("wheel_consensus", f"{EV}, w AS (SELECT user_id, CAST(floor(us / 86400000000) AS BIGINT) AS d, list(value ORDER BY value) AS v FROM ev GROUP BY ALL HAVING count(*) >= 3), m AS (SELECT *, list_aggregate(v, 'median') AS m FROM w), f AS (SELECT *, list_filter(v, lambda x: abs(x - m) <= 15) AS k FROM m) SELECT user_id, d, len(k) AS n, round(list_avg(k), 5) AS consensus FROM f")
def wheel_consensus(spark, sf):
    g = stream(spark, sf).groupBy("user_id", F.floor(F.col("us") / 86400000000).alias("d")).agg(F.array_sort(F.collect_list("value")).alias("v"))
    n = F.size("v")
    g = g.where(n >= 3).withColumn("m", (F.element_at("v", F.floor((n + 1) / 2).cast("int")) + F.element_at("v", F.floor((n + 2) / 2).cast("int"))) / 2)
    g = g.withColumn("k", F.filter("v", lambda x: F.abs(x - F.col("m")) <= 15))
    return g.select("user_id", "d", F.size("k").cast("long").alias("n"), rnd(F.try_divide(F.aggregate("k", F.lit(0.0), lambda a, x: a + x), F.size("k")), 5).alias("consensus"))


@query("typed_rows", "SELECT event_id, event_type AS topic, epoch_us(ts) // 1000000 AS sec, (epoch_us(ts) % 1000000) * 1000 AS nanosec, value FROM events WHERE event_type IN ('view', 'click')")
def typed_rows(spark, sf):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "click"))
    return e.select("event_id", F.col("event_type").alias("topic"), F.floor(us / 1000000).alias("sec"), (us % 1000000 * 1000).alias("nanosec"), "value")


@query("canonical_columns", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END, c_acctbal) AS pose FROM orders JOIN customer ON o_custkey = c_custkey")
def canonical_columns(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    o = table(spark, sf, "orders").join(c, "o_custkey")
    return o.select("o_orderkey", F.coalesce(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")), "c_acctbal").alias("pose"))
