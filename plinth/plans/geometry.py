"""Queries of poses, sensor geometry, projections, tracks and fits."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from plinth.functions import scalar
from plinth.operators import asof, moments, poses, spatial
from plinth.plans.catalog import EV, PTS, points, query, rnd, stream, table

C3 = f"{PTS}, c AS (SELECT cls, frame, avg(x) AS mx, avg(y) AS my, avg(z) * 100 AS mz, covar_pop(x, x) / 50 + 0.1 AS sxx, covar_pop(x, y) / 50 AS sxy, covar_pop(x, z) AS sxz, covar_pop(y, y) / 50 + 0.1 AS syy, covar_pop(y, z) AS syz, covar_pop(z, z) * 100 + 0.5 AS szz, count(*) / 1000.0::DOUBLE AS weight FROM pts GROUP BY cls, frame)"


def comps3(spark, sf):
    m = moments.cell_moments(points(spark, sf), ["cls", "frame"])
    s = lambda c, k, a: (F.col(c) * k + a).alias(c)
    return m.select("cls", "frame", "mx", "my", s("mz", 100, 0), s("sxx", 0.02, 0.1), s("sxy", 0.02, 0), "sxz", s("syy", 0.02, 0.1), "syz", s("szz", 100, 0.5), (F.col("n") / 1000.0).alias("weight"))


@query("xy_marginal", f"{C3} SELECT cls, frame, round(mx, 6) AS mx, round(my, 6) AS my, round(sxx, 6) AS sxx, round(sxy, 6) AS sxy, round(syy, 6) AS syy, round(weight, 6) AS weight FROM c")
def xy_marginal(spark, sf):
    """The XY marginal of XYZ components, weights unchanged."""
    m = spatial.xy_marginal(comps3(spark, sf))
    return m.select("cls", "frame", *(rnd(c, 6).alias(c) for c in ("mx", "my", "sxx", "sxy", "syy", "weight")))


_COS, _SIN = repr(math.cos(0.05)), repr(math.sin(0.05))
_OVERLAP = f"""{C3}, m AS (SELECT cls, weight, {_COS}*mx - {_SIN}*my + 0.3 AS mx, {_SIN}*mx + {_COS}*my - 0.2 AS my, mz, 0 - {_SIN}*mx - {_COS}*my AS ux, {_COS}*mx - {_SIN}*my AS uy,
 {_COS}*{_COS}*sxx - 2*{_COS}*{_SIN}*sxy + {_SIN}*{_SIN}*syy AS a, {_COS}*{_SIN}*(sxx - syy) + ({_COS}*{_COS} - {_SIN}*{_SIN})*sxy AS b, {_COS}*sxz - {_SIN}*syz AS c, {_SIN}*{_SIN}*sxx + 2*{_COS}*{_SIN}*sxy + {_COS}*{_COS}*syy AS d, {_SIN}*sxz + {_COS}*syz AS e, szz AS f FROM c WHERE frame >= 50),
p AS (SELECT f.cls, f.weight * m.weight AS w, f.sxx + m.a AS a, f.sxy + m.b AS b, f.sxz + m.c AS c, f.syy + m.d AS d, f.syz + m.e AS e, f.szz + m.f AS h, f.mx - m.mx AS dx, f.my - m.my AS dy, f.mz - m.mz AS dz, ux, uy, 0 - 2*m.b AS ta, m.a - m.d AS tb, 0 - m.e AS tc, 2*m.b AS td, m.c AS te FROM c f JOIN m ON f.cls = m.cls WHERE f.frame < 50),
i AS (SELECT *, d*h - e*e AS aa, c*e - b*h AS ab, b*e - c*d AS ac, a*h - c*c AS ad, b*c - a*e AS ae, a*d - b*b AS af FROM p), j AS (SELECT *, a*aa + b*ab + c*ac AS det FROM i),
q AS (SELECT *, (aa*dx + ab*dy + ac*dz)/det AS qx, (ab*dx + ad*dy + ae*dz)/det AS qy, (ac*dx + ae*dy + af*dz)/det AS qz FROM j),
k AS (SELECT *, w * exp(-0.5 * (dx*qx + dy*qy + dz*qz)) / (pow(2*pi(), 1.5) * sqrt(det)) AS k FROM q)"""


@query("xyz_overlap", f"{_OVERLAP} SELECT cls, round(sum(k), 7) AS overlap, round(sum(k*qx), 7) AS gx, round(sum(k*qy), 7) AS gy, round(sum(k*(qx*ux + qy*uy + 0.5*(qx*qx*ta + 2*qx*qy*tb + 2*qx*qz*tc + qy*qy*td + 2*qy*qz*te - (aa*ta + 2*ab*tb + 2*ac*tc + ad*td + 2*ae*te)/det))), 5) AS gyaw FROM k GROUP BY cls")
def xyz_overlap(spark, sf):
    c = comps3(spark, sf)
    o = spatial.xyz_overlap(c.where("frame < 50"), c.where("frame >= 50"), "cls", (0.3, -0.2, 0.05))
    return o.select("cls", *(rnd(n, 7).alias(n) for n in ("overlap", "gx", "gy")), rnd("gyaw", 5).alias("gyaw"))


@query("sigma_points", f"{C3}, e AS (SELECT *, 0.5 * atan2(2*sxy, sxx - syy) AS t, sqrt(((sxx - syy)/2)**2 + sxy*sxy) AS r FROM c), a AS (SELECT *, sqrt(2.5 * ((sxx + syy)/2 + r)) AS a, sqrt(2.5 * greatest((sxx + syy)/2 - r, 0)) AS b FROM e) SELECT cls, frame, CAST(i AS INT) AS sigma, round(mx + CASE i WHEN 0 THEN 0 WHEN 1 THEN a*cos(t) WHEN 2 THEN 0 - a*cos(t) WHEN 3 THEN 0 - b*sin(t) ELSE b*sin(t) END, 6) AS x, round(my + CASE i WHEN 0 THEN 0 WHEN 1 THEN a*sin(t) WHEN 2 THEN 0 - a*sin(t) WHEN 3 THEN b*cos(t) ELSE 0 - b*cos(t) END, 6) AS y FROM a, generate_series(0, 4) g(i)")
def sigma_points(spark, sf):
    return poses.sigma_points(comps3(spark, sf).drop("mz", "sxz", "syz", "szz", "weight")).select("cls", "frame", "sigma", rnd("x", 6).alias("x"), rnd("y", 6).alias("y"))


_TRACK = "WINDOW w AS (PARTITION BY cls ORDER BY frame ROWS UNBOUNDED PRECEDING)"


@query("running_track", f"{C3} SELECT cls, frame, count(*) OVER w AS n, round(avg(mx) OVER w, 6) AS mx, round(avg(my) OVER w, 6) AS my, round(avg(sxx) OVER w + var_pop(mx) OVER w, 6) AS sxx, round(avg(sxy) OVER w + covar_pop(mx, my) OVER w, 6) AS sxy, round(avg(syy) OVER w + var_pop(my) OVER w, 6) AS syy FROM c {_TRACK}")
def running_track(spark, sf):
    """Mean and scatter of a class's components over the frames so far."""
    t = poses.running_track(comps3(spark, sf), ["cls"], ["frame"])
    return t.select("cls", "frame", F.col("track_n").alias("n"), *(rnd(f"track_{c}", 6).alias(c) for c in ("mx", "my", "sxx", "sxy", "syy")))


@query("running_view", f"{C3}, v AS (SELECT *, exp(0 - ((mx - 25)**2 + (my - 50)**2) / 8) AS k FROM c), s AS (SELECT cls, frame, sum(k) OVER w AS t, sum(k*mx) OVER w AS x, sum(k*my) OVER w AS y, sum(k*(sxx + (mx-25)**2)) OVER w AS xx, sum(k*(sxy + (mx-25)*(my-50))) OVER w AS xy FROM v {_TRACK}) SELECT cls, frame, round(x/t, 5) AS mx, round(y/t, 5) AS my, round(xx/t - (x/t - 25)**2, 5) AS sxx, round(xy/t - (x/t - 25)*(y/t - 50), 5) AS sxy FROM s")
def running_view(spark, sf):
    """The same, weighted by the kernel of a view, sample by sample."""
    k = F.exp(-((F.col("mx") - 25) ** 2 + (F.col("my") - 50) ** 2) / 8)
    t = poses.running_track(comps3(spark, sf), ["cls"], ["frame"], k)
    return t.select("cls", "frame", *(rnd(f"track_{c}", 5).alias(c) for c in ("mx", "my", "sxx", "sxy")))


_POSED = f"{EV}, q AS (SELECT event_id, user_id, t, value FROM ev WHERE event_type = 'view'), p AS (SELECT user_id, t, value / 80 AS yaw, t / 1e5 AS px, value AS py, 2.0::DOUBLE AS pz FROM ev WHERE event_type <> 'view'), l AS (SELECT q.*, p.t AS t0, p.yaw AS y0, p.px AS x0, p.py AS v0 FROM q ASOF JOIN p ON q.user_id = p.user_id AND q.t >= p.t), b AS (SELECT l.*, p.t AS t1, p.yaw AS y1, p.px AS x1, p.py AS v1 FROM l ASOF JOIN p ON l.user_id = p.user_id AND l.t <= p.t), w AS (SELECT *, CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0 END AS w FROM b WHERE t1 - t0 <= 200000), i AS (SELECT event_id, t, value, y0 + w * (y1 - y0 - 2 * pi() * floor((y1 - y0) / (2 * pi()) + 0.5)) AS yaw, (1 - w) * x0 + w * x1 AS px, (1 - w) * v0 + w * v1 AS py FROM w)"


def posed(spark, sf):
    s = stream(spark, sf)
    zero = F.lit(0.0)
    q = scalar.quaternion(zero, zero, F.col("value") / 80)
    p = s.where("event_type <> 'view'").select("user_id", "t", (F.col("t") / 1e5).alias("px"), F.col("value").alias("py"), F.lit(2.0).alias("pz"), *(c.alias(n) for c, n in zip(q, poses.QUATERNION)))
    return s.where("event_type = 'view'").select("event_id", "user_id", "t", "value"), p


@query("pose_join", f"{_POSED} SELECT event_id, round(px, 6) AS px, round(py, 6) AS py, round(cos(yaw), 4) AS c, round(sin(yaw), 4) AS s FROM i")
def pose_join(spark, sf):
    left, p = posed(spark, sf)
    out = poses.interpolated_pose(left, p, ["user_id"], "t", ["px", "py", "pz"], 200000.0)
    r = scalar.rotation(*(F.col(c) for c in poses.QUATERNION))
    return out.select("event_id", rnd("px", 6).alias("px"), rnd("py", 6).alias("py"), rnd(r[0][0], 4).alias("c"), rnd(r[1][0], 4).alias("s"))


@query("full_deskew", f"{_POSED} SELECT event_id, round(cos(yaw)*value/100 - sin(yaw)*2 + px, 3) AS gx, round(sin(yaw)*value/100 + cos(yaw)*2 + py, 3) AS gy, 3.0::DOUBLE AS gz FROM i")
def full_deskew(spark, sf):
    left, p = posed(spark, sf)
    pts = left.withColumns({"value": F.col("value") / 100, "b": F.lit(2.0), "c": F.lit(1.0)})
    d = poses.deskewed(pts, p, ["user_id"], "t", ["value", "b", "c"], ["px", "py", "pz"], 200000.0)
    return d.select("event_id", rnd("gx", 3).alias("gx"), rnd("gy", 3).alias("gy"), rnd("gz", 6).alias("gz"))


_ANGLES = f"{EV}, a AS (SELECT event_id, value / 300 AS ro, 0.5 - value / 200 AS pi_, value / 60 - 1 AS ya, value FROM ev)"


@query("planar_tilt", f"{_ANGLES} SELECT event_id, round(atan2(sin(ya)*cos(pi_), cos(ya)*cos(pi_)), 6) AS yaw, round(cos(pi_)*sin(ro), 6) AS t21, round(cos(pi_)*cos(ro), 6) AS t22, round(sin(pi_)*sin(ro), 6) AS t01 FROM a WHERE cos(pi_) > 0.05")
def planar_tilt(spark, sf):
    """Heading and the tilt that is left."""
    v = F.col("value")
    r = scalar.rotation(*scalar.quaternion(v / 300, 0.5 - v / 200, v / 60 - 1))
    yaw, t = poses.planar_and_tilt(r)
    return stream(spark, sf).where(F.cos(0.5 - v / 200) > 0.05).select("event_id", rnd(yaw, 6).alias("yaw"), rnd(t[2][1], 6).alias("t21"), rnd(t[2][2], 6).alias("t22"), rnd(t[0][1], 6).alias("t01"))


@query("leveling", f"{_ANGLES}, r AS (SELECT *, 0.1 + tan(pi_) * (sin(ro)*0.2 + cos(ro)*0.3) AS dr, cos(ro)*0.2 - sin(ro)*0.3 AS dp FROM a WHERE abs(cos(pi_)) > 0.01) SELECT event_id, round(sin(pi_)*sin(ro), 6) AS r01, round(cos(pi_)*cos(ro), 6) AS r22, round(0 - sin(pi_)*dp, 5) AS d00, round(cos(pi_)*sin(ro)*dp + sin(pi_)*cos(ro)*dr, 5) AS d01, round(0 - sin(ro)*dr, 5) AS d11, round(0 - sin(pi_)*cos(ro)*dp - cos(pi_)*sin(ro)*dr, 5) AS d22 FROM r")
def leveling(spark, sf):
    v = F.col("value")
    r, d = poses.leveling(v / 300, 0.5 - v / 200, (F.lit(0.1), F.lit(0.2), F.lit(0.3)))
    out = {"r01": r[0][1], "r22": r[2][2]}
    rates = {"d00": d[0][0], "d01": d[0][1], "d11": d[1][1], "d22": d[2][2]}
    return stream(spark, sf).where(F.abs(F.cos(0.5 - v / 200)) > 0.01).select("event_id", *(rnd(c, 6).alias(n) for n, c in out.items()), *(rnd(c, 5).alias(n) for n, c in rates.items()))


@query("line_residuals", f"{PTS}, a AS (SELECT *, frame / 10.0::DOUBLE AS h, cos(0.2)*x - sin(0.2)*y AS rx, sin(0.2)*x + cos(0.2)*y AS ry FROM pts) SELECT ok, ln, x, y, round(cos(h)*(rx + 1 - 30) + sin(h)*(ry - 2 - 40), 5) AS residual, round(sin(h)*rx - cos(h)*ry, 5) AS by_yaw FROM a")
def line_residuals(spark, sf):
    h = F.col("frame") / 10.0
    r, j = poses.line_measurement(F.col("x"), F.col("y"), F.lit(30.0), F.lit(40.0), F.cos(h), F.sin(h), (F.lit(1.0), F.lit(-2.0), F.lit(0.2)))
    return points(spark, sf).select("ok", "ln", "x", "y", rnd(r, 5).alias("residual"), rnd(j[2], 5).alias("by_yaw"))


@query("gnss_point", f"{EV}, a AS (SELECT event_id, value, t / 1e4 AS px, value / 30 AS h, 4 + value / 100 AS ixx, 0.5::DOUBLE AS ixy, 3::DOUBLE AS iyy FROM ev), b AS (SELECT *, cos(h)*1.2 - sin(h)*0.4 AS ox, sin(h)*1.2 + cos(h)*0.4 AS oy, ixx*iyy - ixy*ixy AS det FROM a), c AS (SELECT *, iyy/det + cos(h)*cos(h)*0.02 - 2*cos(h)*sin(h)*0.005 + sin(h)*sin(h)*0.03 + 0.0004*oy*oy AS xx, 0 - ixy/det + cos(h)*sin(h)*(0.02 - 0.03) + (cos(h)*cos(h) - sin(h)*sin(h))*0.005 - 0.0004*ox*oy AS xy, ixx/det + sin(h)*sin(h)*0.02 + 2*cos(h)*sin(h)*0.005 + cos(h)*cos(h)*0.03 + 0.0004*ox*ox AS yy FROM b) SELECT event_id, round(px - ox, 6) AS x, round(value - oy, 6) AS y, round(yy / (xx*yy - xy*xy), 6) AS ixx, round(0 - xy / (xx*yy - xy*xy), 6) AS ixy, round(xx / (xx*yy - xy*xy), 6) AS iyy FROM c")
def gnss_point(spark, sf):
    v = F.col("value")
    x, y, i = poses.output_point(F.col("t") / 1e4, v, (4 + v / 100, F.lit(0.5), F.lit(3.0)), v / 30, (1.2, 0.4), (0.02, 0.005, 0.03), 0.02)
    return stream(spark, sf).select("event_id", *(rnd(c, 6).alias(n) for c, n in zip((x, y, *i), ("x", "y", "ixx", "ixy", "iyy"))))


_N = scalar.EARTH_F / (2 - scalar.EARTH_F)
_A = scalar.EARTH_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_AL = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_E = 2 * math.sqrt(_N) / (1 + _N)
_series = lambda f, g, k: " + ".join(f"{(2 * (j + 1) if k else 1) * _AL[j]!r} * {f}({2 * (j + 1)} * xi) * {g}({2 * (j + 1)} * eta)" for j in range(3))


@query("utm_factors", f"WITH s AS (SELECT s_suppkey, radians(CASE WHEN s_suppkey % 2 = 0 THEN 45 ELSE -30 END + s_acctbal / 1e5) AS la, radians(-93.5 + s_nationkey / 10.0::DOUBLE) - radians(6 * 15 - 183) AS dl FROM supplier), a AS (SELECT *, sinh(atanh(sin(la)) - {_E!r} * atanh({_E!r} * sin(la))) AS t FROM s), b AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t*t)) AS eta FROM a), c AS (SELECT *, 1 + {_series('cos', 'cosh', True)} AS p, {_series('sin', 'sinh', True)} AS q FROM b) SELECT s_suppkey, round(500000 + {0.9996 * _A!r} * (eta + {_series('cos', 'sinh', False)}), 4) AS east, round({0.9996 * _A!r} * (xi + {_series('sin', 'cosh', False)}) + CASE WHEN la < 0 THEN 10000000 ELSE 0 END, 4) AS north, round(atan(t * tan(dl) / sqrt(1 + t*t)) + atan2(q, p), 9) AS convergence, round({0.9996 * _A / scalar.EARTH_A!r} * sqrt(p*p + q*q) * sqrt(1 + tan(la)**2) * sqrt(1 - {_E * _E!r} * sin(la)**2) / sqrt(t*t + cos(dl)**2), 9) AS scale FROM c")
def utm_factors(spark, sf):
    base = F.when(F.col("s_suppkey") % 2 == 0, 45.0).otherwise(-30.0)
    east, north, turn, scale = poses.utm_factors(F.radians(base + F.col("s_acctbal") / 1e5), F.radians(-93.5 + F.col("s_nationkey") / 10.0), 15)
    return table(spark, sf, "supplier").select("s_suppkey", rnd(east, 4).alias("east"), rnd(north, 4).alias("north"), rnd(turn, 9).alias("convergence"), rnd(scale, 9).alias("scale"))


@query("braking_profile", f"{EV}, s AS (SELECT event_id, user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) * 3.0::DOUBLE AS s, sqrt(2.0 / greatest(value / 100, 0.01)) AS lim FROM ev), r AS (SELECT *, min(lim*lim + 3.0 * s) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM s) SELECT event_id, round(sqrt(greatest(e - 3.0 * s, 0)), 6) AS speed FROM r")
def braking_profile(spark, sf):
    """Curvature-limited speed with braking ahead."""
    s = stream(spark, sf).withColumn("s", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")) * 3.0)
    p = poses.braking_profile(s, ["user_id"], "s", F.sqrt(2.0 / F.greatest(F.col("value") / 100, F.lit(0.01))), 1.5)
    return p.select("event_id", rnd("speed", 6).alias("speed"))


@query("covered_join", "SELECT o_orderstatus, l_returnflag, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def covered_join(spark, sf):
    """Every line has its order, or the query fails."""
    left = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    j = poses.covered_join(left, table(spark, sf, "orders"), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])
    return j.groupBy("o_orderstatus", "l_returnflag").agg(F.count("*").alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total"))


@query("causal_chain", f"{EV}, q AS (SELECT event_id, user_id, t FROM ev WHERE event_type = 'view'), i AS (SELECT user_id, t AS ti, value AS gyro FROM ev WHERE event_type = 'click'), w AS (SELECT user_id, t AS tw, value AS wheel FROM ev WHERE event_type = 'purchase'), a AS (SELECT q.*, ti, gyro FROM q ASOF LEFT JOIN i ON q.user_id = i.user_id AND q.t >= i.ti), b AS (SELECT a.*, tw, wheel FROM a ASOF LEFT JOIN w ON a.user_id = w.user_id AND a.ti >= w.tw) SELECT event_id, round(CASE WHEN t - ti <= 100000 THEN gyro END, 6) AS gyro, round(CASE WHEN t - ti <= 100000 AND ti - tw <= 300000 THEN wheel END, 6) AS wheel FROM b")
def causal_chain(spark, sf):
    """The newest gyro row before each query, and the newest wheel row before that, unless stale."""
    s = stream(spark, sf)
    side = lambda kind, name: s.where(f"event_type = '{kind}'").select("user_id", "t", F.col("value").alias(name))
    a = asof.backward(s.where("event_type = 'view'").select("event_id", "user_id", "t"), side("click", "gyro"), ["user_id"], "t", ["gyro"], 100000.0)
    a = a.select("event_id", "user_id", F.col("match.t").alias("t"), F.col("match.gyro").alias("gyro"))
    b = asof.backward(a.where("t IS NOT NULL"), side("purchase", "wheel"), ["user_id"], "t", ["wheel"], 300000.0)
    both = a.select("event_id", "gyro").join(b.select("event_id", F.col("match.wheel").alias("wheel")), "event_id", "left")
    return both.select("event_id", rnd("gyro", 6).alias("gyro"), rnd("wheel", 6).alias("wheel"))


_W = poses.polynomial_slopes(51, 3)
_ROWS = ", ".join(f"({i + 1}, [{', '.join(repr(float(x)) for x in row)}])" for i, row in enumerate(_W))


@query("smooth_derivative", f"{EV}, k AS (SELECT user_id, list(value ORDER BY us, event_id) AS l, count(*) AS n FROM ev GROUP BY user_id), r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM ev), b AS (SELECT event_id, l, n, i, greatest(least(i - 26, n - 51), 0) AS base FROM r JOIN k USING (user_id)), w(p, w) AS (VALUES {_ROWS}) SELECT event_id, round(list_inner_product(l[base + 1 : base + 51], w), 6) AS slope FROM b JOIN w ON w.p = i - base WHERE n >= 51 UNION ALL SELECT event_id, NULL FROM b WHERE n < 51")
def smooth_derivative(spark, sf):
    """Savitzky-Golay derivative, 51 rows and order 3, ends by the polynomials of the first and last window."""
    s = stream(spark, sf).withColumn("o", F.struct("us", "event_id"))
    return poses.smooth_derivative(s, ["user_id"], "o", "value").select("event_id", rnd("slope", 6).alias("slope"))


@query("trajectory_score", f"{EV}, e AS (SELECT user_id, abs(value - 50) / 10 AS e, atan2(sin(value / 7), cos(value / 7)) AS h FROM ev) SELECT user_id, count(*) AS n, round(sqrt(avg(e*e)), 6) AS rmse, round(avg(e), 6) AS mean, round(quantile_cont(e, 0.95), 6) AS p95, round(max(e), 6) AS worst, round(degrees(sqrt(avg(h*h))), 6) AS heading_rmse, count(*) FILTER (WHERE e > 1) AS beyond FROM e GROUP BY user_id")
def trajectory_score(spark, sf):
    from plinth.operators.evaluate import trajectory_score as score

    s = stream(spark, sf).select("user_id", (F.abs(F.col("value") - 50) / 10).alias("e"), scalar.wrap(F.col("value") / 7).alias("h"))
    t = score(s, ["user_id"], "e", "h", 1.0)
    return t.select("user_id", "n", *(rnd(c, 6).alias(c) for c in ("rmse", "mean", "p95", "worst", "heading_rmse")), "beyond")


@query("stamp_parse", "SELECT o_orderkey, (epoch(o_orderdate::TIMESTAMP)::BIGINT + 45296) * 1000000000 + (o_orderkey * 7919) % 1000000000 AS nanos FROM orders")
def stamp_parse(spark, sf):
    """Texts with nine fractional digits to nanoseconds."""
    from plinth.sources.frames import parse_nanos

    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 12:34:56."), F.lpad(((F.col("o_orderkey") * 7919) % 1000000000).cast("string"), 9, "0"))
    return table(spark, sf, "orders").select("o_orderkey", parse_nanos(text).alias("nanos"))
