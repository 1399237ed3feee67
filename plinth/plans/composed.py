"""Queries composed of several operators: ownership, runs of dense returns, boundaries, deskew, overlap gradients."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from plinth.functions import scalar
from plinth.operators import asof, binning, graph, moments, ranges, spatial
from plinth.plans.catalog import EV, PTS, points, query, rnd, stream, table
from plinth.plans.space import _CC, COMP, GRID, IDS, beside, comps, grid, marked


_JITTER = "(c * (f * 7919 + 13)) % 10007"


@query("scan_match", f"{PTS}, p AS (SELECT DISTINCT frame AS f, CAST(x AS BIGINT) AS c FROM pts) SELECT a.f AS scan, b.f AS frame, min(b.f * 100000 + b.c * 10 + (b.c * (b.f * 7919 + 13)) % 10007 - a.c * 10 - (a.c * (a.f * 7919 + 13)) % 10007) AS start, count(*) AS columns FROM p a JOIN p b ON a.c = b.c GROUP BY a.f, b.f HAVING count(*) >= 16 AND min(b.f * 100000 + (b.c * (b.f * 7919 + 13)) % 10007 - (a.c * (a.f * 7919 + 13)) % 10007) = max(b.f * 100000 + (b.c * (b.f * 7919 + 13)) % 10007 - (a.c * (a.f * 7919 + 13)) % 10007)")
def scan_match(spark, sf):
    """Scans find the packet frame with their exact column times."""
    p = points(spark, sf).select(F.col("frame").cast("long").alias("f"), F.col("x").cast("long").alias("c")).distinct().withColumn("offset", F.col("c") * 10 + F.expr(_JITTER))
    scans = p.select(F.col("f").alias("scan"), "c", "offset", (F.col("f") * 100000 + 300).alias("about"))
    return ranges.scan_match(scans, p.select(F.col("f").alias("frame"), "c", (F.col("f") * 100000 + F.col("offset")).alias("stamp")), "scan", "frame", "c", 50000)


@query("dense_vertical_run", f"{PTS}, k AS (SELECT frame, y, lead(y, 4) OVER (PARTITION BY frame ORDER BY y) - y <= 0.8 AS dense FROM pts), d AS (SELECT frame, y, CASE WHEN y - lag(y) OVER (PARTITION BY frame ORDER BY y) > 0.8 THEN 1 ELSE 0 END AS n FROM k WHERE dense), g AS (SELECT frame, y, sum(n) OVER (PARTITION BY frame ORDER BY y) AS island FROM d), s AS (SELECT frame, max(y) - min(y) AS span FROM g GROUP BY frame, island) SELECT frame, round(max(span), 5) AS longest, count(*) AS runs FROM s GROUP BY frame")
def dense_vertical_run(spark, sf):
    from plinth.operators.islands import gap_islands

    w = Window.partitionBy("frame").orderBy("y")
    dense = points(spark, sf).select("frame", "y", (F.lead("y", 4).over(w) - F.col("y") <= 0.8).alias("dense")).where("dense")
    spans = gap_islands(dense, ["frame"], "y", 0.8).groupBy("frame", "island").agg((F.max("y") - F.min("y")).alias("span"))
    return spans.groupBy("frame").agg(rnd(F.max("span"), 5).alias("longest"), F.count("*").alias("runs"))


@query("shaft_ownership", f"{GRID}, o AS (SELECT * FROM g WHERE n >= 7), c AS (SELECT * FROM g WHERE n < 7), j AS (SELECT c.frame, c.n, o.bx, o.by, row_number() OVER (PARTITION BY c.frame, c.bx, c.by ORDER BY o.n DESC, o.bx, o.by) AS i FROM c JOIN o ON c.frame = o.frame AND abs(c.bx - o.bx) <= 1 AND abs(c.by - o.by) <= 1) SELECT frame, bx, by, sum(n)::BIGINT AS support, count(*) AS cells FROM j WHERE i = 1 GROUP BY ALL")
def shaft_ownership(spark, sf):
    g = grid(spark, sf)
    owners = g.where("n >= 7").select("frame", "bx", "by", F.col("n").alias("own"), F.col("bx").alias("ox"), F.col("by").alias("oy"))
    near = binning.neighbours(g.where("n < 7").select("frame", "bx", "by", "n"), owners, ["frame"], 1)
    best = near.groupBy("frame", "bx", "by", "n").agg(F.min(F.struct((-F.col("own")).alias("o"), "ox", "oy")).alias("b"))
    return best.groupBy("frame", F.col("b.ox").alias("bx"), F.col("b.oy").alias("by")).agg(F.sum("n").alias("support"), F.count("*").alias("cells"))


@query("view_conditioned", f"{PTS}, v AS (SELECT frame, x, y, exp(-((x - 25)**2 + (y - 50)**2) / 800) AS w FROM pts), m AS (SELECT frame, sum(w) AS s, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM v GROUP BY frame) SELECT frame, round(mx, 5) AS mx, round(my, 5) AS my, round(sum(w * (x - mx)**2) / s, 4) AS sxx, round(sum(w * (x - mx) * (y - my)) / s, 4) AS sxy FROM v JOIN m USING (frame) GROUP BY frame, mx, my, s")
def view_conditioned(spark, sf):
    d2 = (F.col("x") - 25) ** 2 + (F.col("y") - 50) ** 2
    m = moments.weighted_moments(points(spark, sf), ["frame"], F.exp(-d2 / 800))
    return m.select("frame", rnd("mx", 5).alias("mx"), rnd("my", 5).alias("my"), rnd("sxx", 4).alias("sxx"), rnd("sxy", 4).alias("sxy"))


@query("polynomial_derivative", f"{EV} SELECT event_id, round((-2 * lag(value, 2) OVER w - lag(value) OVER w + lead(value) OVER w + 2 * lead(value, 2) OVER w) / 10, 6) AS slope FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)")
def polynomial_derivative(spark, sf):
    """Derivative of the least-squares parabola over five rows, null where the window isn't whole."""
    w = Window.partitionBy("user_id").orderBy("us")
    weights = {-2: -2.0, -1: -1.0, 1: 1.0, 2: 2.0}
    total = sum((F.lag("value", -k).over(w) * c for k, c in weights.items()), F.lit(0.0))
    return stream(spark, sf).select("event_id", rnd(total / 10, 6).alias("slope"))


@query("boundary_interpolation", f"{GRID}, b AS (SELECT frame, bx, max(v) AS edge FROM g GROUP BY ALL), r AS (SELECT frame, unnest(generate_series(min(bx), max(bx))) AS bx FROM g GROUP BY frame), j AS (SELECT r.frame, r.bx, lo.bx AS x0, lo.edge AS e0 FROM r ASOF LEFT JOIN b lo ON r.frame = lo.frame AND r.bx >= lo.bx), k AS (SELECT j.*, hi.bx AS x1, hi.edge AS e1 FROM j ASOF LEFT JOIN b hi ON j.frame = hi.frame AND j.bx <= hi.bx) SELECT frame, bx, round(CASE WHEN x1 > x0 THEN e0 + (e1 - e0) * (bx - x0) / (x1 - x0) ELSE coalesce(e0, e1) END, 5) AS edge FROM k")
def boundary_interpolation(spark, sf):
    b = grid(spark, sf).groupBy("frame", "bx").agg(F.max("v").alias("edge"))
    r = b.groupBy("frame").agg(F.min("bx").alias("a"), F.max("bx").alias("z")).select("frame", F.explode(F.sequence("a", "z")).alias("bx"))
    j = asof.bracket(r, b, ["frame"], "bx", ["edge"])
    width = F.col("hi.t") - F.col("lo.t")
    inside = F.col("lo.edge") + (F.col("hi.edge") - F.col("lo.edge")) * (F.col("bx") - F.col("lo.t")) / F.when(width > 0, width)
    return j.select("frame", "bx", rnd(F.when(width > 0, inside).otherwise(F.coalesce("lo.edge", "hi.edge")), 5).alias("edge"))


@query("interior_mask", f"{GRID}, c AS (SELECT frame, bx, min(by) AS lo, max(by) AS hi FROM g WHERE n >= 5 GROUP BY ALL HAVING count(*) >= 2) SELECT g.frame, g.bx, g.by FROM g JOIN c ON g.frame = c.frame AND g.bx = c.bx AND g.by > lo AND g.by < hi")
def interior_mask(spark, sf):
    g = grid(spark, sf)
    c = g.where("n >= 5").groupBy("frame", "bx").agg(F.min("by").alias("lo"), F.max("by").alias("hi"), F.count("*").alias("k")).where("k >= 2").drop("k")
    return g.join(c, ["frame", "bx"]).where("by > lo AND by < hi").select("frame", "bx", "by")


@query("road_seeds", f"{GRID} SELECT a.frame, a.bx, a.by FROM g a JOIN g b ON a.frame = b.frame AND abs(a.bx - b.bx) <= 1 AND abs(a.by - b.by) <= 1 WHERE a.v < 60 GROUP BY ALL HAVING count(*) >= 8 AND max(abs(a.v - b.v)) <= 14")
def road_seeds(spark, sf):
    near = beside(grid(spark, sf).where("v < 60"), 0, True).select("frame", "bx", "by", "v").distinct()
    other = grid(spark, sf).select("frame", "bx", "by", F.col("v").alias("nv"))
    g = binning.neighbours(near, other, ["frame"], 1).groupBy("frame", "bx", "by").agg(F.count("*").alias("k"), F.max(F.abs(F.col("v") - F.col("nv"))).alias("d"))
    return g.where("k >= 8 AND d <= 14").select("frame", "bx", "by")


@query("residual_labels", f"{PTS}, c AS (SELECT frame, CAST(floor(x / 5) AS BIGINT) AS bx, min(y) AS low FROM pts GROUP BY ALL) SELECT p.frame, c.bx, count(*) FILTER (WHERE y - low BETWEEN 0 AND 5) AS ground, count(*) AS n FROM pts p JOIN c ON p.frame = c.frame AND CAST(floor(p.x / 5) AS BIGINT) = c.bx GROUP BY ALL")
def residual_labels(spark, sf):
    p = points(spark, sf).withColumn("bx", F.floor(F.col("x") / 5))
    low = p.groupBy("frame", "bx").agg(F.min("y").alias("low"))
    return p.join(low, ["frame", "bx"]).groupBy("frame", "bx").agg(F.count(F.when((F.col("y") - F.col("low")).between(0, 5), 1)).alias("ground"), F.count("*").alias("n"))


@query("seed_height", f"{PTS} SELECT frame, round(coalesce(median(y) FILTER (WHERE x < 2 AND z < 0.01), median(y) FILTER (WHERE x < 5), median(y)), 6) AS seed FROM pts GROUP BY frame")
def seed_height(spark, sf):
    y, x = F.col("y"), F.col("x")
    return points(spark, sf).groupBy("frame").agg(rnd(F.coalesce(F.median(F.when((x < 2) & (F.col("z") < 0.01), y)), F.median(F.when(x < 5, y)), F.median(y)), 6).alias("seed"))


@query("component_support", f"{IDS.replace('WITH', 'WITH RECURSIVE', 1)}, {_CC.format(x=' AND abs(a.v - b.v) <= 2')}, l AS (SELECT id, min(label) AS label FROM r GROUP BY id) SELECT label, count(*) AS cells, sum(n)::BIGINT AS points FROM l JOIN i USING (id) GROUP BY label HAVING count(*) >= 2 AND sum(n) >= 4 AND max(bx) - min(bx) >= 1")
def component_support(spark, sf):
    m = graph.cut(marked(spark, sf), "cells")
    labels = graph.frame_components(m, "frame", "v", 2.0)
    g = labels.join(m, "id").groupBy("label").agg(F.count("*").alias("cells"), F.sum("n").alias("points"), (F.max("bx") - F.min("bx")).alias("reach"))
    return g.where("cells >= 2 AND points >= 4 AND reach >= 1").drop("reach")


_PAIRS = f"{COMP}, p AS (SELECT a.cls, a.weight * b.weight AS w, a.sxx + b.sxx AS xx, a.sxy + b.sxy AS xy, a.syy + b.syy AS yy, a.mx - b.mx AS dx, a.my - b.my AS dy FROM c a JOIN c b ON a.cls = b.cls AND a.frame < 50 AND b.frame >= 50), d AS (SELECT *, xx*yy - xy*xy AS det FROM p), k AS (SELECT *, w * exp(-0.5 * (yy*dx*dx - 2*xy*dx*dy + xx*dy*dy) / det) / (2 * pi() * sqrt(det)) AS k FROM d)"


@query("overlap_gradient", f"{_PAIRS} SELECT cls, round(sum(k * (yy*dx - xy*dy) / det), 5) AS gx, round(sum(k * (xx*dy - xy*dx) / det), 5) AS gy, round(sum(k * yy / det), 5) AS hxx, round(sum(-k * xy / det), 5) AS hxy, round(sum(k * xx / det), 5) AS hyy FROM k GROUP BY cls")
def overlap_gradient(spark, sf):
    c = comps(spark, sf)
    cols = [F.col("mx").alias("x"), F.col("my").alias("y"), "sxx", "sxy", "syy", "weight"]
    a, b = c.where("frame < 50"), c.where("frame >= 50")
    p = spatial.radius_pairs(a.select("cls", *cols), b.select("cls", *cols), ["cls"], spatial.full_reach(a, b))
    xx, xy, yy = (F.col(s) + F.col(f"r_{s}") for s in ("sxx", "sxy", "syy"))
    p = p.select("cls", (F.col("x") - F.col("r_x")).alias("dx"), (F.col("y") - F.col("r_y")).alias("dy"), xx.alias("xx"), xy.alias("xy"), yy.alias("yy"), (xx * yy - xy * xy).alias("det"), (F.col("weight") * F.col("r_weight")).alias("w"))
    p = p.withColumn("k", F.col("w") * F.expr("exp(-0.5 * (yy*dx*dx - 2*xy*dx*dy + xx*dy*dy) / det)") / (2 * math.pi * F.sqrt("det")))
    sums = {"gx": "k * (yy*dx - xy*dy) / det", "gy": "k * (xx*dy - xy*dx) / det", "hxx": "k * yy / det", "hxy": "-k * xy / det", "hyy": "k * xx / det"}
    return p.groupBy("cls").agg(*(rnd(F.sum(F.expr(e)), 5).alias(n) for n, e in sums.items()))


_SELF = "SELECT a.cls, sum(a.weight * b.weight * exp(-0.5 * ((a.syy+b.syy)*(a.mx-b.mx)**2 - 2*(a.sxy+b.sxy)*(a.mx-b.mx)*(a.my-b.my) + (a.sxx+b.sxx)*(a.my-b.my)**2) / ((a.sxx+b.sxx)*(a.syy+b.syy) - (a.sxy+b.sxy)**2)) / (2 * pi() * sqrt((a.sxx+b.sxx)*(a.syy+b.syy) - (a.sxy+b.sxy)**2))) AS o FROM c a JOIN c b ON a.cls = b.cls WHERE {x} GROUP BY a.cls"


@query("class_similarity", f"{COMP}, f AS ({_SELF.format(x='a.frame < 50 AND b.frame < 50')}), m AS ({_SELF.format(x='a.frame >= 50 AND b.frame >= 50')}), x AS ({_SELF.format(x='a.frame < 50 AND b.frame >= 50')}) SELECT cls, round(x.o / sqrt(f.o * m.o), 6) AS similarity FROM f JOIN m USING (cls) JOIN x USING (cls)")
def class_similarity(spark, sf):
    c = comps(spark, sf)
    a, b = c.where("frame < 50"), c.where("frame >= 50")
    o = {n: spatial.kernel_overlap(p, q, "cls").select("cls", F.col("overlap").alias(n)) for n, p, q in (("f", a, a), ("m", b, b), ("x", a, b))}
    return o["f"].join(o["m"], "cls").join(o["x"], "cls").select("cls", rnd(F.col("x") / F.sqrt(F.col("f") * F.col("m")), 6).alias("similarity"))


@query("scatter_replacement", f"{COMP}, a AS (SELECT *, 0.5 * atan2(2*sxy, sxx - syy) AS t FROM c) SELECT cls, frame, round(0.5 * cos(t)**2 + 0.2 * sin(t)**2, 6) AS rxx, round((0.5 - 0.2) * sin(t) * cos(t), 6) AS rxy, round(0.5 * sin(t)**2 + 0.2 * cos(t)**2, 6) AS ryy FROM a")
def scatter_replacement(spark, sf):
    """Own scatter along and across each component's axis, its direction kept."""
    t, _ = scalar.principal_axis(F.col("sxx"), F.col("sxy"), F.col("syy"))
    c, s = F.cos(t), F.sin(t)
    return comps(spark, sf).select("cls", "frame", rnd(0.5 * c * c + 0.2 * s * s, 6).alias("rxx"), rnd(0.3 * s * c, 6).alias("rxy"), rnd(0.5 * s * s + 0.2 * c * c, 6).alias("ryy"))


@query("gain_blend", f"{EV}, w AS (SELECT event_id, least(greatest((value - 5) / 40, 0), 1) AS u, least(greatest(value / 200, 0), 1) AS v FROM ev) SELECT event_id, round((1 - u) * 0.2 + u * (1 - v) * 0.5 + u * v * 0.9, 6) AS gain FROM w")
def gain_blend(spark, sf):
    """Three vertex gains by barycentric weights."""
    u, v = scalar.clamp01((F.col("value") - 5) / 40), scalar.clamp01(F.col("value") / 200)
    return stream(spark, sf).select("event_id", rnd((1 - u) * 0.2 + u * (1 - v) * 0.5 + u * v * 0.9, 6).alias("gain"))


@query("lever_arm", f"{EV}, d AS (SELECT event_id, value / 10 AS a, value / 100 AS r, coalesce((value - lag(value) OVER w) / (t - lag(t) OVER w), 0) AS dr FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)) SELECT event_id, round(a - r * r * 1.2 - dr * 0.4, 6) AS ax, round(dr * 1.2 - r * r * 0.4, 6) AS ay FROM d")
def lever_arm(spark, sf):
    """Planar acceleration carried over a lever arm (1.2, 0.4)."""
    w = Window.partitionBy("user_id").orderBy("us")
    s = stream(spark, sf).withColumn("dr", F.coalesce((F.col("value") - F.lag("value").over(w)) / (F.col("t") - F.lag("t").over(w)), F.lit(0.0)))
    a, rate = F.col("value") / 10, F.col("value") / 100
    return s.select("event_id", rnd(a - rate * rate * 1.2 - F.col("dr") * 0.4, 6).alias("ax"), rnd(F.col("dr") * 1.2 - rate * rate * 0.4, 6).alias("ay"))


@query("deskew", f"{EV}, q AS (SELECT event_id, user_id, t, value FROM ev WHERE event_type = 'view'), p AS (SELECT user_id, t, value / 50 AS yaw, t / 1e5 AS px FROM ev WHERE event_type <> 'view'), a AS (SELECT q.*, p.t AS t0, p.yaw AS y0, p.px AS x0 FROM q ASOF JOIN p ON q.user_id = p.user_id AND q.t >= p.t), b AS (SELECT a.*, p.t AS t1, p.yaw AS y1, p.px AS x1 FROM a ASOF JOIN p ON a.user_id = p.user_id AND a.t <= p.t), w AS (SELECT *, CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0 END AS w FROM b), i AS (SELECT *, y0 + w * atan2(sin(y1 - y0), cos(y1 - y0)) AS yaw, (1 - w) * x0 + w * x1 AS px FROM w) SELECT event_id, round(cos(yaw) * value - sin(yaw) * 2 + px, 5) AS gx, round(sin(yaw) * value + cos(yaw) * 2, 5) AS gy FROM i")
def deskew(spark, sf):
    """Points (value, 2) at their own times into the frame of the interpolated pose; no pose beyond the first and last."""
    s = stream(spark, sf)
    q = s.where("event_type = 'view'").select("event_id", "user_id", "t", F.col("value").alias("x"))
    p = s.where("event_type <> 'view'").select("user_id", "t", (F.col("value") / 50).alias("yaw"), (F.col("t") / 1e5).alias("px"))
    j = asof.interpolated(q, p, ["user_id"], "t", ["yaw", "px"], float("inf"), ("yaw",)).where("ok")
    return j.select("event_id", rnd(F.cos("yaw") * F.col("x") - F.sin("yaw") * 2 + F.col("px"), 5).alias("gx"), rnd(F.sin("yaw") * F.col("x") + F.cos("yaw") * 2, 5).alias("gy"))


@query("shared_hypotheses", "WITH h AS (SELECT DISTINCT l_partkey AS h, l_suppkey AS owner FROM lineitem WHERE l_quantity >= 30) SELECT a.owner AS first_owner, b.owner AS second_owner, count(*) AS shared FROM h a JOIN h b ON a.h = b.h AND a.owner < b.owner GROUP BY ALL HAVING count(*) >= 12")
def shared_hypotheses(spark, sf):
    h = table(spark, sf, "lineitem").where("l_quantity >= 30").select(F.col("l_partkey").alias("h"), F.col("l_suppkey").alias("owner")).distinct()
    a, b = h.withColumnRenamed("owner", "first_owner"), h.withColumnRenamed("owner", "second_owner")
    return a.join(b, "h").where("first_owner < second_owner").groupBy("first_owner", "second_owner").agg(F.count("*").alias("shared")).where("shared >= 12")


@query("first_best_eps")
def first_best_eps(spark, sf):
    """The first value of each key that none later beats by more than eps, by a fold over the ordered rows."""
    rows = F.array_sort(F.collect_list(F.struct("us", "event_id", "value")))
    g = stream(spark, sf).groupBy("user_id").agg(rows.alias("r"))
    start = F.struct(F.lit(-1).cast("bigint").alias("event_id"), F.lit(float("-inf")).alias("value"))
    best = F.aggregate("r", start, lambda a, x: F.when(x["value"] > a["value"] + 1.0, F.struct(x["event_id"].alias("event_id"), x["value"].alias("value"))).otherwise(a))
    return g.select("user_id", best.alias("b")).select("user_id", "b.event_id", "b.value")


@query("rigid_alignment")
def rigid_alignment(spark, sf):
    from plinth.operators.align import rigid_alignment as align

    p = points(spark, sf).select(F.col("x"), F.col("y"), F.col("z"), (F.cos(F.lit(0.3)) * F.col("x") - F.sin(F.lit(0.3)) * F.col("y") + 5).alias("u"), (F.sin(F.lit(0.3)) * F.col("x") + F.cos(F.lit(0.3)) * F.col("y") - 2).alias("v"), F.col("z").alias("w"))
    rot, shift = align(p, ["x", "y", "z"], ["u", "v", "w"])
    return spark.createDataFrame([(i, *map(float, rot[i]), float(shift[i])) for i in range(3)], "row int, r0 double, r1 double, r2 double, shift double")
