"""Queries of shafts, footprints, boundary places, curb masks and callbacks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from plinth.operators import graph, raster, structures, trees
from plinth.plans.catalog import EV, PTS, points, query, rnd, stream
from plinth.plans.detectors import _CURB, CURB
from plinth.plans.space import _CC, GRID, IDS, grid, marked

_C = f"{PTS}, p AS (SELECT frame, CAST(floor(x / 5) AS BIGINT) * 100 + CAST(floor(y / 10) AS BIGINT) AS cell, x, y, z FROM pts)"


def cells(spark, sf):
    p = points(spark, sf)
    return p.select("frame", (F.floor(F.col("x") / 5) * 100 + F.floor(F.col("y") / 10)).alias("cell"), "x", "y", "z")


@query("batched_fits", f"{_C}, g AS (SELECT frame, cell, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM p GROUP BY ALL), e AS (SELECT *, (xx + yy) / 2 + sqrt(((xx - yy) / 2)**2 + xy*xy) AS hi, (xx + yy) / 2 - sqrt(((xx - yy) / 2)**2 + xy*xy) AS lo FROM g), f AS (SELECT *, hi > 0 AND lo / hi >= 0.05 AS ok, (xz*yy - yz*xy) / (xx*yy - xy*xy) AS b, (yz*xx - xz*xy) / (xx*yy - xy*xy) AS c FROM e) SELECT frame, cell, n, ok AS accepted, round(CASE WHEN ok THEN b ELSE -9 END, 6) AS b, round(CASE WHEN ok THEN c ELSE -9 END, 6) AS c FROM f")
def batched_fits(spark, sf):
    f = structures.batched_fits(cells(spark, sf), ["frame", "cell"], "x", "y", "z", 0.05)
    return f.select("frame", "cell", "n", "accepted", *(rnd(F.coalesce(c, F.lit(-9.0)), 6).alias(c) for c in ("b", "c")))


_HYPO = f"{_C}, q AS (SELECT DISTINCT frame, cell, x, y FROM p), s AS (SELECT q.frame, q.cell, q.x, q.y, count(*) AS support, max(p.z) - min(p.z) AS height FROM q JOIN p ON q.frame = p.frame AND (q.x - p.x)**2 + (q.y - p.y)**2 <= 6.25 GROUP BY ALL HAVING count(*) >= 3), b AS (SELECT *, row_number() OVER (PARTITION BY frame, cell ORDER BY support DESC, height DESC, x, y) AS i FROM s), h AS (SELECT frame, cell, x, y, support, height FROM b WHERE i = 1)"


def hypotheses(spark, sf):
    return structures.best_hypotheses(cells(spark, sf), ["frame"], "cell", 2.5, 3)


@query("shaft_hypotheses", f"{_HYPO} SELECT frame, cell, x, y, support, round(height, 6) AS height FROM h")
def shaft_hypotheses(spark, sf):
    """Of each cell the best supported place among its points."""
    return hypotheses(spark, sf).select("frame", "cell", "x", "y", "support", rnd("height", 6).alias("height"))


_PROBES = f"{_HYPO}, j AS (SELECT h.frame, h.cell, p.z, (h.x - p.x)**2 + (h.y - p.y)**2 AS d2, min(p.z) OVER (PARTITION BY h.frame, h.cell) AS a, max(p.z) OVER (PARTITION BY h.frame, h.cell) AS b FROM h JOIN p ON h.frame = p.frame AND (h.x - p.x)**2 + (h.y - p.y)**2 <= 16), k AS (SELECT *, least(3, floor(4 * (z - a) / greatest(b - a, 1e-9))) AS q FROM j), f AS (SELECT frame, cell, count(*) FILTER (WHERE d2 <= 1) AS within0, count(*) FILTER (WHERE d2 <= 6.25) AS within1, count(*) AS within2, avg(sqrt(d2)) AS spread, max(b - a) AS height, least(count(*) FILTER (WHERE q = 0), count(*) FILTER (WHERE q = 1), count(*) FILTER (WHERE q = 2), count(*) FILTER (WHERE q = 3)) AS least_quarter FROM k GROUP BY ALL)"


def probes(spark, sf):
    return structures.shaft_features(points(spark, sf), hypotheses(spark, sf), ["frame"], "cell", [1.0, 2.5, 4.0])


@query("shaft_features", f"{_PROBES} SELECT frame, cell, within0, within1, within2, round(spread, 6) AS spread, round(height, 6) AS height, least_quarter FROM f")
def shaft_features(spark, sf):
    f = probes(spark, sf)
    return f.select("frame", "cell", "within0", "within1", "within2", rnd("spread", 6).alias("spread"), rnd("height", 6).alias("height"), "least_quarter")


@query("shaft_support", f"{_PROBES} SELECT frame, cell FROM f WHERE height >= 0.06 AND least_quarter >= 1 AND within1 >= 4")
def shaft_support(spark, sf):
    """Shafts whose support is tall, whole and dense enough."""
    return probes(spark, sf).where("height >= 0.06 AND least_quarter >= 1 AND within1 >= 4").select("frame", "cell")


#: Two trees over the probes.
CONTEXT = {"kind": "boosted", "bias": -0.4, "roots": [0, 3], "left": [1, 0, 0, 4, 0, 0], "right": [2, 0, 0, 5, 0, 0], "feature": [0, 0, 0, 1, 0, 0], "threshold": [4.5, 0, 0, 6.5, 0, 0], "value": [0, -0.5, 0.7, 0, 0.3, -0.2], "leaf": [0, 1, 1, 0, 1, 1]}


@query("shaft_context", f"{_PROBES}, sc AS (SELECT frame, cell, 1 / (1 + exp(0 - (CASE WHEN within1 <= 4.5 THEN -0.5 ELSE 0.7 END + CASE WHEN within2 <= 6.5 THEN 0.3 ELSE -0.2 END - 0.4))) AS score FROM f) SELECT frame, cell, round(score, 6) AS score, score >= 0.5 AS accepted FROM sc")
def shaft_context(spark, sf):
    """Learned acceptance of shafts by their probes."""
    s = probes(spark, sf).withColumn("score", trees.score_column(CONTEXT, ["within1", "within2"]))
    return s.select("frame", "cell", rnd("score", 6).alias("score"), (F.col("score") >= 0.5).alias("accepted"))


@query("shaft_points", f"{_HYPO}, o AS (SELECT * FROM h WHERE support >= 6), a AS (SELECT DISTINCT frame, x, y FROM pts), j AS (SELECT a.frame, a.x, a.y, o.cell, row_number() OVER (PARTITION BY a.frame, a.x, a.y ORDER BY (a.x - o.x)**2 + (a.y - o.y)**2, o.cell) AS i FROM a JOIN o ON a.frame = o.frame AND (a.x - o.x)**2 + (a.y - o.y)**2 <= 4) SELECT frame, x, y, cell FROM j WHERE i = 1")
def shaft_points(spark, sf):
    """Points within reach of a strong shaft's axis, each with its nearest."""
    a = points(spark, sf).select("frame", "x", "y").distinct().withColumn("pid", F.concat_ws(":", "x", "y"))
    n = structures.near_axis(a, hypotheses(spark, sf).where("support >= 6"), ["frame"], "cell", "pid", 2.0)
    return a.join(n, ["frame", "pid"]).select("frame", "x", "y", "cell")


@query("split_shafts", f"{_HYPO.replace('WITH', 'WITH RECURSIVE', 1)}, sh AS (SELECT frame * 10000 + h.cell AS id, frame, h.x, h.y, min(p.z) AS low, max(p.z) AS high FROM h JOIN p USING (frame, cell) WHERE support >= 5 GROUP BY ALL), e AS (SELECT a.id AS a, b.id AS b FROM sh a JOIN sh b ON a.frame = b.frame AND a.id <> b.id AND (a.x - b.x)**2 + (a.y - b.y)**2 <= 9 AND greatest(a.low, b.low) - least(a.high, b.high) <= 0.02), r(id, label) AS (SELECT id, id FROM sh UNION SELECT e.b, r.label FROM r JOIN e ON r.id = e.a WHERE r.label < e.b) SELECT id, min(label) AS label FROM r GROUP BY id")
def split_shafts(spark, sf):
    """Shafts over one another as one."""
    h = hypotheses(spark, sf).where("support >= 5")
    low = cells(spark, sf).groupBy("frame", "cell").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    s = graph.cut(h.join(low, ["frame", "cell"]).select("frame", (F.col("frame") * 10000 + F.col("cell")).alias("id"), "x", "y", "low", "high"), "hypotheses")
    return structures.joined_shafts(s, ["frame"], 3.0, 0.02)


@query("pillar_footprints", f"{GRID}, j AS (SELECT a.frame, a.bx, a.by, a.n AS v, b.bx - a.bx AS dx, b.by - a.by AS dy, b.n AS o, sum(b.n) OVER w AS s, count(*) OVER w AS k FROM g a JOIN g b ON a.frame = b.frame AND abs(a.bx - b.bx) <= 1 AND abs(a.by - b.by) <= 1 AND (a.bx <> b.bx OR a.by <> b.by) WINDOW w AS (PARTITION BY a.frame, a.bx, a.by)), h AS (SELECT DISTINCT frame, bx, by, 0 AS dx, 0 AS dy, round(v - s / k::DOUBLE, 9) AS c FROM j UNION ALL SELECT frame, bx, by, dx, dy, round((v + o) / 2.0::DOUBLE - (s - o) / (k - 1)::DOUBLE, 9) FROM j WHERE k > 1), r AS (SELECT *, row_number() OVER (PARTITION BY frame, bx, by ORDER BY c DESC, dx, dy) AS i FROM h) SELECT frame, bx, by, dx::INT AS dx, dy::INT AS dy, round(c, 6) AS contrast FROM r WHERE i = 1 AND c >= 2")
def pillar_footprints(spark, sf):
    """One or two cells against their surroundings."""
    f = structures.footprints(grid(spark, sf), ["frame"], "n", 2.0)
    return f.select("frame", "bx", "by", F.col("dx").cast("int"), F.col("dy").cast("int"), rnd("contrast", 6).alias("contrast"))


_MASKED = f"{_CURB}, ro AS (SELECT frame, bx, by FROM f WHERE step < 0.06), cu AS (SELECT frame, bx, by, CASE WHEN ok THEN 0.3*e1 + 0.2*e2 + 0.1*e3 + 0.1*e4 + 0.2*e5 + 0.1*e6 ELSE 0 END AS energy FROM f), ad AS (SELECT DISTINCT c.frame, c.bx, c.by FROM cu c JOIN ro r ON c.frame = r.frame AND abs(c.bx - r.bx) <= 1 AND abs(c.by - r.by) <= 1 AND (c.bx <> r.bx OR c.by <> r.by) WHERE round(energy, 7) >= 0.35)"


def curb_cells(spark, sf):
    p = points(spark, sf).groupBy("frame", F.floor(F.col("x") / 5).alias("bx"), F.floor(F.col("y") / 10).alias("by"))
    c = p.agg(F.count("*").alias("n"), (F.avg("y") / 100).alias("height"), (F.stddev_pop("y") / 100).alias("roughness"), ((F.max("y") - F.min("y")) / 100).alias("relief"))
    e = graph.cut(raster.curb_energy(c, ["frame"], (5.0, 10.0), CURB), "energy")
    return structures.beside_mask(e.where(rnd("energy", 7) >= 0.35), e.where("step < 0.06"), ["frame"], 1)


@query("curb_classification", f"{_MASKED} SELECT ad.* FROM ad ANTI JOIN ro USING (frame, bx, by)")
def curb_classification(spark, sf):
    """Cells of high energy beside the road, and not on it."""
    return curb_cells(spark, sf).select("frame", "bx", "by")


@query("curb_refinement", f"{_MASKED.replace('WITH', 'WITH RECURSIVE', 1)}, i AS (SELECT ad.*, frame * 1000000 + bx * 1000 + by AS id FROM ad ANTI JOIN ro USING (frame, bx, by)), {_CC.format(x='').replace('e AS (', 'eg AS (', 1).replace('JOIN e ON r.id = e.a', 'JOIN eg e ON r.id = e.a')}, l2 AS (SELECT id, min(label) AS label FROM r GROUP BY id) SELECT frame, bx, by, label FROM i JOIN l2 USING (id) WHERE label IN (SELECT label FROM l2 GROUP BY label HAVING count(*) >= 2)")
def curb_refinement(spark, sf):
    """Energy, road adjacency, then connected cells of enough size."""
    c = curb_cells(spark, sf).select("frame", "bx", "by").withColumn("id", F.col("frame") * 1000000 + F.col("bx") * 1000 + F.col("by"))
    labels = graph.frame_components(c, "frame")
    large = labels.groupBy("label").agg(F.count("*").alias("n")).where("n >= 2")
    return c.join(labels.join(large, "label", "left_semi"), "id").select("frame", "bx", "by", "label")


@query("dominant_boundary", f"{PTS}, m AS (SELECT frame, cls, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), covar_pop(x, x) - covar_pop(y, y)) AS t FROM pts GROUP BY ALL) SELECT frame, cls, count(*) AS n, count(*) FILTER (WHERE abs((y - my) * cos(t) - (x - mx) * sin(t)) <= 6) AS kept, round(max(CASE WHEN abs((y - my) * cos(t) - (x - mx) * sin(t)) <= 6 THEN (x - mx) * cos(t) + (y - my) * sin(t) END) - min(CASE WHEN abs((y - my) * cos(t) - (x - mx) * sin(t)) <= 6 THEN (x - mx) * cos(t) + (y - my) * sin(t) END), 5) AS length FROM pts JOIN m USING (frame, cls) GROUP BY frame, cls")
def dominant_boundary(spark, sf):
    """The narrow band about each group's principal line, and its length."""
    b = structures.dominant_band(points(spark, sf), ["frame", "cls"], 6.0)
    held = F.when(F.col("in_band"), F.col("along"))
    return b.groupBy("frame", "cls").agg(F.count("*").alias("n"), F.count(held).alias("kept"), rnd(F.max(held) - F.min(held), 5).alias("length"))


@query("boundary_places", f"{PTS}, o AS (SELECT frame, cls, x, lead(x) OVER w AS nx, count(*) OVER r AS k, sum(z * 100) OVER r AS s, count(*) OVER g AS n, sum(z * 100) OVER g AS t, var_pop(z * 100) OVER g * count(*) OVER g AS v FROM pts WINDOW w AS (PARTITION BY frame, cls ORDER BY x, z), r AS (PARTITION BY frame, cls ORDER BY x, z ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY frame, cls)), c AS (SELECT frame, cls, (x + nx) / 2 AS p, (t - s) / (n - k) - s / k AS h, v, round(k * (n - k) / n::DOUBLE * ((t - s) / (n - k) - s / k)**2, 9) AS g FROM o WHERE k < n AND nx > x), b AS (SELECT *, row_number() OVER (PARTITION BY frame, cls ORDER BY g DESC, p) AS i FROM c) SELECT frame, cls, p AS place, round(h, 5) AS step, round(CASE WHEN v > 0 THEN g / v ELSE 0 END, 6) AS share FROM b WHERE i = 1")
def boundary_places(spark, sf):
    """Where a step best splits each group, as the place of its boundary."""
    p = points(spark, sf).withColumn("h", F.col("z") * 100)
    s = structures.step_places(p, ["frame", "cls"], "x", "h", 0.05)
    return s.select("frame", "cls", "place", rnd("step", 5).alias("step"), rnd("share", 6).alias("share"))


@query("recovered_proposals", f"{IDS.replace('WITH', 'WITH RECURSIVE', 1)}, {_CC.format(x='')}, l AS (SELECT id, min(label) AS label FROM r GROUP BY id), c AS (SELECT label, count(*) AS cells, max(n) AS strongest, max(bx) - min(bx) + 1 AS wide, max(by) - min(by) + 1 AS long FROM l JOIN i USING (id) GROUP BY label) SELECT label, cells FROM c WHERE strongest >= 4 OR (cells >= 4 AND greatest(wide, long) >= 4 AND cells <= 1.5 * greatest(wide, long))")
def recovered_proposals(spark, sf):
    """Parts with strong evidence, or slender ones of enough length."""
    m = marked(spark, sf)
    c = graph.frame_components(m, "frame").join(m, "id").groupBy("label").agg(F.count("*").alias("cells"), F.max("n").alias("strongest"), F.greatest(F.max("bx") - F.min("bx") + 1, F.max("by") - F.min("by") + 1).alias("reach"))
    return c.where("strongest >= 4 OR (cells >= 4 AND reach >= 4 AND cells <= 1.5 * reach)").select("label", "cells")


_LAYERS = f"{PTS}, l AS (SELECT frame, CAST(floor(x / 5) AS BIGINT) AS bx, CAST(floor(y / 10) AS BIGINT) AS by, CAST(floor(z / 0.02) AS BIGINT) AS layer, count(*) AS n FROM pts GROUP BY ALL), r AS (SELECT *, layer - row_number() OVER (PARTITION BY frame, bx, by ORDER BY layer) AS run FROM l), u AS (SELECT frame, bx, by, run, count(*) AS layers, sum(n) AS n FROM r GROUP BY ALL), c AS (SELECT frame, bx, by, sum(layers) AS layers, max(layers) AS longest, sum(n) AS n FROM u GROUP BY ALL)"


@query("pole_candidates", f"{_LAYERS}, k AS (SELECT * FROM c WHERE longest >= 4), s AS (SELECT a.frame, a.bx, a.by, sum(b.layers) AS around FROM c a JOIN c b ON a.frame = b.frame AND abs(a.bx - b.bx) <= 1 AND abs(a.by - b.by) <= 1 GROUP BY ALL) SELECT c.frame, c.bx, c.by, longest >= 4 AS core, layers::BIGINT AS layers FROM c JOIN s USING (frame, bx, by) WHERE longest >= 4 OR (layers >= 4 AND around >= 30)")
def pole_candidates(spark, sf):
    """Cells with a long run of layers, and split ones whose layers and surroundings make up for it."""
    p = points(spark, sf).groupBy("frame", F.floor(F.col("x") / 5).alias("bx"), F.floor(F.col("y") / 10).alias("by"), F.floor(F.col("z") / 0.02).alias("layer")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    run = F.col("layer") - F.row_number().over(Window.partitionBy("frame", "bx", "by").orderBy("layer"))
    u = p.withColumn("run", run).groupBy("frame", "bx", "by", "run").agg(F.count("*").alias("layers"))
    c = u.groupBy("frame", "bx", "by").agg(F.max("layers").alias("longest"), F.sum("layers").alias("layers"))
    j = c.join(raster.box_sums(c, ["frame"], {"around": F.col("layers")}, 1), ["frame", "bx", "by"])
    return j.where("longest >= 4 OR (layers >= 4 AND around >= 30)").select("frame", "bx", "by", (F.col("longest") >= 4).alias("core"), "layers")


@query("grouped_function", f"{PTS}, m AS (SELECT frame, y, median(y) OVER (PARTITION BY frame) AS mid FROM pts) SELECT frame, round(median(abs(y - mid)), 6) AS deviation FROM m GROUP BY frame")
def grouped_function(spark, sf):
    """A function that is no built-in, over groups."""
    g = structures.grouped(points(spark, sf), ["frame"], "y", lambda v: (v - v.median()).abs().median(), "deviation")
    return g.select("frame", rnd("deviation", 6).alias("deviation"))


@query("frame_callback", f"{PTS} SELECT frame, count(*) AS rows, round(max(x) - min(x), 6) AS width FROM pts GROUP BY frame")
def frame_callback(spark, sf):
    """A consumer that sees each frame once."""

    def seen(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(g["frame"].iloc[0], len(g), round(float(g["x"].max() - g["x"].min()), 6))], columns=["frame", "rows", "width"])

    return structures.per_frame(points(spark, sf).select("frame", "x"), "frame", seen, "frame long, rows long, width double")


@query("kernel_dispatch", f"{PTS} SELECT frame, count(y) AS count, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS spread, round(median(y), 6) AS median FROM pts GROUP BY frame")
def kernel_dispatch(spark, sf):
    d = structures.dispatched(points(spark, sf), ["frame"], "y", ["count", "mean", "spread", "median"])
    return d.select("frame", "count", *(rnd(c, 6).alias(c) for c in ("mean", "spread", "median")))


@query("synthetic_sensor")
def synthetic_sensor(spark, sf):
    s = stream(spark, sf).select("user_id", "event_id", "us", F.col("value").alias("truth"))
    return structures.synthetic_walk(s, ["user_id"], ["us", "event_id"], 7, 0.05, 0.2, 0.01)
