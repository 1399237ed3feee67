"""Queries of lattice measures, pole and facade detectors, and what they share."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F


from plinth.operators import moments, raster, rules, shafts, spatial
from plinth.plans.catalog import PTS, points, query, rnd
from plinth.plans.space import GRID, IDS, grid, marked

M3 = f"{PTS}, g AS (SELECT frame, CAST(floor(x / 5) AS BIGINT) AS bx, CAST(floor(y / 10) AS BIGINT) AS by, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS sxx, covar_pop(x, y) AS sxy, covar_pop(x, z) AS sxz, covar_pop(y, y) AS syy, covar_pop(y, z) AS syz, covar_pop(z, z) AS szz FROM pts GROUP BY ALL)"


def cells3(spark, sf):
    p = points(spark, sf).withColumns({"bx": F.floor(F.col("x") / 5), "by": F.floor(F.col("y") / 10)})
    return moments.cell_moments(p, ["frame", "bx", "by"])


def near(r):
    return f"JOIN g b ON a.frame = b.frame AND abs(a.bx - b.bx) <= {r} AND abs(a.by - b.by) <= {r}"


@query("crop_margins", f"{GRID} SELECT frame, bx - min(bx) OVER (PARTITION BY frame) + 1 AS rx, by - min(by) OVER (PARTITION BY frame) + 1 AS ry, n FROM g")
def crop_margins(spark, sf):
    return raster.cropped(grid(spark, sf), ["frame"]).select("frame", "rx", "ry", "n")


@query("lattice_mapping", f"{GRID}, c AS (SELECT frame, CAST(floor(((bx + 0.5) * 5 + 1) / 4) AS BIGINT) + 1 AS i, CAST(floor(((by + 0.5) * 10 + 2) / 6) AS BIGINT) + 1 AS j FROM g WHERE n >= 7) SELECT DISTINCT frame, (i - 1) * 16 + j AS cell FROM c WHERE i BETWEEN 1 AND 12 AND j BETWEEN 1 AND 16")
def lattice_mapping(spark, sf):
    """Candidate cells of one lattice as cells of the lattice that is published."""
    return raster.mapped_cells(grid(spark, sf).where("n >= 7"), ["frame"], (5.0, 10.0), (-1.0, -2.0), (4.0, 6.0), (12, 16))


@query("pole_distribution", f"{M3}, w AS (SELECT a.frame, a.bx, a.by, sum(b.n) AS t, sum(b.n*b.mx)/sum(b.n) AS x, sum(b.n*b.my)/sum(b.n) AS y, sum(b.n*b.mz)/sum(b.n) AS z, sum(b.n*(b.sxx+b.mx*b.mx))/sum(b.n) AS xx, sum(b.n*(b.syy+b.my*b.my))/sum(b.n) AS yy, sum(b.n*(b.szz+b.mz*b.mz))/sum(b.n) AS zz, sum(b.n*(b.sxz+b.mx*b.mz))/sum(b.n) AS xz, sum(b.n*(b.syz+b.my*b.mz))/sum(b.n) AS yz FROM g a {near(1)} GROUP BY ALL), v AS (SELECT *, greatest(zz - z*z, 0) AS vz FROM w) SELECT frame, bx, by, round(vz / greatest(xx - x*x + yy - y*y + vz, 1e-15), 8) AS vertical, round(greatest(xx - x*x + yy - y*y - ((xz - x*z)**2 + (yz - y*z)**2) / greatest(vz, 1e-15), 0), 4) AS radial FROM v")
def pole_distribution(spark, sf):
    g = raster.pooled_spread(cells3(spark, sf), ["frame"], 1)
    return g.select("frame", "bx", "by", rnd("vertical", 8).alias("vertical"), rnd("radial", 4).alias("radial"))


@query("nearest_filled_cell", f"{GRID}, k AS (SELECT * FROM g WHERE n >= 8), j AS (SELECT a.frame, a.bx, a.by, k.v, row_number() OVER (PARTITION BY a.frame, a.bx, a.by ORDER BY (a.bx - k.bx)**2 + (a.by - k.by)**2, k.bx, k.by) AS i, (a.bx - k.bx)**2 + (a.by - k.by)**2 AS d2 FROM g a JOIN k ON a.frame = k.frame AND (a.bx - k.bx)**2 + (a.by - k.by)**2 <= 9) SELECT g.frame, g.bx, g.by, round(coalesce(j.v, -1), 6) AS height, coalesce(j.d2, -1)::BIGINT AS d2 FROM g LEFT JOIN j ON g.frame = j.frame AND g.bx = j.bx AND g.by = j.by AND j.i = 1")
def nearest_filled_cell(spark, sf):
    g = grid(spark, sf)
    f = raster.nearest_filled(g, g.where("n >= 8"), ["frame"], "v", 3)
    return f.select("frame", "bx", "by", rnd(F.coalesce("v", F.lit(-1.0)), 6).alias("height"), F.coalesce(F.col("d2").cast("long"), F.lit(-1)).alias("d2"))


CURB = {"least_points": 2, "least_neighbours": 3, "mean_reach": 2, "low_reach": 2, "step_band": (0.02, 0.4), "step": (0.15, 0.1), "slope": (0.01, 0.01), "bend": (0.005, 0.004), "roughness": (0.028, 0.004), "rise": (0.02, 0.2), "relief": (0.05, 0.1),
        "weights": {"step_energy": 0.3, "slope_energy": 0.2, "bend_energy": 0.1, "rough_energy": 0.1, "rise_energy": 0.2, "relief_energy": 0.1}}
_SMOOTH = lambda v, a, b: f"(least(greatest(({v} - {a}) / ({b} - {a}), 0), 1)**2 * (3 - 2 * least(greatest(({v} - {a}) / ({b} - {a}), 0), 1)))"
_SCORE = lambda v, t, s: f"exp(0 - (({v}) - {t})**2 / (2 * {s} * {s}))"
_SIDES = ", ".join(f"max(CASE WHEN b.bx - a.bx = {i} AND b.by - a.by = {j} THEN b.d END) AS s{i + 1}{j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)
_CURB = f"""{PTS}, c AS (SELECT frame, CAST(floor(x / 5) AS BIGINT) AS bx, CAST(floor(y / 10) AS BIGINT) AS by, count(*) AS n, avg(y) / 100 AS height, stddev_pop(y) / 100 AS roughness, (max(y) - min(y)) / 100 AS relief FROM pts GROUP BY ALL), v AS (SELECT * FROM c WHERE n >= 2),
m AS (SELECT a.frame, a.bx, a.by, a.height - avg(b.height) AS d FROM v a JOIN v b ON a.frame = b.frame AND abs(a.bx - b.bx) <= 2 AND abs(a.by - b.by) <= 2 GROUP BY a.frame, a.bx, a.by, a.height),
s AS (SELECT a.frame, a.bx, a.by, count(*) AS k, max(abs(b.d - a.d)) AS step, {_SIDES} FROM m a JOIN m b ON a.frame = b.frame AND abs(a.bx - b.bx) <= 1 AND abs(a.by - b.by) <= 1 AND (a.bx <> b.bx OR a.by <> b.by) GROUP BY a.frame, a.bx, a.by),
l AS (SELECT a.frame, a.bx, a.by, min(b.height) AS low FROM v a JOIN v b ON a.frame = b.frame AND abs(a.bx - b.bx) <= 2 AND abs(a.by - b.by) <= 2 GROUP BY a.frame, a.bx, a.by),
e AS (SELECT v.frame, v.bx, v.by, coalesce(step, 0) AS step, coalesce(k, 0) >= 3 AS ok, atan(sqrt(((s21 - s01) / 10)**2 + ((s12 - s10) / 20)**2)) AS angle, abs((s21 - 2 * d + s01) / 25) + abs((s12 - 2 * d + s10) / 100) + 2 * abs((s22 - s20 - s02 + s00) / 200) AS bend, roughness, relief, CASE WHEN coalesce(k, 0) >= 3 THEN height - low ELSE 0 END AS rise FROM v JOIN m USING (frame, bx, by) JOIN l USING (frame, bx, by) LEFT JOIN s USING (frame, bx, by)),
f AS (SELECT frame, bx, by, step, ok, CASE WHEN step BETWEEN 0.02 AND 0.4 THEN {_SCORE('step', 0.15, 0.1)} ELSE 0 END AS e1, coalesce({_SCORE('angle', 0.01, 0.01)}, 0) AS e2, coalesce({_SCORE('bend', 0.005, 0.004)}, 0) AS e3, {_SCORE('roughness', 0.028, 0.004)} AS e4, {_SMOOTH('rise', 0.02, 0.2)} AS e5, {_SMOOTH('relief', 0.05, 0.1)} AS e6 FROM e)"""


@query("curb_energy", f"{_CURB} SELECT frame, bx, by, round(step, 7) AS step, round(e1, 7) AS step_energy, round(e2, 7) AS slope_energy, round(e3, 7) AS bend_energy, round(e5, 7) AS rise_energy, round(CASE WHEN ok THEN 0.3*e1 + 0.2*e2 + 0.1*e3 + 0.1*e4 + 0.2*e5 + 0.1*e6 ELSE 0 END, 7) AS energy FROM f")
def curb_energy(spark, sf):
    p = points(spark, sf).groupBy("frame", F.floor(F.col("x") / 5).alias("bx"), F.floor(F.col("y") / 10).alias("by"))
    c = p.agg(F.count("*").alias("n"), (F.avg("y") / 100).alias("height"), (F.stddev_pop("y") / 100).alias("roughness"), ((F.max("y") - F.min("y")) / 100).alias("relief"))
    e = raster.curb_energy(c, ["frame"], (5.0, 10.0), CURB)
    return e.select("frame", "bx", "by", *(rnd(n, 7).alias(n) for n in ("step", "step_energy", "slope_energy", "bend_energy", "rise_energy", "energy")))


_LINE = f"{IDS}, g AS (SELECT frame, bx, by, n AS e FROM i), q AS (SELECT a.frame, a.bx, a.by, count(*) AS seeds, sum(b.e) AS m, sum(b.e * (b.bx - a.bx)) / sum(b.e) AS mx, sum(b.e * (b.by - a.by) * 2.0) / sum(b.e) AS my, sum(b.e * (b.bx - a.bx)**2) / sum(b.e) AS xx, sum(b.e * 4.0 * (b.by - a.by)**2) / sum(b.e) AS yy, sum(b.e * 2.0 * (b.bx - a.bx) * (b.by - a.by)) / sum(b.e) AS xy FROM g a {near(2)} GROUP BY a.frame, a.bx, a.by), c AS (SELECT *, greatest(xx - mx*mx, 0) AS cxx, greatest(yy - my*my, 0) AS cyy, xy - mx*my AS cxy FROM q), l AS (SELECT *, CASE WHEN seeds >= 3 AND cxx + cyy > 0 THEN least(sqrt((cxx - cyy)**2 + 4*cxy*cxy), cxx + cyy) / (cxx + cyy) * {_SMOOTH('seeds', 3.0, 8.0)} ELSE 0 END AS line FROM c)"


@query("line_score", f"{_LINE} SELECT frame, bx, by, seeds, round(line, 6) AS line FROM l")
def line_score(spark, sf):
    s = raster.line_scores(marked(spark, sf).withColumnRenamed("n", "e"), ["frame"], "e", (1.0, 2.0), 2, (3.0, 8.0))
    return s.select("frame", "bx", "by", "seeds", rnd("line", 6).alias("line"))


@query("point_score", f"{IDS}, g AS (SELECT frame, bx, by, n AS e FROM i), x AS (SELECT frame, min(bx) AS x0, max(bx) AS x1, min(by) AS y0, max(by) AS y1 FROM g GROUP BY frame), w AS (SELECT * FROM (VALUES (0, 1, 0), (1, 0, 1), (2, 1, 1), (3, 1, -1)) t(o, i, j), (VALUES (1), (2)) u(r), (VALUES (1), (-1)) v(s)), p AS (SELECT g.frame, g.bx, g.by, g.e, o, r, least(greatest(g.bx + s*r*i, x0), x1) AS nx, least(greatest(g.by + s*r*j, y0), y1) AS ny FROM g JOIN x USING (frame), w), k AS (SELECT p.frame, p.bx, p.by, p.e, o, r, sum(coalesce(b.e, 0)) AS other FROM p LEFT JOIN g b ON p.frame = b.frame AND p.nx = b.bx AND p.ny = b.by GROUP BY ALL), d AS (SELECT frame, bx, by, o, max(greatest(2 * e - other, 0)) AS d FROM k GROUP BY ALL) SELECT frame, bx, by, round(CASE WHEN max(d) > 0 THEN min(d) / max(d) ELSE 0 END, 6) AS point FROM d GROUP BY frame, bx, by")
def point_score(spark, sf):
    return raster.point_scores(marked(spark, sf), ["frame"], "n", 2).select("frame", "bx", "by", rnd("point", 6).alias("point"))


@query("oriented_hough", f"{PTS}, a AS (SELECT frame, x, y, inten + 0.01 AS w, degrees(atan2(y - 52, x - 25)) AS o FROM pts), s AS (SELECT *, unnest(generate_series(ceil((o - 25) / 10)::BIGINT, floor((o + 25) / 10)::BIGINT)) AS t FROM a), h AS (SELECT *, ((t % 18) + 18) % 18 AS th FROM s) SELECT frame, CAST(th AS INT) AS theta_bin, CAST(floor((x * cos(th * pi() / 18) + y * sin(th * pi() / 18)) / 4 + 0.5) AS BIGINT) AS rho_bin, round(sum(w), 4) AS votes FROM h GROUP BY ALL")
def oriented_hough(spark, sf):
    o = F.degrees(F.atan2(F.col("y") - 52, F.col("x") - 25))
    v = raster.oriented_votes(points(spark, sf), ["frame"], F.col("inten") + 0.01, o, 25.0, 18, 4.0)
    return v.select("frame", "theta_bin", "rho_bin", rnd("votes", 4).alias("votes"))


_FACADE = f"{PTS}, l AS (SELECT frame, i AS line, i * 0.6 AS theta, 20.0 + i * 9 AS rho, 5.0 - i AS votes FROM (SELECT DISTINCT frame FROM pts), generate_series(0, 4) t(i)), j AS (SELECT p.frame, p.x, p.y, l.line, round(abs(p.x * cos(theta) + p.y * sin(theta) - rho), 9) AS d, row_number() OVER (PARTITION BY p.frame, p.x, p.y ORDER BY round(abs(p.x * cos(theta) + p.y * sin(theta) - rho), 9), votes DESC, line) AS k FROM (SELECT DISTINCT frame, x, y FROM pts) p JOIN l USING (frame)), c AS (SELECT frame, x, y, line FROM j WHERE k = 1 AND d <= 1.5)"


def facade(spark, sf):
    p = points(spark, sf).select("frame", "x", "y").distinct().withColumn("pid", F.concat_ws(":", "x", "y"))
    i = F.explode(F.array(*map(F.lit, range(5)))).alias("line")
    lines = p.select("frame").distinct().select("frame", i).select("frame", "line", (F.col("line") * 0.6).alias("theta"), (20.0 + F.col("line") * 9).alias("rho"), (5.0 - F.col("line")).alias("votes"))
    near_line = spatial.nearest_line(p, lines.withColumnRenamed("votes", "score"), ["frame"], "pid", "line").where("distance <= 1.5")
    return p.join(near_line, ["frame", "pid"]).select("frame", "x", "y", "line"), lines


@query("facade_column_lines", f"{_FACADE} SELECT frame, x, y, CAST(line AS INT) AS line FROM c")
def facade_column_lines(spark, sf):
    """Columns within reach of a detected line, each with its nearest one."""
    return facade(spark, sf)[0]


@query("facade_line_extents", f"{_FACADE}, e AS (SELECT frame, line, rho, theta, votes, count(*) AS cells, min(y * cos(theta) - x * sin(theta)) AS a, max(y * cos(theta) - x * sin(theta)) AS b FROM c JOIN l USING (frame, line) GROUP BY ALL HAVING count(*) >= 5 AND max(y * cos(theta) - x * sin(theta)) - min(y * cos(theta) - x * sin(theta)) >= 10), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY votes DESC, line) AS k FROM e) SELECT frame, CAST(line AS INT) AS line, cells, round(b - a, 6) AS length, round(rho * cos(theta) - a * sin(theta), 5) AS x1, round(rho * sin(theta) + a * cos(theta), 5) AS y1, round(rho * cos(theta) - b * sin(theta), 5) AS x2, round(rho * sin(theta) + b * cos(theta), 5) AS y2 FROM r WHERE k <= 3")
def facade_line_extents(spark, sf):
    cells, lines = facade(spark, sf)
    e = raster.line_extents(cells, lines, ["frame"], "line", 5, 10.0, 3)
    return e.select("frame", "line", "cells", rnd("length", 6).alias("length"), *(rnd(c, 5).alias(c) for c in ("x1", "y1", "x2", "y2")))


_AXIS = "sqrt(((sxx-q)**2 + (syy-q)**2 + (szz-q)**2 + 2*(sxy*sxy + sxz*sxz + syz*syz)) / 6)"
_GAPS = "r AS (SELECT {k}, z, z - lag(z) OVER (PARTITION BY {k} ORDER BY z) AS gap FROM {t}), u AS (SELECT *, sum(CASE WHEN gap > {g} THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY z ROWS UNBOUNDED PRECEDING) AS run FROM r), s AS (SELECT {k}, run, max(z) - min(z) AS span, max(gap) AS gap FROM u GROUP BY ALL), h AS (SELECT {k}, count(*) AS runs, max(span) AS longest, coalesce(max(gap), 0) AS widest FROM s GROUP BY ALL)"


@query("pole_shape", f"{PTS}, t AS (SELECT frame, cls, x / 50 AS x, y / 100 AS y, y / 10 AS z FROM pts), m AS (SELECT frame, cls, count(*) AS n, covar_pop(x, x) AS sxx, covar_pop(x, y) AS sxy, covar_pop(x, z) AS sxz, covar_pop(y, y) AS syy, covar_pop(y, z) AS syz, covar_pop(z, z) AS szz FROM t GROUP BY ALL), {_GAPS.format(k='frame, cls', t='t', g='0.4')}, q AS (SELECT *, (sxx + syy + szz) / 3 AS q FROM m), p AS (SELECT *, {_AXIS} AS p FROM q), d AS (SELECT *, acos(least(greatest(((sxx-q)*((syy-q)*(szz-q) - syz*syz) - sxy*(sxy*(szz-q) - syz*sxz) + sxz*(sxy*syz - (syy-q)*sxz)) / (p*p*p) / 2, -1), 1)) / 3 AS phi FROM p), e AS (SELECT *, q + 2*p*cos(phi) AS l1, q + 2*p*cos(phi + 2*pi()/3) AS l3 FROM d), f AS (SELECT *, 3*q - l1 - l3 AS l2, l1 / (sxx + syy + szz) AS share FROM e), w AS (SELECT *, degrees(acos(sqrt(least(greatest(((l1 - sxx)*(l1 - syy) - sxy*sxy) / ((l1 - l2)*(l1 - l3)), 0), 1)))) AS tilt FROM f) SELECT frame, cls, n, round(longest, 6) AS longest, runs, round(share, 6) AS share, round(tilt, 4) AS tilt, n >= 20 AND longest >= 2 AND share >= 0.9 AND tilt <= 10 AS accepted FROM w JOIN h USING (frame, cls)")
def pole_shape(spark, sf):
    p = points(spark, sf).select("frame", "cls", (F.col("x") / 50).alias("x"), (F.col("y") / 100).alias("y"), (F.col("y") / 10).alias("z"))
    s = shafts.shaft_shape(p, ["frame", "cls"], 0.4, 20, 2.0, 0.9, 10.0)
    return s.select("frame", "cls", "n", rnd("longest", 6).alias("longest"), "runs", rnd("share", 6).alias("share"), rnd("tilt", 4).alias("tilt"), "accepted")


@query("shaft_evidence", f"{PTS}, k AS (SELECT frame, CAST(floor(x / 10) AS BIGINT) AS peak, avg(x) AS px, avg(y) AS py FROM pts GROUP BY ALL), j AS (SELECT k.frame, peak, z, (x - px)**2 + (y - py)**2 <= 16 AS core FROM k JOIN pts USING (frame) WHERE (x - px)**2 + (y - py)**2 <= 100), t AS (SELECT frame, peak, count(*) AS around, count(*) FILTER (WHERE core) AS core FROM j GROUP BY ALL), c AS (SELECT frame, peak, z, z - lag(z) OVER (PARTITION BY frame, peak ORDER BY z) AS gap, row_number() OVER (PARTITION BY frame, peak ORDER BY z) AS i, count(*) OVER (PARTITION BY frame, peak) AS n FROM j WHERE core), a AS (SELECT *, least(greatest(n * 0.05 + 0.5, 1), n) AS lo, least(greatest(n * 0.95 + 0.5, 1), n) AS hi FROM c), q AS (SELECT frame, peak, max(z) - min(z) AS span, coalesce(max(gap), 0) AS gap, sum(CASE WHEN i = floor(hi) THEN z * (1 - (hi - floor(hi))) WHEN i = floor(hi) + 1 THEN z * (hi - floor(hi)) ELSE 0 END) - sum(CASE WHEN i = floor(lo) THEN z * (1 - (lo - floor(lo))) WHEN i = floor(lo) + 1 THEN z * (lo - floor(lo)) ELSE 0 END) AS height FROM a GROUP BY ALL), f AS (SELECT t.frame, t.peak, t.core, CASE WHEN t.core >= 3 AND span > 0 THEN t.core::DOUBLE / around ELSE 0 END AS concentration, CASE WHEN t.core >= 3 AND span > 0 THEN greatest(1 - gap / span, 0) ELSE 0 END AS continuity, CASE WHEN t.core >= 3 AND span > 0 THEN height ELSE 0 END AS height FROM t LEFT JOIN q USING (frame, peak)) SELECT frame, peak, core AS core_points, round(concentration, 6) AS concentration, round(continuity, 6) AS continuity, round(height, 6) AS height, round(concentration * continuity * least(height / 0.05, 1) * least(core / 10.0::DOUBLE, 1), 6) AS score FROM f")
def shaft_evidence(spark, sf):
    p = points(spark, sf)
    k = p.groupBy("frame", F.floor(F.col("x") / 10).alias("peak")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    e = shafts.peak_evidence(p, k, ["frame"], "peak", 4.0, 10.0, 0.05, 10)
    return e.select("frame", "peak", "core_points", *(rnd(c, 6).alias(c) for c in ("concentration", "continuity", "height", "score")))


MINORITY = {"allOf": [{"alternatives": [[{"feature": f, "operator": o, "threshold": t}]]} for f, o, t in (("height", ">=", 80), ("run_share", ">=", 0.5), ("spread", "<=", 215), ("isolation", ">=", 0.2), ("owner_share", "<=", 0.36))]}


@query("minority_shaft", f"{PTS}, t AS (SELECT frame, cls, count(*) AS n, max(y) - min(y) AS height, covar_pop(x, x) AS spread FROM pts GROUP BY ALL), o AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY frame) AS share FROM t) SELECT frame, cls, height >= 80 AND (height - 2) / height >= 0.5 AND spread <= 215 AND 1 - share >= 0.2 AND share <= 0.36 AS keep FROM o")
def minority_shaft(spark, sf):
    """A narrow, tall, isolated minority of a frame's points: a rule over its measures."""
    m = moments.cell_moments(points(spark, sf), ["frame", "cls"], ("x", "y"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("frame"))
    f = m.select("frame", "cls", (F.col("max_y") - F.col("min_y")).alias("height"), F.col("sxx").alias("spread"), share.alias("owner_share"))
    f = f.withColumns({"run_share": (F.col("height") - 2) / F.col("height"), "isolation": 1 - F.col("owner_share")})
    return f.select("frame", "cls", rules.compile_rules(MINORITY).alias("keep"))


@query("pole_context", f"{PTS}, p AS (SELECT frame, cls, x, y, z * 100 AS z FROM pts), f AS (SELECT frame, cls, count(*) AS n, regr_slope(x, z) AS ax, regr_intercept(x, z) AS cx, regr_slope(y, z) AS ay, regr_intercept(y, z) AS cy, min(z) + 0.5 AS low, max(z) - 0.5 AS high FROM p GROUP BY ALL), k AS (SELECT *, CAST(ceil((high - low) / 2.0) AS BIGINT) AS slices FROM f WHERE high > low AND ax IS NOT NULL), j AS (SELECT k.frame, k.cls, slices, p.z, low, sqrt((p.x - ax*p.z - cx)**2 + (p.y - ay*p.z - cy)**2) AS d FROM k JOIN p ON k.frame = p.frame AND k.cls <> p.cls AND p.z BETWEEN low AND high), s AS (SELECT frame, cls, least(floor((z - low) / 2.0) + 1, slices) AS i, count(*) AS c, count(*) FILTER (WHERE d <= 12) AS t FROM j WHERE d > 4 AND d <= 20 GROUP BY ALL), g AS (SELECT frame, cls, sum(c) AS around, count(*) FILTER (WHERE c >= 2) AS crowded, count(*) FILTER (WHERE t >= 1) AS touched FROM s GROUP BY ALL) SELECT k.frame, k.cls, n, slices, coalesce(around, 0)::BIGINT AS around, coalesce(crowded, 0) AS crowded, coalesce(touched, 0) AS touched FROM k LEFT JOIN g USING (frame, cls)")
def pole_context(spark, sf):
    p = points(spark, sf).select("frame", "cls", "x", "y", (F.col("z") * 100).alias("z"))
    return shafts.axis_context(p, p, ["frame"], "cls", 4.0, 20.0, 12.0, 0.5, 2.0)


@query("curb_obstacles", f"{PTS}, c AS (SELECT ok, ln, frame, x, y, inten * 100 AS z FROM pts WHERE cls = 'R'), a AS (SELECT frame, x, y, z * 100 AS z FROM pts), h AS (SELECT c.ok, c.ln, c.frame, c.x, c.y, c.z, count(*) AS n, count(DISTINCT floor((a.z - c.z - 1) / 1.5)) AS b FROM c JOIN a ON c.frame = a.frame AND (a.x - c.x)**2 + (a.y - c.y)**2 <= 16 AND a.z - c.z BETWEEN 1 AND 8 GROUP BY ALL) SELECT c.frame, count(*) AS candidates, count(*) FILTER (WHERE h.n >= 2 AND h.b >= 2) AS obstacles FROM c LEFT JOIN h USING (ok, ln, frame, x, y, z) GROUP BY c.frame")
def curb_obstacles(spark, sf):
    """Candidates below elevated points of a cylinder, counted by frame."""
    p = points(spark, sf)
    c = p.where("cls = 'R'").select("frame", "x", "y", (F.col("inten") * 100).alias("z"), F.concat_ws(":", "ok", "ln", "frame", "x", "y", "inten").alias("__id"))
    b = shafts.blocked(c, p.select("frame", "x", "y", (F.col("z") * 100).alias("z")), ["frame"], 4.0, 1.0, 8.0, 1.5, 2, 2)
    return b.groupBy("frame").agg(F.count("*").alias("candidates"), F.count(F.when(F.col("obstacle"), 1)).alias("obstacles"))


@query("density_context", f"{PTS}, r AS (SELECT frame, y AS z, CASE WHEN cls = 'N' THEN 1 ELSE 0 END AS a FROM pts WHERE inten >= 0.02), e AS (SELECT frame, z - 0.25 AS t, a, 1 AS s FROM r UNION ALL SELECT frame, z + 0.25, a, -1 FROM r), g AS (SELECT frame, t, sum(s * a) AS a, sum(s) AS s FROM e GROUP BY ALL), w AS (SELECT frame, t, lead(t) OVER v - t AS w, sum(a) OVER (PARTITION BY frame ORDER BY t ROWS UNBOUNDED PRECEDING) AS c, sum(s) OVER (PARTITION BY frame ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM g WINDOW v AS (PARTITION BY frame ORDER BY t)), k AS (SELECT *, w IS NOT NULL AND c >= 3 AND c::DOUBLE / greatest(n, 1) > 0.6 AS ok FROM w), x AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY frame ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM k), y AS (SELECT frame, run, sum(w) AS w, sum(w * c / n) AS q FROM x WHERE ok GROUP BY ALL) SELECT frame, round(sum(w), 5) AS height, round(max(w), 5) AS longest, round(sum(q) / sum(w), 5) AS mean_share FROM y GROUP BY frame")
def density_context(spark, sf):
    p = points(spark, sf).select("frame", F.col("y").alias("z"), "cls", "inten")
    s = shafts.mixture_support(p, ["frame"], F.col("cls") == "N", F.col("inten") >= 0.02, 0.25, 3, 0.6)
    return s.select("frame", *(rnd(c, 5).alias(c) for c in ("height", "longest", "mean_share")))
