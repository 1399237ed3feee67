"""Queries on neighbourhoods: stencils, radius joins, nearest neighbours, kernels, fields, lines, graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plinth.operators import binning, graph, moments, raster, signal, spatial
from plinth.plans.catalog import PTS, points, query, rnd, table

GRID = f"{PTS}, g AS (SELECT frame, CAST(floor(x / 5) AS BIGINT) AS bx, CAST(floor(y / 10) AS BIGINT) AS by, count(*) AS n, avg(y) AS v FROM pts GROUP BY ALL)"


def grid(spark, sf):
    return points(spark, sf).groupBy("frame", F.floor(F.col("x") / 5).alias("bx"), F.floor(F.col("y") / 10).alias("by")).agg(F.count("*").alias("n"), F.avg("y").alias("v"))


def beside(cells, reach, centre=False):
    other = cells.select("frame", "bx", "by", F.col("n").alias("nn"), F.col("v").alias("nv"))
    return binning.neighbours(cells, other, ["frame"], reach, centre)


NB = "JOIN g b ON a.frame = b.frame AND abs(a.bx - b.bx) <= {r} AND abs(a.by - b.by) <= {r}"
NB1 = NB.format(r=1) + " AND (a.bx <> b.bx OR a.by <> b.by)"


@query("neighbour_count", f"{GRID} SELECT a.frame, a.bx, a.by, count(b.frame) AS neighbours FROM g a LEFT {NB1} GROUP BY ALL")
def neighbour_count(spark, sf):
    g = grid(spark, sf)
    n = beside(g, 1).groupBy("frame", "bx", "by").agg(F.count("*").alias("c"))
    return g.join(n, ["frame", "bx", "by"], "left").select("frame", "bx", "by", F.coalesce("c", F.lit(0)).alias("neighbours"))


@query("neighbour_max_difference", f"{GRID} SELECT a.frame, a.bx, a.by, round(coalesce(max(abs(a.v - b.v)), 0), 5) AS diff FROM g a LEFT {NB1} GROUP BY ALL")
def neighbour_max_difference(spark, sf):
    g = grid(spark, sf)
    n = beside(g, 1).groupBy("frame", "bx", "by").agg(F.max(F.abs(F.col("v") - F.col("nv"))).alias("d"))
    return g.join(n, ["frame", "bx", "by"], "left").select("frame", "bx", "by", rnd(F.coalesce("d", F.lit(0.0)), 5).alias("diff"))


@query("box_sum", f"{GRID} SELECT a.frame, a.bx, a.by, sum(b.n)::BIGINT AS box FROM g a JOIN g b ON a.frame = b.frame AND abs(a.bx - b.bx) <= 1 AND abs(a.by - b.by) <= 2 GROUP BY ALL")
def box_sum(spark, sf):
    return signal.separable_window(grid(spark, sf), ["frame"], "n", 1, 2).select("frame", "bx", "by", "box")


@query("box_cell_count", "SELECT r, c, (least(r + 2, 12) - greatest(r - 2, 1) + 1) * (least(c + 3, 9) - greatest(c - 3, 1) + 1) AS n FROM generate_series(1, 12) a(r), generate_series(1, 9) b(c)")
def box_cell_count(spark, sf):
    cells = spark.range(1, 13).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long"))).alias("c"))
    span = lambda v, reach, most: F.least(F.col(v) + reach, F.lit(most)) - F.greatest(F.col(v) - reach, F.lit(1)) + 1
    return cells.withColumn("n", span("r", 2, 12) * span("c", 3, 9))


@query("local_mean", f"{GRID} SELECT a.frame, a.bx, a.by, round(avg(b.v), 5) AS mean FROM g a {NB.format(r=2)} GROUP BY ALL")
def local_mean(spark, sf):
    return beside(grid(spark, sf), 2, True).groupBy("frame", "bx", "by").agg(rnd(F.avg("nv"), 5).alias("mean"))


@query("local_minimum", f"{GRID} SELECT a.frame, a.bx, a.by, min(b.v) AS low FROM g a {NB.format(r=2)} GROUP BY ALL")
def local_minimum(spark, sf):
    return signal.separable_window(grid(spark, sf), ["frame"], "v", 2, 2, "min", "low").select("frame", "bx", "by", "low")


@query("hole_fill", f"{GRID}, f AS (SELECT frame, min(bx) AS x0, max(bx) AS x1, min(by) AS y0, max(by) AS y1 FROM g GROUP BY frame), a AS (SELECT frame, bx, by FROM f, LATERAL (SELECT unnest(generate_series(x0, x1)) AS bx) x, LATERAL (SELECT unnest(generate_series(y0, y1)) AS by) y) SELECT a.frame, a.bx, a.by, round(median(b.v), 5) AS filled, count(*) AS n FROM a {NB.format(r=1)} WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.frame = a.frame AND g.bx = a.bx AND g.by = a.by) GROUP BY ALL HAVING count(*) >= 3")
def hole_fill(spark, sf):
    g = grid(spark, sf)
    return signal.filled_holes(g, ["frame"], "v", 1, 3).select("frame", "bx", "by", rnd("filled", 5).alias("filled"), "n")


@query("hole_fill_wide", f"{GRID.replace('GROUP BY ALL)', 'GROUP BY ALL HAVING count(*) >= 4)')}, f AS (SELECT frame, min(bx) AS x0, max(bx) AS x1, min(by) AS y0, max(by) AS y1 FROM g GROUP BY frame), a AS (SELECT frame, bx, by FROM f, LATERAL (SELECT unnest(generate_series(x0, x1)) AS bx) x, LATERAL (SELECT unnest(generate_series(y0, y1)) AS by) y) SELECT a.frame, a.bx, a.by, round(median(b.v), 5) AS filled, count(*) AS n FROM a {NB.format(r=2)} WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.frame = a.frame AND g.bx = a.bx AND g.by = a.by) GROUP BY ALL HAVING count(*) >= 3")
def hole_fill_wide(spark, sf):
    """The same over windows of five by five, where cells of few points are holes."""
    return signal.filled_holes(grid(spark, sf).where("n >= 4"), ["frame"], "v", 2, 3).select("frame", "bx", "by", rnd("filled", 5).alias("filled"), "n")


@query("directional_support", f"{GRID}, d AS (SELECT * FROM (VALUES (0, 1, 0), (1, 0, 1), (2, 1, 1), (3, 1, -1)) t(o, dx, dy)), k AS (SELECT o, s * dx AS dx, s * dy AS dy FROM d, (VALUES (-2), (-1), (1), (2)) u(s)), c AS (SELECT a.frame, a.bx, a.by, o, sum(b.n) AS s FROM g a, k JOIN g b ON TRUE WHERE a.frame = b.frame AND b.bx = a.bx + dx AND b.by = a.by + dy GROUP BY ALL) SELECT frame, bx, by, max(s)::BIGINT AS best FROM c GROUP BY ALL")
def directional_support(spark, sf):
    g = grid(spark, sf)
    offsets = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(s * dx).alias("dx"), F.lit(s * dy).alias("dy")) for o, dx, dy in ((0, 1, 0), (1, 0, 1), (2, 1, 1), (3, 1, -1)) for s in (-2, -1, 1, 2)))
    spread = g.select("frame", "bx", "by", F.explode(offsets).alias("d")).select("frame", "bx", "by", "d.o", (F.col("bx") + F.col("d.dx")).alias("nx"), (F.col("by") + F.col("d.dy")).alias("ny"))
    other = g.select("frame", F.col("bx").alias("nx"), F.col("by").alias("ny"), F.col("n").alias("nn"))
    return spread.join(other, ["frame", "nx", "ny"]).groupBy("frame", "bx", "by", "o").agg(F.sum("nn").alias("s")).groupBy("frame", "bx", "by").agg(F.max("s").alias("best"))


RADII = (0, 1, 2, 4, 7)
_WITHIN = "FILTER (WHERE greatest(abs(a.bx - b.bx), abs(a.by - b.by)) <= {r})"


@query("multiscale_moments", f"{GRID} SELECT a.frame, a.bx, a.by, {', '.join(f'(sum(b.n) {_WITHIN.format(r=r)})::BIGINT AS n{r}, round(sum(b.n * b.v) {_WITHIN.format(r=r)} / sum(b.n) {_WITHIN.format(r=r)}, 5) AS m{r}, round(sum(b.n * b.v * b.v) {_WITHIN.format(r=r)} / sum(b.n) {_WITHIN.format(r=r)} - (sum(b.n * b.v) {_WITHIN.format(r=r)} / sum(b.n) {_WITHIN.format(r=r)})**2, 4) AS s{r}' for r in RADII)} FROM g a {NB.format(r=7)} GROUP BY a.frame, a.bx, a.by")
def multiscale_moments(spark, sf):
    """Pooled count, mean and variance at every radius, two one-dimensional passes each."""
    out = g = grid(spark, sf)
    out = out.select("frame", "bx", "by")
    n, v = F.col("n"), F.col("v")
    for r in RADII:
        sums = raster.box_sums(g, ["frame"], {f"__n{r}": n, f"__v{r}": n * v, f"__q{r}": n * v * v}, r)
        out = out.join(sums, ["frame", "bx", "by"])
    mean = lambda r: F.col(f"__v{r}") / F.col(f"__n{r}")
    cols = [c for r in RADII for c in (F.col(f"__n{r}").alias(f"n{r}"), rnd(mean(r), 5).alias(f"m{r}"), rnd(F.col(f"__q{r}") / F.col(f"__n{r}") - mean(r) ** 2, 4).alias(f"s{r}"))]
    return out.select("frame", "bx", "by", *cols)


@query("mask_dilation", f"{GRID}, m AS (SELECT frame, bx, by FROM g WHERE n >= 6), o AS (SELECT * FROM generate_series(-1, 1) a(i), generate_series(-1, 1) b(j)) SELECT DISTINCT frame, bx + i AS bx, by + j AS by FROM m, o")
def mask_dilation(spark, sf):
    return binning.dilate(grid(spark, sf).where("n >= 6").select("frame", "bx", "by"), ["frame"], 1)


@query("tile_halo", f"{PTS}, u AS (SELECT frame, x, y, unnest(generate_series(floor((x - 1.5) / 10)::BIGINT, floor((x + 1.5) / 10)::BIGINT)) AS tx FROM pts), w AS (SELECT *, unnest(generate_series(floor((y - 1.5) / 10)::BIGINT, floor((y + 1.5) / 10)::BIGINT)) AS ty FROM u) SELECT frame, tx, ty, count(*) AS n, count(*) FILTER (WHERE floor(x / 10) = tx AND floor(y / 10) = ty) AS core FROM w GROUP BY ALL")
def tile_halo(spark, sf):
    t = binning.tiles_with_halo(points(spark, sf), "x", "y", 10.0, 1.5)
    return t.groupBy("frame", "tx", "ty").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_core"), 1)).alias("core"))


EMB = "WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query("radius_neighbours", f"{EMB} SELECT a.vec_id, count(*) AS n FROM e a JOIN e b ON a.label = b.label AND (a.x - b.x)**2 + (a.y - b.y)**2 <= 0.01 GROUP BY a.vec_id")
def radius_neighbours(spark, sf):
    v = vectors(spark, sf)
    return spatial.radius_pairs(v, v, ["label"], 0.1).groupBy("vec_id").agg(F.count("*").alias("n"))


@query("nearest_neighbour", f"{EMB}, j AS (SELECT a.vec_id, b.vec_id AS nearest_id, (a.x - b.x)**2 + (a.y - b.y)**2 AS d2 FROM e a JOIN e b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND (a.x - b.x)**2 + (a.y - b.y)**2 <= 0.04), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, nearest_id) AS i FROM j) SELECT e.vec_id, coalesce(k.nearest_id, -1) AS nearest_id FROM e LEFT JOIN k ON e.vec_id = k.vec_id AND i = 1 WHERE e.vec_id % 2 = 0")
def nearest_neighbour(spark, sf):
    v = vectors(spark, sf)
    n = spatial.nearest_within(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "mark_id"), ["label"], "vec_id", "mark_id", 0.2)
    return n.select("vec_id", F.coalesce("nearest_id", F.lit(-1)).alias("nearest_id"))


@query("knn_vote", f"{EMB}, b AS (SELECT * FROM e WHERE vec_id % 5 = 0), j AS (SELECT a.vec_id, CAST(b.label < 5 AS INT) AS l, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x - b.x)**2 + (a.y - b.y)**2, b.vec_id) AS i FROM e a, b WHERE a.vec_id % 5 <> 0) SELECT vec_id, round(avg(l), 6) AS score FROM j WHERE i <= 5 GROUP BY vec_id")
def knn_vote(spark, sf):
    v = vectors(spark, sf).withColumn("l", (F.col("label") < 5).cast("int"))
    s = spatial.knn_vote(v.where("vec_id % 5 <> 0"), v.where("vec_id % 5 = 0"), "vec_id", "vec_id", ["x", "y"], "l", 5)
    return s.select("vec_id", rnd("score", 6).alias("score"))


COMP = f"{PTS}, c AS (SELECT cls, frame, avg(x) AS mx, avg(y) AS my, covar_pop(x, x) / 50 + 0.1 AS sxx, covar_pop(x, y) / 50 AS sxy, covar_pop(y, y) / 50 + 0.1 AS syy, count(*) / 1000.0::DOUBLE AS weight FROM pts GROUP BY cls, frame)"


def comps(spark, sf):
    m = moments.cell_moments(points(spark, sf), ["cls", "frame"], ("x", "y"))
    return m.select("cls", "frame", "mx", "my", (F.col("sxx") / 50 + 0.1).alias("sxx"), (F.col("sxy") / 50).alias("sxy"), (F.col("syy") / 50 + 0.1).alias("syy"), (F.col("n") / 1000.0).alias("weight"))


@query("kernel_overlap", f"{COMP}, p AS (SELECT a.cls, a.weight * b.weight AS w, a.sxx + b.sxx AS xx, a.sxy + b.sxy AS xy, a.syy + b.syy AS yy, a.mx - b.mx AS dx, a.my - b.my AS dy FROM c a JOIN c b ON a.cls = b.cls AND a.frame < 50 AND b.frame >= 50), d AS (SELECT *, xx*yy - xy*xy AS det FROM p) SELECT cls, round(sum(w * exp(-0.5 * (yy*dx*dx - 2*xy*dx*dy + xx*dy*dy) / det) / (2 * pi() * sqrt(det))), 5) AS overlap FROM d GROUP BY cls")
def kernel_overlap(spark, sf):
    c = comps(spark, sf)
    return spatial.kernel_overlap(c.where("frame < 50"), c.where("frame >= 50"), "cls").select("cls", rnd("overlap", 5).alias("overlap"))


@query("field_intensity", f"{COMP}, q AS (SELECT row_number() OVER () AS i, x, y, cls FROM (SELECT DISTINCT cls, round(x / 10) * 10 AS x, round(y / 20) * 20 AS y FROM pts)), d AS (SELECT q.cls, q.x, q.y, weight, sxx*syy - sxy*sxy AS det, (syy*(q.x-mx)**2 - 2*sxy*(q.x-mx)*(q.y-my) + sxx*(q.y-my)**2) / (sxx*syy - sxy*sxy) AS m FROM q LEFT JOIN c ON q.cls = c.cls) SELECT cls, x, y, round(coalesce(sum(weight * exp(-0.5 * m) / (2 * pi() * sqrt(det))) FILTER (WHERE m <= 9), 0), 6) AS intensity, count(*) FILTER (WHERE m <= 9) AS components FROM d GROUP BY ALL".replace("round(x / 10)", "floor(x / 10 + 0.5)").replace("round(y / 20)", "floor(y / 20 + 0.5)"))
def field_intensity(spark, sf):
    c = comps(spark, sf)
    q = points(spark, sf).select("cls", (F.floor(F.col("x") / 10 + 0.5) * 10.0).alias("x"), (F.floor(F.col("y") / 20 + 0.5) * 20.0).alias("y")).distinct().withColumn("pid", F.concat_ws(":", "cls", F.col("x").cast("int"), F.col("y").cast("int")))
    index = spatial.field_index(c, 4.0, 3.0)
    found = spatial.field_query(q, index, "pid", "cls", 4.0, 3.0)
    return q.join(found, "pid").select("cls", "x", "y", rnd("intensity", 6).alias("intensity"), F.col("components").cast("long"))


@query("field_index_cells", f"{COMP} SELECT cls, frame, (floor((mx + 3*sqrt(sxx)) / 4) - floor((mx - 3*sqrt(sxx)) / 4) + 1)::BIGINT * (floor((my + 3*sqrt(syy)) / 4) - floor((my - 3*sqrt(syy)) / 4) + 1)::BIGINT AS cells FROM c")
def field_index_cells(spark, sf):
    return spatial.field_index(comps(spark, sf), 4.0, 3.0).groupBy("cls", "frame").agg(F.count("*").alias("cells"))


@query("coverage_predicate", f"{PTS}, t AS (SELECT DISTINCT frame, floor(x / 5) * 5 AS x0, floor(y / 10) * 10 AS y0 FROM pts WHERE cls = 'A'), p AS (SELECT DISTINCT frame, x, y FROM pts WHERE cls <> 'A') SELECT p.frame, p.x, p.y, EXISTS (SELECT 1 FROM t WHERE p.frame = t.frame AND p.x BETWEEN x0 AND x0 + 5 AND p.y BETWEEN y0 AND y0 + 10) AS in_coverage FROM p")
def coverage_predicate(spark, sf):
    pts = points(spark, sf)
    t = pts.where("cls = 'A'").select("frame", F.floor(F.col("x") / 5).alias("tx"), F.floor(F.col("y") / 10).alias("ty"))
    p = pts.where("cls <> 'A'").select("frame", "x", "y").distinct().withColumn("pid", F.concat_ws(":", "frame", "x", "y"))
    scaled = p.select("frame", "pid", (F.col("x") / 5).alias("x"), (F.col("y") / 10).alias("y"))
    return p.join(spatial.covered(scaled, t, "pid", 1.0, ["frame"]), "pid").select("frame", "x", "y", "in_coverage")


@query("local_crop", f"{COMP} SELECT cls, frame FROM c WHERE (mx - 25)**2 + (my - 52)**2 <= 4")
def local_crop(spark, sf):
    return comps(spark, sf).where((F.col("mx") - 25) ** 2 + (F.col("my") - 52) ** 2 <= 4).select("cls", "frame")


HOUGH = f"{PTS}, h AS (SELECT frame, th, CAST(floor((x * cos(th * pi() / 18) + y * sin(th * pi() / 18)) / 4 + 0.5 + 1e-9) AS BIGINT) AS rho, sum(inten + 0.01) AS votes FROM pts, generate_series(0, 17) g(th) GROUP BY ALL)"


def hough_votes(spark, sf):
    return spatial.hough(points(spark, sf), ["frame"], F.col("inten") + 0.01, 18, 4.0)


@query("hough_votes", f"{HOUGH} SELECT frame, CAST(th AS INT) AS theta_bin, rho AS rho_bin, round(votes, 4) AS votes FROM h".replace(" + 1e-9", ""))
def hough(spark, sf):
    return hough_votes(spark, sf).withColumn("votes", rnd("votes", 4))


_BEATEN = "SELECT DISTINCT a.frame, a.th, a.rho FROM v a JOIN v b ON a.frame = b.frame AND abs(a.th - b.th) <= 1 AND abs(a.rho - b.rho) <= 1 AND (a.th <> b.th OR a.rho <> b.rho) AND (b.votes > a.votes OR (b.votes = a.votes AND (b.th < a.th OR (b.th = a.th AND b.rho < a.rho))))"


@query("hough_peaks", f"{HOUGH}, v AS (SELECT frame, CAST(th AS INT) AS th, rho, round(votes, 4) AS votes FROM h WHERE round(votes, 4) >= 1), x AS ({_BEATEN}), k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY votes DESC, th, rho) AS rank FROM v ANTI JOIN x USING (frame, th, rho)) SELECT frame, th AS theta_bin, rho AS rho_bin, votes, rank FROM k WHERE rank <= 3".replace(" + 1e-9", ""))
def hough_peaks(spark, sf):
    return spatial.peaks(hough_votes(spark, sf).withColumn("votes", rnd("votes", 4)), ["frame"], 1, 1.0, 3).withColumn("rank", F.col("rank").cast("long"))


@query("nearest_line", f"{PTS}, l AS (SELECT frame, i, i * 0.3 AS theta, 20.0 + i * 8 AS rho, (i * 7) % 5 AS score FROM (SELECT DISTINCT frame FROM pts), generate_series(0, 4) g(i)), j AS (SELECT p.frame, p.x, p.y, l.i, row_number() OVER (PARTITION BY p.frame, p.x, p.y ORDER BY round(abs(p.x * cos(theta) + p.y * sin(theta) - rho), 9), score DESC, i) AS k FROM (SELECT DISTINCT frame, x, y FROM pts) p JOIN l ON p.frame = l.frame) SELECT frame, x, y, CAST(i AS INT) AS line FROM j WHERE k = 1")
def nearest_line(spark, sf):
    p = points(spark, sf).select("frame", "x", "y").distinct().withColumn("pid", F.concat_ws(":", "x", "y"))
    i = F.explode(F.array(*map(F.lit, range(5)))).alias("line")
    lines = p.select("frame").distinct().select("frame", i).select("frame", "line", (F.col("line") * 0.3).alias("theta"), (20.0 + F.col("line") * 8).alias("rho"), ((F.col("line") * 7) % 5).cast("double").alias("score"))
    found = spatial.nearest_line(p, lines, ["frame"], "pid", "line")
    return p.join(found, ["frame", "pid"]).select("frame", "x", "y", "line")


IDS = f"{PTS}, i AS (SELECT frame * 1000000 + bx * 1000 + by AS id, * FROM (SELECT frame, CAST(floor(x) AS BIGINT) AS bx, CAST(floor(y / 2) AS BIGINT) AS by, count(*) AS n, avg(y) AS v FROM pts GROUP BY ALL))"


def marked(spark, sf):
    """Occupied cells of a fine lattice, with ids."""
    g = points(spark, sf).groupBy("frame", F.floor(F.col("x")).alias("bx"), F.floor(F.col("y") / 2).alias("by")).agg(F.count("*").alias("n"), F.avg("y").alias("v"))
    return g.withColumn("id", F.col("frame") * 1000000 + F.col("bx") * 1000 + F.col("by"))


_CC = "e AS (SELECT a.id AS a, b.id AS b FROM i a JOIN i b ON a.frame = b.frame AND abs(a.bx - b.bx) <= 1 AND abs(a.by - b.by) <= 1{x}), r(id, label) AS (SELECT id, id FROM i UNION SELECT e.b, r.label FROM r JOIN e ON r.id = e.a WHERE r.label < e.b)"


@query("connected_components", f"{IDS.replace('WITH', 'WITH RECURSIVE', 1)}, {_CC.format(x='')} SELECT id, min(label) AS label FROM r GROUP BY id")
def connected_components(spark, sf):
    return graph.frame_components(marked(spark, sf), "frame")


@query("slope_components", f"{IDS.replace('WITH', 'WITH RECURSIVE', 1)}, {_CC.format(x=' AND abs(a.v - b.v) <= 1.5')} SELECT id, min(label) AS label FROM r GROUP BY id")
def slope_components(spark, sf):
    return graph.frame_components(marked(spark, sf), "frame", "v", 1.5)


@query("small_components", f"{IDS.replace('WITH', 'WITH RECURSIVE', 1)}, {_CC.format(x='')}, l AS (SELECT id, min(label) AS label FROM r GROUP BY id) SELECT id FROM l WHERE label IN (SELECT label FROM l GROUP BY label HAVING count(*) >= 4)")
def small_components(spark, sf):
    labels = graph.frame_components(marked(spark, sf), "frame")
    return labels.join(labels.groupBy("label").agg(F.count("*").alias("n")).where("n >= 4"), "label", "left_semi").select("id")


@query("region_growing", f"{IDS.replace('WITH', 'WITH RECURSIVE', 1)}, s AS (SELECT frame, bx, by, v FROM i WHERE n >= 3), m AS (SELECT frame, median(v) AS mid FROM s GROUP BY frame), a AS (SELECT i.* FROM i JOIN m USING (frame) WHERE abs(v - mid) <= 25), r(frame, bx, by, v) AS (SELECT a.frame, a.bx, a.by, a.v FROM a JOIN s USING (frame, bx, by) UNION SELECT b.frame, b.bx, b.by, b.v FROM r JOIN a b ON r.frame = b.frame AND abs(r.bx - b.bx) <= 1 AND abs(r.by - b.by) <= 1 AND abs(r.v - b.v) <= 2.5) SELECT frame, bx, by FROM r")
def region_growing(spark, sf):
    m = marked(spark, sf)
    return graph.frame_growth(m.withColumn("seed", F.col("n") >= 3), "frame", "v", 2.5, 25.0)


@query("greedy_order", f"{COMP} SELECT cls, frame, row_number() OVER (PARTITION BY cls ORDER BY weight DESC, frame) AS rank FROM c")
def greedy_order(spark, sf):
    w = Window.partitionBy("cls").orderBy(F.desc("weight"), "frame")
    return comps(spark, sf).select("cls", "frame", F.row_number().over(w).cast("long").alias("rank"))
