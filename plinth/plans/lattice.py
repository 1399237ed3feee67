"""Queries on point returns: scans, filters, bins, grouped moments, quantiles and shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plinth.operators import binning, moments
from plinth.plans.catalog import PTS, points, query, rnd, table

CELL = f"{PTS}, c AS (SELECT *, CAST(floor(x / 5) AS BIGINT) + 1 AS bx, CAST(floor(y / 10) AS BIGINT) + 1 AS by FROM pts)"


def cells(spark, sf):
    p = points(spark, sf)
    return p.withColumns({"bx": binning.bin_of(F.col("x"), 0, 5), "by": binning.bin_of(F.col("y"), 0, 10)})


def r(df, *names, digits=5):
    """Rounds columns, for comparison."""
    return df.withColumns({n: rnd(n, digits) for n in names})


@query("frame_scan", f"{PTS} SELECT ok, ln, x, y, z FROM pts WHERE frame = 7")
def frame_scan(spark, sf):
    return points(spark, sf).where("frame = 7").select("ok", "ln", "x", "y", "z")


@query("flatten_cloud", f"{PTS}, a AS (SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY ok, ln, x, y, z, inten) AS idx, x, y, z FROM pts) SELECT frame, idx, x, y, round(sqrt(x*x + y*y + z*z), 6) AS rng FROM a")
def flatten_cloud(spark, sf):
    one = points(spark, sf).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("ok", "ln", "x", "y", "z", "inten"))).alias("pts"))
    flat = one.select("frame", F.posexplode("pts").alias("i", "p")).select("frame", (F.col("i") + 1).alias("idx"), "p.x", "p.y", "p.z")
    rng = F.coalesce(F.lit(None).cast("double"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    return flat.select("frame", F.col("idx").cast("long"), "x", "y", rnd(rng, 6).alias("rng"))


@query("retained_returns", f"{PTS} SELECT frame, count(*) AS n FROM pts WHERE sqrt(x*x+y*y+z*z) BETWEEN 10 AND 90 AND NOT (abs(x) < 15 AND abs(y) < 15) GROUP BY frame")
def retained_returns(spark, sf):
    return binning.retained(points(spark, sf), "x", "y", "z", 10, 90, 15).groupBy("frame").agg(F.count("*").alias("n"))


@query("grid_assignment", f"{PTS}, b AS (SELECT *, CAST(floor((x - 5) / 4) AS BIGINT) + 1 AS bx, CAST(floor((y - 10) / 8) AS BIGINT) + 1 AS by FROM pts) SELECT CASE WHEN bx BETWEEN 1 AND 10 AND by BETWEEN 1 AND 10 THEN (bx - 1) * 10 + by ELSE -1 END AS cell, (bx BETWEEN 1 AND 10 AND by BETWEEN 1 AND 10) AS in_grid, count(*) AS n FROM b GROUP BY ALL")
def grid_assignment(spark, sf):
    return binning.with_cells(points(spark, sf), "x", "y", (5, 10), (4, 8), (10, 10)).withColumn("cell", F.coalesce("cell", F.lit(-1))).groupBy("cell", "in_grid").agg(F.count("*").alias("n"))


@query("lattice_extent", "SELECT 1 AS id, -20.0::DOUBLE AS xmin, 30.0::DOUBLE AS xmax, -38.0::DOUBLE AS ymin, 42.0::DOUBLE AS ymax")
def lattice_extent(spark, sf):
    return spark.createDataFrame([(1, *map(float, binning.extent(100, 160, 0.5, (5.0, 2.0))))], "id int, xmin double, xmax double, ymin double, ymax double")


@query("height_layers", f"{PTS} SELECT frame, CAST(floor((z - 0.005) / 0.03) AS BIGINT) + 1 AS layer, count(*) AS n FROM pts GROUP BY ALL")
def height_layers(spark, sf):
    return points(spark, sf).groupBy("frame", binning.bin_of(F.col("z"), 0.005, 0.03).alias("layer")).agg(F.count("*").alias("n"))


@query("branch_split", f"{PTS}, m AS (SELECT frame, median(y) AS my FROM pts GROUP BY frame) SELECT frame, y <= my AS is_ground, count(*) AS n, round(avg(z), 6) AS mz FROM pts JOIN m USING (frame) GROUP BY ALL")
def branch_split(spark, sf):
    p = points(spark, sf)
    m = p.groupBy("frame").agg(F.median("y").alias("my"))
    return p.join(m, "frame").groupBy("frame", (F.col("y") <= F.col("my")).alias("is_ground")).agg(F.count("*").alias("n"), rnd(F.avg("z"), 6).alias("mz"))


@query("index_mask", "SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) AS marked FROM orders")
def index_mask(spark, sf):
    found = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return binning.marked_rows(table(spark, sf, "orders").select("o_orderkey"), found, ["o_orderkey"])


@query("selected_rows", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def selected_rows(spark, sf):
    """The rows of a mask, with all their aligned attributes."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    found = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return binning.marked_rows(orders, found, ["o_orderkey"]).where("marked").drop("marked")


@query("cell_moments", f"{CELL} SELECT bx, by, count(*) AS n, round(avg(x), 5) AS mx, round(avg(y), 5) AS my, round(avg(z), 5) AS mz, round(covar_pop(x, x), 5) AS sxx, round(covar_pop(x, y), 5) AS sxy, round(covar_pop(x, z), 5) AS sxz, round(covar_pop(y, y), 5) AS syy, round(covar_pop(y, z), 5) AS syz, round(covar_pop(z, z), 5) AS szz, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM c GROUP BY bx, by HAVING count(*) >= 5")
def cell_moments(spark, sf):
    return r(moments.cell_moments(cells(spark, sf), ["bx", "by"], least=5), "mx", "my", "mz", "sxx", "sxy", "sxz", "syy", "syz", "szz")


@query("pillar_statistics", f"{CELL} SELECT frame, bx, by, count(*) AS n, min(z) AS min_z, max(z) AS max_z, count(inten) AS n_inten, max(inten) AS max_inten, round(avg(y), 5) AS my FROM c GROUP BY ALL")
def pillar_statistics(spark, sf):
    ok = binning.finite(F.col("inten"))
    return cells(spark, sf).groupBy("frame", "bx", "by").agg(F.count("*").alias("n"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.count(F.when(ok, F.col("inten"))).alias("n_inten"), F.max(F.when(ok, F.col("inten"))).alias("max_inten"), rnd(F.avg("y"), 5).alias("my"))


@query("robust_low", f"{CELL}, k AS (SELECT *, row_number() OVER (PARTITION BY frame, bx ORDER BY y) AS i FROM c), g AS (SELECT frame, bx, count(*) AS n, min(y) AS lowest, min(CASE WHEN i = 2 THEN y END) AS second, max(y) AS highest FROM k GROUP BY ALL) SELECT *, CASE WHEN second - lowest > 1 THEN second ELSE lowest END AS robust_low FROM g")
def robust_low(spark, sf):
    return moments.robust_low(cells(spark, sf), ["frame", "bx"], "y", 1.0)


@query("cell_std", f"{CELL} SELECT bx, by, round(avg(z), 6) AS mean_z, round(stddev_pop(z), 6) AS std_z FROM c GROUP BY ALL")
def cell_std(spark, sf):
    return cells(spark, sf).groupBy("bx", "by").agg(rnd(F.avg("z"), 6).alias("mean_z"), rnd(F.stddev_pop("z"), 6).alias("std_z"))


@query("sample_cell_covariance", f"{CELL} SELECT cls, bx, by, count(*) AS n, round(avg(x), 5) AS mx, round(coalesce(covar_samp(x, x), 0), 5) AS sxx, round(coalesce(covar_samp(x, y), 0), 5) AS sxy, round(avg(y), 5) AS my, round(coalesce(covar_samp(y, y), 0), 5) AS syy FROM c GROUP BY ALL HAVING count(*) >= 3")
def sample_cell_covariance(spark, sf):
    return r(moments.sample_moments(cells(spark, sf), ["cls", "bx", "by"], least=3), "mx", "my", "sxx", "sxy", "syy")


@query("block_scatter", f"{CELL} SELECT frame % 8 AS block, bx, count(*) AS n, round(avg(y), 5) AS my, round(count(*) * covar_pop(y, y), 3) AS scatter FROM c GROUP BY ALL")
def block_scatter(spark, sf):
    return cells(spark, sf).groupBy((F.col("frame") % 8).alias("block"), "bx").agg(F.count("*").alias("n"), rnd(F.avg("y"), 5).alias("my"), rnd(F.count("*") * F.covar_pop("y", "y"), 3).alias("scatter"))


@query("merged_components", f"{CELL} SELECT cls, bx, count(*) AS n, round(avg(x), 5) AS mx, round(avg(y), 5) AS my, round(covar_pop(x, x), 4) AS sxx, round(covar_pop(x, y), 4) AS sxy, round(covar_pop(y, y), 4) AS syy, round(1 - exp(-count(*) / 500.0), 6) AS support FROM c GROUP BY ALL")
def merged_components(spark, sf):
    parts = moments.cell_moments(cells(spark, sf), ["frame", "cls", "bx"], ("x", "y"))
    return r(r(moments.merge_moments(parts, ["cls", "bx"], saturation=500.0), "mx", "my"), "sxx", "sxy", "syy", digits=4).withColumn("support", rnd("support", 6))


_SOFT = "1 / (1 + exp(-(inten - 0.04) * 50))"


@query("soft_weighted_moments", f"{CELL}, w AS (SELECT *, {_SOFT} AS w FROM c), m AS (SELECT bx, by, sum(w) AS mass, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my FROM w GROUP BY ALL) SELECT bx, by, round(mass, 5) AS mass, round(mx, 5) AS mx, round(my, 5) AS my, round(sum(w*(x-mx)*(x-mx))/mass, 5) AS sxx, round(sum(w*(x-mx)*(y-my))/mass, 5) AS sxy, round(sum(w*(y-my)*(y-my))/mass, 5) AS syy FROM w JOIN m USING (bx, by) GROUP BY bx, by, mass, mx, my")
def soft_weighted_moments(spark, sf):
    return r(moments.weighted_moments(cells(spark, sf), ["bx", "by"], 1 / (1 + F.exp(-(F.col("inten") - 0.04) * 50))), "mass", "mx", "my", "sxx", "sxy", "syy")


@query("conditional_moments", f"{CELL} SELECT bx, by, count(*) FILTER (WHERE inten > 0.05) AS n_hot, round(avg(z) FILTER (WHERE inten > 0.05), 6) AS hot_z, round(avg(z) FILTER (WHERE NOT inten > 0.05), 6) AS cold_z, round(count(*) FILTER (WHERE inten > 0.05) / count(*), 6) AS hot_share FROM c GROUP BY ALL")
def conditional_moments(spark, sf):
    hot = F.col("inten") > 0.05
    return cells(spark, sf).groupBy("bx", "by").agg(F.count(F.when(hot, 1)).alias("n_hot"), rnd(F.avg(F.when(hot, F.col("z"))), 6).alias("hot_z"), rnd(F.avg(F.when(~hot, F.col("z"))), 6).alias("cold_z"), rnd(F.count(F.when(hot, 1)) / F.count("*"), 6).alias("hot_share"))


@query("distribution_shape", f"{PTS}, g AS (SELECT frame, y, y - lag(y) OVER (PARTITION BY frame ORDER BY y) AS gap, avg(y) OVER (PARTITION BY frame) AS m FROM pts), s AS (SELECT frame, count(*) AS n, avg((y-m)**2) AS m2, avg((y-m)**3) AS m3, avg((y-m)**4) AS m4, quantile_cont(y, 0.1) AS q1, quantile_cont(y, 0.25) AS q25, quantile_cont(y, 0.75) AS q75, quantile_cont(y, 0.9) AS q9, max(gap) AS g, max(y) - min(y) AS span FROM g GROUP BY frame) SELECT frame, n, round(m3 / m2**1.5, 5) AS skew, round(m4 / m2**2, 5) AS kurt, round(q9 - q1, 5) AS span80, round(q75 - q25, 5) AS span50, round(g / greatest(span, 1e-12), 6) AS gap_ratio FROM s")
def distribution_shape(spark, sf):
    return r(moments.distribution_shape(points(spark, sf), ["frame"], "y"), "skew", "kurt", "span80", "span50").withColumn("gap_ratio", rnd("gap_ratio", 6))


@query("linear_quantiles", f"{PTS} SELECT frame, round(quantile_cont(y, 0.1), 6) AS q10, round(quantile_cont(y, 0.5), 6) AS q50, round(quantile_cont(y, 0.95), 6) AS q95 FROM pts GROUP BY frame")
def linear_quantiles(spark, sf):
    return r(moments.linear_quantiles(points(spark, sf), ["frame"], "y", [0.1, 0.5, 0.95]), "q10", "q50", "q95", digits=6)


@query("midpoint_quantiles", f"{PTS}, k AS (SELECT frame, y, row_number() OVER (PARTITION BY frame ORDER BY y) AS i, count(*) OVER (PARTITION BY frame) AS n FROM pts), p AS (SELECT frame, y, i, least(greatest(n * 0.25 + 0.5, 1), n) AS a, least(greatest(n * 0.9 + 0.5, 1), n) AS b FROM k) SELECT frame, round(sum(CASE WHEN i = floor(a) THEN y * (1 - (a - floor(a))) WHEN i = floor(a) + 1 THEN y * (a - floor(a)) ELSE 0 END), 5) AS q25, round(sum(CASE WHEN i = floor(b) THEN y * (1 - (b - floor(b))) WHEN i = floor(b) + 1 THEN y * (b - floor(b)) ELSE 0 END), 5) AS q90 FROM p GROUP BY frame")
def midpoint_quantiles(spark, sf):
    return r(moments.midpoint_quantiles(points(spark, sf), ["frame"], "y", [0.25, 0.9]), "q25", "q90")


@query("decile_entropy", f"{PTS}, h AS (SELECT frame, least(9, CAST(floor(10 * (y - min(y) OVER w) / greatest(max(y) OVER w - min(y) OVER w, 1e-12)) AS INT)) AS b FROM pts WINDOW w AS (PARTITION BY frame)), g AS (SELECT frame, b, count(*) AS c FROM h GROUP BY ALL), p AS (SELECT frame, c / sum(c) OVER (PARTITION BY frame) AS p FROM g) SELECT frame, round(-sum(p * ln(p)) / ln(10.0), 6) AS entropy, count(*) / 10.0::DOUBLE AS occupied FROM p GROUP BY frame")
def decile_entropy(spark, sf):
    return r(moments.decile_entropy(points(spark, sf), ["frame"], "y"), "entropy", digits=6)


@query("radial_mass", f"{PTS}, m AS (SELECT frame, avg(x) AS cx, avg(y) AS cy FROM pts GROUP BY frame) SELECT frame, least(9, CAST(floor(sqrt((x-cx)**2 + (y-cy)**2) / 6) AS BIGINT)) AS ring, count(*) AS n FROM pts JOIN m USING (frame) GROUP BY ALL")
def radial_mass(spark, sf):
    p = points(spark, sf)
    m = p.groupBy("frame").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    ring = F.least(F.lit(9), F.floor(F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2) / 6))
    return p.join(m, "frame").groupBy("frame", ring.cast("long").alias("ring")).agg(F.count("*").alias("n"))


@query("finite_median", f"{CELL} SELECT bx, by, count(y) AS n, min(y) AS least, round(median(y), 6) AS median, max(y) AS greatest FROM c GROUP BY ALL")
def finite_median(spark, sf):
    return r(moments.finite_extremes(cells(spark, sf), ["bx", "by"], "y"), "median", digits=6)


@query("density_mode", f"{CELL}, g AS (SELECT frame, bx, by, count(*) AS n FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n DESC, bx, by) AS i FROM g), m AS (SELECT frame, bx AS px, by AS py FROM k WHERE i = 1) SELECT frame, px, py, count(*) FILTER (WHERE bx = px AND by = py) AS core, round(count(*) FILTER (WHERE bx = px AND by = py) / count(*), 6) AS core_share, round(avg(z) FILTER (WHERE bx = px AND by = py), 6) AS core_z FROM c JOIN m USING (frame) GROUP BY ALL")
def density_mode(spark, sf):
    c = cells(spark, sf)
    g = c.groupBy("frame", "bx", "by").agg(F.count("*").alias("n"))
    m = g.groupBy("frame").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("bx").alias("px"), F.col("by").alias("py"))).alias("m")).select("frame", "m.px", "m.py")
    core = (F.col("bx") == F.col("px")) & (F.col("by") == F.col("py"))
    return c.join(m, "frame").groupBy("frame", "px", "py").agg(F.count(F.when(core, 1)).alias("core"), rnd(F.count(F.when(core, 1)) / F.count("*"), 6).alias("core_share"), rnd(F.avg(F.when(core, F.col("z"))), 6).alias("core_z"))


@query("voxel_representative", f"{CELL}, d AS (SELECT frame, bx, by, x, y, z, row_number() OVER (PARTITION BY frame, bx, by ORDER BY (x - (bx * 5 - 2.5))**2 + (y - (by * 10 - 5))**2, x, y, z) AS i FROM c) SELECT frame, bx, by, x, y FROM d WHERE i = 1")
def voxel_representative(spark, sf):
    d = (F.col("x") - (F.col("bx") * 5 - 2.5)) ** 2 + (F.col("y") - (F.col("by") * 10 - 5)) ** 2
    return moments.representatives(cells(spark, sf), ["frame", "bx", "by"], d, ["x", "y", "z"]).select("frame", "bx", "by", "x", "y")


@query("group_members", f"{CELL} SELECT bx, by, list_sort(list(DISTINCT frame))::VARCHAR AS frames, count(DISTINCT frame) AS n FROM c WHERE cls = 'R' GROUP BY ALL")
def group_members(spark, sf):
    g = cells(spark, sf).where("cls = 'R'").groupBy("bx", "by").agg(F.array_sort(F.collect_set("frame")).alias("f"))
    return g.select("bx", "by", F.concat(F.lit("["), F.array_join(F.transform("f", lambda x: x.cast("string")), ", "), F.lit("]")).alias("frames"), F.size("f").cast("long").alias("n"))


@query("block_conflicts", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS blocks FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def block_conflicts(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("blocks")).where("blocks > 1")


@query("plane_fit", f"{PTS}, w AS (SELECT frame, x, y, z, 1.0::DOUBLE AS w FROM pts), m AS (SELECT frame, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x,x) AS xx, covar_pop(x,y) AS xy, covar_pop(y,y) AS yy, covar_pop(x,z) AS xz, covar_pop(y,z) AS yz FROM w GROUP BY frame), s AS (SELECT *, (xz*yy - yz*xy)/(xx*yy - xy*xy) AS b, (yz*xx - xz*xy)/(xx*yy - xy*xy) AS c FROM m) SELECT frame, round(mz - b*mx - c*my, 6) AS a, round(b, 7) AS b, round(c, 7) AS c FROM s")
def plane_fit(spark, sf):
    f = moments.plane_fit(points(spark, sf), ["frame"], F.lit(1.0))
    return f.select("frame", rnd("a", 6).alias("a"), rnd("b", 7).alias("b"), rnd("c", 7).alias("c"))


@query("plane_modes", f"{PTS}, w AS (SELECT frame, x, y, z, inten + 0.01 AS w FROM pts WHERE z <= 0.02 OR z >= 0.06), m AS (SELECT frame, sum(w) AS s, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my, sum(w*z)/sum(w) AS mz FROM w GROUP BY frame), q AS (SELECT frame, s, mx, my, mz, sum(w*(x-mx)**2) AS xx, sum(w*(x-mx)*(y-my)) AS xy, sum(w*(y-my)**2) AS yy, sum(w*(x-mx)*(z-mz)) AS xz, sum(w*(y-my)*(z-mz)) AS yz FROM w JOIN m USING (frame) GROUP BY ALL), f AS (SELECT *, (xz*yy - yz*xy)/(xx*yy - xy*xy) AS b, (yz*xx - xz*xy)/(xx*yy - xy*xy) AS c FROM q), r AS (SELECT frame, s, w, z - mz - b*(x-mx) - c*(y-my) AS r FROM w JOIN f USING (frame)), v AS (SELECT frame, s, r <= 0 AS low, sum(w) AS m, sum(w*r) / sum(w) AS a, sum(w*r*r) AS rr FROM r GROUP BY ALL), g AS (SELECT frame, max(s) AS s, sum(rr) / max(s) AS variance, (sum(rr) - sum(m*a*a)) / max(s) AS within, min(m) / max(s) AS balance, max(a) - min(a) AS apart, count(*) AS k FROM v GROUP BY frame) SELECT frame, round(variance, 9) AS variance, round(within, 9) AS within, round(apart, 7) AS apart, k = 2 AND balance > 0.15 AND apart > 0.03 AND within < 0.35 * variance AS two_modes FROM g")
def plane_modes(spark, sf):
    """Whether the heights about a weighted plane fall into two modes."""
    p = points(spark, sf).where("z <= 0.02 OR z >= 0.06")
    m = moments.plane_modes(p, ["frame"], F.col("inten") + 0.01, 0.03, 0.35)
    return m.select("frame", rnd("variance", 9).alias("variance"), rnd("within", 9).alias("within"), rnd("apart", 7).alias("apart"), "two_modes")


_D = "(PARTITION BY frame)"
_SHAPE = f"""{PTS}, g AS (SELECT frame, x / 10 AS x, z AS y, y AS z FROM pts), m AS (SELECT *, x - avg(x) OVER {_D} AS dx, y - avg(y) OVER {_D} AS dy, z - avg(z) OVER {_D} AS dz, min(z) OVER {_D} AS lo, max(z) OVER {_D} AS hi, count(*) OVER {_D} AS n FROM g), q AS (SELECT *, (z - lo) / greatest(hi - lo, 1e-10) AS u, dx*dx + dy*dy AS rad, (z - lo) / greatest(hi - lo, 1e-10) - lag((z - lo) / greatest(hi - lo, 1e-10)) OVER (PARTITION BY frame ORDER BY z) AS gap FROM m), b AS (SELECT *, least(10, greatest(1, floor(floor(u * 1e10 + 0.5) / 1e10 * 10) + 1)) AS bin, avg(rad) OVER {_D} AS r2, avg(dz*dz) OVER {_D} AS v, avg(dx*dz) OVER {_D} AS xz, avg(dy*dz) OVER {_D} AS yz FROM q), t AS (SELECT *, dx - xz / greatest(v, 1e-14) * dz AS tx, dy - yz / greatest(v, 1e-14) * dz AS ty FROM b), h AS (SELECT frame, 0 - sum(p * ln(p)) / ln(10) AS entropy, max(p) AS mode, count(*) AS bins FROM (SELECT frame, bin, count(*) / max(n)::DOUBLE AS p FROM t GROUP BY ALL) GROUP BY frame),
s AS (SELECT frame, max(n) AS n, avg(dz**3) / greatest(avg(dz*dz)**1.5, 1e-15) AS skew, avg(dz**4) / greatest(avg(dz*dz)**2, 1e-20) AS kurt, avg(rad*rad) / greatest(avg(rad)**2, 1e-20) AS rkurt, avg(u) AS level, avg(dz*dz) / greatest(max(hi - lo)**2, 1e-20) AS spread, avg(CASE WHEN u < 0.25 THEN 1.0 ELSE 0.0 END) AS low, avg(CASE WHEN u BETWEEN 0.25 AND 0.75 THEN 1.0 ELSE 0.0 END) AS mid, avg(CASE WHEN u > 0.75 THEN 1.0 ELSE 0.0 END) AS high, quantile_cont(u, 0.1) AS q1, quantile_cont(u, 0.25) AS q2, quantile_cont(u, 0.5) AS q3, quantile_cont(u, 0.75) AS q4, quantile_cont(u, 0.9) AS q5, max(gap) AS gap, corr(dz, rad) AS coupling, quantile_cont(sqrt(tx*tx + ty*ty), 0.9) AS t90, max(sqrt(tx*tx + ty*ty)) AS tmax, avg((tx*tx + ty*ty)**2) / greatest(avg(tx*tx + ty*ty)**2, 1e-20) AS tkurt, least(1, sqrt(avg((dz*dz - v)*tx)**2 + avg((dz*dz - v)*ty)**2) / sqrt(avg((dz*dz - v)**2) * avg(tx*tx + ty*ty))) AS bow FROM t GROUP BY frame)"""
_SHAPE_NAMES = {"skew": "skew", "kurt": "kurt", "radial_kurt": "rkurt", "level": "level", "spread": "spread", "low": "low", "mid": "mid", "high": "high", "span50": "q4 - q2", "span80": "q5 - q1", "median": "q3", "tilt": "(q5 + q1 - 2 * q3) / greatest(q5 - q1, 1e-10)", "gap": "gap", "entropy": "entropy", "mode": "mode", "bins": "bins / least(n, 10)::DOUBLE", "coupling": "coupling", "lean90": "t90", "lean_max": "tmax", "lean_kurt": "tkurt", "bow": "bow"}


@query("higher_moments", f"{_SHAPE} SELECT frame, {', '.join(f'round({e}, 5) AS {k}' for k, e in _SHAPE_NAMES.items())} FROM s JOIN h USING (frame)")
def higher_moments(spark, sf):
    """The 21 measures of a population's shape."""
    p = points(spark, sf).select("frame", (F.col("x") / 10).alias("x"), F.col("z").alias("y"), F.col("y").alias("z"))
    return r(moments.higher_moments(p, ["frame"]), *_SHAPE_NAMES).select("frame", *_SHAPE_NAMES)


@query("height_order", f"{PTS}, k AS (SELECT frame, y, y - lag(y) OVER (PARTITION BY frame ORDER BY y) AS gap, avg(y) OVER {_D} AS m, row_number() OVER (PARTITION BY frame ORDER BY y) AS i, count(*) OVER {_D} AS n FROM pts), q AS (SELECT frame, max(gap) AS gap, max(y) - min(y) AS span, avg((y-m)**2) AS m2, avg((y-m)**3) AS m3, avg((y-m)**4) AS m4, {', '.join(f'sum(CASE WHEN i = floor(greatest(least(n * {p} + 0.5, n), 1)) THEN y * (1 - (greatest(least(n * {p} + 0.5, n), 1) - floor(greatest(least(n * {p} + 0.5, n), 1)))) WHEN i = floor(greatest(least(n * {p} + 0.5, n), 1)) + 1 THEN y * (greatest(least(n * {p} + 0.5, n), 1) - floor(greatest(least(n * {p} + 0.5, n), 1))) ELSE 0 END) AS q{round(p * 100)}' for p in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM k GROUP BY frame) SELECT frame, round(gap / span, 6) AS gap_ratio, round((q75 - q25) / span, 6) AS quartile_ratio, round(m3 / m2**1.5, 5) AS skew, round(m4 / m2**2, 5) AS kurt, round(q50 - q5, 5) AS lower_half, round(q95 - q50, 5) AS upper_half FROM q")
def height_order(spark, sf):
    h = moments.height_order(points(spark, sf), ["frame"], "y")
    return h.select("frame", rnd("gap_ratio", 6).alias("gap_ratio"), rnd("quartile_ratio", 6).alias("quartile_ratio"), *(rnd(c, 5).alias(c) for c in ("skew", "kurt", "lower_half", "upper_half")))


@query("balanced_slope", f"{PTS}, o AS (SELECT frame, x, y, (coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y)) / 2 AS g FROM (SELECT DISTINCT frame, x, y FROM pts) WINDOW w AS (PARTITION BY frame ORDER BY y, x)), m AS (SELECT frame, sum(g*x)/sum(g) AS mx, sum(g*y)/sum(g) AS my FROM o GROUP BY frame) SELECT frame, round(sum(g*(x-mx)*(y-my))/sum(g*(y-my)*(y-my)), 6) AS slope FROM o JOIN m USING (frame) GROUP BY frame")
def balanced_slope(spark, sf):
    w = Window.partitionBy("frame").orderBy("y", "x")
    o = points(spark, sf).select("frame", "x", "y").distinct().withColumn("g", (F.coalesce(F.lead("y").over(w), F.col("y")) - F.coalesce(F.lag("y").over(w), F.col("y"))) / 2)
    m = moments.weighted_moments(o, ["frame"], F.col("g"))
    return m.select("frame", rnd(F.col("sxy") / F.col("syy"), 6).alias("slope"))


@query("least_squares", f"{PTS} SELECT frame, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 5) AS intercept, count(*) AS n FROM pts GROUP BY frame")
def least_squares(spark, sf):
    return moments.least_squares(points(spark, sf), ["frame"], "x", "y").select("frame", rnd("slope", 6).alias("slope"), rnd("intercept", 5).alias("intercept"), "n")


@query("normalised_weights", f"{PTS} SELECT frame, cls, round(sum(z), 4) AS w, round(CASE WHEN sum(sum(z)) OVER (PARTITION BY frame) = 0 THEN 1.0 / count(*) OVER (PARTITION BY frame) ELSE sum(z) / sum(sum(z)) OVER (PARTITION BY frame) END, 6) AS share FROM pts GROUP BY frame, cls")
def normalised_weights(spark, sf):
    g = points(spark, sf).groupBy("frame", "cls").agg(F.sum("z").alias("w"))
    return moments.normalised_weights(g, ["frame"], "w").select("frame", "cls", rnd("w", 4).alias("w"), rnd("share", 6).alias("share"))


@query("class_summary", "SELECT p_type AS cls, count(l_orderkey) AS n, round(coalesce(sum(l_quantity), 0), 2) AS mass FROM (SELECT DISTINCT p_type FROM part) t LEFT JOIN (SELECT p.p_type AS ty, l_orderkey, l_quantity FROM lineitem JOIN part p ON l_partkey = p_partkey WHERE p_size > 49) s ON t.p_type = s.ty GROUP BY p_type")
def class_summary(spark, sf):
    part = table(spark, sf, "part")
    used = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(part.where("p_size > 49").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("cls")), "l_partkey")
    g = used.groupBy("cls").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("mass"))
    return part.select(F.col("p_type").alias("cls")).distinct().join(g, "cls", "left").select("cls", F.coalesce("n", F.lit(0)).alias("n"), rnd(F.coalesce("mass", F.lit(0.0)), 2).alias("mass"))


@query("voxel_downsample", f"{PTS} SELECT CAST(floor(x/2) AS BIGINT) AS vx, CAST(floor(y/2) AS BIGINT) AS vy, count(*) AS n, round(avg(x), 5) AS x, round(avg(y), 5) AS y FROM pts GROUP BY ALL")
def voxel_downsample(spark, sf):
    g = points(spark, sf).groupBy(F.floor(F.col("x") / 2).alias("vx"), F.floor(F.col("y") / 2).alias("vy")).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return r(g, "x", "y")


@query("category_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def category_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("monomial_moments", f"{PTS} SELECT frame, round(avg(x*x), 4) AS xx, round(avg(x*y), 4) AS xy, round(avg(x*x*y), 3) AS xxy, round(avg(y*y*z), 4) AS yyz FROM pts GROUP BY frame")
def monomial_moments(spark, sf):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return points(spark, sf).groupBy("frame").agg(rnd(F.avg(x * x), 4).alias("xx"), rnd(F.avg(x * y), 4).alias("xy"), rnd(F.avg(x * x * y), 3).alias("xxy"), rnd(F.avg(y * y * z), 4).alias("yyz"))


@query("isolation_fraction", f"{CELL} SELECT bx, by, round(count(*) FILTER (WHERE abs(x - (bx * 5 - 2.5)) <= 1 AND abs(y - (by * 10 - 5)) <= 2) / count(*), 6) AS isolation FROM c GROUP BY ALL")
def isolation_fraction(spark, sf):
    core = (F.abs(F.col("x") - (F.col("bx") * 5 - 2.5)) <= 1) & (F.abs(F.col("y") - (F.col("by") * 10 - 5)) <= 2)
    return cells(spark, sf).groupBy("bx", "by").agg(rnd(F.count(F.when(core, 1)) / F.count("*"), 6).alias("isolation"))


@query("column_layers", f"{PTS}, l AS (SELECT DISTINCT frame, CAST(floor(x/5) AS BIGINT) AS bx, CAST(floor(y/3) AS BIGINT) AS k FROM pts), g AS (SELECT *, k - row_number() OVER (PARTITION BY frame, bx ORDER BY k) AS g FROM l), n AS (SELECT frame, bx, g, count(*) AS len FROM g GROUP BY ALL) SELECT frame, bx, sum(len)::BIGINT AS layers, max(len) AS longest_run FROM n GROUP BY ALL")
def column_layers(spark, sf):
    w = Window.partitionBy("frame", "bx").orderBy("k")
    layers = points(spark, sf).select("frame", F.floor(F.col("x") / 5).alias("bx"), F.floor(F.col("y") / 3).alias("k")).distinct()
    g = layers.withColumn("g", F.col("k") - F.row_number().over(w)).groupBy("frame", "bx", "g").agg(F.count("*").alias("len"))
    return g.groupBy("frame", "bx").agg(F.sum("len").alias("layers"), F.max("len").alias("longest_run"))


@query("mass_allocation", f"{CELL}, g AS (SELECT cls, bx, avg(inten) AS a FROM c GROUP BY ALL) SELECT cls, bx, round(a / sum(a) OVER (PARTITION BY cls) * 100, 6) AS mass FROM g")
def mass_allocation(spark, sf):
    g = cells(spark, sf).groupBy("cls", "bx").agg(F.avg("inten").alias("a"))
    return moments.normalised_weights(g, ["cls"], "a").select("cls", "bx", rnd(F.col("share") * 100, 6).alias("mass"))


@query("publication_mass", f"{PTS}, b AS (SELECT cls, frame % 16 AS block, count(*) AS n FROM pts WHERE x > 48 GROUP BY ALL) SELECT cls, sum(n)::BIGINT AS n, count(*) AS blocks, round(sum(n) * CASE WHEN count(*) >= 8 THEN 1.0 ELSE count(*) / 8.0 END, 4) AS mass FROM b GROUP BY cls")
def publication_mass(spark, sf):
    b = points(spark, sf).where("x > 48").groupBy("cls", (F.col("frame") % 16).alias("block")).agg(F.count("*").alias("n"))
    g = b.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"))
    return g.select("cls", "n", "blocks", rnd(F.col("n") * F.when(F.col("blocks") >= 8, 1.0).otherwise(F.col("blocks") / 8.0), 4).alias("mass"))
