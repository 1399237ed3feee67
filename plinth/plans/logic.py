"""Queries: compiled rules, gates, tree ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import binning, rules, trees
from plinth.plans.catalog import PTS, points, query, rnd, table

RULES = {"allOf": [{"alternatives": [[{"feature": "x", "operator": ">=", "threshold": 20}], [{"feature": "inten", "operator": ">", "threshold": 0.06}]]}, {"alternatives": [[{"feature": "y", "operator": "<=", "threshold": 60}, {"feature": "z", "operator": ">", "threshold": 0.02}]]}]}


@query("rule_engine", f"{PTS} SELECT ok, ln, x, y, z FROM pts WHERE (x >= 20 OR inten > 0.06) AND (y <= 60 AND z > 0.02)")
def rule_engine(spark, sf):
    return points(spark, sf).where(rules.compile_rules(RULES)).select("ok", "ln", "x", "y", "z")


@query("class_gates", f"{PTS}, g AS (SELECT frame, cls, count(*) AS n, avg(z) AS mz, stddev_pop(y) AS sy FROM pts GROUP BY ALL) SELECT frame, cls, n FROM g WHERE (cls = 'R' AND mz >= 0.05) OR (cls = 'A' AND sy <= 30) OR (cls = 'N' AND n > 300)")
def class_gates(spark, sf):
    g = points(spark, sf).groupBy("frame", "cls").agg(F.count("*").alias("n"), F.avg("z").alias("mz"), F.stddev_pop("y").alias("sy"))
    gates = {"R": [("mz", ">=", 0.05)], "A": [("sy", "<=", 30)], "N": [("n", ">", 300)]}
    keep = F.lit(False)
    for cls, predicates in gates.items():
        keep = keep | ((F.col("cls") == cls) & rules.conjunction([dict(zip(("feature", "operator", "threshold"), p)) for p in predicates]))
    return g.where(keep).select("frame", "cls", "n")


@query("candidate_context", f"{PTS}, c AS (SELECT frame, CAST(floor(x / 5) AS BIGINT) AS bx, CAST(floor(y / 10) AS BIGINT) AS by, count(*) AS n, max(inten) AS hot FROM pts GROUP BY ALL), s AS (SELECT * FROM c WHERE n >= 8 AND hot >= 0.08) SELECT DISTINCT c.frame, c.bx, c.by FROM c JOIN s ON c.frame = s.frame AND abs(c.bx - s.bx) <= 1 AND abs(c.by - s.by) <= 1")
def candidate_context(spark, sf):
    c = points(spark, sf).groupBy("frame", F.floor(F.col("x") / 5).alias("bx"), F.floor(F.col("y") / 10).alias("by")).agg(F.count("*").alias("n"), F.max("inten").alias("hot"))
    return c.select("frame", "bx", "by").join(binning.dilate(c.where("n >= 8 AND hot >= 0.08"), ["frame"], 1), ["frame", "bx", "by"], "left_semi")


@query("score_threshold", "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 3000)), 6) AS score FROM customer WHERE 1 / (1 + exp(-c_acctbal / 3000)) >= CASE c_mktsegment WHEN 'BUILDING' THEN 0.9 WHEN 'MACHINERY' THEN 0.7 ELSE 0.8 END")
def score_threshold(spark, sf):
    limits = spark.createDataFrame([("BUILDING", 0.9), ("MACHINERY", 0.7)], "c_mktsegment string, own double")
    c = table(spark, sf, "customer").withColumn("s", 1 / (1 + F.exp(-F.col("c_acctbal") / 3000))).join(F.broadcast(limits), "c_mktsegment", "left")
    return c.where(F.col("s") >= F.coalesce("own", F.lit(0.8))).select("c_custkey", rnd("s", 6).alias("score"))


@query("availability", "SELECT event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value > 25 END, true) AS available FROM events")
def availability(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce(F.when(F.col("event_id") % 7 != 0, F.col("value") > 25), F.lit(True)).alias("available"))


@query("lattice_constant", "SELECT p_partkey, CASE WHEN p_size <= 20 THEN 12 ELSE 3 END::DOUBLE AS least_points FROM part")
def lattice_constant(spark, sf):
    """A constant by the lattice's spacing; a spacing without one would fail the query."""
    from plinth.operators.binning import spacing_constant

    p = table(spark, sf, "part").withColumn("spacing", F.when(F.col("p_size") <= 20, 0.6).otherwise(0.3))
    return p.select("p_partkey", spacing_constant(F.col("spacing"), {0.6: 12, 0.3: 3}).alias("least_points"))


@query("class_parameters", "WITH o AS (SELECT * FROM (VALUES ('BRASS', 4), ('STEEL', 7)) t(k, own)) SELECT p_partkey, coalesce(own, 5) AS parameter FROM part LEFT JOIN o ON ends_with(p_type, k)")
def class_parameters(spark, sf):
    own = spark.createDataFrame([("BRASS", 4), ("STEEL", 7)], "k string, own int")
    p = table(spark, sf, "part").withColumn("k", F.element_at(F.split("p_type", " "), -1))
    return p.join(F.broadcast(own), "k", "left").select("p_partkey", F.coalesce("own", F.lit(5)).alias("parameter"))


#: Two trees over x, y and z.
FOREST = {"kind": "forest", "roots": [0, 3], "left": [1, 0, 0, 4, 0, 6, 0, 0], "right": [2, 0, 0, 5, 0, 7, 0, 0], "feature": [0, 0, 0, 1, 0, 2, 0, 0], "threshold": [25.0, 0, 0, 50.0, 0, 0.05, 0, 0], "value": [0, 0.2, 0.9, 0, 0.1, 0, 0.4, 0.8], "leaf": [0, 1, 1, 0, 1, 0, 1, 1]}
_TREES = "((CASE WHEN x <= 25 THEN 0.2 ELSE 0.9 END) + (CASE WHEN y::FLOAT::DOUBLE <= 50 THEN 0.1 WHEN z::FLOAT::DOUBLE <= 0.05 THEN 0.4 ELSE 0.8 END)) / 2"


@query("tree_ensemble", f"{PTS} SELECT frame, round(avg({_TREES}), 6) AS mean_score, count(*) AS n FROM pts GROUP BY frame")
def tree_ensemble(spark, sf):
    s = trees.score(points(spark, sf), FOREST, ["x", "y", "z"])
    return s.groupBy("frame").agg(rnd(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n"))


@query("tree_expression", f"{PTS} SELECT frame, round(avg({_TREES}), 6) AS mean_score FROM pts GROUP BY frame")
def tree_expression(spark, sf):
    return points(spark, sf).groupBy("frame").agg(rnd(F.avg(trees.score_column(FOREST, ["x", "y", "z"])), 6).alias("mean_score"))
