"""Queries on sensor streams: as-of, bracket, interval and band joins, islands, sweeps, integrals and smoothing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plinth.operators import asof, islands, ranges, signal
from plinth.plans.catalog import EV, query, rnd, stream, table

SIDES = f"{EV}, l AS (SELECT * FROM ev WHERE event_type = 'view'), r AS (SELECT * FROM ev WHERE event_type = 'click')"
BOTH = f"{SIDES}, a AS (SELECT l.*, r.t AS lo_t, r.value AS lo_v FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t), b AS (SELECT a.*, r.t AS hi_t, r.value AS hi_v FROM a ASOF LEFT JOIN r ON a.user_id = r.user_id AND a.t <= r.t)"


def sides(spark, sf):
    s = stream(spark, sf)
    cols = ["event_id", "user_id", "t", "value"]
    return s.where("event_type = 'view'").select(*cols), s.where("event_type = 'click'").select(*cols)


@query("asof_backward", f"{BOTH} SELECT event_id, round(lo_t, 6) AS match_t, lo_v AS match_value FROM b")
def asof_backward(spark, sf):
    a, b = sides(spark, sf)
    return asof.backward(a, b, ["user_id"], "t", ["value"]).select("event_id", rnd("match.t", 6).alias("match_t"), F.col("match.value").alias("match_value"))


@query("asof_backward_max_age", f"{BOTH} SELECT event_id, CASE WHEN t - lo_t <= 20000 THEN lo_v END AS match_value FROM b")
def asof_backward_max_age(spark, sf):
    a, b = sides(spark, sf)
    return asof.backward(a, b, ["user_id"], "t", ["value"], 20000).select("event_id", F.col("match.value").alias("match_value"))


@query("asof_forward", f"{BOTH} SELECT event_id, hi_v AS match_value FROM b")
def asof_forward(spark, sf):
    a, b = sides(spark, sf)
    return asof.forward(a, b, ["user_id"], "t", ["value"]).select("event_id", F.col("match.value").alias("match_value"))


_NEAR = "CASE WHEN hi_t IS NULL OR t - lo_t {op} hi_t - t THEN lo_{c} ELSE hi_{c} END"


@query("asof_nearest_earlier", f"{BOTH} SELECT event_id, {_NEAR.format(op='<=', c='v')} AS match_value, round({_NEAR.format(op='<=', c='t')} - t, 6) AS dt FROM b")
def asof_nearest_earlier(spark, sf):
    a, b = sides(spark, sf)
    return asof.nearest(a, b, ["user_id"], "t", ["value"]).select("event_id", F.col("match.value").alias("match_value"), rnd("dt", 6).alias("dt"))


@query("asof_nearest_later", f"{BOTH} SELECT event_id, {_NEAR.format(op='<', c='v')} AS match_value, round(abs({_NEAR.format(op='<', c='t')} - t), 6) AS dt FROM b")
def asof_nearest_later(spark, sf):
    a, b = sides(spark, sf)
    return asof.nearest(a, b, ["user_id"], "t", ["value"], "later").select("event_id", F.col("match.value").alias("match_value"), rnd(F.abs("dt"), 6).alias("dt"))


@query("asof_two_sides", f"{EV}, l AS (SELECT * FROM ev WHERE event_type = 'view'), a AS (SELECT l.event_id, l.user_id, l.t, r.value AS click FROM l ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.t >= r.t) SELECT a.event_id, a.click, r.value AS purchase FROM a ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'purchase') r ON a.user_id = r.user_id AND a.t >= r.t")
def asof_two_sides(spark, sf):
    a, b = sides(spark, sf)
    p = stream(spark, sf).where("event_type = 'purchase'").select("user_id", "t", "value")
    one = asof.backward(a, b, ["user_id"], "t", ["value"]).select("event_id", "user_id", "t", F.col("match.value").alias("click"))
    return asof.backward(one, p, ["user_id"], "t", ["value"]).select("event_id", "click", F.col("match.value").alias("purchase"))


@query("bracket_interpolate", f"{BOTH} SELECT event_id, coalesce(hi_t - lo_t <= 200000, false) AS ok, round(CASE WHEN hi_t > lo_t THEN (1 - (t - lo_t) / (hi_t - lo_t)) * lo_v + (t - lo_t) / (hi_t - lo_t) * hi_v ELSE lo_v + 0 * hi_v END, 5) AS value FROM b")
def bracket_interpolate(spark, sf):
    a, b = sides(spark, sf)
    return asof.interpolated(a.drop("value"), b, ["user_id"], "t", ["value"], 200000).select("event_id", "ok", rnd("value", 5).alias("value"))


_ANG = "atan2(sin(lo_v + w * atan2(sin(hi_v - lo_v), cos(hi_v - lo_v))), cos(lo_v + w * atan2(sin(hi_v - lo_v), cos(hi_v - lo_v))))"


@query("bracket_angle", f"{BOTH}, c AS (SELECT *, CASE WHEN hi_t > lo_t THEN (t - lo_t) / (hi_t - lo_t) ELSE 0 END AS w FROM b) SELECT event_id, round({_ANG}, 5) AS value FROM c")
def bracket_angle(spark, sf):
    a, b = sides(spark, sf)
    return asof.interpolated(a.drop("value"), b, ["user_id"], "t", ["value"], 200000, ("value",)).select("event_id", rnd("value", 5).alias("value"))


@query("neighbour_segments", f"{BOTH} SELECT event_id, CASE WHEN CAST(floor(lo_v / 20) AS BIGINT) = CAST(floor(hi_v / 20) AS BIGINT) AND floor(lo_v / 20) > 0 THEN CAST(floor(lo_v / 20) AS BIGINT) ELSE 0 END AS segment FROM b")
def neighbour_segments(spark, sf):
    a, b = sides(spark, sf)
    j = asof.bracket(a, b.withColumn("seg", F.floor(F.col("value") / 20)), ["user_id"], "t", ["seg"])
    return j.select("event_id", F.when((F.col("lo.seg") == F.col("hi.seg")) & (F.col("lo.seg") > 0), F.col("lo.seg")).otherwise(F.lit(0)).alias("segment"))


def spans(spark, sf):
    return stream(spark, sf).where("event_type = 'error'").select("user_id", F.col("event_id").alias("span_id"), F.col("t").alias("b"), (F.col("t") + 30000).alias("e"))


SPANS = f"{EV}, s AS (SELECT user_id, event_id AS span_id, t AS b, t + 30000 AS e FROM ev WHERE event_type = 'error')"


@query("interval_join_last", f"{SPANS}, j AS (SELECT ev.event_id, span_id, row_number() OVER (PARTITION BY ev.event_id ORDER BY b DESC, span_id DESC) AS i FROM ev JOIN s ON ev.user_id = s.user_id AND t BETWEEN b AND e WHERE event_type = 'view') SELECT event_id, span_id FROM j WHERE i = 1")
def interval_join_last(spark, sf):
    v = stream(spark, sf).where("event_type = 'view'").select("event_id", "user_id", "t")
    j = ranges.interval_join(v, spans(spark, sf), ["user_id"], "t", "b", "e", 30000)
    return j.groupBy("event_id").agg(F.max(F.struct("b", "span_id")).alias("m")).select("event_id", "m.span_id")


@query("interval_join_first", f"{SPANS}, j AS (SELECT ev.event_id, span_id, row_number() OVER (PARTITION BY ev.event_id ORDER BY b, span_id) AS i FROM ev JOIN s ON ev.user_id = s.user_id AND t BETWEEN b AND e WHERE event_type = 'view') SELECT event_id, span_id FROM j WHERE i = 1")
def interval_join_first(spark, sf):
    v = stream(spark, sf).where("event_type = 'view'").select("event_id", "user_id", "t")
    j = ranges.interval_join(v, spans(spark, sf), ["user_id"], "t", "b", "e", 30000)
    return j.groupBy("event_id").agg(F.min(F.struct("b", "span_id")).alias("m")).select("event_id", "m.span_id")


@query("band_join", f"{SIDES}, j AS (SELECT l.event_id, r.value FROM l JOIN r ON l.user_id = r.user_id AND abs(l.t - r.t) <= 40000) SELECT event_id, count(*) AS n, round(avg(value), 5) AS mean FROM j GROUP BY event_id HAVING count(*) >= 2")
def band_join(spark, sf):
    a, b = sides(spark, sf)
    return ranges.band_join(a, b, ["user_id"], "t", 40000).groupBy("event_id").agg(F.count("*").alias("n"), rnd(F.avg("r_value"), 5).alias("mean")).where("n >= 2")


@query("first_difference", f"{EV} SELECT event_id, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us), -1) AS dt FROM ev WHERE event_type = 'view'")
def first_difference(spark, sf):
    return signal.difference(stream(spark, sf).where("event_type = 'view'"), ["user_id"], ["us"], "us", "dt").select("event_id", F.coalesce("dt", F.lit(-1)).alias("dt"))


@query("gap_islands", f"{EV}, m AS (SELECT *, CASE WHEN us - lag(us) OVER w > 3600000000 THEN 1 ELSE 0 END AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY us) AS island FROM m) SELECT user_id, island::BIGINT AS island, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM g GROUP BY ALL")
def gap_islands(spark, sf):
    return islands.gap_islands(stream(spark, sf), ["user_id"], "us", 3600000000).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("continuous_support", f"{EV}, m AS (SELECT *, CASE WHEN us - lag(us) OVER w > 36000000000 THEN 1 ELSE 0 END AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY us) AS island FROM m), k AS (SELECT *, count(*) OVER w AS c, max(us) OVER w - min(us) OVER w AS s FROM g WINDOW w AS (PARTITION BY user_id, island)) SELECT event_id FROM k WHERE c >= 4 AND s >= 50000000000")
def continuous_support(spark, sf):
    return islands.continuous_support(stream(spark, sf), ["user_id"], "us", 36000000000, 4, 50000000000).select("event_id")


_RUNS = "m AS (SELECT *, value > 30 AS label, CASE WHEN (value > 30) = lag(value > 30) OVER w THEN 0 ELSE 1 END AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY us) AS run FROM m), q AS (SELECT user_id, run, label, min(us) AS b, max(us) AS e, count(*) AS n FROM g GROUP BY ALL)"


@query("category_runs", f"{EV}, {_RUNS} SELECT user_id, run::BIGINT AS run, label, b AS \"begin\", e AS \"end\", n FROM q")
def category_runs(spark, sf):
    return islands.runs(stream(spark, sf), ["user_id"], ["us"], F.col("value") > 30)


@query("true_runs_joined", f"{EV}, {_RUNS}, t AS (SELECT user_id, b, e, CASE WHEN b > max(e) OVER (PARTITION BY user_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 7200000000 OR row_number() OVER (PARTITION BY user_id ORDER BY b, e) = 1 THEN 1 ELSE 0 END AS nw FROM q WHERE label), u AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS isl FROM t) SELECT user_id, min(b) - 1000000 AS \"begin\", max(e) + 1000000 AS \"end\", count(*) AS n FROM u GROUP BY user_id, isl HAVING max(e) - min(b) >= 3600000000")
def true_runs_joined(spark, sf):
    return islands.true_runs(stream(spark, sf), ["user_id"], ["us"], F.col("value") > 30, 3600000000, 7200000000, 1000000)


@query("run_medians", f"{EV}, {_RUNS}, j AS (SELECT g.user_id, g.run, g.value FROM g JOIN q USING (user_id, run) WHERE q.label AND q.n >= 3) SELECT user_id, run::BIGINT AS run, round(median(value), 5) AS med, count(*) AS n FROM j GROUP BY user_id, run")
def run_medians(spark, sf):
    w = Window.partitionBy("user_id").orderBy("us")
    s = stream(spark, sf).withColumn("label", F.col("value") > 30)
    s = s.withColumn("n", F.when(F.col("label") == F.lag("label").over(w), 0).otherwise(1)).withColumn("run", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.where("label").groupBy("user_id", "run").agg(rnd(F.median("value"), 5).alias("med"), F.count("*").alias("n")).where("n >= 3")


@query("merged_intervals", f"{SPANS}, m AS (SELECT *, CASE WHEN b > max(e) OVER (PARTITION BY user_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY user_id ORDER BY b, e) = 1 THEN 1 ELSE 0 END AS n FROM s), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT user_id, island::BIGINT AS island, round(min(b), 5) AS b, round(max(e), 5) AS e, count(*) AS n FROM g GROUP BY user_id, island")
def merged_intervals(spark, sf):
    m = ranges.merge_intervals(spans(spark, sf), ["user_id"], "b", "e")
    return m.withColumns({"b": rnd("b", 5), "e": rnd("e", 5)})


@query("sweep_coverage", f"{SPANS}, pp AS (SELECT user_id, b AS p, 1 AS s FROM s UNION ALL SELECT user_id, e, -1 FROM s), n AS (SELECT user_id, p, sum(s) AS s FROM pp GROUP BY ALL), c AS (SELECT user_id, p, lead(p) OVER w AS nx, sum(s) OVER (PARTITION BY user_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS cover FROM n WINDOW w AS (PARTITION BY user_id ORDER BY p)) SELECT user_id, cover::BIGINT AS cover, round(sum(nx - p), 3) AS length, count(*) AS n FROM c WHERE cover > 0 AND nx IS NOT NULL GROUP BY ALL")
def sweep_coverage(spark, sf):
    s = ranges.sweep(spans(spark, sf), ["user_id"], "b", "e")
    return s.groupBy("user_id", "cover").agg(rnd(F.sum(F.col("end") - F.col("begin")), 3).alias("length"), F.count("*").alias("n"))


@query("count_within", f"{EV} SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY value RANGE BETWEEN 0.25 PRECEDING AND 0.25 FOLLOWING) AS within FROM ev")
def count_within(spark, sf):
    return signal.count_within(stream(spark, sf), ["event_type"], "value", 0.25).select("event_id", "within")


@query("box_mean", f"{EV} SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7, 5) AS smooth FROM ev")
def box_mean(spark, sf):
    return signal.box_mean(stream(spark, sf), ["user_id"], ["us"], "value", 3).select("event_id", rnd("smooth", 5).alias("smooth"))


@query("gradient", f"{EV}, g AS (SELECT event_id, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b, value - lag(value) OVER w AS dv, lead(value) OVER w - value AS uv FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT event_id, round(CASE WHEN a IS NULL THEN uv / b WHEN b IS NULL THEN dv / a ELSE (dv / a * b + uv / b * a) / (a + b) END * 1000, 5) AS gradient FROM g")
def gradient(spark, sf):
    return signal.gradient(stream(spark, sf), ["user_id"], "t", "value").select("event_id", rnd(F.col("gradient") * 1000, 5).alias("gradient"))


@query("unwrapped_angle", f"{EV}, d AS (SELECT event_id, user_id, us, value, coalesce(floor((value - lag(value) OVER w + pi()) / (2 * pi())), 0) AS k FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)) SELECT event_id, round(value - 2 * pi() * sum(k) OVER (PARTITION BY user_id ORDER BY us), 5) AS unwrapped FROM d")
def unwrapped_angle(spark, sf):
    return signal.unwrapped(stream(spark, sf), ["user_id"], ["us"], "value").select("event_id", rnd("unwrapped", 5).alias("unwrapped"))


@query("trapezoid_integral", f"{EV}, s AS (SELECT event_id, user_id, t, coalesce((t - lag(t) OVER w) * (value + lag(value) OVER w) / 2, 0) AS s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT event_id, round(sum(s) OVER (PARTITION BY user_id ORDER BY t), 2) AS integral FROM s")
def trapezoid_integral(spark, sf):
    return signal.trapezoid(stream(spark, sf), ["user_id"], "t", "value").select("event_id", rnd("integral", 2).alias("integral"))


@query("anchored_integral", f"{EV}, s AS (SELECT event_id, user_id, t, coalesce((t - lag(t) OVER w) * (value + lag(value) OVER w) / 2, 0) AS s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t) AS integral FROM s) SELECT event_id, round(integral - last_value(integral) OVER w * CASE WHEN max(t) OVER w > min(t) OVER w THEN (t - min(t) OVER w) / (max(t) OVER w - min(t) OVER w) ELSE 0 END, 2) AS anchored FROM i WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def anchored_integral(spark, sf):
    i = signal.trapezoid(stream(spark, sf), ["user_id"], "t", "value")
    return signal.anchored(i, ["user_id"], "t", "integral", F.lit(0.0)).select("event_id", rnd("anchored", 2).alias("anchored"))


@query("spike_repair", f"{EV}, n AS (SELECT event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)) SELECT event_id, round(CASE WHEN abs(value - a) > 20 AND abs(value - b) > 20 AND (value - a) * (value - b) > 0 AND abs(a - b) <= 20 THEN (a + b) / 2 ELSE value END, 5) AS repaired FROM n")
def spike_repair(spark, sf):
    return signal.repair_spikes(stream(spark, sf), ["user_id"], ["us"], "value", 20.0).select("event_id", rnd("repaired", 5).alias("repaired"))


@query("largest_gap", f"{EV}, d AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS g FROM ev) SELECT user_id, max(g) AS largest FROM d GROUP BY user_id")
def largest_gap(spark, sf):
    return signal.difference(stream(spark, sf), ["user_id"], ["us"], "us", "g").groupBy("user_id").agg(F.max("g").alias("largest"))


@query("kernel_smooth", f"{EV}, l AS (SELECT * FROM ev WHERE event_type = 'view'), j AS (SELECT l.event_id, exp(-0.5 * ((l.t - r.t) / 20000) ** 2) AS k, r.value FROM l JOIN l r ON l.user_id = r.user_id AND abs(l.t - r.t) <= 60000) SELECT event_id, CASE WHEN count(*) >= 2 THEN round(sum(k * value) / sum(k), 5) END AS smooth, count(*) AS support FROM j GROUP BY event_id")
def kernel_smooth(spark, sf):
    v = stream(spark, sf).where("event_type = 'view'")
    s = signal.kernel_smooth(v, ["user_id"], "t", "value", 20000, 60000, 2)
    return v.select("event_id", "user_id", "t").join(s, ["user_id", "t"]).select("event_id", rnd("smooth", 5).alias("smooth"), "support")


@query("validity_sessions", f"{EV}, v AS (SELECT *, value > 20 AS v FROM ev), e AS (SELECT *, CASE WHEN v AND NOT coalesce(lag(v) OVER w, false) THEN 1 ELSE 0 END AS r FROM v WINDOW w AS (PARTITION BY user_id ORDER BY us)) SELECT event_id, CASE WHEN v THEN sum(r) OVER (PARTITION BY user_id ORDER BY us) ELSE 0 END::BIGINT AS session FROM e")
def validity_sessions(spark, sf):
    return islands.validity_sessions(stream(spark, sf), ["user_id"], ["us"], F.col("value") > 20).select("event_id", F.col("session").cast("long"))


_STEP = "SELECT event_id, user_id, t, coalesce(t - lag(t) OVER w, 0) * coalesce(lag(value / 1e6) OVER w, 0) AS a, coalesce(t - lag(t) OVER w, 0) * coalesce(lag(value / 1e3) OVER w, 0) AS s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)"


@query("dead_reckoning", f"{EV}, d AS ({_STEP}), y AS (SELECT *, sum(a) OVER (PARTITION BY user_id ORDER BY t) AS yaw FROM d), c AS (SELECT *, s * CASE WHEN abs(a / 2) < 1e-9 THEN 1 ELSE sin(a / 2) / (a / 2) END AS ch FROM y) SELECT event_id, round(yaw, 6) AS yaw, round(sum(ch * cos(yaw - a / 2)) OVER (PARTITION BY user_id ORDER BY t), 3) AS px, round(sum(ch * sin(yaw - a / 2)) OVER (PARTITION BY user_id ORDER BY t), 3) AS py FROM c")
def dead_reckoning(spark, sf):
    s = stream(spark, sf).withColumns({"v": F.col("value") / 1e3, "rate": F.col("value") / 1e6})
    return signal.dead_reckon(s, ["user_id"], "t", "v", "rate").select("event_id", rnd("yaw", 6).alias("yaw"), rnd("px", 3).alias("px"), rnd("py", 3).alias("py"))


@query("window_schedule", "WITH f AS (SELECT DISTINCT CAST(event_id // 100 AS BIGINT) AS frame FROM events), n AS (SELECT count(*) AS n FROM f), k AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS i FROM f), s AS (SELECT DISTINCT least(b, n - 8) AS b FROM n, generate_series(0, (SELECT greatest(n - 8 + 5, 0) FROM n), 6) g(b)) SELECT s.b::BIGINT AS first_row, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n FROM s JOIN k ON i BETWEEN s.b AND s.b + 7 GROUP BY ALL")
def window_schedule(spark, sf):
    from plinth.operators.schedule import schedule

    frames = table(spark, sf, "events").select(F.floor(F.col("event_id") / 100).alias("frame")).distinct()
    return schedule(frames, "frame", 8, 6).groupBy("first_row").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n"))


@query("ingest_once", f"{EV}, w AS (SELECT event_id, CAST(floor(t / 86400) AS BIGINT) AS d FROM ev), x AS (SELECT event_id, unnest([d - 1, d]) AS win FROM w) SELECT event_id, min(win) AS win FROM x GROUP BY event_id")
def ingest_once(spark, sf):
    d = F.floor(F.col("t") / 86400)
    return stream(spark, sf).select("event_id", F.explode(F.array(d - 1, d)).alias("win")).groupBy("event_id").agg(F.min("win").alias("win"))


@query("compressed_ranges", "WITH d AS (SELECT DISTINCT o_custkey % 20 AS g, CAST(o_orderkey % 300 AS BIGINT) AS k FROM orders WHERE o_totalprice > 90000), r AS (SELECT g, k, k - row_number() OVER (PARTITION BY g ORDER BY k) AS i FROM d), s AS (SELECT g, min(k) AS a, max(k) AS b FROM r GROUP BY g, i) SELECT g, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM s GROUP BY g")
def compressed_ranges(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 90000").select((F.col("o_custkey") % 20).alias("g"), (F.col("o_orderkey") % 300).alias("k"))
    return islands.compressed_ranges(o, ["g"], "k")


@query("parity_sample", f"{EV} SELECT event_id FROM ev WHERE event_id % 2 = 1 AND t BETWEEN 86400 AND 864000")
def parity_sample(spark, sf):
    return stream(spark, sf).where((F.col("event_id") % 2 == 1) & F.col("t").between(86400, 864000)).select("event_id")


@query("topic_merge", f"{EV}, u AS (SELECT event_id, us, 0 AS topic FROM ev WHERE event_type = 'view' UNION ALL SELECT event_id, us, 1 FROM ev WHERE event_type = 'error') SELECT event_id, topic, us FROM u")
def topic_merge(spark, sf):
    s = stream(spark, sf).select("event_id", "us", "event_type")
    merged = s.where("event_type = 'view'").withColumn("topic", F.lit(0)).unionByName(s.where("event_type = 'error'").withColumn("topic", F.lit(1)))
    return merged.orderBy("us", "topic", "event_id").select("event_id", "topic", "us")


