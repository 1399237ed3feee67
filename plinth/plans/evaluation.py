"""Queries: confusion counts, error windows, votes, scenario pivots, sequential and iterative operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import evaluate, ranges
from plinth.plans.catalog import EV, PTS, points, query, rnd, stream, table


@query("confusion_counts", f"{PTS}, t AS (SELECT DISTINCT cls, frame FROM pts WHERE x > 49 AND z > 0.07), f AS (SELECT DISTINCT cls, frame FROM pts WHERE x > 48.5 AND inten > 0.07), j AS (SELECT coalesce(t.cls, f.cls) AS cls, t.cls IS NOT NULL AS a, f.cls IS NOT NULL AS b FROM t FULL JOIN f ON t.cls = f.cls AND t.frame = f.frame) SELECT cls, count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE NOT a) AS fp, count(*) FILTER (WHERE NOT b) AS fn, round(count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE b), 6) AS precision, round(count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a), 6) AS recall, round(count(*) FILTER (WHERE a AND b) / count(*), 6) AS iou FROM j GROUP BY cls")
def confusion_counts(spark, sf):
    p = points(spark, sf)
    c = evaluate.confusion(p.where("x > 49 AND z > 0.07"), p.where("x > 48.5 AND inten > 0.07"), ["frame"], ["cls"])
    return c.withColumns({k: rnd(k, 6) for k in ("precision", "recall", "iou")})


@query("quality_confusion", "WITH j AS (SELECT lang, quality = 1 AS a, n_chars > 600 AS b FROM documents JOIN labels USING (doc_id)) SELECT lang, count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE NOT a AND b) AS fp, count(*) FILTER (WHERE a AND NOT b) AS fn FROM j GROUP BY lang")
def quality_confusion(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return evaluate.confusion(j.where("quality = 1"), j.where("n_chars > 600"), ["doc_id"], ["lang"]).select("lang", "tp", "fp", "fn")


@query("error_windows", f"{EV}, w AS (SELECT event_type, value - 30 AS e, unnest(list_filter([CASE WHEN us % 2 = 0 THEN 'even' END, CASE WHEN us < 864000000000 THEN 'early' END, 'all'], lambda x: x IS NOT NULL)) AS win FROM ev) SELECT event_type, win AS \"window\", count(*) AS n, round(sqrt(avg(e*e)), 6) AS rmse, round(quantile_cont(abs(e), 0.95), 5) AS p95, round(max(abs(e)), 6) AS greatest, count(*) FILTER (WHERE abs(e) > 20) AS beyond FROM w GROUP BY ALL")
def error_windows(spark, sf):
    s = stream(spark, sf).withColumn("e", F.col("value") - 30)
    windows = {"even": F.col("us") % 2 == 0, "early": F.col("us") < 864000000000, "all": F.lit(True)}
    w = evaluate.error_windows(s, ["event_type"], "e", windows, 20.0)
    return w.withColumns({"rmse": rnd("rmse", 6), "p95": rnd("p95", 5), "greatest": rnd("greatest", 6)})


@query("window_votes", f"{EV}, s AS (SELECT user_id, event_id AS span_id, t AS b, t + 30000 AS e FROM ev WHERE event_type = 'error'), j AS (SELECT span_id, ev.value FROM ev JOIN s ON ev.user_id = s.user_id AND t BETWEEN b AND e WHERE event_type <> 'error') SELECT span_id, count(*) AS n, round(avg(CAST(value > 30 AS INT)), 6) AS share, round(median(value), 5) AS med FROM j GROUP BY span_id HAVING count(*) >= 2")
def window_votes(spark, sf):
    s = stream(spark, sf)
    spans = s.where("event_type = 'error'").select("user_id", F.col("event_id").alias("span_id"), F.col("t").alias("b"), (F.col("t") + 30000).alias("e"))
    j = ranges.interval_join(s.where("event_type <> 'error'").select("user_id", "t", "value"), spans, ["user_id"], "t", "b", "e", 30000)
    g = j.groupBy("span_id").agg(F.count("*").alias("n"), rnd(F.avg((F.col("value") > 30).cast("int")), 6).alias("share"), rnd(F.median("value"), 5).alias("med"))
    return g.where("n >= 2")


@query("scenario_pivot", f"{EV} SELECT user_id % 10 AS scenario, round(sqrt(avg(value*value) FILTER (WHERE event_type = 'view')), 5) AS \"view\", round(sqrt(avg(value*value) FILTER (WHERE event_type = 'click')), 5) AS click, round(sqrt(avg(value*value) FILTER (WHERE event_type = 'error')), 5) AS error FROM ev GROUP BY ALL")
def scenario_pivot(spark, sf):
    s = stream(spark, sf).withColumn("scenario", F.col("user_id") % 10)
    return evaluate.pivoted(s, ["scenario"], "event_type", ["view", "click", "error"], rnd(F.sqrt(F.avg(F.col("value") * F.col("value"))), 5))


@query("completeness", f"{EV}, g AS (SELECT user_id, event_type, count(*) AS n, round(sqrt(avg(value*value)), 5) AS rmse FROM ev GROUP BY ALL), x AS (SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM ev) u, (SELECT DISTINCT event_type FROM ev) t) SELECT x.user_id, x.event_type, coalesce(n >= 12, false) AS complete, CASE WHEN n >= 12 THEN rmse ELSE -1 END AS rmse FROM x LEFT JOIN g USING (user_id, event_type)")
def completeness(spark, sf):
    s = stream(spark, sf)
    g = s.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), rnd(F.sqrt(F.avg(F.col("value") * F.col("value"))), 5).alias("rmse"))
    types = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    expected = s.select("user_id").distinct().select("user_id", F.explode(types).alias("event_type"), F.lit(12).alias("expected_n"))
    done = evaluate.with_completeness(g, expected, ["user_id", "event_type"], "n", ["rmse"])
    return done.select("user_id", "event_type", "complete", F.when(F.col("complete"), F.col("rmse")).otherwise(-1.0).alias("rmse"))


_TIER = "CASE WHEN r < 5 THEN 'good' WHEN r < 20 THEN 'fair' ELSE 'poor' END"


@query("residual_tiers", f"{EV}, m AS (SELECT *, abs(value - median(value) OVER (PARTITION BY user_id)) AS r FROM ev), l AS (SELECT user_id, us, {_TIER} AS tier FROM m), c AS (SELECT *, CASE WHEN tier = lag(tier) OVER w THEN 0 ELSE 1 END AS n FROM l WINDOW w AS (PARTITION BY user_id ORDER BY us)), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY us) AS run FROM c) SELECT user_id, run::BIGINT AS run, tier AS label, min(us) AS \"begin\", max(us) AS \"end\", count(*) AS n FROM g GROUP BY ALL")
def residual_tiers(spark, sf):
    from plinth.operators import islands

    m = stream(spark, sf)
    middle = m.groupBy("user_id").agg(F.median("value").alias("mid"))
    r = F.abs(F.col("value") - F.col("mid"))
    return islands.runs(m.join(middle, "user_id"), ["user_id"], ["us"], F.when(r < 5, "good").when(r < 20, "fair").otherwise("poor"))


@query("availability_scenarios", f"{EV} SELECT event_id, CASE WHEN t BETWEEN 100000 AND 200000 THEN 'blackout' WHEN CAST(floor(t / 2) AS BIGINT) % 2 = 0 THEN 'on' ELSE 'off' END AS scenario FROM ev")
def availability_scenarios(spark, sf):
    t = F.col("t")
    return stream(spark, sf).select("event_id", F.when(t.between(100000, 200000), "blackout").when(F.floor(t / 2) % 2 == 0, "on").otherwise("off").alias("scenario"))


@query("robust_clock")
def robust_clock(spark, sf):
    from plinth.operators.robust import clipped_line

    s = stream(spark, sf).select("user_id", F.col("t").alias("x"), (F.col("t") * 1.09 + F.when(F.col("event_id") % 17 == 0, F.col("value")).otherwise(0.0)).alias("y"))
    return clipped_line(s, ["user_id"], "x", "y")


@query("greedy_canonical")
def greedy_canonical(spark, sf):
    from plinth.operators.greedy import canonicalise
    from plinth.plans.space import comps

    return canonicalise(comps(spark, sf), "cls", 1.0)


@query("greedy_association")
def greedy_association(spark, sf):
    from plinth.operators.greedy import associate
    from plinth.plans.space import comps

    c = comps(spark, sf)
    return associate(c.where("frame % 2 = 0"), c.where("frame % 2 = 1").withColumnRenamed("frame", "other"), "cls", "frame", "other", 2.0)


@query("ordered_propagation")
def ordered_propagation(spark, sf):
    from plinth.operators.greedy import propagate
    from plinth.plans.space import grid

    return propagate(grid(spark, sf), "frame", "v", 6.0)


@query("mixture_tiles")
def mixture_tiles(spark, sf):
    from plinth.operators.mixture import fit_tiles

    return fit_tiles(points(spark, sf), ["cls", "frame"], 3)


@query("wheel_filter")
def wheel_filter(spark, sf):
    from plinth.operators.stateful import filtered_speed

    return filtered_speed(stream(spark, sf), "user_id", "t", "event_type", "value", 50000.0, 20000.0, 30.0)


@query("source_horizon")
def source_horizon(spark, sf):
    from plinth.operators.stateful import horizon

    return horizon(stream(spark, sf), "user_id", "t", "value", 5, 40000.0)


@query("low_pass", None)
def low_pass(spark, sf):
    from plinth.operators.stateful import low_pass as run

    return run(stream(spark, sf), "user_id", "t", "value", 3600.0)


@query("pose_observer")
def pose_observer(spark, sf):
    from plinth.operators.stateful import observe

    return observe(stream(spark, sf), "user_id", "t", "event_type", "value")


@query("kalman_track")
def kalman_track(spark, sf):
    from plinth.operators.stateful import track

    view = F.col("event_type") == "view"
    s = stream(spark, sf).select("user_id", "event_id", (F.col("t") / 86400).alias("t"), F.when(view, "range").otherwise("heading").alias("kind"), F.when(view, F.col("value")).otherwise(F.col("value") / 200).alias("m"))
    return track(s, "user_id", "t", "kind", "m", 2.0)


@query("streaming_tumbling", f"{EV} SELECT event_type, CAST(floor(t / 3600) AS BIGINT) AS hour, count(*) AS n, round(sum(value), 3) AS total FROM ev GROUP BY ALL")
def streaming_tumbling(spark, sf):
    from plinth.streaming.replay import tumbling

    return tumbling(spark, f"{sf}/events.parquet").select("event_type", "hour", "n", rnd("total", 3).alias("total"))


