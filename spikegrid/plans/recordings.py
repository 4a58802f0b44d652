"""Tracking, spike-train and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikegrid.operators import asof, spikes as S, tracking as T
from spikegrid.plans.base import (
    OPTIONS, R, all_units, compose, events, options, part, query, rd, spikes, tracking,
)

GAP = 43_200.0      # longest interval inside a burst, in the time scale of the events table
HOUR_BIN = 86_400.0


@query("track_speed", compose(f"SELECT session_id, i, {R('speed', 6)} AS speed FROM speed", "speed"))
def track_speed(spark, sf):
    return T.with_speed(tracking(spark, sf), options(spark, sf)).select("session_id", "i", rd("speed", 6).alias("speed"))


@query("speed_filter", compose(
    "SELECT session_id, count(*) AS n, min(i) AS first_i, max(i) AS last_i FROM moving GROUP BY 1", "moving"))
def speed_filter(spark, sf):
    m = T.speed_between(T.with_speed(tracking(spark, sf), options(spark, sf)), 0.0, OPTIONS.speed_high)
    return m.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))


@query("adaptive_speed", compose(f"""
, per AS (SELECT session_id, min(speed) lo, count(*) n, max(t) - min(t) span FROM speed GROUP BY 1),
h AS (SELECT s.session_id, CAST(floor((s.speed - p.lo) / 0.0002) AS BIGINT) b, count(*) n, max(p.lo) lo, max((p.n - 1) / p.span) fs
      FROM speed s JOIN per p ON p.session_id = s.session_id WHERE s.speed IS NOT NULL GROUP BY 1, 2),
st AS (SELECT session_id, unnest(range(b - 9, b + 1)) s, n, lo, fs FROM h),
band AS (SELECT session_id, s, sum(n) n, max(lo) lo, max(fs) fs FROM st WHERE s >= 0 GROUP BY 1, 2)
SELECT session_id, {R('max(lo + (s + 5) * 0.0002)', 6)} AS upper_speed FROM band WHERE n >= 86400 * 3 * fs GROUP BY 1
""", "speed"))
def adaptive_speed(spark, sf):
    up = T.adaptive_upper_speed(T.with_speed(tracking(spark, sf), options(spark, sf)), 86_400.0 * 3, 0.002)
    return up.select("session_id", rd("upper_speed", 6).alias("upper_speed"))


part("head0", ("trk",), """
  SELECT *, x - coalesce(lag(x) OVER w, 0.0) AS dx, y - coalesce(lag(y) OVER w, 0.0) AS dy
  FROM trk WINDOW w AS (PARTITION BY session_id ORDER BY t, i)""")
part("head", ("head0",), """
  SELECT session_id, i, t, x, y,
    CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END AS heading FROM (
    SELECT *, coalesce(last_value(CASE WHEN dx <> 0 OR dy <> 0 THEN atan2(dy, dx) END IGNORE NULLS) OVER (
      PARTITION BY session_id ORDER BY t, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS a FROM head0)""")


@query("head_direction", compose(f"SELECT session_id, i, {R('heading')} AS heading FROM head", "head"))
def head_direction(spark, sf):
    return T.with_heading(tracking(spark, sf), options(spark, sf)).select("session_id", "i", rd("heading").alias("heading"))


@query("track_boxcar", compose(f"""
, w5 AS (SELECT session_id, i, x,
   lag(x,1) OVER w a1, lag(x,2) OVER w a2, lead(x,1) OVER w b1, lead(x,2) OVER w b2
   FROM trk WINDOW w AS (PARTITION BY session_id ORDER BY t, i))
SELECT session_id, i, {R('(coalesce(a2, a1, x) + coalesce(a1, x) + x + coalesce(b1, x) + coalesce(b2, b1, x)) / 5')} AS x_smooth FROM w5
""", "trk"))
def track_boxcar(spark, sf):
    return T.boxcar(tracking(spark, sf), 5, ("x",), options(spark, sf)).select("session_id", "i", rd("x_smooth").alias("x_smooth"))


@query("track_travel", compose(f"""
, d AS (SELECT *, sqrt((x-px)*(x-px)+(y-py)*(y-py)) AS d, t - pt AS dt FROM (
   SELECT *, lag(x) OVER w px, lag(y) OVER w py, lag(t) OVER w pt FROM trk
   WINDOW w AS (PARTITION BY session_id ORDER BY t, i))),
v AS (SELECT session_id, d, CASE WHEN dt <> 0 THEN d / dt END AS v FROM d)
SELECT session_id, {R('sum(d)')} AS distance, {R('min(v)', 6)} AS min_speed, {R('max(v)', 6)} AS max_speed,
  {R('avg(v)', 6)} AS mean_speed, {R('quantile_cont(v, 0.5)', 6)} AS median_speed FROM v GROUP BY 1
""", "trk"))
def track_travel(spark, sf):
    t = T.travel(tracking(spark, sf), options(spark, sf))
    return t.select(
        "session_id", rd("distance").alias("distance"),
        *[rd(c, 6).alias(c) for c in ("min_speed", "max_speed", "mean_speed", "median_speed")])


# between a jump and the next: one sample, or samples that stay at the x of the next jump's end
@query("drop_jumps", compose("""
, d AS (SELECT *, coalesce(sqrt((x-px)*(x-px)+(y-py)*(y-py)) > 60, false) AS jump FROM (
   SELECT *, lag(x) OVER w px, lag(y) OVER w py, row_number() OVER w AS k FROM trk WINDOW w AS (PARTITION BY session_id ORDER BY t, i))),
j AS (SELECT session_id, k AS a, lead(k) OVER (PARTITION BY session_id ORDER BY k) AS b FROM d WHERE jump),
gone AS (SELECT session_id, a AS low, a AS high FROM j WHERE b = a + 1
  UNION ALL SELECT session_id, a, b FROM j WHERE b > a + 1 AND NOT EXISTS (
    SELECT 1 FROM d AS p, d AS q WHERE p.session_id = j.session_id AND q.session_id = j.session_id AND q.k = j.a AND p.k BETWEEN j.a AND j.b AND p.x IS DISTINCT FROM q.x))
SELECT session_id, count(*) AS kept, sum(i)::BIGINT AS sum_i FROM d
WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.session_id = d.session_id AND d.k BETWEEN g.low AND g.high) GROUP BY 1
""", "trk"))
def drop_jumps(spark, sf):
    return T.drop_jumps(tracking(spark, sf), 60.0, options(spark, sf)).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("i").alias("sum_i"))


@query("centre_scale", compose(f"""
, m AS (SELECT session_id, (min(x)+max(x))/2 cx, (min(y)+max(y))/2 cy FROM trk GROUP BY 1)
SELECT t.session_id, t.i, {R('100 * (t.x - m.cx) / 511.0')} AS x, {R('-100 * (t.y - m.cy) / 511.0')} AS y
FROM trk t JOIN m ON m.session_id = t.session_id""", "trk"))
def centre_scale(spark, sf):
    return T.to_cm(tracking(spark, sf), 511.0).select("session_id", "i", rd("x").alias("x"), rd("y").alias("y"))


# ------------------------------------------------------------------ spikes
part("isi", ("ev",), "SELECT *, t - lag(t) OVER (PARTITION BY session_id, unit ORDER BY t, i) AS isi FROM ev")


@query("isi_stats", compose(f"""
, ms AS (SELECT session_id, unit, isi * 1000 AS ms FROM isi WHERE isi IS NOT NULL)
SELECT session_id, unit, {R('min(ms)', 4)} AS isi_min, {R('max(ms)', 4)} AS isi_max, {R('avg(ms)', 2)} AS isi_mean,
  {R('stddev_pop(ms)', 2)} AS isi_std, {R('quantile_cont(ms, 0.5)', 4)} AS isi_median,
  {R('CASE WHEN avg(ms) <> 0 THEN stddev_pop(ms) / avg(ms) END')} AS isi_cv FROM ms GROUP BY 1, 2""", "isi"))
def isi_stats(spark, sf):
    s = S.isi_statistics(all_units(spark, sf), options(spark, sf))
    return s.select(
        "session_id", "unit", *[rd(f"isi_{c}", 2 if c in ("mean", "std") else 4).alias(f"isi_{c}") for c in ("min", "max", "mean", "std", "median")],
        rd("isi_cv").alias("isi_cv"))


@query("isi_hist", compose("""
SELECT session_id, unit, CAST(least(floor(isi * 1000 / 1e7), 99) AS INTEGER) AS bin, count(*) AS n
FROM isi WHERE isi * 1000 BETWEEN 0 AND 1e9 GROUP BY 1, 2, 3""", "isi"))
def isi_hist(spark, sf):
    return S.isi_histogram(all_units(spark, sf), 1e7, 1e9, options(spark, sf))


part("flags", ("ev",), f"""
  SELECT *, (gb IS NULL OR gb > {GAP}) AND (ga IS NULL OR ga > {GAP}) AS single FROM (
    SELECT session_id, unit, i, t, t - lag(t) OVER w AS gb, lead(t) OVER w - t AS ga FROM ev
    WINDOW w AS (PARTITION BY session_id, unit ORDER BY t, i))""")
part("runs", ("flags",), """
  SELECT *, CASE WHEN NOT single THEN sum(st) OVER (PARTITION BY session_id, unit ORDER BY t, i) END AS burst FROM (
    SELECT *, CASE WHEN NOT single AND coalesce(lag(single) OVER (PARTITION BY session_id, unit ORDER BY t, i), TRUE)
              THEN 1 ELSE 0 END AS st FROM flags)""")


@query("bursts", compose(f"""
, a AS (SELECT session_id, unit, count(*) n_spikes, count(DISTINCT burst) n_bursts,
         sum(CASE WHEN burst IS NULL THEN 1 ELSE 0 END)::BIGINT n_single FROM runs GROUP BY 1, 2)
SELECT session_id, unit, n_spikes, n_bursts, n_single,
  {R('CASE WHEN n_spikes >= 2 THEN 100.0 * n_bursts / (n_bursts + n_single) END')} AS bursting,
  {R('CASE WHEN n_spikes >= 2 AND n_bursts > 0 THEN (n_spikes - n_single) / n_bursts::DOUBLE END')} AS spikes_per_burst FROM a""", "runs"))
def bursts(spark, sf):
    b = S.burst_statistics(all_units(spark, sf), GAP, settings=options(spark, sf))
    return b.select(
        "session_id", "unit", "n_spikes", "n_bursts", "n_single",
        rd("bursting").alias("bursting"), rd("spikes_per_burst").alias("spikes_per_burst"))


@query("bursts_split", compose(f"""
, r2 AS (SELECT *, CASE WHEN NOT single THEN sum(st) OVER (PARTITION BY session_id, unit ORDER BY t, i) END AS burst FROM (
   SELECT *, CASE WHEN NOT single AND (coalesce(lag(single) OVER (PARTITION BY session_id, unit ORDER BY t, i), TRUE)
                  OR gb IS NULL OR gb > {GAP}) THEN 1 ELSE 0 END AS st FROM flags)),
k AS (SELECT session_id, unit, burst, count(*) k FROM r2 GROUP BY 1, 2, 3)
SELECT session_id, unit, sum(CASE WHEN burst IS NOT NULL AND k >= 3 THEN 1 ELSE 0 END)::BIGINT AS n_bursts,
  sum(CASE WHEN burst IS NULL OR k < 3 THEN k ELSE 0 END)::BIGINT AS n_single FROM k GROUP BY 1, 2""", "flags"))
def bursts_split(spark, sf):
    return S.burst_statistics(all_units(spark, sf), GAP, 3, True, options(spark, sf)).select("session_id", "unit", "n_bursts", "n_single")


@query("event_rate", compose(f"""
SELECT session_id, unit, count(*) AS n, {R('CASE WHEN max(t) > min(t) THEN count(*) / (max(t) - min(t)) * 1000 END', 6)} AS rate
FROM ev GROUP BY 1, 2""", "ev"))
def event_rate(spark, sf):
    return S.event_rate(all_units(spark, sf)).select("session_id", "unit", "n", rd(F.col("rate") * 1000, 6).alias("rate"))


@query("session_rate", compose(f"""
, u AS (SELECT session_id, unit, CASE WHEN max(t) > min(t) THEN count(*) / (max(t) - min(t)) END AS rate FROM ev GROUP BY 1, 2)
SELECT session_id, {R('avg(rate) * 1000', 6)} AS mean_rate, count(rate) AS units FROM u GROUP BY 1""", "ev"))
def session_rate(spark, sf):
    return S.session_rate(all_units(spark, sf)).select("session_id", rd(F.col("mean_rate") * 1000, 6).alias("mean_rate"), "units")


@query("binned_train", compose("""
SELECT session_id, unit, CAST(floor(t * 0.01 + 1e-9) AS BIGINT) AS bin, count(*) AS n FROM ev GROUP BY 1, 2, 3""", "ev"))
def binned_train(spark, sf):
    return S.binned_train(all_units(spark, sf), 0.01)


@query("interval_rate", compose(f"""
SELECT session_id, unit, CAST(floor(t / {HOUR_BIN}) AS BIGINT) AS bin, count(*) AS n, {R(f'count(*) / {HOUR_BIN} * 1000', 6)} AS rate
FROM ev GROUP BY 1, 2, 3""", "ev"))
def interval_rate(spark, sf):
    return S.interval_rate(all_units(spark, sf), HOUR_BIN).withColumn("rate", rd(F.col("rate") * 1000, 6))


@query("interval_speed", compose(f"""
SELECT session_id, CAST(floor(t / {HOUR_BIN}) AS BIGINT) AS bin, {R('avg(speed)', 6)} AS speed FROM speed GROUP BY 1, 2""", "speed"))
def interval_speed(spark, sf):
    return S.interval_speed(T.with_speed(tracking(spark, sf), options(spark, sf)), HOUR_BIN).withColumn("speed", rd("speed", 6))


@query("speed_rate_mass", compose(f"""
, rt AS (SELECT session_id, CAST(floor(t / {HOUR_BIN}) AS BIGINT) bin, count(*) n FROM spk GROUP BY 1, 2),
sp AS (SELECT session_id, CAST(floor(t / {HOUR_BIN}) AS BIGINT) bin, avg(speed) speed FROM speed GROUP BY 1, 2),
cells AS (SELECT CAST(floor(speed / 0.002) AS BIGINT) speed_bin, CAST(floor(n / {HOUR_BIN} / 0.00001) AS BIGINT) rate_bin, count(*) n
  FROM rt JOIN sp USING (session_id, bin) WHERE speed IS NOT NULL GROUP BY 1, 2)
SELECT speed_bin, rate_bin, n, {R('n / sum(n) OVER ()', 6)} AS joint, {R('n / sum(n) OVER (PARTITION BY speed_bin)', 6)} AS conditional
FROM cells""", "spk", "speed"))
def speed_rate_mass(spark, sf):
    rates = spikes(spark, sf).groupBy("session_id", F.floor(F.col("t") / HOUR_BIN).alias("bin")).agg(
        (F.count(F.lit(1)) / F.lit(HOUR_BIN)).alias("rate"))
    speeds = S.interval_speed(T.with_speed(tracking(spark, sf), options(spark, sf)), HOUR_BIN)
    m = S.rate_given_speed(rates, speeds, 0.00001, 0.002)
    return m.select("speed_bin", "rate_bin", "n", rd("joint", 6).alias("joint"), rd("conditional", 6).alias("conditional"))


# ------------------------------------------------------------------- joins
@query("asof_nearest", compose(
    "SELECT session_id, unit, i, x, y FROM pos", "pos"))
def asof_nearest(spark, sf):
    m = T.speed_between(T.with_speed(tracking(spark, sf), options(spark, sf)), 0.0, OPTIONS.speed_high)
    return asof.asof_nearest(spikes(spark, sf), m, ["session_id"], "t", ["x", "y"], "i", options(spark, sf)).select(
        "session_id", "unit", "i", "x", "y")


@query("asof_backward", compose("""
SELECT session_id, unit, i, x, y FROM (
  SELECT s.session_id, s.unit, s.i, m.x, m.y,
     row_number() OVER (PARTITION BY s.session_id, s.i ORDER BY m.t DESC, m.i) rn
  FROM spk s LEFT JOIN trk m ON s.session_id = m.session_id AND m.t <= s.t) WHERE rn = 1""", "spk", "trk"))
def asof_backward(spark, sf):
    return asof.asof_backward(spikes(spark, sf), tracking(spark, sf), ["session_id"], "t", ["x", "y"], "i", options(spark, sf)).select(
        "session_id", "unit", "i", "x", "y")


@query("label_gap", """
WITH lab AS (SELECT DISTINCT user_id AS session_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS label FROM events)
SELECT session_id, min(label) AS gap FROM (
  SELECT session_id, label + 1 AS label FROM lab WHERE label >= 0 UNION SELECT session_id, 1 FROM lab) c
WHERE NOT EXISTS (SELECT 1 FROM lab l WHERE l.session_id = c.session_id AND l.label = c.label) GROUP BY 1""")
def label_gap(spark, sf):
    lab = events(spark, sf).select("session_id", F.col("y").cast("int").alias("label"))
    return S.first_gap(lab, ["session_id"])
