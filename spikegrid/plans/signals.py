"""Filter, spectrum and adaptive-rate queries: the value series of every session as a signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikegrid.operators import asof, signals as G
from spikegrid.operators.ordered import Ordered
from spikegrid.plans.base import R, all_units, compose, events, options, part, query, rd, tracking

RATE = 50.0
KEYS = ["session_id"]


def series(spark, sf):
    e = events(spark, sf).select("session_id", "t", F.col("i").alias("event_id"), F.col("x").alias("v"))
    o = Ordered(e, KEYS, ["t", "event_id"], options(spark, sf)).number("_k")
    return o.df.select("session_id", (F.col("_k") - 1).alias("i"), "v")


part("series", ("ev",), "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t, i) - 1 AS i, x AS v FROM ev")


@query("downsample_signal", compose("SELECT session_id, i // 5 AS i, v FROM series WHERE i % 5 = 0", "series"))
def downsample_signal(spark, sf):
    return G.every_kth(series(spark, sf), RATE, 10.0)


@query("fft_amplitude", compose(f"""
, n AS (SELECT session_id, count(*) n FROM series GROUP BY 1)
SELECT s.session_id, k AS k, {R(f'k * {RATE} / n')} AS frequency,
  {R('2.0 / n * sqrt(pow(sum(v * cos(2 * pi() * ((i * k) % n) / n)), 2) + pow(sum(v * sin(2 * pi() * ((i * k) % n) / n)), 2))', 8)} AS amplitude
FROM series s JOIN (SELECT session_id, n, unnest(range(0, n // 2)) AS k FROM n) n ON n.session_id = s.session_id GROUP BY s.session_id, k, n""", "series"))
def fft_amplitude(spark, sf):
    f = G.spectrum(series(spark, sf), KEYS, RATE)
    return f.select("session_id", "k", rd("frequency").alias("frequency"), rd("amplitude", 8).alias("amplitude"))


@query("iir_filter")
def iir_filter(spark, sf):
    return G.iir(series(spark, sf), KEYS, RATE, "low", 5.0, order=2).withColumn("y", rd("y"))


@query("notch_filter")
def notch_filter(spark, sf):
    return G.notch(series(spark, sf), KEYS, RATE, 12.0, 4.0, order=1).withColumn("y", rd("y"))


@query("dc_block")
def dc_block(spark, sf):
    return G.block_dc(series(spark, sf), KEYS, RATE, 0.5).withColumn("y", rd("y"))


ADAPT = 200_000.0


@query("adaptive_rate", compose(f"""
, num AS (SELECT session_id, unit, t, row_number() OVER (PARTITION BY session_id, unit ORDER BY t, i) AS k FROM ev),
nx AS (SELECT a.session_id, a.unit, a.k, a.t, min(b.k) AS nk, min(b.t) AS nt FROM num a JOIN num b
   ON a.session_id = b.session_id AND a.unit = b.unit AND b.t > a.t + {ADAPT} GROUP BY 1, 2, 3, 4)
, RECURSIVE_STEP
SELECT session_id, unit, {R('(t + nt) / 2', 7)} AS t, {R('(nk - k + CASE WHEN k = 1 THEN 1 ELSE 0 END) / (nt - t) * 1e6')} AS rate FROM chain""", "ev")
    .replace("WITH ev", "WITH RECURSIVE ev", 1)
    .replace(", RECURSIVE_STEP", ", chain AS (SELECT * FROM nx WHERE k = 1 UNION ALL SELECT x.* FROM chain c JOIN nx x ON x.session_id = c.session_id AND x.unit = c.unit AND x.k = c.nk)"))
def adaptive_rate(spark, sf):
    a = G.adaptive_rate(all_units(spark, sf), ["session_id", "unit"], ADAPT, options(spark, sf))
    return a.select("session_id", "unit", rd("t", 7).alias("t"), rd(F.col("rate") * 1e6).alias("rate"))


RATE_SLOTS = compose(f"""
, num AS (SELECT session_id, unit, t, row_number() OVER (PARTITION BY session_id, unit ORDER BY t, i) AS k FROM ev),
nx AS (SELECT a.session_id, a.unit, a.k, a.t, min(b.k) AS nk, min(b.t) AS nt FROM num a JOIN num b
   ON a.session_id = b.session_id AND a.unit = b.unit AND b.t > a.t + {ADAPT} GROUP BY 1, 2, 3, 4),
chain AS (SELECT * FROM nx WHERE k = 1 UNION ALL SELECT x.* FROM chain c JOIN nx x ON x.session_id = c.session_id AND x.unit = c.unit AND x.k = c.nk),
ar AS (SELECT session_id, unit, (t + nt) / 2 AS t, (nk - k + CASE WHEN k = 1 THEN 1 ELSE 0 END) / (nt - t) AS rate FROM chain),
near AS (SELECT a.session_id, a.unit, a.t, a.rate, k.i, row_number() OVER (PARTITION BY a.session_id, a.unit, a.t ORDER BY abs(k.t - a.t), k.t, k.i) AS rn
   FROM ar a JOIN trk k ON k.session_id = a.session_id),
slot AS (SELECT session_id, unit, i, arg_max(rate, t) AS rate FROM near WHERE rn = 1 GROUP BY 1, 2, 3),
u AS (SELECT DISTINCT session_id, unit FROM ev)
SELECT trk.session_id, u.unit, trk.i, {R('coalesce(slot.rate, 0) * 1e6')} AS rate
FROM trk JOIN u ON u.session_id = trk.session_id LEFT JOIN slot ON slot.session_id = trk.session_id AND slot.unit = u.unit AND slot.i = trk.i""", "trk").replace("WITH ev", "WITH RECURSIVE ev", 1)


@query("rate_slots", RATE_SLOTS)
def rate_slots(spark, sf):
    """Rates over adaptive windows, written to the tracking samples nearest to their middles."""
    s = options(spark, sf)
    rates = G.adaptive_rate(all_units(spark, sf), ["session_id", "unit"], ADAPT, s)
    units = all_units(spark, sf).select("session_id", "unit").distinct()
    slots = tracking(spark, sf).select("session_id", "i", "t").join(units, "session_id")
    out = asof.at_nearest_slot(rates, slots, ["session_id", "unit"], "t", "rate", "i", s)
    return out.select("session_id", "unit", "i", rd(F.col("rate") * 1e6).alias("rate"))
