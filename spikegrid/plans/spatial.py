"""Map, score and field queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from spikegrid.functions import grid_kernels as gk
from spikegrid.functions.expr import Extent
from spikegrid.operators import asof, maps as M, scores as C, tracking as T
from spikegrid.plans.base import (
    ARENA, COLS, OPTIONS, options, ROWS, R, compose, node, part, query, rd, spikes, tracking,
)

SESSION, UNIT = ["session_id"], ["session_id", "unit"]
N = ROWS * COLS
SIGMA_FRAMES = 1.0


# ---------------------------------------------------------------- base tables
def spike_positions(spark, sf):
    moving = T.speed_between(T.with_speed(tracking(spark, sf), options(spark, sf)), 0.0, OPTIONS.speed_high)
    return asof.asof_nearest(spikes(spark, sf), moving, SESSION, "t", ["x", "y"], "i", options(spark, sf))


def occupancy(spark, sf):
    return M.occupancy(tracking(spark, sf), ARENA, ROWS, COLS, options(spark, sf))


def spike_map(spark, sf):
    return M.spike_counts(spike_positions(spark, sf), ARENA, ROWS, COLS)


def rate_map(spark, sf):
    return M.rate_bins(occupancy(spark, sf), spike_map(spark, sf))


def dense_rate(spark, sf):
    """Smoothed rate maps, one dense array per unit."""
    return M.smooth_rate(occupancy(spark, sf), spike_map(spark, sf), ROWS, COLS, OPTIONS.smoothing_factor)


# ----------------------------------------------------------------------- maps
@query("occupancy_map", compose(f"SELECT session_id, r, c, {R('v', 6)} AS v FROM occ", "occ"))
def occupancy_map(spark, sf):
    return occupancy(spark, sf).withColumn("v", rd("v", 6))


@query("occupancy_extent", compose(f"""
, m AS (SELECT session_id, min(x) xl, max(x) xh, min(y) yl, max(y) yh FROM trk GROUP BY 1),
b AS (SELECT s.session_id, s.dt,
   greatest(0, least({ROWS-1}, CAST(ceil((yh - y) / ((yh - yl) / {ROWS-1}.0::DOUBLE) - 0.5) AS INTEGER))) AS r,
   greatest(0, least({COLS-1}, CAST(ceil((x - xl) / ((xh - xl) / {COLS-1}.0::DOUBLE) - 0.5) AS INTEGER))) AS c
   FROM step s JOIN m ON m.session_id = s.session_id WHERE dt IS NOT NULL)
SELECT session_id, r, c, {R('sum(dt)', 6)} AS v FROM b GROUP BY 1, 2, 3""", "step"))
def occupancy_extent(spark, sf):
    trk = T.with_step(tracking(spark, sf), options(spark, sf))
    wide, ext = M.on_data_extent(trk, M.data_extent(tracking(spark, sf)))
    return M.occupancy(wide, ext, ROWS, COLS, options(spark, sf)).withColumn("v", rd("v", 6))


@query("spike_map", compose("SELECT session_id, unit, r, c, v FROM spkmap", "spkmap"))
def spike_map_query(spark, sf):
    return spike_map(spark, sf)


ROW_SWAP = node(f"({ARENA.x_hi!r} - y)", 0.0, ARENA.x_hi - ARENA.x_lo, ROWS)
COL_SWAP = node("x", ARENA.y_lo, ARENA.y_hi, COLS)


@query("spike_map_swapped", compose(f"""
SELECT session_id, unit, {ROW_SWAP} AS r, {COL_SWAP} AS c, CAST(count(*) AS DOUBLE) AS v FROM pos GROUP BY 1, 2, 3, 4""", "pos"))
def spike_map_swapped(spark, sf):
    return M.spike_counts(spike_positions(spark, sf), ARENA, ROWS, COLS, swapped_axes=True)


@query("rate_map_raw", compose(f"SELECT session_id, unit, r, c, {R('v * 1e6')} AS v FROM rate", "rate"))
def rate_map_raw(spark, sf):
    return rate_map(spark, sf).withColumn("v", rd(F.col("v") * 1e6))


@query("coverage", compose(f"""
SELECT DISTINCT session_id, r + a.d::INTEGER AS r, c + b.d::INTEGER AS c FROM occ, range(2) a(d), range(2) b(d)
WHERE r + a.d < {ROWS} AND c + b.d < {COLS}""", "occ"))
def coverage(spark, sf):
    return M.coverage(occupancy(spark, sf), ROWS, COLS)


@query("arena_coverage", compose(f"""
SELECT session_id, {R(f'count(*) / {N}.0', 6)} AS covered FROM occ GROUP BY 1""", "occ"))
def arena_coverage(spark, sf):
    return occupancy(spark, sf).groupBy(*SESSION).agg(rd(F.count(F.lit(1)) / float(N), 6).alias("covered"))


@query("disk_mask", compose(f"""
SELECT session_id, r, c, {R('v', 6)} AS v FROM occ
WHERE (r - {(ROWS-1)/2}) * (r - {(ROWS-1)/2}) + (c - {(COLS-1)/2}) * (c - {(COLS-1)/2}) <= {min(ROWS, COLS)/2} * {min(ROWS, COLS)/2}""", "occ"))
def disk_mask(spark, sf):
    return M.disk_mask(occupancy(spark, sf), ROWS, COLS).withColumn("v", rd("v", 6))


@query("downsample", compose(f"""
SELECT session_id, CAST(floor(r / 4) AS INTEGER) AS r, CAST(floor(c / 4) AS INTEGER) AS c, {R('sum(v)', 6)} AS v
FROM occ GROUP BY 1, 2, 3""", "occ"))
def downsample(spark, sf):
    return M.downsample(occupancy(spark, sf), SESSION, 4).withColumn("v", rd("v", 6))


@query("resize_nearest", compose(f"""
SELECT session_id, CAST(a.k AS INTEGER) AS r, CAST(b.k AS INTEGER) AS c, {R('v', 6)} AS v FROM occ
JOIN range(24) a(k) ON floor(a.k * {ROWS} / 24.0) = r JOIN range(10) b(k) ON floor(b.k * {COLS} / 10.0) = c""", "occ"))
def resize_nearest(spark, sf):
    return M.resize_nearest(occupancy(spark, sf), SESSION, (ROWS, COLS), (24, 10)).withColumn("v", rd("v", 6))


part("cut", ("dense",), "SELECT session_id, unit, quantile_cont(v, 0.9) AS threshold FROM dense GROUP BY 1, 2")


@query("binary_map", compose("""
SELECT d.session_id, d.unit, d.r, d.c FROM dense d JOIN cut ON cut.session_id = d.session_id AND cut.unit = d.unit
WHERE d.v >= cut.threshold""", "dense", "cut"))
def binary_map(spark, sf):
    return M.binary_bins(rate_map(spark, sf), UNIT, ROWS, COLS, 0.9).drop("v")


# Smoothing in SQL: every source bin reaches the targets through the mirrored taps.
_taps = gk.gaussian_taps(OPTIONS.smoothing_factor)
_mat = gk.smoothing_matrix(ROWS, _taps)
part("tap", (), "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {j}, {float(_mat[i, j])!r}::DOUBLE)" for i in range(ROWS) for j in range(ROWS) if _mat[i, j]) + ") AS t(dst, src, w)")
for _name, _src, _keys in (("socc", "occ", "session_id"), ("sspk", "spkmap", "session_id, unit")):
    part(_name + "0", ("tap", _src), f"""
      SELECT {_keys}, a.dst AS r, b.dst AS c, sum(m.v * a.w * b.w) AS v FROM {_src} m
      JOIN tap a ON a.src = m.r JOIN tap b ON b.src = m.c GROUP BY {_keys}, a.dst, b.dst""")
    part(_name, (_name + "0",), f"SELECT {_keys}, r, c, v / max(v) OVER (PARTITION BY {_keys}) AS v FROM {_name}0")


@query("occupancy_smooth", compose(f"""
SELECT session_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, {R('v')} AS v FROM socc WHERE v > 1e-6""", "socc"))
def occupancy_smooth(spark, sf):
    s = M.smooth(occupancy(spark, sf), SESSION, ROWS, COLS, OPTIONS.smoothing_factor)
    return M.unpack(s, SESSION, "smooth", COLS).where("v > 1e-6").withColumn("v", rd("v"))


part("srate", ("socc", "sspk", "grid"), """
  SELECT session_id, unit, r, c, CASE WHEN max(v) OVER w > 0 THEN v / max(v) OVER w ELSE 0 END AS v FROM (
    SELECT u.session_id, u.unit, g.r, g.c,
      CASE WHEN coalesce(o.v, 0) < 1e-4 THEN 0.0 ELSE coalesce(s.v, 0) / o.v END AS v
    FROM (SELECT DISTINCT session_id, unit FROM sspk) u CROSS JOIN grid g
    LEFT JOIN socc o ON o.session_id = u.session_id AND o.r = g.r AND o.c = g.c
    LEFT JOIN sspk s ON s.session_id = u.session_id AND s.unit = u.unit AND s.r = g.r AND s.c = g.c
    WHERE EXISTS (SELECT 1 FROM socc x WHERE x.session_id = u.session_id))
  WINDOW w AS (PARTITION BY session_id, unit)""")


@query("rate_map_smooth", compose(f"SELECT session_id, unit, r, c, {R('v')} AS v FROM srate", "srate"))
def rate_map_smooth(spark, sf):
    return M.unpack(dense_rate(spark, sf), UNIT, "rate", COLS).withColumn("v", rd("v"))


@query("kernel_density", compose(f"""
SELECT session_id, g.r, g.c, {R('sum(exp(-(pow(x - g.c * 20.0, 2) + pow(100.0 - y - g.r * (100.0::DOUBLE / 15), 2)) / 200.0))', 6)} AS v
FROM trk, grid g WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3""", "trk", "grid"))
def kernel_density(spark, sf):
    return M.kernel_density(tracking(spark, sf), SESSION, ARENA, ROWS, COLS, 10.0).withColumn("v", rd("v", 6))


@query("trial_raster", compose(f"""
, d AS (SELECT session_id, CAST(floor(t / 604800) AS BIGINT) lap, CAST(floor(x / 25) AS BIGINT) bin, coalesce(sum(dt), 0) dwell FROM step GROUP BY 1, 2, 3),
h AS (SELECT session_id, CAST(floor(t / 604800) AS BIGINT) lap, CAST(floor(x / 25) AS BIGINT) bin, count(*) spikes FROM pos GROUP BY 1, 2, 3),
j AS (SELECT session_id, lap, bin, coalesce(dwell, 0) dwell, coalesce(spikes, 0) spikes FROM d FULL JOIN h USING (session_id, lap, bin))
SELECT session_id, lap, bin, {R('dwell', 6)} AS dwell, spikes, {R('sum(dwell) OVER w', 6)} AS dwell_total, CAST(sum(spikes) OVER w AS BIGINT) AS spikes_total
FROM j WINDOW w AS (PARTITION BY session_id, bin ORDER BY lap)""", "step", "pos"))
def trial_raster(spark, sf):
    t = M.trial_raster(spike_positions(spark, sf), tracking(spark, sf), 604_800, 0.0, 25.0, options(spark, sf))
    return t.withColumn("dwell", rd("dwell", 6)).withColumn("dwell_total", rd("dwell_total", 6))


# --------------------------------------------------------------------- scores
part("stats1", ("occ", "rate"), """
  SELECT r.session_id, r.unit, r.v, o.v / d.dur AS p FROM rate r
  JOIN occ o ON o.session_id = r.session_id AND o.r = r.r AND o.c = r.c
  JOIN (SELECT session_id, sum(v) dur FROM occ GROUP BY 1) d ON d.session_id = r.session_id""")
STATS_SQL = compose(f"""
, m AS (SELECT session_id, unit, sum(p * v) m1, sum(p * v * v) m2, max(v) peak, sum(v) tot FROM stats1 GROUP BY 1, 2),
i AS (SELECT s.session_id, s.unit, sum(CASE WHEN v > m1 THEN p * v * log2(v / m1) ELSE 0 END) info
      FROM stats1 s JOIN m ON m.session_id = s.session_id AND m.unit = s.unit GROUP BY 1, 2)
SELECT m.session_id, m.unit, {R('peak * 1e6')} AS peak_rate, {R(f'tot / {N}.0 * 1e6')} AS mean_rate, {R('m1 * 1e6')} AS weighted_rate,
  {R('m1 * m1 / m2')} AS sparsity, {R('peak / m1')} AS selectivity, {R('info * 1e6')} AS information_rate, {R('info / m1')} AS information_content
FROM m JOIN i ON i.session_id = m.session_id AND i.unit = m.unit""", "stats1")


@query("map_stats", STATS_SQL)
def map_stats(spark, sf):
    s = C.map_statistics(occupancy(spark, sf), rate_map(spark, sf), ROWS, COLS)
    micro = ("peak_rate", "mean_rate", "weighted_rate", "information_rate")
    return s.select(
        *UNIT, *[rd(F.col(c) * 1e6).alias(c) for c in micro],
        *[rd(c).alias(c) for c in ("sparsity", "selectivity", "information_content")])


@query("coherence", compose(f"""
, nb AS (SELECT a.session_id, a.unit, a.r, a.c, max(a.v) AS a, sum(CASE WHEN b.r <> a.r OR b.c <> a.c THEN b.v ELSE 0 END) / 8 AS b
   FROM dense a JOIN dense b ON a.session_id = b.session_id AND a.unit = b.unit AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1
   GROUP BY 1, 2, 3, 4)
SELECT session_id, unit, {R('coalesce(corr(a * 1e6, b * 1e6), 0)')} AS coherence FROM nb GROUP BY 1, 2""", "dense"))
def coherence(spark, sf):
    return C.coherence(rate_map(spark, sf), ROWS, COLS).withColumn("coherence", rd("coherence"))


_wall = lambda cond, n: f"(sum(CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0 END) / {n})"
_dist = lambda e: f"(avg({e}) / {min(ROWS, COLS) / 2})"
_score = lambda a, b: f"CASE WHEN {a} + {b} <> 0 THEN ({a} - {b}) / ({a} + {b}) END"


@query("border_score", compose(f"""
, rr AS (SELECT session_id, unit, r, c, round(v, 6) AS v FROM srate),
act AS (SELECT d.session_id, d.unit, d.r, d.c, d.v FROM rr d JOIN (
   SELECT session_id, unit, quantile_cont(v, 0.75) t FROM rr GROUP BY 1, 2) q ON q.session_id = d.session_id AND q.unit = d.unit AND d.v >= q.t)
SELECT session_id, unit,
 {R(_score(_wall('r = 0', COLS), _dist('r * v')))} AS border_top,
 {R(_score(_wall(f'r = {ROWS-1}', COLS), _dist(f'({COLS} - r) * v')))} AS border_bottom,
 {R(_score(_wall('c = 0', ROWS), _dist('c * v')))} AS border_left,
 {R(_score(_wall(f'c = {COLS-1}', ROWS), _dist(f'({ROWS} - c) * v')))} AS border_right
FROM act GROUP BY 1, 2""", "srate"))
def border_score(spark, sf):
    rates = M.unpack(dense_rate(spark, sf), UNIT, "rate", COLS).withColumn("v", F.round("v", 6))
    b = C.border_score(rates, ROWS, COLS)
    return b.select(*UNIT, *[rd(f"border_{k}").alias(f"border_{k}") for k in ("top", "bottom", "left", "right")])


# ------------------------------------------------------------------ direction
import spikegrid.plans.recordings  # noqa: E402,F401  (the SQL piece ``head`` lives there)

part("spkhead", ("spk", "head"), """
  SELECT session_id, unit, i, heading FROM (
    SELECT s.session_id, s.unit, s.i, m.heading,
           row_number() OVER (PARTITION BY s.session_id, s.i ORDER BY abs(m.t - s.t), m.t, m.i) rn
    FROM spk s JOIN head m ON s.session_id = m.session_id) WHERE rn = 1""")
part("hist360", ("spkhead",), """
  SELECT session_id, unit, CAST(least(floor(heading / (2 * pi() / 360)), 359) AS INTEGER) AS bin, count(*) n FROM spkhead GROUP BY 1, 2, 3""")
part("hd", ("hist360",), """
  SELECT session_id, unit, CAST((bin + k + 360) % 360 AS INTEGER) AS bin, CAST(sum(n) AS BIGINT) AS n
  FROM hist360, range(-11, 12) t(k) GROUP BY 1, 2, 3""")


@query("hd_hist", compose("SELECT session_id, unit, bin, n FROM hd", "hd"))
def hd_hist(spark, sf):
    return C.heading_histogram(C.spike_headings(tracking(spark, sf), spikes(spark, sf), options(spark, sf)))


@query("hd_vector", compose(f"""
SELECT session_id, unit, {R('sqrt(pow(sum(n * cos(radians(bin - 179))) / sum(n), 2) + pow(sum(n * sin(radians(bin - 179))) / sum(n), 2))')} AS vector_length
FROM hd GROUP BY 1, 2""", "hd"))
def hd_vector(spark, sf):
    hist = C.heading_histogram(C.spike_headings(tracking(spark, sf), spikes(spark, sf), options(spark, sf)))
    return C.mean_vector_length(hist).withColumn("vector_length", rd("vector_length"))


_b36 = "CAST(least(floor(heading / (2 * pi() / 36)), 35) AS INTEGER)"
part("tune", ("head", "spkhead"), f"""
  SELECT a.session_id, a.unit, a.bin, a.n, a.n / (o.n * f.frame) AS rate FROM
   (SELECT session_id, unit, {_b36} AS bin, count(*) n FROM spkhead GROUP BY 1, 2, 3) a
   JOIN (SELECT session_id, {_b36} AS bin, count(*) n FROM head GROUP BY 1, 2) o ON o.session_id = a.session_id AND o.bin = a.bin
   JOIN (SELECT session_id, CASE WHEN count(*) > 1 THEN (max(t) - min(t)) / (count(*) - 1) END AS frame FROM head GROUP BY 1) f
     ON f.session_id = a.session_id""")


@query("tuning_curve", compose(f"SELECT session_id, unit, bin, n, {R('rate * 1e6')} AS rate FROM tune", "tune"))
def tuning_curve(spark, sf):
    t = C.tuning_curve(tracking(spark, sf), spikes(spark, sf), settings=options(spark, sf))
    return t.withColumn("rate", rd(F.col("rate") * 1e6))


@query("tuning_smooth", compose(f"""
SELECT session_id, unit, CAST((bin + k + 36) % 36 AS INTEGER) AS bin, {R('sum(rate) / 3 * 1e6')} AS rate FROM tune, range(-1, 2) t(k) GROUP BY 1, 2, 3""", "tune"))
def tuning_smooth(spark, sf):
    t = C.smooth_tuning(C.tuning_curve(tracking(spark, sf), spikes(spark, sf), settings=options(spark, sf)), 3)
    return t.withColumn("rate", rd(F.col("rate") * 1e6))


# ---------------------------------------------------------------------- speed
import math as _m  # noqa: E402

_half = max(1, _m.ceil(4 * SIGMA_FRAMES))
_g = [_m.exp(-0.5 * (k / SIGMA_FRAMES) ** 2) for k in range(-_half, _half + 1)]
_g = [v / sum(_g) for v in _g]
part("frame", ("speed", "spk"), """
  SELECT f.session_id, f.unit, f.t, f.i, f.speed, coalesce(h.n, 0) * f.fs AS rate FROM
   (SELECT s.*, u.unit, p.fs FROM speed s JOIN (SELECT DISTINCT session_id, unit FROM spk) u ON u.session_id = s.session_id
     JOIN (SELECT session_id, CASE WHEN max(t) > min(t) THEN (count(*) - 1) / (max(t) - min(t)) END fs FROM speed GROUP BY 1) p ON p.session_id = s.session_id) f
   LEFT JOIN (SELECT session_id, unit, tm, count(*) n FROM (
      SELECT s.session_id, s.unit, s.t, (SELECT max(m.t) FROM trk m WHERE m.session_id = s.session_id AND m.t <= s.t) tm FROM spk s) a
      WHERE tm IS NOT NULL AND t <= (SELECT max(m.t) + CASE WHEN count(*) > 1 THEN (max(m.t) - min(m.t)) / (count(*) - 1) END FROM trk m WHERE m.session_id = a.session_id)
      GROUP BY 1, 2, 3) h
   ON h.session_id = f.session_id AND h.unit = f.unit AND h.tm = f.t""")
part("numbered", ("frame",), """
  SELECT *, row_number() OVER (PARTITION BY session_id, unit ORDER BY t, i) - 1 AS k, count(*) OVER (PARTITION BY session_id, unit) AS n FROM frame""")
part("gauss", (), "SELECT * FROM (VALUES " + ", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in zip(range(-_half, _half + 1), _g)) + ") AS t(d, w)")


def _smooth(src: str, col: str) -> str:
    return f"""SELECT a.session_id, a.unit, a.k, sum(g.w * b.{col}) AS v FROM {src} a CROSS JOIN gauss g
      JOIN {src} b ON b.session_id = a.session_id AND b.unit = a.unit AND b.k =
        CASE WHEN ((a.k + g.d) % (2 * a.n) + 2 * a.n) % (2 * a.n) < a.n THEN ((a.k + g.d) % (2 * a.n) + 2 * a.n) % (2 * a.n)
             ELSE 2 * a.n - 1 - ((a.k + g.d) % (2 * a.n) + 2 * a.n) % (2 * a.n) END GROUP BY 1, 2, 3"""


part("smspeed", ("numbered", "gauss"), _smooth("numbered", "speed"))
part("smrate", ("numbered", "gauss"), _smooth("numbered", "rate"))


@query("speed_score", compose(f"""
, j AS (SELECT s.session_id, s.unit, s.v * 1e3 AS a, r.v * 1e3 AS b FROM smspeed s JOIN smrate r ON r.session_id = s.session_id AND r.unit = s.unit AND r.k = s.k)
SELECT session_id, unit, count(*) AS n, {R('CASE WHEN isnan(corr(a, b)) THEN NULL ELSE corr(a, b) END')} AS score_2016 FROM j GROUP BY 1, 2""", "smspeed", "smrate"))
def speed_score(spark, sf):
    s = C.speed_score(tracking(spark, sf), spikes(spark, sf), SIGMA_FRAMES, settings=options(spark, sf))
    return s.select(*UNIT, "n", rd("score_2016").alias("score_2016"))


@query("gauss_smooth_1d", compose(f"""
SELECT n.session_id, n.unit, n.i, {R('s.v', 6)} AS speed_smooth FROM smspeed s JOIN numbered n ON n.session_id = s.session_id AND n.unit = s.unit AND n.k = s.k""", "smspeed", "numbered"))
def gauss_smooth_1d(spark, sf):
    frames = C.frame_rates(T.with_speed(tracking(spark, sf), options(spark, sf)), spikes(spark, sf), options(spark, sf))
    g = C.gaussian_series(frames, UNIT, ["speed"], SIGMA_FRAMES, options(spark, sf))
    return g.select(*UNIT, "i", rd("speed_smooth", 6).alias("speed_smooth"))


@query("speed_score_fixed")
def speed_score_fixed(spark, sf):
    s = C.speed_score(tracking(spark, sf), spikes(spark, sf), SIGMA_FRAMES, 0.0005, SPEED_BAND_HIGH, options(spark, sf))
    return s.select(*UNIT, "n", rd("score_2016").alias("score_2016"), rd("score_2015").alias("score_2015"))


SPEED_BAND_HIGH = 0.02


# ----------------------------------------------------------------- grid cells
@query("autocorrelogram", compose(f"""
, z AS (SELECT session_id, unit, r, c, v - avg(v) OVER (PARTITION BY session_id, unit) AS v FROM srate),
p AS (SELECT session_id, unit, a.r - b.r AS dr, a.c - b.c AS dc, count(*) AS n, sum(a.v) AS s1, sum(b.v) AS s2, sum(a.v * a.v) AS q1, sum(b.v * b.v) AS q2, sum(a.v * b.v) AS ab
  FROM z a JOIN z b USING (session_id, unit) GROUP BY 1, 2, 3, 4),
d AS (SELECT *, q1 - s1 * s1 / n AS f1, q2 - s2 * s2 / n AS f2 FROM p),
e AS (SELECT *, max(f1) OVER (PARTITION BY session_id, unit) AS top1, max(f2) OVER (PARTITION BY session_id, unit) AS top2 FROM d)
SELECT session_id, unit, CAST(dr + 14 AS INTEGER) AS r, CAST(dc + 14 AS INTEGER) AS c,
  {R('CASE WHEN f1 > 1e-10 * top1 AND f2 > 1e-10 * top2 THEN greatest(-1, least(1, (ab - s1 * s2 / n) / sqrt(f1 * f2))) ELSE 0 END')} AS v
FROM e WHERE abs(dr) <= 14 AND abs(dc) <= 14""", "srate"))
def autocorrelogram(spark, sf):
    return C.autocorrelation(dense_rate(spark, sf), UNIT, "rate", ROWS, COLS).withColumn("v", rd("v"))


@query("grid_score")
def grid_score(spark, sf):
    return C.grid_score(dense_rate(spark, sf), UNIT, "rate", ROWS, COLS)


# ------------------------------------------------- smoothing with empty places
RING, SIGMA_RING, SIGMA_MAP = OPTIONS.tuning_bins, 1.5, 1.0


def _taps(n: int, sigma: float, circular: bool) -> str:
    reach = -(-int(8 * sigma) // 2) if sigma * 8 == int(sigma * 8) else int(8 * sigma + 1) // 2
    to = f"(i.k + d.k + {n}) % {n}" if circular else f"greatest(0, least({n - 1}, i.k + d.k))"
    return (f"SELECT CAST(i.k AS INTEGER) AS dst, CAST({to} AS INTEGER) AS src, sum(exp(-0.5 * pow(d.k / {sigma!r}::DOUBLE, 2))) AS w "
            f"FROM range({n}) i(k), range(-{reach}, {reach + 1}) d(k) GROUP BY 1, 2")


part("ringtap", (), _taps(RING, SIGMA_RING, True))
part("ring", ("trk", "head"), f"""
  SELECT session_id, CAST(least(floor(heading / (2 * pi() / {RING})), {RING - 1}) AS INTEGER) AS bin, count(*)::DOUBLE AS n FROM head GROUP BY 1, 2""")


@query("ring_smooth", compose(f"""
SELECT r.session_id, t.dst AS bin, {R('sum(t.w * r.n) / sum(t.w)')} AS v FROM ring r JOIN ringtap t ON t.src = r.bin GROUP BY 1, 2""", "ring", "ringtap"))
def ring_smooth(spark, sf):
    """Samples per heading, smoothed around the circle; headings never seen get the value of their surroundings."""
    head = T.with_heading(tracking(spark, sf), options(spark, sf))
    n = head.where("heading IS NOT NULL").groupBy(*SESSION, F.least(F.floor(F.col("heading") / F.lit(2 * math.pi / RING)), F.lit(RING - 1)).cast("int").alias("c")).agg(
        F.count(F.lit(1)).cast("double").alias("v")).withColumn("r", F.lit(0))
    ring = M.dense(M.pack(n, SESSION, RING), SESSION, 1, RING, "v", normalise=False)
    ring = ring.withColumn("v", F.transform("v", lambda x: F.when(x > 0, x)))
    s = M.smooth_visible(ring, SESSION, "v", 1, RING, SIGMA_RING, circular=True, fill=None)
    return M.unpack(s, SESSION, "v", RING).where("v IS NOT NULL").select(*SESSION, F.col("c").alias("bin"), rd("v").alias("v"))


part("maptap", (), _taps(ROWS, SIGMA_MAP, False))


@query("masked_smooth", compose(f"""
, s AS (SELECT o.session_id, a.dst AS r, b.dst AS c, sum(a.w * b.w * o.v) / sum(a.w * b.w) AS v FROM occ o JOIN maptap a ON a.src = o.r JOIN maptap b ON b.src = o.c GROUP BY 1, 2, 3)
SELECT s.session_id, s.r, s.c, {R('s.v', 3)} AS v FROM s JOIN occ o ON o.session_id = s.session_id AND o.r = s.r AND o.c = s.c""", "occ", "maptap"))
def masked_smooth(spark, sf):
    """Occupancy smoothed over the visited bins alone; bins never visited stay empty."""
    d = M.pack(occupancy(spark, sf), SESSION, COLS)
    seen = d.withColumn("_at", F.map_from_arrays("bins", "vals")).select(
        *SESSION, F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda b: F.try_element_at("_at", b)).alias("v"))
    s = M.smooth_visible(seen, SESSION, "v", ROWS, COLS, SIGMA_MAP)
    return M.unpack(s, SESSION, "v", COLS).where("v IS NOT NULL").withColumn("v", rd("v", 3))
