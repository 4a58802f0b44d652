"""Null distributions with the published number of iterations."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikegrid.functions import map_scores
from spikegrid.operators import distances as D, null_maps as NM, nulls as N, relabel as RL, tracking as T
from spikegrid.plans.base import ARENA, COL_SQL, COLS, OPTIONS, ROW_SQL, ROWS, R, compose, events, options, part, query, rd, spikes, tracking
from spikegrid.plans.remapping import BIN, LIMIT, LINK, cells, link_points
from spikegrid.plans.spatial import UNIT, occupancy
from spikegrid.settings import DEFAULT

SHUFFLES = DEFAULT.shuffle_iterations
GOLDEN = (5 ** 0.5 - 1) / 2
HALF = min(ROWS, COLS) / 2
CELL_COUNT = ROWS * COLS


# ------------------------------------------------- all scores of shifted trains
part("manyshift", ("spk",), f"""
  SELECT session_id, unit, iter, CASE WHEN m > t1 THEN m - (t1 - t0) ELSE m END AS t FROM (
    SELECT session_id, unit, iter, t0, t1, CASE WHEN iter = 0 THEN t ELSE t + (lim + share * (t1 - 2 * lim)) END AS m FROM (
      SELECT *, CASE WHEN {LIMIT} >= (t1 - t0) / 2 THEN CASE WHEN floor((t1 - t0) / 2) = (t1 - t0) / 2 THEN (t1 - t0) / 2 - 1 ELSE floor((t1 - t0) / 2) END ELSE {LIMIT} END AS lim
      FROM (SELECT *, min(t) OVER (PARTITION BY session_id, unit) t0, max(t) OVER (PARTITION BY session_id, unit) t1 FROM spk) WHERE t1 > t0),
      (SELECT CAST(k AS INTEGER) AS iter, (k * {GOLDEN!r}::DOUBLE) % 1.0::DOUBLE AS share FROM range({SHUFFLES + 1}) s(k)))""")
part("samples", ("moving",), f"SELECT session_id, t, arg_min(r, i) AS r, arg_min(c, i) AS c FROM (SELECT session_id, t, i, {ROW_SQL} AS r, {COL_SQL} AS c FROM moving) GROUP BY 1, 2")
part("manybins", ("manyshift", "samples", "occ"), f"""
  SELECT k.session_id, k.unit, k.iter, k.r, k.c, k.n / o.v AS v, o.v / d.dur AS p FROM (
    SELECT session_id, unit, iter, r, c, count(*)::DOUBLE AS n FROM (
      SELECT s.session_id, s.unit, s.iter, CASE WHEN back THEN b.r ELSE a.r END AS r, CASE WHEN back THEN b.c ELSE a.c END AS c FROM (
        SELECT s.session_id, s.unit, s.iter, b.t AS bt, a.t AS at, b.t IS NOT NULL AND (a.t IS NULL OR s.t - b.t <= a.t - s.t) AS back
        FROM manyshift s ASOF LEFT JOIN samples b ON s.session_id = b.session_id AND s.t >= b.t ASOF LEFT JOIN samples a ON s.session_id = a.session_id AND s.t < a.t) s
      LEFT JOIN samples b ON b.session_id = s.session_id AND b.t = s.bt LEFT JOIN samples a ON a.session_id = s.session_id AND a.t = s.at
      WHERE s.bt IS NOT NULL OR s.at IS NOT NULL) GROUP BY 1, 2, 3, 4, 5) k
  JOIN occ o ON o.session_id = k.session_id AND o.r = k.r AND o.c = k.c
  JOIN (SELECT session_id, sum(v) dur FROM occ GROUP BY 1) d ON d.session_id = k.session_id WHERE o.v >= 1e-4""")
# maps with rates in fewer than a quarter of their bins: the percentile is 0, so every bin is active
_border = lambda d: f"CASE WHEN bins >= {CELL_COUNT // 4} THEN error('a map too full for this SQL') ELSE (1 - {d}) / (1 + {d}) END"
_far = lambda e: f"(sum({e} * v) / max(v) / {CELL_COUNT} / {HALF})"
NULL_REPORT_SQL = compose(f"""
, f AS (SELECT session_id, unit, iter, sum(p * v) AS m1, sum(p * v * v) AS m2, max(v) AS peak, count(*) AS bins,
     {_far('r')} AS top, {_far(f'({COLS} - r)')} AS bottom, {_far('c')} AS lft, {_far(f'({ROWS} - c)')} AS rgt
   FROM manybins GROUP BY 1, 2, 3),
i AS (SELECT b.session_id, b.unit, b.iter, sum(CASE WHEN v > m1 THEN p * v * log2(v / m1) ELSE 0 END) / max(m1) AS info
   FROM manybins b JOIN f USING (session_id, unit, iter) GROUP BY 1, 2, 3),
g AS (SELECT session_id, unit, iter, r + dr AS r, c + dc AS c, sum(CASE WHEN dr = 0 AND dc = 0 THEN v ELSE 0 END) AS a, sum(CASE WHEN dr = 0 AND dc = 0 THEN 0 ELSE v / 8 END) AS b
   FROM manybins, (VALUES (-1), (0), (1)) x(dr), (VALUES (-1), (0), (1)) y(dc)
   WHERE r + dr BETWEEN 0 AND {ROWS - 1} AND c + dc BETWEEN 0 AND {COLS - 1} GROUP BY 1, 2, 3, 4, 5),
h AS (SELECT session_id, unit, iter, sum(a) sa, sum(b) sb, sum(a * a) saa, sum(b * b) sbb, sum(a * b) sab FROM g GROUP BY 1, 2, 3),
w AS (SELECT session_id, unit, iter, info AS information, m1 * m1 / m2 AS sparsity, peak / m1 AS selectivity,
     (sab - sa * sb / {CELL_COUNT}) / sqrt((saa - sa * sa / {CELL_COUNT}) * (sbb - sb * sb / {CELL_COUNT})) AS coherence,
     {_border('top')} AS border_top, {_border('bottom')} AS border_bottom, {_border('lft')} AS border_left, {_border('rgt')} AS border_right
   FROM f JOIN i USING (session_id, unit, iter) JOIN h USING (session_id, unit, iter)),
l AS (UNPIVOT w ON information, sparsity, selectivity, coherence, border_top, border_bottom, border_left, border_right INTO NAME score VALUE v),
n AS (SELECT l.*, o.v AS observed, 1e-9 * greatest(1.0, abs(o.v)) AS slack FROM l JOIN l o ON o.session_id = l.session_id AND o.unit = l.unit AND o.score = l.score AND o.iter = 0 WHERE l.iter > 0)
SELECT session_id, unit, score, {R('max(observed)')} AS observed, count(*) AS null_n, {R('avg(v)')} AS null_mean, {R('stddev_pop(v)')} AS null_std,
  {R('avg(CASE WHEN v < observed - slack THEN 1.0 ELSE 0 END)')} AS below, {R('avg(CASE WHEN v > observed + slack THEN 1.0 ELSE 0 END)')} AS above
FROM n GROUP BY 1, 2, 3""", "manybins")


def shifted(spark, sf, *names):
    """The report on the named scores (all, if none is named) of shifted trains."""
    moving = T.speed_between(T.with_speed(tracking(spark, sf), options(spark, sf)), 0.0, OPTIONS.speed_high)
    return NM.shifted_report(spikes(spark, sf), moving, occupancy(spark, sf), ARENA, ROWS, COLS, N.lattice_shares(SHUFFLES), LIMIT,
                             names or map_scores.NAMES, options(spark, sf))


@query("null_report", NULL_REPORT_SQL)
def null_report(spark, sf):
    """Information, sparsity, selectivity, coherence and four wall scores of every unit against 1000 shifts of its train."""
    report = shifted(spark, sf)
    return report.select(*UNIT, "score", rd("observed").alias("observed"), "null_n", *[rd(c).alias(c) for c in ("null_mean", "null_std", "below", "above")])


@query("null_pvalue", compose(f"""
, f AS (SELECT session_id, unit, iter, sum(p * v) AS m1 FROM manybins GROUP BY 1, 2, 3),
i AS (SELECT b.session_id, b.unit, b.iter, sum(CASE WHEN v > m1 THEN p * v * log2(v / m1) ELSE 0 END) / max(m1) AS info
   FROM manybins b JOIN f USING (session_id, unit, iter) GROUP BY 1, 2, 3)
SELECT n.session_id, n.unit, count(*) AS iterations, {R('avg(n.info)')} AS shuffled_mean, {R('stddev_pop(n.info)')} AS shuffled_std,
  {R('avg(CASE WHEN n.info > o.info + 1e-9 * greatest(1, abs(o.info)) THEN 1.0 ELSE 0 END)')} AS p_value
FROM i n JOIN i o ON o.session_id = n.session_id AND o.unit = n.unit AND o.iter = 0 WHERE n.iter > 0 GROUP BY 1, 2""", "manybins"))
def null_pvalue(spark, sf):
    """Spatial information of every unit against 1000 shifts of its train."""
    r = shifted(spark, sf, "information")
    return r.select(*UNIT, F.col("null_n").alias("iterations"), rd("null_mean").alias("shuffled_mean"), rd("null_std").alias("shuffled_std"), rd("above").alias("p_value"))


# ------------------------------------------------------ relabelled spike times
_M = "4294967296::UBIGINT"
_stir = lambda x: f"((xor({x} >> 16, {x}) * {RL.MIX}::UBIGINT) % {_M})"
part("pool", ("links", "cells"), """
  SELECT l.animal_id, l.cell, l.prev_no, l.session_no, CASE WHEN c.session_no = l.prev_no THEN 'a' ELSE 'b' END AS side, c.i, c.t
  FROM links l JOIN cells c ON c.animal_id = l.animal_id AND c.cell = l.cell AND (c.session_no = l.prev_no OR c.session_no = l.session_no)""")
_L = "animal_id, cell, prev_no, session_no"


@query("temporal_permutation_null", compose(f"""
, per AS (SELECT {_L}, sum(CASE WHEN side = 'a' THEN 1 ELSE 0 END) AS na, sum(CASE WHEN side = 'b' THEN 1 ELSE 0 END) AS nb, min(t) AS lo, max(t) AS hi FROM pool GROUP BY {_L}),
b AS (SELECT pool.*, na, nb, least(floor((t - lo) / {BIN}), greatest(ceil((hi - lo) / {BIN}), 1) - 1) AS bin FROM pool JOIN per USING ({_L}) WHERE na > 0 AND nb > 0),
x0 AS (SELECT b.*, k, ((i % 4294967296)::UBIGINT * {RL.SPIKE}::UBIGINT + (k + 1)::UBIGINT * {RL.ITERATION}::UBIGINT + {OPTIONS.seed}::UBIGINT) % {_M} AS x FROM b, range({SHUFFLES}) r(k)),
x1 AS (SELECT * REPLACE ({_stir('x')} AS x) FROM x0), x2 AS (SELECT * REPLACE ({_stir('x')} AS x) FROM x1),
d AS (SELECT {_L}, k, bin, na, nb, row_number() OVER (PARTITION BY {_L}, k ORDER BY xor(x >> 16, x), i) <= na AS is_a FROM x2
      UNION ALL SELECT {_L}, -1, bin, na, nb, side = 'a' FROM b),
m AS (SELECT {_L}, k, bin, sum(CASE WHEN is_a THEN 1.0::DOUBLE / na ELSE -1.0::DOUBLE / nb END) AS m FROM d GROUP BY {_L}, k, bin),
c AS (SELECT {_L}, k, bin, sum(m) OVER w AS c, lead(bin) OVER w AS nx FROM m WINDOW w AS (PARTITION BY {_L}, k ORDER BY bin)),
e AS (SELECT {_L}, k, coalesce(sum(abs(c) * (nx - bin)), 0) AS emd FROM c GROUP BY {_L}, k)
SELECT {_L}, {R('max(o.emd) + 1e-9')} AS observed, count(*) AS null_n, {R('avg(e.emd) + 1e-9')} AS null_mean, {R('stddev_pop(e.emd) + 1e-9')} AS null_std,
  {R('avg(CASE WHEN e.emd > o.emd + 1e-6 THEN 1.0 ELSE 0 END)')} AS above
FROM e JOIN e o USING ({_L}) WHERE e.k >= 0 AND o.k = -1 GROUP BY {_L}""", "pool"))
def temporal_permutation_null(spark, sf):
    """Temporal distance of a cell's consecutive sessions against 1000 relabellings of their spikes."""
    d = RL.relabelled_distances(link_points(cells(spark, sf)).select(*LINK, "i", "side", "t"), LINK, BIN, SHUFFLES, OPTIONS.seed, options(spark, sf, "animal_id", 2))
    each = d.select(*LINK, "observed", F.explode("nulls").alias("v"))
    off = lambda c: rd(c + 1e-9)  # noqa: E731  (multiples of small fractions often end in an exact half)
    return each.groupBy(*LINK).agg(off(F.max("observed")).alias("observed"), F.count(F.lit(1)).alias("null_n"), off(F.avg("v")).alias("null_mean"),
                                   off(F.stddev_pop("v")).alias("null_std"), rd(F.avg((F.col("v") > F.col("observed") + 1e-6).cast("double"))).alias("above"))


PROJECTIONS = D.lattice_projections(DEFAULT.n_projections)


@query("permutation_null")
def permutation_null(spark, sf):
    """Sliced distance of consecutive sessions, over 50 directions, against 1000 relabellings of their spikes."""
    pts = link_points(cells(spark, sf)).select(*LINK, "side", "i", "x", "y")
    d = RL.relabelled_sliced(pts, LINK, PROJECTIONS, SHUFFLES, OPTIONS.seed, settings=options(spark, sf, "animal_id", 2), margin=1e-9)
    return d.select(*LINK, *[rd(c).alias(c) for c in ("observed", "null_mean", "null_std", "above")], F.col("null_n").alias("n"))


# ------------------------------------------------------------------- bootstrap
@query("bootstrap_mean", compose(f"""
, b AS (SELECT session_id, x, row_number() OVER (PARTITION BY session_id ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY session_id) AS n FROM ev WHERE x IS NOT NULL),
x0 AS (SELECT session_id, n, k, (j::UBIGINT * {RL.SPIKE}::UBIGINT + (k + 1)::UBIGINT * {RL.ITERATION}::UBIGINT + {OPTIONS.seed}::UBIGINT) % {_M} AS x FROM b, range({SHUFFLES}) r(k)),
x1 AS (SELECT * REPLACE ({_stir('x')} AS x) FROM x0), x2 AS (SELECT * REPLACE ({_stir('x')} AS x) FROM x1),
m AS (SELECT x2.session_id, k, avg(b.x) AS m FROM x2 JOIN b ON b.session_id = x2.session_id AND b.j = xor(x2.x >> 16, x2.x) % x2.n::UBIGINT GROUP BY 1, 2)
SELECT session_id, (SELECT max(n) FROM b WHERE b.session_id = m.session_id) AS n, {R('avg(m) + 1e-9')} AS boot_mean, {R('stddev_pop(m)')} AS boot_std FROM m GROUP BY 1""", "ev"))
def bootstrap_mean(spark, sf):
    """Mean and deviation of 1000 bootstrapped means of each session."""
    e = events(spark, sf).select("session_id", "i", "x")
    each = N.bootstrap_means(e, ["session_id"], "i", "x", SHUFFLES, OPTIONS.seed, options(spark, sf))
    long = each.select("session_id", "n", F.explode("means").alias("m"))
    return long.groupBy("session_id").agg(F.max("n").alias("n"), rd(F.avg("m") + 1e-9).alias("boot_mean"), rd(F.stddev_pop("m")).alias("boot_std"))
