"""The tables of a remapping study: whole maps, spike clouds, rates and spike times of a cell in
consecutive sessions, each against different cells of the same two sessions; and a row per animal."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikegrid.operators import distances as D, fields as FL, nulls as N
from spikegrid.plans.base import COLS, R, compose, options, part, query, rd
from spikegrid.plans.field_sets import count_fields, recursive
from spikegrid.plans.remapping import (
    BIN, CELL, DIR_SQL, DIRECTIONS, HEIGHT, LINK, ROWS, WEEK, WIDTH, cells, link_points, null_pairs, packed_links, w_sql,
)
from spikegrid.session import computed_once

PAIR = ["animal_id", "prev_no", "session_no"]
CROSS = [*PAIR, "cell_a", "cell_b"]
_L, _NK, _X = "animal_id, cell, prev_no, session_no", "animal_id, prev_no, session_no", "animal_id, prev_no, session_no, cell_a, cell_b"


# ------------------------------------------------------------------- shared parts
def pair_points(points, pairs):
    """Points of both cells of each pair with side a (first cell, earlier session) or b."""
    ends = pairs.select(*CROSS, F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("prev_no").alias("n"), F.col("cell_a").alias("cell")),
        F.struct(F.lit("b").alias("side"), F.col("session_no").alias("n"), F.col("cell_b").alias("cell")))).alias("e"))
    ends = ends.select(*CROSS, F.col("e.side").alias("side"), F.col("e.n").alias("_n"), F.col("e.cell").alias("cell"))
    return points.withColumnRenamed("session_no", "_n").join(ends, ["animal_id", "_n", "cell"]).drop("_n", "cell")


def against(observed, null, name):
    """(link, name, name_n, _mean, _std, _z, _median, _mad, _mod_z, _q): values against those of
    different cells of the same two sessions. Values are rounded first, so ties are ties; the
    rest is rounded a little up, since ratios of small counts often end in an exact half."""
    exact = lambda d: d.withColumn("value", F.round("value", 6))
    s = N.with_quantile(N.with_scores(exact(observed), N.null_statistics(exact(null), PAIR), PAIR))
    spread = F.col("null_std") > 1e-9
    return s.select(*LINK, rd("value", 6).alias(name), F.col("null_n").alias(f"{name}_n"), rd(F.col("null_mean") + 1e-7, 4).alias(f"{name}_mean"), rd(F.col("null_std") + 1e-7, 4).alias(f"{name}_std"),
                    F.when(spread, rd(F.col("z") + 1e-7, 3)).alias(f"{name}_z"), rd(F.col("null_median") + 1e-9, 5).alias(f"{name}_median"), rd(F.col("null_mad") + 1e-7, 3).alias(f"{name}_mad"),
                    rd(F.col("mod_z") + 1e-7, 3).alias(f"{name}_mod_z"), rd(F.col("quantile") + 1e-7, 4).alias(f"{name}_q"))


def against_sql(name: str, observed: str, null: str) -> str:
    """CTEs that end in ``name`` with the columns of :func:`against`; both sources give (keys, d)."""
    return f"""
{name}_o AS (SELECT {_L}, round(d, 6) AS d FROM {observed}), {name}_e AS (SELECT {_NK}, round(d, 6) AS d FROM {null} WHERE d IS NOT NULL),
{name}_s AS (SELECT {_NK}, count(*) n, avg(d) mu, stddev_pop(d) sd, median(d) med, min(d) lo, max(d) hi FROM {name}_e GROUP BY {_NK}),
{name}_m AS (SELECT {_NK}, median(abs(d - med)) * 1.482602218505602 AS mad FROM {name}_e JOIN {name}_s USING ({_NK}) GROUP BY {_NK}),
{name}_l AS (SELECT *, n::DOUBLE AS nn, CASE WHEN hi = lo THEN 0.5 ELSE (hi - lo) / (2 * (n - 1)) END AS pad FROM {name}_s),
{name}_p AS (SELECT o.*, n, nn, mu, sd, med, mad, lo - pad AS low, (hi - lo + 2 * pad) / nn AS w,
   (d - (lo - pad)) / CASE WHEN nn > 1 THEN (hi - lo + 2 * pad) / nn * nn / (nn - 1) ELSE 1.0 END AS pos FROM {name}_o o JOIN {name}_l USING ({_NK}) JOIN {name}_m USING ({_NK})),
{name}_k AS (SELECT *, greatest(0, least(floor(pos), nn - 1)) AS k FROM {name}_p),
{name}_c AS (SELECT {', '.join('k.' + c for c in _L.split(', '))}, sum(CASE WHEN greatest(0, least(floor((e.d - low) / w), nn - 1)) <= k THEN 1 ELSE 0 END) c0,
   sum(CASE WHEN greatest(0, least(floor((e.d - low) / w), nn - 1)) <= k + 1 THEN 1 ELSE 0 END) c1 FROM {name}_k k JOIN {name}_e e USING ({_NK}) GROUP BY 1, 2, 3, 4),
{name} AS (SELECT {_L}, {R("d", 6)} AS {name}, n AS {name}_n, {R('mu + 1e-7')} AS {name}_mean, {R('sd + 1e-7')} AS {name}_std, CASE WHEN sd > 1e-9 THEN {R('(d - mu) / sd + 1e-7', 3)} END AS {name}_z,
   {R('med + 1e-9', 5)} AS {name}_median, {R('mad + 1e-7', 3)} AS {name}_mad, {R('0.6745 * (d - med) / CASE WHEN mad = 0 THEN 1 ELSE mad END + 1e-7', 3)} AS {name}_mod_z,
   {R('(c0 + (c1 - c0) * greatest(0.0, least(pos - k, 1.0))) / nn + 1e-7')} AS {name}_q FROM {name}_k JOIN {name}_c USING ({_L}))"""


part("xpts", ("npair", "cells"), """
  SELECT p.animal_id, p.prev_no, p.session_no, p.cell_a, p.cell_b, 'a' AS side, c.t, c.x, c.y FROM npair p JOIN cells c ON c.animal_id = p.animal_id AND c.session_no = p.prev_no AND c.cell = p.cell_a
  UNION ALL SELECT p.animal_id, p.prev_no, p.session_no, p.cell_a, p.cell_b, 'b', c.t, c.x, c.y FROM npair p JOIN cells c ON c.animal_id = p.animal_id AND c.session_no = p.session_no AND c.cell = p.cell_b""")


def _emd_sql(name: str, source: str, keys: str) -> str:
    return f"""
{name}_b AS (SELECT {keys}, min(t) lo, max(t) hi, sum(CASE WHEN side = 'a' THEN 1 ELSE 0 END) na, sum(CASE WHEN side = 'b' THEN 1 ELSE 0 END) nb FROM {source} GROUP BY {keys}),
{name}_m AS (SELECT {keys}, least(floor((t - lo) / {BIN}), greatest(ceil((hi - lo) / {BIN}), 1) - 1) AS bin, sum(CASE WHEN side = 'a' THEN 1.0::DOUBLE / na ELSE -1.0::DOUBLE / nb END) AS m
   FROM {source} JOIN {name}_b USING ({keys}) WHERE na > 0 AND nb > 0 GROUP BY ALL),
{name}_c AS (SELECT {keys}, bin, sum(m) OVER w AS c, lead(bin) OVER w AS nx FROM {name}_m WINDOW w AS (PARTITION BY {keys} ORDER BY bin)),
{name} AS (SELECT {keys}, coalesce(sum(abs(c) * (nx - bin)), 0) AS d FROM {name}_c GROUP BY {keys})"""


# ------------------------------------------------------------------- the tables

REGULAR_SQL = compose(f"""
, {", ".join(w_sql("nwhole", _X + ", k", 2))}, nd AS (SELECT {_X}, sqrt(avg(wpp)) AS d FROM nwhole_w GROUP BY {_X}),
{", ".join(w_sql("whole", _L + ", k", 2))}, od AS (SELECT {_L}, sqrt(avg(wpp)) AS d FROM whole_w GROUP BY {_L}),
sx AS (SELECT {_X}, k, side, x * ux + y * uy AS x, 1.0::DOUBLE AS w FROM xpts, {DIR_SQL}), {", ".join(w_sql("sx", _X + ", k", 2))}, nsd AS (SELECT {_X}, sqrt(avg(wpp)) AS d FROM sx_w GROUP BY {_X}),
so AS (SELECT {_L}, k, side, x * ux + y * uy AS x, 1.0::DOUBLE AS w FROM pts, {DIR_SQL}), {", ".join(w_sql("so", _L + ", k", 2))}, osd AS (SELECT {_L}, sqrt(avg(wpp)) AS d FROM so_w GROUP BY {_L}),
nn AS (SELECT {_X}, count(*) FILTER (side = 'a')::DOUBLE AS na, count(*) FILTER (side = 'b')::DOUBLE AS nb FROM xpts GROUP BY {_X}),
oo AS (SELECT {_L}, count(*) FILTER (side = 'a')::DOUBLE AS na, count(*) FILTER (side = 'b')::DOUBLE AS nb FROM pts GROUP BY {_L}),
nra AS (SELECT {_NK}, nb / na AS d FROM nn), ora AS (SELECT {_L}, nb / na AS d FROM oo), nch AS (SELECT {_NK}, (nb - na) / {WEEK} * 1e6 AS d FROM nn), och AS (SELECT {_L}, (nb - na) / {WEEK} * 1e6 AS d FROM oo),
{against_sql('whole_wass', 'od', 'nd')}, {against_sql('sd_wass', 'osd', 'nsd')}, {against_sql('fr_ratio', 'ora', 'nra')}, {against_sql('fr_change', 'och', 'nch')}
SELECT *, {R('1 - whole_wass_q + 1e-7')} AS phigher, {R('2 * least(whole_wass_q, 1 - whole_wass_q) + 1e-7')} AS ptwotail, CAST(na AS BIGINT) AS spikes_prev, CAST(nb AS BIGINT) AS spikes_curr
FROM whole_wass JOIN sd_wass USING ({_L}) JOIN fr_ratio USING ({_L}) JOIN fr_change USING ({_L}) JOIN oo USING ({_L})""", "whole", "nwhole", "xpts", "pts").replace(
    "SELECT *, (ROUND(1", "SELECT * EXCLUDE (na, nb), (ROUND(1")


@query("remapping_regular", REGULAR_SQL)
def remapping_regular(spark, sf):
    """A row for each cell in two consecutive sessions: distances of whole maps and spike clouds and the
    change of rate, each with its place among different cells."""
    d = computed_once(cells(spark, sf).select(*CELL, "x", "y"))
    pairs = computed_once(null_pairs(spark, sf))
    mine = packed_links(spark, sf)
    size = lambda df, keep, name: D.map_distance(df, keep, ROWS, COLS, HEIGHT, WIDTH, DIRECTIONS, name=name)
    whole = against(size(mine, LINK, "value"), size(pairs, CROSS, "value"), "whole_wass")
    s = options(spark, sf, "animal_id", 10)
    one = lambda p: p.withColumn("w", F.lit(1.0))
    own, other = link_points(d), pair_points(d, pairs.select(*CROSS))
    cloud = lambda p, k: D.sliced_distance(one(p), k, DIRECTIONS, 2, s).withColumnRenamed("distance", "value")
    clouds = against(cloud(own, LINK), cloud(other, CROSS), "sd_wass")
    side = lambda k: F.count_if(F.col("side") == k).cast("double")
    counted = lambda p, k: p.groupBy(*k).agg(side("a").alias("na"), side("b").alias("nb"))
    n, m = computed_once(counted(own, LINK)), counted(other, CROSS)
    rate = lambda df, keep: df.select(*keep, (F.col("nb") / F.col("na")).alias("value"))
    change = lambda df, keep: df.select(*keep, ((F.col("nb") - F.col("na")) / F.lit(WEEK) * 1e6).alias("value"))
    out = whole.join(clouds, LINK).join(against(rate(n, LINK), rate(m, PAIR), "fr_ratio"), LINK).join(against(change(n, LINK), change(m, PAIR), "fr_change"), LINK)
    q = F.col("whole_wass_q")
    out = out.withColumns({"phigher": rd(1 - q + 1e-7), "ptwotail": rd(2 * F.least(q, 1 - q) + 1e-7)})
    return out.join(n.select(*LINK, F.col("na").cast("long").alias("spikes_prev"), F.col("nb").cast("long").alias("spikes_curr")), LINK)


@query("remapping_temporal", compose(f"""
, {_emd_sql('td', 'pts', _L)}, {_emd_sql('tn', 'xpts', _X)}, {against_sql('emd', 'td', 'tn')} SELECT * FROM emd""", "pts", "xpts"))
def remapping_temporal(spark, sf):
    """Temporal distance of each cell in consecutive sessions, with its place among different cells."""
    d = computed_once(cells(spark, sf).select(*CELL, "t"))
    s = options(spark, sf, "animal_id", 10)
    emd = lambda p, k: D.temporal_distance(p, k, BIN, s).withColumnRenamed("emd", "value")
    return against(emd(link_points(d), LINK), emd(pair_points(d, null_pairs(spark, sf).select(*CROSS)), CROSS), "emd")


@query("animal_cells", recursive(compose("""
, n AS (SELECT animal_id, count(DISTINCT session_no) AS sessions, count(DISTINCT cell) AS cells, count(*) AS spikes FROM cells GROUP BY 1),
f AS (SELECT animal_id, max(k) AS most_fields, sum(k) AS fields FROM (SELECT animal_id, session_no, cell, count(DISTINCT first) AS k FROM cfield GROUP BY 1, 2, 3) GROUP BY 1)
SELECT animal_id, sessions, cells, spikes, coalesce(most_fields, 0) AS most_fields, CAST(coalesce(fields, 0) AS BIGINT) AS fields FROM n LEFT JOIN f USING (animal_id)""", "cells", "cfield")))
def animal_cells(spark, sf):
    """Per animal: its sessions, cells and spikes, and the fields of all its maps."""
    n = cells(spark, sf).groupBy("animal_id").agg(F.count_distinct("session_no").alias("sessions"), F.count_distinct("cell").alias("cells"), F.count(F.lit(1)).alias("spikes"))
    k = FL.field_bins(count_fields(spark, sf), CELL, "rate", COLS).groupBy(*CELL).agg(F.count_distinct("field_id").alias("k"))
    f = k.groupBy("animal_id").agg(F.max("k").alias("most_fields"), F.sum("k").alias("fields"))
    return n.join(f, "animal_id", "left").na.fill(0, ["most_fields", "fields"])
