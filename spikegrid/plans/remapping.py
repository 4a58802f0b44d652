"""Field, null and between-session queries.

animal = user, session = week of the recording, cell = event type; every event is
a spike at its own position.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spikegrid.operators import distances as D, fields as FL, maps as M, nulls as N
from spikegrid.plans.base import ARENA, COL_SQL, COLS, OPTIONS, options, ROW_SQL, ROWS, R, compose, events, part, query, rd, spikes
from spikegrid.plans.spatial import UNIT, dense_rate
from spikegrid.functions.expr import grid_col, grid_row

WEEK = 604_800.0
CELL = ["animal_id", "session_no", "cell"]
LINK = ["animal_id", "cell", "prev_no", "session_no"]
HEIGHT, WIDTH = ARENA.y_hi - ARENA.y_lo, ARENA.x_hi - ARENA.x_lo
DIRECTIONS = D.lattice_projections(OPTIONS.n_projections)
SHARES = N.lattice_shares(20)
LIMIT = 3_600.0


# ---------------------------------------------------------------- base tables
def cells(spark, sf):
    return events(spark, sf).select(
        F.col("session_id").alias("animal_id"), (F.floor(F.col("t") / WEEK) + 1).cast("int").alias("session_no"),
        F.col("unit").alias("cell"), "i", "t", "x", "y")


def links(df):
    """Sessions of a cell with the previous session in which it appears.

    One row per (cell, session) enters the window, so its groups are small.
    """
    seen = df.select(*CELL).distinct()
    w = Window.partitionBy("animal_id", "cell").orderBy("session_no")
    return seen.withColumn("prev_no", F.lag("session_no").over(w)).where("prev_no IS NOT NULL").select(*LINK)


def link_points(df):
    """Points of both sessions of each link with side a (previous) or b (current).

    A spike belongs to at most two links: as current and as previous session.
    """
    ln = links(df)
    ends = ln.withColumn("_e", F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("prev_no").alias("n")),
        F.struct(F.lit("b").alias("side"), F.col("session_no").alias("n")))))
    ends = ends.select(*LINK, F.col("_e.side").alias("side"), F.col("_e.n").alias("_n"))
    d = df.withColumnRenamed("session_no", "_n")
    return d.join(ends, ["animal_id", "cell", "_n"]).drop("_n")


def cell_maps(spark, sf):
    d = cells(spark, sf)
    return d.groupBy(*CELL, grid_row("y", ARENA, ROWS).alias("r"), grid_col("x", ARENA, COLS).alias("c")).agg(
        F.count(F.lit(1)).cast("double").alias("v"))


part("cells", ("ev",), f"""
  SELECT session_id AS animal_id, CAST(floor(t / {WEEK}) AS INTEGER) + 1 AS session_no, unit AS cell, i, t, x, y FROM ev""")
part("links", ("cells",), """
  SELECT * FROM (SELECT animal_id, cell, session_no,
     lag(session_no) OVER (PARTITION BY animal_id, cell ORDER BY session_no) AS prev_no
     FROM (SELECT DISTINCT animal_id, cell, session_no FROM cells)) WHERE prev_no IS NOT NULL""")
part("pts", ("links", "cells"), """
  SELECT l.animal_id, l.cell, l.prev_no, l.session_no, 'a' AS side, c.t, c.x, c.y FROM links l JOIN cells c
    ON c.animal_id = l.animal_id AND c.cell = l.cell AND c.session_no = l.prev_no
  UNION ALL SELECT l.animal_id, l.cell, l.prev_no, l.session_no, 'b', c.t, c.x, c.y FROM links l JOIN cells c
    ON c.animal_id = l.animal_id AND c.cell = l.cell AND c.session_no = l.session_no""")
part("cmap", ("cells",), f"""
  SELECT animal_id, session_no, cell, {ROW_SQL} AS r, {COL_SQL} AS c, CAST(count(*) AS DOUBLE) AS v
  FROM cells GROUP BY 1, 2, 3, 4, 5""")


def w_sql(src: str, keys: str, p: int) -> list[str]:
    """SQL of the quantile merge over ``src(keys, side, x, w)``."""
    return [
        f"{src}_f AS (SELECT {keys}, side, x, sum(w) AS w FROM {src} GROUP BY {keys}, side, x HAVING sum(w) > 0)",
        f"{src}_q AS (SELECT {keys}, side, x, sum(w) OVER (PARTITION BY {keys}, side ORDER BY x) / sum(w) OVER (PARTITION BY {keys}, side) AS q FROM {src}_f)",
        f"""{src}_m AS (SELECT {keys}, q - coalesce(lag(q) OVER w, 0.0) AS dq,
             first_value(CASE WHEN side = 'a' THEN x END IGNORE NULLS) OVER f AS xa,
             first_value(CASE WHEN side = 'b' THEN x END IGNORE NULLS) OVER f AS xb FROM {src}_q
             WINDOW w AS (PARTITION BY {keys} ORDER BY q, side, x),
                    f AS (PARTITION BY {keys} ORDER BY q, side, x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        f"{src}_w AS (SELECT {keys}, coalesce(sum(dq * pow(abs(xa - xb), {p})), 0.0) AS wpp FROM {src}_m GROUP BY {keys})",
    ]


DIR_SQL = "(VALUES " + ", ".join(f"({k}, {ux!r}::DOUBLE, {uy!r}::DOUBLE)" for k, (ux, uy) in enumerate(DIRECTIONS)) + ") AS d(k, ux, uy)"
_L = "animal_id, cell, prev_no, session_no"


# --------------------------------------------------------------- session links
@query("consecutive_sessions", compose("SELECT animal_id, cell, prev_no, session_no FROM links", "links"))
def consecutive_sessions(spark, sf):
    return links(cells(spark, sf))


@query("firing_change", compose(f"""
, n AS (SELECT {_L}, sum(CASE WHEN side = 'a' THEN 1 ELSE 0 END) na, sum(CASE WHEN side = 'b' THEN 1 ELSE 0 END) nb FROM pts GROUP BY {_L})
SELECT {_L}, {R('nb / na::DOUBLE')} AS fr_ratio, {R(f'(nb - na) / {WEEK} * 1e6')} AS fr_change FROM n""", "pts"))
def firing_change(spark, sf):
    p = link_points(cells(spark, sf))
    n = lambda s: F.sum((F.col("side") == s).cast("int"))
    g = p.groupBy(*LINK).agg(n("a").alias("na"), n("b").alias("nb"))
    return g.select(*LINK, rd(F.col("nb") / F.col("na")).alias("fr_ratio"),
                    rd((F.col("nb") - F.col("na")) / F.lit(WEEK) * 1e6).alias("fr_change"))


# ------------------------------------------------------------------- distances
@query("w1d_weighted", compose(f"""
, s AS (SELECT {_L}, side, x, y + 1 AS w FROM pts),
{", ".join(w_sql("s", _L, 2))}
SELECT {_L}, {R('sqrt(wpp)')} AS distance FROM s_w""", "pts"))
def w1d_weighted(spark, sf):
    p = link_points(cells(spark, sf)).withColumn("w", F.col("y") + 1)
    return D.quantile_distance(p, LINK, 2, options(spark, sf, "animal_id")).select(*LINK, rd(F.sqrt("wpp")).alias("distance"))


@query("sliced_w", compose(f"""
, s AS (SELECT {_L}, k, side, x * ux + y * uy AS x, 1.0::DOUBLE AS w FROM pts, {DIR_SQL}),
{", ".join(w_sql("s", _L + ", k", 2))}
SELECT {_L}, {R('sqrt(avg(wpp))')} AS distance FROM s_w GROUP BY {_L}""", "pts"))
def sliced_w(spark, sf):
    p = link_points(cells(spark, sf)).withColumn("w", F.lit(1.0))
    return D.sliced_distance(p, LINK, DIRECTIONS, 2, options(spark, sf, "animal_id")).withColumn("distance", rd("distance"))


def packed_links(spark, sf):
    m = M.pack(cell_maps(spark, sf), CELL, COLS)
    ln = links(cells(spark, sf))
    a = m.select("animal_id", "cell", F.col("session_no").alias("prev_no"), F.col("bins").alias("bins_a"), F.col("vals").alias("vals_a"))
    b = m.select("animal_id", "cell", "session_no", F.col("bins").alias("bins_b"), F.col("vals").alias("vals_b"))
    return ln.join(a, ["animal_id", "cell", "prev_no"]).join(b, ["animal_id", "cell", "session_no"])


def _map_pts(pair_keys: str, pairs: str, a: str, b: str) -> str:
    """Bin mid-points of both maps of each pair, projected on every direction."""
    sx, sy = WIDTH / COLS, HEIGHT / ROWS
    pos = f"((m.c + 0.5) * {sx!r} * ux + (m.r + 0.5) * {sy!r} * uy)"
    return (f"SELECT {pair_keys}, k, 'a' AS side, {pos} AS x, m.v AS w FROM {pairs} p JOIN cmap m ON {a}, {DIR_SQL} "
            f"UNION ALL SELECT {pair_keys}, k, 'b', {pos}, m.v FROM {pairs} p JOIN cmap m ON {b}, {DIR_SQL}")


_PK = "p.animal_id, p.cell, p.prev_no, p.session_no"
part("whole", ("links", "cmap"), _map_pts(
    _PK, "links", "m.animal_id = p.animal_id AND m.cell = p.cell AND m.session_no = p.prev_no",
    "m.animal_id = p.animal_id AND m.cell = p.cell AND m.session_no = p.session_no"))


@query("map_distance", compose(f"""
, {", ".join(w_sql("whole", _L + ", k", 2))}
SELECT {_L}, {R('sqrt(avg(wpp))')} AS distance FROM whole_w GROUP BY {_L}""", "whole"))
def map_distance(spark, sf):
    d = D.map_distance(packed_links(spark, sf), LINK, ROWS, COLS, HEIGHT, WIDTH, DIRECTIONS)
    return d.withColumn("distance", rd("distance"))


BIN = 3_600.0


@query("temporal_emd", compose(f"""
, b AS (SELECT {_L}, min(t) lo, max(t) hi, sum(CASE WHEN side = 'a' THEN 1 ELSE 0 END) na, sum(CASE WHEN side = 'b' THEN 1 ELSE 0 END) nb FROM pts GROUP BY {_L}),
m AS (SELECT p.animal_id, p.cell, p.prev_no, p.session_no, least(floor((p.t - b.lo) / {BIN}), greatest(ceil((b.hi - b.lo) / {BIN}), 1) - 1) AS bin,
   sum(CASE WHEN side = 'a' THEN 1.0::DOUBLE / na ELSE -1.0::DOUBLE / nb END) AS m
   FROM pts p JOIN b ON b.animal_id = p.animal_id AND b.cell = p.cell AND b.prev_no = p.prev_no AND b.session_no = p.session_no GROUP BY 1, 2, 3, 4, 5),
c AS (SELECT {_L}, bin, sum(m) OVER w AS c, lead(bin) OVER w AS nx FROM m WINDOW w AS (PARTITION BY {_L} ORDER BY bin))
SELECT {_L}, {R('coalesce(sum(abs(c) * (nx - bin)), 0)')} AS emd FROM c GROUP BY {_L}""", "pts"))
def temporal_emd(spark, sf):
    e = D.temporal_distance(link_points(cells(spark, sf)), LINK, BIN, options(spark, sf, "animal_id"))
    return e.select(*LINK, rd("emd").alias("emd"))


OBJ_R, OBJ_C = 0, COLS // 2


@query("single_point_w", compose(f"""
SELECT animal_id, session_no, cell, {R(f'sum(v * sqrt(pow((r - {OBJ_R}) * {HEIGHT / ROWS}, 2) + pow((c - {OBJ_C}) * {WIDTH / COLS}, 2))) / sum(v)')} AS distance
FROM cmap GROUP BY 1, 2, 3""", "cmap"))
def single_point_w(spark, sf):
    return D.point_distance(cell_maps(spark, sf), CELL, ROWS, COLS, HEIGHT, WIDTH, OBJ_R, OBJ_C).withColumn("distance", rd("distance"))


@query("spike_point_w", compose(f"""
SELECT animal_id, session_no, cell, {R('avg(sqrt(pow(x - 150, 2) + pow(y - 50, 2)))')} AS distance FROM cells GROUP BY 1, 2, 3""", "cells"))
def spike_point_w(spark, sf):
    return D.spike_point_distance(cells(spark, sf), CELL, 150.0, 50.0).withColumn("distance", rd("distance"))


@query("object_vector", compose(f"""
, top AS (SELECT animal_id, session_no, cell, r, c FROM (SELECT *, row_number() OVER (PARTITION BY animal_id, session_no, cell ORDER BY v DESC, r, c) rn FROM cmap) WHERE rn = 1),
p AS (SELECT *, (r + 0.5) * {HEIGHT / ROWS} py, (c + 0.5) * {WIDTH / COLS} px, {(OBJ_R + 0.5) * HEIGHT / ROWS}::DOUBLE oy, {(OBJ_C + 0.5) * WIDTH / COLS}::DOUBLE ox FROM top)
SELECT animal_id, session_no, cell, {R('sqrt((px-ox)*(px-ox)+(py-oy)*(py-oy))')} AS magnitude, {R('degrees(atan2(oy*px - ox*py, oy*py + ox*px))')} AS angle FROM p""", "cmap"))
def object_vector(spark, sf):
    v = D.object_vector(cell_maps(spark, sf), CELL, ROWS, COLS, HEIGHT, WIDTH, OBJ_R, OBJ_C)
    return v.withColumn("magnitude", rd("magnitude")).withColumn("angle", rd("angle"))


@query("map_moments", compose(f"""
, m AS (SELECT animal_id, session_no, cell, sum(v) s, sum(v*r) mr, sum(v*c) mc, sum(v*r*r) rr, sum(v*c*c) cc, sum(v*r*c) rc FROM cmap GROUP BY 1, 2, 3)
SELECT animal_id, session_no, cell, s AS mass, {R('mr/s')} AS centroid_r, {R('mc/s')} AS centroid_c, {R('rr/s - (mr/s)*(mr/s)')} AS var_r,
  {R('cc/s - (mc/s)*(mc/s)')} AS var_c, {R('rc/s - (mr/s)*(mc/s)')} AS cov_rc FROM m""", "cmap"))
def map_moments(spark, sf):
    m = D.map_moments(cell_maps(spark, sf), CELL)
    return m.select(*CELL, "mass", *[rd(c).alias(c) for c in ("centroid_r", "centroid_c", "var_r", "var_c", "cov_rc")])


@query("map_spearman", compose(f"""
, g AS (SELECT l.animal_id, l.cell, l.prev_no, l.session_no, coalesce(a.v, 0.0) va, coalesce(b.v, 0.0) vb FROM links l CROSS JOIN grid
   LEFT JOIN cmap a ON a.animal_id = l.animal_id AND a.cell = l.cell AND a.session_no = l.prev_no AND a.r = grid.r AND a.c = grid.c
   LEFT JOIN cmap b ON b.animal_id = l.animal_id AND b.cell = l.cell AND b.session_no = l.session_no AND b.r = grid.r AND b.c = grid.c),
k AS (SELECT *, rank() OVER (PARTITION BY {_L} ORDER BY va) + (count(*) OVER (PARTITION BY {_L}, va) - 1) / 2.0::DOUBLE AS ra,
   rank() OVER (PARTITION BY {_L} ORDER BY vb) + (count(*) OVER (PARTITION BY {_L}, vb) - 1) / 2.0::DOUBLE AS rb FROM g)
SELECT {_L}, {R('corr(ra, rb)')} AS rho FROM k GROUP BY {_L}""", "links", "cmap", "grid"))
def map_spearman(spark, sf):
    """Rank correlation over all bins of the maps of two consecutive sessions."""
    m = cell_maps(spark, sf)
    ln = links(cells(spark, sf))
    none = F.lit(None).cast("double")
    side = lambda no, va, vb: ln.join(m.withColumnRenamed("session_no", no), ["animal_id", "cell", no]).select(
        *LINK, "r", "c", va.alias("va"), vb.alias("vb"))
    # every pair of maps lists its first bin, and else the bins that hold something on a side
    corner = ln.select(*LINK, F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(0.0).alias("va"), F.lit(0.0).alias("vb"))
    both = corner.unionByName(side("prev_no", F.col("v"), none)).unionByName(side("session_no", none, F.col("v")))
    j = both.groupBy(*LINK, "r", "c").agg(F.max("va").alias("va"), F.max("vb").alias("vb"))
    placed = F.col("r").isNotNull() & F.col("c").isNotNull()
    j = j.withColumns({v: F.when(placed, F.coalesce(v, F.lit(0.0))).otherwise(F.col(v)) for v in ("va", "vb")})
    return D.map_spearman(j, LINK, "va", "vb", F.lit(ROWS * COLS) - F.count_if(placed)).select(*LINK, rd("rho").alias("rho"))


# ---------------------------------------------------------------- different cells
part("sess", ("cells",), """
  SELECT animal_id, session_no, lag(session_no) OVER (PARTITION BY animal_id ORDER BY session_no) AS prev_no
  FROM (SELECT DISTINCT animal_id, session_no FROM cells)""")
part("cpair", ("sess", "cells"), """
  SELECT a.animal_id, a.prev_no, a.session_no, a.cell AS cell_a, b.cell AS cell_b FROM
    (SELECT DISTINCT s.animal_id, s.prev_no, s.session_no, c.cell FROM sess s JOIN cells c ON c.animal_id = s.animal_id AND c.session_no = s.prev_no) a
  JOIN (SELECT DISTINCT animal_id, session_no, cell FROM cells) b ON b.animal_id = a.animal_id AND b.session_no = a.session_no AND a.cell <> b.cell""")
part("npair", ("cpair",), """
  SELECT * FROM cpair p WHERE cell_a < cell_b OR NOT EXISTS (SELECT 1 FROM cpair q WHERE q.animal_id = p.animal_id
    AND q.session_no = p.session_no AND q.cell_a = p.cell_b AND q.cell_b = p.cell_a)""")


def null_pairs(spark, sf):
    """Packed maps of different cells in consecutive sessions of an animal."""
    m = M.pack(cell_maps(spark, sf), CELL, COLS)
    ses = m.select("animal_id", "session_no").distinct()
    w = Window.partitionBy("animal_id").orderBy("session_no")
    ses = ses.withColumn("prev_no", F.lag("session_no").over(w)).where("prev_no IS NOT NULL")
    key = ["animal_id", "prev_no", "session_no"]
    prev = ses.join(m.withColumnRenamed("session_no", "prev_no"), ["animal_id", "prev_no"]).select(*key, "cell", "bins", "vals")
    curr = ses.join(m, ["animal_id", "session_no"]).select(*key, "cell", "bins", "vals")
    return N.different_cells(prev, curr, key, "cell")


@query("cell_pair_null", compose("SELECT animal_id, prev_no, session_no, cell_a, cell_b FROM npair", "npair"))
def cell_pair_null(spark, sf):
    return null_pairs(spark, sf).select("animal_id", "prev_no", "session_no", "cell_a", "cell_b")


_NK = "animal_id, prev_no, session_no"
part("nwhole", ("npair", "cmap"), _map_pts(
    "p.animal_id, p.prev_no, p.session_no, p.cell_a, p.cell_b", "npair",
    "m.animal_id = p.animal_id AND m.cell = p.cell_a AND m.session_no = p.prev_no",
    "m.animal_id = p.animal_id AND m.cell = p.cell_b AND m.session_no = p.session_no"))
NULL_SQL = f"""
, {", ".join(w_sql("nwhole", _NK + ", cell_a, cell_b, k", 2))},
nd AS (SELECT {_NK}, round(sqrt(avg(wpp)), 6) AS d FROM nwhole_w GROUP BY {_NK}, cell_a, cell_b),
{", ".join(w_sql("whole", _L + ", k", 2))},
ob AS (SELECT {_L}, round(sqrt(avg(wpp)), 6) AS d FROM whole_w WHERE prev_no IS NOT NULL GROUP BY {_L}),
st AS (SELECT {_NK}, count(*) n, avg(d) mu, stddev_pop(d) sd, median(d) med FROM nd GROUP BY {_NK}),
ma AS (SELECT nd.animal_id, nd.prev_no, nd.session_no, median(abs(d - med)) * 1.482602218505602 AS mad FROM nd JOIN st USING ({_NK}) GROUP BY 1, 2, 3),
lim AS (SELECT {_NK}, count(*)::DOUBLE n, min(d) lo, max(d) hi, CASE WHEN max(d) = min(d) THEN 0.5 ELSE (max(d) - min(d)) / (2 * (count(*) - 1)) END pad FROM nd GROUP BY {_NK}),
"""


def _observed(spark, sf):
    d = D.map_distance(packed_links(spark, sf), LINK, ROWS, COLS, HEIGHT, WIDTH, DIRECTIONS, name="value")
    return d.withColumn("value", F.round("value", 6))


def _null(spark, sf):
    keep = ["animal_id", "prev_no", "session_no", "cell_a", "cell_b"]
    d = D.map_distance(null_pairs(spark, sf), keep, ROWS, COLS, HEIGHT, WIDTH, DIRECTIONS, name="value")
    return d.withColumn("value", F.round("value", 6))


@query("remapping_scores", compose(NULL_SQL + f"""
o2 AS (SELECT ob.*, st.n, st.mu, st.sd, st.med, ma.mad FROM ob JOIN st USING ({_NK}) JOIN ma USING ({_NK}))
SELECT {_L}, {R('d', 6)} AS whole_wass, n AS null_n, {R('mu + 1e-7')} AS base_mean, {R('sd + 1e-7')} AS base_std, {R('CASE WHEN sd > 1e-9 THEN (d - mu) / sd END', 3)} AS z_score,
  {R('med', 8)} AS median, {R('mad + 1e-7', 3)} AS mad, {R('0.6745 * (d - med) / CASE WHEN mad = 0 THEN 1 ELSE mad END', 3)} AS mod_z_score FROM o2""",
    "nwhole", "whole"))
def remapping_scores(spark, sf):
    key = ["animal_id", "prev_no", "session_no"]
    stats = N.null_statistics(_null(spark, sf), key)
    s = N.with_scores(_observed(spark, sf), stats, key)
    return s.select(
        *LINK, rd("value", 6).alias("whole_wass"), F.col("null_n"), rd(F.col("null_mean") + 1e-7).alias("base_mean"), rd(F.col("null_std") + 1e-7).alias("base_std"),
        F.when(F.col("null_std") > 1e-9, rd("z", 3)).alias("z_score"), rd("null_median", 8).alias("median"), rd(F.col("null_mad") + 1e-7, 3).alias("mad"),
        rd("mod_z", 3).alias("mod_z_score"))


@query("ecdf_quantile", compose(NULL_SQL + f"""
pos AS (SELECT ob.animal_id, ob.cell, ob.prev_no, ob.session_no, lim.n, lim.lo - pad AS low, (hi - lo + 2 * pad) / lim.n AS w,
   (d - (lim.lo - pad)) / CASE WHEN lim.n > 1 THEN (hi - lo + 2 * pad) / (lim.n - 1) ELSE 1.0 END AS pos FROM ob JOIN lim USING ({_NK})),
kk AS (SELECT *, greatest(0, least(floor(pos), n - 1)) AS k FROM pos),
cc AS (SELECT kk.animal_id, kk.cell, kk.prev_no, kk.session_no, max(kk.n) n, max(greatest(0.0, least(pos - k, 1.0))) f,
   sum(CASE WHEN greatest(0, least(floor((nd.d - low) / w), kk.n - 1)) <= k THEN 1 ELSE 0 END) c0,
   sum(CASE WHEN greatest(0, least(floor((nd.d - low) / w), kk.n - 1)) <= k + 1 THEN 1 ELSE 0 END) c1
   FROM kk JOIN nd USING ({_NK}) GROUP BY 1, 2, 3, 4)
SELECT {_L}, {R('(c0 + (c1 - c0) * f) / n')} AS quantile, {R('1 - (c0 + (c1 - c0) * f) / n')} AS p_higher,
  {R('2 * least((c0 + (c1 - c0) * f) / n, 1 - (c0 + (c1 - c0) * f) / n)')} AS p_two FROM cc""", "nwhole", "whole"))
def ecdf_quantile(spark, sf):
    key = ["animal_id", "prev_no", "session_no"]
    q = N.with_quantile(N.with_scores(_observed(spark, sf), N.null_statistics(_null(spark, sf), key), key))
    t = N.tails(F.col("quantile"))
    return q.select(*LINK, rd("quantile").alias("quantile"), rd(t["p_higher"]).alias("p_higher"), rd(t["p_two"]).alias("p_two"))


# -------------------------------------------------------------- shifted trains
_shares = "(VALUES " + ", ".join(f"({k}, {s!r}::DOUBLE)" for k, s in enumerate(SHARES)) + ") AS s(iter, share)"
part("shift", ("spk",), f"""
  SELECT session_id, unit, i, iter, CASE WHEN m > t1 THEN m - (t1 - t0) ELSE m END AS t FROM (
    SELECT *, t + lim + share * (t1 - 2 * lim) AS m FROM (
      SELECT *, CASE WHEN {LIMIT} >= (t1 - t0) / 2 THEN CASE WHEN floor((t1 - t0) / 2) = (t1 - t0) / 2 THEN (t1 - t0) / 2 - 1 ELSE floor((t1 - t0) / 2) END ELSE {LIMIT} END AS lim
      FROM (SELECT *, min(t) OVER (PARTITION BY session_id, unit) t0, max(t) OVER (PARTITION BY session_id, unit) t1 FROM spk) WHERE t1 > t0), {_shares})""")


@query("shift_null", compose(f"SELECT session_id, unit, i, iter, {R('t', 6)} AS t FROM shift", "shift"))
def shift_null(spark, sf):
    return N.shift_spikes(spikes(spark, sf), UNIT, SHARES, LIMIT).select("session_id", "unit", "i", "iter", rd("t", 6).alias("t"))


# ---------------------------------------------------------------- permutations
@query("group_permutation")
def group_permutation(spark, sf):
    """Event types dealt anew inside each session: counts per type must not change."""
    e = events(spark, sf).select("session_id", "i", "unit")
    p = N.permute_groups(e, ["session_id"], "unit", ["i"], OPTIONS.seed, options(spark, sf))
    return p.groupBy("session_id", "unit").agg(F.count(F.lit(1)).alias("n"))


from spikegrid.plans.base import ORACLE  # noqa: E402

ORACLE["group_permutation"] = "SELECT user_id AS session_id, event_type AS unit, count(*) AS n FROM events GROUP BY 1, 2"


# ---------------------------------------------------------------------- fields
FIELD_OPTIONS = OPTIONS.but(field_min_peak=0.1, field_min_bins=4, field_min_mean=0.01)


@query("blobs")
def blobs(spark, sf):
    lab = FL.blobs(dense_rate(spark, sf), UNIT, "rate", ROWS, COLS, OPTIONS.smoothing_factor)
    m = FL.field_measures(FL.field_bins(lab, UNIT, "rate", COLS), UNIT, ROWS * COLS)
    return m.select(*UNIT, "field_id", "bins", *[rd(c).alias(c) for c in ("size_percent", "centroid_r", "centroid_c", "mean_rate", "peak_rate")])


@query("place_fields")
def place_fields(spark, sf):
    lab = FL.place_fields(dense_rate(spark, sf), UNIT, "rate", ROWS, COLS, 0, FIELD_OPTIONS)
    m = FL.field_measures(FL.field_bins(lab, UNIT, "rate", COLS), UNIT, ROWS * COLS)
    return m.select(*UNIT, "field_id", "bins", *[rd(c).alias(c) for c in ("size_percent", "mean_rate", "peak_rate")])


@query("field_report")
def field_report(spark, sf):
    """Ranked fields as report columns, with the cumulative measures."""
    lab = FL.blobs(dense_rate(spark, sf), UNIT, "rate", ROWS, COLS, OPTIONS.smoothing_factor, no_filter=True)
    bins = FL.field_bins(lab, UNIT, "rate", COLS)
    ranked = FL.rank_fields(FL.field_measures(bins, UNIT, ROWS * COLS), UNIT, HEIGHT / ROWS * WIDTH / COLS, 500.0)
    wide = FL.wide_fields(ranked, UNIT, 4)
    return wide.join(FL.cumulative_measures(bins, UNIT, ROWS * COLS), UNIT).select(
        *UNIT, *[rd(f"Field_{k}").alias(f"Field_{k}") for k in range(1, 5)], "fields", rd("coverage").alias("coverage"), "area", rd("rate").alias("rate"))


@query("field_ellipses")
def field_ellipses(spark, sf):
    lab = FL.blobs(dense_rate(spark, sf), UNIT, "rate", ROWS, COLS, OPTIONS.smoothing_factor)
    e = FL.fit_ellipses(FL.field_bins(lab, UNIT, "rate", COLS), [*UNIT, "field_id"])
    return e.select(*UNIT, "field_id", *[rd(c, 3).alias(c) for c in ("x", "y", "long", "short", "tilt")])


@query("field_shuffle")
def field_shuffle(spark, sf):
    """Maps with their fields placed anew: the values of a map are kept."""
    lab = FL.blobs(dense_rate(spark, sf), UNIT, "rate", ROWS, COLS, OPTIONS.smoothing_factor)
    s = FL.shift_fields(lab, UNIT, "rate", ROWS, COLS, OPTIONS.seed)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return s.select(*UNIT, rd(total("shuffled")).alias("total"), rd(F.array_max("shuffled")).alias("peak"))


ORACLE["field_shuffle"] = compose(
    f"SELECT session_id, unit, {R('sum(v)')} AS total, {R('max(v)')} AS peak FROM srate GROUP BY 1, 2", "srate")


@query("field_remapping")
def field_remapping(spark, sf):
    """Every field of a session with every field of the next session of the same cell."""
    m = cell_maps(spark, sf)
    dense = M.smooth(m, CELL, ROWS, COLS, OPTIONS.smoothing_factor)
    lab = FL.blobs(dense, CELL, "smooth", ROWS, COLS, OPTIONS.smoothing_factor, no_filter=True)
    packed = D.pack_fields(FL.field_bins(lab, CELL, "smooth", COLS), CELL, COLS)
    ln = links(cells(spark, sf))
    a = ln.join(packed.withColumnRenamed("session_no", "prev_no"), ["animal_id", "cell", "prev_no"])
    b = ln.join(packed, ["animal_id", "cell", "session_no"])
    pairs = D.field_pairs(a, b, LINK)
    keep = [*LINK, "field_id_a", "field_id_b", "centroid_distance", "bins_a", "vals_a", "bins_b", "vals_b"]
    w = D.map_distance(pairs, keep, ROWS, COLS, HEIGHT, WIDTH, DIRECTIONS, name="field_wass")
    out = D.map_distance(w, [*keep[:7], "field_wass"], ROWS, COLS, HEIGHT, WIDTH, DIRECTIONS, weighted=False, name="binary_wass")
    return out.select(*LINK, "field_id_a", "field_id_b", *[rd(c).alias(c) for c in ("centroid_distance", "field_wass", "binary_wass")])
