"""Fields of count maps taken together: blobs, distances between sessions, moved fields, sampling points.

The SQL finds the blobs of one round by its own means: ranks for the noise floor, between-class
variance of the 256 grey levels for the threshold, and reachability for the connected parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spikegrid.operators import distances as D, fields as FL, maps as M
from spikegrid.plans.base import COLS, OPTIONS, ROWS, R, compose, part, query, rd, tracking
from spikegrid.plans.remapping import CELL, DIR_SQL, DIRECTIONS, HEIGHT, LINK, WIDTH, cell_maps, cells, links, w_sql

N = ROWS * COLS
_C = "animal_id, session_no, cell"
_L = "animal_id, cell, prev_no, session_no"


def count_fields(spark, sf):
    """Labelled maps of spike counts over their maximum."""
    d = M.dense(M.pack(cell_maps(spark, sf), CELL, COLS), CELL, ROWS, COLS)
    return FL.blobs(d, CELL, "rate", ROWS, COLS, OPTIONS.smoothing_factor, no_filter=True)


# rank of a quantile at a whole position, as 0.2 and 0.8 of 255 are
_at = lambda q: int(q * (N - 1)) + 1
part("img", ("cmap", "grid"), f"""
  SELECT {_C}, b, v, CAST(least(255, greatest(0, floor((CASE WHEN v <= q80 THEN low ELSE v END) * 255))) AS INTEGER) AS g FROM (
    SELECT *, avg(CASE WHEN v <= q20 THEN v END) OVER (PARTITION BY {_C}) AS low FROM (
      SELECT *, max(CASE WHEN rn = {_at(0.2)} THEN v END) OVER (PARTITION BY {_C}) AS q20, max(CASE WHEN rn = {_at(0.8)} THEN v END) OVER (PARTITION BY {_C}) AS q80 FROM (
        SELECT u.animal_id, u.session_no, u.cell, g.r * {COLS} + g.c AS b, coalesce(m.v, 0.0) / u.top AS v,
               row_number() OVER (PARTITION BY u.animal_id, u.session_no, u.cell ORDER BY coalesce(m.v, 0.0), g.r, g.c) AS rn
        FROM (SELECT {_C}, max(v) AS top FROM cmap GROUP BY {_C}) u CROSS JOIN grid g
        LEFT JOIN cmap m ON m.animal_id = u.animal_id AND m.session_no = u.session_no AND m.cell = u.cell AND m.r = g.r AND m.c = g.c)))""")
part("cutgrey", ("img",), f"""
  SELECT {_C}, arg_max(g, (between_, -g)) AS g FROM (
    SELECT {_C}, g, w0 * ({N} - w0) * pow(m0 / w0 - (total - m0) / ({N} - w0), 2) AS between_ FROM (
      SELECT {_C}, g, sum(n) OVER w AS w0, sum(n * g) OVER w AS m0, sum(n * g) OVER (PARTITION BY {_C}) AS total
      FROM (SELECT {_C}, g, count(*)::DOUBLE AS n FROM img GROUP BY {_C}, g) WINDOW w AS (PARTITION BY {_C} ORDER BY g)) WHERE w0 < {N}) GROUP BY {_C}""")
part("lit", ("img", "cutgrey"), f"SELECT i.animal_id, i.session_no, i.cell, i.b, i.v FROM img i JOIN cutgrey k ON k.animal_id = i.animal_id AND k.session_no = i.session_no AND k.cell = i.cell WHERE i.g > k.g")
part("reach", ("lit",), f"""
  SELECT {_C}, b, b AS other FROM lit UNION SELECT x.animal_id, x.session_no, x.cell, x.b, y.b FROM reach x JOIN lit y
  ON y.animal_id = x.animal_id AND y.session_no = x.session_no AND y.cell = x.cell
  AND (abs(y.b - x.other) = {COLS} OR (abs(y.b - x.other) = 1 AND y.b // {COLS} = x.other // {COLS}))""")
part("cfield", ("reach", "lit"), f"""
  SELECT l.animal_id, l.session_no, l.cell, f.first, CAST(l.b // {COLS} AS INTEGER) AS r, CAST(l.b % {COLS} AS INTEGER) AS c, l.v
  FROM lit l JOIN (SELECT {_C}, b, min(other) AS first FROM reach GROUP BY {_C}, b) f ON f.animal_id = l.animal_id AND f.session_no = l.session_no AND f.cell = l.cell AND f.b = l.b""")


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("count_blobs", recursive(compose(f"""
SELECT {_C}, CAST(dense_rank() OVER (PARTITION BY {_C} ORDER BY first) AS INTEGER) AS field_id, count(*) AS bins, {R('avg(r)')} AS centroid_r, {R('avg(c)')} AS centroid_c,
  {R('avg(v)')} AS mean_rate, {R('max(v)')} AS peak_rate FROM cfield GROUP BY {_C}, first""", "cfield")))
def count_blobs(spark, sf):
    """Blobs of one round on the count maps of all cells."""
    m = FL.field_measures(FL.field_bins(count_fields(spark, sf), CELL, "rate", COLS), CELL, N)
    return m.select(*CELL, "field_id", "bins", *[rd(c).alias(c) for c in ("centroid_r", "centroid_c", "mean_rate", "peak_rate")])


_SX, _SY = WIDTH / COLS, HEIGHT / ROWS
_POS = f"((f.c + 0.5) * {_SX!r} * ux + (f.r + 0.5) * {_SY!r} * uy)"


def _side(side: str, no: str, weight: str) -> str:
    return (f"SELECT l.animal_id, l.cell, l.prev_no, l.session_no, k, '{side}' AS side, {_POS} AS x, {weight} AS w FROM links l "
            f"JOIN cfield f ON f.animal_id = l.animal_id AND f.cell = l.cell AND f.session_no = l.{no}, {DIR_SQL}")


for _name, _weight in (("fset", "f.v"), ("fbin", "1.0::DOUBLE")):
    part(_name, ("links", "cfield"), _side("a", "prev_no", _weight) + " UNION ALL " + _side("b", "session_no", _weight))


@query("field_set_distance", recursive(compose(f"""
, {", ".join(w_sql("fset", _L + ", k", 2))}, {", ".join(w_sql("fbin", _L + ", k", 2))},
cen AS (SELECT animal_id, session_no, cell, count(*) AS fields, avg(r) AS r, avg(c) AS c FROM (SELECT {_C}, first, avg(r) AS r, avg(c) AS c FROM cfield GROUP BY {_C}, first) GROUP BY 1, 2, 3)
SELECT l.animal_id, l.cell, l.prev_no, l.session_no, a.fields AS fields_a, b.fields AS fields_b, {R('sqrt(pow(a.r - b.r, 2) + pow(a.c - b.c, 2))')} AS centroid_distance,
  {R('(SELECT sqrt(avg(wpp)) FROM fset_w w WHERE w.animal_id = l.animal_id AND w.cell = l.cell AND w.prev_no = l.prev_no AND w.session_no = l.session_no)')} AS field_wass,
  {R('(SELECT sqrt(avg(wpp)) FROM fbin_w w WHERE w.animal_id = l.animal_id AND w.cell = l.cell AND w.prev_no = l.prev_no AND w.session_no = l.session_no)')} AS binary_wass
FROM links l JOIN cen a ON a.animal_id = l.animal_id AND a.cell = l.cell AND a.session_no = l.prev_no JOIN cen b ON b.animal_id = l.animal_id AND b.cell = l.cell AND b.session_no = l.session_no""",
    "fset", "fbin")))
def field_set_distance(spark, sf):
    """All fields of a session with all fields of the next session of the same cell."""
    sets = D.field_sets(FL.field_bins(count_fields(spark, sf), CELL, "rate", COLS), CELL, COLS)
    ln = links(cells(spark, sf))
    a = ln.join(sets.withColumnRenamed("session_no", "prev_no"), ["animal_id", "cell", "prev_no"])
    b = ln.join(sets, ["animal_id", "cell", "session_no"])
    d = D.field_set_distance(a, b, LINK, ROWS, COLS, HEIGHT, WIDTH, DIRECTIONS)
    return d.select(*LINK, "fields_a", "fields_b", *[rd(c).alias(c) for c in ("centroid_distance", "field_wass", "binary_wass")])


@query("field_wrap_shuffle", recursive(compose(f"""
SELECT {_C}, count(DISTINCT first) AS fields, {R('sum(v)')} AS placed, 1.0 AS blurred_total, true AS whole FROM cfield GROUP BY {_C}""".replace("1.0 AS", "1.0::DOUBLE AS"), "cfield")))
def field_wrap_shuffle(spark, sf):
    """Maps with whole fields moved around the edges: what the fields held is placed, and every
    value elsewhere is one of a bin outside the fields."""
    s = FL.wrap_fields(count_fields(spark, sf), CELL, "rate", ROWS, COLS, OPTIONS.seed)
    s = s.where(F.exists("labels", lambda l: l > 0))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    inside = F.transform(F.arrays_zip(F.col("rate").alias("v"), F.col("labels").alias("l")), lambda z: F.when(z["l"] > 0, z["v"]).otherwise(F.lit(0.0)))
    outside = F.transform(F.filter(F.arrays_zip(F.col("rate").alias("v"), F.col("labels").alias("l")), lambda z: z["l"] == 0), lambda z: z["v"])
    rest = s.withColumns({"_in": total(inside), "_out": F.array_distinct(outside)})
    # bins that differ from every value outside the fields hold field rates
    strange = F.filter("raw", lambda v: ~F.array_contains(F.col("_out"), v))
    return rest.select(*CELL, F.array_max("labels").cast("long").alias("fields"), rd("_in").alias("placed"), rd(total("blurred"), 6).alias("blurred_total"),
                       (total(strange) <= F.col("_in") + 1e-9).alias("whole"))


# ------------------------------------------------------------- sampling points
SPACING, LEAST = 40.0, 25.0
part("arena", ("trk",), "SELECT session_id, max(y) - min(y) AS height, max(x) - min(x) AS width FROM trk GROUP BY 1")


def _lattice_sql(hexagonal: bool) -> str:
    size = SPACING / 3 ** 0.5
    sx, sy = (1.5 * size, size * 3 ** 0.5) if hexagonal else (SPACING, SPACING)
    shift = f"CASE WHEN c.k % 2 = 1 THEN {sy / 2!r} ELSE 0.0 END" if hexagonal else "0.0"
    return f"""
      SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY r, c) - 1 AS no, x, y FROM (
        SELECT a.session_id, r.k AS r, c.k AS c, c.k * {sx!r}::DOUBLE AS x, r.k * {sy!r}::DOUBLE + {shift} AS y, width, height FROM arena a, range(60) r(k), range(60) c(k)
        WHERE height > 0 AND width > 0 AND r.k < greatest(ceil(height / {sy!r}::DOUBLE), 1) AND c.k < greatest(ceil(width / {sx!r}::DOUBLE), 1))
      WHERE sqrt((x - width / 2) * (x - width / 2) + (y - height / 2) * (y - height / 2)) <= width / 2"""


part("points", ("arena",), _lattice_sql(True))
part("picked", ("points",), f"""
  SELECT session_id, no AS step_, [{{'x': x, 'y': y}}] AS kept FROM points WHERE no = 0 UNION ALL
  SELECT p.session_id, p.no, CASE WHEN len(list_filter(k.kept, lambda q: sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) < {LEAST})) > 0 THEN k.kept ELSE list_append(k.kept, {{'x': p.x, 'y': p.y}}) END
  FROM picked k JOIN points p ON p.session_id = k.session_id AND p.no = k.step_ + 1""")


@query("sampling_points", recursive(compose(f"""
, last AS (SELECT session_id, arg_max(kept, step_) AS kept FROM picked GROUP BY 1),
u AS (SELECT session_id, unnest(range(len(kept))) AS no, unnest(kept) AS p FROM last)
SELECT session_id, CAST(no AS INTEGER) AS no, {R('p.x')} AS x, {R('p.y')} AS y FROM u""", "picked")))
def sampling_points(spark, sf):
    """Hexagonal points inside the disk of each session's tracked arena, thinned to a least distance."""
    t = tracking(spark, sf)
    arenas = t.groupBy("session_id").agg((F.max("y") - F.min("y")).alias("height"), (F.max("x") - F.min("x")).alias("width"))
    g = FL.lattice_points(arenas, ["session_id"], SPACING, LEAST, hexagonal=True, disk=True)
    return g.select("session_id", "no", rd("x").alias("x"), rd("y").alias("y"))
