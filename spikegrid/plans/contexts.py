"""Object, category and rate-change queries between sessions, and the wide unit report."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spikegrid.operators import distances as D, fields as FL, geometry as G, nulls as N, reports as RP, scores as C
from spikegrid.plans.base import COLS, ORACLE, QUERIES, ROWS, SPIKE_TYPES, R, compose, options, part, query, rd
from spikegrid.plans.remapping import BIN, CELL, HEIGHT, LINK, WIDTH, cell_maps, cells, links, link_points, null_pairs
from spikegrid.plans.spatial import UNIT, dense_rate

OBJECTS = FL.object_bins(ROWS, COLS)
PAIR = ["animal_id", "prev_no", "session_no"]
_mid = lambda rc: ((rc[0] + 0.5) * HEIGHT / ROWS, (rc[1] + 0.5) * WIDTH / COLS)
_objects = "(VALUES " + ", ".join(f"('{k}', {_mid(v)[0]!r}::DOUBLE, {_mid(v)[1]!r}::DOUBLE)" for k, v in OBJECTS.items()) + ") AS o(object, oy, ox)"
_y, _x = f"(r + 0.5) * {HEIGHT / ROWS!r}", f"(c + 0.5) * {WIDTH / COLS!r}"


# --------------------------------------------------------------------- objects
@query("object_distances", compose(f"""
, d AS (SELECT animal_id, session_no, cell, object, sum(v * sqrt(pow({_y} - oy, 2) + pow({_x} - ox, 2))) / sum(v) AS d FROM cmap, {_objects} GROUP BY 1, 2, 3, 4)
SELECT animal_id, session_no, cell, {", ".join(f"{R(f'max(CASE WHEN object = {chr(39)}{k}{chr(39)} THEN d END)')} AS obj_wass_{k}" for k in OBJECTS)}
FROM d GROUP BY 1, 2, 3""", "cmap"))
def object_distances(spark, sf):
    pts = [(k, *_mid(v)) for k, v in OBJECTS.items()]
    d = G.point_distances(cell_maps(spark, sf), CELL, ROWS, COLS, HEIGHT, WIDTH, pts)
    w = d.groupBy(*CELL).pivot("point", list(OBJECTS)).agg(F.first("distance"))
    return w.select(*CELL, *[rd(F.col(k)).alias(f"obj_wass_{k}") for k in OBJECTS])


@query("object_vectors", compose(f"""
, top AS (SELECT animal_id, session_no, cell, sum(v * r) / sum(v) AS mr, sum(v * c) / sum(v) AS mc FROM cmap GROUP BY 1, 2, 3),
p AS (SELECT *, (round_even(mr, 0) + 0.5) * {HEIGHT / ROWS!r} AS py, (round_even(mc, 0) + 0.5) * {WIDTH / COLS!r} AS px FROM top, {_objects})
SELECT animal_id, session_no, cell, object, {R('sqrt((px-ox)*(px-ox)+(py-oy)*(py-oy))')} AS magnitude, {R('degrees(atan2(oy*px - ox*py, oy*py + ox*px))')} AS angle FROM p""", "cmap"))
def object_vectors(spark, sf):
    anchors = G.centroid_anchor(cell_maps(spark, sf), CELL, F.col("v"))
    v = G.vectors_to_objects(anchors, CELL, ROWS, COLS, HEIGHT, WIDTH, OBJECTS)
    return v.select(*CELL, "object", rd("magnitude").alias("magnitude"), rd("angle").alias("angle"))


@query("object_quantiles")
def object_quantiles(spark, sf):
    """Distance to each object against the distances to a lattice of sampling points, and the best object."""
    m = cell_maps(spark, sf)
    lattice = FL.sampling_grid(spark, HEIGHT, WIDTH, 25.0, hexagonal=True)
    # the lattice is fixed by the arena, not by the data
    pts = [(f"{r.row}_{r.col}", r.y, r.x) for r in lattice.collect()]
    null = N.null_statistics(G.point_distances(m, CELL, ROWS, COLS, HEIGHT, WIDTH, pts).withColumnRenamed("distance", "value"), CELL)
    obs = G.point_distances(m, CELL, ROWS, COLS, HEIGHT, WIDTH, [(k, *_mid(v)) for k, v in OBJECTS.items()]).withColumnRenamed("distance", "value")
    q = N.with_quantile(N.with_scores(obs, null, CELL)).groupBy(*CELL).pivot("point", list(OBJECTS)).agg(F.first("quantile"))
    low, which = RP.lowest_of([f"obj_q_{k}" for k in OBJECTS], list(OBJECTS))
    q = q.select(*CELL, *[rd(F.col(k)).alias(f"obj_q_{k}") for k in OBJECTS])
    return q.withColumn("best", which).withColumn("significant", (low < 0.05).cast("int"))


# ------------------------------------------------------------------ categories
CATEGORIES = {"morning": (1, 3, 5), "afternoon": (2, 4)}


@query("category_sessions", compose("""
, k AS (SELECT * FROM (VALUES ('morning', 1), ('morning', 3), ('morning', 5), ('afternoon', 2), ('afternoon', 4)) AS v(category, session_no))
SELECT * FROM (SELECT category, animal_id, cell, session_no, lag(session_no) OVER (PARTITION BY category, animal_id, cell ORDER BY session_no) AS prev_no
  FROM (SELECT DISTINCT k.category, c.animal_id, c.cell, c.session_no FROM cells c JOIN k ON k.session_no = c.session_no)) WHERE prev_no IS NOT NULL""", "cells"))
def category_sessions(spark, sf):
    """Consecutive members of a list of sessions, for every cell."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, v in CATEGORIES.items() for n in v])
    hit = F.filter(table, lambda x: x["n"] == F.col("session_no"))
    seen = cells(spark, sf).select(*CELL).distinct().withColumn("category", F.explode(F.transform(hit, lambda x: x["k"])))
    w = Window.partitionBy("category", "animal_id", "cell").orderBy("session_no")
    return seen.withColumn("prev_no", F.lag("session_no").over(w)).where("prev_no IS NOT NULL").select("category", *LINK)


# ---------------------------------------------------------------- rate changes
part("ncnt", ("cells",), "SELECT animal_id, session_no, cell, count(*)::DOUBLE AS n FROM cells GROUP BY 1, 2, 3")


@query("firing_null", compose(f"""
, nr AS (SELECT p.animal_id, p.prev_no, p.session_no, b.n / a.n AS ratio FROM npair p
  JOIN ncnt a ON a.animal_id = p.animal_id AND a.session_no = p.prev_no AND a.cell = p.cell_a
  JOIN ncnt b ON b.animal_id = p.animal_id AND b.session_no = p.session_no AND b.cell = p.cell_b),
st AS (SELECT animal_id, prev_no, session_no, avg(ratio) mu, stddev_pop(ratio) sd FROM nr GROUP BY 1, 2, 3),
ob AS (SELECT l.animal_id, l.cell, l.prev_no, l.session_no, b.n / a.n AS ratio FROM links l
  JOIN ncnt a ON a.animal_id = l.animal_id AND a.session_no = l.prev_no AND a.cell = l.cell
  JOIN ncnt b ON b.animal_id = l.animal_id AND b.session_no = l.session_no AND b.cell = l.cell)
SELECT ob.animal_id, cell, ob.prev_no, ob.session_no, {R('ratio')} AS fr_ratio, {R('mu')} AS fr_ratio_mean, {R('sd')} AS fr_ratio_std,
  {R('CASE WHEN sd > 1e-9 THEN (ratio - mu) / sd END')} AS fr_ratio_z
FROM ob JOIN st ON st.animal_id = ob.animal_id AND st.prev_no = ob.prev_no AND st.session_no = ob.session_no""", "npair", "links", "ncnt"))
def firing_null(spark, sf):
    """Rate ratio of a cell against the ratios of different cells."""
    d = cells(spark, sf)
    n = d.groupBy(*CELL).agg(F.count(F.lit(1)).cast("double").alias("n"))
    ln = links(d)
    prev = n.select("animal_id", "cell", F.col("session_no").alias("prev_no"), F.col("n").alias("_na"))
    obs = ln.join(prev, ["animal_id", "cell", "prev_no"]).join(n, CELL).select(*LINK, (F.col("n") / F.col("_na")).alias("value"))
    w = Window.partitionBy("animal_id").orderBy("session_no")
    ses = n.select("animal_id", "session_no").distinct().withColumn("prev_no", F.lag("session_no").over(w)).where("prev_no IS NOT NULL")
    a = ses.join(n.withColumnRenamed("session_no", "prev_no"), ["animal_id", "prev_no"]).select(*PAIR, "cell", "n")
    b = ses.join(n, ["animal_id", "session_no"]).select(*PAIR, "cell", "n")
    null = N.different_cells(a, b, PAIR, "cell").select(*PAIR, (F.col("n_b") / F.col("n_a")).alias("value"))
    s = N.with_scores(obs, N.null_statistics(null, PAIR), PAIR)
    return s.select(*LINK, rd("value").alias("fr_ratio"), rd("null_mean").alias("fr_ratio_mean"), rd("null_std").alias("fr_ratio_std"),
                    F.when(F.col("null_std") > 1e-9, rd("z")).alias("fr_ratio_z"))


@query("temporal_null")
def temporal_null(spark, sf):
    """Temporal distance of a cell against that of different cells: z and quantile."""
    d = cells(spark, sf)
    opts = options(spark, sf, "animal_id", fan_out=10)
    pairs = null_pairs(spark, sf).select(*PAIR, "cell_a", "cell_b")
    ends = pairs.withColumn("_e", F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("prev_no").alias("n"), F.col("cell_a").alias("cell")),
        F.struct(F.lit("b").alias("side"), F.col("session_no").alias("n"), F.col("cell_b").alias("cell")))))
    key = [*PAIR, "cell_a", "cell_b"]
    ends = ends.select(*key, F.col("_e.side").alias("side"), F.col("_e.n").alias("_n"), F.col("_e.cell").alias("cell"))
    pts = d.select("animal_id", F.col("session_no").alias("_n"), "cell", "t").join(ends, ["animal_id", "_n", "cell"])
    null = D.temporal_distance(pts, key, BIN, opts).withColumnRenamed("emd", "value")
    obs = D.temporal_distance(link_points(d), LINK, BIN, opts).withColumnRenamed("emd", "value")
    s = N.with_quantile(N.with_scores(obs, N.null_statistics(null, PAIR), PAIR))
    return s.select(*LINK, rd("value").alias("emd"), rd("null_mean").alias("emd_mean"), rd("null_std").alias("emd_std"),
                    F.when(F.col("null_std") > 1e-9, rd("z")).alias("emd_z"), rd("quantile").alias("emd_quantile"))


# ----------------------------------------------------------------- wide report
# column: (query that gives it, its name there)
REPORT = {
    "spike_count": ("event_rate", "n"), "firing_rate": ("event_rate", "rate"),
    **{n: ("map_stats", n) for n in ("information_content", "information_rate", "sparsity", "selectivity", "peak_rate", "mean_rate")},
    "coherence": ("coherence", "coherence"),
    **{f"border_{k}": ("border_score", f"border_{k}") for k in ("top", "bottom", "left", "right")},
    "hd_score": ("hd_vector", "vector_length"), "speed_score": ("speed_score", "score_2016"),
    **{f"isi_{k}": ("isi_stats", f"isi_{k}") for k in ("min", "max", "median", "mean", "std", "cv")},
    "bursting": ("bursts", "bursting"), "spikes_per_burst": ("bursts", "spikes_per_burst"),
}
_sources = list(dict.fromkeys(source for source, _ in REPORT.values()))
_columns = ", ".join((f"{s}.{c}::DOUBLE" if n != "spike_count" else f"{s}.{c}") + f" AS {n}" for n, (s, c) in REPORT.items())
_joins = " ".join(f"LEFT JOIN ({ORACLE[s]}) AS {s} ON {s}.session_id = event_rate.session_id AND {s}.unit = event_rate.unit" for s in _sources[1:])
REPORT_SQL = f"SELECT event_rate.session_id, event_rate.unit, {_columns} FROM ({ORACLE['event_rate']}) AS event_rate {_joins} WHERE event_rate.unit IN {SPIKE_TYPES!r}"


@query("unit_report", REPORT_SQL)
def unit_report(spark, sf):
    """One row per unit with its counts, map, border, direction, speed and train scores."""
    parts = {}
    for source in _sources:
        names = {c: n for n, (s, c) in REPORT.items() if s == source}
        scores = QUERIES[source](spark, sf).where(F.col("unit").isin(*SPIKE_TYPES))
        parts[source] = scores.select(*UNIT, *[F.col(c).alias(n) for c, n in names.items()])
    wide = RP.wide_report(RP.score_table(parts, UNIT), UNIT, list(REPORT))
    return wide.select(*UNIT, F.col("spike_count").cast("long").alias("spike_count"), *list(REPORT)[1:])


@query("unit_report_fields")
def unit_report_fields(spark, sf):
    """The part of the report that kernels give: grid score with its geometry, and the sizes of the largest fields."""
    grid = C.grid_score(dense_rate(spark, sf), UNIT, "rate", ROWS, COLS)
    return QUERIES["field_report"](spark, sf).join(grid.select(*UNIT, *[rd(c, 3).alias(c) for c in grid.columns if c not in UNIT]), UNIT, "full")
