"""Waveform, cluster-quality and unit-matching queries on the embeddings table.

64 values = 4 channels x 16 samples, cluster = label; odd and even vectors are
two sessions of one recording site.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spikegrid.operators import clusters as K, divergence as DV, matching as MT, spikes as S
from spikegrid.operators.ordered import plan_chunks
from spikegrid.plans.base import OPTIONS, R, compose, part, query, rd, table

CH, LEN = 4, 16
SITE = ["site"]
PAIR = ["site", "prev_no", "session_no"]


def waves(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.lit(1).alias("site"), F.col("vec_id").alias("spike_idx"), (F.col("vec_id") % 2 + 1).cast("int").alias("session_no"),
        "label", F.col("embedding").cast("array<double>").alias("samples"))


def unit_options(spark, sf):
    """A cluster has at most the spikes of its site, so one count of the base table serves all orders."""
    base = table(spark, sf, "embeddings").select(F.lit(1).alias("site"), "vec_id")
    return OPTIONS.but(chunks=plan_chunks(base, SITE, "vec_id", OPTIONS))


def session_pairs(w):
    """Sessions of a site with the one before (few rows)."""
    from pyspark.sql import Window

    win = Window.partitionBy(*SITE).orderBy("session_no")
    s = w.select(*SITE, "session_no").distinct()
    return s.withColumn("prev_no", F.lag("session_no").over(win)).where("prev_no IS NOT NULL")


part("wv", (), """
  SELECT 1 AS site, vec_id AS spike_idx, CAST(vec_id % 2 + 1 AS INTEGER) AS session_no, label, CAST(embedding AS DOUBLE[]) AS s FROM embeddings""")
part("samp", ("wv",), """
  SELECT site, spike_idx, session_no, label, unnest(range(0, 64)) AS pos, unnest(s) AS v FROM wv""")
part("en", ("samp",), f"""
  SELECT site, spike_idx, session_no, label, CAST(pos // {LEN} AS INTEGER) AS ch, sqrt(sum(v * v)) / sqrt({LEN}) AS e FROM samp GROUP BY 1, 2, 3, 4, 5""")


@query("wave_energy", compose(f"SELECT spike_idx, label, ch AS channel, {R('e', 6)} AS energy FROM en", "en"))
def wave_energy(spark, sf):
    e = K.with_energy(waves(spark, sf), CH, LEN)
    return e.select("spike_idx", "label", F.posexplode_outer("energy").alias("channel", "e")).select("spike_idx", "label", "channel", rd("e", 6).alias("energy"))


@query("wave_mean", compose(f"SELECT label, CAST(pos AS INTEGER) AS pos, {R('avg(v)', 6)} AS v FROM samp GROUP BY 1, 2", "samp"))
def wave_mean(spark, sf):
    return K.mean_waveform(waves(spark, sf), ["label"]).withColumn("v", rd("v", 6))


@query("peak_channel", compose(f"""
SELECT spike_idx, channel, {R('peak', 6)} AS peak FROM (
  SELECT spike_idx, CAST(pos // {LEN} AS INTEGER) AS channel, max(v) AS peak,
    row_number() OVER (PARTITION BY spike_idx ORDER BY max(v) DESC, CAST(pos // {LEN} AS INTEGER)) rn FROM samp GROUP BY 1, 2) WHERE rn = 1""", "samp"))
def peak_channel(spark, sf):
    w = waves(spark, sf)
    per = w.select(F.lit(1).alias("session_id"), "spike_idx", F.explode(F.array(*[
        F.struct(F.lit(k).alias("channel"), K.channel("samples", k, LEN).alias("samples")) for k in range(CH)])).alias("x"))
    p = S.peak_channel(per.select("session_id", "spike_idx", "x.channel", "x.samples"))
    return p.select("spike_idx", "channel", rd("peak", 6).alias("peak"))


@query("spike_width", compose(f"""
, m AS (SELECT label, pos, CAST(pos // {LEN} AS INTEGER) ch, CAST(pos % {LEN} AS INTEGER) s, avg(v) v FROM samp GROUP BY 1, 2),
p AS (SELECT label, ch, s FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY v DESC, pos) rn FROM m) WHERE rn = 1),
t AS (SELECT m.label, p.ch AS channel, m.s - p.s AS w, row_number() OVER (PARTITION BY m.label ORDER BY m.v, m.s) rn FROM m JOIN p ON p.label = m.label AND p.ch = m.ch AND m.s >= p.s)
SELECT label, channel, {R('w / 48.0', 6)} AS width FROM t WHERE rn = 1""", "samp"))
def spike_width(spark, sf):
    return K.spike_width(waves(spark, sf), ["label"], CH, LEN, 48.0).withColumn("width", rd("width", 6))


# ------------------------------------------------------------- cluster quality
def quality_features(spark, sf, d: int):
    """Energies, and for d = 8 also the first principal component of every channel."""
    w = waves(spark, sf)
    e = K.with_energy(w, CH, LEN)
    if d <= CH:
        return e.select(*SITE, "spike_idx", "label", F.slice("energy", 1, d).alias("features"))
    pc = K.wave_components(e, SITE, CH, LEN, id_columns=("spike_idx", "label", "energy"))
    return pc.select(*SITE, "spike_idx", "label", F.concat("energy", "pc").alias("features"))


part("f2", ("en",), """
  SELECT spike_idx, label, max(CASE WHEN ch = 0 THEN e END) AS a, max(CASE WHEN ch = 1 THEN e END) AS b FROM en GROUP BY 1, 2""")
part("d2", ("f2",), """
  SELECT f.spike_idx, f.label, m.label AS cluster, m.n,
    ((f.a-ma)*(f.a-ma)*vb - 2*(f.a-ma)*(f.b-mb)*cv + (f.b-mb)*(f.b-mb)*va) / (va*vb - cv*cv) AS d2
  FROM f2 f CROSS JOIN (SELECT label, count(*) n, avg(a) ma, avg(b) mb, var_samp(a) va, var_samp(b) vb, covar_samp(a, b) cv FROM f2 GROUP BY 1) m""")


@query("mahalanobis", compose(f"SELECT spike_idx, cluster, {R('d2')} AS d2 FROM d2", "d2"))
def mahalanobis(spark, sf):
    m = K.mahalanobis(quality_features(spark, sf, 2), SITE, 2)
    return m.select("spike_idx", "cluster", rd("d2").alias("d2"))


@query("l_ratio_2d", compose(f"""
SELECT cluster, max(n) AS n, {R('sum(CASE WHEN label <> cluster THEN exp(-d2 / 2) ELSE 0 END)')} AS l,
  {R('sum(CASE WHEN label <> cluster THEN exp(-d2 / 2) ELSE 0 END) / max(n)')} AS l_ratio FROM d2 GROUP BY 1""", "d2"))
def l_ratio_2d(spark, sf):
    r = K.l_ratio(K.mahalanobis(quality_features(spark, sf, 2), SITE, 2), SITE, 2)
    return r.select("cluster", "n", rd("l").alias("l"), rd("l_ratio").alias("l_ratio"))


@query("isolation_2d", compose(f"""
, r AS (SELECT cluster, n, d2, row_number() OVER (PARTITION BY cluster ORDER BY d2) rn FROM d2 WHERE label <> cluster)
SELECT cluster, n, {R('d2')} AS isolation FROM r WHERE rn = n""", "d2"))
def isolation_2d(spark, sf):
    i = K.isolation_distance(K.mahalanobis(quality_features(spark, sf, 2), SITE, 2), SITE, unit_options(spark, sf))
    return i.select("cluster", "n", rd("isolation").alias("isolation"))


@query("cluster_quality")
def cluster_quality(spark, sf):
    """L-ratio and isolation distance on energies and first principal components."""
    m = K.mahalanobis(quality_features(spark, sf, 8), SITE, 8)
    j = K.l_ratio(m, SITE, 8).join(K.isolation_distance(m, SITE, unit_options(spark, sf)).drop("n"), [*SITE, "cluster"])
    return j.select("cluster", "n", rd("l_ratio").alias("l_ratio"), rd("isolation").alias("isolation"))


@query("wave_pca")
def wave_pca(spark, sf):
    pc = K.wave_components(waves(spark, sf), SITE, CH, LEN)
    return pc.select("spike_idx", "label", F.posexplode_outer("pc").alias("channel", "v")).withColumn("v", rd("v"))


@query("wave_features")
def wave_features(spark, sf):
    f = K.shape_features(waves(spark, sf), CH, LEN, 1.0, ["spike_idx", "label"])
    return f.select("spike_idx", "label", F.posexplode_outer("features").alias("feature", "v")).withColumn("v", rd("v"))


# ------------------------------------------------------------------- matching
part("um", ("samp",), "SELECT site, session_no, label, pos, avg(v) AS v FROM samp GROUP BY 1, 2, 3, 4")
part("msd", ("um",), """
  SELECT a.site, a.session_no AS prev_no, b.session_no, a.label AS unit_a, b.label AS unit_b, avg((a.v - b.v) * (a.v - b.v)) AS distance
  FROM um a JOIN um b ON a.site = b.site AND b.session_no = a.session_no + 1 AND a.pos = b.pos GROUP BY 1, 2, 3, 4, 5""")


@query("msd_matrix", compose(f"SELECT prev_no, session_no, unit_a, unit_b, {R('distance', 8)} AS distance FROM msd", "msd"))
def msd_matrix(spark, sf):
    w = waves(spark, sf)
    return MT.mean_square_difference(w, session_pairs(w), SITE).select("prev_no", "session_no", "unit_a", "unit_b", rd("distance", 8).alias("distance"))


part("hist", ("en",), """
  SELECT e.site, e.session_no, e.label, e.ch AS feature, least(floor((e.e - lo) / (hi - lo) * 100), 99) AS bin, count(*) n, max(size) AS size
  FROM en e JOIN (SELECT site, session_no, label, ch, min(e) lo, max(e) hi, count(*) size FROM en GROUP BY 1, 2, 3, 4) l
    ON l.site = e.site AND l.session_no = e.session_no AND l.label = e.label AND l.ch = e.ch GROUP BY 1, 2, 3, 4, 5""")
part("jsd", ("hist",), """
  SELECT site, prev_no, session_no, unit_a, unit_b, avg(js) AS distance FROM (
    SELECT site, prev_no, session_no, unit_a, unit_b, feature, sqrt(greatest(sum(
        (CASE WHEN np > 0 THEN np / sp * ln(np / sp / ((np + nq) / (sp + sq))) ELSE 0 END
       + CASE WHEN nq > 0 THEN nq / sq * ln(nq / sq / ((np + nq) / (sp + sq))) ELSE 0 END)) / 2, 0)) AS js FROM (
      SELECT a.site, a.session_no AS prev_no, b.session_no, a.label AS unit_a, b.label AS unit_b, a.feature, k.bin,
             coalesce(x.n, 0)::DOUBLE np, coalesce(y.n, 0)::DOUBLE nq, a.size::DOUBLE sp, b.size::DOUBLE sq
      FROM (SELECT DISTINCT site, session_no, label, feature, size FROM hist) a
      JOIN (SELECT DISTINCT site, session_no, label, feature, size FROM hist) b ON b.site = a.site AND b.session_no = a.session_no + 1 AND b.feature = a.feature
      CROSS JOIN range(100) k(bin)
      LEFT JOIN hist x ON x.site = a.site AND x.session_no = a.session_no AND x.label = a.label AND x.feature = a.feature AND x.bin = k.bin
      LEFT JOIN hist y ON y.site = b.site AND y.session_no = b.session_no AND y.label = b.label AND y.feature = b.feature AND y.bin = k.bin)
    GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1, 2, 3, 4, 5""")


def jsd(spark, sf):
    w = waves(spark, sf)
    f = K.with_energy(w, CH, LEN).withColumnRenamed("energy", "features")
    return MT.jensen_shannon(f, session_pairs(w), SITE, 100)


@query("jsd_matrix", compose(f"SELECT prev_no, session_no, unit_a, unit_b, {R('distance', 6)} AS distance FROM jsd", "jsd"))
def jsd_matrix(spark, sf):
    return jsd(spark, sf).select("prev_no", "session_no", "unit_a", "unit_b", rd("distance", 6).alias("distance"))


@query("mutual_best", compose(f"""
SELECT prev_no, session_no, unit_a, unit_b, {R('distance', 6)} AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY prev_no, session_no, unit_a ORDER BY distance, unit_b) ra,
            row_number() OVER (PARTITION BY prev_no, session_no, unit_b ORDER BY distance, unit_a) rb FROM jsd) WHERE ra = 1 AND rb = 1""", "jsd"))
def mutual_best(spark, sf):
    return MT.mutual_best(jsd(spark, sf), PAIR).select("prev_no", "session_no", "unit_a", "unit_b", rd("distance", 6).alias("distance"))


@query("unit_matches")
def unit_matches(spark, sf):
    return MT.match_units(jsd(spark, sf), PAIR).select("prev_no", "session_no", "unit_a", "unit_b", rd("distance", 6).alias("distance"), "step")


@query("global_units")
def global_units(spark, sf):
    w = waves(spark, sf)
    m = MT.match_units(jsd(spark, sf), PAIR)
    ids = MT.chain_ids(m, w.select(*SITE, "session_no", "label").distinct(), SITE)
    return ids.withColumn("chain_distance", rd("chain_distance", 6))


@query("label_remap")
def label_remap(spark, sf):
    w = waves(spark, sf)
    ids = MT.chain_ids(MT.match_units(jsd(spark, sf), PAIR), w.select(*SITE, "session_no", "label").distinct(), SITE)
    r = MT.relabel(w.select(*SITE, "session_no", "spike_idx", "label"), ids, [*SITE, "session_no"])
    return r.groupBy("session_no", "label").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------- divergence of several features
SITES = 3
SIDES = ["site", "prev_no", "session_no", "unit_a", "unit_b"]


def recorded(spark, sf):
    """Spikes with a recording site from the data; every second spike of a site is of the second session."""
    return waves(spark, sf).withColumn("site", (F.floor(F.col("spike_idx") / 2) % SITES).cast("int"))


def unit_mixtures(spark, sf):
    w = recorded(spark, sf).select(*SITE, "session_no", "label", "spike_idx", F.col("samples").alias("features"))
    return DV.mixtures(w, session_pairs(w), SITE, OPTIONS.seed, OPTIONS)


part("rec", (), f"""
  SELECT CAST(vec_id // 2 % {SITES} AS INTEGER) AS site, vec_id AS spike_idx, CAST(vec_id % 2 + 1 AS INTEGER) AS session_no, label,
         CAST(embedding AS DOUBLE[]) AS v, CAST(('0x' || substr(md5('{OPTIONS.seed}:' || vec_id), 1, 13)) AS BIGINT) AS u FROM embeddings""")
part("drawn", ("rec",), "SELECT *, row_number() OVER (PARTITION BY site, session_no, label ORDER BY u, spike_idx) AS draw, count(*) OVER (PARTITION BY site, session_no, label) AS n FROM rec")
part("upair", ("drawn",), """
  SELECT a.site, a.session_no AS prev_no, b.session_no, a.label AS unit_a, b.label AS unit_b, least(a.n, b.n) AS take
  FROM (SELECT DISTINCT site, session_no, label, n FROM drawn) a JOIN (SELECT DISTINCT site, session_no, label, n FROM drawn) b
  ON a.site = b.site AND b.session_no = a.session_no + 1""")
part("mix", ("upair", "drawn"), """
  SELECT p.site, p.prev_no, p.session_no, p.unit_a, p.unit_b, 'a' AS side, d.spike_idx, d.v, d.draw <= p.take AS in_mixture
  FROM upair p JOIN drawn d ON d.site = p.site AND d.session_no = p.prev_no AND d.label = p.unit_a
  UNION ALL SELECT p.site, p.prev_no, p.session_no, p.unit_a, p.unit_b, 'b', d.spike_idx, d.v, d.draw <= p.take
  FROM upair p JOIN drawn d ON d.site = p.site AND d.session_no = p.session_no AND d.label = p.unit_b""")


@query("unit_mixture", compose("SELECT site, prev_no, session_no, unit_a, unit_b, side, spike_idx FROM mix WHERE in_mixture", "mix"))
def unit_mixture(spark, sf):
    """The rows of each pair of units that make up its mixture sample."""
    return unit_mixtures(spark, sf).where("in_mixture").select(*SIDES, "side", "spike_idx")


@query("knn_divergence", compose(f"""
, dist AS (SELECT x.site, x.prev_no, x.session_no, x.unit_a, x.unit_b, x.side, x.spike_idx,
    min(CASE WHEN y.side = x.side AND list_distance(x.v, y.v) > 0 THEN list_distance(x.v, y.v) END) AS r,
    min(CASE WHEN y.in_mixture AND list_distance(x.v, y.v) > 0 THEN list_distance(x.v, y.v) END) AS s
  FROM mix x JOIN mix y ON x.site = y.site AND x.prev_no = y.prev_no AND x.session_no = y.session_no AND x.unit_a = y.unit_a AND x.unit_b = y.unit_b
  GROUP BY 1, 2, 3, 4, 5, 6, 7),
m AS (SELECT site, prev_no, session_no, unit_a, unit_b, count(*) FILTER (in_mixture) AS m FROM mix GROUP BY 1, 2, 3, 4, 5),
k AS (SELECT site, prev_no, session_no, unit_a, unit_b, side, count(*) AS n, sum(log2(s / r)) AS t, count(*) FILTER (r IS NULL OR s IS NULL) AS open
  FROM dist GROUP BY 1, 2, 3, 4, 5, 6),
kl AS (SELECT *, CASE WHEN n > 1 AND open = 0 THEN greatest({CH * LEN}::DOUBLE / n * t + log2(m / (n - 1)), 0.0) END AS kl FROM k JOIN m USING (site, prev_no, session_no, unit_a, unit_b)),
w AS (SELECT site, prev_no, session_no, unit_a, unit_b, max(CASE WHEN side = 'a' THEN kl END) AS kl_a, max(CASE WHEN side = 'b' THEN kl END) AS kl_b FROM kl GROUP BY 1, 2, 3, 4, 5)
SELECT site, prev_no, session_no, unit_a, unit_b, {R('kl_a')} AS kl_a, {R('kl_b')} AS kl_b, {R('sqrt((kl_a + kl_b) / 2)')} AS jsd FROM w""", "mix"))
def knn_divergence(spark, sf):
    """Divergence of the units of two sessions over whole waveforms, by nearest neighbours."""
    k = DV.neighbour_divergence(unit_mixtures(spark, sf), SIDES, CH * LEN)
    return k.select(*SIDES, *[rd(c).alias(c) for c in ("kl_a", "kl_b", "jsd")])


# --------------------------------------------------- chains over many sessions
SESSIONS = 4
part("um4", (), f"""
  SELECT CAST(vec_id // {SESSIONS} % {SITES} AS INTEGER) AS site, CAST(vec_id % {SESSIONS} + 1 AS INTEGER) AS session_no, label, pos, avg(v) AS v
  FROM (SELECT vec_id, label, unnest(range(0, {CH * LEN})) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings) GROUP BY 1, 2, 3, 4""")
part("best4", ("um4",), """
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY site, session_no, unit_a ORDER BY distance, unit_b) ra, row_number() OVER (PARTITION BY site, session_no, unit_b ORDER BY distance, unit_a) rb FROM (
      SELECT a.site, a.session_no AS prev_no, b.session_no, a.label AS unit_a, b.label AS unit_b, avg((a.v - b.v) * (a.v - b.v)) AS distance
      FROM um4 a JOIN um4 b ON a.site = b.site AND b.session_no = a.session_no + 1 AND a.pos = b.pos GROUP BY 1, 2, 3, 4, 5)) WHERE ra = 1 AND rb = 1""")
part("chained", ("best4",), """
  SELECT m.site, m.prev_no AS session_no, m.unit_a AS label, m.prev_no AS root_no, m.unit_a AS root_label FROM best4 m
  WHERE NOT EXISTS (SELECT 1 FROM best4 e WHERE e.site = m.site AND e.session_no = m.prev_no AND e.unit_b = m.unit_a)
  UNION ALL SELECT c.site, m.session_no, m.unit_b, c.root_no, c.root_label FROM chained c JOIN best4 m ON m.site = c.site AND m.prev_no = c.session_no AND m.unit_a = c.label""")


@query("unit_chains", compose(f"""
, mean AS (SELECT c.site, root_no, root_label, avg(distance) AS d FROM chained c JOIN best4 m ON m.site = c.site AND m.session_no = c.session_no AND m.unit_b = c.label GROUP BY 1, 2, 3),
num AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY d, root_no, root_label) AS id, count(*) OVER (PARTITION BY site) AS chains FROM mean),
u AS (SELECT DISTINCT site, session_no, label FROM um4),
j AS (SELECT u.*, n.id, n.d, (SELECT max(chains) FROM num WHERE num.site = u.site) AS chains FROM u LEFT JOIN chained c ON c.site = u.site AND c.session_no = u.session_no AND c.label = u.label
      LEFT JOIN num n ON n.site = c.site AND n.root_no = c.root_no AND n.root_label = c.root_label)
SELECT site, session_no, label, CAST(coalesce(id, coalesce(chains, 0) + 1 + sum(CASE WHEN id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY session_no, label ROWS UNBOUNDED PRECEDING)) AS INTEGER) AS global_id,
  {R('d', 8)} AS chain_distance FROM j""", "chained").replace("WITH ", "WITH RECURSIVE ", 1))
def unit_chains(spark, sf):
    """Units followed over four sessions of three sites by mutual best matches of their mean waveforms."""
    w = waves(spark, sf).withColumns({"site": (F.floor(F.col("spike_idx") / SESSIONS) % SITES).cast("int"), "session_no": (F.col("spike_idx") % SESSIONS + 1).cast("int")})
    m = MT.mutual_best(MT.mean_square_difference(w, session_pairs(w), SITE), PAIR)
    ids = MT.chain_ids(m, w.select(*SITE, "session_no", "label").distinct(), SITE)
    return ids.withColumn("chain_distance", rd("chain_distance", 8))
