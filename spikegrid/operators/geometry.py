"""Positions relative to objects, rotations, scaling and time axes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spikegrid.functions.expr import hash_uniform, hypot2, safe_div
from spikegrid.operators.ordered import attach


# --------------------------------------------------------------------- objects
def peak_anchor(maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bin with the highest value (first in scan order)."""
    top = F.max_by(F.struct("r", "c"), F.struct("v", -F.col("r"), -F.col("c")))
    return maps.groupBy(*keys).agg(top.alias("_p")).select(*keys, F.col("_p.r").cast("double").alias("r"), F.col("_p.c").cast("double").alias("c"))


def centroid_anchor(bins: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Mean bin, plain (field or binary map) or weighted."""
    w = weight if weight is not None else F.lit(1.0)
    return bins.groupBy(*keys).agg(safe_div(F.sum(w * F.col("r")), F.sum(w)).alias("r"), safe_div(F.sum(w * F.col("c")), F.sum(w)).alias("c"))


def vectors_to_objects(anchors: DataFrame, keys: Sequence[str], rows: int, cols: int, height: float, width: float,
                       objects: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Length and signed angle (degrees) from each of a few fixed objects to the anchor bin
    (nearest bin, halves to the even one)."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit((r + 0.5) * height / rows).alias("y"), F.lit((c + 0.5) * width / cols).alias("x"))
                      for k, (r, c) in objects.items()])
    d = anchors.withColumn("_o", F.explode(table))
    y, x = (F.rint("r") + 0.5) * F.lit(height / rows), (F.rint("c") + 0.5) * F.lit(width / cols)
    oy, ox = F.col("_o.y"), F.col("_o.x")
    return d.select(*keys, F.col("_o.k").alias("object"), hypot2(x - ox, y - oy).alias("magnitude"),
                    F.degrees(F.atan2(oy * x - ox * y, oy * y + ox * x)).alias("angle"))


def point_distances(maps: DataFrame, keys: Sequence[str], rows: int, cols: int, height: float, width: float,
                    points: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Weighted mean distance of a map to each of a fixed list of points (name, y, x)."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(y)).alias("y"), F.lit(float(x)).alias("x")) for k, y, x in points])
    y, x = (F.col("r") + 0.5) * F.lit(height / rows), (F.col("c") + 0.5) * F.lit(width / cols)
    # a map is packed before it meets the points: what is shuffled are its bins, not one row a point
    packed = maps.groupBy(*keys).agg(F.collect_list(F.struct(y.alias("y"), x.alias("x"), F.col("v").alias("v"))).alias("_m"), F.sum("v").alias("_w"))
    d = packed.withColumn("_o", F.explode(table))
    far = F.transform("_m", lambda m: m["v"] * hypot2(m["x"] - F.col("_o.x"), m["y"] - F.col("_o.y")))
    d = d.select(*keys, "_w", F.col("_o.k").alias("point"), F.filter(far, lambda v: v.isNotNull()).alias("_d"))
    total = F.when(F.size("_d") > 0, F.aggregate("_d", F.lit(0.0), lambda s, v: s + v))
    return d.select(*keys, "point", safe_div(total, "_w").alias("distance"))


# ---------------------------------------------------------- rotation, scaling
def rotate_quarter(maps: DataFrame, rows: int) -> DataFrame:
    """Map turned by 90 degrees: the first row becomes the last column."""
    return maps.withColumns({"r": F.col("c"), "c": F.lit(rows - 1) - F.col("r")})


def rotate_points(points: DataFrame) -> DataFrame:
    return points.withColumns({"x": F.col("y"), "y": -F.col("x")})


def scale_points(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each axis mapped to [0, 1] within a key."""
    lim = points.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    j = attach(points, lim, keys)
    return j.withColumns({c: safe_div(F.col(c) - F.col(f"_lo{c}"), F.col(f"_hi{c}") - F.col(f"_lo{c}")) for c in ("x", "y")}).drop("_lox", "_hix", "_loy", "_hiy")


# ------------------------------------------------------------------- time axes
def time_index(spark: SparkSession, seconds: float, rate: float) -> DataFrame:
    """i, t and clock text of a regular time axis."""
    n = int(int(seconds) * rate)
    t = F.col("id") / F.lit(float(rate))
    clock = F.date_format(F.timestamp_micros(F.round(t * 1e6).cast("long")), "HH:mm:ss.SSSSSS")
    return spark.range(n).select(F.col("id").alias("i"), t.alias("t"), clock.alias("clock"))


# ------------------------------------------------------------------ generators
def random_trains(spark: SparkSession, units: int, seconds: float, rate: float, share: float = 0.1, seed: int = 0) -> DataFrame:
    """Spikes of random trains: every time bin fires with probability ``share``."""
    n = int(seconds * rate)
    g = spark.range(units * n).select((F.col("id") / n).cast("int").alias("unit"), (F.col("id") % n).alias("i"))
    return g.where(hash_uniform("unit", "i", seed=seed) < F.lit(share)).select("unit", "i", (F.col("i") / F.lit(float(rate))).alias("t"))


def random_waveforms(spikes: DataFrame, channels: int, length: int, clusters: int = 10, seed: int = 0) -> DataFrame:
    """Label and integer samples in [-20, 20) for every spike."""
    u = lambda *c: hash_uniform("unit", "i", *c, seed=seed)
    samples = F.transform(F.sequence(F.lit(0), F.lit(channels * length - 1)), lambda k: F.floor(u(k) * 40 - 20).cast("double"))
    return spikes.withColumns({"label": F.floor(u(F.lit(-1)) * clusters).cast("int"), "samples": samples})
