"""Firing fields: blobs, place fields, sampling grids and field measures."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spikegrid.functions import grid_kernels as gk
from spikegrid.functions.arrow_lists import end_to_end, lists_of
from spikegrid.functions.expr import safe_div
from spikegrid.operators.maps import spread
from spikegrid.settings import DEFAULT, Settings


def blobs(packed: DataFrame, keys: Sequence[str], column: str, rows: int, cols: int, factor: float,
          no_filter: bool = False, settings: Settings = DEFAULT) -> DataFrame:
    """Labels of the activity blobs as an int array ``labels`` per map."""
    taps = gk.gaussian_taps(factor)
    mats = None if no_filter else (gk.smoothing_matrix(rows, taps), gk.smoothing_matrix(cols, taps))
    s = settings

    @F.arrow_udf("array<int>")
    def run(rate: pa.Array) -> pa.Array:
        maps = end_to_end(rate).reshape(-1, rows, cols)
        return lists_of(gk.blob_labels(maps, mats, s.blob_low, s.blob_high, s.blob_min_share).reshape(-1, rows * cols))

    # not repeatable to the planner, or a filter on the labels runs the kernel a second time
    return spread(packed, keys).select(*keys, column, run.asNondeterministic()(column).alias("labels"))


def place_fields(packed: DataFrame, keys: Sequence[str], column: str, rows: int, cols: int,
                 clearance: int = 4, settings: Settings = DEFAULT) -> DataFrame:
    """Labels of the place fields as an int array ``labels`` per map."""
    s = settings

    @F.arrow_udf("array<int>")
    def run(rate: pa.Array) -> pa.Array:
        found = [gk.place_field_labels(m, s.field_min_bins, s.field_min_mean, s.field_min_peak, s.field_high, s.field_low, s.field_step,
                                       clearance=clearance) for m in gk.parts(end_to_end(rate).reshape(-1, rows, cols))]
        return lists_of(np.concatenate([*found, np.zeros((0, rows, cols), np.int32)]).reshape(-1, rows * cols))

    return spread(packed, keys).select(*keys, column, run.asNondeterministic()(column).alias("labels"))


def field_bins(labelled: DataFrame, keys: Sequence[str], column: str, cols: int) -> DataFrame:
    """Long rows (keys, field_id, r, c, rate) of the labelled bins."""
    z = labelled.select(*keys, F.posexplode_outer(F.arrays_zip(F.col("labels").alias("l"), F.col(column).alias("v"))).alias("_b", "_z"))
    return z.where("_z.l > 0").select(
        *keys, F.col("_z.l").alias("field_id"), F.floor(F.col("_b") / cols).cast("int").alias("r"),
        (F.col("_b") % cols).cast("int").alias("c"), F.col("_z.v").alias("rate"),
    )


def field_measures(bins: DataFrame, keys: Sequence[str], total_bins: int) -> DataFrame:
    """Size, share, centroid and rates of each field."""
    return bins.groupBy(*keys, "field_id").agg(
        F.count(F.lit(1)).alias("bins"),
        (100.0 * F.count(F.lit(1)) / F.lit(float(total_bins))).alias("size_percent"),
        F.avg("r").alias("centroid_r"),
        F.avg("c").alias("centroid_c"),
        F.avg("rate").alias("mean_rate"),
        F.max("rate").alias("peak_rate"),
        F.sum("rate").alias("total_rate"),
    )


def rank_fields(measures: DataFrame, keys: Sequence[str], bin_area: float, min_area: float = 22.5,
                count_twice: bool = True) -> DataFrame:
    """Order fields by total rate and keep the large ones; the largest always stays.

    ``count_twice`` keeps the published area rule, which adds the row and the
    column count of a field.
    """
    area = F.col("bins") * F.lit((2.0 if count_twice else 1.0) * bin_area)
    wide = measures.withColumn("area", area)
    w = Window.partitionBy(*keys)
    big = F.max("area").over(w)
    first_big = F.row_number().over(w.orderBy(F.desc("area"), "field_id"))
    kept = wide.withColumn("_keep", F.when(big > F.lit(min_area), F.col("area") > F.lit(min_area)).otherwise(first_big == 1))
    rank = F.row_number().over(w.orderBy(F.desc("total_rate"), "field_id"))
    return kept.where("_keep").withColumn("rank", rank).drop("_keep")


def cumulative_measures(bins: DataFrame, keys: Sequence[str], valid_bins: int) -> DataFrame:
    """Coverage, area and rate of all fields of a map together."""
    return bins.groupBy(*keys).agg(
        F.count_distinct("field_id").alias("fields"),
        (F.count(F.lit(1)) / F.lit(float(valid_bins))).alias("coverage"),
        F.count(F.lit(1)).alias("area"),
        F.sum("rate").alias("rate"),
    )


def wide_fields(measures: DataFrame, keys: Sequence[str], n: int, value: str = "size_percent") -> DataFrame:
    """Report columns ``Field_1 .. Field_n``."""
    return measures.groupBy(*keys).pivot("rank", list(range(1, n + 1))).agg(F.first(value)).select(
        *keys, *[F.col(str(k)).alias(f"Field_{k}") for k in range(1, n + 1)]
    )


def fit_ellipses(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least-squares ellipse of the bins of each field (a field has at most one map of bins)."""

    @F.pandas_udf("struct<x:double,y:double,long:double,short:double,tilt:double>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(x, y):
            fit = gk.ellipse(np.asarray(a, float), np.asarray(b, float)) if len(a) > 5 else None
            out.append(fit or (None,) * 5)
        return pd.DataFrame(out, columns=["x", "y", "long", "short", "tilt"]).astype(float)

    g = bins.groupBy(*keys).agg(F.collect_list(F.struct("c", "r")).alias("_p"))
    return g.select(*keys, run(F.col("_p.c"), F.col("_p.r")).alias("e")).select(*keys, "e.*")


def sampling_grid(spark: SparkSession, height: float, width: float, spacing: float, hexagonal: bool = False,
                  cylinder: bool = False) -> DataFrame:
    """Rectangular or hexagonal lattice of sampling points, optionally clipped to a disk."""
    size = spacing / math.sqrt(3)
    step_x = 1.5 * size if hexagonal else spacing
    step_y = size * math.sqrt(3) if hexagonal else spacing
    nx, ny = math.ceil(width / step_x), math.ceil(height / step_y)
    g = spark.range(nx * ny).select(
        (F.col("id") % nx).alias("col"), F.floor(F.col("id") / nx).alias("row")
    )
    shift = F.when(F.col("col") % 2 == 1, F.lit(step_y / 2)).otherwise(0.0) if hexagonal else F.lit(0.0)
    g = g.select("row", "col", (F.col("col") * F.lit(step_x)).alias("x"), (F.col("row") * F.lit(step_y) + shift).alias("y"))
    if cylinder:
        rx, ry = width / 2, height / 2
        g = g.where(F.sqrt(F.pow(F.col("x") - rx, 2) + F.pow(F.col("y") - ry, 2)) <= rx)
    return g


def lattice_points(arenas: DataFrame, keys: Sequence[str], spacing: float, least: float | None = None, hexagonal: bool = False,
                   disk: bool = False) -> DataFrame:
    """(keys, no, x, y): sampling points of each arena (keys, height, width) by row, then column.

    ``disk`` keeps the points inside the circle of the arena's width; ``least`` drops a point
    that is closer than that to an earlier one that stays. An arena has few points, so they
    are one row until they are listed."""
    size = spacing / math.sqrt(3)
    step_x, step_y = (1.5 * size, size * math.sqrt(3)) if hexagonal else (spacing, spacing)
    to = lambda n: F.sequence(F.lit(0), F.greatest(F.ceil(n), F.lit(1)).cast("int") - 1)
    rows, cols = to(F.col("height") / F.lit(step_y)), to(F.col("width") / F.lit(step_x))
    shift = lambda c: F.when(c % 2 == 1, F.lit(step_y / 2)).otherwise(F.lit(0.0)) if hexagonal else F.lit(0.0)
    point = lambda r, c: F.struct((c * F.lit(step_x)).alias("x"), (r * F.lit(step_y) + shift(c)).alias("y"))
    grid = F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: point(r, c))))
    if disk:
        rx, ry = F.col("width") / 2, F.col("height") / 2
        grid = F.filter(grid, lambda p: F.sqrt((p["x"] - rx) * (p["x"] - rx) + (p["y"] - ry) * (p["y"] - ry)) <= rx)
    found = arenas.where("height > 0 AND width > 0").select(*keys, grid.alias("_g"))
    if least is not None:
        @F.pandas_udf("array<struct<x: double, y: double>>")
        def thinned(x: pd.Series, y: pd.Series) -> pd.Series:
            out = []
            for a, b in zip(x, y):
                stay = gk.thin(np.asarray(a, float), np.asarray(b, float), least)
                out.append([{"x": float(p), "y": float(q)} for p, q, s in zip(a, b, stay) if s])
            return pd.Series(out)

        found = found.select(*keys, thinned(F.col("_g.x"), F.col("_g.y")).alias("_g"))
    return found.select(*keys, F.posexplode_outer("_g").alias("no", "p")).where("no IS NOT NULL").select(*keys, "no", "p.x", "p.y")


def object_bins(rows: int, cols: int) -> dict[str, tuple[int, int]]:
    """Bin of the object for each object angle (fixed layout: wall mid-points, NO = centre)."""
    return {
        "0": (0, cols // 2), "90": (rows // 2, cols - 1), "180": (rows - 1, cols // 2), "270": (rows // 2, 0),
        "NO": (rows // 2, cols // 2),
    }


def shift_fields(packed: DataFrame, keys: Sequence[str], column: str, rows: int, cols: int, seed: int = 0) -> DataFrame:
    """Null map: every field keeps its shape and moves to a random place (torus),
    a bin that is taken goes to the nearest free one; other bins keep their order."""

    @F.pandas_udf("array<double>")
    def run(rate: pd.Series, labels: pd.Series, salt: pd.Series) -> pd.Series:
        out = []
        for v, l, s in zip(rate, labels, salt):
            out.append(_place_anew(np.asarray(v, float).reshape(rows, cols), np.asarray(l).reshape(rows, cols), int(s)))
        return pd.Series(out)

    salt = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(1 << 31))
    return spread(packed, keys).select(*keys, run(column, "labels", salt).alias("shuffled"))


def wrap_fields(packed: DataFrame, keys: Sequence[str], column: str, rows: int, cols: int, seed: int = 0, sigma: float = 2.0) -> DataFrame:
    """(keys, raw, blurred): null map with whole fields moved around the edges of the map, the
    holes they leave refilled from the bins they cover; then blurred to a distribution."""
    left, right = gk.reflected_blur(rows, sigma), gk.reflected_blur(cols, sigma)

    @F.arrow_udf("struct<raw: array<double>, blurred: array<double>>")
    def run(rate: pa.Array, labels: pa.Array, salt: pa.Array) -> pa.Array:
        raw = end_to_end(rate).reshape(-1, rows, cols)
        for k, (l, s) in enumerate(zip(end_to_end(labels).astype(int).reshape(raw.shape), salt.to_pylist())):
            raw[k] = gk.wrapped_fields(raw[k], l, np.random.default_rng(s))
        blur, total = raw.copy(), raw.sum(axis=(1, 2), keepdims=True)
        full = total[:, 0, 0] > 0
        blur[full] = left @ (raw[full] / total[full]) @ right.T
        blur[full] /= blur[full].sum(axis=(1, 2), keepdims=True)
        flat = lambda m: lists_of(m.reshape(-1, rows * cols))
        return pa.StructArray.from_arrays([flat(raw), flat(blur)], ["raw", "blurred"])

    salt = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(1 << 31))
    return spread(packed, keys).select(*keys, column, "labels", run.asNondeterministic()(column, "labels", salt).alias("_s")).select(*keys, column, "labels", "_s.raw", "_s.blurred")


def _place_anew(rate: np.ndarray, labels: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    n, m = rate.shape
    out, free = np.full(rate.shape, np.nan), np.ones(rate.shape, dtype=bool)
    rr, cc = np.mgrid[:n, :m]
    for k in range(1, labels.max() + 1):
        dr, dc = rng.integers(n), rng.integers(m)
        for r, c in np.argwhere(labels == k):
            y, x = (r + dr) % n, (c + dc) % m
            if not free[y, x]:
                d = np.where(free, np.abs(rr - y) + np.abs(cc - x), n + m + 1)
                y, x = np.unravel_index(np.argmin(d), d.shape)
            out[y, x], free[y, x] = rate[r, c], False
    rest = rate[labels == 0]
    out[free] = rest[rng.permutation(len(rest))]
    return out.ravel()
