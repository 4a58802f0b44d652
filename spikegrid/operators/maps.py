"""Occupancy, spike and rate maps.

A map is a long table ``(keys..., r, c, v)`` that stores only the bins with a
value; operators that need the empty bins account for them by formula or unpack
one map (at most rows x cols values) inside a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spikegrid.functions import grid_kernels as gk
from spikegrid.functions.arrow_lists import end_to_end, lists_of, row_numbers
from spikegrid.functions.expr import (
    Extent, grid_col, grid_col_yspan, grid_row, grid_row_upward_span,
)
from spikegrid.operators.ordered import attach
from spikegrid.operators.tracking import with_step
from spikegrid.settings import DEFAULT, Settings

SESSION = ["session_id"]
UNIT = ["session_id", "unit"]


def data_extent(trk: DataFrame) -> DataFrame:
    """Tracked limits per session, for maps that span the data rather than the arena."""
    return trk.groupBy(*SESSION).agg(
        F.min("x").alias("_xlo"), F.max("x").alias("_xhi"), F.min("y").alias("_ylo"), F.max("y").alias("_yhi")
    )


def on_data_extent(df: DataFrame, limits: DataFrame) -> tuple[DataFrame, Extent]:
    """Attach the limits of each session and return the matching extent."""
    return attach(df, limits, SESSION), Extent(F.col("_xlo"), F.col("_xhi"), F.col("_ylo"), F.col("_yhi"))


def occupancy(trk: DataFrame, ext: Extent, rows: int, cols: int, settings: Settings = DEFAULT) -> DataFrame:
    """Seconds per bin: the time since the previous sample goes to the bin of the sample."""
    steps = trk if "dt" in trk.columns else with_step(trk, settings)
    return (
        steps.where(F.col("dt").isNotNull())
        .groupBy(*SESSION, grid_row("y", ext, rows).alias("r"), grid_col("x", ext, cols).alias("c"))
        .agg(F.sum("dt").alias("v"))
    )


def coverage(occ: DataFrame, rows: int, cols: int) -> DataFrame:
    """Visited bins dilated by a 2 x 2 block (to the right and down)."""
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (0, 1) for b in (0, 1)]))
    return (
        occ.select(*SESSION, "r", "c", shift.alias("d"))
        .select(*SESSION, (F.col("r") + F.col("d.dr")).alias("r"), (F.col("c") + F.col("d.dc")).alias("c"))
        .where((F.col("r") < rows) & (F.col("c") < cols))
        .distinct()
    )


def spike_counts(
    pos: DataFrame, ext: Extent, rows: int, cols: int, keys: Sequence[str] = UNIT, swapped_axes: bool = False
) -> DataFrame:
    """Spikes per bin; ``swapped_axes`` keeps the axis mix-up some old reports rely on."""
    r = grid_row_upward_span("y", ext, rows) if swapped_axes else grid_row("y", ext, rows)
    c = grid_col_yspan("x", ext, cols) if swapped_axes else grid_col("x", ext, cols)
    return pos.groupBy(*keys, r.alias("r"), c.alias("c")).agg(F.count(F.lit(1)).cast("double").alias("v"))


def rate_bins(occ: DataFrame, spk: DataFrame, keys: Sequence[str] = UNIT, floor: float = 1e-4) -> DataFrame:
    """Rates of the bins that hold spikes; every other bin has rate 0."""
    o = occ.select(*SESSION, "r", "c", F.col("v").alias("_occ")).where(F.col("_occ") >= F.lit(floor))
    return spk.join(o, SESSION + ["r", "c"]).select(*keys, "r", "c", (F.col("v") / F.col("_occ")).alias("v"))


# ---------------------------------------------------------------- map algebra
def in_disk(rows: int, cols: int) -> Column:
    """True inside the disk inscribed in the grid."""
    dr = F.col("r") - F.lit((rows - 1) / 2.0)
    dc = F.col("c") - F.lit((cols - 1) / 2.0)
    return dr * dr + dc * dc <= F.lit((min(rows, cols) / 2.0) ** 2)


def disk_mask(maps: DataFrame, rows: int, cols: int) -> DataFrame:
    return maps.where(in_disk(rows, cols))


def downsample(maps: DataFrame, keys: Sequence[str], factor: int, how: str = "sum") -> DataFrame:
    """Block reduction; absent bins count as zeros."""
    total = F.sum("v")
    v = total if how == "sum" else total / F.lit(float(factor * factor))
    return maps.groupBy(
        *keys, F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c")
    ).agg(v.alias("v"))


def resize_nearest(maps: DataFrame, keys: Sequence[str], shape: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resize: target bin i takes source bin floor(i * old / new)."""
    out = maps
    for axis, old, size in (("r", shape[0], new[0]), ("c", shape[1], new[1])):
        lo = F.ceil(F.col(axis) * F.lit(size / old) - F.lit(1e-9))
        hi = F.ceil((F.col(axis) + 1) * F.lit(size / old) - F.lit(1e-9)) - 1
        out = out.withColumn("_to", F.explode(F.when(hi >= lo, F.sequence(lo, hi)))).withColumn(axis, F.col("_to").cast("int"))
    return out.drop("_to")


def pack(maps: DataFrame, keys: Sequence[str], cols: int) -> DataFrame:
    """One row per map: bin numbers and values in two arrays (bounded by the grid)."""
    cell = F.struct((F.col("r") * cols + F.col("c")).alias("b"), F.col("v").cast("double").alias("v"))
    return (
        maps.where(F.col("v").isNotNull())
        .groupBy(*keys)
        .agg(F.collect_list(cell).alias("_m"))
        .select(*keys, F.col("_m.b").alias("bins"), F.col("_m.v").alias("vals"))
    )


def dense(packed: DataFrame, keys: Sequence[str], rows: int, cols: int, name: str = "rate", normalise: bool = True) -> DataFrame:
    """Packed maps as dense arrays; absent bins are 0, and the largest value is 1 if ``normalise``."""
    lookup = F.map_from_arrays("bins", "vals")
    every = F.sequence(F.lit(0), F.lit(rows * cols - 1))
    top = F.array_max("vals")
    scale = F.when(top > 0, top).otherwise(F.lit(1.0)) if normalise else F.lit(1.0)
    filled = packed.withColumns({"_at": lookup, "_top": scale})
    return filled.select(*keys, F.transform(every, lambda b: F.coalesce(F.try_element_at("_at", b), F.lit(0.0)) / F.col("_top")).alias(name))


def unpack(packed: DataFrame, keys: Sequence[str], column: str, cols: int, name: str = "v") -> DataFrame:
    """Long form of a dense array column.

    The outer explode keeps the planner from deriving a "not empty" filter, which
    would evaluate the expression or kernel behind ``column`` twice.
    """
    return packed.select(*keys, F.posexplode_outer(column).alias("_b", name)).where("_b IS NOT NULL").select(
        *keys, F.floor(F.col("_b") / cols).cast("int").alias("r"), (F.col("_b") % cols).cast("int").alias("c"), name
    )


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Even out packed maps before a CPU-heavy kernel; packed rows are small, so
    the size-based coalescing would put too many of them into one task.

    Rows are dealt by a hash of their keys: dealt by the keys themselves, the planner drops
    this step wherever rows lie by their keys already, and coalesces that shuffle after all."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(*[F.col(k) for k in keys]))


def dense_quantile(total: int, p: float, vals: Column | str = "vals") -> Column:
    """Linear quantile over all bins of a non-negative map whose absent bins are 0."""
    vals = F.col(vals) if isinstance(vals, str) else vals
    pos = (total - 1) * p
    lo, w = int(np.floor(pos)), pos - np.floor(pos)
    s = F.array_sort(vals)

    def at(rank):
        k = F.lit(rank) - (F.lit(total) - F.size(s))
        return F.when(k >= 0, F.coalesce(F.get(s, k), F.lit(0.0))).otherwise(F.lit(0.0))

    return at(lo) + (at(min(lo + 1, total - 1)) - at(lo)) * F.lit(float(w))


def active_threshold(maps: DataFrame, keys: Sequence[str], rows: int, cols: int, p: float = 0.75) -> DataFrame:
    return pack(maps, keys, cols).select(*keys, dense_quantile(rows * cols, p).alias("threshold"))


def binary_bins(maps: DataFrame, keys: Sequence[str], rows: int, cols: int, p: float = 0.75) -> DataFrame:
    """Bins at or above the percentile, with their rate.

    If the percentile is 0 every bin qualifies; then the absent bins are listed too.
    """
    packed = pack(maps, keys, cols).withColumn("_t", dense_quantile(rows * cols, p))
    lookup = F.map_from_arrays("bins", "vals")
    every = F.sequence(F.lit(0), F.lit(rows * cols - 1))
    dense = F.transform(every, lambda b: F.struct(b.alias("b"), F.coalesce(F.element_at(lookup, b), F.lit(0.0)).alias("v")))
    sparse = F.arrays_zip(F.col("bins").alias("b"), F.col("vals").alias("v"))
    cells = F.when(F.col("_t") > 0, F.filter(sparse, lambda x: x["v"] >= F.col("_t"))).otherwise(dense)
    out = packed.select(*keys, F.explode_outer(cells).alias("_x")).where("_x IS NOT NULL")
    return out.select(
        *keys, F.floor(F.col("_x.b") / cols).cast("int").alias("r"), (F.col("_x.b") % cols).cast("int").alias("c"),
        F.col("_x.v").alias("v"),
    )


# ------------------------------------------------------------ per-map kernels
def map_kernel(fn: Callable[[np.ndarray], object], returns: T.DataType | str, rows: int, cols: int):
    """Arrow UDF over packed maps; ``fn`` gets one dense grid."""

    @F.pandas_udf(returns)
    def run(bins: pd.Series, vals: pd.Series) -> pd.Series:
        out = []
        for b, v in zip(bins, vals):
            m = np.zeros(rows * cols)
            m[np.asarray(b, dtype=np.int64)] = v
            out.append(fn(m.reshape(rows, cols)))
        return pd.Series(out, dtype=object)

    return run


def smoother(rows: int, cols: int, factor: float, normalise: bool = True):
    """Gaussian smoothing of packed maps as two matrix products per Arrow batch."""
    taps = gk.gaussian_taps(factor)
    left, right = gk.smoothing_matrix(rows, taps), gk.smoothing_matrix(cols, taps)

    @F.arrow_udf("array<double>")
    def run(bins: pa.Array, vals: pa.Array) -> pa.Array:
        stack = np.zeros((len(bins), rows * cols))
        stack[row_numbers(bins), end_to_end(bins).astype(int)] = end_to_end(vals)
        out = left @ stack.reshape(-1, rows, cols) @ right.T
        if normalise:
            top = out.max(axis=(1, 2), keepdims=True)
            out = np.divide(out, top, out=np.zeros_like(out), where=top > 0)
        return lists_of(out.reshape(len(bins), -1))

    return run


def smooth(maps: DataFrame, keys: Sequence[str], rows: int, cols: int, factor: float, normalise: bool = True) -> DataFrame:
    """Smoothed maps, packed as a dense ``smooth`` array per key."""
    return pack(maps, keys, cols).select(*keys, smoother(rows, cols, factor, normalise)("bins", "vals").alias("smooth"))


def smooth_rate(
    occ: DataFrame, spk: DataFrame, rows: int, cols: int, factor: float, keys: Sequence[str] = UNIT, floor: float = 1e-4
) -> DataFrame:
    """Smoothed rate map per unit (dense array ``rate``): ratio of smoothed maps over its maximum."""
    so = smooth(occ, SESSION, rows, cols, factor).withColumnRenamed("smooth", "_occ")
    ss = smooth(spk, keys, rows, cols, factor).withColumnRenamed("smooth", "_spk")
    ratio = F.zip_with("_spk", "_occ", lambda s, o: F.when(o < F.lit(floor), F.lit(0.0)).otherwise(s / o))
    out = ss.join(so, SESSION).select(*keys, ratio.alias("_rate"))
    # the maximum is a column of its own: inside the lambda it would be found anew per bin
    out = out.withColumn("_top", F.array_max("_rate"))
    scaled = F.when(F.col("_top") > 0, F.transform("_rate", lambda v: v / F.col("_top"))).otherwise(F.col("_rate"))
    return out.select(*keys, scaled.alias("rate"))


def smooth_visible(packed: DataFrame, keys: Sequence[str], column: str, rows: int, cols: int, sigma: float, circular: bool = False,
                   fill: float | str | None = "keep") -> DataFrame:
    """Gaussian smoothing of dense arrays with nulls where a map is masked (rows = 1: a line or ring).

    A masked bin gives nothing to its neighbours; weights are shared among the visible ones, and a
    bin that sees none stays null. In the result a masked bin is null again (``fill`` 'keep'),
    holds the smoothed value of its surroundings (None), or a given number."""
    left, right = gk.visible_matrix(rows, sigma, circular) if rows > 1 else np.ones((1, 1)), gk.visible_matrix(cols, sigma, circular)

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            m = np.array([np.nan if x is None else x for x in v], float).reshape(rows, cols)
            seen = ~np.isnan(m)
            weight = left @ seen.astype(float) @ right.T
            total = left @ np.where(seen, m, 0.0) @ right.T
            smooth = np.divide(total, weight, out=np.full(m.shape, np.nan), where=weight > 1e-12)
            if fill is not None:
                smooth[~seen] = np.nan if fill == "keep" else fill
            out.append([None if np.isnan(x) else float(x) for x in smooth.ravel()])
        return pd.Series(out)

    return packed.select(*keys, run(column).alias(column))


def dense_bins(cols: str) -> Column:
    """Bin numbers that go with a dense array column (for ``map_kernel``)."""
    return F.sequence(F.lit(0), F.size(cols) - 1)


# ------------------------------------------------------ kernel-density variant
def kernel_density(points: DataFrame, keys: Sequence[str], ext: Extent, rows: int, cols: int, width: float,
                   block: int = 4096) -> DataFrame:
    """Gaussian density of points on the nodes of the grid, exact: no point is rounded and no
    distance cut.

    The kernel is a product of one factor for each axis, so a block of points becomes a map by
    one matrix product; the maps of the blocks of a key add up."""
    across = ext.x_lo + np.arange(cols) * (ext.x_hi - ext.x_lo) / (cols - 1)
    down = np.arange(rows) * (ext.y_hi - ext.y_lo) / (rows - 1)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        bell = lambda d: np.exp(-d * d / (2 * width * width))
        return pd.Series([(bell((ext.y_hi - np.asarray(b))[:, None] - down).T @ bell(np.asarray(a)[:, None] - across)).ravel() for a, b in zip(x, y)])

    seen = points.where("x IS NOT NULL AND y IS NOT NULL")
    n = seen.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("_blocks"))
    dealt = attach(seen, n, keys).withColumn("_block", F.pmod(F.xxhash64("x", "y", F.monotonically_increasing_id()), F.col("_blocks")))
    packed = dealt.groupBy(*keys, "_block").agg(F.collect_list(F.struct("x", "y")).alias("_p"))
    each = unpack(packed.select(*keys, run(F.col("_p.x"), F.col("_p.y")).alias("_v")), keys, "_v", cols)
    return each.groupBy(*keys, "r", "c").agg(F.sum("v").alias("v"))


# --------------------------------------------------------------------- rasters
def trial_raster(spk_pos: DataFrame, trk: DataFrame, lap_seconds: float, lo: float, width: float,
                 settings: Settings = DEFAULT) -> DataFrame:
    """1-D spikes and dwell time per (lap, bin) with the running totals over laps."""
    lap = F.floor(F.col("t") / F.lit(float(lap_seconds))).alias("lap")
    b = F.floor((F.col("x") - F.lit(float(lo))) / F.lit(float(width))).alias("bin")
    dwell = with_step(trk, settings).groupBy(*SESSION, lap, b).agg(F.coalesce(F.sum("dt"), F.lit(0.0)).alias("dwell"))
    hits = spk_pos.groupBy(*SESSION, lap, b).agg(F.count(F.lit(1)).alias("spikes"))
    j = dwell.join(hits, SESSION + ["lap", "bin"], "full").na.fill(0, ["dwell", "spikes"])
    w = Window.partitionBy(*SESSION, "bin").orderBy("lap").rowsBetween(Window.unboundedPreceding, 0)
    return j.select(
        *SESSION, "lap", "bin", "dwell", "spikes",
        F.sum("dwell").over(w).alias("dwell_total"), F.sum("spikes").over(w).alias("spikes_total"),
    )
