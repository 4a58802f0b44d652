"""Scores of maps and trains, one row per key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikegrid.functions import grid_kernels as gk
from spikegrid.functions.arrow_lists import end_to_end, lists_of
from spikegrid.functions.expr import TWO_PI, hypot2, safe_corr, safe_div
from spikegrid.operators import maps as M
from spikegrid.operators.asof import asof_backward, asof_nearest
from spikegrid.operators.ordered import Ordered, attach
from spikegrid.operators.tracking import with_heading, with_speed
from spikegrid.settings import DEFAULT, Settings

SESSION = ["session_id"]
UNIT = ["session_id", "unit"]


def map_statistics(occ: DataFrame, rates: DataFrame, rows: int, cols: int, keys: Sequence[str] = UNIT) -> DataFrame:
    """Spatial information, sparsity, selectivity and mean rates.

    Only bins with a positive rate contribute, so the join keeps to those; the
    second pass over them needs the mean rate of the first.
    """
    total = occ.groupBy(*SESSION).agg(F.sum("v").alias("_dur"))
    o = occ.select(*SESSION, "r", "c", F.col("v").alias("_occ"))
    bins = rates.join(o, SESSION + ["r", "c"])
    bins = attach(bins, total, SESSION).withColumn("_p", safe_div("_occ", "_dur"))
    v, p = F.col("v"), F.col("_p")
    # bins of one map are bounded by the grid; carrying them in the first aggregate saves a second join
    one = bins.groupBy(*keys).agg(
        F.sum(p * v).alias("_m1"), F.sum(p * v * v).alias("_m2"), F.max(v).alias("peak_rate"),
        F.sum(v).alias("_sum"), F.collect_list(F.struct(p.alias("p"), v.alias("v"))).alias("_bins"),
    )
    m1 = F.col("_m1")
    info = F.aggregate(
        "_bins", F.lit(0.0),
        lambda s, b: s + F.when(b["v"] > m1, b["p"] * b["v"] * F.log2(b["v"] / m1)).otherwise(F.lit(0.0)),
    )
    return one.select(
        *keys, "peak_rate",
        (F.col("_sum") / F.lit(float(rows * cols))).alias("mean_rate"),
        m1.alias("weighted_rate"),
        safe_div(m1 * m1, F.col("_m2")).alias("sparsity"),
        safe_div("peak_rate", "_m1").alias("selectivity"),
        F.when(m1 != 0, info).alias("information_rate"),
        safe_div(info, m1).alias("information_content"),
    )


def coherence(rates: DataFrame, rows: int, cols: int, keys: Sequence[str] = UNIT) -> DataFrame:
    """Correlation over all bins of the rate with the mean of its eight neighbours."""
    ring = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    moves = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ring])
    own = (F.col("d.dr") == 0) & (F.col("d.dc") == 0)
    spread = (
        rates.select(*keys, "r", "c", "v", F.explode(moves).alias("d"))
        .select(
            *keys, (F.col("r") + F.col("d.dr")).alias("r"), (F.col("c") + F.col("d.dc")).alias("c"),
            F.when(own, F.col("v")).otherwise(0.0).alias("_a"),
            F.when(own, F.lit(0.0)).otherwise(F.col("v") / 8).alias("_b"),
        )
        .where(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1))
        .groupBy(*keys, "r", "c")
        .agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    )
    a, b, n = F.col("a"), F.col("b"), float(rows * cols)
    s = spread.groupBy(*keys).agg(
        F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("saa"),
        F.sum(b * b).alias("sbb"), F.sum(a * b).alias("sab"),
    )
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    return s.select(*keys, F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).otherwise(0.0).alias("coherence"))


def border_score(rates: DataFrame, rows: int, cols: int, keys: Sequence[str] = UNIT, p: float = 0.75,
                 lengths_as_published: bool = True) -> DataFrame:
    """Score per wall from the active bins; ``lengths_as_published`` measures the
    bottom distance with the column count and the right one with the row count."""
    act = M.binary_bins(rates, keys, rows, cols, p)
    half = min(rows, cols) / 2
    r, c, v = F.col("r"), F.col("c"), F.col("v")
    down, across = (cols, rows) if lengths_as_published else (rows, cols)
    far = {"top": r * v, "bottom": (F.lit(down) - r) * v, "left": c * v, "right": (F.lit(across) - c) * v}
    wall = {"top": (r == 0, cols), "bottom": (r == rows - 1, cols), "left": (c == 0, rows), "right": (c == cols - 1, rows)}
    agg = act.groupBy(*keys).agg(
        *[(F.sum(F.when(cond, 1.0).otherwise(0.0)) / F.lit(float(n))).alias(f"_c_{k}") for k, (cond, n) in wall.items()],
        *[(F.avg(e) / F.lit(half)).alias(f"_d_{k}") for k, e in far.items()],
    )
    return agg.select(
        *keys,
        *[safe_div(F.col(f"_c_{k}") - F.col(f"_d_{k}"), F.col(f"_c_{k}") + F.col(f"_d_{k}")).alias(f"border_{k}") for k in wall],
    )


# ----------------------------------------------------------------- direction
def spike_headings(trk: DataFrame, spk: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Heading of each spike: that of the nearest tracking sample."""
    return asof_nearest(spk, with_heading(trk, settings), SESSION, "t", ["heading"], "i", settings)


def _angle_bin(n: int) -> Column:
    return F.least(F.floor(F.col("heading") / F.lit(TWO_PI / n)), F.lit(n - 1)).cast("int")


def heading_histogram(angles: DataFrame, keys: Sequence[str] = UNIT, n: int = 360, window: int = 23) -> DataFrame:
    """Circular rolling sum of the heading histogram (bins with a value only)."""
    half = window // 2
    raw = angles.groupBy(*keys, _angle_bin(n).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    to = F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda k: F.pmod(F.col("bin") + k, F.lit(n)))
    return raw.select(*keys, F.explode(to).alias("bin"), "n").groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def mean_vector_length(hist: DataFrame, keys: Sequence[str] = UNIT) -> DataFrame:
    """Resultant length of a 360-bin histogram with bin angles -179..180 degrees."""
    a = F.radians(F.col("bin") - F.lit(179.0))
    n = F.sum("n")
    return hist.groupBy(*keys).agg(
        hypot2(F.sum(F.col("n") * F.cos(a)) / n, F.sum(F.col("n") * F.sin(a)) / n).alias("vector_length")
    )


def angular_occupancy(heads: DataFrame, n: int = 36) -> DataFrame:
    """Seconds per direction: samples times the mean frame duration."""
    per = heads.groupBy(*SESSION).agg(
        safe_div(F.max("t") - F.min("t"), F.count(F.lit(1)) - 1).alias("_frame")
    )
    hist = heads.groupBy(*SESSION, _angle_bin(n).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return attach(hist, per, SESSION).select(*SESSION, "bin", (F.col("n") * F.col("_frame")).alias("seconds"))


def tuning_curve(trk: DataFrame, spk: DataFrame, n: int = 36, settings: Settings = DEFAULT) -> DataFrame:
    """Spikes per second of each visited direction."""
    occ = angular_occupancy(with_heading(trk, settings), n)
    ang = spike_headings(trk, spk, settings).groupBy(*UNIT, _angle_bin(n).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return ang.join(occ, SESSION + ["bin"]).select(*UNIT, "bin", "n", safe_div("n", "seconds").alias("rate"))


def smooth_tuning(curve: DataFrame, width: int, n: int = 36, keys: Sequence[str] = UNIT) -> DataFrame:
    """Circular moving mean of a tuning curve (absent bins are 0)."""
    half = width // 2
    to = F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda k: F.pmod(F.col("bin") + k, F.lit(n)))
    return curve.select(*keys, F.explode(to).alias("bin"), "rate").groupBy(*keys, "bin").agg(
        (F.sum("rate") / F.lit(float(2 * half + 1))).alias("rate")
    )


# --------------------------------------------------------------------- speed
def frame_rates(trk: DataFrame, spk: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Spike rate of each tracking frame [t_i, t_i+1), per unit, for all frames of the session.

    The last frame lasts one mean frame and is closed at its end.
    """
    per = trk.groupBy(*SESSION).agg(
        safe_div(F.count(F.lit(1)) - 1, F.max("t") - F.min("t")).alias("fs"), F.max("t").alias("_tmax")
    )
    hit = asof_backward(spk, trk.select(*SESSION, "t", "i"), SESSION, "t", [], "i", settings, keep_unmatched=False)
    hit = attach(hit, per, SESSION).where(F.col("t") <= F.col("_tmax") + 1 / F.col("fs"))
    counts = hit.groupBy(*UNIT, F.col("t_match").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    units = spk.select(*UNIT).distinct()
    grid = attach(trk, per.drop("_tmax"), SESSION).join(units, SESSION)
    return grid.join(counts, UNIT + ["t"], "left").withColumn("rate", F.coalesce("n", F.lit(0)) * F.col("fs")).drop("n")


def gaussian_series(df: DataFrame, keys: Sequence[str], columns: Sequence[str], sigma: float,
                    settings: Settings = DEFAULT) -> DataFrame:
    """Gaussian smoothing along the row order with mirrored ends (support 4 sigma each side).

    The weights are fixed taps over lag/lead, so a chunk only needs that many
    rows of its neighbours.
    """
    half = max(1, int(np.ceil(4 * sigma)))
    taps = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    taps = taps / taps.sum()
    o = Ordered(df, keys, ["t", "i"], settings)

    def build(w):
        out = {}
        full = w.rowsBetween(-half, half)
        for c in columns:
            around = F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).over(full)
            before = F.count(F.lit(1)).over(w.rowsBetween(-half, -1))
            out[f"_w_{c}"] = F.struct(around.alias("a"), before.alias("b"))
        return out

    o = o.near(half, half, build)
    exprs = {}
    for c in columns:
        a, b = F.col(f"_w_{c}.a"), F.col(f"_w_{c}.b").cast("int")
        n = F.size(a)
        terms = F.transform(
            F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(g)).alias("g")) for k, g in zip(range(-half, half + 1), taps)]),
            lambda t: t["g"] * F.get(a, _mirror_index(b + t["k"], n)),
        )
        exprs[f"{c}_smooth"] = F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)
    return o.columns(exprs).df.drop(*[f"_w_{c}" for c in columns])


def _mirror_index(i: Column, n: Column) -> Column:
    """Symmetric border (the edge value is repeated) on an array of length n."""
    j = F.pmod(i, 2 * n)
    return F.when(j < n, j).otherwise(2 * n - 1 - j)


def speed_score(trk: DataFrame, spk: DataFrame, sigma_frames: float, low: float | None = None, high: float | None = None,
                settings: Settings = DEFAULT) -> DataFrame:
    """Correlation of smoothed speed with smoothed rate, in both published orders.

    ``score_2016`` smooths the rate and then filters; ``score_2015`` filters first.
    """
    frames = frame_rates(with_speed(trk, settings), spk, settings)
    sm = gaussian_series(frames, UNIT, ["speed", "rate"], sigma_frames, settings)
    if low is not None:
        sm = sm.where(F.col("speed_smooth").between(low, high))
    a = sm.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"), safe_corr("speed_smooth", "rate_smooth").alias("score_2016"))
    late = sm.withColumnRenamed("rate_smooth", "_r16")
    late = gaussian_series(late, UNIT, ["rate"], sigma_frames, settings)
    b = late.groupBy(*UNIT).agg(safe_corr("speed_smooth", "rate_smooth").alias("score_2015"))
    return a.join(b, UNIT)


# ---------------------------------------------------------------------- grid
GRID_TYPE = "struct<score:double,spacing:double,orientation:double,orientation_std:double,aspect:double,tilt:double>"


def grid_score(packed: DataFrame, keys: Sequence[str], column: str, rows: int, cols: int) -> DataFrame:
    """Grid score and grid geometry of packed dense rate maps."""
    @F.arrow_udf(GRID_TYPE)
    def run(rate: pa.Array) -> pa.Array:
        found = [g or {} for m in gk.parts(end_to_end(rate).reshape(-1, rows, cols)) for g in gk.grid_measures(m)]
        names = ["score", "spacing", "orientation", "orientation_std", "aspect", "tilt"]
        return pa.StructArray.from_arrays([pa.array([g.get(n) for g in found], pa.float64()) for n in names], names)

    g = M.spread(packed, keys).select(*keys, run.asNondeterministic()(column).alias("_g"))
    clean = lambda f, n: F.when(~F.isnan(f"_g.{f}"), F.col(f"_g.{f}")).alias(n)
    return g.select(
        *keys, clean("score", "grid_score"), clean("spacing", "grid_spacing"), clean("orientation", "grid_orientation"),
        clean("orientation_std", "grid_orientation_std"), clean("aspect", "grid_aspect"), clean("tilt", "grid_tilt"),
    )


def autocorrelation(packed: DataFrame, keys: Sequence[str], column: str, rows: int, cols: int) -> DataFrame:
    """Autocorrelogram of packed dense maps in long form (r, c, v)."""
    probe = gk.autocorrelogram(np.arange(rows * cols, dtype=float).reshape(rows, cols))

    @F.arrow_udf("array<double>")
    def run(rate: pa.Array) -> pa.Array:
        found = [gk.autocorrelogram(m) for m in gk.parts(end_to_end(rate).reshape(-1, rows, cols))]
        return lists_of(np.concatenate([*found, np.zeros((0, *probe.shape))]).reshape(-1, probe.size))

    return M.unpack(M.spread(packed, keys).select(*keys, run(column).alias("_ac")), keys, "_ac", probe.shape[1])
