"""Distances between maps, trains and units."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spikegrid.functions.arrow_lists import end_to_end, row_numbers
from spikegrid.functions.expr import hypot2, safe_div
from spikegrid.operators.maps import spread
from spikegrid.operators.ordered import Ordered, attach
from spikegrid.settings import DEFAULT, Settings


# --------------------------------------------------------------- projections
def lattice_projections(n: int) -> list[tuple[float, float]]:
    """Evenly spread directions of the half circle."""
    return [(math.cos(math.pi * k / n), math.sin(math.pi * k / n)) for k in range(n)]


def random_projections(n: int, seed: int = 0) -> list[tuple[float, float]]:
    """Seeded random unit directions."""
    v = np.random.default_rng(seed).normal(size=(n, 2))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [tuple(map(float, row)) for row in v]


# --------------------------------------------------------------- Wasserstein
def quantile_distance(points: DataFrame, keys: Sequence[str], p: int = 2, settings: Settings = DEFAULT) -> DataFrame:
    """1-D Wasserstein distance W_p^p between the sides of each key.

    ``points``: keys, side ('a' or 'b'), x, w.  The inverse distribution functions
    are merged by carrying the next value of either side backwards over the
    cumulative weight; groups may be of any size.
    """
    flat = points.groupBy(*keys, "side", "x").agg(F.sum("w").alias("w")).where("w > 0")
    total = flat.groupBy(*keys, "side").agg(F.sum("w").alias("_total"))
    cum = Ordered(flat, [*keys, "side"], ["x"], settings).running({"_cum": F.col("w")}).df
    q = attach(cum, total, [*keys, "side"]).select(*keys, "side", "x", (F.col("_cum") / F.col("_total")).alias("q"))
    o = Ordered(q, keys, ["q", "side", "x"], settings)
    o = o.near(1, 0, lambda w: {"_dq": F.col("q") - F.coalesce(F.lag("q").over(w), F.lit(0.0))})
    o = o.fill(first={"_a": F.when(F.col("side") == "a", F.col("x")), "_b": F.when(F.col("side") == "b", F.col("x"))})
    gap = F.abs(F.col("_a") - F.col("_b"))
    cost = gap if p == 1 else F.pow(gap, F.lit(p))
    return o.df.groupBy(*keys).agg(F.coalesce(F.sum(F.col("_dq") * cost), F.lit(0.0)).alias("wpp"))


def sliced_distance(points: DataFrame, keys: Sequence[str], directions, p: int = 2, settings: Settings = DEFAULT) -> DataFrame:
    """Sliced Wasserstein distance between weighted point clouds of any size.

    ``points``: keys, side, x, y, w.  If the chunk plan of the base table has no hot key, the
    clouds of a key are one packed row and all directions are compared in its task; otherwise
    the projections are long tables.
    """
    plan = settings.chunks
    if plan is not None and plan.cuts is None and set(plan.keys) <= set(keys):
        return _packed_sliced(points, list(keys), np.array(directions), p)
    dirs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(ux).alias("ux"), F.lit(uy).alias("uy")) for k, (ux, uy) in enumerate(directions)])
    flat = points.groupBy(*keys, "side", "x", "y").agg(F.sum("w").alias("w"))
    proj = flat.withColumn("_d", F.explode(dirs)).select(
        *keys, F.col("_d.k").alias("_k"), "side", (F.col("x") * F.col("_d.ux") + F.col("y") * F.col("_d.uy")).alias("x"), "w"
    )
    each = quantile_distance(proj, [*keys, "_k"], p, settings)
    return each.groupBy(*keys).agg(F.pow(F.avg("wpp"), F.lit(1.0 / p)).alias("distance"))


def _packed_sliced(points: DataFrame, keys: list[str], u: np.ndarray, p: int) -> DataFrame:
    """Both clouds of a key in one row; a key with one side only has distance 0, as in the long form."""

    @F.arrow_udf("double")
    def run(cloud_x: pa.Array, cloud_y: pa.Array, weight: pa.Array, side: pa.Array) -> pa.Array:
        no, x, y, w, s = row_numbers(side), *(end_to_end(c) for c in (cloud_x, cloud_y, weight, side))
        clouds = [(np.bincount(no[k], minlength=len(side)), x[k], y[k], w[k]) for k in (s > 0, s == 0)]
        both = (clouds[0][0] > 0) & (clouds[1][0] > 0)
        d = np.where(both, _sliced_rows(*clouds, u, p), 0.0)
        return pa.array(d, mask=np.isnan(d))

    c = points.where("w > 0").groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "w", (F.col("side") == "a").alias("a"))).alias("_p"))
    d = run.asNondeterministic()(F.col("_p.x"), F.col("_p.y"), F.col("_p.w"), F.col("_p.a"))
    return spread(c, keys).select(*keys, d.alias("distance"))


ROWS_AT_ONCE, VALUES_AT_ONCE = 128, 1 << 16     # rows compared together, and (row, direction, point) held at once


def _sliced_rows(a: tuple, b: tuple, u: np.ndarray, p: int) -> np.ndarray:
    """Sliced distance of the two weighted clouds of each row, NaN where a side has no point.

    A side is (points per row, x, y, w) with the points of all rows end to end. Rows of about
    one size are compared together; shorter clouds repeat their first point with weight 0."""
    (na, *flat_a), (nb, *flat_b) = a, b
    out, size = np.full(len(na), np.nan), na + nb
    first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb

    def padded(flat, n, first, rows):
        k = np.arange(n[rows].max())
        real = k < n[rows][:, None]
        at = first[rows][:, None] + np.where(real, k, 0)
        return flat[0][at], flat[1][at], np.where(real, flat[2][at], 0.0)

    def even(w, n, first):
        """Rows in which all points weigh the same."""
        no = np.repeat(np.arange(len(n)), n)
        return np.bincount(no[w != w[first[no]]], minlength=len(n)) == 0

    flat = even(flat_a[2], na, first_a) & even(flat_b[2], nb, first_b)
    for kind, cost_of in ((flat, _sliced_even), (~flat, _sliced)):
        order, at = np.lexsort((na, size)), 0
        order = order[((na > 0) & (nb > 0) & kind)[order]]
        while at < len(order):
            n = min(ROWS_AT_ONCE, len(order) - at)
            while n > 1 and n * len(u) * size[order[at + n - 1]] > VALUES_AT_ONCE:
                n //= 2
            rows = order[at:at + n]
            clouds = [*padded(flat_a, na, first_a, rows), *padded(flat_b, nb, first_b, rows)]
            step = max(1, (1 << 22) // (n * int(size[rows].max())))        # directions at once
            out[rows] = (sum(cost_of(*clouds, u[k:k + step], p) for k in range(0, len(u), step)) / len(u)) ** (1 / p)
            at += n
    return out


def _along(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values of the last axis at the given places, as one flat look-up."""
    first = np.arange(0, v.size, v.shape[-1]).reshape(*v.shape[:-1], 1)
    return v.reshape(-1)[at + first]


def _project(x: np.ndarray, y: np.ndarray, u: np.ndarray) -> np.ndarray:
    return u[:, :1] * x[:, None, :] + u[:, 1:] * y[:, None, :]


def _merged(qa: np.ndarray, qb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps of two merged distributions, and the next value of either side at each."""
    q = np.concatenate([qa, qb], axis=-1)
    order = np.argsort(q, axis=-1, kind="stable")         # two rising runs
    from_a = order < qa.shape[-1]
    seen = np.cumsum(from_a, axis=-1)
    before_b = np.arange(q.shape[-1]) - (seen - from_a)
    return np.diff(_along(q, order), axis=-1, prepend=0.0), seen - from_a, before_b


def _sliced(ax, ay, aw, bx, by, bw, u: np.ndarray, p: int) -> np.ndarray:
    """Transport cost of two clouds in each row, summed over all directions."""
    def sides(v, w):
        order = np.argsort(v, axis=2)
        held = w.reshape(-1)[order + np.arange(0, w.size, w.shape[1])[:, None, None]]
        return _along(v, order), np.cumsum(held, axis=2) / w.sum(axis=1)[:, None, None]

    (a, qa), (b, qb) = sides(_project(ax, ay, u), aw), sides(_project(bx, by, u), bw)
    step, na, nb = _merged(qa, qb)
    gap = np.abs(_along(a, np.minimum(na, a.shape[2] - 1)) - _along(b, np.minimum(nb, b.shape[2] - 1)))
    return (step * gap ** p).sum(axis=(1, 2))


def _sliced_even(ax, ay, aw, bx, by, bw, u: np.ndarray, p: int) -> np.ndarray:
    """As :func:`_sliced` where all points of a cloud weigh the same: the steps do not depend on the direction."""
    def sides(x, y, w):
        n = (w > 0).sum(axis=1, keepdims=True)
        v = np.sort(np.where((w > 0)[:, None, :], _project(x, y, u), np.inf), axis=2)
        return v, n, np.minimum(np.arange(1, w.shape[1] + 1) / n, 1.0)

    (a, na, qa), (b, nb, qb) = sides(ax, ay, aw), sides(bx, by, bw)
    step, at_a, at_b = _merged(qa, qb)
    gap = np.abs(_along(a, np.minimum(at_a, na - 1)[:, None, :]) - _along(b, np.minimum(at_b, nb - 1)[:, None, :]))
    return (step[:, None, :] * gap ** p).sum(axis=(1, 2))


def map_distance(pairs: DataFrame, keep: Sequence[str], rows: int, cols: int, height: float, width: float, directions,
                 p: int = 2, weighted: bool = True, name: str = "distance") -> DataFrame:
    """Sliced distance between two packed maps per row (``bins_a, vals_a, bins_b, vals_b``).

    A map has at most rows x cols bins, so one row is a bounded piece of work.
    """
    u = np.array(directions)
    ys = (np.arange(rows) + 0.5) * height / rows
    xs = (np.arange(cols) + 0.5) * width / cols

    @F.arrow_udf("double")
    def run(ba: pa.Array, va: pa.Array, bb: pa.Array, vb: pa.Array) -> pa.Array:
        clouds, given = [], np.ones(len(ba), bool)
        for bins, vals in ((ba, va), (bb, vb)):
            no, i, v = row_numbers(bins), end_to_end(bins).astype(int), end_to_end(vals)
            if not weighted:
                v = np.ones_like(v)
            given &= ~(np.bincount(no, v, len(bins)) <= 0)
            no, i, v = no[v > 0], i[v > 0], v[v > 0]
            clouds.append((np.bincount(no, minlength=len(bins)), xs[i % cols], ys[i // cols], v))
        d = _sliced_rows(*clouds, u, p)
        return pa.array(d, mask=~given | np.isnan(d))

    # not repeatable to the planner, or a filter on the result runs the kernel a second time
    run = run.asNondeterministic()
    d = run("bins_a", "vals_a", "bins_b", "vals_b")
    return spread(pairs, [c for c in keep if not c.startswith(("bins", "vals"))]).select(*keep, d.alias(name))


# -------------------------------------------------------------- spike trains
def temporal_distance(points: DataFrame, keys: Sequence[str], bin_size: float, settings: Settings = DEFAULT) -> DataFrame:
    """Temporal earth-mover distance between the sides of each key: the sum over shared
    time bins of |CDF_a - CDF_b|.

    ``points``: keys, side ('a' or 'b'), t.  Bins start at the earliest spike; the
    difference of the distributions only changes in occupied bins, so the empty
    bins between two of them are counted, not listed.
    """
    n = lambda s: F.sum(F.when(F.col("side") == s, 1).otherwise(0))
    per = points.groupBy(*keys).agg(n("a").alias("_na"), n("b").alias("_nb"), F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    width = F.lit(float(bin_size))
    last = F.greatest(F.ceil((F.col("_hi") - F.col("_lo")) / width), F.lit(1)) - 1
    b = F.least(F.floor((F.col("t") - F.col("_lo")) / width), last)
    m = F.when(F.col("side") == "a", F.lit(1.0) / F.col("_na")).otherwise(F.lit(-1.0) / F.col("_nb"))
    mass = attach(points, per.where("_na > 0 AND _nb > 0"), keys).groupBy(*keys, b.alias("bin")).agg(F.sum(m).alias("m"))
    o = Ordered(mass, keys, ["bin"], settings).running({"_c": F.col("m")}).lag_lead({"_next": ("bin", 1)})
    return o.df.groupBy(*keys).agg(
        F.coalesce(F.sum(F.abs("_c") * (F.col("_next") - F.col("bin"))), F.lit(0.0)).alias("emd"))


# ------------------------------------------------------------- single points
def point_distance(maps: DataFrame, keys: Sequence[str], rows: int, cols: int, height: float, width: float,
                   object_row: float, object_col: float) -> DataFrame:
    """Weighted mean distance of the bins to an object bin."""
    dy = (F.col("r") - F.lit(float(object_row))) * F.lit(height / rows)
    dx = (F.col("c") - F.lit(float(object_col))) * F.lit(width / cols)
    return maps.groupBy(*keys).agg(safe_div(F.sum(F.col("v") * hypot2(dx, dy)), F.sum("v")).alias("distance"))


def spike_point_distance(pos: DataFrame, keys: Sequence[str], x: float, y: float) -> DataFrame:
    """Mean distance of the spikes to an object."""
    return pos.groupBy(*keys).agg(F.avg(hypot2(F.col("x") - F.lit(float(x)), F.col("y") - F.lit(float(y)))).alias("distance"))


def object_vector(maps: DataFrame, keys: Sequence[str], rows: int, cols: int, height: float, width: float,
                  object_row: float, object_col: float) -> DataFrame:
    """Length and signed angle (degrees) from the object to the peak bin of a map."""
    sy, sx = height / rows, width / cols
    top = maps.groupBy(*keys).agg(F.max_by(F.struct("r", "c"), F.struct("v", -F.col("r"), -F.col("c"))).alias("_p"))
    py, px = (F.col("_p.r") + 0.5) * F.lit(sy), (F.col("_p.c") + 0.5) * F.lit(sx)
    oy, ox = F.lit((object_row + 0.5) * sy), F.lit((object_col + 0.5) * sx)
    det, dot = oy * px - ox * py, oy * py + ox * px
    return top.select(*keys, hypot2(px - ox, py - oy).alias("magnitude"), F.degrees(F.atan2(det, dot)).alias("angle"))


# -------------------------------------------------------------------- fields
def field_pairs(fields_a: DataFrame, fields_b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every field of the first map with every field of the second map of one cell.

    Inputs hold one packed row per field: keys, field_id, bins, vals, centroid_r, centroid_c.
    """
    cols = ["field_id", "bins", "vals", "centroid_r", "centroid_c"]
    a = fields_a.select(*keys, *[F.col(c).alias(c + "_a") for c in cols])
    b = fields_b.select(*keys, *[F.col(c).alias(c + "_b") for c in cols])
    j = a.join(b, list(keys))
    return j.withColumn("centroid_distance", hypot2(F.col("centroid_r_a") - F.col("centroid_r_b"), F.col("centroid_c_a") - F.col("centroid_c_b")))


def pack_fields(bins: DataFrame, keys: Sequence[str], cols: int) -> DataFrame:
    g = bins.groupBy(*keys, "field_id").agg(
        F.collect_list(F.struct((F.col("r") * cols + F.col("c")).alias("b"), F.col("rate").alias("v"))).alias("_m"),
        F.avg("r").alias("centroid_r"), F.avg("c").alias("centroid_c"),
    )
    return g.select(*keys, "field_id", F.col("_m.b").alias("bins"), F.col("_m.v").alias("vals"), "centroid_r", "centroid_c")


def field_sets(bins: DataFrame, keys: Sequence[str], cols: int) -> DataFrame:
    """All fields of a map as one weighted set: (keys, fields, bins, vals, centroid_r, centroid_c).

    The centroid is the mean of the centroids of the fields, each counted once."""
    per = bins.groupBy(*keys, "field_id").agg(
        F.collect_list(F.struct((F.col("r") * cols + F.col("c")).alias("b"), F.col("rate").alias("v"))).alias("_m"),
        F.avg("r").alias("_r"), F.avg("c").alias("_c"))
    g = per.groupBy(*keys).agg(F.flatten(F.collect_list("_m")).alias("_m"), F.count(F.lit(1)).alias("fields"),
                               F.avg("_r").alias("centroid_r"), F.avg("_c").alias("centroid_c"))
    return g.select(*keys, "fields", F.col("_m.b").alias("bins"), F.col("_m.v").alias("vals"), "centroid_r", "centroid_c")


def field_set_distance(sets_a: DataFrame, sets_b: DataFrame, keys: Sequence[str], rows: int, cols: int, height: float, width: float,
                       directions, p: int = 2) -> DataFrame:
    """Distances between the fields of two maps taken together: weighted and unweighted sliced
    transport of their bins, and the distance of their centroids in bins.

    Each side holds one row per key; keys that lack fields on one side are left out."""
    columns = ["fields", "bins", "vals", "centroid_r", "centroid_c"]
    side = lambda d, s: d.select(*keys, *[F.col(c).alias(c + s) for c in columns])
    both = side(sets_a, "_a").join(side(sets_b, "_b"), list(keys))
    apart = hypot2(F.col("centroid_r_a") - F.col("centroid_r_b"), F.col("centroid_c_a") - F.col("centroid_c_b"))
    both = both.withColumn("centroid_distance", apart)
    keep = [*keys, "fields_a", "fields_b", "centroid_distance"]
    sets = ["bins_a", "vals_a", "bins_b", "vals_b"]
    w = map_distance(both, [*keep, *sets], rows, cols, height, width, directions, p, name="field_wass")
    return map_distance(w, [*keep, "field_wass"], rows, cols, height, width, directions, p, weighted=False, name="binary_wass")


# ---------------------------------------------------------------------- maps
def spearman(pairs: DataFrame, keys: Sequence[str], a: str, b: str, settings: Settings = DEFAULT) -> DataFrame:
    """Rank correlation of two columns per key, ties by mean rank."""
    from spikegrid.functions.expr import safe_corr
    from spikegrid.operators.ordered import average_ranks

    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("_w"))
    ra = average_ranks(pairs.where(F.col(b).isNotNull()), keys, a, settings).select(*keys, a, F.col("rank").alias("_ra"))
    rb = average_ranks(pairs.where(F.col(a).isNotNull()), keys, b, settings).select(*keys, b, F.col("rank").alias("_rb"))
    r = both.join(ra, [*keys, a]).join(rb, [*keys, b])
    # moments weighted by how often a value pair occurs
    w, x, y = F.col("_w"), F.col("_ra"), F.col("_rb")
    m = r.groupBy(*keys).agg(
        F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"),
        F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"),
    )
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    return m.select(*keys, "n", F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("rho"))


def _rank_correlation(a: np.ndarray, b: np.ndarray, zeros: int) -> float | None:
    """Correlation of the mean ranks of two columns that go on with ``zeros`` rows of zeros."""
    w = np.append(np.ones(len(a)), zeros)

    def rank(v):
        _, at = np.unique(np.append(v, 0.0), return_inverse=True)
        n = np.bincount(at, w)
        return (np.cumsum(n) - (n - 1) / 2)[at]

    x, y = rank(a), rank(b)
    x, y = x - w @ x / w.sum(), y - w @ y / w.sum()
    spread = math.sqrt((w @ (x * x)) * (w @ (y * y)))
    return float(w @ (x * y)) / spread if spread > 0 else None


def map_spearman(cells: DataFrame, keys: Sequence[str], a: str, b: str, zeros: Column | None = None) -> DataFrame:
    """Rank correlation over the bins of two maps; a key has at most rows x cols rows.

    Bins that hold 0 on both sides need no row: ``zeros`` is the aggregate that says how many
    of them a key has besides its rows.  A null ranks below all values."""

    @F.pandas_udf("double")
    def run(first: pd.Series, second: pd.Series, more: pd.Series) -> pd.Series:
        low = lambda v: np.nan_to_num(np.asarray(v, float), nan=-np.inf)
        return pd.Series([_rank_correlation(low(x), low(y), n) for x, y, n in zip(first, second, more)], dtype=float)

    both = F.struct(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    packed = cells.groupBy(*keys).agg(F.collect_list(both).alias("_p"), (F.lit(0) if zeros is None else zeros).cast("long").alias("_z"))
    return packed.select(*keys, run(F.col("_p.a"), F.col("_p.b"), F.col("_z")).alias("rho"))


def map_moments(maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mass, centroid and covariance of a map taken as a distribution."""
    v = F.col("v")
    m = maps.groupBy(*keys).agg(
        F.sum(v).alias("mass"), F.sum(v * F.col("r")).alias("_r"), F.sum(v * F.col("c")).alias("_c"),
        F.sum(v * F.col("r") * F.col("r")).alias("_rr"), F.sum(v * F.col("c") * F.col("c")).alias("_cc"),
        F.sum(v * F.col("r") * F.col("c")).alias("_rc"),
    )
    r, c = F.col("_r") / F.col("mass"), F.col("_c") / F.col("mass")
    return m.where("mass > 0").select(
        *keys, "mass", r.alias("centroid_r"), c.alias("centroid_c"),
        (F.col("_rr") / F.col("mass") - r * r).alias("var_r"),
        (F.col("_cc") / F.col("mass") - c * c).alias("var_c"),
        (F.col("_rc") / F.col("mass") - r * c).alias("cov_rc"),
    )
