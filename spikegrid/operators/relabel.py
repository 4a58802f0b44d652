"""Null distribution of the temporal distance between two trains by relabelled spikes.

An iteration deals the labels of both trains anew to the pooled spikes, in the original
numbers. It takes the spikes with the smallest hashes of (spike, iteration), so that any
engine can repeat it. All iterations ride on one running sum over the sorted spikes. A pool
that is hot is cut into time-ordered chunks: how many labels each chunk gets is drawn without
replacement per iteration, the chunk then takes its smallest hashes, which together is again
a draw of the exact number.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikegrid.operators.maps import spread
from spikegrid.operators.ordered import Ordered, attach
from spikegrid.settings import DEFAULT, Settings

CELLS = 1 << 22         # (spike, iteration) pairs held at once

# fixed values of the hash; queries repeat them in SQL
SPIKE, ITERATION, MIX = 2654435761, 340573321, 73244475


def hash32(i: np.ndarray, k: np.ndarray, seed: int) -> np.ndarray:
    """32-bit hash of each (spike, iteration)."""
    low = np.uint64(0xFFFFFFFF)
    x = ((i.astype(np.uint64) & low)[:, None] * np.uint64(SPIKE) + (k.astype(np.uint64) + np.uint64(1))[None, :] * np.uint64(ITERATION) + np.uint64(seed)) & low
    for _ in range(2):
        x = (((x >> np.uint64(16)) ^ x) * np.uint64(MIX)) & low
    return (x >> np.uint64(16)) ^ x


def _chosen(i: np.ndarray, take: np.ndarray, k: np.ndarray, seed: int) -> np.ndarray:
    """(spike, iteration): whether the spike is among the ``take[k]`` smallest hashes of the iteration."""
    place = np.argsort(np.argsort(i, kind="stable"), kind="stable").astype(np.uint64)
    key = (hash32(i, k, seed) << np.uint64(31)) | place[:, None]         # equal hashes go by spike number
    want = take[k]
    last = np.sort(key, axis=0)[np.maximum(want - 1, 0), np.arange(len(k))]
    return (key <= last[None, :]) & (want > 0)[None, :]


def _distances(i: np.ndarray, is_a: np.ndarray, bins: np.ndarray, follows: int, na: int, nb: int, before: int, before_a: np.ndarray,
               own_before: int, take: np.ndarray, seed: int) -> np.ndarray:
    """The part of this chunk in the distance of the given labels (first) and of each iteration."""
    gap = np.diff(bins, append=follows).astype(float)
    done = before + np.arange(1, len(i) + 1)

    def cost(labels_a: np.ndarray) -> np.ndarray:
        return np.abs(labels_a / na - (done[:, None] - labels_a) / nb).T @ gap

    out = [cost((own_before + np.cumsum(is_a))[:, None])]
    step = max(1, CELLS // max(1, len(i)))
    for at in range(0, len(take), step):
        k = np.arange(at, min(at + step, len(take)))
        out.append(cost(before_a[k][None, :] + np.cumsum(_chosen(i, take, k, seed), axis=0)))
    return np.concatenate(out)


def relabelled_distances(points: DataFrame, keys: Sequence[str], bin_size: float, iterations: int, seed: int = 0,
                         settings: Settings = DEFAULT) -> DataFrame:
    """(keys, observed, nulls): the temporal distance of both sides, and that of each relabelling.

    ``points``: keys, i, side ('a' or 'b'), t.  A key with one side only is left out."""
    keys = list(keys)
    n = lambda s: F.count_if(F.col("side") == s)
    per = points.groupBy(*keys).agg(n("a").alias("_na"), n("b").alias("_nb"), F.min("t").alias("_lo"), F.max("t").alias("_hi")).where("_na > 0 AND _nb > 0")
    width = F.lit(float(bin_size))
    last = F.greatest(F.ceil((F.col("_hi") - F.col("_lo")) / width), F.lit(1)) - 1
    o = Ordered(attach(points.select(*keys, "i", "side", "t"), per, keys), keys, ["t", "i"], settings)
    o = o.columns({"_bin": F.least(F.floor((F.col("t") - F.col("_lo")) / width), last).cast("long"), "_is_a": F.col("side") == "a"})
    rows = o._df.select(*o.group, "i", "t", "_bin", "_is_a", "_na", "_nb")
    kinds, group = dict(rows.dtypes), o.group
    if o.chunked:
        def dealt(part: pa.Table) -> pa.Table:
            part = part.sort_by("_first")
            size, own, first = (part[c].to_numpy() for c in ("_n", "_own", "_bin0"))
            na, total = int(part["_na"][0].as_py()), int(size.sum())
            rng = np.random.default_rng([seed, na, total])
            left, takes = np.full(iterations, na), []
            for k, c in enumerate(size):
                rest = total - int(size[:k].sum()) - int(c)
                takes.append(rng.hypergeometric(np.full(iterations, c), np.full(iterations, rest), left) if rest else left)
                left = left - takes[-1]
            before_a = np.concatenate([np.zeros((1, iterations), int), np.cumsum(takes, axis=0)[:-1]])
            lists = lambda m: pa.array([[int(x) for x in v] for v in m], pa.list_(pa.int64()))
            return pa.table({**{c: part[c] for c in group}, "_before": pa.array(np.cumsum(size) - size), "_own_before": pa.array(np.cumsum(own) - own),
                             "_follows": pa.array(np.append(first[1:], -1)), "_take": lists(takes), "_before_a": lists(before_a)})

        chunk = rows.groupBy(*o.group).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_is_a").alias("_own"), F.min("t").alias("_first"),
                                           F.min("_bin").alias("_bin0"), F.first("_na").alias("_na"))
        head = ", ".join(f"{c} {kinds[c]}" for c in o.group)
        plan = chunk.groupBy(*keys).applyInArrow(dealt, f"{head}, _before long, _own_before long, _follows long, _take array<long>, _before_a array<long>")
        packed = rows.groupBy(*o.group).agg(F.sort_array(F.collect_list(F.struct("t", "i", "_bin", "_is_a"))).alias("_s"), F.first("_na").alias("_na"), F.first("_nb").alias("_nb"))
        packed = packed.join(plan, o.group)
    else:
        packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "i", "_bin", "_is_a"))).alias("_s"), F.first("_na").alias("_na"), F.first("_nb").alias("_nb"))
        none = F.lit(None).cast("array<long>")
        packed = packed.withColumns({"_before": F.lit(0).cast("long"), "_own_before": F.lit(0).cast("long"), "_follows": F.lit(-1).cast("long"), "_take": none, "_before_a": none})

    def run(batches):
        for batch in batches:
            names, found = batch.schema.names, []
            col = {c: batch.column(names.index(c)) for c in names}
            for k in range(batch.num_rows):
                s = col["_s"][k].values
                i, bins, is_a = (np.asarray(s.field(f).to_numpy(zero_copy_only=False)) for f in ("i", "_bin", "_is_a"))
                na, nb, before, own, follows, take, before_a = (col[c][k].as_py() for c in ("_na", "_nb", "_before", "_own_before", "_follows", "_take", "_before_a"))
                take = np.full(iterations, na) if take is None else np.asarray(take)
                before_a = np.zeros(iterations, int) if before_a is None else np.asarray(before_a)
                follows = int(bins[-1]) if follows < 0 else follows
                found.append(_distances(i, is_a, bins, follows, na, nb, before, before_a, own, take, seed))
            yield pa.RecordBatch.from_arrays([*[col[c] for c in keys], pa.array([f.tolist() for f in found], pa.list_(pa.float64()))], [*keys, "_d"])

    out = spread(packed, group).mapInArrow(run, f"{', '.join(f'{c} {kinds[c]}' for c in keys)}, _d array<double>")
    if o.chunked:
        each = out.select(*keys, F.posexplode("_d").alias("_k", "_v")).groupBy(*keys, "_k").agg(F.sum("_v").alias("_v"))
        out = each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_v"))), lambda s: s["_v"]).alias("_d"))
    return out.select(*keys, F.col("_d")[0].alias("observed"), F.slice("_d", 2, iterations).alias("nulls"))


def _sliced(i: np.ndarray, is_a: np.ndarray, x: np.ndarray, y: np.ndarray, u: np.ndarray, iterations: int, seed: int, p: int) -> np.ndarray:
    """Sliced distance of the given labels (first) and of each relabelling. The numbers of both
    sides never change, so neither do the steps at which their distributions are compared."""
    na = int(is_a.sum())
    nb = len(i) - na
    proj = u @ np.vstack([x, y])
    order = np.argsort(proj, axis=1, kind="stable")
    proj = np.take_along_axis(proj, order, 1)
    ends_a, ends_b = np.arange(1, na + 1) * nb, np.arange(1, nb + 1) * na        # in 1 / (na nb)
    ends = np.union1d(ends_a, ends_b)
    at_a, at_b, part = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), np.diff(ends, prepend=0) / (na * nb)

    def cost(labels: np.ndarray) -> np.ndarray:
        total, step = np.zeros(len(labels)), max(1, CELLS // labels.size)
        for k in range(0, len(u), step):                                         # directions at once
            own = labels[:, order[k:k + step]]
            spread = np.broadcast_to(proj[k:k + step], own.shape)
            a, b = spread[own].reshape(*own.shape[:2], na), spread[~own].reshape(*own.shape[:2], nb)
            total += (np.abs(a[..., at_a] - b[..., at_b]) ** p @ part).sum(axis=1)
        return (total / len(u)) ** (1 / p)

    out = [cost(is_a[None, :])]
    step = max(1, CELLS // len(i))
    for k in range(0, iterations, step):
        labels = np.ascontiguousarray(_chosen(i, np.full(iterations, na), np.arange(k, min(k + step, iterations)), seed).T)
        if len(i) > 62:
            out.append(cost(labels))
        else:                                       # a small pool has few ways to deal its labels: each is compared once
            _, first, which = np.unique(labels @ (np.int64(1) << np.arange(len(i))), return_index=True, return_inverse=True)
            out.append(cost(labels[first])[which])
    return np.concatenate(out)


def null_summary(each: DataFrame, keys: Sequence[str], margin: float) -> DataFrame:
    """(keys, observed, null_n, null_mean, null_std, above) of rows (keys, observed, nulls)."""
    long = each.select(*keys, "observed", F.explode("nulls").alias("v"))
    return long.groupBy(*keys).agg(F.max("observed").alias("observed"), F.count(F.lit(1)).alias("null_n"), F.avg("v").alias("null_mean"),
                                   F.stddev_pop("v").alias("null_std"), F.avg((F.col("v") > F.col("observed") + margin).cast("double")).alias("above"))


def relabelled_sliced(points: DataFrame, keys: Sequence[str], directions, iterations: int, seed: int = 0, p: int = 2,
                      settings: Settings = DEFAULT, margin: float | None = None) -> DataFrame:
    """(keys, observed, nulls): the sliced transport of both sides, and that of each relabelling;
    with a ``margin`` the columns of :func:`null_summary`, so that no null value leaves its task.

    ``points``: keys, i, side ('a' or 'b'), x, y.  The pool of a key is one row up to
    ``rows_per_chunk`` points; larger pools are relabelled and compared as long tables."""
    keys = list(keys)
    n = lambda s: F.count_if(F.col("side") == s)
    per = points.groupBy(*keys).agg(n("a").alias("_na"), n("b").alias("_nb")).where("_na > 0 AND _nb > 0")
    rows = attach(points.select(*keys, "i", "side", "x", "y"), per, keys)
    large = F.col("_na") + F.col("_nb") > settings.rows_per_chunk
    pools = rows.where(~large).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", (F.col("side") == "a").alias("a"), "x", "y"))).alias("_s"))
    u, kinds = np.array(directions), dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            names, found = batch.schema.names, []
            packed = batch.column(names.index("_s"))
            for k in range(batch.num_rows):
                i, a, x, y = (np.asarray(packed[k].values.field(f).to_numpy(zero_copy_only=False)) for f in ("i", "a", "x", "y"))
                d = _sliced(i, a.astype(bool), x, y, u, iterations, seed, p)
                found.append((d[0], d[1:]) if margin is None else (d[0], iterations, d[1:].mean(), d[1:].std(), (d[1:] > d[0] + margin).mean()))
            values = [pa.array(list(c), k) for c, k in zip(zip(*found), types)]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in keys], *values], [*keys, *given])

    given = ["observed", "nulls"] if margin is None else ["observed", "null_n", "null_mean", "null_std", "above"]
    types = [pa.float64(), pa.list_(pa.float64())] if margin is None else [pa.float64(), pa.int64(), *[pa.float64()] * 3]
    declared = ["double", "array<double>"] if margin is None else ["double", "long", *["double"] * 3]
    out = spread(pools, keys).mapInArrow(run, ", ".join(f"{c} {k}" for c, k in [*((c, kinds[c]) for c in keys), *zip(given, declared)]))
    hot = rows.where(large).drop("_na", "_nb")
    if not hot.take(1):
        return out
    from spikegrid.operators.distances import sliced_distance
    from spikegrid.operators.nulls import permute_sides

    weighted = lambda d: d.withColumn("w", F.lit(1.0))
    seen = sliced_distance(weighted(hot), keys, directions, p, settings).withColumnRenamed("distance", "observed")
    dealt = sliced_distance(weighted(permute_sides(hot, keys, ["i"], iterations, seed, settings)), [*keys, "iter"], directions, p, settings)
    nulls = dealt.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("iter", "distance"))), lambda s: s["distance"]).alias("nulls"))
    large_pools = seen.join(nulls, keys)
    return out.unionByName(large_pools if margin is None else null_summary(large_pools, keys, margin))
