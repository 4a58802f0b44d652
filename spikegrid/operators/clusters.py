"""Waveform features and cluster quality.

``waves``: keys..., label, samples ARRAY<DOUBLE> with all channels one after another.
Every statistic of a cluster is a sum, so clusters of any size are reduced before
they are shuffled; only a d x d matrix per cluster reaches a kernel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spikegrid.functions import waveforms as WF
from spikegrid.functions.expr import chi2_survival_even, root_energy, safe_div
from spikegrid.operators.ordered import attach, broadcast_if_small, kth_smallest
from spikegrid.settings import DEFAULT, Settings


def channel(samples: Column | str, k: int, length: int) -> Column:
    return F.slice(samples, k * length + 1, length)


def with_energy(waves: DataFrame, channels: int, length: int) -> DataFrame:
    """Energy of each channel as array ``energy``."""
    return waves.withColumn("energy", F.array(*[root_energy(channel("samples", k, length)) for k in range(channels)]))


# ---------------------------------------------------------------- moments
def moments(df: DataFrame, keys: Sequence[str], column: str, d: int) -> DataFrame:
    """n, mean array and sums of products (upper triangle, row by row) of an array column."""
    x = [F.element_at(column, i + 1) for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(v) for v in x]).alias("sums"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("products"),
    )


def _covariance(n, sums, products) -> tuple[np.ndarray, np.ndarray]:
    s = np.asarray(sums, float)
    d = len(s)
    c = np.zeros((d, d))
    c[np.triu_indices(d)] = products
    c = c + np.triu(c, 1).T
    return s / n, (c - np.outer(s, s) / n) / (n - 1)


def _arrays(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in names])


@F.pandas_udf(_arrays("mean", "whiten"))
def _whitening(n: pd.Series, sums: pd.Series, products: pd.Series) -> pd.DataFrame:
    """Mean and row-wise whitening matrix of one cluster (null if it is degenerate)."""
    out = []
    for k, s, p in zip(n, sums, products):
        try:
            mean, cov = _covariance(k, s, p)
            if k <= len(mean):
                raise np.linalg.LinAlgError
            out.append((mean, np.linalg.inv(np.linalg.cholesky(cov)).ravel()))
        except np.linalg.LinAlgError:
            out.append((None, None))
    return pd.DataFrame(out, columns=["mean", "whiten"])


@F.pandas_udf(_arrays("mean", "sd", "axes"))
def _principal(n: pd.Series, sums: pd.Series, products: pd.Series) -> pd.DataFrame:
    """Principal axes of the correlation matrix; the largest loading of an axis is positive."""
    out = []
    for k, s, p in zip(n, sums, products):
        mean, cov = _covariance(k, s, p)
        sd = np.sqrt(np.clip(np.diag(cov), 0, None))
        with np.errstate(all="ignore"):
            cor = np.nan_to_num(cov / np.outer(sd, sd), posinf=0, neginf=0)
        w, v = np.linalg.eigh((cor + cor.T) / 2)
        v = v[:, np.argsort(-w, kind="stable")]
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(len(sd))] < 0, -1, 1)
        out.append((mean, sd, v.T.ravel()))
    return pd.DataFrame(out, columns=["mean", "sd", "axes"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _normalised(w: Column) -> Column:
    """A waveform over its length; the length is found once, not for each sample."""
    pair = F.array(F.struct(w.alias("w"), F.sqrt(dot(w, w)).alias("len")))
    return F.transform(pair, lambda p: F.when(p["len"] > 0, F.transform(p["w"], lambda v: v / p["len"])).otherwise(p["w"]))[0]


def wave_components(waves: DataFrame, keys: Sequence[str], channels: int, length: int, component: int = 1,
                    id_columns: Sequence[str] = ("spike_idx", "label"), settings: Settings = DEFAULT) -> DataFrame:
    """Projection of the normalised waveform of each channel on a principal axis (array ``pc``).

    The channels of a spike stay in its row: only sums of products are shuffled, and the
    axes of all channels of a recording come back as one row."""
    rows = waves.select(*keys, *id_columns, F.array(*[_normalised(channel("samples", k, length)) for k in range(channels)]).alias("_w"))
    each = rows.select(*keys, F.posexplode("_w").alias("ch", "w"))
    model = moments(each, [*keys, "ch"], "w", length).select(*keys, "ch", _principal("n", "sums", "products").alias("m"))
    # one array of ``channels`` models for each recording
    models = model.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ch", "m.mean", "m.sd", "m.axes"))).alias("_models"))
    j = attach(rows, broadcast_if_small(models, settings), keys)

    def projected(k: int) -> Column:
        m = F.col("_models")[k]
        z = F.zip_with(F.zip_with(F.col("_w")[k], m["mean"], lambda a, b: a - b), m["sd"], lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)))
        return dot(z, F.slice(m["axes"], (component - 1) * length + 1, length))

    return j.select(*keys, *id_columns, F.array(*[projected(k) for k in range(channels)]).alias("pc"))


# --------------------------------------------------------- cluster quality
def mahalanobis(features: DataFrame, keys: Sequence[str], d: int, id_columns: Sequence[str] = ("spike_idx",),
                settings: Settings = DEFAULT) -> DataFrame:
    """Squared distance of every spike to every cluster of its recording.

    Columns: keys, id columns, label (of the spike), cluster, n_cluster, d2.
    """
    model = moments(features, [*keys, "label"], "features", d).select(
        *keys, F.col("label").alias("cluster"), F.col("n").alias("n_cluster"), _whitening("n", "sums", "products").alias("m"))
    # one row per recording with its few clusters: spikes are matched once, then fanned out locally
    models = model.groupBy(*keys).agg(F.collect_list(F.struct("cluster", "n_cluster", "m.mean", "m.whiten")).alias("_models"))
    rows = attach(features, broadcast_if_small(models, settings), keys).withColumn("_m", F.explode("_models"))
    rows = rows.withColumn("_diff", F.zip_with("features", "_m.mean", lambda a, b: a - b))
    diff = F.col("_diff")
    # sum over rows of (whitening row . difference)^2, with the rows written out
    d2 = F.lit(0.0)
    for i in range(d):
        z = F.lit(0.0)
        for j in range(i + 1):      # lower triangle
            z = z + F.get("_m.whiten", F.lit(i * d + j)) * F.get(diff, F.lit(j))
        d2 = d2 + z * z
    return rows.select(*keys, *id_columns, "label", F.col("_m.cluster").alias("cluster"), F.col("_m.n_cluster").alias("n_cluster"),
                       F.when(F.col("_m.whiten").isNotNull(), d2).alias("d2"))


def l_ratio(distances: DataFrame, keys: Sequence[str], d: int) -> DataFrame:
    """Contamination of each cluster: upper chi-square tails of the other spikes over its size."""
    noise = F.col("label") != F.col("cluster")
    tail = F.when(noise, chi2_survival_even("d2", d))
    return distances.groupBy(*keys, "cluster").agg(F.first("n_cluster").alias("n"), F.coalesce(F.sum(tail), F.lit(0.0)).alias("l"),
                                                    F.count("d2").alias("_ok")).select(
        *keys, "cluster", "n", F.when(F.col("_ok") > 0, F.col("l")).alias("l"), F.when(F.col("_ok") > 0, F.col("l") / F.col("n")).alias("l_ratio"))


def isolation_distance(distances: DataFrame, keys: Sequence[str], settings: Settings = DEFAULT) -> DataFrame:
    """n-th smallest distance of a foreign spike, n = cluster size; null if n exceeds half of all spikes."""
    sizes = distances.groupBy(*keys, "cluster").agg(F.first("n_cluster").alias("n"), F.count(F.lit(1)).alias("total"))
    noise = distances.where((F.col("label") != F.col("cluster")) & F.col("d2").isNotNull())
    kth = kth_smallest(noise, [*keys, "cluster"], "d2", F.col("n_cluster"), "isolation", settings)
    out = sizes.join(kth, [*keys, "cluster"], "left")
    return out.select(*keys, "cluster", "n", F.when(F.col("n") <= F.col("total") / 2, F.col("isolation")).alias("isolation"))


# ------------------------------------------------------------------ waveforms
def mean_waveform(waves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of every sample position, long form (keys, pos, v)."""
    return waves.select(*keys, F.posexplode("samples").alias("pos", "_v")).groupBy(*keys, "pos").agg(F.avg("_v").alias("v"))


def spike_width(waves: DataFrame, keys: Sequence[str], channels: int, length: int, rate: float) -> DataFrame:
    """Time from the largest peak of the mean waveform to the lowest point after it, on the
    channel with the highest mean peak."""
    m = mean_waveform(waves, keys)
    ch = F.floor(F.col("pos") / length).cast("int")
    m = m.withColumn("ch", ch).withColumn("s", (F.col("pos") % length).cast("int"))
    peak = m.groupBy(*keys).agg(F.max_by(F.struct("ch", "s"), F.struct("v", -F.col("pos"))).alias("_p"))
    j = m.join(peak, list(keys)).where((F.col("ch") == F.col("_p.ch")) & (F.col("s") >= F.col("_p.s")))
    low = j.groupBy(*keys).agg(F.first("_p.ch").alias("channel"), F.first("_p.s").alias("_s"), F.min_by("s", F.struct("v", "s")).alias("_t"))
    return low.select(*keys, "channel", ((F.col("_t") - F.col("_s")) / F.lit(float(rate))).alias("width"))


def shape_features(waves: DataFrame, channels: int, length: int, dt: float, keep: Sequence[str]) -> DataFrame:
    """25 shape features per channel as one array ``features`` (channel after channel)."""

    @F.pandas_udf("array<double>")
    def run(samples: pd.Series) -> pd.Series:
        if not len(samples):
            return pd.Series([], dtype=object)
        w = np.stack(samples.to_numpy()).astype(float)
        parts = [WF.features(w[:, k * length:(k + 1) * length], dt) for k in range(channels)]
        return pd.Series(list(np.concatenate(parts, axis=1)))

    return waves.select(*keep, run("samples").alias("features"))
