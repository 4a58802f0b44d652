"""Null distributions and their statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spikegrid.functions.expr import hash_uniform, modified_zscore, safe_div, zscore
from spikegrid.operators.ordered import Ordered, attach
from spikegrid.settings import DEFAULT, Settings


MAD_SCALE = 1.482602218505602   # fixed value: makes the MAD of a normal sample its deviation


def lattice_shares(n: int) -> list[float]:
    """Low-discrepancy numbers in [0, 1): multiples of the golden ratio."""
    g = (5 ** 0.5 - 1) / 2
    return [(k * g) % 1.0 for k in range(1, n + 1)]


def random_shares(n: int, seed: int = 0) -> list[float]:
    return [float(v) for v in np.random.default_rng(seed).random(n)]


def shift_spikes(spk: DataFrame, keys: Sequence[str], shares: Sequence[float], limit: float) -> DataFrame:
    """Circularly shifted copies ``iter`` = 0.. of every train.

    The shift of copy k is limit + share_k * (t_stop - 2 limit); a limit of half
    the span or more is lowered to the next whole number below.  A spike pushed
    past the end re-enters once at the start.
    """
    span = spk.groupBy(*keys).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    j = attach(spk, span, keys).where(F.col("_t1") > F.col("_t0"))
    half = (F.col("_t1") - F.col("_t0")) / 2
    low = F.floor(half).cast("double")
    lim = F.when(F.lit(float(limit)) >= half, F.when(low == half, low - 1).otherwise(low)).otherwise(F.lit(float(limit)))
    copies = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(shares)])
    x = j.withColumn("_lim", lim).withColumn("_c", F.explode(copies))
    moved = F.col("t") + F.col("_lim") + F.col("_c.s") * (F.col("_t1") - 2 * F.col("_lim"))
    wrapped = F.when(moved > F.col("_t1"), moved - (F.col("_t1") - F.col("_t0"))).otherwise(moved)
    return x.withColumn("iter", F.col("_c.k")).withColumn("t", wrapped).drop("_t0", "_t1", "_lim", "_c")


def permute_sides(points: DataFrame, keys: Sequence[str], order_key: Sequence[str], iterations: int, seed: int = 0,
                  settings: Settings = DEFAULT) -> DataFrame:
    """Random relabelling: per iteration the pooled points are dealt to sides 'a' and 'b'
    in the original numbers.  The order is a hash of the row's key, so it is repeatable."""
    sizes = points.groupBy(*keys).agg(F.sum(F.when(F.col("side") == "a", 1).otherwise(0)).alias("_na"))
    pool = points.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    pool = pool.withColumn("_u", hash_uniform(*keys, *order_key, "side", "iter", seed=seed))
    dealt = Ordered(pool, [*keys, "iter"], ["_u", *order_key, "side"], settings).number("_rn").df
    out = attach(dealt, sizes, keys)
    return out.withColumn("side", F.when(F.col("_rn") <= F.col("_na"), F.lit("a")).otherwise(F.lit("b"))).drop("_u", "_rn", "_na")


def different_cells(prev: DataFrame, curr: DataFrame, keys: Sequence[str], cell: str) -> DataFrame:
    """Pairs of different cells of two sessions; of (p, q) and (q, p) the ascending one stays.

    The cells of one recording site carry the few labels of the cutting software,
    so the pairs per key are bounded.  Pairs are formed on the keys alone; the other
    columns (suffix _a / _b) are attached afterwards.
    """
    side = lambda d, s: d.select(*keys, *[F.col(c).alias(c + s) for c in d.columns if c not in keys])
    ca, cb = cell + "_a", cell + "_b"
    slim = prev.select(*keys, F.col(cell).alias(ca)).join(curr.select(*keys, F.col(cell).alias(cb)), list(keys))
    slim = slim.where(F.col(ca) != F.col(cb)).groupBy(*keys, F.least(ca, cb).alias("_lo"), F.greatest(ca, cb).alias("_hi")).agg(
        F.min(F.struct(ca, cb)).alias("_p"))
    pairs = slim.select(*keys, F.col(f"_p.{ca}").alias(ca), F.col(f"_p.{cb}").alias(cb))
    return pairs.join(side(prev, "_a"), [*keys, ca]).join(side(curr, "_b"), [*keys, cb])


# ---------------------------------------------------------------- statistics
def array_quantile(values: Column, p: float) -> Column:
    """Linear quantile of a sorted array."""
    pos = (F.size(values) - 1) * F.lit(float(p))
    lo = F.floor(pos).cast("int")
    a, b = F.get(values, lo), F.get(values, F.ceil(pos).cast("int"))
    return a + (b - a) * (pos - lo)


def null_statistics(nulls: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """mean, std, median and (normal-scaled) MAD of each null distribution.

    A null holds one value per iteration (or per pair of cells of one site), so the
    sorted values of a key fit one row; they stay in ``null_values`` for quantiles
    and the null itself is computed only once.
    """
    g = nulls.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_list(value)).alias("null_values"),
        F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_std"),
    )
    g = g.withColumn("null_n", F.size("null_values").cast("long")).withColumn("null_median", array_quantile(F.col("null_values"), 0.5))
    dev = F.array_sort(F.transform("null_values", lambda v: F.abs(v - F.col("null_median"))))
    g = g.withColumn("_dev", dev)
    return g.withColumn("null_mad", array_quantile(F.col("_dev"), 0.5) * F.lit(MAD_SCALE)).drop("_dev")


def with_scores(observed: DataFrame, stats: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """z and modified z of each observed value."""
    return attach(observed, stats, keys).withColumn("z", zscore(value, "null_mean", "null_std")).withColumn(
        "mod_z", modified_zscore(value, "null_median", "null_mad"))


def empirical_p(observed: DataFrame, nulls: DataFrame, keys: Sequence[str], larger_is_better: bool, value: str = "value") -> DataFrame:
    """Share of null values on the good side of the observation (strict)."""
    n = nulls.select(*keys, F.col(value).alias("_null"))
    j = attach(n, observed.select(*keys, value), keys)
    better = F.col("_null") > F.col(value) if larger_is_better else F.col("_null") < F.col(value)
    return j.groupBy(*keys).agg(F.avg(better.cast("double")).alias("p_value"))


def with_quantile(scored: DataFrame, value: str = "value", name: str = "quantile") -> DataFrame:
    """Position of a value in the null of its row: a histogram distribution function
    with as many bins as null values, interpolated linearly between its knots."""
    v = F.col("null_values")
    n = F.size(v).cast("double")
    lo, hi = F.get(v, F.lit(0)), F.get(v, F.size(v) - 1)
    # a null without spread is widened by one half on both sides
    pad = F.when(hi == lo, F.lit(0.5)).otherwise((hi - lo) / (2 * (n - 1)))
    d = scored.withColumn("_n", n).withColumn("_low", lo - pad).withColumn("_width", (hi - lo + 2 * pad) / n)
    # the knots are spread evenly over the whole range, one per bin
    knot = F.when(F.col("_n") > 1, F.col("_width") * F.col("_n") / (F.col("_n") - 1)).otherwise(F.lit(1.0))
    d = d.withColumn("_pos", (F.col(value) - F.col("_low")) / knot)
    d = d.withColumn("_k", F.greatest(F.lit(0.0), F.least(F.floor("_pos").cast("double"), F.col("_n") - 1)))
    share = F.greatest(F.lit(0.0), F.least(F.col("_pos") - F.col("_k"), F.lit(1.0)))

    def below(k):
        b = lambda x: F.greatest(F.lit(0.0), F.least(F.floor((x - F.col("_low")) / F.col("_width")).cast("double"), F.col("_n") - 1))
        return F.size(F.filter("null_values", lambda x: b(x) <= k))

    d = d.withColumn("_c0", below(F.col("_k"))).withColumn("_c1", below(F.col("_k") + 1))
    q = (F.col("_c0") + (F.col("_c1") - F.col("_c0")) * share) / F.col("_n")
    return d.withColumn(name, q).drop("_n", "_low", "_width", "_pos", "_k", "_c0", "_c1")


def tails(q: Column) -> dict[str, Column]:
    """One- and two-sided p values of a quantile."""
    return {"p_lower": q, "p_higher": 1 - q, "p_two": 2 * F.least(q, 1 - q)}


def permute_groups(df: DataFrame, keys: Sequence[str], label: str, row_key: Sequence[str], seed: int = 0,
                   settings: Settings = DEFAULT) -> DataFrame:
    """Shuffle ``label`` among the rows of each key."""
    a = Ordered(df, keys, list(row_key), settings).number("_rn").df
    donors = df.select(*keys, *row_key, F.col(label).alias("_new")).withColumn("_u", hash_uniform(*keys, *row_key, seed=seed))
    b = Ordered(donors, keys, ["_u", *row_key], settings).number("_rn").df.select(*keys, "_rn", "_new")
    return a.join(b, [*keys, "_rn"]).drop(label, "_rn").withColumnRenamed("_new", label)


def bootstrap_means(df: DataFrame, keys: Sequence[str], row_key: str, value: str, iterations: int, seed: int = 0,
                    settings: Settings = DEFAULT) -> DataFrame:
    """(keys, n, means): the mean of each resample of a key, for keys that fit one row.

    Draw j of iteration k takes the row with number hash(j, k) mod n; rows are numbered from
    0 by ``row_key``.  No row is copied: a key's values are packed once, and its resamples are
    index arrays in the task.  Keys above ``rows_per_chunk`` rows go through :func:`bootstrap`."""
    from spikegrid.operators.maps import spread
    from spikegrid.operators.relabel import CELLS, hash32

    n = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows = attach(df.where(F.col(value).isNotNull()).select(*keys, F.col(row_key).alias("_r"), F.col(value).cast("double").alias("_v")), n, keys)
    few = rows.where(F.col("n") <= settings.rows_per_chunk)
    packed = few.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_v"))), lambda s: s["_v"]).alias("_v"))

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            v = np.asarray(v, float)
            step = max(1, CELLS // len(v))
            parts = [v[hash32(np.arange(len(v)), np.arange(k, min(k + step, iterations)), seed) % np.uint64(len(v))].mean(axis=0)
                     for k in range(0, iterations, step)]
            out.append(np.concatenate(parts))
        return pd.Series(out)

    small = spread(packed, keys).select(*keys, F.size("_v").cast("long").alias("n"), run("_v").alias("means"))
    many = rows.where(F.col("n") > settings.rows_per_chunk).drop("n")
    if not many.take(1):
        return small
    drawn = bootstrap(many, keys, ["_r"], iterations, seed, settings).groupBy(*keys, "iter").agg(F.avg("_v").alias("_m"), F.count(F.lit(1)).alias("n"))
    large = drawn.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("iter", "_m"))), lambda s: s["_m"]).alias("means"))
    return small.unionByName(large)


def bootstrap(df: DataFrame, keys: Sequence[str], row_key: Sequence[str], iterations: int, seed: int = 0,
              settings: Settings = DEFAULT) -> DataFrame:
    """Resamples with replacement of the size of each key, numbered ``iter``.

    Draw j of a key picks the row with number floor(u n) + 1; rows and draws meet
    in an equi-join on (key, number), so no group is collected.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    numbered = Ordered(df, keys, list(row_key), settings).number("_rn").df
    draws = attach(numbered.select(*keys, F.col("_rn").alias("_j")), sizes, keys).withColumn(
        "iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    pick = F.floor(hash_uniform(*keys, "_j", "iter", seed=seed) * F.col("_n")) + 1
    return draws.select(*keys, "iter", pick.alias("_rn")).join(numbered, [*keys, "_rn"]).drop("_rn")
