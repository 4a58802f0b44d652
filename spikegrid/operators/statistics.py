"""Tests over report tables: every statistic is a sum or an order over chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikegrid.functions.expr import circular_distance, safe_div
from spikegrid.functions.tails import fisher_exact, normal_two_sided, t_two_sided
from spikegrid.operators.ordered import Ordered, attach, average_ranks, value_counts
from spikegrid.settings import DEFAULT, Settings


def _sides(cond_a: Column, e: Column, agg=F.sum):
    return agg(F.when(cond_a, e)), agg(F.when(~cond_a, e))


def one_sided(p_two: Column, statistic: Column, alternative: str) -> Column:
    """The p value of one side from that of both, for a symmetric distribution."""
    if alternative == "two-sided":
        return p_two
    towards = statistic > 0 if alternative == "greater" else statistic < 0
    return F.when(towards, p_two / 2).otherwise(1 - p_two / 2)


def welch_t(df: DataFrame, value: str, side_a: Column, keys: Sequence[str] = (), weight: Column | None = None,
            alternative: str = "two-sided") -> DataFrame:
    """Unequal-variance t of two sides, optionally weighted (weights as frequencies).
    ``alternative``: 'two-sided', or side a is 'greater' or 'less'."""
    w = weight if weight is not None else F.lit(1.0)
    v = F.col(value)
    aggs = []
    for name, e in (("n", w), ("s", w * v), ("q", w * v * v)):
        a, b = _sides(side_a, e)
        aggs += [a.alias(name + "a"), b.alias(name + "b")]
    m = df.where(v.isNotNull()).groupBy(*keys).agg(*aggs)
    var = lambda k: (F.col("q" + k) - F.col("s" + k) * F.col("s" + k) / F.col("n" + k)) / (F.col("n" + k) - 1)
    m = m.withColumn("_ma", F.col("sa") / F.col("na")).withColumn("_mb", F.col("sb") / F.col("nb"))
    m = m.withColumn("_ea", var("a") / F.col("na")).withColumn("_eb", var("b") / F.col("nb"))
    se = F.col("_ea") + F.col("_eb")
    dof = se * se / (F.col("_ea") * F.col("_ea") / (F.col("na") - 1) + F.col("_eb") * F.col("_eb") / (F.col("nb") - 1))
    out = m.select(*keys, F.col("_ma").alias("mean_a"), F.col("_mb").alias("mean_b"),
                   ((F.col("_ma") - F.col("_mb")) / F.sqrt(se)).alias("t"), dof.alias("dof"))
    return out.withColumn("p_value", one_sided(t_two_sided("t", "dof"), F.col("t"), alternative))


def one_sample_t(df: DataFrame, value: Column, mean: float = 0.0, keys: Sequence[str] = (), alternative: str = "two-sided") -> DataFrame:
    """t of a mean against a constant; a paired test passes the difference as ``value``."""
    m = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"))
    out = m.select(*keys, "n", "mean", safe_div(F.col("mean") - F.lit(float(mean)), F.col("_sd") / F.sqrt("n")).alias("t"))
    return out.withColumn("p_value", one_sided(t_two_sided("t", F.col("n") - 1), F.col("t"), alternative))


def mann_whitney(df: DataFrame, value: str, side_a: Column, keys: Sequence[str] = (), settings: Settings = DEFAULT) -> DataFrame:
    """U of side a with mean ranks and the tie-corrected normal approximation.

    Values are counted first, so ties cost one row and a hot side is spread over chunks.
    """
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n(side_a).alias("na"), n(~side_a).alias("nb"))
    both = F.col("na") + F.col("nb")
    r = Ordered(counts, keys, [value], settings).running({"_cum": both}).df
    rank = F.col("_cum") - (both - 1) / 2.0
    b = both.cast("double")
    m = r.groupBy(*keys).agg(
        F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), F.sum(F.col("na") * rank).alias("_ra"),
        F.sum(b * b * b - b).alias("_tie"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    total = na + nb
    u = F.col("_ra") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * (total + 1 - F.col("_tie") / (total * (total - 1))))
    out = m.select(*keys, "n_a", "n_b", u.alias("u"), safe_div(u - na * nb / 2, sd).alias("z"))
    return out.withColumn("p_value", normal_two_sided("z"))


def wilcoxon(df: DataFrame, difference: Column, keys: Sequence[str] = (), settings: Settings = DEFAULT) -> DataFrame:
    """Signed-rank sums of non-zero differences, with the tie-corrected normal approximation."""
    d = df.select(*keys, difference.alias("_d")).where("_d <> 0").withColumn("_abs", F.abs("_d"))
    plus = F.col("_d") > 0
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = d.groupBy(*keys, "_abs").agg(n(plus).alias("np"), n(~plus).alias("nm"))
    both = F.col("np") + F.col("nm")
    r = Ordered(counts, keys, ["_abs"], settings).running({"_cum": both}).df
    rank = F.col("_cum") - (both - 1) / 2.0
    b, n = both.cast("double"), F.col("n").cast("double")
    m = r.groupBy(*keys).agg(F.sum(both).alias("n"), F.sum(F.col("np") * rank).alias("w_plus"), F.sum(F.col("nm") * rank).alias("w_minus"),
                             F.sum(b * b * b - b).alias("_tie"))
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_tie") / 48)
    m = m.withColumn("z", safe_div(F.col("w_plus") - n * (n + 1) / 4, sd)).drop("_tie")
    return m.withColumn("p_value", normal_two_sided("z"))


def weighted_ks(df: DataFrame, value: str, side_a: Column, weight: Column, keys: Sequence[str] = (), settings: Settings = DEFAULT) -> DataFrame:
    """Largest distance of the weighted distribution functions of two sides."""
    wa, wb = _sides(side_a, weight)
    z = F.lit(0.0)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.coalesce(wa, z).alias("wa"), F.coalesce(wb, z).alias("wb"))
    totals = counts.groupBy(*keys).agg(F.sum("wa").alias("_ta"), F.sum("wb").alias("_tb"))
    r = Ordered(counts, keys, [value], settings).running({"_ca": F.col("wa"), "_cb": F.col("wb")}).df
    r = attach(r, totals, keys) if keys else r.join(F.broadcast(totals))
    return r.groupBy(*keys).agg(F.max(F.abs(F.col("_ca") / F.col("_ta") - F.col("_cb") / F.col("_tb"))).alias("d"))


def benjamini_hochberg(df: DataFrame, p: str, keys: Sequence[str], row_key: Sequence[str], settings: Settings = DEFAULT) -> DataFrame:
    """Adjusted p values: running minimum from the largest p of p n / rank."""
    totals = df.groupBy(*keys).agg(F.count(p).alias("_m"))
    o = Ordered(df.where(F.col(p).isNotNull()), keys, [p, *row_key], settings).number("_rank")
    d = attach(o._df, totals, keys) if keys else o._df.join(F.broadcast(totals))
    o = o._with(d.withColumn("_adj", F.col(p) * F.col("_m") / F.col("_rank"))).then_by("_rank").least_ahead({"p_adjusted": F.least(F.col("_adj"), F.lit(1.0))})
    return o.df.drop("_rank", "_m", "_adj")


def fisher(df: DataFrame, first: Column, second: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of a 2 x 2 table and Fisher's exact p."""
    n = lambda x, y: F.sum(F.when(x & y, 1).otherwise(0)).alias
    t = df.groupBy(*keys).agg(n(first, second)("a"), n(first, ~second)("b"), n(~first, second)("c"), n(~first, ~second)("d"))
    return t.withColumn("p_value", fisher_exact("a", "b", "c", "d"))


def linear_fit(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line and its share of explained variance."""
    m = df.groupBy(*keys).agg(F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    slope = safe_div("_c", "_vx")
    return m.select(*keys, slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"),
                    safe_div(F.col("_c") * F.col("_c"), F.col("_vx") * F.col("_vy")).alias("r2"))


def circular_mae(df: DataFrame, a: Column, b: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute wrapped difference of two angles (degrees)."""
    return df.groupBy(*keys).agg(F.avg(F.abs(F.degrees(circular_distance(F.radians(a), F.radians(b))))).alias("mae"))


def train_test(df: DataFrame, row_key: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """Mark each row as train or test by a hash of its key."""
    from spikegrid.functions.expr import hash_uniform

    return df.withColumn("part", F.when(hash_uniform(*row_key, seed=seed) < F.lit(share), F.lit("test")).otherwise(F.lit("train")))
