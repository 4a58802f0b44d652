"""Histograms with free edges, speed curves, change columns and label numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spikegrid.functions.expr import safe_div


def even_edges(low: float, high: float, bins: int | None = None, width: float | None = None) -> list[float]:
    """Edges between two limits: a number of bins, or as many of about ``width`` as fit."""
    if (bins is None) == (width is None):
        raise ValueError("give either bins or width")
    n = bins if bins is not None else max(1, -int(-(high - low) // width))
    return [low + (high - low) * k / n for k in range(n)] + [high]


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """Bin of a value from 0: lower edge in, upper edge out, but the last edge is in.
    Null outside the edges and for a missing value."""
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must rise")

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high + 1) // 2
        return F.when(value < F.lit(float(edges[mid])), below(low, mid - 1)).otherwise(below(mid, high))

    inside = (value >= F.lit(float(edges[0]))) & (value <= F.lit(float(edges[-1]))) & ~F.isnan(value)
    return F.when(inside, below(0, len(edges) - 2))


def histogram(rows: DataFrame, keys: Sequence[str], x: str, x_edges: Sequence[float],
              y: str | None = None, y_edges: Sequence[float] | None = None) -> DataFrame:
    """Counts per occupied bin: (keys, x_bin, n) or (keys, x_bin, y_bin, n)."""
    axes = {"x_bin": bin_index(F.col(x).cast("double"), x_edges)}
    if y is not None:
        axes["y_bin"] = bin_index(F.col(y).cast("double"), y_edges)
    binned = rows.select(*keys, *[c.alias(n) for n, c in axes.items()]).dropna(subset=list(axes))
    return binned.groupBy(*keys, *axes).agg(F.count(F.lit(1)).alias("n"))


def limits(rows: DataFrame, x: str) -> tuple[float, float] | None:
    """Smallest and largest value, the default limits; None without values."""
    r = rows.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).agg(F.min(x), F.max(x)).first()
    return None if r[0] is None else (float(r[0]), float(r[1]))


def rate_by_speed(rates: DataFrame, speeds: DataFrame) -> DataFrame:
    """Mean and largest firing rate at each whole speed of common intervals."""
    j = rates.join(speeds, ["session_id", "bin"]).where(F.col("speed").isNotNull())
    # speeds are cut to whole numbers, towards zero
    return j.groupBy(F.col("speed").cast("long").alias("speed")).agg(
        F.avg("rate").alias("mean_rate"), F.max("rate").alias("max_rate"), F.count(F.lit(1)).alias("intervals"))


def change_scores(observed: DataFrame, null: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """z of each observed change or ratio against its null: (x - mean) / population deviation."""
    stats = null.groupBy(*keys).agg(*[f(n).alias(n + s) for n in names for f, s in ((F.avg, "_mean"), (F.stddev_pop, "_std"))])
    out = observed.join(stats, list(keys))
    return out.withColumns({n + "_z": safe_div(F.col(n) - F.col(n + "_mean"), F.col(n + "_std")) for n in names})


def with_change(pairs: DataFrame, names: Sequence[str], prev: str = "_prev", curr: str = "_curr") -> DataFrame:
    """Adds name = [previous, current, current - previous] for each score of a session pair."""
    return pairs.withColumns({n: F.array(F.col(n + prev), F.col(n + curr), F.col(n + curr) - F.col(n + prev)) for n in names})


def largest_label(units: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Largest matched label over the sessions of a key."""
    return units.groupBy(*keys).agg(F.max(label).alias(label))


def sequential_labels(matches: DataFrame, unmatched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, label, new_label): a matched unit takes its partner's label in the session
    before; unmatched ones follow, in order, after one free number.

    ``matches``: keys, unit_a, unit_b; ``unmatched``: keys, label. Keys name one pair of
    sessions of a site, so a group is the units of one recording."""
    taken = matches.select(*keys, F.col("unit_b").alias("label"), F.col("unit_a").alias("new_label"))
    return taken.unionByName(_after(unmatched, taken, keys))


def first_session_labels(matches: DataFrame, unmatched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, label, new_label): matched units of the first session are numbered from 1 by
    the distance to their partners; unmatched ones follow after one free number."""
    order = Window.partitionBy(*keys).orderBy("distance", "unit_a")
    taken = matches.select(*keys, F.col("unit_a").alias("label"), F.row_number().over(order).alias("new_label"))
    return taken.unionByName(_after(unmatched, taken, keys))


def _after(unmatched: DataFrame, taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    top = taken.groupBy(*keys).agg(F.max("new_label").alias("_top"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("label"))
    return unmatched.join(top, list(keys), "left").select(*keys, "label", (F.coalesce("_top", F.lit(0)) + 1 + rank).alias("new_label"))
