"""Unit distances between sessions, matching, chaining and relabelling.

Units of one recording site carry a handful of labels, so everything after the
per-unit statistics is small; spikes are reduced to unit statistics first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spikegrid.operators.clusters import mean_waveform
from spikegrid.operators.ordered import attach
from spikegrid.session import computed_once


def mean_square_difference(waves: DataFrame, pairs: DataFrame, site: Sequence[str]) -> DataFrame:
    """Mean squared difference of the mean waveforms of every unit pair of two sessions.

    ``waves``: site, session_no, label, samples.  ``pairs``: site, prev_no, session_no.
    """
    m = mean_waveform(waves, [*site, "session_no", "label"])
    a = m.select(*site, F.col("session_no").alias("prev_no"), F.col("label").alias("unit_a"), "pos", F.col("v").alias("va"))
    b = m.select(*site, "session_no", F.col("label").alias("unit_b"), "pos", F.col("v").alias("vb"))
    j = pairs.join(a, [*site, "prev_no"]).join(b, [*site, "session_no", "pos"])
    return j.groupBy(*site, "prev_no", "session_no", "unit_a", "unit_b").agg(
        F.avg((F.col("va") - F.col("vb")) * (F.col("va") - F.col("vb"))).alias("distance"))


def unit_histograms(features: DataFrame, site: Sequence[str], bins: int = 100) -> DataFrame:
    """Histogram of every feature of every unit over the unit's own range."""
    unit = [*site, "session_no", "label"]
    long = features.select(*unit, F.posexplode_outer("features").alias("feature", "v")).where("v IS NOT NULL")
    lim = long.groupBy(*unit, "feature").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count("v").alias("size"))
    j = attach(long, lim, [*unit, "feature"])
    # a constant feature is widened by one half on both sides
    lo = F.when(F.col("_hi") > F.col("_lo"), F.col("_lo")).otherwise(F.col("_lo") - 0.5)
    hi = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi")).otherwise(F.col("_hi") + 0.5)
    b = F.least(F.floor((F.col("v") - lo) / (hi - lo) * F.lit(bins)), F.lit(bins - 1)).cast("int")
    return j.groupBy(*unit, "feature", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))


def jensen_shannon(features: DataFrame, pairs: DataFrame, site: Sequence[str], bins: int = 100) -> DataFrame:
    """Jensen-Shannon distance per feature, averaged, of every unit pair of two sessions.

    As published, bins are compared by number although either unit has its own edges.
    """
    # a few rows per unit, read by four branches below
    h = computed_once(unit_histograms(features, site, bins))
    key = [*site, "prev_no", "session_no"]
    hp = pairs.join(h.withColumnRenamed("session_no", "prev_no"), [*site, "prev_no"])
    hq = pairs.join(h, [*site, "session_no"])
    a = hp.select(*key, F.col("label").alias("unit_a"), "feature", "bin", F.col("n").alias("np"), F.col("size").alias("sp"))
    b = hq.select(*key, F.col("label").alias("unit_b"), "feature", "bin", F.col("n").alias("nq"), F.col("size").alias("sq"))
    # sizes per unit, so that a bin empty on one side still knows the other side's total
    ua = a.select(*key, "unit_a", "feature", "sp").distinct()
    ub = b.select(*key, "unit_b", "feature", "sq").distinct()
    both = ua.join(ub, [*key, "feature"])
    left = both.join(a.drop("sp"), [*key, "unit_a", "feature"]).select(*key, "unit_a", "unit_b", "feature", "bin", "sp", "sq", "np", F.lit(0).cast("long").alias("nq"))
    right = both.join(b.drop("sq"), [*key, "unit_b", "feature"]).select(*key, "unit_a", "unit_b", "feature", "bin", "sp", "sq", F.lit(0).cast("long").alias("np"), "nq")
    cell = left.unionByName(right).groupBy(*key, "unit_a", "unit_b", "feature", "bin").agg(
        F.sum("np").alias("np"), F.sum("nq").alias("nq"), F.first("sp").alias("sp"), F.first("sq").alias("sq"))
    m = (F.col("np") + F.col("nq")) / (F.col("sp") + F.col("sq"))
    term = lambda n, s: F.when(F.col(n) > 0, F.col(n) / F.col(s) * F.log(F.col(n) / F.col(s) / m)).otherwise(0.0)
    per = cell.groupBy(*key, "unit_a", "unit_b", "feature").agg(((F.sum(term("np", "sp")) + F.sum(term("nq", "sq"))) / 2).alias("_js"))
    root = F.sqrt(F.greatest(F.col("_js"), F.lit(0.0)))
    return per.groupBy(*key, "unit_a", "unit_b").agg(F.avg(root).alias("distance"))


def mutual_best(distances: DataFrame, key: Sequence[str]) -> DataFrame:
    """Pairs that are each other's nearest unit (lowest label on ties)."""
    wa = Window.partitionBy(*key, "unit_a").orderBy("distance", "unit_b")
    wb = Window.partitionBy(*key, "unit_b").orderBy("distance", "unit_a")
    r = distances.withColumn("_ra", F.row_number().over(wa)).withColumn("_rb", F.row_number().over(wb))
    return r.where((F.col("_ra") == 1) & (F.col("_rb") == 1)).drop("_ra", "_rb")


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment (shortest augmenting paths) of a small matrix."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        slack, via, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = np.nonzero(~used[1:])[0] + 1
            red = c[i0 - 1, free - 1] - u[i0] - v[free]
            better = red < slack[free]
            slack[free[better]], via[free[better]] = red[better], j0
            j1 = free[np.argmin(slack[free])]
            step = slack[j1]
            u[owner[used]] += step
            v[used] -= step
            slack[~used] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[via[j0]], via[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def match_units(distances: DataFrame, key: Sequence[str], label_type: str = "int") -> DataFrame:
    """Mutual best pairs, then the cheapest assignment of the remaining units.

    Columns: key, unit_a, unit_b, distance, step ('mutual' or 'assigned').  The
    matrix of one session pair has at most a few dozen units per side.
    """
    distances = computed_once(distances)    # one row per unit pair, read by every step
    best = mutual_best(distances, key)
    rest = distances.join(best.select(*key, "unit_a"), [*key, "unit_a"], "left_anti").join(
        best.select(*key, "unit_b"), [*key, "unit_b"], "left_anti")
    kinds = dict(distances.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*key, "unit_a", "unit_b", "distance"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="unit_a", columns="unit_b", values="distance").sort_index().sort_index(axis=1)
        hits = assign(grid.to_numpy())
        out = pd.DataFrame({"unit_a": [grid.index[i] for i, _ in hits], "unit_b": [grid.columns[j] for _, j in hits],
                            "distance": [grid.iat[i, j] for i, j in hits]})
        for k in key:
            out[k] = pdf[k].iloc[0]
        return out[[*key, "unit_a", "unit_b", "distance"]]

    more = rest.select(*key, "unit_a", "unit_b", "distance").groupBy(*key).applyInPandas(solve, schema)
    return best.select(*key, "unit_a", "unit_b", "distance", F.lit("mutual").alias("step")).unionByName(
        more.withColumn("step", F.lit("assigned")))


def unmatched(units: DataFrame, matches: DataFrame, key: Sequence[str], side: str) -> DataFrame:
    """Units of one side without a partner."""
    return units.join(matches.select(*key, side), [*key, side], "left_anti")


def chain_roots(matches: DataFrame, site: Sequence[str]) -> DataFrame:
    """(site, session_no, label, root_no, root_label): the first unit of the chain of each matched unit.

    A match points from a unit to its partner in the session before. Pointers are doubled by
    joining the table with itself, so a chain of n sessions takes log2(n) joins and no site is
    folded in one task."""
    at = ["session_no", "label"]
    down = matches.select(*site, "session_no", F.col("unit_b").alias("label"), F.col("prev_no").alias("root_no"), F.col("unit_a").alias("root_label"))
    first = down.select(*site, F.col("root_no").alias("session_no"), F.col("root_label").alias("label")).join(down.select(*site, *at), [*site, *at], "left_anti")
    ends = first.select(*site, *at, F.col("session_no").alias("root_no"), F.col("label").alias("root_label"))
    known = computed_once(down.unionByName(ends))
    longest = matches.select("session_no").distinct().count() + 1
    for _ in range(max(1, (longest - 1).bit_length())):
        further = known.select(*site, F.col("session_no").alias("root_no"), F.col("label").alias("root_label"),
                               F.col("root_no").alias("_no"), F.col("root_label").alias("_label"))
        known = known.join(further, [*site, "root_no", "root_label"], "left")
        known = computed_once(known.select(*site, *at, F.coalesce("_no", "root_no").alias("root_no"), F.coalesce("_label", "root_label").alias("root_label")))
    return known


def chain_ids(matches: DataFrame, units: DataFrame, site: Sequence[str]) -> DataFrame:
    """Global unit numbers over all sessions of a site.

    Matches of consecutive sessions form chains.  Chains are numbered by their mean
    distance from 1; after a gap of one number the units without any match follow.
    ``units``: site, session_no, label.  Result: site, session_no, label, global_id,
    chain_distance (mean over the chain's matches, null for a unit without any).
    """
    at, root = ["session_no", "label"], ["root_no", "root_label"]
    matches = computed_once(matches)        # one row per matched unit
    roots = chain_roots(matches, site)
    links = matches.select(*site, "session_no", F.col("unit_b").alias("label"), "distance").join(roots, [*site, *at])
    means = links.groupBy(*site, *root).agg(F.avg("distance").alias("chain_distance"))
    order = F.row_number().over(Window.partitionBy(*site).orderBy("chain_distance", *root))     # a row for each chain of a site
    means = means.withColumn("_id", order)
    count = means.groupBy(*site).agg(F.max("_id").alias("_chains"))
    known = units.select(*site, *at).join(roots.join(means, [*site, *root]).select(*site, *at, "_id", "chain_distance"), [*site, *at], "left")
    known = known.join(count, list(site), "left")
    alone = F.sum(F.col("_id").isNull().cast("int")).over(Window.partitionBy(*site).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0))
    number = F.coalesce(F.col("_id"), F.coalesce("_chains", F.lit(0)) + 1 + alone).cast("int")
    return known.select(*site, *at, number.alias("global_id"), "chain_distance")


def relabel(spikes: DataFrame, mapping: DataFrame, key: Sequence[str], keep_unknown: bool = False) -> DataFrame:
    """Replace labels by their global number; labels without one become 0 (or stay)."""
    j = spikes.join(mapping.select(*key, "label", "global_id"), [*key, "label"], "left")
    other = F.col("label") if keep_unknown else F.lit(0)
    return j.withColumn("label", F.coalesce("global_id", other).cast("int")).drop("global_id")


def swap_instructions(rows: DataFrame, column: str) -> DataFrame:
    """One row per move of instructions like ``3 to 5 for ses2`` (also several joined by 'and')."""
    pattern = r"(\d+)\s+to\s+(\d+)\s+for\s+ses\s*(\d+)"
    hits = F.arrays_zip(
        F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1)).alias("a"),
        F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(2)).alias("b"),
        F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(3)).alias("s"),
    )
    keep = [c for c in rows.columns if c != column]
    return rows.select(*keep, F.explode(hits).alias("_h")).select(
        *keep, F.col("_h.s").cast("int").alias("session_no"), F.col("_h.a").cast("int").alias("label"), F.col("_h.b").cast("int").alias("global_id"))
