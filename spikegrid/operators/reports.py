"""Report tables: session order, filters, unions, roll-ups and histories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spikegrid.operators.ordered import Ordered, attach
from spikegrid.settings import DEFAULT, Settings


def session_numbers(sessions: DataFrame, animal: str, order: Sequence[str], settings: Settings = DEFAULT) -> DataFrame:
    """Sessions of each animal numbered from 1 in time."""
    return Ordered(sessions, [animal], order, settings).number("session_no").df


def first_of_copies(spikes: DataFrame, site: Sequence[str], session: str, t: str, order: Sequence[str], prefix: int | None = None) -> DataFrame:
    """Sessions to keep when several of a site have the same events; the smallest stays.

    Whole trains are compared: their number of events and two sums of hashes of the
    values, so equal values meet whatever their order, and no train is gathered.  With
    ``prefix`` only that many first events count (the published rule is 50): trains that
    differ later are then taken for copies.
    """
    if prefix is None:
        keys = spikes.groupBy(*site, session).agg(
            F.count(F.lit(1)).alias("_n"), F.sum(F.xxhash64(t).cast("decimal(38,0)")).alias("_a"), F.sum(F.xxhash64(F.lit(1), t).cast("decimal(38,0)")).alias("_b"))
        return keys.groupBy(*site, "_n", "_a", "_b").agg(F.min(session).alias(session), F.count(F.lit(1)).alias("copies")).drop("_n", "_a", "_b")
    w = Window.partitionBy(*site, session).orderBy(*order)
    head = spikes.select(*site, session, t, *[c for c in order if c != t]).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= prefix)
    keys = head.groupBy(*site, session).agg(F.sort_array(F.collect_list(F.struct("_rn", t))).alias("_h"))
    return keys.groupBy(*site, F.transform("_h", lambda x: x[t]).alias("_key")).agg(
        F.min(session).alias(session), F.count(F.lit(1)).alias("copies")).drop("_key")


def valid_row(s: Settings = DEFAULT) -> Column:
    """Spike count, isolation, interval and rate limits of an included cell (a missing value passes)."""
    ok = lambda c: F.coalesce(c, F.lit(True))
    return (
        ok(F.col("spike_count").between(s.report_min_spikes, s.report_max_spikes))
        & ok(F.col("iso_dist") >= s.report_min_isolation)
        & ok(F.col("ISI_mean") >= s.report_min_isi)
        & ok(F.col("firing_rate") <= s.report_max_rate)
    )


def choose_sessions(rows: DataFrame, session: str, date: str, depth: str, step: int = 8) -> DataFrame:
    """Session with most rows per (date, depth), then visits 1, 9, 17, ... of each depth.

    After counting, the tables hold one row per session and per day.
    """
    counts = rows.groupBy(date, depth, session).agg(F.count(F.lit(1)).alias("cells"))
    best = counts.groupBy(date, depth).agg(F.max_by(session, F.struct("cells", -F.col(session).cast("double"))).alias(session), F.max("cells").alias("cells"))
    visit = F.row_number().over(Window.partitionBy(depth).orderBy(date)).cast("long")
    return best.withColumn("visit", visit).where(F.col("visit") % step == 1)


def stack_reports(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Vertical union; columns a report lacks are null."""
    out = first
    for o in others:
        out = out.unionByName(o, allowMissingColumns=True)
    return out


def history(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, settings: Settings = DEFAULT) -> DataFrame:
    """Value of the previous two and the next visit."""
    return Ordered(rows, keys, order, settings).lag_lead({
        f"{value}_prev": (value, -1), f"{value}_prev2": (value, -2), f"{value}_next": (value, 1)}).df


def share_of_total(rows: DataFrame, group: Sequence[str], part: Sequence[str]) -> DataFrame:
    """Rows per (group, part) and their percentage of the group."""
    n = rows.groupBy(*group, *part).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def score_table(scores: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Long (keys, score, value) table of several score frames.

    The rows of each frame are dealt before the union: a union is one stage, which adaptive
    execution gives about a task a core for all its frames, so each would have one or two."""
    out = None
    for df in scores.values():
        cols = [c for c in df.columns if c not in keys]
        df = df.repartition(F.xxhash64(*keys))
        pairs = F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).cast("double").alias("value")) for c in cols])
        long = df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.score", "_p.value")
        out = long if out is None else out.unionByName(long)
    return out


def wide_report(scores: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One column per score."""
    return scores.groupBy(*keys).pivot("score", list(names)).agg(F.first("value"))


def lowest_of(columns: Sequence[str], labels: Sequence[str]) -> tuple[Column, Column]:
    """Lowest value across columns and the label of its column."""
    low = F.least(*columns)
    which = F.get(F.array(*[F.lit(l) for l in labels]), F.array_position(F.array(*columns), low).cast("int") - 1)
    return low, which
