"""Spike-train operators over ``spikes(session_id, unit, t, i)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spikegrid.functions.expr import safe_div
from spikegrid.operators.ordered import Ordered, attach, quantiles
from spikegrid.settings import DEFAULT, Settings

UNIT = ["session_id", "unit"]
ORDER = ["t", "i"]


def with_isi(spk: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Interval to the previous spike of the unit, in seconds."""
    return Ordered(spk, UNIT, ORDER, settings).near(1, 0, lambda w: {"isi": F.col("t") - F.lag("t").over(w)}).df


def isi_statistics(spk: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Interval statistics in milliseconds; cv is std over mean."""
    ms = with_isi(spk, settings).where(F.col("isi").isNotNull()).withColumn("ms", F.col("isi") * 1000)
    agg = ms.groupBy(*UNIT).agg(
        F.min("ms").alias("isi_min"),
        F.max("ms").alias("isi_max"),
        F.avg("ms").alias("isi_mean"),
        F.stddev_pop("ms").alias("isi_std"),
    )
    med = quantiles(ms, UNIT, "ms", {"isi_median": 0.5}, settings)
    return agg.join(med, UNIT).withColumn("isi_cv", safe_div("isi_std", "isi_mean"))


def isi_histogram(spk: DataFrame, width: float, limit: float, settings: Settings = DEFAULT) -> DataFrame:
    """Counts of intervals (ms) in bins of ``width`` over [0, limit]; the last bin is closed."""
    ms = with_isi(spk, settings).withColumn("ms", F.col("isi") * 1000).where(F.col("ms").between(0, limit))
    n = int(round(limit / width))
    b = F.least(F.floor(F.col("ms") / F.lit(float(width))), F.lit(n - 1)).cast("int")
    return ms.groupBy(*UNIT, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def burst_members(spk: DataFrame, max_isi: float, min_spikes: int = 2, split_touching: bool = False,
                  settings: Settings = DEFAULT) -> DataFrame:
    """Spikes with ``burst`` (running number) or null for single spikes.

    A spike is single when both neighbouring intervals exceed ``max_isi``; the
    rest form runs.  With ``split_touching`` a long interval also ends a run.
    """
    o = Ordered(spk, UNIT, ORDER, settings)
    o = o.near(1, 1, lambda w: {
        "_gap_before": F.col("t") - F.lag("t").over(w),
        "_gap_after": F.lead("t").over(w) - F.col("t"),
    })
    far = lambda c: F.coalesce(F.col(c) > F.lit(float(max_isi)), F.lit(True))
    o = o.columns({"_single": far("_gap_before") & far("_gap_after")})
    o = o.lag_lead({"_prev_single": ("_single", -1)})
    starts = ~F.col("_single") & F.coalesce(F.col("_prev_single"), F.lit(True))
    if split_touching:
        starts = starts | (~F.col("_single") & far("_gap_before"))
    o = o.columns({"_start": starts.cast("long")}).running({"_run": F.col("_start")})
    run = F.when(~F.col("_single"), F.col("_run"))
    out = o.df.withColumn("burst", run).drop("_gap_before", "_gap_after", "_prev_single", "_start", "_run", "_single")
    if min_spikes <= 2 and not split_touching:
        return out  # with merged runs a run of one spike cannot occur
    sizes = out.where(F.col("burst").isNotNull()).groupBy(*UNIT, "burst").agg(F.count(F.lit(1)).alias("_size"))
    kept = out.join(sizes, UNIT + ["burst"], "left")
    return kept.withColumn("burst", F.when(F.col("_size") >= min_spikes, F.col("burst"))).drop("_size")


def burst_statistics(spk: DataFrame, max_isi: float, min_spikes: int = 2, split_touching: bool = False,
                     settings: Settings = DEFAULT) -> DataFrame:
    """Burst share 100 B / (B + S) and mean spikes per burst; null below two spikes."""
    members = burst_members(spk, max_isi, min_spikes, split_touching, settings)
    # count per run first, so a hot unit is reduced before the per-unit step
    runs = members.groupBy(*UNIT, "burst").agg(F.count(F.lit(1)).alias("_k"))
    out = runs.groupBy(*UNIT).agg(
        F.sum("_k").alias("n_spikes"),
        F.count("burst").alias("n_bursts"),
        F.coalesce(F.sum(F.when(F.col("burst").isNull(), F.col("_k"))), F.lit(0)).alias("n_single"),
    )
    enough = F.col("n_spikes") >= 2
    return out.select(
        *UNIT, "n_spikes", "n_bursts", "n_single",
        F.when(enough, 100.0 * F.col("n_bursts") / (F.col("n_bursts") + F.col("n_single"))).alias("bursting"),
        F.when(enough, safe_div(F.col("n_spikes") - F.col("n_single"), F.col("n_bursts"))).alias("spikes_per_burst"),
    )


def event_rate(spk: DataFrame, duration: float | None = None) -> DataFrame:
    """Spikes per second of the unit's own span, or of a given duration."""
    span = F.lit(float(duration)) if duration else F.max("t") - F.min("t")
    return spk.groupBy(*UNIT).agg(
        F.count(F.lit(1)).alias("n"), safe_div(F.count(F.lit(1)), span).alias("rate")
    )


def session_rate(spk: DataFrame, duration: float | None = None) -> DataFrame:
    """Mean of the unit rates of a session (undefined rates are skipped)."""
    return event_rate(spk, duration).groupBy("session_id").agg(
        F.avg("rate").alias("mean_rate"), F.count("rate").alias("units")
    )


def binned_train(spk: DataFrame, rate: float) -> DataFrame:
    """Occupied time bins of ``1/rate`` seconds with their spike count (sparse binary view)."""
    return spk.groupBy(*UNIT, F.floor(F.col("t") * F.lit(float(rate)) + F.lit(1e-9)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def train_times(binned: DataFrame, rate: float) -> DataFrame:
    """Times of the occupied bins: the inverse of ``binned_train``."""
    return binned.select(*UNIT, (F.col("bin") / F.lit(float(rate))).alias("t"))


def interval_rate(spk: DataFrame, interval: float) -> DataFrame:
    """Spikes per interval, half-open so a boundary spike counts once."""
    return spk.groupBy(*UNIT, F.floor(F.col("t") / F.lit(float(interval))).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.lit(float(interval))).alias("rate")
    )


def interval_speed(trk: DataFrame, interval: float) -> DataFrame:
    return trk.groupBy("session_id", F.floor(F.col("t") / F.lit(float(interval))).alias("bin")).agg(
        F.avg("speed").alias("speed")
    )


def rate_given_speed(rates: DataFrame, speeds: DataFrame, rate_step: float, speed_step: float) -> DataFrame:
    """Joint and conditional mass of firing rate given speed over common intervals."""
    j = rates.join(speeds, ["session_id", "bin"]).where(F.col("speed").isNotNull())
    cells = j.groupBy(
        F.floor(F.col("speed") / F.lit(float(speed_step))).alias("speed_bin"),
        F.floor(F.col("rate") / F.lit(float(rate_step))).alias("rate_bin"),
    ).agg(F.count(F.lit(1)).alias("n"))
    # from here on the table has one row per occupied (speed, rate) cell
    w = Window.partitionBy("speed_bin")
    total = cells.agg(F.sum("n").alias("_all"))
    return cells.join(F.broadcast(total)).select(
        "speed_bin", "rate_bin", "n",
        (F.col("n") / F.col("_all")).alias("joint"),
        (F.col("n") / F.sum("n").over(w)).alias("conditional"),
    )


def first_gap(labels: DataFrame, keys: list[str]) -> DataFrame:
    """First positive label that is missing; cells are the labels below it, 0 is noise."""
    known = labels.select(*keys, "label").distinct()
    nxt = known.select(*keys, F.col("label").alias("_have"))
    cand = known.where(F.col("label") >= 0).select(*keys, (F.col("label") + 1).alias("label"))
    seed = known.select(*keys).distinct().select(*keys, F.lit(1).cast(dict(known.dtypes)["label"]).alias("label"))
    cand = cand.unionByName(seed).distinct()
    missing = cand.join(known, keys + ["label"], "left_anti")
    return missing.groupBy(*keys).agg(F.min("label").alias("gap"))


def valid_cells(spk: DataFrame, keys: list[str]) -> DataFrame:
    """Spikes whose label lies in 1 .. first gap - 1."""
    gap = first_gap(spk, keys)
    return attach(spk, gap, keys).where((F.col("label") >= 1) & (F.col("label") < F.col("gap"))).drop("gap")


def peak_channel(waves: DataFrame) -> DataFrame:
    """Channel with the largest sample of each spike (the lowest one on a tie)."""
    peak = F.array_max("samples")
    return waves.groupBy("session_id", "spike_idx").agg(
        F.max_by("channel", F.struct(peak, -F.col("channel"))).alias("channel"), F.max(peak).alias("peak")
    )
