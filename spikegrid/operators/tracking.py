"""Tracking operators: speed, speed filters, heading, smoothing, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spikegrid.functions.expr import hypot2, safe_div, wrap_angle
from spikegrid.operators.ordered import Ordered, attach
from spikegrid.settings import DEFAULT, Settings

KEYS = ["session_id"]
ORDER = ["t", "i"]


def _ordered(trk: DataFrame, settings: Settings) -> Ordered:
    return Ordered(trk, KEYS, ORDER, settings)


def with_speed(trk: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Central-difference speed; the two ends copy their inner neighbour."""

    def build(w):
        def p(c, k):
            if k < 0:
                return F.lag(c, -k).over(w)
            if k > 0:
                return F.lead(c, k).over(w)
            return F.col(c)

        def speed(a, b):
            return safe_div(hypot2(p("x", b) - p("x", a), p("y", b) - p("y", a)), p("t", b) - p("t", a))

        first, last = p("t", -1).isNull(), p("t", 1).isNull()
        return {
            "speed": F.when(first & p("t", 2).isNotNull(), speed(0, 2))
            .when(first, F.lit(0.0))
            .when(last & p("t", -2).isNotNull(), speed(-2, 0))
            .when(last, F.lit(0.0))
            .otherwise(speed(-1, 1))
        }

    return _ordered(trk, settings).near(2, 2, build).df


def speed_between(trk: DataFrame, low: float, high: float, inclusive: bool = False) -> DataFrame:
    """Rows inside a speed band; strict bounds by default, so a low of 0 drops standing samples."""
    if low >= high:
        raise ValueError("the lower speed must be below the upper speed")
    v = F.col("speed")
    return trk.where(v.between(low, high) if inclusive else (v > low) & (v < high))


def adaptive_upper_speed(trk: DataFrame, required_seconds: float, bandwidth: float = 2.0) -> DataFrame:
    """Per session the highest speed band in which the animal spent ``required_seconds``.

    The histogram has ten bins per band.  A band qualifies when ten consecutive
    bins hold enough frames; the answer is the middle of the highest such band.
    """
    width = bandwidth / 10
    per = trk.groupBy(*KEYS).agg(
        F.min("speed").alias("_lo"),
        F.count(F.lit(1)).alias("_n"),
        (F.max("t") - F.min("t")).alias("_span"),
    )
    hist = (
        attach(trk.where(F.col("speed").isNotNull()), per, KEYS)
        .groupBy(*KEYS, F.floor((F.col("speed") - F.col("_lo")) / F.lit(width)).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"),
             F.first((F.col("_n") - 1) / F.col("_span")).alias("_fs"))
    )
    # a band that starts at bin b is the sum of bins b..b+9; starts are the occupied bins and the nine below
    starts = hist.withColumn("s", F.explode(F.sequence(F.col("b") - 9, F.col("b")))).where("s >= 0")
    band = starts.groupBy(*KEYS, "s").agg(
        F.sum("n").alias("n"), F.first("_lo").alias("_lo"), F.first("_fs").alias("_fs")
    )
    good = band.where(F.col("n") >= F.lit(required_seconds) * F.col("_fs"))
    return good.groupBy(*KEYS).agg(
        F.max(F.col("_lo") + (F.col("s") + 5) * F.lit(width)).alias("upper_speed")
    )


def with_heading(trk: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Movement direction in [0, 2 pi); a sample that did not move keeps the last direction."""
    o = _ordered(trk, settings).lag_lead({"_px": ("x", -1), "_py": ("y", -1)})
    dx = F.col("x") - F.coalesce(F.col("_px"), F.lit(0.0))
    dy = F.col("y") - F.coalesce(F.col("_py"), F.lit(0.0))
    moved = F.when((dx != 0) | (dy != 0), F.atan2(dy, dx))
    o = o.columns({"_a": moved}).fill(last={"_h": F.col("_a")})
    return o.df.withColumn("heading", wrap_angle(F.coalesce(F.col("_h"), F.lit(0.0)))).drop("_px", "_py", "_a", "_h")


def with_step(trk: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Time since the previous sample (null for the first one)."""
    return _ordered(trk, settings).near(1, 0, lambda w: {"dt": F.col("t") - F.lag("t").over(w)}).df


def travel(trk: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Distance walked and speed statistics per session."""
    from spikegrid.operators.ordered import quantiles

    o = _ordered(trk, settings).lag_lead({"_px": ("x", -1), "_py": ("y", -1), "_pt": ("t", -1)})
    d = hypot2(F.col("x") - F.col("_px"), F.col("y") - F.col("_py"))
    steps = o.df.withColumn("_d", d).withColumn("_v", safe_div(d, F.col("t") - F.col("_pt")))
    agg = steps.groupBy(*KEYS).agg(
        F.sum("_d").alias("distance"),
        F.min("_v").alias("min_speed"),
        F.max("_v").alias("max_speed"),
        F.avg("_v").alias("mean_speed"),
    )
    med = quantiles(steps, KEYS, "_v", {"median_speed": 0.5}, settings)
    return agg.join(med, KEYS, "left")


def boxcar(trk: DataFrame, width: int, columns=("x", "y"), settings: Settings = DEFAULT) -> DataFrame:
    """Moving mean of ``width`` samples; beyond the ends the end value is repeated."""
    left, right = width // 2, width - 1 - width // 2

    def build(w):
        full = w.rowsBetween(-left, right)
        wa, wb = w.rowsBetween(-left, 0), w.rowsBetween(0, right)
        out = {}
        for c in columns:
            before = left - (F.count(c).over(wa) - 1)
            after = right - (F.count(c).over(wb) - 1)
            total = (
                F.sum(c).over(full)
                + before * F.first(c).over(wa)
                + after * F.last(c).over(wb)
            )
            out[f"{c}_smooth"] = total / F.lit(float(width))
        return out

    return _ordered(trk, settings).near(left, right, build).df


def centre(trk: DataFrame) -> DataFrame:
    """Mid point of the tracked box, one row per session."""
    mid = lambda c: ((F.min(c) + F.max(c)) / 2).alias(f"{c}_centre")
    size = lambda c, n: (F.max(c) - F.min(c)).alias(n)
    return trk.groupBy(*KEYS).agg(mid("x"), mid("y"), size("y", "arena_height"), size("x", "arena_width"))


def to_cm(trk: DataFrame, ppm: float, flip_y: bool = True) -> DataFrame:
    """Pixels to centimetres around the arena centre."""
    j = attach(trk, centre(trk).select(*KEYS, "x_centre", "y_centre"), KEYS)
    sign = -1.0 if flip_y else 1.0
    return (
        j.withColumn("x", 100 * (F.col("x") - F.col("x_centre")) / F.lit(float(ppm)))
        .withColumn("y", sign * 100 * (F.col("y") - F.col("y_centre")) / F.lit(float(ppm)))
        .drop("x_centre", "y_centre")
    )


def drop_jumps(trk: DataFrame, threshold: float, settings: Settings = DEFAULT) -> DataFrame:
    """Remove what lies between a jump of more than ``threshold`` and the next one, if it
    is a single sample, or samples that all have the x at which the next jump ends too (that
    end goes with them).  Other jumps are left untouched; so is what follows the last."""
    o = _ordered(trk, settings).lag_lead({"_px": ("x", -1), "_py": ("y", -1)})
    d = hypot2(F.col("x") - F.col("_px"), F.col("y") - F.col("_py"))
    o = o.columns({"_jump": F.coalesce(d > F.lit(float(threshold)), F.lit(False)).cast("int")}).running({"_run": F.col("_jump")})
    rows = o.df
    # one row for each run of samples between jumps
    runs = rows.groupBy(*KEYS, "_run").agg(
        F.count(F.lit(1)).alias("_n"), F.count("x").alias("_nx"), F.min("x").alias("_low"), F.max("x").alias("_high"),
        F.min_by("x", F.struct(*ORDER)).alias("_first"))
    runs = Ordered(runs, KEYS, ["_run"], settings).lag_lead({"_next": ("_run", 1), "_next_x": ("_first", 1)}).df
    between = (F.col("_run") > 0) & F.col("_next").isNotNull()
    stay = between & (F.col("_n") > 1) & (F.col("_nx") == F.col("_n")) & (F.col("_low") == F.col("_high")) & F.coalesce(F.col("_next_x") == F.col("_low"), F.lit(False))
    runs = runs.select(*KEYS, "_run", (between & (F.col("_n") == 1)).alias("_single"), stay.alias("_stay"))
    runs = Ordered(runs, KEYS, ["_run"], settings).lag_lead({"_stayed": ("_stay", -1)}).df
    ends_stay = (F.col("_jump") == 1) & F.coalesce("_stayed", F.lit(False))
    out = attach(rows, runs, [*KEYS, "_run"]).where(~(F.col("_single") | F.col("_stay") | ends_stay))
    return out.select(*trk.columns)


def strip_trailing_missing(trk: DataFrame) -> DataFrame:
    """Drop the samples after the last one with a position."""
    last = trk.where(F.col("x").isNotNull()).groupBy(*KEYS).agg(F.max("i").alias("_last"))
    return attach(trk, last, KEYS).where(F.col("i") <= F.col("_last")).drop("_last")


def repair_time(trk: DataFrame, step: float | str = 0.02, settings: Settings = DEFAULT) -> DataFrame:
    """Rebuild the clock of sessions whose time stamps repeat: steps from the first stamp;
    samples after the last stamp that is not zero are dropped there.  ``step`` is a number of
    seconds, or the name of a column that has it."""
    counts = trk.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("t").alias("_d"), F.min_by("t", "i").alias("_t0"),
        F.coalesce(F.max(F.when(F.col("t") != 0, F.col("i"))), F.min("i")).alias("_end"))
    numbered = Ordered(trk, KEYS, ["i"], settings).number("_k").df
    rebuilt = F.col("_t0") + (F.col("_k") - 1) * (F.col(step) if isinstance(step, str) else F.lit(float(step)))
    broken = F.col("_n") > F.col("_d")
    out = attach(numbered, counts, KEYS).where(~broken | (F.col("i") <= F.col("_end")))
    return out.withColumn("t", F.when(broken, rebuilt).otherwise(F.col("t"))).select(*trk.columns)


def windowed_speed(trk: DataFrame, max_half: int = 50, axis: str = "x", settings: Settings = DEFAULT) -> DataFrame:
    """1-D speed averaged over centred windows of growing half width (clamped at the ends)."""

    def build(w):
        total = F.lit(0.0)
        for k in range(1, max_half + 1):
            f = w.rowsBetween(-k, k)
            dp = F.abs(F.last(axis).over(f) - F.first(axis).over(f))
            total = total + F.coalesce(safe_div(dp, F.last("t").over(f) - F.first("t").over(f)), F.lit(0.0))
        return {"speed_1d": total / F.lit(float(max_half))}

    return _ordered(trk, settings).near(max_half, max_half, build).df
