"""As-of joins as one union plus a carried value (no inequality join)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spikegrid.operators.ordered import Ordered
from spikegrid.settings import DEFAULT, Settings


def _merged(left, right, keys, t, values, tie, settings, need_ahead) -> Ordered:
    rest = [c for c in left.columns if c not in keys and c != t]
    l = left.select(
        *keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"),
        F.struct(*rest).alias("_left") if rest else F.struct(F.lit(1).alias("_one")).alias("_left"),
    )
    r = right.where(F.col(t).isNotNull()).select(
        *keys, F.col(t).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"),
        F.struct(F.col(t).alias("_rt"), *values).alias("_right"),
    )
    both = l.unionByName(r, allowMissingColumns=True)
    o = Ordered(both, keys, ["_t", "_side", "_tie"], settings)
    # of several samples at one instant only the first counts; they share a chunk
    prev = F.lag("_t").over(o.window)
    o = o.columns({"_fresh": (F.col("_side") == 0) & (prev.isNull() | (prev < F.col("_t")))})
    value = F.when(F.col("_fresh"), F.col("_right"))
    return o.fill(last={"_prev": value}, first={"_next": value} if need_ahead else {})


def _unpack(df: DataFrame, left: DataFrame, keys, t, chosen) -> list:
    rest = [c for c in left.columns if c not in keys and c != t]
    return [*keys, F.col("_t").alias(t), *[F.col(f"_left.{c}").alias(c) for c in rest]]


def asof_nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], tie: str,
    settings: Settings = DEFAULT,
) -> DataFrame:
    """Each left row with the right row nearest in time; equal distance takes the earlier one.

    Left rows of a key without right rows are dropped.
    """
    o = _merged(left, right, keys, t, values, tie, settings, True)
    prev, nxt = F.col("_prev"), F.col("_next")
    back, ahead = F.col("_t") - prev["_rt"], nxt["_rt"] - F.col("_t")
    pick = F.when(prev.isNotNull() & (nxt.isNull() | (back <= ahead)), prev).otherwise(nxt)
    out = o.df.where(F.col("_side") == 1).withColumn("_pick", pick).where(F.col("_pick").isNotNull())
    return out.select(
        *_unpack(out, left, keys, t, values),
        F.col("_pick._rt").alias(f"{t}_match"),
        *[F.col(f"_pick.{v}").alias(v) for v in values],
    )


def asof_backward(
    left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], tie: str,
    settings: Settings = DEFAULT, keep_unmatched: bool = True,
) -> DataFrame:
    """Each left row with the latest right row not after it."""
    o = _merged(left, right, keys, t, values, tie, settings, False)
    out = o.df.where(F.col("_side") == 1)
    if not keep_unmatched:
        out = out.where(F.col("_prev").isNotNull())
    return out.select(
        *_unpack(out, left, keys, t, values),
        F.col("_prev._rt").alias(f"{t}_match"),
        *[F.col(f"_prev.{v}").alias(v) for v in values],
    )


def at_nearest_slot(
    values: DataFrame, slots: DataFrame, keys: Sequence[str], t: str, value: str, tie: str, settings: Settings = DEFAULT,
) -> DataFrame:
    """Every slot with the value whose time is nearest to it among all slots; 0 if none is.

    The inverse of a nearest join: each value chooses its slot (the earlier of two equally
    near), of several values in one slot the latest stays.  Keys absent from ``values`` keep
    all slots at 0.
    """
    rows = values.where(F.col(t).isNotNull()).select(*keys, t, F.col(value).alias("_value"))
    placed = asof_nearest(rows, slots, keys, t, [tie], tie, settings)
    last = placed.groupBy(*keys, tie).agg(F.max_by("_value", F.struct(t, "_value")).alias(value))
    return slots.join(last, [*keys, tie], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
