"""Structured Streaming forms of the incremental measures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def interval_counts(events: DataFrame, interval: str, delay: str, keys=("session_id", "unit"), ts: str = "ts") -> DataFrame:
    """Spikes per tumbling interval; late events within ``delay`` still count."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, interval).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), *keys, "n")
    )


def bursts(events: DataFrame, gap: str, delay: str, keys=("session_id", "unit"), ts: str = "ts") -> DataFrame:
    """Runs of spikes closer than ``gap`` (session windows) with their size."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("spikes"), F.min(ts).alias("first"), F.max(ts).alias("last"))
        .select(*keys, "first", "last", "spikes")
    )


def occupancy(samples: DataFrame, row, col, delay: str, interval: str, ts: str = "ts") -> DataFrame:
    """Samples per bin and interval: the running form of the occupancy map."""
    return (
        samples.withWatermark(ts, delay)
        .groupBy(F.window(ts, interval).alias("w"), "session_id", row.alias("r"), col.alias("c"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), "session_id", "r", "c", "n")
    )


def headings(samples: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Movement direction per session: the last position and direction are the state."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import math

        x, y, a = state.get if state.exists else (0.0, 0.0, 0.0)
        pdf = pd.concat(list(batches)).sort_values(ts)
        out = []
        for r in pdf.itertuples():
            if (r.x, r.y) != (x, y):
                a = math.atan2(r.y - y, r.x - x) % (2 * math.pi)
            x, y = r.x, r.y
            out.append((key[0], getattr(r, ts), a))
        state.update((x, y, a))
        yield pd.DataFrame(out, columns=["session_id", ts, "heading"])

    return samples.withWatermark(ts, delay).select("session_id", ts, "x", "y").groupBy("session_id").applyInPandasWithState(
        step, f"session_id long, {ts} timestamp, heading double", "x double, y double, a double", "append", GroupStateTimeout.NoTimeout)


def adaptive_rate(events: DataFrame, window_seconds: float, delay: str, ts: str = "ts") -> DataFrame:
    """Rate over windows that grow until they exceed ``window_seconds``, then restart.

    State per unit: start of the open window and its spike count.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        out = []
        for t in pd.concat(list(batches))[ts].sort_values():
            now = t.timestamp()
            if start is None:
                start, n = now, 1
                continue
            n += 1
            if now - start > window_seconds:
                out.append((*key, pd.Timestamp((now + start) / 2, unit="s").round("us"), n / (now - start)))
                start, n = now, 0
        state.update((start, n))
        yield pd.DataFrame(out, columns=["session_id", "unit", "mid", "rate"])

    return events.withWatermark(ts, delay).select("session_id", "unit", ts).groupBy("session_id", "unit").applyInPandasWithState(
        step, "session_id long, unit string, mid timestamp, rate double", "start double, n long", "append", GroupStateTimeout.NoTimeout)
