"""Speed over growing windows, and spike times from binned trains."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikegrid.operators import spikes as S, tracking as T
from spikegrid.plans.base import R, all_units, compose, options, query, rd, tracking

HALF = 5            # widest window: this many samples to each side
BIN_RATE = 0.01     # bins of a second, in the time scale of the events table


def _window(k: int) -> str:
    over = f"OVER (PARTITION BY session_id ORDER BY t, i ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    dt = f"(last(t) {over} - first(t) {over})"
    return f"coalesce(CASE WHEN {dt} <> 0 THEN abs(last(x) {over} - first(x) {over}) / {dt} END, 0.0)"


@query("windowed_speed", compose(f"""
SELECT session_id, i, {R(f"({' + '.join(_window(k) for k in range(1, HALF + 1))}) / {float(HALF)} * 1e3")} AS speed_1d FROM trk""", "trk"))
def windowed_speed(spark, sf):
    s = T.windowed_speed(tracking(spark, sf), HALF, settings=options(spark, sf))
    return s.select("session_id", "i", rd(F.col("speed_1d") * 1e3).alias("speed_1d"))


@query("train_times", compose(f"""
SELECT DISTINCT session_id, unit, {R(f"floor(t * {BIN_RATE} + 1e-9) / {BIN_RATE}")} AS t FROM ev""", "ev"))
def train_times(spark, sf):
    t = S.train_times(S.binned_train(all_units(spark, sf), BIN_RATE), BIN_RATE)
    return t.select("session_id", "unit", rd("t").alias("t"))
