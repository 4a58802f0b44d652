"""All knobs of the engine in one frozen object that is passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Settings:
    # physical layout
    rows_per_chunk: int = 1_000_000      # a time-ordered group above this is cut into chunks
    broadcast_keys: int = 50_000         # lookup tables above this many rows are joined, not broadcast
    chunks: Any = None                   # ChunkPlan of the base table (see operators.ordered)
    broadcast_rows: int = 2_000          # model rows (a few KB each) that may be broadcast
    samples_per_kernel: int = 1 << 16    # samples of one signal block (one row of a kernel)

    # grid
    rows: int = 64
    cols: int = 64
    smoothing_factor: float = 3.0
    occupancy_floor: float = 1e-4        # bins visited less than this have rate 0
    active_percentile: float = 0.75

    # tracking and spikes
    speed_low: float = 0.0
    speed_high: float = 100.0
    burst_max_isi: float = 0.01
    burst_min_spikes: int = 2

    # head direction
    hd_bins: int = 360
    hd_window: int = 23
    tuning_bins: int = 36

    # nulls and distances
    shuffle_iterations: int = 1000
    shuffle_limit: float = 20.0
    n_projections: int = 50
    wasserstein_p: int = 2
    seed: int = 0

    # field detection
    field_min_bins: int = 9
    field_min_mean: float = 0.1
    field_min_peak: float = 1.0
    field_low: float = 0.2
    field_high: float = 0.96
    field_step: float = 0.02
    blob_low: float = 0.20
    blob_high: float = 0.80
    blob_min_share: float = 0.01

    # report filter
    report_min_spikes: int = 100
    report_max_spikes: int = 30_000
    report_min_isolation: float = 7.5
    report_min_isi: float = 1.0
    report_max_rate: float = 80.0
    report_visit_step: int = 8

    def but(self, **changes) -> "Settings":
        return replace(self, **changes)


DEFAULT = Settings()
