"""Scores of a stack of count maps of one session at once (NumPy, one small stack)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from spikegrid.functions import grid_kernels as gk

NAMES = ("information", "sparsity", "selectivity", "coherence", "border_top", "border_bottom", "border_left", "border_right")
STACK = 64              # maps filled in at once: their temporaries stay in the cache


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(a.shape, np.nan), where=b != 0)


def _coherence(v: np.ndarray) -> np.ndarray:
    """Correlation over all bins of a rate with the mean of its eight neighbours."""
    m, rows, cols = v.shape
    p = np.pad(v, ((0, 0), (1, 1), (1, 1)))
    ring = sum(p[:, a:a + rows, b:b + cols] for a in range(3) for b in range(3) if (a, b) != (1, 1)) / 8
    x, y = v.reshape(m, -1), ring.reshape(m, -1)
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    spread = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    return np.divide((x * y).sum(axis=1), spread, out=np.zeros(m), where=spread > 0)


def _borders(v: np.ndarray, p: float, lengths_as_published: bool) -> list[np.ndarray]:
    """Score of each wall from the active bins of maps whose largest rate is one."""
    m, rows, cols = v.shape
    flat, limit = v.reshape(m, -1), np.zeros(m)
    # where few bins hold a rate and none is negative the percentile is 0
    full = (np.count_nonzero(flat, axis=1) >= rows * cols - 1 - math.ceil(p * (rows * cols - 1))) | ~(flat.min(axis=1) >= 0)
    limit[full] = np.quantile(flat[full], p, axis=1) if full.any() else 0
    active = v >= limit[:, None, None]
    n = active.sum(axis=(1, 2))
    r, c = np.mgrid[:rows, :cols]
    down, across = (cols, rows) if lengths_as_published else (rows, cols)
    near = [active[:, 0].sum(axis=1) / cols, active[:, -1].sum(axis=1) / cols, active[:, :, 0].sum(axis=1) / rows, active[:, :, -1].sum(axis=1) / rows]
    far = [(active * v * d).sum(axis=(1, 2)) / n / (min(rows, cols) / 2) for d in (r, down - r, c, across - c)]
    return [_ratio(a - b, a + b) for a, b in zip(near, far)]


def scores(counts: np.ndarray, occupancy: np.ndarray, rows: int, cols: int, floor: float, p: float = 0.75,
           lengths_as_published: bool = True, names: Sequence[str] = NAMES) -> np.ndarray:
    """The named scores (of :data:`NAMES`, and the grid score) for each row of spike counts; a
    score that is not defined is NaN."""
    seen = occupancy >= floor
    v = np.divide(counts, occupancy, out=np.zeros(counts.shape), where=seen)
    share = occupancy / occupancy.sum()
    mean, peak = v @ share, v.max(axis=1)
    stack = v.reshape(-1, rows, cols)
    out = {}
    if "information" in names:
        ratio = _ratio(v, np.broadcast_to(mean[:, None], v.shape))
        out["information"] = _ratio(np.where(ratio > 1, v * np.log2(np.where(ratio > 1, ratio, 1)), 0) @ share, mean)
    if "sparsity" in names:
        out["sparsity"] = _ratio(mean * mean, (v * v) @ share)
    if "selectivity" in names:
        out["selectivity"] = _ratio(peak, mean)
    if "coherence" in names:
        out["coherence"] = _coherence(stack)
    if any(n.startswith("border") for n in names):
        out |= zip(NAMES[4:], _borders(_ratio(stack, np.broadcast_to(peak[:, None, None], stack.shape)), p, lengths_as_published))
    if "grid" in names:
        found = [g if m.any() else None for part in gk.parts(stack) for m, g in zip(part, gk.grid_measures(part))]
        out["grid"] = np.array([f["score"] if f else math.nan for f in found])
    return np.where(mean[:, None] > 0, np.column_stack([out[n] for n in names]), np.nan)


def _neighbours(bins: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For some bins: which are neighbours, how many bins two of them have as common neighbours, how many neighbours each has."""
    r, c = np.divmod(bins, cols)

    def along(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.minimum(x[:, None], x), np.maximum(x[:, None], x)
        return high - low, np.maximum(np.minimum(low + 1, size - 1) - np.maximum(high - 1, 0) + 1, 0)

    (down, both_down), (across, both_across) = along(r, rows), along(c, cols)
    far = np.maximum(down, across)
    common = both_down * both_across - 2 * (far == 1) - (far == 0)      # a bin is not its own neighbour
    return (far == 1).astype(float), common.astype(float), np.diagonal(common).astype(float)


def of_bins(counts: np.ndarray, bins: np.ndarray, occupancy: np.ndarray, rows: int, cols: int, floor: float, p: float = 0.75,
            lengths_as_published: bool = True, names: Sequence[str] = NAMES) -> np.ndarray:
    """:func:`scores` of maps with spikes in the given bins only: ``counts`` has a column for each.

    Sums over a map are sums over these bins, those of the neighbours' means quadratic forms. Only
    maps where that would lose digits, or that fill so many bins that a percentile is needed, are
    filled in, or all if the bins are many."""
    size, maps = rows * cols, len(counts)

    def filled(v: np.ndarray) -> np.ndarray:
        whole = np.zeros((len(v), size))
        whole[:, bins] = v
        return whole

    def stacks(which: np.ndarray) -> list[np.ndarray]:
        rows_of = np.flatnonzero(which)
        return [rows_of[at:at + STACK] for at in range(0, len(rows_of), STACK)]

    if "grid" in names or len(bins) ** 2 > 64 * size:
        return np.concatenate([scores(filled(counts[at:at + STACK]), occupancy, rows, cols, floor, p, lengths_as_published, names)
                               for at in range(0, maps, STACK)])
    room = np.where(occupancy[bins] >= floor, occupancy[bins], np.inf)
    v = counts / room
    share = (occupancy / occupancy.sum())[bins]
    r, c = np.divmod(bins, cols)
    beside, common, around = _neighbours(bins, rows, cols)
    down, across = (cols, rows) if lengths_as_published else (rows, cols)
    # all sums over a map that are linear in its rates, by one product
    sums = v @ np.hstack([beside / 8, common / 64, np.stack([share, np.ones(len(bins)), around / 8, r, down - r, c, across - c], axis=1)])
    mean, x, y, *far = sums[:, 2 * len(bins):].T.copy()
    peak, out = v.max(axis=1), {}
    if "information" in names:
        above = np.flatnonzero(v > mean[:, None])
        of, at = np.divmod(above, len(bins))
        some, own = v.ravel()[above], mean[of]
        out["information"] = _ratio(np.bincount(of, some * np.log2(some / own, out=np.zeros(len(own)), where=own > 0) * share[at], maps), mean)
    if "sparsity" in names:
        out["sparsity"] = _ratio(mean * mean, np.einsum("ij,ij,j->i", v, v, share))
    if "selectivity" in names:
        out["selectivity"] = _ratio(peak, mean)
    if "coherence" in names:
        dot = lambda a: np.einsum("ij,ij->i", a, v)
        xx, xy, yy = dot(v), dot(sums[:, :len(bins)]), dot(sums[:, len(bins):2 * len(bins)])
        cxx, cyy = xx - x * x / size, yy - y * y / size
        safe = (cxx > 1e-3 * xx) & (cyy > 1e-3 * yy)
        out["coherence"] = np.divide(xy - x * y / size, np.sqrt(np.where(safe, cxx * cyy, 1)), out=np.zeros(maps), where=safe)
        for at in stacks(~safe & (peak > 0)):
            out["coherence"][at] = _coherence(filled(v[at]).reshape(-1, rows, cols))
    if any(n.startswith("border") for n in names):
        # every bin is active unless the percentile is above 0: a wall is then filled, and the distances are a sum
        apart = [_ratio(d, peak) / size / (min(rows, cols) / 2) for d in far]
        found = [_ratio(1 - d, 1 + d) for d in apart]
        for at in stacks(np.count_nonzero(v, axis=1) >= size - 1 - math.ceil(p * (size - 1))):
            whole = filled(v[at])
            for score, of_full in zip(found, _borders(_ratio(whole, np.broadcast_to(peak[at, None], whole.shape)).reshape(-1, rows, cols), p, lengths_as_published)):
                score[at] = of_full
        out |= zip(NAMES[4:], found)
    return np.where(mean > 0, np.stack([out[n] for n in names]), np.nan).T
