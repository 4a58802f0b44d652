"""Shape features of spike waveforms, for a batch of equally long waveforms at once."""

from __future__ import annotations

import numpy as np

NAMES = ["peak", *[f"f{k}" for k in range(1, 25)]]


def derivative(w: np.ndarray, dt: float) -> np.ndarray:
    d = np.empty_like(w)
    d[:, 1:-1] = (w[:, 2:] - w[:, :-2]) / (2 * dt)
    d[:, 0], d[:, -1] = (w[:, 1] - w[:, 0]) / dt, (w[:, -1] - w[:, -2]) / dt
    return d


def _extreme(w: np.ndarray, sign: int) -> np.ndarray:
    """Interior maxima above 0 (sign 1) or minima below 0 (sign -1)."""
    v = sign * w
    out = np.zeros(w.shape, dtype=bool)
    out[:, 1:-1] = (v[:, 1:-1] > v[:, :-2]) & (v[:, 1:-1] >= v[:, 2:]) & (v[:, 1:-1] > 0)
    return out


def _first_after(mask: np.ndarray, i: np.ndarray) -> np.ndarray:
    cols = np.arange(mask.shape[1])
    m = mask & (cols > i[:, None])
    return np.where(m.any(axis=1), m.argmax(axis=1), -1)


def _last_before(mask: np.ndarray, i: np.ndarray) -> np.ndarray:
    cols = np.arange(mask.shape[1])
    m = mask & (cols < i[:, None])
    return np.where(m.any(axis=1), mask.shape[1] - 1 - m[:, ::-1].argmax(axis=1), -1)


def _steepest(d: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Point of steepest slope between two points, -1 if one of them is missing.

    As published, extrema are numbered from the start of the slice but compared
    with the absolute bounds; without a candidate the middle of the two is taken.
    """
    out = np.full(len(d), -1)
    for s, e in {(int(a), int(b)) for a, b in zip(start, end) if a >= 0 and b >= 0}:
        rows = np.nonzero((start == s) & (end == e))[0]
        part = d[rows, s:e]
        best = np.full(len(rows), (s + e) // 2)
        if part.shape[1] > 2:
            mid, left, right = part[:, 1:-1], part[:, :-2], part[:, 2:]
            hi, lo = np.quantile(part, 0.6, axis=1)[:, None], np.quantile(part, 0.4, axis=1)[:, None]
            ext = ((mid > left) & (mid >= right) & (mid > hi)) | ((mid < left) & (mid <= right) & (mid < lo))
            k = np.arange(1, part.shape[1] - 1)
            ext &= (k > s) & (k < e)
            if ext.any():
                size = np.where(ext, np.abs(d[rows][:, k]), -1.0)
                best = np.where(ext.any(axis=1), k[size.argmax(axis=1)], best)
        out[rows] = best
    return out


def _moment(x: np.ndarray, k: int) -> np.ndarray:
    c = x - x.mean(axis=1, keepdims=True)
    return (c ** k).mean(axis=1) / x.std(axis=1) ** k


def features(w: np.ndarray, dt: float) -> np.ndarray:
    """(n, 25) array: peak amplitude and f1..f24; undefined values are 0."""
    n, length = w.shape
    d, rows = derivative(w, dt), np.arange(n)
    d2 = derivative(d, dt)
    ups, downs = _extreme(w, 1), _extreme(w, -1)
    troughs = downs.copy()
    troughs[:, [0, -1]] = True
    p3 = np.where(ups.any(axis=1), np.where(ups, w, -np.inf).argmax(axis=1), -1)
    p1 = np.where(p3 >= 0, _last_before(troughs, p3), -1)
    p5 = np.where(p3 >= 0, _first_after(troughs, p3), -1)
    ends = ups.copy()
    ends[:, -1] = True
    rp = np.where(p5 >= 0, _first_after(ends, p5), -1)
    p2, p4, p6 = _steepest(d, p1, p3), _steepest(d, p3, p5), _steepest(d, p5, rp)

    def at(a, p):
        return np.where(p >= 0, a[rows, np.maximum(p, 0)], np.nan)

    t = {k: np.where(p >= 0, p * dt, np.nan) for k, p in enumerate((p1, p2, p3, p4, p5, p6), 1)}
    v = {k: at(d, p) for k, p in enumerate((p1, p2, p3, p4, p5, p6), 1)}
    slog = lambda x: np.sign(x) * np.log1p(np.abs(x))
    with np.errstate(all="ignore"):
        slope = lambda a, b: (v[b] - v[a]) / (t[b] - t[a])
        trap = np.concatenate([np.zeros((n, 1)), np.cumsum((w[:, 1:] + w[:, :-1]) / 2 * dt, axis=1)], axis=1)
        area = np.where((p1 >= 0) & (p5 >= 0), trap[rows, np.maximum(p5 - 1, 0)] - trap[rows, np.maximum(p1, 0)], np.nan)
        power = np.cumsum(d ** 2, axis=1) / np.arange(1, length + 1)
        iqr = lambda x: np.subtract(*np.quantile(x, [0.75, 0.25], axis=1))
        out = np.column_stack([
            at(w, p3), t[5] - t[1], v[4] - v[2], v[6] - v[2], area / (t[5] - t[1]), slog(slope(2, 4)), slope(4, 6),
            slog(slope(2, 6)), np.sqrt(at(power, p1)), slope(1, 2) / slope(2, 3), slope(3, 4) / slope(4, 5), v[2] / v[4],
            v[1], v[3], v[4], v[5], v[6], at(d2, p1), at(d2, p3), at(d2, p5), iqr(d), iqr(d2),
            _moment(d, 4), _moment(d, 3), _moment(d2, 3),
        ])
    return np.where(np.isfinite(out), out, 0.0)
