"""Small NumPy helpers that work on one map (at most rows x cols values).

Spark partitions the maps; each helper sees a single, bounded grid.
"""

from __future__ import annotations

import math

import numpy as np


# ------------------------------------------------------------------ smoothing
def gaussian_taps(factor: float) -> np.ndarray:
    """Un-normalised taps: length int(8 f), deviation int(0.2 length)."""
    n = int(8 * factor)
    sd = int(0.2 * n)
    if sd < 1:
        raise ValueError("the smoothing factor is too small for a kernel")
    k = np.arange(n) - (n - 1) / 2
    return np.exp(-0.5 * (k / sd) ** 2)


def mirror(i: int, n: int) -> int:
    """Index of a mirror border that does not repeat the edge."""
    if n == 1:
        return 0
    i = abs(i) % (2 * n - 2)
    return i if i < n else 2 * n - 2 - i


def smoothing_matrix(n: int, taps: np.ndarray) -> np.ndarray:
    """1-D correlation with ``taps`` and mirror border as a matrix."""
    out = np.zeros((n, n))
    anchor = len(taps) // 2
    for i in range(n):
        for k, g in enumerate(taps):
            out[i, mirror(i + k - anchor, n)] += g
    return out


AT_ONCE = 1 << 14       # bins of the maps that one kernel call takes together


def parts(stack: np.ndarray):
    """The maps of a stack, as many together as keep temporary arrays in the cache."""
    step = max(1, AT_ONCE // max(1, stack[0].size if len(stack) else 1))
    return (stack[k:k + step] for k in range(0, len(stack), step))


# ------------------------------------------------------------ regions of a map
def _spread(cur: np.ndarray, diagonal: bool) -> np.ndarray:
    """One step of dilation by a cross, or by a 3 x 3 block."""
    out = cur.copy()
    out[:, 1:] |= cur[:, :-1]
    out[:, :-1] |= cur[:, 1:]
    src = out.copy() if diagonal else cur
    out[1:] |= src[:-1]
    out[:-1] |= src[1:]
    return out


def grow(seed: np.ndarray, mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """All bins of ``mask`` connected to ``seed``."""
    cur = seed & mask
    size = np.count_nonzero(cur)
    while True:
        cur = _spread(cur, diagonal)
        cur &= mask
        now = np.count_nonzero(cur)
        if now == size:
            return cur
        size = now


def components(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Labels 1..n in scan order, 0 outside the mask."""
    out = np.zeros(mask.shape, dtype=np.int32)
    todo, n = mask.copy(), 0
    while todo.any():
        n += 1
        seed = np.zeros_like(mask)
        seed.flat[np.argmax(todo)] = True
        region = grow(seed, todo, diagonal)
        out[region] = n
        todo &= ~region
    return out


def enclosed(region: np.ndarray) -> np.ndarray:
    """Bins outside the region that cannot reach the border."""
    r, c = np.flatnonzero(region.any(axis=1)), np.flatnonzero(region.any(axis=0))
    out = np.zeros_like(region)
    if r[-1] - r[0] < 2 or c[-1] - c[0] < 2:
        return out
    part = (slice(r[0], r[-1] + 1), slice(c[0], c[-1] + 1))
    free = ~region[part]
    rim = free.copy()
    rim[1:-1, 1:-1] = False
    out[part] = free & ~grow(rim, free)
    return out


def plateaus(images: np.ndarray, masks: np.ndarray | None = None, clearance: int = 4) -> list[np.ndarray]:
    """(row, col) of the 8-connected maxima of each map of a stack farther than ``clearance`` bins
    from empty or masked bins."""
    count, n, m = images.shape
    size, img = n * m, images.copy()
    low = np.nanmin(img, axis=(1, 2), keepdims=True)
    if masks is not None:
        img = np.where(masks, low, img)
    empty = img == 0 if masks is None else (img == 0) | masks
    near = _dilated(empty, clearance)
    p = np.pad(img, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
    shifts = [np.s_[:, a:a + n, b:b + m] for a in range(3) for b in range(3) if (a, b) != (1, 1)]
    candidate = np.all([img >= p[q] for q in shifts], axis=0)
    # bins of one value that touch, named by their first bin; bins of the least value rise nowhere
    named = np.broadcast_to(np.arange(size).reshape(1, n, m), img.shape).copy()
    least = img == low
    same = [(q, (img == p[q]) & ~least) for q in shifts]
    same = [(q, s) for q, s in same if s.any()]
    while same:
        around = np.pad(named, ((0, 0), (1, 1), (1, 1)))
        found = named
        for q, s in same:
            found = np.where(s, np.minimum(found, around[q]), found)
        found = np.take_along_axis(found.reshape(count, size), found.reshape(count, size), axis=1).reshape(img.shape)
        if np.array_equal(found, named):
            break
        named = found
    key = (named + size * np.arange(count)[:, None, None]).ravel()
    held, total = candidate.ravel() & ~least.ravel(), count * size
    # an equal bin beyond the plateau may rise further
    bins, full = np.bincount(key, minlength=total), np.bincount(key[held], minlength=total)
    top = np.flatnonzero((full == bins) & (bins > 0) & (bins < size))
    r, c = (np.bincount(key, np.broadcast_to(v, img.shape).ravel(), total)[top] / bins[top] for v in (np.arange(n)[:, None], np.arange(m)))
    of = top // size
    free = ~near[of, np.rint(r).astype(int), np.rint(c).astype(int)]
    at = np.stack([r, c], axis=1)[free].astype(int)
    return np.split(at, np.searchsorted(of[free], np.arange(1, count))) if count else []


def _dilated(masks: np.ndarray, steps: int) -> np.ndarray:
    """Masks dilated by a 3 x 3 block several times."""
    out = masks
    for _ in range(steps):
        p = np.pad(out, ((0, 0), (1, 1), (1, 1)))
        rows = p[:, :-2] | p[:, 1:-1] | p[:, 2:]
        out = rows[:, :, :-2] | rows[:, :, 1:-1] | rows[:, :, 2:]
    return out


# ------------------------------------------------- smoothing with empty places
def visible_matrix(n: int, sigma: float, circular: bool) -> np.ndarray:
    """1-D Gaussian weights as a matrix; the reach is four deviations (an odd number of taps). The
    end values go on beyond the ends, or the ends meet."""
    reach = int(np.ceil(8 * sigma)) // 2
    offsets = np.arange(-reach, reach + 1)
    taps = np.exp(-0.5 * (offsets / sigma) ** 2)
    out = np.zeros((n, n))
    for i in range(n):
        at = (i + offsets) % n if circular else np.clip(i + offsets, 0, n - 1)
        np.add.at(out[i], at, taps / taps.sum())
    return out


# ----------------------------------------------------------------- thinning
def thin(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which points stay if, in the given order, a point closer than ``least`` to one that
    stays is dropped. Points that stay are found by cell: only nine cells can hold one so near."""
    kept: dict[tuple[int, int], list[int]] = {}
    stay = np.zeros(len(x), bool)
    for k, cell in enumerate(zip(np.floor(x / least).astype(int).tolist(), np.floor(y / least).astype(int).tolist())):
        near = (j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in kept.get((cell[0] + a, cell[1] + b), ()))
        if all(math.sqrt((x[k] - x[j]) ** 2 + (y[k] - y[j]) ** 2) >= least for j in near):
            stay[k] = True
            kept.setdefault(cell, []).append(k)
    return stay


# ------------------------------------------------------------- moved fields
def reflected_blur(n: int, sigma: float) -> np.ndarray:
    """1-D Gaussian of four deviations' reach as a matrix; the border mirrors with its edge repeated."""
    reach = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    out = np.zeros((n, n))
    for i in range(n):
        for d, g in zip(range(-reach, reach + 1), taps / taps.sum()):
            j = (i + d) % (2 * n)
            out[i, j if j < n else 2 * n - 1 - j] += g
    return out


def wrapped_fields(rate: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Null map: each field goes with its peak to a random bin, around the edges; bins where
    fields meet add up. Bins that a field left empty get values of the bins that fields now
    cover, each once before one is used again; all other bins stay."""
    size, (rows, cols) = np.array(rate.shape), rate.shape
    values, label = rate.ravel(), labels.ravel()
    by_label, ends = np.argsort(label, kind="stable"), np.cumsum(np.bincount(label))
    out, taken, covered = np.zeros(rate.size), np.zeros(rate.size, bool), []
    for k in rng.permutation(len(ends) - 1) + 1:
        bins = by_label[ends[k - 1]:ends[k]]
        held = values[bins]
        move_r, move_c = rng.integers(0, size) - divmod(bins[np.argmax(held)], cols)
        r, c = np.divmod(bins, cols)
        to = (r + move_r) % rows * cols + (c + move_c) % cols
        covered.append(values[to][label[to] == 0])
        out[to] += held
        taken[to] = True
    rest = ~taken & (label == 0)
    out[rest] = values[rest]
    holes = np.flatnonzero(~taken & (label > 0))
    covered = np.concatenate([*covered, np.zeros(0)])
    if len(covered):
        drawn = np.concatenate([rng.permutation(covered) for _ in range(-(-len(holes) // len(covered)))] or [np.zeros(0)])
        out[holes] = drawn[:len(holes)]
    return out.reshape(rate.shape)


# -------------------------------------------------------------------- blobs
def components_of(masks: np.ndarray) -> np.ndarray:
    """4-connected labels 1..n in scan order of each of a stack of masks, 0 outside."""
    count, rows, cols = masks.shape
    size, every = rows * cols, np.arange(rows * cols)
    # each bin names a bin of its region that lies no later; it goes on to the least that its neighbours name
    least = np.full((count, rows + 2, cols + 2), size)
    inner, outside = least[:, 1:-1, 1:-1], ~masks
    inner[masks] = np.broadcast_to(every.reshape(rows, cols), masks.shape)[masks]
    while masks.any():
        found = np.minimum(np.minimum(least[:, :-2, 1:-1], least[:, 2:, 1:-1]), np.minimum(least[:, 1:-1, :-2], least[:, 1:-1, 2:]))
        np.minimum(found, inner, out=found)
        found[outside] = size
        flat = np.append(found.reshape(count, size), np.full((count, 1), size), axis=1)
        found = np.take_along_axis(flat, flat[:, :-1], axis=1).reshape(masks.shape)
        if np.array_equal(found, inner):
            break
        inner[...] = found
    named = inner.reshape(count, size)
    number = np.cumsum((named == every) & masks.reshape(count, size), axis=1, dtype=np.int32)
    number = np.append(number, np.zeros((count, 1), np.int32), axis=1)
    return np.take_along_axis(number, named, axis=1).reshape(masks.shape)


def otsu(images: np.ndarray) -> np.ndarray:
    """Threshold of each 8-bit image of a stack with the largest between-class variance."""
    count = len(images)
    at = images.reshape(count, -1) + 256 * np.arange(count)[:, None]
    hist = np.bincount(at.ravel(), minlength=256 * count).reshape(count, 256).astype(float)
    total, levels = hist.sum(axis=1, keepdims=True), np.arange(256)
    w0 = np.cumsum(hist, axis=1)
    m0 = np.cumsum(hist * levels, axis=1)
    w1 = total - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = w0 * w1 * (m0 / w0 - (m0[:, -1:] - m0) / w1) ** 2
    return np.argmax(np.where((w0 > 0) & (w1 > 0), between, -1), axis=1)


def blob_labels(rates: np.ndarray, smooth: np.ndarray | None, low=0.2, high=0.8, min_share=0.01) -> np.ndarray:
    """Two rounds of noise floor, Otsu threshold and 4-connected labels, for a stack of maps.

    ``smooth`` is the pair of smoothing matrices packed as (rows, cols), or None
    for a single round without size filter.
    """
    flat = rates.reshape(len(rates), -1)
    bounds = np.quantile(flat, [low, high], axis=1)
    floor = np.array([v[v <= q].mean() if q != 0 or v.min() < 0 else 0.0 for v, q in zip(flat, bounds[0])])
    img = np.where(flat <= bounds[1][:, None], floor[:, None], flat).reshape(rates.shape)
    above = lambda u8: components_of(u8 > otsu(u8)[:, None, None])
    u8 = np.clip(img * 255, 0, 255).astype(np.uint8)
    labels = above(u8)
    if smooth is None:
        return labels
    n = flat.shape[1] + 1
    sizes = np.bincount((labels.reshape(len(rates), -1) + n * np.arange(len(rates))[:, None]).ravel(), minlength=n * len(rates)).reshape(-1, n)
    keep = sizes > flat.shape[1] * min_share
    keep[:, 0] = False
    img = np.where(np.take_along_axis(keep, labels.reshape(len(rates), -1), axis=1).reshape(rates.shape), u8, 0).astype(float)
    out, seen = np.zeros_like(labels), img.max(axis=(1, 2)) > 0
    if seen.any():
        img = img[seen]
        img = smooth[0] @ (img / img.max(axis=(1, 2), keepdims=True)) @ smooth[1].T
        out[seen] = above((img / img.max(axis=(1, 2), keepdims=True) * 255).astype(np.uint8))
    return out


# -------------------------------------------------------------- place fields
def _around(p: np.ndarray, diagonal: bool, best) -> np.ndarray:
    """``best`` (np.maximum or np.minimum) over each bin and its neighbours, for a stack with a border."""
    rows = best(best(p[:, :-2], p[:, 1:-1]), p[:, 2:])
    if diagonal:
        return best(best(rows[:, :, :-2], rows[:, :, 1:-1]), rows[:, :, 2:])
    return best(best(rows[:, :, 1:-1], p[:, 1:-1, :-2]), p[:, 1:-1, 2:])


def _settled(start: np.ndarray, limit: np.ndarray, diagonal: bool, down: bool = False) -> np.ndarray:
    """Each map's ``start`` raised by its neighbours, never above ``limit`` (``down``: lowered, never
    below it), until nothing changes."""
    best, bound, edge = (np.minimum, np.maximum, np.inf) if down else (np.maximum, np.minimum, -np.inf)
    p = np.full((len(start), start.shape[1] + 2, start.shape[2] + 2), edge)
    inner = p[:, 1:-1, 1:-1]
    inner[...] = start
    while True:
        found = bound(_around(p, diagonal, best), limit)
        if np.array_equal(found, inner):
            return found
        inner[...] = found


def _erode_open(images: np.ndarray) -> np.ndarray:
    """Erosion by a cross, then reconstruction under the original image, for a stack."""
    p = np.pad(images, ((0, 0), (1, 1), (1, 1)), mode="edge")
    return _settled(_around(p, False, np.minimum), images, True)


class _FieldSearch:
    """Regions around one peak in each map of a stack, at shares of the peak's value.

    ``reach`` is the highest level at which a bin is connected to its peak, ``leave`` the level
    from which a bin has a way to the border: so one pass serves all shares."""

    def __init__(self, images: np.ndarray, unvisited: np.ndarray, peaks: np.ndarray, others: np.ndarray):
        count, every = len(images), np.arange(len(images))
        self.top = images[every, peaks[:, 0], peaks[:, 1]]
        start = np.full(images.shape, -np.inf)
        start[every, peaks[:, 0], peaks[:, 1]] = self.top
        reach = _settled(start, images, False)
        start = np.full(images.shape, np.inf)
        for edge in (np.s_[:, 0], np.s_[:, -1], np.s_[:, :, 0], np.s_[:, :, -1]):
            start[edge] = reach[edge]
        leave = _settled(start, reach, False, down=True)
        flat = lambda m: m.reshape(count, -1)
        self.reach, self.leave, self.visited, self.others = flat(reach), flat(leave), ~flat(unvisited), flat(others)
        self.found: dict[float, tuple[list, list]] = {}

    def region(self, k: int, share: float) -> tuple[int, bool]:
        """(bins, ok) of the part above ``share`` of the peak's value in map k."""
        if share not in self.found:
            level = (self.top * share)[:, None]
            inside = self.reach >= level
            bad = ~inside & (self.leave >= level) & self.visited | inside & self.others
            size = np.count_nonzero(inside, axis=1)
            self.found[share] = size.tolist(), ((size > 0) & ~bad.any(axis=1)).tolist()
        sizes, ok = self.found[share]
        return sizes[k], ok[k]

    def closed(self, k: int, share: float) -> bool:
        """Whether the region exists and encloses no visited bin."""
        level = self.top[k] * share
        return self.top[k] >= level and not (~(self.reach[k] >= level) & (self.leave[k] >= level) & self.visited[k]).any()

    def growth(self, k: int, first: float, second: float):
        a, ok_a = self.region(k, first)
        if not ok_a:
            return None
        b, ok_b = self.region(k, second)
        if not ok_b:
            return None
        return b / a, b

    def expand(self, k: int, start: float, low: float, step: float) -> float | None:
        """The share at which the field of map k ends, None without a field."""
        change, share = self.growth(k, start, start - step), start
        if change is None:
            for j in np.linspace(start + 0.01, 1.0, 4).tolist():
                change = self.growth(k, j, j - 0.01)
                if change is not None:
                    share = j - 0.01
                    break
        if change is None:
            return share + 0.01 if self.closed(k, share + 0.01) else None
        initial, area = change
        best, shrinks, still = None, 0, 0
        for level in np.round(np.linspace(share, low, int((share - low) / step) + 1), 2).tolist():
            size, ok = self.region(k, level)
            if not ok:
                break
            ratio = size / area
            shrinks = shrinks + 1 if ratio < 1 else 0
            still = still + 1 if ratio == 1 else 0
            if math.floor(ratio / initial) > 2 or shrinks >= 3 or still >= 10:
                break
            area, best = size, level
        return best


def place_field_labels(
    rates: np.ndarray, min_bins=9, min_mean=0.1, min_peak=1.0, start=0.96, low=0.2, step=0.02, peaks=None,
    clearance=4,
) -> np.ndarray:
    """Labels of the firing fields of each rate map of a stack, or of one map (NaN = never visited).

    The peaks of a map are searched one after another; the first ones of all maps go together,
    then the second ones, and so on."""
    if rates.ndim == 2:
        return place_field_labels(rates[None], min_bins, min_mean, min_peak, start, low, step, peaks, clearance)[0]
    unvisited = np.isnan(rates)
    finite = np.where(unvisited, 0.0, rates)
    out = np.zeros(rates.shape, dtype=np.int32)
    images, live = _erode_open(finite), finite.max(axis=(1, 2)) > 0
    lists = [peaks] * len(rates) if peaks is not None else plateaus(images, clearance=clearance)
    lists = [at[(finite[k][at[:, 0], at[:, 1]] >= min_peak) & live[k]] for k, at in enumerate(lists)]
    tops = images.max(axis=(1, 2)) * 1.5
    images = np.where((images < min_peak) & (images > 0.01), tops[:, None, None], images)
    number = np.zeros(len(rates), dtype=np.int32)
    for turn in range(max(map(len, lists), default=0)):
        maps = np.array([k for k, at in enumerate(lists) if len(at) > turn])
        others = np.zeros((len(maps), *rates.shape[1:]), bool)
        for j, k in enumerate(maps):
            at = np.delete(lists[k], turn, axis=0)
            others[j, at[:, 0], at[:, 1]] = True
        search = _FieldSearch(images[maps], unvisited[maps], np.array([lists[k][turn] for k in maps]), others)
        for j, k in enumerate(maps):
            share = search.expand(j, start, low, step)
            if share is None:
                continue
            region = (search.reach[j] >= search.top[j] * share).reshape(rates.shape[1:])
            images[k][region] = tops[k]
            if region.sum() >= min_bins and finite[k][region].mean() >= min_mean:
                number[k] += 1
                out[k][region] = number[k]
    return out


# -------------------------------------------------- autocorrelogram, grid score
def autocorrelogram(a: np.ndarray, share: float = 1.8) -> np.ndarray:
    """Normalised correlation of each map of a stack with itself at every offset, central part (or of one map)."""
    if a.ndim == 2:
        return autocorrelogram(a[None], share)[0]
    flat = a.reshape(len(a), -1)
    flat = np.nan_to_num(flat) - np.minimum(0.0, np.nanmin(flat, axis=1, keepdims=True))
    a = (flat - flat.mean(axis=1, keepdims=True)).reshape(a.shape)     # correlations do not change, rounding errors shrink
    n, m = a.shape[1:]
    shape = (2 * n - 1, 2 * m - 1)
    flip = a[:, ::-1, ::-1]
    one = np.fft.rfft2(np.ones((n, m)), shape)

    def full(p, q):
        return np.fft.irfft2(p * q, shape)

    seen = lambda v: np.fft.rfft2(v, shape)
    fa, fb = seen(a), seen(flip)
    count = np.round(full(one, one))
    s1, s2 = full(fa, one), full(one, fb)
    q1, q2 = full(seen(a * a), one), full(one, seen(flip * flip))
    num = full(fa, fb) - s1 * s2 / count
    left, right = q1 - s1 ** 2 / count, q2 - s2 ** 2 / count
    # an overlap without spread on either side has no correlation; less than this is rounding
    enough = lambda v: v > 1e-10 * v.max(axis=(1, 2), keepdims=True)
    spread = enough(left) & enough(right)
    r = np.divide(num, np.sqrt(np.where(spread, left * right, 1.0)), out=np.zeros_like(num), where=spread)
    r = np.clip(r, -1, 1)
    keep = [slice(None)]
    for size, length in zip(shape, (n, m)):
        k = int(round(share * length))
        k -= 1 - k % 2
        lo = (size - k) // 2
        keep.append(slice(lo, lo + k))
    return r[tuple(keep)]


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """Bilinear rotation about the centre, zero outside; of a map or of each map of a stack."""
    n, m = image.shape[-2:]
    t = math.radians(degrees)
    y, x = np.mgrid[:n, :m].astype(float)
    cy, cx = n / 2 - 0.5, m / 2 - 0.5
    sx = math.cos(t) * (x - cx) - math.sin(t) * (y - cy) + cx
    sy = math.sin(t) * (x - cx) + math.cos(t) * (y - cy) + cy
    p = np.pad(image, [(0, 0)] * (image.ndim - 2) + [(1, 1)] * 2)
    sx, sy = np.clip(sx + 1, 0, m + 1), np.clip(sy + 1, 0, n + 1)
    x0, y0 = np.minimum(sx.astype(int), m), np.minimum(sy.astype(int), n)
    fx, fy = sx - x0, sy - y0
    return (
        p[..., y0, x0] * (1 - fx) * (1 - fy) + p[..., y0, x0 + 1] * fx * (1 - fy)
        + p[..., y0 + 1, x0] * (1 - fx) * fy + p[..., y0 + 1, x0 + 1] * fx * fy
    )


def _pearson(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of the rows of two stacks, NaN without spread."""
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    d = np.sqrt(dot(a, a) * dot(b, b))
    return np.divide(dot(a, b), d, out=np.full(len(a), np.nan), where=d > 0)


def ellipse(x: np.ndarray, y: np.ndarray):
    """Direct least-squares ellipse: (x0, y0, long radius, short radius, tilt)."""
    mx, my = x.mean(), y.mean()
    sx, sy = max(np.ptp(x) / 2, 1e-12), max(np.ptp(y) / 2, 1e-12)
    u, v = (x - mx) / sx, (y - my) / sy
    quad = np.c_[u * u, u * v, v * v]
    lin = np.c_[u, v, np.ones_like(u)]
    t = -np.linalg.pinv(lin.T @ lin) @ (quad.T @ lin).T
    m = quad.T @ quad + (quad.T @ lin) @ t
    m = np.array([m[2] / 2, -m[1], m[0] / 2])
    w, vec = np.linalg.eig(m)
    vec = np.real(vec)
    good = np.nonzero(4 * vec[0] * vec[2] - vec[1] ** 2 > 0)[0]
    if not len(good):
        return None
    a, b, c = vec[:, good[0]]
    d, e, f = t @ vec[:, good[0]]
    # back to the original scale
    A, B, C = a / sx ** 2, b / (sx * sy), c / sy ** 2
    D = d / sx - 2 * a * mx / sx ** 2 - b * my / (sx * sy)
    E = e / sy - 2 * c * my / sy ** 2 - b * mx / (sx * sy)
    F = (a * mx ** 2 / sx ** 2 + b * mx * my / (sx * sy) + c * my ** 2 / sy ** 2 - d * mx / sx - e * my / sy + f)
    det = 4 * A * C - B * B
    x0, y0 = (B * E - 2 * C * D) / det, (B * D - 2 * A * E) / det
    level = -(F + (D * x0 + E * y0) / 2)
    lam, axes = np.linalg.eigh(np.array([[A, B / 2], [B / 2, C]]))
    radii = np.sqrt(np.abs(level / lam))
    k = int(np.argmax(radii))
    return x0, y0, float(radii[k]), float(radii[1 - k]), float(np.arctan2(axes[1, k], axes[0, k]))


def _fold_orientation(deg: np.ndarray):
    """Mean and deviation of directions folded to +-30 degrees of the 60 degree axes."""
    d = deg % 60
    d = np.where(np.abs(d - 60) < np.abs(d), d - 60, d)
    if np.mean(np.abs(np.abs(d) - 30)) < np.mean(np.abs(d)):
        d = -np.abs(d) if np.median(d) < 0 else np.abs(d)
    mean, sd = d.mean(), d.std()
    return (mean - 60 if abs(mean - 60) < abs(mean) else mean), sd


def _ring_steps(ac: np.ndarray, spun: dict[int, np.ndarray], core: int, radii: np.ndarray) -> np.ndarray:
    """(map, radius): by how much rings around the core agree more with themselves at 60 than at 30 degrees."""
    half = np.ceil(np.array(ac.shape[1:]) / 2)
    y, x = np.mgrid[:ac.shape[1], :ac.shape[2]] + 1
    dist = np.hypot(x - half[1], y - half[0])
    smaller = lambda a, b: np.where(b < a, b, a)
    larger = lambda a, b: np.where(b > a, b, a)
    steps: dict[int, np.ndarray] = {}
    for radius in dict.fromkeys(radii.tolist()):
        ring = (dist > core) & (dist < radius)
        if ring.sum() < 3:
            steps[radius] = np.full(len(ac), np.nan)
            continue
        r = {a: _pearson(ac[:, ring], img[:, ring]) for a, img in spun.items()}
        steps[radius] = smaller(r[60], r[120]) - larger(larger(r[30], r[90]), r[150])
    return np.stack([steps[r] for r in radii.tolist()], axis=1)


def _best_mean(steps: np.ndarray) -> np.ndarray:
    """The largest mean of three radii in a row (the last three left out) for each map, NaN without any."""
    n = max(steps.shape[1] - 3, 1)
    runs = steps[:, None] if n == 1 else np.lib.stride_tricks.sliding_window_view(steps, 3, axis=1)[:, :n]
    known = ~np.isnan(runs)
    held = known.sum(axis=2)
    mean = np.divide(np.where(known, runs, 0.0).sum(axis=2), held, out=np.full(held.shape, -np.inf), where=held > 0)
    best = mean.max(axis=1)
    return np.where(best > -np.inf, best, np.nan)


def grid_measures(rates: np.ndarray, min_separation_deg: float = 15.0) -> list[dict | None] | dict | None:
    """Grid score and grid statistics of each rate map of a stack (or of one map)."""
    if rates.ndim == 2:
        return grid_measures(rates[None], min_separation_deg)[0]
    out: list[dict | None] = [None] * len(rates)
    ac = autocorrelogram(rates)
    top = ac.max(axis=(1, 2))
    live = np.flatnonzero(top > 0)
    ac = ac[live] / top[live, None, None]
    shape = np.array(ac.shape[1:])
    mid = (np.ceil(shape / 2).astype(int) - 1)[None]
    fields = place_field_labels(ac, min_bins=5, min_mean=0, min_peak=0, start=0.95, peaks=mid)
    cores = np.floor(np.sqrt((fields == 1).sum(axis=(1, 2)) / math.pi)).astype(int)
    outer = int(shape.min() / 2)
    spun = {a: rotate(ac, a) for a in (30, 60, 90, 120, 150)}
    scores, best = np.full(len(ac), np.nan), np.zeros(len(ac), int)
    for core in np.unique(cores[(cores > 0) & (cores < outer)]).tolist():
        maps = np.flatnonzero(cores == core)
        radii = np.linspace(max(3, core + 1), outer, outer - core).astype(int)
        steps = _ring_steps(ac[maps], {a: img[maps] for a, img in spun.items()}, core, radii)
        maps, steps = maps[~np.isnan(steps).all(axis=1)], steps[~np.isnan(steps).all(axis=1)]
        scores[maps], best[maps] = _best_mean(steps), radii[np.nanargmax(steps, axis=1)]
    seen = np.flatnonzero(~np.isnan(scores))
    centre = shape / 2 - 0.5
    yy, xx = np.mgrid[:shape[0], :shape[1]]
    away = np.hypot(xx - centre[1], yy - centre[0])
    masks = (away >= best[seen, None, None] * 1.25) | (away <= cores[seen, None, None] * 1.5)
    for k, peaks in zip(seen, plateaus(ac[seen], masks)):
        out[live[k]] = {"score": float(scores[k]), **_lattice(peaks, centre, min_separation_deg)}
    return out


def _lattice(peaks: np.ndarray, centre: np.ndarray, min_separation_deg: float) -> dict:
    """Spacing, orientation and shape of the six fields around the centre, if there are six."""
    out = {"spacing": None, "orientation": None, "orientation_std": None, "aspect": None, "tilt": None}
    if len(peaks) >= 6:
        dy, dx = (peaks - centre).T
        angle, far = np.arctan2(dy, dx), np.hypot(dy, dx)
        order, kept = np.argsort(far, kind="stable"), []
        limit = math.radians(min_separation_deg)
        for k in order:
            gaps = [abs(math.atan2(math.sin(angle[k] - angle[j]), math.cos(angle[k] - angle[j]))) for j in kept]
            if all(g >= limit for g in gaps):
                kept.append(k)
        kept = np.array(kept[:6])
        kept = kept[np.argsort(angle[kept], kind="stable")]
        out["spacing"] = float(far[kept][:3].mean())
        mean, sd = _fold_orientation(np.degrees(angle[kept][:3]) % 180)
        out["orientation"], out["orientation_std"] = float(mean), float(sd)
        fit = ellipse(peaks[kept][:, 1].astype(float), peaks[kept][:, 0].astype(float)) if len(kept) > 4 else None
        if fit and fit[3] > 0:
            out["aspect"], out["tilt"] = fit[2] / fit[3], math.degrees(fit[4] + math.pi) % 360
    return out
