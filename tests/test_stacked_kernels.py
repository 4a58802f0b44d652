"""Kernels that take a whole stack of maps or clouds give what one map at a time gives, and run once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikegrid.functions import grid_kernels as gk
from spikegrid.operators import distances as D, fields as FL

U = np.array(D.lattice_projections(7))


def plain_cost(a, b, p):
    """Transport cost of two weighted samples on a line by their quantiles."""
    def steps(side):
        x, w = map(np.array, zip(*sorted(side)))
        return x, np.cumsum(w) / w.sum()

    (xa, qa), (xb, qb) = steps(a), steps(b)
    q = np.unique(np.concatenate([[0.0], qa, qb]).round(12))
    mid, at = (q[1:] + q[:-1]) / 2, lambda x, c, m: x[np.minimum(np.searchsorted(c, m), len(x) - 1)]
    return float((np.diff(q) * np.abs(at(xa, qa, mid) - at(xb, qb, mid)) ** p).sum())


@pytest.mark.parametrize("weights", [[1.0], [1.0, 2.0, 3.5]])
@pytest.mark.parametrize("p", [1, 2])
def test_clouds_of_many_sizes(weights, p):
    rng = np.random.default_rng(5)
    sizes = np.array([[1, 1], [1, 4], [3, 3], [0, 2], [5, 0], [9, 2], [60, 41], [2, 2]])
    flat = [(n, rng.integers(0, 5, n.sum()).astype(float), rng.random(n.sum()), rng.choice(weights, n.sum())) for n in sizes.T]
    got = D._sliced_rows(*flat, U, p)
    for k, (n, m) in enumerate(sizes):
        if not n or not m:
            assert np.isnan(got[k])
            continue
        part = [[v[sizes[:k, s].sum():sizes[:k + 1, s].sum()] for v in flat[s][1:]] for s in (0, 1)]
        cost = [plain_cost(*[list(zip(ux * x + uy * y, w)) for x, y, w in part], p) for ux, uy in U]
        assert np.isclose(got[k], np.mean(cost) ** (1 / p))


def test_blobs_of_a_stack():
    """Labels go in scan order in every map of a stack; maps do not disturb each other."""
    rng = np.random.default_rng(6)
    masks = np.stack([rng.random((7, 9)) < q for q in (0.0, 0.3, 0.5, 0.6, 0.8, 1.0)])
    assert np.array_equal(gk.components_of(masks), [gk.components(m) for m in masks])
    maps = np.concatenate([rng.random((5, 7, 9)) * (rng.random((5, 7, 9)) < 0.4), np.ones((1, 7, 9)), -rng.random((1, 7, 9))])
    mats = gk.smoothing_matrix(7, gk.gaussian_taps(1.0)), gk.smoothing_matrix(9, gk.gaussian_taps(1.0))
    for smooth in (None, mats):
        assert np.array_equal(gk.blob_labels(maps, smooth), np.concatenate([gk.blob_labels(m[None], smooth) for m in maps]))


def kernels(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")


def test_a_filter_does_not_run_a_kernel_twice(spark):
    """The planner would push a filter on the result below the shuffle, with the kernel in it."""
    rows = [(k, [0, 5, 7][:1 + k % 3], [1.0, 2.0, 3.0][:1 + k % 3], [3], [1.0 - k % 2]) for k in range(30)]
    pairs = spark.createDataFrame(rows, "k int, bins_a array<int>, vals_a array<double>, bins_b array<int>, vals_b array<double>")
    d = D.map_distance(pairs, ["k"], 4, 4, 8.0, 4.0, U).where("distance IS NOT NULL")
    assert kernels(d) == 1 and sorted(r.k for r in d.collect()) == list(range(0, 30, 2))
    maps = spark.createDataFrame([(k, np.random.default_rng(k).random(64).tolist()) for k in range(20)], "k int, rate array<double>")
    lab = FL.blobs(maps, ["k"], "rate", 8, 8, 1.0, no_filter=True).where(F.exists("labels", lambda x: x > 0))
    assert kernels(lab) == 1 and lab.count() == 20
    moved = FL.wrap_fields(FL.blobs(maps, ["k"], "rate", 8, 8, 1.0, no_filter=True), ["k"], "rate", 8, 8).where(F.exists("labels", lambda x: x > 0))
    assert kernels(moved) == 2
    for r in moved.collect():
        inside = sum(v for v, x in zip(r.rate, r.labels) if x > 0)
        assert sum(r.raw) >= inside - 1e-9 and np.isclose(sum(r.blurred), 1.0)


def plain_region(image, peak, share):
    """Bins that reach the peak through bins above its share, and whether a bin outside is shut in."""
    inside = gk.grow(np.eye(1, image.size, peak[0] * image.shape[1] + peak[1]).reshape(image.shape) > 0, image >= image[tuple(peak)] * share)
    return inside, bool(inside.any() and gk.enclosed(inside).any())


def test_regions_of_all_shares_at_once():
    """One pass gives the region of every share, holes and other peaks in it included."""
    rng = np.random.default_rng(7)
    images = gk.smoothing_matrix(12, gk.gaussian_taps(1.0)) @ rng.random((20, 12, 12)) - 0.3
    images[:4] = images[:4].round(1)
    peaks, others = rng.integers(0, 12, (20, 2)), rng.random(images.shape) < 0.02
    search = gk._FieldSearch(images, np.zeros(images.shape, bool), peaks, others)
    for k, (image, peak) in enumerate(zip(images, peaks)):
        for share in (1.0, 0.9, 0.5, 0.2):
            inside, holes = plain_region(image, peak, share)
            assert search.region(k, share) == (inside.sum(), bool(inside.any() and not holes and not (inside & others[k]).any()))
            assert search.closed(k, share) == bool(inside.any() and not holes)


def test_maxima_of_a_stack():
    """A maximum is a part of equal bins, no bin of which touches a higher one."""
    rng = np.random.default_rng(8)
    images = np.concatenate([rng.random((6, 9, 8)).round(1) + 0.1, np.ones((1, 9, 8)), rng.random((5, 9, 8))])
    for img, got in zip(images, gk.plateaus(images, clearance=0)):
        want = []
        for value in np.unique(img):
            lab = gk.components(img == value, True)
            for k in range(1, lab.max() + 1):
                part = lab == k
                beside = gk._spread(part, True) & ~part
                if beside.any() and (img[beside] < value).all():
                    r, c = np.nonzero(part)
                    want.append((int(r.mean()), int(c.mean())))
        assert sorted(map(tuple, got.tolist())) == sorted(want)
    masks = rng.random(images.shape) < 0.01
    far = gk.plateaus(images, masks, 2)
    assert all(np.array_equal(a, gk.plateaus(i[None], m[None], 2)[0]) for a, i, m in zip(far, images, masks))
    assert all(not m[max(0, r - 2):r + 3, max(0, c - 2):c + 3].any() for at, m in zip(gk.plateaus(images[7:], masks[7:], 2), masks[7:]) for r, c in at)


def test_grid_and_fields_of_a_stack():
    rng = np.random.default_rng(9)
    y, x = np.mgrid[:16, :16]
    hexa = [sum(np.cos(2 * np.pi / s * (x * np.cos(t) + y * np.sin(t))) for t in (0, np.pi / 3, 2 * np.pi / 3)) + 3 for s in (5, 6, 7)]
    maps = np.concatenate([hexa, rng.random((5, 16, 16)), np.zeros((1, 16, 16)), np.ones((1, 16, 16))])
    ours, alone = gk.grid_measures(maps), [gk.grid_measures(m) for m in maps]
    assert ours[-2:] == [None, None] and ours[0]["score"] > 0.5
    for a, b in zip(ours, alone):
        assert (a is None) == (b is None)
        assert a is None or all((a[k] is None) == (b[k] is None) and (a[k] is None or np.isclose(a[k], b[k])) for k in a)
    options = dict(min_bins=3, min_mean=0.01, min_peak=0.1, clearance=0)
    assert np.array_equal(gk.place_field_labels(maps, **options), [gk.place_field_labels(m, **options) for m in maps])
    assert np.array_equal(np.concatenate(list(gk.parts(maps))), maps)
