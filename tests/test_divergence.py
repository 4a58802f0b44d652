"""Nearest neighbours across cells, mixtures and divergences against plain loops."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikegrid.operators import divergence as DV

PAIR = ["site", "prev_no", "session_no", "unit_a", "unit_b"]


def three_clusters(seed=1):
    """Unequal clusters with repeated points and points at equal distances."""
    rng = np.random.default_rng(seed)
    points = [rng.normal(0, 1, (300, 3)), rng.normal(20, 3, (60, 3)), rng.normal(-30, 0.1, (15, 3))]
    x = np.round(np.vstack(points), 1)
    return np.vstack([x, x[:40], np.array([[5.0, 5, 5]] * 4), np.array([[100.0, 0, 0], [102, 0, 0], [104, 0, 0]])])


def plain_nearest(x, y):
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    d[d == 0] = np.inf
    return d.min(axis=1)


@pytest.mark.parametrize("rows,most", [(20, 16), (4096, 64)])
def test_nearest_other(spark, rows, most):
    x = three_clusters()
    y = np.vstack([x[::3] + 0.05, x[:30]])
    frame = lambda v, key, first: spark.createDataFrame([(key, first + k, list(map(float, p))) for k, p in enumerate(v)], "site int, id long, v array<double>")
    points = frame(x, 1, 0).unionByName(frame(x[:50], 2, 1000)).unionByName(frame(x[:1], 3, 2000))
    searched = frame(y, 1, 0).unionByName(frame(x[:50], 2, 0)).unionByName(frame(x[:1], 3, 0))
    got = {r.id: r.distance for r in DV.nearest_other(points, searched, ["site"], rows, most).collect()}
    want = dict(enumerate(plain_nearest(x, y))) | {1000 + k: d for k, d in enumerate(plain_nearest(x[:50], x[:50]))}
    assert got.pop(2000) is None and got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


def samples(spark, sizes):
    rng = random.Random(3)
    rows, n = [], 0
    for session, units in sizes.items():
        for label, size in units.items():
            for _ in range(size):
                rows.append((1, session, label, n, [round(rng.gauss(label, 1), 2), round(rng.gauss(session, 2), 2)]))
                n += 1
    return rows, spark.createDataFrame(rows, "site int, session_no int, label int, spike_idx long, features array<double>")


def test_mixture_and_divergence(spark):
    rows, df = samples(spark, {1: {0: 30, 1: 7, 2: 1}, 2: {0: 12, 3: 25}})
    pairs = spark.createDataFrame([(1, 1, 2)], "site int, prev_no int, session_no int")
    mixed = DV.mixtures(df, pairs, ["site"])
    again = DV.mixtures(df.repartition(7), pairs, ["site"])
    key = lambda d: sorted(tuple(r) for r in d.where("in_mixture").select(*PAIR, "side", "spike_idx").collect())
    assert key(mixed) == key(again)
    by = {}
    for r in mixed.collect():
        by.setdefault((r.unit_a, r.unit_b), []).append(r)
    got = {(r.unit_a, r.unit_b): r for r in DV.neighbour_divergence(mixed, PAIR, 2, 5).collect()}
    assert set(by) == set(got) == {(a, b) for a in (0, 1, 2) for b in (0, 3)}
    for pair, part in by.items():
        sides = {s: [r for r in part if r.side == s] for s in "ab"}
        take = min(map(len, sides.values()))
        assert all(sum(r.in_mixture for r in v) == take for v in sides.values())
        whole = np.array([r.features for r in part if r.in_mixture])
        for s, v in sides.items():
            value = got[pair][f"kl_{s}"]
            if len(v) < 2:
                assert value is None
                continue
            x = np.array([r.features for r in v])
            r, q = plain_nearest(x, x), plain_nearest(x, whole)
            want = 2 / len(x) * np.log2(q / r).sum() + math.log2(len(whole) / (len(x) - 1))
            assert math.isclose(value, max(want, 0), rel_tol=1e-9, abs_tol=1e-9)


def test_units_that_fill_many_blocks_and_slices(spark):
    """The same value for units above a slice and a block, with copies of points, and in the middle of three sessions."""
    _, df = samples(spark, {1: {0: 4500, 1: 30}, 2: {0: 700, 2: 4300}, 3: {1: 50}})
    pairs = spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "site int, prev_no int, session_no int")
    mixed = DV.mixtures(df, pairs, ["site"]).drop("first", "draw").where("side = 'a' OR side = 'b'")
    by = {}
    for r in mixed.collect():
        by.setdefault(tuple(r[c] for c in PAIR[1:]), {}).setdefault(r.side, []).append((r.features, r.in_mixture))
    got = {tuple(r[c] for c in PAIR[1:]): r for r in DV.neighbour_divergence(DV.mixtures(df, pairs, ["site"]), PAIR, 2, 1500).collect()}
    assert set(got) == set(by) and len(got) == 6
    positive = 0
    for pair, sides in by.items():
        whole = np.array([v for side in sides.values() for v, taken in side if taken])
        for s, points in sides.items():
            x = np.array([v for v, _ in points])
            r, q = plain_nearest(x, x), plain_nearest(x, whole)
            want = 2 / len(x) * np.log2(q / r).sum() + math.log2(len(whole) / (len(x) - 1))
            assert math.isclose(got[pair][f"kl_{s}"], max(want, 0), rel_tol=1e-9, abs_tol=1e-9)
            positive += want > 0
    assert positive


def test_a_point_travels_once_for_each_block(spark):
    """Not once for each pair of its unit and each cell."""
    _, df = samples(spark, {s: {u: 20 + u for u in range(6)} for s in (1, 2)})
    pairs = spark.createDataFrame([(1, 1, 2)], "site int, prev_no int, session_no int")
    mixed = DV.mixtures(df, pairs, ["site"])
    assert mixed.count() == 6 * df.count() and mixed.where("first").count() == df.count()
    sizes = mixed.groupBy(*PAIR, "side").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_mixture").alias("_in"))
    for rows, most in ((1000, 2), (50, 6)):
        left, right, tile = DV._sent(mixed, sizes, PAIR, rows)
        copies = left.where("draw IS NOT NULL").unionByName(right, allowMissingColumns=True)
        assert copies.count() <= most * df.count()
        assert copies.groupBy(*tile, "no").count().agg(F.max("count")).first()[0] <= (rows if rows < 1000 else df.count())


def test_least_distance_through_cells():
    """Cells of points far apart are left out, and the least distance is the same to the last bit."""
    rng = np.random.default_rng(8)
    x = np.round(np.vstack([rng.normal(c, 0.3, (400, 3)) for c in range(0, 60, 6)]), 2)
    rng.shuffle(x)
    for a, b in ((x, x), (x[:500] + 0.005, x), (x, x[:300]), (np.ones((5, 3)), np.ones((3000, 3))), (np.vstack([x[:50], [[np.nan, 0, 0]]]), x)):
        assert np.array_equal(DV.least_in_cells(a, b, 100), DV._least_plain(a, b), equal_nan=True)


def test_points_at_one_place(spark):
    rows = [(1, s, 0, 10 * s + k, [1.0, 2.0]) for s in (1, 2) for k in range(4)]
    df = spark.createDataFrame(rows, "site int, session_no int, label int, spike_idx long, features array<double>")
    pairs = spark.createDataFrame([(1, 1, 2)], "site int, prev_no int, session_no int")
    assert [tuple(r)[-3:] for r in DV.neighbour_divergence(DV.mixtures(df, pairs, ["site"]), PAIR, 2).collect()] == [(None, None, None)]


def test_least_distance_by_matrix_product():
    """The product finds what all differences give, to the last bit, in a fraction of their time."""
    rng = np.random.default_rng(3)
    near = np.round(rng.normal(0, 1, (300, 3)), 1)
    copies = np.vstack([rng.normal(0, 1, (100, 64)), np.ones((300, 64))])
    for x in (near, near * 1e6 + 1e9, near * 1e-170, near * 1e160, copies, np.ones((5, 2)), np.vstack([near, [[np.nan, 0, 0]]]), np.vstack([near, [[np.inf, 0, 0]]])):
        for y in (x, x[::3], x[:1]):
            with np.errstate(all="ignore"):
                assert np.array_equal(DV.least_positive(x, y), DV._least_plain(x, y), equal_nan=True)
    x = rng.normal(0, 1, (1500, 64))
    spent = []
    for least in (DV.least_positive, DV._least_plain):
        least(x[:10], x)
        begin = time.thread_time()
        least(x, x)
        spent.append(time.thread_time() - begin)
    assert spent[0] < spent[1] / 2
