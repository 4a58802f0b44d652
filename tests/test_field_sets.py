"""Moved fields, sampling points, slots and field sets on literal cases."""

import math

import numpy as np
import pytest

from spikegrid.functions import grid_kernels as gk
from spikegrid.operators import asof, distances as D, fields as FL


def case():
    """6 x 6, two fields: a 2 x 2 block and a single bin; other bins hold 1, 2, 3 ..."""
    rate = np.arange(1.0, 37.0).reshape(6, 6)
    labels = np.zeros((6, 6), int)
    labels[0:2, 0:2] = 1
    labels[4, 4] = 2
    rate[0:2, 0:2], rate[4, 4] = [[100, 110], [120, 190]], 500
    return rate, labels


class Drawn:
    """A generator whose draws are written down."""

    def __init__(self, order, targets):
        self.order, self.targets = [np.array(order)], list(targets)

    def permutation(self, what):
        return self.order.pop() if self.order else np.array(what)[::-1]

    def integers(self, low, high):
        return np.array(self.targets.pop(0))


def test_fields_move_around_the_edges():
    rate, labels = case()
    # field 1 (peak 190 at 1, 1) goes to (0, 5): its bins lie at rows 5 and 0, columns 4 and 5; field 2 to (2, 2)
    out = gk.wrapped_fields(rate, labels, Drawn([0, 1], [(0, 5), (2, 2)]))
    want = rate.copy()
    covered = [rate[5, 4], rate[5, 5], rate[0, 4], rate[0, 5], rate[2, 2]]
    want[5, 4], want[5, 5], want[0, 4], want[0, 5], want[2, 2] = 100, 110, 120, 190, 500
    holes = [(0, 0), (0, 1), (1, 0), (1, 1), (4, 4)]
    for at, v in zip(holes, covered[::-1]):
        want[at] = v
    assert np.array_equal(out, want)
    assert sorted(out.ravel()) == sorted(rate.ravel()) and not np.array_equal(out, rate)


def test_fields_that_meet_add_up():
    rate, labels = case()
    out = gk.wrapped_fields(rate, labels, Drawn([1, 0], [(3, 3), (3, 3)]))
    assert out[3, 3] == 690 and out[2, 2] == 100 and np.isfinite(out).all()


@pytest.mark.parametrize("seed", range(5))
def test_rates_are_kept_without_overlap(seed):
    rate, labels = case()
    labels[4, 4], rate[4, 4] = 0, 29.0
    out = gk.wrapped_fields(rate, labels, np.random.default_rng(seed))
    assert sorted(out.ravel()) == sorted(rate.ravel())


def test_wrap_fields_and_blur(spark):
    rate, labels = case()
    rows = [(1, rate.ravel().tolist(), labels.ravel().tolist()), (2, [0.0] * 36, [0] * 36)]
    df = spark.createDataFrame(rows, "key int, rate array<double>, labels array<int>")
    got = {r.key: r for r in FL.wrap_fields(df, ["key"], "rate", 6, 6, 3).collect()}
    again = {r.key: r for r in FL.wrap_fields(df.repartition(3), ["key"], "rate", 6, 6, 3).collect()}
    assert got == again and math.isclose(sum(got[1].blurred), 1) and got[2].raw == got[2].blurred == [0.0] * 36
    m = gk.reflected_blur(6, 2.0)
    assert np.allclose(m.sum(axis=1), 1) and np.allclose(m, m[::-1, ::-1]) and m[0, 0] > m[0, 1] > m[0, 2]


def plain_thin(points, least):
    kept = []
    for p in points:
        if all(math.dist(p, q) >= least for q in kept):
            kept.append(p)
    return kept


@pytest.mark.parametrize("hexagonal,disk,least", [(False, False, None), (True, False, 7.0), (True, True, 11.5), (False, True, 9.0)])
def test_lattice_points(spark, hexagonal, disk, least):
    sizes = {1: (40.0, 50.0), 2: (3.0, 2.0), 3: (61.5, 30.25)}
    step = 6.0
    size = step / math.sqrt(3)
    got = {}
    for r in FL.lattice_points(spark.createDataFrame([(k, *v) for k, v in sizes.items()], "key int, height double, width double"), ["key"], step, least, hexagonal, disk).orderBy("key", "no").collect():
        got.setdefault(r.key, []).append((r.x, r.y))
    for key, (height, width) in sizes.items():
        sx, sy = (1.5 * size, size * math.sqrt(3)) if hexagonal else (step, step)
        points = [(c * sx, r * sy + (sy / 2 if hexagonal and c % 2 else 0)) for r in range(math.ceil(height / sy)) for c in range(math.ceil(width / sx))]
        points = [p for p in points if not disk or math.hypot(p[0] - width / 2, p[1] - height / 2) <= width / 2]
        points = plain_thin(points, least) if least else points
        assert np.allclose(got.get(key, []), points) and len(got.get(key, [])) == len(points)


def test_values_in_slots(spark):
    slots = spark.createDataFrame([(1, 10, 0.0), (1, 11, 1.0), (1, 12, 1.0), (1, 13, 4.0), (2, 20, 0.0)], "key int, i long, t double")
    values = spark.createDataFrame([(1, 0.4, 5.0), (1, 0.5, 6.0), (1, 1.2, 7.0), (1, 1.1, 8.0), (1, 99.0, 9.0), (3, 1.0, 1.0)], "key int, t double, rate double")
    got = {r.i: r.rate for r in asof.at_nearest_slot(values, slots, ["key"], "t", "rate", "i").collect()}
    assert got == {10: 6.0, 11: 7.0, 12: 0.0, 13: 9.0, 20: 0.0}


def test_field_set_distance_of_moved_fields(spark):
    """Both fields of a map moved by the same step: that step is the distance of bins and centroids."""
    bins = [(1, 1, 0, 0, 2.0), (1, 1, 0, 1, 1.0), (1, 2, 5, 5, 4.0), (2, 1, 1, 0, 2.0), (2, 1, 1, 1, 1.0), (2, 2, 6, 5, 4.0), (3, 1, 2, 2, 1.0)]
    df = spark.createDataFrame(bins, "map int, field_id int, r int, c int, rate double")
    sets = D.field_sets(df, ["map"], 8)
    assert {r.map: r.fields for r in sets.collect()} == {1: 2, 2: 2, 3: 1}
    a, b = (sets.where(f"map = {k}").selectExpr("1 AS pair", "*") for k in (1, 2))
    one = D.field_set_distance(a, b, ["pair"], 8, 8, 8.0, 8.0, [(0.0, 1.0), (1.0, 0.0)], 1).first()
    assert one.centroid_distance == 1 and math.isclose(one.field_wass, 0.5) and math.isclose(one.binary_wass, 0.5)
