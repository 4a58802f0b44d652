"""Hard negatives against a plain loop over all rows; the SQL checks the given tables."""

import math
import random

import numpy as np
import pytest

from spikegrid.llm import hard_negatives
from spikegrid.llm.queries import ORACLE, QUERIES
from tests.llm.test_operators import sorted_rows
from tests.oracle import compare, connect

TABLE = "vec_id long, embedding array<float>, label int, row string, score long, block string, v int"


def plain(rows, positives=5, negatives=10):
    used = []
    for i, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        used.append((i, label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for a, (i, label, x) in enumerate(used):
        if i is None or i % 100:
            continue
        all_rows = sorted(((-sum(p * q for p, q in zip(x, y)), math.inf if j is None else j, lab) for b, (j, lab, y) in enumerate(used) if b != a))
        for s, j, _ in [r for r in all_rows if r[2] == label][:positives]:
            fits = [r for r in all_rows if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s]
            out += [(i, None if j == math.inf else j, k + 1, None if m == math.inf else m, -s, -t) for k, (t, m, _) in enumerate(fits[:negatives])]
    return out


def awkward(rng, n=400, width=6):
    rows = [(k, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(width)], rng.randrange(3)) for k in range(n)]
    rows += [(100, [0.5] * width, 1), (100, [0.5] * width, 1), (200, [1.0] + [0.0] * (width - 1), 0), (None, [0.5] * width, 1), (None, [0.5] * width, 2)]
    rows += [(300, [0.0] * width, 1), (900, [], 1), (901, [0.5], 2), (500, None, 1), (600, [None] * width, 1), (700, [math.nan] * width, 1),
             (800, [math.inf] + [0.0] * 5, 1), (1000, [0.5] * width, None), (-100, [0.5] * width, 0)]
    return rows + [(5000 + k, [0.5] * width, 2) for k in range(60)]          # many equal vectors of one label


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], TABLE)


@pytest.mark.parametrize("rows,anchors", [(64, 2), (8192, 1024)])
def test_against_plain(spark, rows, anchors):
    given = awkward(random.Random(rows))
    got = hard_negatives.mine(frame(spark, given), rows=rows, anchors=anchors).collect()
    assert sorted_rows(got) == sorted_rows(plain(given)) and got


def test_reading_stops_early():
    rng = np.random.default_rng(1)
    v = rng.integers(-9, 9, (6000, 4))
    v[:40] = 60
    b = hard_negatives.Block(np.arange(6000), np.arange(6000), np.zeros(6000, int), v)
    seen = []
    scores = b.scores
    b.scores = lambda at, a: seen.append(len(at)) or scores(at, a)
    best = b.best(np.array([1, 1, -1, 2]), [(np.ones(6000, bool), None, None)], 5)[0]
    want = np.lexsort((np.arange(6000), -(v @ [1, 1, -1, 2])))[:5]
    assert best[:, 0].tolist() == want.tolist() and sum(seen) < 4000


def test_large_components_are_exact(spark):
    rows = [(100, [4e6] * 8, 1), (1, [4e6] * 8, 1), (2, [3e6] * 7 + [3000003.0], 2), (3, [3e6] * 8, 2)]
    assert sorted_rows(hard_negatives.mine(frame(spark, rows)).collect()) == sorted_rows(plain(rows))
    with pytest.raises(Exception, match="2\\^31"):
        hard_negatives.mine(frame(spark, [(100, [1e9], 1)])).collect()


def test_empty(spark):
    assert hard_negatives.mine(frame(spark, [(1, [1.0], 1)]).where("false")).collect() == []
    assert hard_negatives.mine(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    assert compare(QUERIES["op13_threshold_algorithm"](spark, d), connect(d), ORACLE["op13_threshold_algorithm"]) is None
