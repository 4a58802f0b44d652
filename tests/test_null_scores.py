"""Null maps, their scores and relabelled trains against the operators for single maps and plain loops."""

import math
import random
import time

import numpy as np
import pytest

from spikegrid.functions import map_scores
from spikegrid.functions.expr import Extent
from spikegrid.operators import asof, distances as D, maps as M, null_maps as NM, nulls as N, relabel as RL, scores as C
from spikegrid.operators.ordered import plan_chunks
from spikegrid.settings import DEFAULT

ARENA = Extent(0.0, 10.0, 0.0, 10.0)
ROWS = COLS = 6
SHARES = N.lattice_shares(9)
KEYS = ["session_id", "unit", "iter"]


@pytest.fixture(scope="module")
def recording(spark):
    rng = random.Random(2)
    trk = [(s, k, float(k // 2) if k % 9 == 0 else k * 0.5 + rng.random() * 0.1, rng.random() * 10, rng.random() * 10) for s in (1, 2) for k in range(240)]
    spk = [(s, u, 1000 * s + 200 * j + k, rng.random() * 120) for s in (1, 2) for j, u in enumerate("xy") for k in range(40)] + [(1, "one", 9, 3.0)]
    return spark.createDataFrame(trk, "session_id int, i long, t double, x double, y double"), spark.createDataFrame(spk, "session_id int, unit string, i long, t double")


def rounded(df, digits=9):
    return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("hot", [False, True])
def test_counts_and_scores_of_shifts(spark, recording, hot):
    trk, spk = recording
    s = DEFAULT.but(rows_per_chunk=37) if hot else DEFAULT
    s = s.but(chunks=plan_chunks(trk.select("session_id", "t"), ["session_id"], "t", s))
    counts = NM.shifted_counts(spk, trk, ARENA, ROWS, COLS, SHARES, 20.0, s)
    long = counts.selectExpr("session_id", "unit", "explode(arrays_zip(iters, bins, counts)) AS z").selectExpr("session_id", "unit", "z.iters AS iter", "z.bins AS b", "z.counts AS n")
    long = long.groupBy(*KEYS, "b").sum("n")
    shifted = N.shift_spikes(spk, ["session_id", "unit"], SHARES, 20.0)
    pos = asof.asof_nearest(shifted, trk, ["session_id"], "t", ["x", "y"], "i")
    single = M.spike_counts(pos, ARENA, ROWS, COLS, KEYS)
    want = single.selectExpr("session_id", "unit", "iter + 1", f"r * {COLS} + c", "CAST(v AS LONG)")
    assert rounded(long.where("iter > 0")) == rounded(want)
    occ = M.occupancy(trk, ARENA, ROWS, COLS)
    scored = NM.map_null_scores(counts, occ, ROWS, COLS, [*map_scores.NAMES, "grid"], s)
    rates = M.rate_bins(occ, single, KEYS)
    stats = C.map_statistics(occ, rates, ROWS, COLS, KEYS).selectExpr(*KEYS, "information_content", "sparsity", "selectivity")
    assert rounded(scored.where("iter > 0").selectExpr("session_id", "unit", "iter - 1", "information", "sparsity", "selectivity")) == rounded(stats)
    assert rounded(scored.where("iter > 0").selectExpr("session_id", "unit", "iter - 1", "coherence"), 6) == rounded(C.coherence(rates, ROWS, COLS, KEYS), 6)
    top = rates.groupBy(*KEYS).max("v").toDF(*KEYS, "top")
    borders = C.border_score(rates.join(top, KEYS).selectExpr(*KEYS, "r", "c", "v / top AS v"), ROWS, COLS, KEYS)
    assert rounded(scored.where("iter > 0").selectExpr("session_id", "unit", "iter - 1", "border_top", "border_bottom", "border_left", "border_right")) == rounded(
        borders.select(*KEYS, "border_top", "border_bottom", "border_left", "border_right"))
    report = NM.null_report(scored, [*map_scores.NAMES, "grid"])
    by = {(r.session_id, r.unit, r.score): r for r in report.collect()}
    assert not any(u == "one" for _, u, _ in by)           # a train of one spike cannot be shifted
    info = [r.information for r in scored.where("session_id = 1 AND unit = 'x' AND iter > 0").collect()]
    row = by[1, "x", "information"]
    assert row.null_n == len(SHARES) and math.isclose(row.null_mean, np.mean(info)) and math.isclose(row.null_std, np.std(info))
    assert math.isclose(row.below, np.mean(np.array(info) < row.observed - 1e-9)) and math.isclose(row.above, np.mean(np.array(info) > row.observed + 1e-9))


def test_scores_from_occupied_bins():
    """Maps of few bins are scored without being filled in: the same scores in a fraction of the time."""
    rng = np.random.default_rng(5)
    for rows, cols, some, most in ((16, 16, 20, 3), (16, 16, 100, 40), (6, 9, 54, 3), (5, 5, 25, 2), (4, 4, 1, 2), (16, 16, 256, 3)):
        bins = np.sort(rng.choice(rows * cols, some, replace=False))
        occupancy = rng.random(rows * cols) * 50
        occupancy[bins[::5]] = 1e-6                             # below the floor
        counts = rng.integers(0, most, (70, some)) * (rng.random((70, 1)) < rng.random((70, some)) * 2)
        even = np.where(np.arange(70)[:, None] % 7 == 3, occupancy[bins], counts)       # a rate of one in all of the bins
        for c in (counts, even):
            whole = np.zeros((70, rows * cols))
            whole[:, bins] = c
            for names in (map_scores.NAMES, ["coherence"], ["border_left", "information"], ["selectivity", "grid"]):
                for published in (True, False):
                    got = map_scores.of_bins(c, bins, occupancy, rows, cols, 1e-4, lengths_as_published=published, names=names)
                    assert np.allclose(got, map_scores.scores(whole, occupancy, rows, cols, 1e-4, lengths_as_published=published, names=names), rtol=1e-10, atol=1e-10, equal_nan=True)
    bins, occupancy = np.arange(0, 256, 11), rng.random(256)
    counts = rng.integers(0, 2, (1001, len(bins)))
    whole = np.zeros((1001, 256))
    whole[:, bins] = counts
    spent = []
    for call in (lambda: map_scores.of_bins(counts, bins, occupancy, 16, 16, 1e-4), lambda: map_scores.scores(whole, occupancy, 16, 16, 1e-4)):
        call()
        begin = time.thread_time()
        call()
        spent.append(time.thread_time() - begin)
    assert spent[0] < spent[1] / 3


def test_columns_against_their_first_row():
    values = np.array([[1.0, np.nan, 2.0, 5.0], [0.0, 1.0, np.nan, 5.0], [3.0, 2.0, np.nan, 5.0 + 1e-10], [1.0, np.nan, np.nan, 4.0]])
    observed, n, mean, std, below, above = NM._compared(values, 1e-9)
    assert np.array_equal(observed, values[0], equal_nan=True) and n.tolist() == [3, 2, 0, 3]
    assert np.allclose(mean[[0, 1, 3]], [4 / 3, 1.5, 14 / 3]) and np.allclose(std[[0, 1, 3]], [np.std([0, 3, 1]), 0.5, np.std([5, 5, 4])])
    assert np.allclose(below[[0, 3]], 1 / 3) and np.allclose(above[[0, 3]], [1 / 3, 0]) and np.isnan([below[1], above[1]]).all()


def plain_distance(times, labels, width):
    lo, hi = min(times), max(times)
    last = max(math.ceil((hi - lo) / width), 1) - 1
    na, nb = labels.count("a"), labels.count("b")
    mass = {}
    for t, s in zip(times, labels):
        b = min(math.floor((t - lo) / width), last)
        mass[b] = mass.get(b, 0) + (1 / na if s == "a" else -1 / nb)
    total, run, at = 0.0, 0.0, sorted(mass)
    for b, nxt in zip(at, at[1:]):
        run += mass[b]
        total += abs(run) * (nxt - b)
    return total


def pool(n=60):
    rng = random.Random(6)
    return [(1, k, "a" if rng.random() < 0.4 else "b", round(rng.random() * 50, 1)) for k in range(n)] + [(2, 500 + k, "a", float(k)) for k in range(4)] + [(3, 600, "a", 1.0), (3, 601, "b", 1.0)]


def test_relabelled_distances(spark):
    rows = pool()
    got = {r.key: r for r in RL.relabelled_distances(spark.createDataFrame(rows, "key int, i long, side string, t double"), ["key"], 3.0, 25, 4).collect()}
    assert set(got) == {1, 3} and got[3].observed == 0
    mine = [r for r in rows if r[0] == 1]
    assert math.isclose(got[1].observed, plain_distance([r[3] for r in mine], [r[2] for r in mine], 3.0))
    na = sum(r[2] == "a" for r in mine)
    h = RL.hash32(np.array([r[1] for r in mine]), np.arange(25), 4)
    for k in range(25):
        first = set(sorted(range(len(mine)), key=lambda j: (h[j, k], mine[j][1]))[:na])
        assert math.isclose(got[1].nulls[k], plain_distance([r[3] for r in mine], ["a" if j in first else "b" for j in range(len(mine))], 3.0))


def test_relabelling_in_chunks(spark):
    """A hot pool: the observed distance is the same, the null has the same centre and spread."""
    rows = pool(400)
    df = spark.createDataFrame(rows, "key int, i long, side string, t double")
    whole = RL.relabelled_distances(df, ["key"], 1.0, 600).where("key = 1").first()
    cut = RL.relabelled_distances(df, ["key"], 1.0, 600, settings=DEFAULT.but(rows_per_chunk=50)).where("key = 1").first()
    assert math.isclose(whole.observed, cut.observed) and len(cut.nulls) == 600
    assert abs(np.mean(whole.nulls) - np.mean(cut.nulls)) < 0.15 * np.mean(whole.nulls) and 0.7 < np.std(cut.nulls) / np.std(whole.nulls) < 1.4


def test_relabelled_sliced(spark):
    """Each relabelling against the operator for one pair of clouds; a pool above the limit is drawn otherwise but as wide."""
    rng = random.Random(9)
    rows = [(k, s, float(rng.randrange(6)), rng.random()) for k, s in enumerate("aabbbbaabab")]
    df = spark.createDataFrame([(1, *r) for r in rows] + [(2, 0, "a", 1.0, 1.0)], "key int, i long, side string, x double, y double")
    u = D.lattice_projections(5)
    got = RL.relabelled_sliced(df, ["key"], u, 7, 3).collect()
    assert [r.key for r in got] == [1]
    h, na = RL.hash32(np.arange(len(rows)), np.arange(7), 3), sum(r[1] == "a" for r in rows)
    labels = [[r[1] for r in rows]] + [["a" if j in sorted(range(len(rows)), key=lambda j: (h[j, k], j))[:na] else "b" for j in range(len(rows))] for k in range(7)]
    long = spark.createDataFrame([(k, lab[j], rows[j][2], rows[j][3], 1.0) for k, lab in enumerate(labels) for j in range(len(rows))], "k int, side string, x double, y double, w double")
    want = {r.k: r.distance for r in D.sliced_distance(long, ["k"], u).collect()}
    assert np.allclose([got[0].observed, *got[0].nulls], [want[k] for k in range(8)])
    hot = RL.relabelled_sliced(df, ["key"], u, 7, 3, settings=DEFAULT.but(rows_per_chunk=5)).first()
    assert math.isclose(hot.observed, got[0].observed) and len(hot.nulls) == 7 and all(0 <= v < 5 for v in hot.nulls)


def test_bootstrap_means(spark):
    rng = random.Random(2)
    rows = [(1, k, rng.random()) for k in range(40)] + [(2, 5, 3.0), (3, 1, None)]
    df = spark.createDataFrame(rows, "key int, i long, v double")
    got = {r.key: r for r in N.bootstrap_means(df, ["key"], "i", "v", 200).collect()}
    assert set(got) == {1, 2} and got[2].means == [3.0] * 200 and got[1].n == 40
    v = np.array([r[2] for r in rows[:40]])
    pick = RL.hash32(np.arange(40), np.arange(200), 0) % np.uint64(40)
    assert np.allclose(got[1].means, v[pick].mean(axis=0)) and abs(np.std(got[1].means) / (v.std() / 40 ** 0.5) - 1) < 0.2
    hot = {r.key: r for r in N.bootstrap_means(df, ["key"], "i", "v", 50, settings=DEFAULT.but(rows_per_chunk=10)).collect()}
    assert set(hot) == {1, 2} and len(hot[1].means) == 50 and abs(np.mean(hot[1].means) - v.mean()) < 0.1
