"""Grid kernels, matching, waveforms and cluster quality against direct computation."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spikegrid.functions import grid_kernels as gk, tails, waveforms as WF
from spikegrid.operators import clusters as K, distances as D, fields as FL, maps as M, matching as MT, nulls as N, scores as C
from spikegrid.functions.expr import Extent
from spikegrid.settings import DEFAULT

rng = np.random.default_rng(0)


def test_smoothing_is_a_mirrored_correlation():
    taps, m = gk.gaussian_taps(1.0), rng.random((9, 7))
    p = np.pad(m, 4, mode="reflect")
    want = np.array([[sum(taps[a] * taps[b] * p[r + a, c + b] for a in range(8) for b in range(8)) for c in range(7)] for r in range(9)])
    np.testing.assert_allclose(gk.smoothing_matrix(9, taps) @ m @ gk.smoothing_matrix(7, taps).T, want)


def test_components_and_holes():
    m = rng.random((20, 20)) > 0.5
    lab = gk.components(m)
    assert (lab > 0).sum() == m.sum()
    for r, c in itertools.product(range(20), range(19)):
        if m[r, c] and m[r, c + 1]:
            assert lab[r, c] == lab[r, c + 1]
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[3, 3] = False
    assert gk.enclosed(ring).sum() == 1 and gk.enclosed(ring)[3, 3]


def test_autocorrelogram_direct():
    a = rng.random((5, 6))
    ac = gk.autocorrelogram(a, 1.8)
    full = np.zeros((9, 11))
    for dy, dx in itertools.product(range(-4, 5), range(-5, 6)):
        p = a[max(0, dy):5 + min(0, dy), max(0, dx):6 + min(0, dx)].ravel()
        q = a[max(0, -dy):5 + min(0, -dy), max(0, -dx):6 + min(0, -dx)].ravel()
        sp, sq = p.std(), q.std()
        full[dy + 4, dx + 5] = ((p - p.mean()) * (q - q.mean())).mean() / (sp * sq) if sp * sq > 1e-9 else 0
    h, w = ac.shape
    np.testing.assert_allclose(ac, full[(9 - h) // 2:(9 + h) // 2, (11 - w) // 2:(11 + w) // 2], atol=1e-6)


def test_grid_score_of_a_hexagonal_map():
    y, x = np.mgrid[:48, :48]
    hexa = sum(np.cos(2 * np.pi / 11 * (x * np.cos(t) + y * np.sin(t))) for t in (0.2, 0.2 + np.pi / 3, 0.2 + 2 * np.pi / 3))
    g = gk.grid_measures(np.clip(hexa, 0, None))
    r = gk.grid_measures(gk.smoothing_matrix(48, gk.gaussian_taps(1)) @ rng.random((48, 48)))
    assert g["score"] > 0.8 and g["spacing"] == pytest.approx(11 * 2 / np.sqrt(3), abs=1.5)
    assert r is None or r["score"] < g["score"]


def test_place_field_and_blob_of_one_bump(spark):
    y, x = np.mgrid[:32, :32]
    bump = 10 * np.exp(-((x - 20) ** 2 + (y - 10) ** 2) / 18.0)
    lab = gk.place_field_labels(bump, clearance=0)
    assert lab.max() == 1 and lab[10, 20] == 1 and lab[25, 5] == 0
    df = spark.createDataFrame([(1, (bump / 10).ravel().tolist())], "k int, rate array<double>")
    bins = FL.field_bins(FL.blobs(df, ["k"], "rate", 32, 32, 1.0), ["k"], "rate", 32)
    m = FL.field_measures(bins, ["k"], 1024).collect()
    assert len(m) == 1 and abs(m[0].centroid_r - 10) < 1 and abs(m[0].centroid_c - 20) < 1
    s = FL.shift_fields(FL.blobs(df, ["k"], "rate", 32, 32, 1.0), ["k"], "rate", 32, 32, 3).first().shuffled
    np.testing.assert_allclose(np.sort(s), np.sort((bump / 10).ravel()))


def test_ellipse():
    t = np.linspace(0, 2 * np.pi, 30, endpoint=False)
    u, v = 5 * np.cos(t), 2 * np.sin(t)
    x0, y0, a, b, tilt = gk.ellipse(3 + u * np.cos(0.4) - v * np.sin(0.4), -1 + u * np.sin(0.4) + v * np.cos(0.4))
    np.testing.assert_allclose([x0, y0, a, b], [3, -1, 5, 2], atol=1e-6)
    assert np.tan(tilt) == pytest.approx(np.tan(0.4), abs=1e-6)


@pytest.mark.parametrize("shape", [(3, 3), (4, 6), (6, 4), (1, 5)])
def test_assignment(shape):
    c = rng.random(shape)
    n, m = shape
    best = min(sum(c[i, j] for i, j in zip(rows, cols)) for rows in itertools.permutations(range(n), min(shape))
               for cols in [range(m)] if len(rows) == m) if n > m else min(
        sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
    assert sum(c[i, j] for i, j in MT.assign(c)) == pytest.approx(best)


def test_matching_fixture(spark):
    d = [[5, 1, 5], [5, 1, 5], [5, 5, 2]]
    rows = [(1, i + 1, j + 1, float(d[i][j])) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(rows, "p int, unit_a int, unit_b int, distance double")
    best = {(r.unit_a, r.unit_b) for r in MT.mutual_best(df, ["p"]).collect()}
    assert best == {(1, 2), (3, 3)}
    full = {(r.unit_a, r.unit_b): r.step for r in MT.match_units(df, ["p"]).collect()}
    assert full == {(1, 2): "mutual", (3, 3): "mutual", (2, 1): "assigned"}


def test_chains(spark):
    """Five chains over three sessions numbered by mean distance; strangers follow after a gap."""
    m = [(1, 1, 2, a, b, d) for (a, b), d in zip([(2, 1), (3, 2), (4, 3), (1, 4)], [.1, .2, .3, .4])]
    m += [(1, 2, 3, a, b, d) for (a, b), d in zip([(1, 4), (2, 2), (3, 1), (4, 3), (5, 6)], [.1, .2, .3, .4, .5])]
    units = [(1, s, k) for s, n in ((1, 5), (2, 5), (3, 6)) for k in range(1, n + 1) if (s, k) != (3, 5)]
    mm = spark.createDataFrame(m, "site int, prev_no int, session_no int, unit_a int, unit_b int, distance double")
    uu = spark.createDataFrame(units, "site int, session_no int, label int")
    ids = {(r.session_no, r.label): r.global_id for r in MT.chain_ids(mm, uu, ["site"]).collect()}
    assert ids[1, 2] == ids[2, 1] == ids[3, 4] == 1
    assert ids[2, 5] == ids[3, 6] == 5 and ids[1, 5] == 7
    far = {(r.session_no, r.label): r.chain_distance for r in MT.chain_ids(mm, uu, ["site"]).collect()}
    assert abs(far[2, 1] - 0.1) < 1e-12 and abs(far[2, 5] - 0.5) < 1e-12 and far[1, 5] is None
    spk = spark.createDataFrame([(1, 1, 2), (1, 1, 9)], "site int, session_no int, label int")
    back = MT.relabel(spk, spark.createDataFrame([(1, 1, 2, 1)], "site int, session_no int, label int, global_id int"), ["site", "session_no"])
    assert sorted(r.label for r in back.collect()) == [0, 1]


def test_long_chains(spark):
    """Chains of up to eleven sessions, with breaks, at two sites: pointers are doubled to the first unit."""
    m = [(s, k, k + 1, 10 + k, 11 + k, 0.5) for s in (1, 2) for k in range(1, 11) if (s, k) != (2, 6)] + [(1, 4, 5, 1, 1, 0.1)]
    units = sorted({(s, k, a) for s, k, _, a, _, _ in m} | {(s, k, b) for s, _, k, _, b, _ in m})
    mm = spark.createDataFrame(m, "site int, prev_no int, session_no int, unit_a int, unit_b int, distance double")
    got = {(r.site, r.session_no, r.label): (r.root_no, r.root_label) for r in MT.chain_roots(mm, ["site"]).collect()}
    want = {u: (1, 11) if u[0] == 1 or u[1] <= 6 else (7, 17) for u in units} | {(1, 4, 1): (4, 1), (1, 5, 1): (4, 1)}
    assert got == want
    ids = MT.chain_ids(mm, spark.createDataFrame(units, "site int, session_no int, label int"), ["site"]).where("site = 1").collect()
    assert {(r.global_id, r.chain_distance) for r in ids} == {(1, 0.1), (2, 0.5)}


def test_smoothing_of_visible_bins(spark):
    from spikegrid.operators import maps as M

    ring = [1.0, None, 3.0, 4.0, None, None, 7.0, 8.0]
    df = spark.createDataFrame([(1, ring), (2, [None] * 8)], "key int, v array<double>")
    taps = np.exp(-0.5 * (np.arange(-4, 5) / 1.0) ** 2)

    def plain(at, wrap):
        top = low = 0.0
        for d, w in zip(range(-4, 5), taps):
            j = (at + d) % 8 if wrap else min(7, max(0, at + d))
            if ring[j] is not None:
                top, low = top + w * ring[j], low + w
        return top / low

    for wrap, fill in ((True, None), (False, "keep"), (True, 0.5)):
        got = {r.key: r.v for r in M.smooth_visible(df, ["key"], "v", 1, 8, 1.0, wrap, fill).collect()}
        for k, x in enumerate(ring):
            want = plain(k, wrap) if x is not None or fill is None else None if fill == "keep" else fill
            assert got[1][k] is None if want is None else abs(got[1][k] - want) < 1e-12
        assert got[2] == ([0.5] * 8 if fill == 0.5 else [None] * 8)


def test_swap_instructions(spark):
    df = spark.createDataFrame([("r1", "3 to 5 for ses2"), ("r2", "DOUBLE: 1 to 2 for ses1 and 2 to 1 for ses 3")], "row string, text string")
    got = sorted((r.row, r.session_no, r.label, r.global_id) for r in MT.swap_instructions(df, "text").collect())
    assert got == [("r1", 2, 3, 5), ("r2", 1, 1, 2), ("r2", 3, 2, 1)]


def test_sliced_distance_three_ways(spark):
    u = np.array(D.random_projections(6, 1))
    a, b = rng.integers(0, 16 * 16, 12), rng.integers(0, 16 * 16, 9)
    a, b = np.unique(a), np.unique(b)
    wa, wb = rng.random(len(a)) + .1, rng.random(len(b)) + .1
    mid = lambda k: (k + 0.5)
    row = [(1, a.tolist(), wa.tolist(), b.tolist(), wb.tolist())]
    df = spark.createDataFrame(row, "k int, bins_a array<int>, vals_a array<double>, bins_b array<int>, vals_b array<double>")
    got = D.map_distance(df, ["k"], 16, 16, 16.0, 16.0, [tuple(v) for v in u]).first().distance
    pts = [(1, "a", float(mid(i % 16)), float(mid(i // 16)), float(w)) for i, w in zip(a, wa)]
    pts += [(1, "b", float(mid(i % 16)), float(mid(i // 16)), float(w)) for i, w in zip(b, wb)]
    cloud = spark.createDataFrame(pts, "k int, side string, x double, y double, w double")
    for settings in (DEFAULT, DEFAULT.but(rows_per_chunk=4)):
        assert D.sliced_distance(cloud, ["k"], [tuple(v) for v in u], 2, settings).first().distance == pytest.approx(got)
    total = 0
    grid = np.linspace(0, 1, 200_001)[:-1] + 0.5 / 200_000
    for ux, uy in u:
        inv = []
        for i, w in ((a, wa), (b, wb)):
            x = mid(i % 16) * ux + mid(i // 16) * uy
            o = np.argsort(x)
            inv.append(x[o][np.minimum(np.searchsorted(np.cumsum(w[o]) / w.sum(), grid), len(x) - 1)])
        total += ((inv[0] - inv[1]) ** 2).mean()
    assert got == pytest.approx(np.sqrt(total / len(u)), rel=1e-3)


def test_temporal_distance_in_chunks(spark):
    a, b = np.sort(rng.random(80) * 50), np.sort(rng.random(60) * 60)
    df = spark.createDataFrame([(1, "a", float(t)) for t in a] + [(1, "b", float(t)) for t in b], "k int, side string, t double")
    lo, hi = min(a.min(), b.min()), max(a.max(), b.max())
    bins = np.arange(lo, hi + 0.7, 0.7)
    want = np.abs(np.cumsum(np.histogram(a, bins)[0]) / 80 - np.cumsum(np.histogram(b, bins)[0]) / 60).sum()
    for settings in (DEFAULT, DEFAULT.but(rows_per_chunk=15)):
        assert D.temporal_distance(df, ["k"], 0.7, settings).first().emd == pytest.approx(want)


def scalar_features(w, dt):
    """Shape features of one waveform, point by point."""
    d = WF.derivative(w[None], dt)[0]
    n = len(w)
    up = [i for i in range(1, n - 1) if w[i] > w[i - 1] and w[i] >= w[i + 1] and w[i] > 0]
    down = [0] + [i for i in range(1, n - 1) if w[i] < w[i - 1] and w[i] <= w[i + 1] and w[i] < 0] + [n - 1]
    if not up:
        return None
    p3 = max(up, key=lambda i: (w[i], -i))
    p1, p5 = max(i for i in down if i < p3), min(i for i in down if i > p3)
    return {"peak": w[p3], "f1": (p5 - p1) * dt, "f12": d[p1], "f13": d[p3], "f15": d[p5],
            "f4": np.trapezoid(w[p1:p5], dx=dt) / ((p5 - p1) * dt), "f8": np.sqrt(np.mean(d[:p1 + 1] ** 2)),
            "f20": np.subtract(*np.percentile(d, [75, 25])), "f22": np.mean((d - d.mean()) ** 4) / d.std() ** 4}


def test_waveform_features():
    w = rng.normal(size=(60, 16))
    got = WF.features(w, 0.5)
    for k in range(60):
        want = scalar_features(w[k], 0.5)
        if want:
            for name, v in want.items():
                assert got[k, WF.NAMES.index(name)] == pytest.approx(v), name
    assert np.isfinite(got).all()


def test_cluster_quality(spark):
    x = np.concatenate([rng.normal(size=(60, 4)), rng.normal(size=(90, 4)) * 1.5 + 3])
    lab = np.repeat([1, 2], [60, 90])
    df = spark.createDataFrame([(1, i, int(l), v.tolist()) for i, (l, v) in enumerate(zip(lab, x))], "site int, spike_idx int, label int, features array<double>")
    c, mu = np.cov(x[lab == 1].T), x[lab == 1].mean(axis=0)
    d2 = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(c), x - mu)
    noise = d2[lab != 1]
    m = K.mahalanobis(df, ["site"], 4)
    iso = {r.cluster: r.isolation for settings in [DEFAULT.but(rows_per_chunk=20)] for r in K.isolation_distance(m, ["site"], settings).collect()}
    assert iso[1] == pytest.approx(np.sort(noise)[59]) and iso[2] is None
    lr = {r.cluster: r.l for r in K.l_ratio(m, ["site"], 4).collect()}
    assert lr[1] == pytest.approx((np.exp(-noise / 2) * (1 + noise / 2)).sum())


def test_wave_components(spark):
    w = rng.normal(size=(50, 8))
    df = spark.createDataFrame([(1, i, 1, v.tolist()) for i, v in enumerate(w)], "site int, spike_idx int, label int, samples array<double>")
    got = K.wave_components(df, ["site"], 2, 4).orderBy("spike_idx").toPandas()
    for ch in range(2):
        x = w[:, ch * 4:ch * 4 + 4]
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
        v = np.linalg.svd(np.corrcoef(x.T))[2][0]
        v = v * np.sign(v[np.abs(v).argmax()])
        np.testing.assert_allclose([p[ch] for p in got.pc], z @ v, atol=1e-8)


def test_tails():
    # t = 2.228 with 10 degrees of freedom is the two-sided five percent point
    assert tails.incomplete_beta(5, 0.5, 10 / (10 + 2.228138852 ** 2)) == pytest.approx(0.05, abs=1e-6)


def test_null_quantile(spark):
    null = rng.random(40)
    obs = [(k, float(v)) for k, v in enumerate([-0.5, 0.1, null[3], 0.77, 2.0])]
    nd = spark.createDataFrame([(k, float(v)) for k in range(5) for v in null], "k int, value double")
    od = spark.createDataFrame(obs, "k int, value double")
    got = N.with_quantile(N.with_scores(od, N.null_statistics(nd, ["k"]), ["k"])).orderBy("k").toPandas()
    n, s = 40, (null.max() - null.min()) / 78
    lo, w = null.min() - s, (null.max() - null.min() + 2 * s) / 40
    cum = np.cumsum(np.histogram(null, bins=lo + w * np.arange(n + 1))[0]) / n
    np.testing.assert_allclose(got["quantile"], np.interp([v for _, v in obs], lo + np.linspace(0, w * n, n), cum), atol=1e-9)
    mad = np.median(np.abs(null - np.median(null))) * 1.482602218505602
    np.testing.assert_allclose(got.mod_z, 0.6745 * (np.array([v for _, v in obs]) - np.median(null)) / mad)


def test_permutations_keep_sizes(spark):
    pts = spark.createDataFrame([(1, "a" if i < 7 else "b", i, float(i)) for i in range(20)], "k int, side string, i int, x double")
    for settings in (DEFAULT, DEFAULT.but(rows_per_chunk=5)):
        p = N.permute_sides(pts, ["k"], ["i"], 4, 1, settings).toPandas()
        assert (p[p.side == "a"].groupby("iter").size() == 7).all() and len(p) == 80
        b = N.bootstrap(pts.select("k", "i", "x"), ["k"], ["i"], 3, 1, settings).toPandas()
        assert (b.groupby("iter").size() == 20).all() and b.i.nunique() < 21


def test_map_invariants(spark):
    """Occupancy adds up to the recorded time; a smoothed rate map peaks at one."""
    n = 500
    walk = np.clip(np.cumsum(rng.normal(size=(n, 2)), axis=0), -10, 10)
    trk = spark.createDataFrame(pd.DataFrame({"session_id": 1, "i": np.arange(n), "t": np.arange(n) * 0.02, "x": walk[:, 0], "y": walk[:, 1]}))
    ext = Extent.centred(20, 20)
    occ = M.occupancy(trk, ext, 8, 8)
    assert occ.agg(F.sum("v")).first()[0] == pytest.approx((n - 1) * 0.02)
    spk = trk.where("i % 7 = 0").withColumn("unit", F.lit("u"))
    rate = M.smooth_rate(occ, M.spike_counts(spk, ext, 8, 8), 8, 8, 1.0).first().rate
    assert max(rate) == pytest.approx(1.0)
    st = C.map_statistics(occ, M.rate_bins(occ, M.spike_counts(spk, ext, 8, 8)), 8, 8).first()
    assert st.information_content >= 0 and 0 < st.sparsity <= 1


def test_spearman_in_chunks(spark):
    x, y = rng.integers(0, 9, 200), rng.integers(0, 9, 200)
    y = np.where(rng.random(200) < 0.5, x, y)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "k int, a double, b double")
    want = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    for settings in (DEFAULT, DEFAULT.but(rows_per_chunk=3)):
        assert D.spearman(df, ["k"], "a", "b", settings).first().rho == pytest.approx(want)
    assert D.map_spearman(df, ["k"], "a", "b").first().rho == pytest.approx(want)


def test_geometry(spark):
    from spikegrid.operators import geometry as G

    t = G.time_index(spark, 2, 50).orderBy("i").collect()
    assert len(t) == 100 and t[51].clock == "00:00:01.020000"
    g = G.random_waveforms(G.random_trains(spark, 3, 10, 50.0), 4, 10).toPandas()
    assert set(g.unit) == {0, 1, 2} and g.label.between(0, 9).all() and np.stack(g.samples).min() >= -20
    m = spark.createDataFrame([(1, 0, 2, 5.0), (1, 3, 1, 1.0)], "k int, r int, c int, v double")
    turned = {(r.r, r.c): r.v for r in G.rotate_quarter(m, 4).collect()}
    assert turned == {(2, 3): 5.0, (1, 0): 1.0}
    assert G.peak_anchor(m, ["k"]).first()[1:] == (0.0, 2.0)
    s = G.scale_points(spark.createDataFrame([(1, 0.0, 2.0), (1, 4.0, 3.0), (1, 1.0, 2.5)], "k int, x double, y double"), ["k"]).toPandas()
    assert sorted(s.x) == [0, 0.25, 1] and sorted(s.y) == [0, 0.5, 1]
