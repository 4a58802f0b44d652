"""Filters, spectra and adaptive rates against direct computation, whole and in pieces."""

import numpy as np
import pandas as pd
import pytest

from spikegrid.functions.filters import PROTOTYPES, dc_blocker, design
from spikegrid.operators import signals as G
from spikegrid.settings import DEFAULT


def response(b, a, w):
    z = np.exp(-1j * np.pi * np.asarray(w))
    return np.abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))


def lfilter(b, a, x, z):
    n, y = max(len(a), len(b)), []
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    for v in x:
        o = b[0] * v + z[0]
        z = np.append(z[1:], 0) + b[1:] * v - a[1:] * o
        y.append(o)
    return np.array(y)


def filtfilt(b, a, x):
    pad, n = 3 * max(len(a), len(b)), max(len(a), len(b)) - 1
    e = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]])
    bb, aa = np.pad(b, (0, n + 1 - len(b))), np.pad(a, (0, n + 1 - len(a)))
    comp = np.eye(n) - np.vstack([-aa[1:], np.eye(n)[:-1]]).T if n > 1 else np.array([[1 + aa[1]]])
    zi = np.linalg.solve(comp, bb[1:] - aa[1:] * bb[0])
    y = lfilter(bb, aa, e, zi * e[0])
    y = lfilter(bb, aa, y[::-1], zi * y[-1])[::-1]
    return y[pad:-pad]


def test_butterworth_coefficients():
    b, a = design(2, 0.2, "low")
    np.testing.assert_allclose(b, [0.06745527, 0.13491055, 0.06745527], atol=1e-7)
    np.testing.assert_allclose(a, [1, -1.1429805, 0.4128016], atol=1e-7)


@pytest.mark.parametrize("kind", sorted(PROTOTYPES))
@pytest.mark.parametrize("order", [2, 3, 4, 5])
@pytest.mark.parametrize("band,edges", [("low", 0.3), ("high", 0.3), ("band", [0.2, 0.5]), ("stop", [0.2, 0.5])])
def test_families(kind, order, band, edges):
    b, a = design(order, edges, band, kind, 1.0, 40.0)
    assert np.abs(np.roots(a)).max() < 1
    passing = {"low": 0.01, "high": 0.99, "band": np.sqrt(0.1), "stop": 0.01}[band]
    stopping = {"low": 0.99, "high": 0.01, "band": 0.99, "stop": 2 / np.pi * np.arctan(np.sqrt(np.tan(np.pi * 0.1) * np.tan(np.pi * 0.25)))}[band]
    if band == "band":
        passing = 2 / np.pi * np.arctan(np.sqrt(np.tan(np.pi * 0.1) * np.tan(np.pi * 0.25)))
    assert response(b, a, [passing])[0] >= 10 ** (-1.0 / 20) - 1e-6
    assert response(b, a, [stopping])[0] < 0.2
    if kind in ("cheby1", "ellip"):
        inside = {"low": np.linspace(0.001, 0.3, 200), "high": np.linspace(0.3, 0.999, 200),
                  "band": np.linspace(0.2, 0.5, 200), "stop": np.linspace(0.001, 0.2, 200)}[band]
        r = response(b, a, inside)
        assert r.max() < 1 + 1e-6 and r.min() > 10 ** (-1.0 / 20) - 1e-5
    if kind in ("cheby2", "ellip") and band == "low" and order > 2:
        assert response(b, a, np.linspace(0.8, 0.999, 50)).max() < 10 ** (-40 / 20) * 1.01


@pytest.fixture(scope="module")
def lfp(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i, float(v)) for s, n in ((1, 700), (2, 150)) for i, v in enumerate(np.cumsum(rng.normal(size=n)))]
    return spark.createDataFrame(rows, "session_id long, i long, v double").cache()


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_zero_phase(lfp, block):
    raw = lfp.toPandas()
    for b, a in (design(3, [0.1, 0.4], "band"), dc_blocker(0.02)):
        got = G.zero_phase(lfp, ["session_id"], b, a, DEFAULT.but(samples_per_kernel=block)).toPandas()
        for s, part in raw.groupby("session_id"):
            y = got[got.session_id == s].sort_values("i")
            np.testing.assert_array_equal(y.i, np.arange(len(part)))
            np.testing.assert_allclose(y.y, filtfilt(b, a, part.sort_values("i").v.to_numpy()), atol=1e-8)


@pytest.mark.parametrize("limit", [300, 1 << 16])
def test_spectrum(lfp, limit):
    raw = lfp.toPandas()
    got = G.spectrum(lfp, ["session_id"], 50.0, DEFAULT.but(samples_per_kernel=limit)).toPandas()
    for s, part in raw.groupby("session_id"):
        x = part.sort_values("i").v.to_numpy()
        y = got[got.session_id == s].sort_values("k")
        np.testing.assert_allclose(y.amplitude, 2 / len(x) * np.abs(np.fft.fft(x))[: len(x) // 2], atol=1e-7)
        np.testing.assert_allclose(y.frequency, np.arange(len(x) // 2) * 50 / len(x))


@pytest.mark.parametrize("rows", [25, 1_000_000])
def test_adaptive_rate(spark, rows):
    rng = np.random.default_rng(8)
    t = np.sort(np.round(np.concatenate([rng.random(300) * 20, 40 + rng.random(50) * 100]), 3))
    df = spark.createDataFrame(pd.DataFrame({"session_id": 1, "t": t, "i": np.arange(len(t))}))
    got = G.adaptive_rate(df, ["session_id"], 0.4, DEFAULT.but(rows_per_chunk=rows)).toPandas().sort_values("t")
    want, start, n = [], t[0], 1
    for v in t[1:]:
        n += 1
        if v - start > 0.4:
            want.append(((v + start) / 2, n / (v - start)))
            start, n = v, 0
    np.testing.assert_allclose(got[["t", "rate"]].values, np.array(want))
