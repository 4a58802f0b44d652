"""The chunked path must give what the plain window gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spikegrid.operators import asof, spikes, tracking
from spikegrid.operators.ordered import Ordered, average_ranks, kth_smallest, quantiles
from spikegrid.settings import DEFAULT

SMALL = DEFAULT.but(rows_per_chunk=20)


def walk(n=400, seed=1, hot=0.7):
    """One session holds most of the rows; its clock is dense in places."""
    rng = np.random.default_rng(seed)
    s = np.where(rng.random(n) < hot, 1, rng.integers(2, 6, n))
    t = np.round(np.where(rng.random(n) < 0.5, rng.random(n) * 3, rng.random(n) * 1000), 3)
    return pd.DataFrame({
        "session_id": s, "i": np.arange(n), "t": t,
        "x": np.round(rng.random(n) * 100, 2), "y": rng.integers(0, 9, n).astype(float),
        "unit": rng.choice(["a", "b"], n, p=[0.9, 0.1]),
    })


def frame(df, keys):
    return df.toPandas().sort_values(keys).reset_index(drop=True)


@pytest.fixture(scope="module")
def trk(spark):
    return spark.createDataFrame(walk()).cache()


@pytest.mark.parametrize("fn", [
    tracking.with_speed, tracking.with_heading, tracking.with_step, tracking.travel,
    lambda d, settings: tracking.boxcar(d, 5, settings=settings),
    lambda d, settings: spikes.burst_members(d, 0.8, settings=settings),
    lambda d, settings: spikes.burst_members(d, 0.8, 3, True, settings=settings),
    lambda d, settings: spikes.isi_statistics(d, settings=settings),
])
def test_chunked_equals_plain(trk, fn):
    plain, cut = fn(trk, settings=DEFAULT), fn(trk, settings=SMALL)
    keys = [c for c in ("session_id", "unit", "i") if c in plain.columns]
    cols = plain.columns
    pd.testing.assert_frame_equal(frame(plain.select(cols), keys), frame(cut.select(cols), keys))


def test_cutting_happens_and_is_bounded(trk):
    o = Ordered(trk, ["session_id"], ["t", "i"], SMALL)
    assert o.chunked
    sizes = o._df.groupBy(*o.group).count().toPandas()
    assert sizes["count"].max() <= 40 and len(sizes) > 12


def test_running_fill_number(trk):
    for settings in (DEFAULT, SMALL):
        o = Ordered(trk, ["session_id"], ["t", "i"], settings)
        got = frame(
            o.running({"c": F.col("x")}).number("k")
            .fill(last={"p": F.when(F.col("y") == 3, F.col("x"))}, first={"q": F.when(F.col("y") == 3, F.col("x"))}).df,
            ["session_id", "t", "i"],
        )
        want = walk().sort_values(["session_id", "t", "i"]).reset_index(drop=True)
        g = want.groupby("session_id")
        np.testing.assert_allclose(got.c, g.x.cumsum())
        np.testing.assert_array_equal(got.k, g.cumcount() + 1)
        mark = want.x.where(want.y == 3)
        np.testing.assert_allclose(got.p, mark.groupby(want.session_id).ffill())
        np.testing.assert_allclose(got.q, mark.groupby(want.session_id).bfill())


def test_quantiles_and_ranks(trk):
    pdf = walk()
    for settings in (DEFAULT, SMALL):
        q = frame(quantiles(trk, ["session_id"], "x", {"a": 0.1, "m": 0.5}, settings), ["session_id"])
        want = pdf.groupby("session_id").x.quantile([0.1, 0.5]).unstack()
        np.testing.assert_allclose(q[["a", "m"]].values, want.values)
        r = average_ranks(trk, [], "y", settings).toPandas().set_index("y")["rank"].sort_index()
        ref = pdf.assign(r=pdf.y.rank()).groupby("y").r.first()
        np.testing.assert_allclose(r.values, ref.values)
        k = frame(kth_smallest(trk, ["session_id"], "t", F.lit(7), "v", settings), ["session_id"])
        np.testing.assert_allclose(k.v, pdf.groupby("session_id").t.apply(lambda s: np.sort(s.values)[6]))


def test_asof_nearest_against_argmin(spark):
    pdf = walk(300, 5)
    pdf["t"] = np.round(pdf.t)          # many equal times and exact mid-points
    spk = pdf[pdf.unit == "b"][["session_id", "i", "t"]]
    sam = pdf[pdf.unit == "a"]
    want = []
    for r in spk.itertuples():
        s = sam[sam.session_id == r.session_id].sort_values(["t", "i"])
        if len(s):
            d = (s.t - r.t).abs().values
            m = s.iloc[d.argmin()]
            want.append((r.i, m.x))
    want = dict(want)
    for settings in (DEFAULT, SMALL):
        got = asof.asof_nearest(spark.createDataFrame(spk), spark.createDataFrame(sam), ["session_id"], "t", ["x"], "i", settings)
        assert dict((r.i, r.x) for r in got.collect()) == want


def test_first_gap(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 4), (2, 2), (3, 1)], "session_id int, label int")
    got = dict(spikes.first_gap(df, ["session_id"]).collect())
    assert got == {1: 3, 2: 1, 3: 2}
    assert spikes.valid_cells(df, ["session_id"]).count() == 3
