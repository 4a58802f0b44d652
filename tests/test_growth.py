"""Steps whose cost must grow with the rows alone: look-ahead over long groups, work per small group."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikegrid.operators import statistics as ST
from spikegrid.operators.ordered import Ordered


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_ahead_is_read_backwards(spark):
    """A frame from the row to the end of its group is computed anew for each row."""
    rng = random.Random(1)
    p = [(k, k % 2, rng.choice([None, round(rng.random(), 2)])) for k in range(300)] + [(5, 1, 0.25)] * 3
    df = spark.createDataFrame(p, "id long, g int, p double")
    adjusted = ST.benjamini_hochberg(df, "p", ["g"], ["id"])
    assert "unboundedfollowing" not in plan_of(adjusted)
    got = sorted((r.g, r.p, r.id, r.p_adjusted) for r in adjusted.collect())
    want = []
    for g in (0, 1):
        mine = sorted((v, i) for i, h, v in p if h == g and v is not None)
        adj = [min(v * len(mine) / (k + 1), 1.0) for k, (v, _) in enumerate(mine)]
        want += [(g, *mine[k], min(adj[k:])) for k in range(len(mine))]
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in sorted(want)]
    assert np.allclose([r[3] for r in got], [r[3] for r in sorted(want)])
    nxt = Ordered(df, ["g"], ["id"]).fill(first={"n": F.when(F.col("p") > 0.5, F.col("id"))}).df
    assert "unboundedfollowing" not in plan_of(nxt)
    for r in nxt.collect():
        assert r.n == min((i for i, h, v in p if h == r.g and i >= r.id and v is not None and v > 0.5), default=None)


def test_rank_correlation_of_sparse_maps(spark):
    """Bins empty on both sides need no row."""
    from spikegrid.operators import distances as D

    rng = random.Random(3)
    rows = [(k, rng.choice([0.0, 0.0, 0.0, 1.0, 2.0]), rng.choice([0.0, 0.0, 1.0, 3.0])) for k in (1, 2) for _ in range(40)]
    sparse = [r for r in rows if r[1] or r[2]]
    kinds = "k int, a double, b double"
    every = {r.k: r.rho for r in D.map_spearman(spark.createDataFrame(rows, kinds), ["k"], "a", "b").collect()}
    few = {r.k: r.rho for r in D.map_spearman(spark.createDataFrame([*sparse, (3, 1.0, 0.0)], kinds), ["k"], "a", "b", F.lit(40) - F.count("a")).collect()}
    assert np.allclose([every[1], every[2]], [few[1], few[2]]) and few[3] is None


def test_relabellings_summed_up_in_their_task(spark):
    from spikegrid.operators import distances as D, relabel as RL
    from spikegrid.settings import DEFAULT

    rng = random.Random(4)
    rows = [(n, k, "ab"[k % 2], rng.random(), rng.random()) for n in (5, 9, 70) for k in range(n)]
    df = spark.createDataFrame(rows, "key int, i long, side string, x double, y double")
    u = D.lattice_projections(4)
    for s in (DEFAULT, DEFAULT.but(rows_per_chunk=60)):
        full = {r.key: r for r in RL.relabelled_sliced(df, ["key"], u, 50, 3, settings=s).collect()}
        got = {r.key: r for r in RL.relabelled_sliced(df, ["key"], u, 50, 3, settings=s, margin=1e-9).collect()}
        assert set(got) == set(full) == {5, 9, 70}
        for key, r in got.items():
            v = np.array(full[key].nulls)
            assert np.allclose([r.observed, r.null_n, r.null_mean, r.null_std, r.above], [full[key].observed, 50, v.mean(), v.std(), (v > r.observed + 1e-9).mean()])


@pytest.mark.parametrize("rows", [37, 300, 1000])
def test_shift_report_in_one_task(spark, rows):
    """The report made in the task of a train is that of the shuffled scores, for sessions hot and not."""
    from spikegrid.functions import map_scores
    from spikegrid.functions.expr import Extent
    from spikegrid.operators import maps as M, null_maps as NM, nulls as N
    from spikegrid.operators.ordered import plan_chunks
    from spikegrid.settings import DEFAULT

    rng, ext = random.Random(2), Extent(0.0, 10.0, 0.0, 10.0)
    trk = spark.createDataFrame([(s, k, k * 0.5, rng.random() * 10, rng.random() * 10) for s, n in ((1, 240), (2, 400)) for k in range(n)],
                                "session_id int, i long, t double, x double, y double")
    spk = spark.createDataFrame([(s, u, 1000 * s + 200 * j + k, rng.random() * 120) for s in (1, 2) for j, u in enumerate("xy") for k in range(40)] + [(1, "one", 9, 3.0)],
                                "session_id int, unit string, i long, t double")
    s = DEFAULT.but(rows_per_chunk=rows)
    s = s.but(chunks=plan_chunks(trk.select("session_id", "t"), ["session_id"], "t", s))
    occ, shares = M.occupancy(trk, ext, 6, 6), N.lattice_shares(60)
    for names in (map_scores.NAMES, ["information"], ["selectivity", "sparsity"]):
        want = NM.null_report(NM.map_null_scores(NM.shifted_counts(spk, trk, ext, 6, 6, shares, 20.0, s), occ, 6, 6, names, s), names)
        got = NM.shifted_report(spk, trk, occ, ext, 6, 6, shares, 20.0, names, s)
        a, b = ({(r.session_id, r.unit, r.score): r[3:] for r in d.collect()} for d in (want, got))
        assert set(a) == set(b) and len(a) == 4 * len(names)
        assert all(np.allclose(a[k], b[k]) for k in a)


def test_kernels_are_spread_over_tasks(spark):
    """Rows that lie by their keys already are still dealt to all tasks."""
    from spikegrid.operators.maps import spread

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = spark.range(200).selectExpr("id AS k", "id AS v").groupBy("k").agg(F.collect_list("v").alias("v"))
    places = {r.p for r in spread(small, ["k"]).mapInArrow(lambda it: it, "k long, v array<long>").select(F.spark_partition_id().alias("p")).collect()}
    assert len(places) == n


def test_point_distances_shuffle_bins_alone(spark):
    """A map with many points is one shuffle of its bins; bins without a place count in the weight alone."""
    from spikegrid.operators import geometry as G

    maps = spark.createDataFrame([(1, 0, 0, 2.0), (1, 1, 3, 1.0), (1, None, 3, 1.0), (2, None, None, 1.0), (3, 2, 2, 0.0)], "k int, r int, c int, v double")
    points = [(str(j), j * 0.5, j * 0.25) for j in range(12)]
    d = G.point_distances(maps, ["k"], 4, 4, 8.0, 4.0, points)
    assert plan_of(d.groupBy("k").agg(F.collect_list("distance"))).count("exchange hashpartitioning") == 1
    got = {(r.k, r.point): r.distance for r in d.collect()}
    assert len(got) == 36
    for name, y, x in points:
        want = (2 * math.hypot(0.5 - x, 1 - y) + math.hypot(3.5 - x, 3 - y)) / 4
        assert math.isclose(got[1, name], want) and got[2, name] is None and got[3, name] is None


def test_shuffles_start_with_partitions_for_the_rows(spark, monkeypatch):
    """A long table is not sorted in as few tasks as a short one; a short one changes nothing."""
    from spikegrid import session
    from spikegrid.plans.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    run = lambda: QUERIES["sequential_labels"](spark, folder)
    assert session.SQL_OPTIONS["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "8m"
    before = spark.conf.get(session.FIRST_PARTITIONS, None)
    few = sorted(map(tuple, run().collect()))
    assert spark.conf.get(session.FIRST_PARTITIONS, None) == before
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    monkeypatch.setattr(session, "ROWS_PER_PARTITION", 100)
    try:
        wide = run()
        n = -(-lines // 100)
        assert spark.conf.get(session.FIRST_PARTITIONS) == str(n) and f", {n})" in plan_of(wide)
        assert sorted(map(tuple, wide.collect())) == few
    finally:
        spark.conf.unset(session.FIRST_PARTITIONS)


def test_frames_of_a_report_have_a_stage_each(spark):
    """Each frame reaches the union through a shuffle, so its tasks are not shared with the others."""
    from spikegrid.operators import reports as RP

    rows = [(k, u, float(k)) for k in range(40) for u in ("a", None)]
    df = spark.createDataFrame([*rows, (None, "a", 2.0)], "session_id int, unit string, x double")
    frames = {n: df.groupBy("session_id", "unit").agg(F.max("x").alias(n)) for n in ("p", "q", "r")}
    long = RP.score_table(frames, ["session_id", "unit"])
    assert plan_of(long).count("exchange hashpartitioning(xxhash64(") == 3
    wide = RP.wide_report(long, ["session_id", "unit"], list(frames))
    assert sorted(map(str, wide.collect())) == sorted(f"Row(session_id={s}, unit={u!r}, p={x}, q={x}, r={x})" for s, u, x in [*rows, (None, "a", 2.0)])
