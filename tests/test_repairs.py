"""Readers at their edges, and rules taken from the published code."""

import random
import struct

import numpy as np
import pytest

from spikegrid.functions.tails import fisher_two_sided
from spikegrid.operators import geometry, reports, tracking
from spikegrid.sources import formats, study
from tests.test_sources import cut_bytes, pos_bytes, tetrode_bytes


def load(spark, kind, path):
    formats.register(spark)
    return spark.read.format(kind).load(str(path))


def test_long_header(spark, tmp_path):
    extra = "".join(f"key_{k:06d} {'v' * 20}{k}\r\n" for k in range(5000)).encode()
    (tmp_path / "a.set").write_bytes(extra)
    got = load(spark, "recording_header", tmp_path / "a.set").collect()
    assert len(got) == 5000 and {r.value for r in got if r.key == "key_004999"} == {"v" * 20 + "4999"}
    (tmp_path / "a.pos").write_bytes(extra + pos_bytes(100))
    assert load(spark, "recording_pos", tmp_path / "a.pos").count() == 100


@pytest.mark.parametrize("counted", [True, False])
@pytest.mark.parametrize("trailer", [True, False])
def test_last_record(spark, tmp_path, counted, trailer):
    data = pos_bytes(100)
    if not counted:
        data = data.replace(b"num_pos_samples 100\r\n", b"")
    if not trailer:
        data = data[: -len(b"\r\ndata_end\r\n")]
    (tmp_path / "a.pos").write_bytes(data)
    assert load(spark, "recording_pos", tmp_path / "a.pos").count() == 100


def test_part_of_a_record_is_an_error(spark, tmp_path):
    (tmp_path / "a.pos").write_bytes(pos_bytes(100)[:-30])
    with pytest.raises(Exception, match="num_pos_samples is 100"):
        load(spark, "recording_pos", tmp_path / "a.pos").count()


def test_wide_samples(spark, tmp_path):
    waves = np.random.default_rng(0).integers(-30_000, 30_000, (7, 4, 10))
    data = tetrode_bytes(np.arange(7), np.zeros((7, 4, 10), int)).replace(b"bytes_per_sample 1", b"bytes_per_sample 2")
    head = data[: data.index(b"data_start") + 10]
    body = b"".join(b"".join(struct.pack(">I", k * 96000) + w[c].astype("<i2").tobytes() for c in range(4)) for k, w in enumerate(waves))
    (tmp_path / "a.1").write_bytes(head + body + b"\r\ndata_end\r\n")
    got = load(spark, "recording_tetrode", tmp_path / "a.1").orderBy("spike_idx").toPandas()
    assert got.t.tolist() == list(range(7))
    np.testing.assert_array_equal(np.stack(got.samples), waves.reshape(7, -1))


def test_boxcar_follows_the_sample_rate(spark, tmp_path):
    n = 200
    for name, rate in (("slow", 25), ("fast", 50)):
        (tmp_path / f"{name}.pos").write_bytes(pos_bytes(n).replace(b"sample_rate 50.0", f"sample_rate {rate}.0".encode()))
    got = study.read_tracking(spark, str(tmp_path), 511.0, 1e9).toPandas()
    x = np.array([100 + k % 40 for k in range(n)], float)
    for name, width in (("slow", 10), ("fast", 20)):
        mine = got[got.session_id.str.endswith(f"{name}.pos")].sort_values("i").x.to_numpy()
        cm = 100 * (x - (x.min() + x.max()) / 2) / 511
        padded = np.pad(cm, (width // 2, width - 1 - width // 2), "edge")
        np.testing.assert_allclose(mine, np.convolve(padded, np.ones(width) / width, "valid"), atol=1e-9)


def jumps_left(x, y, threshold):
    """Kept indexes by the published loop over pairs of jumps."""
    step = np.hypot(np.diff(x), np.diff(y))
    at = np.nonzero(np.where(np.isnan(step), threshold, step) > threshold)[0]
    gone = set()
    for a, b in zip(at, at[1:]):
        if b == a + 1:
            gone.add(a + 1)
        elif (x[a + 1:b + 2] == x[a + 1]).all():
            gone |= set(range(a + 1, b + 2))
    return [k for k in range(len(x)) if k not in gone]


def test_jumps(spark):
    rng = random.Random(0)
    tracks = {"single": ([0, 1, 50, 2, 3, 4], [0] * 6), "stay": ([0, 1, 50, 50, 50, 2, 3], [0, 0, 5, 5, 5, 0, 0]), "same x": ([5, 5, 5, 5, 5, 5], [0, 0, 40, 40, 0, 0])}
    for k in range(20):
        tracks[f"r{k}"] = ([rng.choice([0, 1, 2, 30, 30, 31]) for _ in range(40)], [rng.choice([0, 0, 0, 20]) for _ in range(40)])
    rows = [(s, i, i * 0.02, None if s == "r3" and i % 7 == 0 else float(a), float(b)) for s, (x, y) in tracks.items() for i, (a, b) in enumerate(zip(x, y))]
    got = tracking.drop_jumps(spark.createDataFrame(rows, "session_id string, i long, t double, x double, y double"), 10.0).toPandas()
    for s in tracks:
        x, y = (np.array([r[c] if r[c] is not None else np.nan for r in rows if r[0] == s], float) for c in (3, 4))
        assert sorted(got[got.session_id == s].i) == jumps_left(x, y, 10.0), s


def test_clock_with_zero_stamps(spark):
    rows = [("a", k, t, 1.0, 1.0) for k, t in enumerate([1.0, 1.02, 1.02, 1.06, 0.0, 0.0])] + [("b", k, k * 0.5, 1.0, 1.0) for k in range(3)]
    got = tracking.repair_time(spark.createDataFrame(rows, "session_id string, i long, t double, x double, y double")).orderBy("session_id", "i").toPandas()
    np.testing.assert_allclose(got[got.session_id == "a"].t, [1.0, 1.02, 1.04, 1.06])
    assert got[got.session_id == "b"].t.tolist() == [0.0, 0.5, 1.0]


def test_anchor_halves_go_to_the_even_bin(spark):
    anchors = spark.createDataFrame([(1, 2.5, 3.5)], "k int, r double, c double")
    got = geometry.vectors_to_objects(anchors, ["k"], 8, 8, 8.0, 8.0, {"o": (2, 4)}).first()
    assert got.magnitude == 0


def test_trains_that_differ_late_are_no_copies(spark):
    rows = [("a", "s1", float(k)) for k in range(60)] + [("a", "s2", float(k)) for k in range(80)] + [("a", "s3", float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "site string, session string, t double")
    assert sorted(r.session for r in reports.first_of_copies(df, ["site"], "session", "t", ["t"]).collect()) == ["s1", "s2"]
    assert [r.session for r in reports.first_of_copies(df, ["site"], "session", "t", ["t"], prefix=50).collect()] == ["s1"]


def test_copies_stay_within_an_animal(spark, tmp_path):
    for animal in ("one", "two"):
        root = tmp_path / animal
        root.mkdir()
        rng = np.random.default_rng(5)
        (root / "s.1").write_bytes(tetrode_bytes(np.sort(rng.random(80) * 9), rng.integers(-90, 90, (80, 4, 50))))
        (root / "s_1.cut").write_bytes(cut_bytes(np.tile([0, 1, 2, 4], 20)))
    assert study.build_study(spark, str(tmp_path))["sessions"].count() == 2


def test_labels_of_failed_tasks_are_not_seen(tmp_path):
    w = formats.CutWriter({"path": str(tmp_path)})
    done = w.write(iter([{"name": "a.cut", "label": 1}, {"name": "a.cut", "label": 2}]))
    assert not (tmp_path / "a.cut").exists()
    w.commit([done])
    assert (tmp_path / "a.cut").read_text().endswith("1 2")
    w.abort([w.write(iter([{"name": "b.cut", "label": 1}]))])
    assert [p.name for p in tmp_path.iterdir()] == ["a.cut"]


def test_fisher_of_large_tables():
    from math import comb
    a, b, c, d = 1200, 1100, 900, 1300
    r, s, n = a + b, a + c, a + b + c + d
    p = lambda k: comb(s, k) * comb(n - s, r - k)
    want = sum(p(k) for k in range(max(0, r + s - n), min(r, s) + 1) if p(k) <= p(a)) / comb(n, r)
    assert abs(fisher_two_sided(a, b, c, d) / want - 1) < 1e-6
    assert 0 < fisher_two_sided(250_000_000, 250_000_100, 249_990_000, 250_000_000) < 1
