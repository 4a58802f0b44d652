"""Byte-built recordings through the data sources, and the study tables."""

import os
import struct

import numpy as np
import pytest

from spikegrid.sources import formats, study


def pos_bytes(n, missing=()):
    head = (f"trial_date Friday, 15 Aug 2014\r\nsample_rate 50.0 hz\r\npixels_per_metre 511\r\ntimebase 50 hz\r\n"
            f"num_pos_samples {n}\r\ndata_start").encode()
    body = b"".join(struct.pack(">i8h", k, 1023 if k in missing else 100 + k % 40, 200 + (k * 3) % 50, 0, 0, 0, 0, 0, 0) for k in range(n))
    return head + body + b"\r\ndata_end\r\n"


def tetrode_bytes(times, waves, day=15):
    n, ch, length = waves.shape
    head = (f"trial_date Friday, {day} Aug 2014\r\ntrial_time 15:21:10\r\nduration 10\r\nnum_chans 4\r\ntimebase 96000 hz\r\n"
            f"bytes_per_timestamp 4\r\nsamples_per_spike {length}\r\nsample_rate 48000 hz\r\nbytes_per_sample 1\r\nnum_spikes {n}\r\ndata_start").encode()
    body = b"".join(b"".join(struct.pack(">I", int(t * 96000)) + w[c].astype(np.int8).tobytes() for c in range(4)) for t, w in zip(times, waves))
    return head + body + b"\r\ndata_end\r\n"


def cut_bytes(labels):
    return f"n_clusters: 4\nExact_cut_for: x spikes: {len(labels)}\n{' '.join(map(str, labels))}\n".encode()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("rec") / "animal"
    root.mkdir()
    rng = np.random.default_rng(0)
    for name, day in (("s1", 15), ("s2", 16), ("copy", 17)):
        rng = np.random.default_rng(1 if name == "copy" else day if name == "s2" else 1)
        t = np.sort(rng.random(300) * 10)
        w = rng.integers(-90, 90, (300, 4, 50))
        lab = np.tile([0, 1, 2, 4], 75)
        (root / f"{name}.pos").write_bytes(pos_bytes(500, missing=(498, 499)))
        (root / f"{name}.1").write_bytes(tetrode_bytes(t, w, day))
        (root / f"{name}_1.cut").write_bytes(cut_bytes(lab))
        if name == "s1":
            np.savez(root.parent / "truth.npz", t=t, w=w, lab=lab)
    (root / "lonely.2").write_bytes(tetrode_bytes(t, w))
    return str(root)


def test_readers(spark, folder):
    formats.register(spark)
    truth = np.load(os.path.join(os.path.dirname(folder), "truth.npz"))
    pos = spark.read.format("recording_pos").option("splitBytes", 3000).load(folder + "/s1.pos").orderBy("i").toPandas()
    assert len(pos) == 500 and pos.x.isna().sum() == 2 and pos.t.iloc[50] == 1.0 and pos.x.iloc[3] == 103 and pos.ppm[0] == 511
    spk = spark.read.format("recording_tetrode").option("splitBytes", 7000).load(folder + "/s1.1").orderBy("spike_idx").toPandas()
    np.testing.assert_allclose(spk.t, np.floor(truth["t"] * 96000) / 96000)
    np.testing.assert_array_equal(np.stack(spk.samples), truth["w"].reshape(300, -1))
    cut = spark.read.format("recording_cut").load(folder + "/s1_1.cut").orderBy("spike_idx").toPandas()
    np.testing.assert_array_equal(cut.label, truth["lab"])


def test_study(spark, folder):
    st = study.build_study(spark, folder)
    ses = st["sessions"].orderBy("session_no").toPandas()
    assert [os.path.basename(s) for s in ses.signature] in (["s1", "s2"], ["copy", "s2"], ["s2", "copy"])
    assert list(ses.session_no) == [1, 2] and set(ses.animal_id) == {"animal_tet1"}
    got = st["spikes"].groupBy("label").count().toPandas()
    assert set(got.label) == {1, 2} and got["count"].sum() == 300      # 3 is the gap: label 4 is not a cell


def test_tracking_pipeline(spark, folder):
    t = study.read_tracking(spark, folder + "/s1.pos", 511.0, 20.0).toPandas()
    assert len(t) and t.x.abs().max() < 20 and t.t.min() == 0


def test_label_files(spark, folder, tmp_path):
    rows = [("a_1_matched.cut", k, k % 3) for k in range(50)] + [("b_1_matched.cut", k, 7) for k in range(5)]
    df = spark.createDataFrame(rows, "name string, spike_idx long, label int")
    formats.register(spark)
    formats.write_labels(df, str(tmp_path / "out"), "n_clusters: 9\n")
    back = spark.read.format("recording_cut").load(str(tmp_path / "out")).orderBy("path", "spike_idx").toPandas()
    assert list(back.label) == [k % 3 for k in range(50)] + [7] * 5
