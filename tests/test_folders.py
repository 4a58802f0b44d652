"""Folders as a stream: a damaged folder, a restart, a batch done twice, a retry."""

import os

import numpy as np
import pytest

from spikegrid.streaming import folders
from tests.test_sources import cut_bytes, pos_bytes, tetrode_bytes


def add(root, name, n=60, damaged=False, ready=True):
    d = root / name
    d.mkdir(parents=True)
    rng = np.random.default_rng(len(name) + n)
    spikes = tetrode_bytes(np.sort(rng.random(n) * 10), rng.integers(-90, 90, (n, 4, 50)))
    (d / "s1.pos").write_bytes(pos_bytes(500))
    (d / "s1.1").write_bytes(spikes[:len(spikes) // 2] if damaged else spikes)
    (d / "s1_1.cut").write_bytes(cut_bytes(np.tile([1, 2, 3], n // 3)))
    if ready:
        (d / "READY").write_bytes(b"1")
    return d


def run(spark, root, out, mark, **more):
    folders.start(spark, str(root), str(out), str(mark), **more).awaitTermination()


@pytest.fixture
def place(tmp_path):
    return tmp_path / "in", tmp_path / "out", tmp_path / "mark"


def names(rows):
    return sorted(os.path.basename(r["folder"]) for r in rows.select("folder").distinct().collect())


def test_damaged_folder_and_restart(spark, place):
    root, out, mark = place
    add(root, "a"), add(root, "b", damaged=True), add(root, "deep/c", n=30), add(root, "late", ready=False)
    seen = []

    def work(s, folder):
        seen.append(os.path.basename(folder))
        return folders.study_tables(s, folder)

    run(spark, root, out, mark, work=work, per_batch=2)
    assert sorted(seen) == ["a", "b", "c"]
    assert names(folders.status(spark, str(out)).where("ok")) == ["a", "c"]
    (bad,) = folders.errors(spark, str(out)).collect()
    assert bad["folder"].endswith("/b") and bad["error"]
    assert folders.results(spark, str(out), "spikes").count() == 90

    (root / "late" / "READY").write_bytes(b"1")
    run(spark, root, out, mark, work=work, per_batch=2)
    assert sorted(seen) == ["a", "b", "c", "late"]                      # nothing is done twice
    assert names(folders.results(spark, str(out), "sessions")) == ["a", "c", "late"]
    assert folders.results(spark, str(out), "spikes").count() == 150


def test_batch_done_again_replaces(spark, place):
    root, out, _ = place
    a = str(add(root, "a"))
    for _ in range(2):
        folders.work_on(spark, [a, a], str(out), 0)
    assert folders.results(spark, str(out), "spikes").count() == 60 and folders.status(spark, str(out)).count() == 1


def test_half_written_folder_gives_no_rows(spark, place):
    root, out, _ = place
    a = str(add(root, "a"))

    def work(s, folder):
        tables = folders.study_tables(s, folder)
        return {**tables, "broken": tables["spikes"].selectExpr("raise_error('no')  AS x")}

    folders.work_on(spark, [a], str(out), 0, work)
    assert folders.results(spark, str(out), "spikes").count() == 0 and folders.errors(spark, str(out)).count() == 1
    folders.retry(spark, str(out))
    assert folders.results(spark, str(out), "spikes").count() == 60 and folders.errors(spark, str(out)).count() == 0
