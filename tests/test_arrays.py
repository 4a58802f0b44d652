"""Labelled arrays and record tables: round trip, records once, a failed export leaves nothing."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikegrid.sources import arrays


@pytest.fixture
def rows(spark):
    data = [(s, k, k * 0.5 if k % 7 else None, [float(k), float(-k), 1.0]) for s, n in (("s1", 50), ("s2", 3)) for k in range(n)]
    return spark.createDataFrame(data, "session string, i long, t double, wave array<double>")


def both(rows, chunk=16):
    t = arrays.to_arrays(rows, "session", "i", "t", F.col("t"), ["spike"], {"unit": "s"}, chunk=chunk)
    return t.unionByName(arrays.to_arrays(rows, "session", "i", "wave", F.col("wave"), ["spike", "sample"], width=3, chunk=chunk))


def animals(spark, *names):
    return {"animals": (spark.createDataFrame([(n, f"note {k}") for k, n in enumerate(names)], "animal string, note string"), ["animal"])}


def test_round_trip(spark, rows, tmp_path):
    out = str(tmp_path / "out")
    name = arrays.write_export(both(rows), out, animals(spark, "a", "b", "a"))
    got = {}
    for r in arrays.read_arrays(spark, out, chunk=7).orderBy("session", "array", "start").collect():
        got.setdefault((r.session, r.array, tuple(r.dims), tuple(r.shape), r.attrs.get("unit")), []).extend(r["values"])
    assert set(got) == {("s1", "t", ("spike",), (50,), "s"), ("s2", "t", ("spike",), (3,), "s"),
                        ("s1", "wave", ("spike", "sample"), (50, 3), None), ("s2", "wave", ("spike", "sample"), (3, 3), None)}
    t = np.array([k * 0.5 if k % 7 else np.nan for k in range(50)])
    np.testing.assert_array_equal(got[("s1", "t", ("spike",), (50,), "s")], t)
    (entry,) = [e for e in arrays.manifests(out)[0][1]["arrays"] if (e["session"], e["array"]) == ("s1", "wave")]
    plain = np.load(os.path.join(out, name, entry["file"]))                 # the files are plain .npy
    np.testing.assert_array_equal(plain, [[k, -k, 1] for k in range(50)])
    assert sorted(map(tuple, arrays.read_records(spark, out, "animals").collect())) == [("a", "note 0"), ("b", "note 1")]


def test_records_once(spark, rows, tmp_path):
    out = str(tmp_path / "out")
    for names in (("a", "b"), ("b", "c", "c")):
        arrays.write_export(both(rows.where("session = 's2'")), out, animals(spark, *names))
    assert sorted(map(tuple, arrays.read_records(spark, out, "animals").collect())) == [("a", "note 0"), ("b", "note 1"), ("c", "note 1")]
    assert len(arrays.manifests(out)) == 2


@pytest.mark.parametrize("fault", ["start <> 16", "raise_error('killed') IS NULL"])
def test_failed_export_leaves_nothing(spark, rows, tmp_path, fault):
    out = str(tmp_path / "out")
    arrays.write_export(both(rows), out, animals(spark, "a"))
    before = sorted(os.listdir(out))
    with pytest.raises(Exception):
        arrays.write_export(both(rows).where(fault), out, animals(spark, "z"))
    assert sorted(os.listdir(out)) == before
    assert [r.animal for r in arrays.read_records(spark, out, "animals").collect()] == ["a"]


def test_nothing_exported(spark, rows, tmp_path):
    out = str(tmp_path / "none")
    assert arrays.read_arrays(spark, out).collect() == [] and arrays.read_records(spark, out, "animals") is None
    arrays.write_export(both(rows.where("false")), out)
    assert arrays.read_arrays(spark, out).collect() == [] and len(arrays.manifests(out)) == 1
