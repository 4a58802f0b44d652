"""Histogram edges against NumPy; report tables out and in."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikegrid.operators import summaries
from spikegrid.sources import tables


@pytest.mark.parametrize("edges", [[0.0, 1.0], [0.0, 0.5, 2.0, 2.25, 9.0], summaries.even_edges(-3.0, 7.0, bins=17)])
def test_histogram_as_numpy(spark, edges):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(2, 3, 400), edges, [np.nan]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    got = {r.x_bin: r.n for r in summaries.histogram(df, [], "x", edges).collect()}
    want = np.histogram(x[~np.isnan(x)], edges)[0]
    assert [got.get(k, 0) for k in range(len(want))] == want.tolist()
    assert summaries.limits(df, "x") == (np.nanmin(x), np.nanmax(x))
    assert summaries.limits(df.where("x > 1e9"), "x") is None


def test_edges_by_width():
    assert summaries.even_edges(0, 10, width=2.5) == [0, 2.5, 5.0, 7.5, 10]
    assert len(summaries.even_edges(0, 10, width=3)) == 5
    with pytest.raises(ValueError):
        summaries.even_edges(0, 1)


def test_reports_out_and_in(spark, tmp_path):
    df = spark.range(200).select((199 - F.col("id")).alias("id"), (F.col("id") % 7).cast("string").alias("name"))
    for ending in ("csv", "parquet"):
        path = str(tmp_path / f"report.{ending}")
        tables.save_report(df, path, ["id"])
        parts = [spark.read.option("header", True).csv(f) if ending == "csv" else spark.read.parquet(f) for f in sorted(glob.glob(path + "/part-*"))]
        assert [int(r.id) for p in parts for r in p.collect()] == list(range(200))
        with pytest.raises(Exception):
            tables.save_report(df, path)
        tables.save_report(df, path, append=True)
        assert tables.read_report(spark, path).count() == 400
    both = tables.join_report(df, spark.createDataFrame([(3, "x", 1.5)], "id long, name string, depth double"), ["id"])
    assert both.columns == ["id", "name", "depth"] and both.where("depth IS NOT NULL").count() == 1
