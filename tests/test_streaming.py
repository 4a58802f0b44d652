"""Streaming measures over a replayed file stream agree with the batch ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spikegrid.functions.naming import ANGLES, LC_RULES, LEC_RULES, MEC_RULES, TRACK_RULES, is_cylinder, object_angle, parse_name, recording_date
from spikegrid.streaming import live


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stream") / "in")
    rng = np.random.default_rng(2)
    n = 200
    pdf = pd.DataFrame({
        "session_id": rng.integers(1, 3, n), "unit": "u", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.random(n) * 600), unit="s"),
        "x": rng.integers(0, 5, n).astype(float), "y": rng.integers(0, 5, n).astype(float)})
    df = spark.createDataFrame(pdf)
    df.coalesce(1).sortWithinPartitions("ts").write.parquet(folder)
    return folder, df


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_intervals_and_bursts(spark, source):
    folder, df = source
    s = spark.readStream.schema(df.schema).parquet(folder)
    got = drain(spark, live.interval_counts(s, "1 minute", "10 seconds"), "iv", "update")
    want = df.groupBy(F.window("ts", "1 minute").start.alias("start"), "session_id", "unit").count()
    assert got.agg(F.sum("n")).first()[0] == 200 and got.count() == want.count()
    b = drain(spark, live.bursts(s, "2 seconds", "10 seconds"), "bu")
    assert b.where("spikes < 1").count() == 0 and b.count() > 0
    o = drain(spark, live.occupancy(s, F.col("y").cast("int"), F.col("x").cast("int"), "10 seconds", "1 day"), "oc", "update")
    assert o.agg(F.sum("n")).first()[0] == 200


def test_state(spark, source):
    from spikegrid.operators.signals import adaptive_rate
    from spikegrid.operators.tracking import with_heading

    folder, df = source
    s = spark.readStream.schema(df.schema).parquet(folder)
    got = drain(spark, live.adaptive_rate(s, 20.0, "10 seconds"), "ar")
    t = df.withColumn("t", F.unix_micros("ts") / 1e6).withColumn("i", F.monotonically_increasing_id())
    want = adaptive_rate(t, ["session_id", "unit"], 20.0)
    a, b = sorted(r.rate for r in got.collect()), sorted(r.rate for r in want.collect())
    np.testing.assert_allclose(a, b, rtol=1e-6)
    h = drain(spark, live.headings(s, "10 seconds"), "hd")
    w = with_heading(t.select("session_id", "t", "i", "x", "y"))
    np.testing.assert_allclose(sorted(r.heading for r in h.collect()), sorted(r.heading for r in w.collect()), atol=1e-9)


def test_names(spark):
    names = [("MEC-1_20210304-02-a-1500-x", MEC_RULES, ("1500", "MEC-1", "20210304")),
             ("L-10262021-mX-PHF-1uL-HPC-950um-900s-Rectangle", LC_RULES, ("950", "L", "10262021")),
             ("M1_B6_4mo_session1_B_1m_lineartrack_042024_1050um", TRACK_RULES, ("1050", "M1", "042024")),
             ("B6-LEC1_20151211-cylinder-0", LEC_RULES, ("", "B6-LEC1", "20151211"))]
    for text, rules, (depth, name, date) in names:
        r = spark.createDataFrame([(text,)], "f string").select(parse_name(F.col("f"), rules).alias("p"), is_cylinder(F.col("f")).alias("c")).first()
        assert r.p is not None and (r.p.depth or "") == depth and r.p.name == name and r.p.date == date, text
        assert r.c == ("cylinder" in text)
    # too many or too few parts are no such layout
    for text in ("MEC-1_20210304-02-a-b-1500-x", "MEC_20210304-02-1500-x", "A-B-C_20210304-2-a-1500-x"):
        assert spark.createDataFrame([(text,)], "f string").select(parse_name(F.col("f"), MEC_RULES).alias("p")).first().p is None
    a = spark.createDataFrame([(k,) for k in [*ANGLES, "17"]], "s string").select(object_angle(F.col("s")).alias("a")).collect()
    assert [r.a for r in a] == [*ANGLES.values(), None]
    d = spark.createDataFrame([("20210304",), ("10262021",)], "s string").select(recording_date(F.col("s")).alias("d")).collect()
    assert [str(r.d) for r in d] == ["2021-03-04", "2021-10-26"]
