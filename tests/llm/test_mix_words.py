"""Words of each source against its own target."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from spikegrid.llm import mixing
from spikegrid.llm.common import saved
from tests.llm import brute

ROWS = "row_id string, source string, size long"


def test_small_sources_beside_large(spark):
    """Sizes as of 5e9 words: the error is measured against each source's target."""
    rng = random.Random(1)
    rows = [(f"L{s}-{k}", f"large{s:02}", 5_000_000) for s in range(20) for k in range(50)]
    rows += [(f"S{s}-{k}", f"small{s:03}", rng.randrange(200, 1201)) for s in range(200) for k in range(10)]
    rows += [("one", "tiny", 3), ("same", "zero", 0)]
    rows = saved(spark.createDataFrame(rows, ROWS), "rows")
    docs, taken = mixing.mix(rows)
    sums = taken.groupBy("row_id").agg(F.sum("words").alias("taken"), F.min("words").alias("least"))
    got = docs.join(sums, "row_id", "left").groupBy("source").agg(F.first("target").alias("target"), F.coalesce(F.sum("taken"), F.lit(0)).alias("taken"), F.min("least").alias("least")).collect()
    assert len(got) == 222
    for r in got:
        assert abs(r.taken - r.target) <= r.target / mixing.NEAR + 1 and (r.taken > 0) == (r.target > 0)
        assert r.least is None or r.least > 0
    last = taken.groupBy("slot").agg(F.sum("words")).agg(F.max("slot")).first()[0]
    assert last < mixing.SLOTS


def test_stage_has_the_words_of_the_mix(spark):
    """Sources of one or a few very long documents, and rows that repeat an id, among usual ones."""
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    rows = [(1, text(3000), "a"), (2, text(40), "b"), (3, text(9000), "c"), (4, text(2500), "d"), (4, text(2500), "d"), (4, text(2500), "d"), (5, None, "d"), (6, text(900), None)]
    rows += [(k, "\n" + text(rng.randrange(1, 60)) + " ", rng.choice("defg")) for k in range(10, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    got = corpus_pipeline.source_mix(spark, docs, "").collect()
    words = {}
    for r in got:
        assert r.n_chars == len(r.text) and any(i == r.doc_id and (t or "").startswith(r.text) for i, t, _ in rows)
        words[r.source] = words.get(r.source, 0) + len(brute.words(r.text))
    targets = {r.source: r.target for r in mixing.targets(docs.select("source", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long").alias("size"))).collect()}
    assert set(words) == set(targets) and all(abs(words[s] - targets[s]) <= targets[s] / mixing.NEAR + 1 for s in words)
