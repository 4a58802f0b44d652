"""The registered queries on whole given tables against plain versions."""

import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from spikegrid.llm import mixing, quality, tokens
from spikegrid.llm.queries import ORACLE, QUERIES
from tests.llm import brute
from tests.llm.test_operators import sorted_rows
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def run(spark, name):
    return QUERIES[name](spark, SF)


def test_all_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    assert compare(run(spark, name), connect(SF), ORACLE[name]) is None


def test_op1(spark, docs):
    p = run(spark, "op1_sampled_splitters").toPandas()
    assert sorted_rows(p[["doc_id", "size", "text_crc32"]].itertuples(index=False)) == sorted_rows(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in docs)
    sums, slots = p.groupby("shard")["size"].sum(), p.groupby("shard")["slot"]
    assert sorted(p["shard"].unique()) == list(range(24)) and (slots.max() + 1 == slots.nunique()).all()
    assert sums.max() - sums.min() <= 2 * p["size"].max()


def test_op2(spark, docs):
    p = run(spark, "op2_mcd_outliers").toPandas()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted_rows(p[names].itertuples(index=False)) == sorted_rows((i, *brute.statistics(t)) for i, t, _ in docs)
    again = quality.judged(spark.read.parquet(f"{SF}/documents.parquet")).toPandas().set_index("doc_id")
    assert (p.set_index("doc_id").kept == again.kept).all()


@pytest.mark.parametrize("name,end", [("op3_wavelet_matrix", 1), ("op10_harmonic_packing", 2)])
def test_token_queries(spark, docs, name, end):
    library = Tokenizer.from_file(tokens.default_path())
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [end] for i, t, _ in docs}
    p = run(spark, name).toPandas().sort_values(["doc_id", "start"])
    if end == 1:
        at = np.cumsum([0] + [len(ids[i]) for i in sorted(ids)])[:-1]
        assert list(p.itertuples(index=False, name=None)) == [(i, s, len(ids[i]), brute.crc(ids[i])) for i, s in zip(sorted(ids), at.tolist())]
    else:
        assert all(r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == brute.crc(ids[r.doc_id][r.start:r.start + r.length]) for r in p.itertuples())
        assert p.length.sum() == sum(map(len, ids.values())) and not p.duplicated(["sequence_id", "offset"]).any()
        assert p.groupby("sequence_id").length.sum().max() <= 4096


def test_op4(spark):
    pages = duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in run(spark, "op4_ngram_logistic").collect()}
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    assert len(got) == len(pages)
    for i, url in pages:
        rest = (url or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path) == (host, path)
        assert (got[i].rule, got[i].verdict) == max(fits)[1:] if fits else got[i].rule is None and got[i].verdict in ("allow", "block")


def test_op5(spark, docs):
    assert sorted_rows(run(spark, "op5_difference_cover").collect()) == sorted_rows(brute.without_earlier([(i, t) for i, t, _ in docs]))


def test_op6(spark, docs):
    assert sorted_rows(run(spark, "op6_simhash_pigeonring").collect()) == sorted_rows(brute.components([(i, t) for i, t, _ in docs]))


def test_op8_reruns_agree(spark):
    a, b = (sorted_rows(run(spark, "op8_low_discrepancy_mix").collect()) for _ in range(2))
    assert a == b
    p = mixing.mix_documents(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    total = p["size"].sum()
    by = p.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").toPandas().set_index("doc_id"), on="doc_id").groupby("source")
    assert abs(by.taken.sum() - by.target.first()).max() <= 0.002 * total + 5 and (p.taken <= 3 * p["size"]).all()


def test_op9(spark):
    r = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchnumpy()
    x, ids = np.stack(r["embedding"]).astype(float), r["vec_id"]
    p = run(spark, "op9_adaptive_scan").toPandas()
    hit = total = 0
    for k in np.nonzero(ids % 20 == 0)[0]:
        s = x @ x[k]
        mine = p[p.query_id == ids[k]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine.score, s[np.searchsorted(ids, mine.vec_id)], atol=1e-12)
        s[k] = -9
        hit, total = hit + len(set(ids[np.argsort(-s)[:20]]) & set(mine.vec_id)), total + 20
    assert hit / total >= 0.9
