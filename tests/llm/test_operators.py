"""The operators on small tables with every awkward case: nulls in any column, empty and
very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from spikegrid.llm import mixing, packing, quality, sharding, simhash, suffix_dedup, token_files, tokens, url_filter, url_labels, vector_search, warc
from spikegrid.llm.components import components
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, n string, key string, fp string, _piece string, file string, h string, block int"


def some_words(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('Tatibo')}w{rng.randrange(vocabulary)}é" for _ in range(n))


def awkward_rows():
    rng = random.Random(3)
    base = some_words(rng, 120)
    passage = some_words(rng, 40)
    texts = [(k, some_words(rng, rng.randrange(1, 150))) for k in range(10, 50)]
    texts += [(50, base), (51, base), (52, base.replace("w1", "w2", 1)), (52, base), (7, base), (None, base), (None, None), (3, None), (4, ""), (5, " \n\t "),
              (60, "one"), (61, "one two"), (62, "A\nB c\nA\n\nA "), (63, "x " * 300), (64, some_words(rng, 9000)), (65, passage + " tail"), (66, "head " + passage + " mid " + passage),
              (67, "é" * 80 + "|#*"), (68, "è" * 80), (69, "<|endoftext|> Ünïcode’s ﬁne\u3000日本語 İΣ"), (70, "\x1c odd \x85 spaces\xa0here"), (50, base)]
    langs, sources = ["en", "de", None, ""], ["a", "b", "é", None]
    return [(i, t, langs[k % 4], sources[(k // 3) % 4], len(t or ""), -1, "x", "y", "z", "f", "p", "g", "h", 7) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, str(type(x)), x) for x in r])


def test_shards(docs, rows, nothing):
    got = sharding.shard_documents(docs, 6, ranges=8, rows_per_piece=5).collect()
    want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "bytes", None) for i, t, *_ in rows]
    assert sorted_rows((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == sorted_rows(want)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by.values())
    small = sharding.shard_documents(docs.where("doc_id <> 64 AND doc_id <> 50"), 4, ranges=8, rows_per_piece=5).collect()
    sums = [sum(r.size for r in small if r.shard == s) for s in range(4)]
    assert max(sums) - min(sums) <= 2 * max(r.size for r in small)
    assert sharding.shard_documents(nothing).collect() == []


def test_statistics(docs, rows, nothing):
    got = quality.verdicts(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted_rows(got.select("doc_id", *names).collect()) == sorted_rows((i, *brute.statistics(t)) for i, t, *_ in rows)
    for r in got.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.verdicts(nothing).collect() == []
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()


def test_determinant_against_plain(spark):
    """Distances equal those of a plain loop over each group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("source IN ('src0', 'src1', 'src2')")
    got = quality.judged(docs).where("NOT base_failed").toPandas().sort_values("doc_id")
    x = quality.statistics(docs).select("doc_id", "n_words", "n_repeat_words", *[quality._long(c).alias(f"x{k}") for k, c in enumerate(quality.transformed())])
    x = x.where(~quality.base_failed()).toPandas().sort_values("doc_id")[[f"x{k}" for k in range(5)]].to_numpy().clip(-16384, 16384).astype(float)
    groups = got.groupby(["lang", "source"]).indices
    model = {}
    for g, at in groups.items():
        low = lambda v: np.sort(v)[(len(v) + 1) // 2 - 1]
        m = np.array([low(x[at, k]) for k in range(5)])
        d = np.array([low(abs(x[at, k] - m[k])) for k in range(5)])
        model[g] = m, np.diag((d * 1.4826 + quality.FLOOR * 1024) ** 2)
    distance = np.zeros(len(x))

    def measure():
        for g, at in groups.items():
            y = x[at] - model[g][0]
            distance[at] = np.einsum("ij,ij->i", y, np.linalg.solve(model[g][1], y.T).T)

    for _ in range(quality.STEPS):
        measure()
        chosen = {}
        for g, at in groups.items():
            bins = np.floor(np.log1p(distance[at]) * quality.BINS_PER_UNIT)
            edge = np.sort(bins)[int(np.ceil(len(at) * quality.SHARE)) - 1]
            chosen[g] = at[bins <= edge]
        within = sum(np.cov(x[at].T, bias=True) * len(at) for at in chosen.values() if len(at) > 1)
        within = within / sum(map(len, chosen.values()))
        for g, at in chosen.items():
            own = np.cov(x[at].T, bias=True) * len(at) if len(at) > 1 else np.zeros((5, 5))
            cov = (own + within * quality.PRIOR) / (len(at) + quality.PRIOR)
            model[g] = x[at].mean(axis=0), cov * quality.CONSISTENCY + np.eye(5) * (quality.FLOOR * 1024) ** 2
    measure()
    assert np.allclose(got["distance"], distance, rtol=1e-6)
    assert ((got["distance"] <= quality.CUTOFF) == got["kept"]).all()


def test_outliers_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    p = quality.judged(docs).where("NOT base_failed").join(labels, "doc_id").toPandas()
    assert p[p.quality == 1].kept.mean() > 0.98 and p[p.quality == 0].distance.median() > quality.CUTOFF


def ids_of(rows, end):
    library = Tokenizer.from_file(tokens.default_path())
    return [(i, library.encode(t or "", add_special_tokens=False).ids + [end]) for i, t, *_ in rows]


def test_encoder(rows):
    got = tokens.Encoder(tokens.default_path()).encode([t or "" for _, t, *_ in rows])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [x[:-1] for _, x in ids_of(rows, 0)]


def test_words_of_many_texts():
    """Words as by the rule of the tokenizer file, each looked up once for all texts (F1)."""
    letters, numbers = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
    rule = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}\\s]+")
    rng = np.random.default_rng(3)
    pieces = ["'", "'s", "'ll", "'ve", "'re", "'d", "'r", "'l", "s", "ve", "e", "l", "x1", "42", "\xb2", "\xe9", "\xd7", ".", "''", " ", "\n", "\t", "\xa0", "\x00", "\x84", "#"]
    texts = ["", " ", "'", "it's", "'s's", "'ll'", "o'", "\xa0"] + ["".join(rng.choice(pieces, rng.integers(0, 30))) for _ in range(3000)]
    for t in texts:
        words, places = tokens.split_words(f" {t}  ")
        assert [w.decode("latin-1") for w in words.to_pylist()] == rule.findall(t)
        assert places.tolist() == [m.start() + 1 for m in rule.finditer(t)]
    library = Tokenizer.from_file(tokens.default_path())
    texts += ["\u4e2d \u0e01", "a <|endoftext|> b", "\x85 \x1c"] + texts[:9]
    assert [np.frombuffer(g, "<u4").tolist() for g in tokens.Encoder(tokens.default_path()).encode(texts)] == [
        library.encode(t, add_special_tokens=False).ids for t in texts]

    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    e = tokens.Encoder(tokens.default_path())
    e.words = Counted()
    got = e.encode(["the cat's 2 hats, " * 500] * 20)
    assert e.words.asked <= 6 and len(set(got)) == 1


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 40)
    monkeypatch.setattr(tokens, "SLICE", 60)
    library, e = Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path())
    texts = [f"alpha{k % 7}x beta\xe9{'xyz'[k % 3] * (k % 11)} 'tis {k}" for k in range(200)]
    assert [np.frombuffer(g, "<u4").tolist() for g in e.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(e.words) + len(e.older) < 120


def test_wavelet_file():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 300, 10_000).astype(np.uint32)
    f = token_files.WaveletFile(token_files.to_bytes([None, 5], [4000, 6000], ids, 16))
    assert f.doc_ids == [None, 5] and f.decode().tolist() == ids.tolist()
    for i in rng.integers(0, 10_000, 50).tolist():
        token = int(ids[i])
        assert f.access(i) == token and f.count(token, i) == int((ids[:i] == token).sum())
        assert f.find(token, int((ids[:i] == token).sum())) == i
    assert f.count(999) == 0 and f.find(999, 0) == -1


def test_token_files(docs, rows, nothing):
    got = token_files.token_digests(docs, shard_tokens=500).collect()
    want = sorted(((i is not None, i or 0, t or ""), x) for (i, t, *_), (_, x) in zip(rows, ids_of(rows, 1)))
    at, full = 0, []
    for (there, i, _), x in want:
        full.append((i if there else None, at, len(x), brute.crc(x)))
        at += len(x)
    # rows with equal ids may come in either order of null and empty text: their ids are equal
    assert sorted_rows(got) == sorted_rows(full)
    assert token_files.token_digests(nothing).collect() == []


def test_packing(docs, rows, nothing):
    got = packing.pack(docs, rows_per_piece=20, with_ids=True).collect()
    by = {}
    for r in got:
        assert brute.crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for i, x in ids_of(rows, 2):
        mine = [r for r in by[i, len(x)] if r.ids == np.asarray(x[r.start:r.start + r.length], "<u4").tobytes()]
        assert {p for r in mine for p in range(r.start, r.start + r.length)} == set(range(len(x)))
    assert sum(r.length for r in got) == sum(len(x) for _, x in ids_of(rows, 2))
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(n for _, n in p) <= 4096
    assert packing.pack(nothing).collect() == []


def test_cuts_fill_classes():
    for n in range(1, 9000):
        parts = packing.cuts(n)
        assert sum(parts) == n and max(parts) <= 4096 and len(parts) <= n // 4096 + 6


def test_harmonic_padding(spark):
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    assert 1 - got.length.sum() / (4096 * got.sequence_id.nunique()) < 0.02


def test_wavelet_ids_too_large():
    with pytest.raises(ValueError):
        token_files.build(np.array([1, 70_000], np.uint32), 16)
    planes, zeros, _ = token_files.build(np.array([70_000, 1], np.uint32), 17)
    assert len(planes) == 17 and zeros[0] == 1


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/x?y"), (2, "http://example.com/en/"), (3, "https://a.example.com/en/z#q"), (4, "http://com/q"), (5, "http://xcom/q"), (6, None),
            (7, "no scheme"), (8, "x://b.net/es/1"), (9, "x://b.net/es"), (10, "http://casino-win.example.org/en/1"), (11, "http://y.org?u=://net/fr/"), (12, "http://net/fr/a"), (None, ""), (12, "http://net/fr/a")]
    rows += [(k, f"http://{'casino-win' if k % 3 == 0 else 'thing'}.example.org/en/{k}") for k in range(100, 160)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")
                                                   .selectExpr("*", "'x' AS host", "1 AS path", "2 AS rule", "3 AS block")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert [got[k].rule for k in (2, 3, 4, 5, 8, 9, 12)] == ["example.com/en/", "example.com/en/", "com/", None, "net/es/", None, "net/fr/"]
    assert [got[k].verdict for k in (2, 3, 4, 8, 12)] == ["block", "block", "allow", "block", "block"]
    assert (got[6].host, got[6].path, got[7].host) == ("", "", "") and (got[11].host, got[11].path) == ("y.org", "")
    assert got[10].verdict == "block" and got[101].verdict == "allow" and len(got) == len({r[0] for r in rows})
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def fitted(rows):
    return url_filter.fit([t for t, _ in rows], np.array([b for _, b in rows], float))


def test_url_model_unseen_names():
    bad, good = url_labels.unwanted_names(), url_labels.ordinary_names()
    hits = misses = false = 0
    for fold in range(3):
        out = frozenset(bad[fold::3] + good[fold::3])
        w = fitted(url_filter.drawn(url_labels.table(out)))
        blocked = lambda names: [x for k, n in enumerate(names) if n in out for x in url_filter.scores(url_labels.forms(n, k * 5), w) > 0]
        on_bad, on_good = blocked(bad), blocked(good)
        hits, misses, false = hits + sum(on_bad), misses + on_bad.count(False), false + sum(on_good)
    assert hits / (hits + false) > 0.98 and hits / (hits + misses) > 0.88


def test_url_model_paths():
    w = fitted(url_filter.drawn(url_labels.table()))
    z = url_filter.scores(["www.city-library.example.org /casino/bonus", "www.city-library.example.org /en/12.html", "unheard.example.net /de/1", ""], w)
    assert list(z > 0) == [True, False, False, False]


def test_url_model_plain():
    texts = ["a.b /c", "", "x", "münchen.example /straße/", "a.b /c" * 40]
    w = np.random.default_rng(0).normal(size=url_filter.BUCKETS + 1)
    for text, got in zip(texts, url_filter.scores(texts, w)):
        raw, found = b"^" + text.encode() + b"$", []
        for n in (3, 4, 5):
            for k in range(len(raw) - n + 1):
                h = n
                for byte in raw[k:k + n]:
                    h = (h * 0x100000001B3 + byte + 1) % 2**64
                found.append(((h * 0x9E3779B97F4A7C15) % 2**64 >> 40) % url_filter.BUCKETS)
        assert abs(got - sum(w[f] for f in found) / max(len(found), 1) ** 0.5 - w[-1]) < 1e-9
    table = [("good.one /", False), ("bad.two /", True), ("bad.three /", True)]
    w = fitted(table)
    loss = lambda v: sum(np.log1p(np.exp(-z if b else z)) * (0.15 if b else 0.7) for (t, b), z in zip(table, url_filter.scores([t for t, _ in table], v))) + url_filter.PENALTY / 2 * (v[:-1] @ v[:-1])
    rng = np.random.default_rng(1)
    assert all(loss(w) <= loss(w + 0.1 * np.append(rng.normal(size=len(w) - 1), 0)) for _ in range(20)) and loss(w) < 0.1
    assert url_filter.drawn([("a", True)] * 3 + [("b", False)], 1) == [("a", True), ("b", False)]


def test_suffix_dedup(docs, rows, nothing):
    want = brute.without_earlier([(i, t) for i, t, *_ in rows])
    got = suffix_dedup.dedup(docs, block_bytes=3000, bucket_rows=500).collect()
    assert sorted_rows(got) == sorted_rows(want)
    assert suffix_dedup.dedup(nothing).collect() == []
    clean = suffix_dedup.without_repeats(docs)
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert 51 not in texts and texts[4] == "" and texts[3] is None and texts[65].endswith(" tail")


def test_difference_covers():
    for v, cover in suffix_dedup.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_suffix_codes_on_random_texts(spark):
    rng = random.Random(9)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 160)))) for k in range(120)]
    rows += [(200 + k, rows[k][1][rng.randrange(40):] + rows[k + 1][1]) for k in range(60)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=20, block_bytes=2000, bucket_rows=300)
    assert sorted_rows(got.collect()) == sorted_rows(brute.without_earlier(rows, 20))


def test_simhash(docs, rows, nothing):
    want = brute.components([(i, t) for i, t, *_ in rows])
    for bucket in (2000, 2):            # 2: every shared key is split
        assert sorted_rows(simhash.near_duplicates(docs, bucket).collect()) == sorted_rows(want)
    assert simhash.near_duplicates(nothing).collect() == []


def test_simhash_bridges_without_id(spark, monkeypatch):
    """Fingerprints 0, 1 and 2 lie within the limit, 7 and 8 from both ends of another chain; one in
    the middle has no id, another text repeats an id of an unrelated one."""
    fps = [(5, 1), (None, 0), (9, 2), (4, 1 << 40), (9, 0x7 << 50 | 1 << 40), (None, 0x3F << 50 | 1 << 40), (3, 0xFFFF << 16), (3, 0x5555 << 33)]
    table = spark.createDataFrame(fps, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "with_fingerprints", lambda docs: docs)
    got = simhash.near_duplicates(table).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 4), (0, 4), (3, 3), (3, 3), (4, 4), (5, 4), (9, 4), (9, 4)]


def test_simhash_chains_prune():
    """Every pair within three bits survives the chains, none beyond does."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base, *[base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, n, False))) for n in (1, 2, 3, 3, 4, 4, 5)]])
    x, y = simhash.within(fps[:, None] ^ fps[None, :])
    assert set(zip(x.tolist(), y.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3))))


def test_simhash_links_are_whole(spark):
    """Random and near fingerprints: the linked groups are those of all pairs."""
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [f ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), False))) for f in fps for _ in range(6)]
    fps = np.unique(np.concatenate([fps, np.array(near, np.uint64)]))
    want = {tuple(sorted(p)) for p in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)) if p[0] < p[1]}
    for bucket in (2000, 3):
        rows = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), bucket).collect()
        at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
        got = {tuple(sorted((at[r.a], at[r.b]))) for r in rows}
        assert got <= want
        assert groups(len(fps), got) == groups(len(fps), want)


def groups(n, edges):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(60)] + [(500, k) for k in range(501, 560)]
    want = groups(600, edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: want[k] for k in {x for e in edges if e[0] != e[1] for x in e}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_archives(spark):
    big = "x" * 150
    rows = [(5, "http://B.org/a", big), (2, "http://a.org/a", big), (9, None, big), (None, "http://c.org", big), (1, "http://a.org/b", "short"), (3, "http://a.org/b", "short"),
            (4, "u\r\nInjected: 1", None), (6, "", ""), (7, "http://a.org/z", "é" * 60), (8, "http://a.org/z", "é" * 60), (8, "http://a.org/z", "é" * 60), (10, "http://a.org/long", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, 1, "f") for r in rows], "page_id long, url string, html string, first int, digest string")
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if g == h and j is not None]
        first = min(same) if len(b) >= 100 else None
        visit = first is not None and i != first
        import hashlib
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if visit else "response", first if visit else None))
    got = warc.archived(pages, archive_bytes=400, range_rows=3).collect()
    assert sorted_rows(got) == sorted_rows(want)
    index, _ = warc.archive(pages, archive_bytes=400, range_rows=3)
    order = [(r.key, r.time, r.page) for r in index.orderBy("range", "place").collect()]
    assert order == sorted(order) and len(order) == len(rows)
    assert warc.archived(pages.limit(0)).collect() == []


def test_loser_tree():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(30),) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_mix(docs, rows, nothing):
    got = mixing.mix_documents(docs).collect()
    sizes = [len(brute.words(t)) for _, t, *_ in rows]
    assert sorted_rows((r.doc_id, r.size) for r in got) == sorted_rows((r[0], n) for r, n in zip(rows, sizes))
    sums = {}
    for r, n in zip(rows, sizes):
        sums[r[3]] = sums.get(r[3], 0) + n
    order = sorted(sums, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        left = sum(sizes) - sum(target.values())
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > 3 * sums[s]}
        if not over:
            break
        target |= {s: 3 * sums[s] for s in over}
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    by = {}
    for r in got:
        assert r.taken <= 3 * r.size
        by.setdefault((r.source_size, r.target), 0)
        by[r.source_size, r.target] += r.taken
    for s in order:
        near = [(k, v) for k, v in by.items() if k[0] == sums[s] and abs(k[1] - target[s]) < 1e-6 * (1 + target[s])]
        assert near and abs(near[0][1] - target[s]) <= 0.01 * sum(sizes) + 5
    assert mixing.mix_documents(nothing).collect() == []
    taken = mixing.take_documents(docs)
    assert taken.columns == docs.columns and 0 < taken.count() <= 3 * len(rows)


def test_mix_of_skewed_pieces(docs):
    """Totals do not depend on how a source's stream is numbered."""
    a = mixing.mix_documents(docs, rows_per_piece=1)
    b = mixing.mix_documents(docs)
    assert sorted_rows(a.collect()) == sorted_rows(b.collect())


def test_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((700, 16))
    x[100:200] = x[100]                                   # one vector many times
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(800, None), (820, [0.0] * 16), (840, [float("nan")] + [1.0] * 15), (860, [None] + [1.0] * 15), (880, [float("inf")] * 16), (900, [1.0]), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS list", "2 AS v", "3 AS block")
    x = x.astype(np.float32).astype(float)
    got = {}
    for r in vector_search.search(table, lists=8, probes=8, rows=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        s = x @ x[q]
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in found)
        assert [f[1] for f in found] == [f[1] for f in sorted(found, key=lambda f: (-f[2], f[1]))]
        s[q] = -1e9
        best = np.lexsort((np.arange(700), -s.round(9)))[:20]
        hit += len(set(best.tolist()) & {f[1] for f in found})
    assert hit / (20 * len(got)) > 0.97
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in vector_search.search(few).orderBy("query_id", "rank").collect()] == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
    assert vector_search.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_vector_recall_on_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = table.toPandas()
    x, ids = np.stack(p["embedding"]).astype(float), p["vec_id"].to_numpy()
    found = {}
    for r in vector_search.search(table).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for k in np.nonzero(ids % 20 == 0)[0]:
        s = x @ x[k]
        s[k] = -9
        hit += len(set(ids[np.argsort(-s)[:20]].tolist()) & found[ids[k]])
    assert hit / (20 * len(found)) >= 0.93
