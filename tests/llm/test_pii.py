"""Personal data: the registered query and the operator against plain expressions."""

import hashlib
import random
import re
import time

import duckdb
import pytest

from spikegrid.llm import pii
from spikegrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v // 10 + v % 10
    return total % 10 == 0


def plain(text):
    """(kind, start, end) of the base kinds by the expressions as they are written."""
    out = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                    "card": 13 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def text_of(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_random_texts_equal_plain_expressions():
    rng = random.Random(5)
    parts = ["@", "a@b.c", "+", ".", "-", " ", "  ", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "+1 (555) 123-4567", "é", "x", "7", "99", "(", "@@", "a.b@c-d.e.f", "%", "\n", "12-", "+49", "000"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        got = [(s.kind, s.start, s.end) for s in pii.spans_of(t) if s.base]
        assert got == plain(t), t


def test_query_on_the_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in QUERIES["op11_checked_spans"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = plain(t or "")
        want = [sum(k == kind for k, _, _ in base) for kind in pii.BASE]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == want
        assert got[i].base_sha256 == hashlib.sha256(text_of(base).encode()).hexdigest()
        assert set(filter(None, text_of(base).split(","))) <= set(got[i].spans.split(","))


@pytest.mark.parametrize("text,want", [
    ("IBAN DE89 3704 0044 0532 0130 00 AND MORE", "iban:5:32"),
    ("see DE89370400440532013000.", "iban:4:26"),
    ("see DE88370400440532013000.", ""),
    ("see DE893704004405320130001", ""),
    ("invoice DE89370400440532013000", ""),
    ("card 4111 1111 1111 1111 12/30", "card:5:24"),
    ("numbers 4111 1111 1111 1111 12/30", ""),
    ("visa 4111.1111.1111.1111", "card:5:24"),
    ("write to jane.doe [at] mail (dot) org now", "email:9:37"),
    ("call 030 1234567 or 0151/23456789", "phone:5:16,phone:20:33"),
    ("pages 030 1234567", ""),
    ("SSN 123-45-6789", "ssn:4:15"),
    ("code 123-45-6789", ""),
    ("SSN 000-45-6789 and 666-45-6789", ""),
])
def test_checksums_and_context(text, want):
    assert pii.joined(pii.spans_of(text)) == want


def test_score_moves_with_words():
    score = lambda t: pii.spans_of(t)[0].score
    assert score("server 10.0.0.1") > score("10.0.0.1") > score("version 10.0.0.1")


def test_awkward_rows(spark):
    long = "a" * 300_000 + " 1" * 150_000 + "+" * 100_000 + "1.." * 100_000 + " x@y.zz"
    rows = [(1, None, "s"), (None, "a@b.cd", "t"), (2, "", None), (3, "a@b.cd", "t"), (3, "a@b.cd", "t"), (4, long, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    began = time.time()
    got = sorted(((r.doc_id, r.n_email, r.spans) for r in pii.digests(docs).collect()), key=str)
    assert time.time() - began < 30
    assert got == sorted([(1, 0, ""), (None, 1, "email:0:6"), (2, 0, ""), (3, 1, "email:0:6"), (3, 1, "email:0:6"), (4, 1, f"email:{len(long) - 6}:{len(long)}")], key=str)
    assert [len(r.spans) for r in pii.find(docs).orderBy("doc_id").collect()] == [1, 0, 0, 1, 1, 1]
    hidden = pii.masked(docs)
    assert hidden.columns == docs.columns
    assert [r.text for r in hidden.where("doc_id < 4 OR doc_id IS NULL").orderBy("doc_id").collect()] == ["<email>", None, "", "<email>", "<email>"]
    none = docs.where("false")
    assert pii.digests(none).collect() == [] and pii.find(none).collect() == [] and pii.masked(none).collect() == []
