"""Personal data in texts: expressions propose spans, checksums confirm them, and words
nearby move their score.

Kinds that any text must be searched for ("base": email, ip, card, phone) are taken by
their expression and check alone. Further kinds (iban, card in other groupings, email
written out, phone without a plus, ssn) are weaker proposals: each has a score by form and
checksum, a word of its kind nearby adds to it, a word that speaks against it takes away,
and from ``THRESHOLD`` on the span is kept. A further span never covers a base span; of
further spans that overlap, the better scored stays, then the earlier.

One pass over the rows without a shuffle; every scan takes time linear in the text, also
where a plain expression would start again at each character of a long run.

A null text is empty; a null id is kept as it is; repeated rows are searched one by one.
Only the id and the text are read, so further columns may have any name. An empty table
gives an empty one. Places are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.7
NEAR = 40               # code points before and after a span in which words count
RAISE, LOWER = 0.3, 0.3
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7}

_LOCAL = "".join(c for c in map(chr, range(33, 127)) if re.match(r"[A-Za-z0-9._%+-]", c))
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[ -]?[A-Z0-9])")
_GROUPS = re.compile(r"(?<![0-9])[0-9]{4}([ ./_ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_HOME = re.compile(r"(?<![0-9+.])\(?0[0-9][0-9 ()/.-]{5,18}[0-9](?![0-9])|(?<![0-9+.(])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_AT = re.compile(r" ?[\[({] ?at ?[\])}] ?", re.IGNORECASE)
_AFTER_AT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({] ?dot ?[\])}] ?)[A-Za-z0-9-]{1,63})+", re.IGNORECASE)

# Published lengths of account numbers by country.
IBAN_LENGTH = {"AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
               "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
               "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26}

# Words of the languages of the corpus that speak for a kind, and those that name other numbers.
FOR = {
    "email": "email e-mail mail contact correo kontakt courriel",
    "ip": "ip address server host adresse dirección",
    "card": "card visa mastercard amex credit debit karte kreditkarte carte tarjeta",
    "phone": "phone tel telephone mobile call fax telefon handy anruf téléphone portable appel teléfono móvil llame",
    "iban": "iban account bank konto compte cuenta",
    "ssn": "ssn social security",
}
AGAINST = "isbn issn version order invoice reference ref serial bestellung rechnung commande facture pedido factura"
_FOR = {k: frozenset(v.split()) for k, v in FOR.items()}
_AGAINST = frozenset(AGAINST.split())
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


@dataclass(frozen=True, order=True)
class Span:
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    twice = [2 * int(c) for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(t - 9 if t > 9 else t for t in twice)) % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        head = text[done:at]
        start = done + len(head.rstrip(_LOCAL))
        tail = _DOMAIN.match(text, at) if start < at else None
        if tail:
            yield start, tail.end()
            done = tail.end()
        else:
            done = at + 1       # no match can reach over this character
        at = text.find("@", done)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost spans of the base kinds that pass their checks."""
    found: dict[str, list[tuple[int, int]]] = {"email": list(_emails(text)), "ip": [], "card": [], "phone": []}
    if not _DIGIT.search(text):
        return found
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return found


def _account(text: str, start: int) -> int | None:
    """End of the account number that starts here and passes its checksum."""
    want, got, at = IBAN_LENGTH.get(text[start:start + 2], 0), [], start
    while len(got) < want and at < len(text):
        c = text[at]
        if c.isascii() and (c.isdigit() or c.isupper()):
            got.append(c)
        elif c not in " -" or text[at - 1] in " -":
            return None
        at += 1
    if not want or len(got) < want or (at < len(text) and text[at].isalnum()) or not mod97("".join(got)):
        return None
    return at


def proposals(text: str) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, score by form and checksum) of the further kinds."""
    for m in _AT.finditer(text):
        window = text[max(0, m.start() - 64):m.start()]
        start, tail = m.start() - len(window) + len(window.rstrip(_LOCAL)), _AFTER_AT.match(text, m.end())
        if start < m.start() and tail:
            yield "email", start, tail.end(), 0.7
    if not _DIGIT.search(text):
        return
    for m in _IBAN.finditer(text):
        end = _account(text, m.start())
        if end:
            yield "iban", m.start(), end, 0.8
    for m in _GROUPS.finditer(text):
        if luhn(_NOT_DIGIT.sub("", m.group())):
            yield "card", *m.span(), 0.5
    for m in _HOME.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield "phone", *m.span(), 0.4
    for m in _SSN.finditer(text):
        yield "ssn", *m.span(), 0.4


def with_context(text: str, kind: str, start: int, end: int, score: float) -> float:
    """The score after the words nearby."""
    near = set(_WORD.findall(text[max(0, start - NEAR):start].lower())) | set(_WORD.findall(text[end:end + NEAR].lower()))
    return round(min(1.0, max(0.0, score + RAISE * bool(near & _FOR[kind]) - LOWER * bool(near & _AGAINST))), 2)


def spans_of(text: str) -> list[Span]:
    """All spans of one text by kind as listed, then place."""
    out = [Span(k, a, b, with_context(text, k, a, b, PRIOR[k]), True) for k, found in base_spans(text).items() for a, b in found]
    more = [Span(k, a, b, s, False) for k, a, b, p in proposals(text) if (s := with_context(text, k, a, b, p)) >= THRESHOLD]
    if more:
        taken: list[tuple[int, int]] = []           # without overlaps, in order
        for a, b in sorted((s.start, s.end) for s in out):
            if taken and a < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
            else:
                taken.append((a, b))
        for s in sorted(more, key=lambda s: (-s.score, s.start, s.end, s.kind)):
            at = bisect.bisect_left(taken, (s.end, -1))
            if not at or taken[at - 1][1] <= s.start:
                out.append(s)
                taken.insert(at, (s.start, s.end))
    return sorted(out, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, spans): an array of (kind, start, end, score, base) for each row."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[vars(s) for s in spans_of(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], [id_column, "spans"])

    rows = docs.select(id_column, F.col("text"))
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(search, f"`{id_column}` {kind}, spans array<struct<kind: string, start: long, end: long, score: double, base: boolean>>")


def masked(docs: DataFrame) -> DataFrame:
    """The same rows and columns; in the text each span is replaced by its kind in angle
    brackets. Of spans that overlap the first is replaced to the end of the last. A null
    text stays null."""
    names = docs.columns
    at = names.index("text")

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(at):
                text, done, pieces = value.as_py(), 0, []
                for s in sorted(spans_of(text or ""), key=lambda s: (s.start, -s.end)):
                    if s.start >= done:
                        pieces += [text[done:s.start], f"<{s.kind}>"]
                    done = max(done, s.end)
                out.append("".join(pieces) + text[done:] if pieces else text)
            columns = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(hide, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, lowest_score): counts and the
    digest are of base spans, ``spans`` holds all."""
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", "lowest_score"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names[1:]]
            for value in batch.column(1):
                spans = spans_of(value.as_py() or "")
                base = [s for s in spans if s.base]
                base.sort(key=lambda s: (BASE.index(s.kind), s.start))
                row = [sum(s.kind == k for s in base) for k in BASE]
                row += [hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base),
                        min((s.score for s in spans), default=None)]
                for column, x in zip(columns, row):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names)

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(search, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, lowest_score double")
