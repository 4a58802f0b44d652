"""Repeated passages by blockwise suffix sorting with a difference cover.

A byte is removed if a string of ``length`` bytes that covers it also starts in a
document with a smaller id. Only suffixes cut to ``length`` bytes matter, and of these
only such as can tie with another one.

* Blocks hold documents of consecutive ids (sampled splitters) of about ``block_bytes``.
* Cover sample: positions whose remainder modulo v lies in a difference cover. Any two
  equal strings of ``length`` bytes have, at some common offset below v, a sampled
  position in both, followed by length - v + 1 equal bytes. Each block sends the sorted
  codes of its sampled strings, cut into buckets; a bucket is sorted on its own, and each
  block learns which of its sample ranks are shared.
* Suffix buckets: only suffixes whose string holds a shared sample are sorted, again one
  bucket at a time. Ties are equal strings, and each block learns which of its own also
  occur in an earlier block; within a block, the first document of a tie is known there.

Sorting is by 64-bit codes of the (cut) suffixes, not by their bytes, since only ties
count here; sample codes are cut shorter, which can only add candidates. A task holds one
block, or one bucket of ``bucket_rows`` codes. Exact copies of longer documents are found
by digest first and take no part in the sorting.

Nulls: a null text is empty. A null id is larger than every other, and rows with equal
(or both null) ids remove nothing from each other; such rows stay in one block. Texts
shorter than ``length`` bytes are kept. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikegrid.llm.common import saved, unit_hash

LENGTH = 50
BLOCK_BYTES = 4 << 20
BUCKET_ROWS = 1 << 20
SAMPLES_PER_BLOCK = 64
# perfect difference sets: every remainder modulo v is a difference of two members
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}
LAST = np.iinfo(np.int64).max
_STEP = 1 << 20          # bytes coded together
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64)


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The widest cover that leaves sampled strings of over half the length."""
    v = max(v for v in COVERS if 2 * (length - v + 1) > length)
    return v, COVERS[v]


class Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def codes(data: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """64-bit code of the k bytes at each start: differences of one running sum."""
    up, down = powers.upto(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up, dtype=np.uint64, out=total[1:])
    h = (total[k:] - total[:-k]) * down[:len(data) - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def to_cell(values: np.ndarray, flags: np.ndarray | None = None) -> bytes:
    """Sorted distinct codes as differences, byte plane by byte plane (high planes are
    nearly all zero and vanish in the shuffle's compression), then one bit for each."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    planes = gaps.view(np.uint8).reshape(-1, 8)[:, :width].T
    head = np.array([len(values), width], "<u4").tobytes()
    return head + np.ascontiguousarray(planes).tobytes() + (b"" if flags is None else np.packbits(flags).tobytes())


def from_cell(cell: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    n, width = np.frombuffer(cell, "<u4", 2).tolist()
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(cell, np.uint8, n * width, 8).reshape(width, n).T
    rest = np.frombuffer(cell, np.uint8, offset=8 + n * width)
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64), np.unpackbits(rest, count=n).astype(bool) if len(rest) else None


class Cutter:
    """Buckets of equal code ranges."""

    def __init__(self, bits: int, buckets: int):
        self.bits, self.buckets = bits, buckets
        self.low = np.array([-(-(k << bits) // buckets) for k in range(buckets)], np.uint64)

    def cells(self, values: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to) of sorted codes."""
        at = np.append(np.searchsorted(values, self.low), len(values)).tolist()
        return ((k, a, b) for k, (a, b) in enumerate(zip(at, at[1:])) if b > a)


class Block:
    """The documents of one block: bytes one after another, copies and short ones left out."""

    def __init__(self, packs: list[bytes], copies: set[tuple[int, bytes]], length: int):
        self.rows = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in packs])
        texts = self.rows.column("__bytes").to_pylist()
        self.keys = self.rows.column("__key").to_numpy()
        self.rows = self.rows.drop_columns(["__bytes"])         # the list holds them now
        self.texts, self.length = texts, length
        self.digests = [hashlib.sha256(t).digest() for t in texts]
        self.copy = np.array([len(t) >= length and (int(k), d) in copies for t, k, d in zip(texts, self.keys, self.digests)], bool)
        self.take = np.array([k for k, t in enumerate(texts) if len(t) >= length and not self.copy[k]], np.int64)
        self.sizes = np.array([len(texts[k]) for k in self.take], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(b"".join(texts[k] for k in self.take), np.uint8)
        self.powers = Powers()

    def parts(self) -> Iterator[tuple[int, int]]:
        """Runs of documents of about _STEP bytes: (first, last + 1)."""
        a = 0
        while a < len(self.take):
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + _STEP, "right")))
            yield a, b
            a = b

    def samples(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(code, place) of the cover sample."""
        v, cover = cover_for(self.length)
        k = self.length - v + 1
        longest = int(self.sizes.max(initial=0))
        pattern = (np.arange(0, longest, v)[:, None] + np.array(cover)).ravel()
        found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for a, b in self.parts():
            low, high = self.starts[a], self.ends[b - 1]
            h = codes(self.data[low:high], k, self.powers)
            counts = np.searchsorted(pattern, self.sizes[a:b] - k, "right")
            at = np.concatenate([pattern[:n] + s for n, s in zip(counts.tolist(), self.starts[a:b].tolist())])
            found.append(h[at - low] >> np.uint64(64 - bits))
            places.append(at.astype(np.int32))
        return np.concatenate(found), np.concatenate(places)

    def candidates(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, place) of the suffixes whose string holds a shared sample."""
        v, _ = cover_for(self.length)
        owner = np.searchsorted(self.ends, shared, "right")
        mark = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(mark, np.maximum(shared - (v - 1), self.starts[owner]), 1)
        np.add.at(mark, np.minimum(shared, self.ends[owner] - self.length) + 1, -1)
        inside = np.cumsum(mark[:-1], dtype=np.int32) > 0
        found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for a, b in self.parts():
            low, high = self.starts[a], self.ends[b - 1]
            at = np.nonzero(inside[low:high])[0]
            if len(at):
                found.append(codes(self.data[low:high], self.length, self.powers)[at])
                places.append((at + low).astype(np.int32))
        return np.concatenate(found), np.concatenate(places)


def _ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each tie in that order, tie of each)."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    first = np.ones(len(values), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    return order, first, np.cumsum(first, dtype=np.int32) - 1


def _answers(cutter: Cutter, values: np.ndarray, replies: dict[int, bytes]) -> np.ndarray:
    """The bits a block got back for its sorted distinct codes; none: all zero."""
    out = np.zeros(len(values), bool)
    for bucket, a, b in cutter.cells(values):
        if bucket in replies:
            out[a:b] = np.unpackbits(np.frombuffer(replies[bucket], np.uint8), count=b - a).astype(bool)
    return out


def _reply(bucket: int, rows: pd.DataFrame, kind: int, flags_of) -> pd.DataFrame:
    """Sorts one bucket; ``flags_of`` gives a bit for each (tie, block) in sorted order."""
    rows = rows.sort_values("block", kind="stable")
    cells = [from_cell(c) for c in rows["payload"]]
    sizes = [len(c[0]) for c in cells]
    values = np.concatenate([c[0] for c in cells])
    order, first, tie = _ranks(values)         # stable: blocks of a tie come in ascending order
    flags = np.empty(len(values), bool)
    flags[order] = flags_of(first, tie)
    out = []
    for block, (_, own), part in zip(rows["block"], cells, np.split(flags, np.cumsum(sizes)[:-1])):
        part = part if own is None else part | own
        if part.any():
            out.append((block, kind, bucket, np.packbits(part).tobytes()))
    return pd.DataFrame(out, columns=["block", "kind", "part", "payload"])


COPY, SAMPLE, EARLIER = 0, 1, 2
MESSAGE = "block int, kind int, part int, payload binary"


def dedup(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_rows: int = BUCKET_ROWS,
          carry: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document. With
    ``carry``, also those columns as __c0, __c1, ... and what remains of the text (__text);
    a character that loses some of its bytes goes as a whole, and null stays null."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    key = F.coalesce("doc_id", F.lit(int(LAST)))
    narrow = saved(docs.select(key.cast("long").alias("key"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), F.sha2(text, 256).alias("digest")), "digests")
    total = narrow.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    drawn = narrow.where("n > 0").select("key", (-F.log(unit_hash("key", "digest", seed=5)) / F.col("n")).alias("_p"))
    keys = sorted(r[0] for r in drawn.orderBy("_p", "key").limit(SAMPLES_PER_BLOCK * blocks).collect()) if blocks > 1 else []
    cuts = np.array(sorted({keys[len(keys) * k // blocks] for k in range(1, blocks)} if keys else ()), np.int64)

    first = narrow.where(F.col("n") >= length).groupBy("digest").agg(F.min("key").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    copies = narrow.where(F.col("n") >= length).join(first, "digest").where(F.col("key") > F.col("_first")).select("key", F.unhex("digest").alias("digest"))

    def to_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            block = np.searchsorted(cuts, keys, "right").astype(np.int32)
            payload = [k.astype("<i8").tobytes() + d for k, d in zip(keys, batch.column(1).to_pylist())]
            zero = pa.array(np.full(len(keys), COPY, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(block), zero, zero, pa.array(payload, pa.binary())], ["block", "kind", "part", "payload"])

    def to_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                block = np.searchsorted(cuts, part.column(0).to_numpy(), "right")
                found, packs = np.unique(block), []
                for b in found:
                    rows = part.take(pa.array(np.nonzero(block == b)[0]))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                        out.write_batch(rows)
                    packs.append(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(packs, pa.binary())], ["block", "pack"])

    v, cover = cover_for(length)
    samples = max(1, total * len(cover) // v)
    bits = min(64, max(40, math.ceil(math.log2(samples)) + 12))
    ranks = Cutter(bits, -(-samples // bucket_rows))
    suffixes = Cutter(64, -(-samples // bucket_rows))
    with_text, carry = carry is not None, carry or ()
    carried = docs.select(key.cast("long").alias("__key"), text.alias("__bytes"), "doc_id", F.col("text").isNull().alias("__null"),
                          *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)])
    packs = carried.mapInArrow(to_packs, "block int, pack binary").repartition(blocks, "block")

    def opened(left: pa.Table, right: pa.Table) -> tuple[Block, dict[int, dict[int, bytes]]]:
        replies: dict[int, dict[int, bytes]] = {SAMPLE: {}, EARLIER: {}}
        copied = set()
        for kind, part, payload in zip(*(right.column(c).to_pylist() for c in ("kind", "part", "payload"))):
            if kind == COPY:
                copied.add((int.from_bytes(payload[:8], "little", signed=True), payload[8:]))
            else:
                replies[kind][part] = payload
        return Block(left.column("pack").to_pylist(), copied, length), replies

    def messages(block: int, cutter: Cutter, values: np.ndarray, flags: np.ndarray | None) -> pa.Table:
        rows = [(bucket, block, to_cell(values[a:b], None if flags is None else flags[a:b])) for bucket, a, b in cutter.cells(values)]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["bucket", "block", "payload"])

    def send_samples(key, left: pa.Table, right: pa.Table) -> pa.Table:
        block, _ = opened(left, right)
        values = np.sort(block.samples(bits)[0])
        first = np.ones(len(values), bool)
        first[1:] = values[1:] != values[:-1]
        at = np.nonzero(first)[0]
        return messages(key[0].as_py(), ranks, values[first], np.diff(at, append=len(values)) > 1)

    def shared_suffixes(block: Block, replies) -> tuple[np.ndarray, np.ndarray]:
        values, places = block.samples(bits)
        order, first, tie = _ranks(values)
        shared = _answers(ranks, values[order][first], replies[SAMPLE])
        return block.candidates(np.sort(places[order[shared[tie]]]))

    def send_suffixes(key, left: pa.Table, right: pa.Table) -> pa.Table:
        block, replies = opened(left, right)
        values, _ = shared_suffixes(block, replies)
        return messages(key[0].as_py(), suffixes, np.unique(values), None)

    def clean(key, left: pa.Table, right: pa.Table) -> pa.Table:
        block, replies = opened(left, right)
        values, places = shared_suffixes(block, replies)
        order, first, tie = _ranks(values)
        removed = np.zeros(len(block.data) + 1, np.int32)
        if len(values):
            ids = block.keys[block.take][np.searchsorted(block.ends, places, "right")]
            least = np.minimum.reduceat(ids[order], np.nonzero(first)[0])
            gone = (ids[order] > least[tie]) | _answers(suffixes, values[order][first], replies[EARLIER])[tie]
            at = places[order][gone]
            np.add.at(removed, at, 1)
            np.add.at(removed, at + length, -1)
        mask = np.cumsum(removed[:-1], dtype=np.int32) > 0
        n = len(block.texts)
        cut, spans, kept = [0] * n, [0] * n, list(block.texts)
        digest = [d.hex() for d in block.digests]
        for k in np.nonzero(block.copy)[0].tolist():
            cut[k], spans[k], kept[k] = len(block.texts[k]), 1, b""
        for k, a, b in zip(block.take.tolist(), block.starts.tolist(), block.ends.tolist()):
            own = mask[a:b]
            if own.any():
                cut[k] = int(own.sum())
                spans[k] = int(own[0]) + int((own[1:] & ~own[:-1]).sum())
                kept[k] = block.data[a:b][~own].tobytes()
        for k in range(n):
            if cut[k]:
                digest[k] = hashlib.sha256(kept[k]).hexdigest()
        rows = block.rows
        out = {"doc_id": rows.column("doc_id"), "n_bytes": pa.array([len(t) for t in block.texts], pa.int64()), "n_removed": pa.array(cut, pa.int64()),
               "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest)}
        if with_text:
            nulls = rows.column("__null").to_pylist()
            out |= {f"__c{i}": rows.column(f"__c{i}") for i in range(len(carry))}
            out["__text"] = pa.array([None if null else b.decode("utf-8", "ignore") for b, null in zip(kept, nulls)], pa.string())
        return pa.table(out)

    def together(right: DataFrame, step, schema: str) -> DataFrame:
        return packs.groupBy("block").cogroup(right.repartition(blocks, "block").groupBy("block")).applyInArrow(step, schema)

    cell = "bucket int, block int, payload binary"
    known = copies.mapInArrow(to_copies, MESSAGE)
    sample_cells = together(known, send_samples, cell)
    sample_replies = sample_cells.groupBy("bucket").applyInPandas(
        lambda key, rows: _reply(int(key[0]), rows, SAMPLE, lambda first, tie: (np.bincount(tie) > 1)[tie]), MESSAGE)
    known = known.union(sample_replies)
    suffix_cells = together(known, send_suffixes, cell)
    suffix_replies = suffix_cells.groupBy("bucket").applyInPandas(
        lambda key, rows: _reply(int(key[0]), rows, EARLIER, lambda first, tie: ~first), MESSAGE)
    known = known.union(suffix_replies)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        kinds = dict(docs.dtypes)
        schema = ", ".join([schema] + [f"__c{i} {kinds[c]}" for i, c in enumerate(carry)] + ["__text string"])
    return together(known, clean, schema)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """Documents with repeated passages taken out of their text. Documents of which
    nothing remains are dropped, those that were empty before are kept; n_chars, if
    there, is counted anew. One Python step does it, so a task holds one block once."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    kinds = dict(docs.dtypes)
    out = dedup(docs, carry=carry, **options).where("n_bytes = 0 OR n_removed < n_bytes")
    found = {c: F.col(f"__c{i}") for i, c in enumerate(carry)} | {"doc_id": F.col("doc_id"), "text": F.col("__text")}
    if "n_chars" in found:
        found["n_chars"] = F.length(F.coalesce("__text", F.lit("")))
    return out.select(*[found[c].cast(kinds[c]).alias(c) for c in docs.columns])
