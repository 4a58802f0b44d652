"""Token ids in wavelet matrix files.

Documents are range-partitioned by id and written as shards of whole documents, at
least ``shard_tokens`` ids each but the last of a partition. A file holds document ids,
lengths and one bit plane per id bit, each compressed, with sampled one-counts; it
answers access, count (rank) and occurrence (select) queries without decoding the rest.
A shard's file has a name of its own for every attempt; only names that a finished task
returned are read, so a retried task leaves nothing wrong behind.

Nulls: a null text is empty (its ids are the end id alone); null ids come first.
Repeated rows are separate documents; rows with equal ids are ordered by text.
An empty table writes no file and gives an empty table.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spikegrid.llm.common import saved, shared_path
from spikegrid.llm.tokens import default_path, encoder

MAGIC = b"WMTX0001"
SAMPLE = 4096           # bits between stored one-counts
SHARD_TOKENS = 1 << 20


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute path that all executors share."""
    return pafs.FileSystem.from_uri(uri)


def build(ids: np.ndarray, bits: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """Planes from the highest bit down (packed), zeros of each, one-counts before each
    block of SAMPLE bits."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit into {bits} bits")
    planes, zeros, counts = [], [], []
    values = ids.astype(np.uint32 if bits > 16 else np.uint16)
    after = np.empty_like(values)
    for k in range(bits - 1, -1, -1):
        ones = (values & values.dtype.type(1 << k)) != 0
        planes.append(np.packbits(ones, bitorder="little").tobytes())
        sums = np.add.reduceat(ones, np.arange(0, len(ones), SAMPLE), dtype=np.uint32) if len(ones) else np.zeros(0, np.uint32)
        counts.append(np.concatenate([[0], np.cumsum(sums)]).astype("<u4").tobytes())
        low, high = np.flatnonzero(~ones), np.flatnonzero(ones)
        zeros.append(len(low))
        values.take(low, out=after[:len(low)], mode="clip")
        values.take(high, out=after[len(low):], mode="clip")
        values, after = after, values
    return planes, zeros, counts


class WaveletFile:
    """A file read back: planes are inflated when first asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack("<I", data[8:12])
        head = json.loads(data[12:12 + size])
        self.n, self.bits, self.zeros = head["n"], head["bits"], head["zeros"]
        at, parts = 12 + size, []
        for length in head["parts"]:
            parts.append(data[at:at + length])
            at += length
        self._parts, self._planes, self._counts = parts, {}, {}
        self.lengths = np.frombuffer(self._inflate(1), "<u4").astype(np.int64)
        ids = np.frombuffer(self._inflate(0), "<i8")
        nulls = np.zeros(len(ids), bool)
        nulls[head["null_ids"]] = True
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, nulls)]

    def _inflate(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._parts[k])

    def plane(self, k: int) -> np.ndarray:
        """Plane k, eight bits to the byte."""
        if k not in self._planes:
            self._planes[k] = np.frombuffer(self._inflate(2 + 2 * k), np.uint8)
            self._counts[k] = np.frombuffer(self._inflate(3 + 2 * k), "<u4")
        return self._planes[k]

    def unpacked(self, k: int, block: int | None = None) -> np.ndarray:
        """Plane k, or one block of it, as booleans."""
        packed, count = self.plane(k), self.n
        if block is not None:
            packed, count = packed[block * SAMPLE // 8:(block + 1) * SAMPLE // 8], min(SAMPLE, self.n - block * SAMPLE)
        return np.unpackbits(packed, count=max(count, 0), bitorder="little").view(bool)

    def ones(self, k: int, i: int) -> int:
        """One bits among the first i of plane k: a stored count and one block."""
        bits = self.unpacked(k, i // SAMPLE)
        return int(self._counts[k][i // SAMPLE]) + int(np.count_nonzero(bits[:i % SAMPLE]))

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for k in range(self.bits):
            one = bool(self.plane(k)[i >> 3] >> (i & 7) & 1)
            before = self.ones(k, i)
            value = value << 1 | one
            i = self.zeros[k] + before if one else i - before
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        for k in range(self.bits):
            a, b = self.ones(k, low), self.ones(k, high)
            low, high = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of the id among the first ``end`` positions."""
        low, high = self._range(token, self.n if end is None else end)
        return high - low

    def find(self, token: int, nth: int) -> int:
        """Position of the id's occurrence number ``nth`` (from 0); -1 if there are fewer."""
        low, high = self._range(token, self.n)
        if nth >= high - low:
            return -1
        i = low + nth
        for k in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - k) & 1
            i = self._select(k, one, i - self.zeros[k] if one else i)
        return i

    def _select(self, k: int, one: int, nth: int) -> int:
        self.plane(k)
        before = self._counts[k].astype(np.int64)
        if not one:
            before = np.minimum(np.arange(len(before)) * SAMPLE, self.n) - before
        block = int(np.searchsorted(before, nth, "right")) - 1
        inside = self.unpacked(k, block)
        return block * SAMPLE + int(np.nonzero(inside if one else ~inside)[0][nth - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids: the partitions are undone from the lowest plane up."""
        kind = np.uint32 if self.bits > 16 else np.uint16
        values, above = np.zeros(self.n, kind), np.empty(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            ones = self.unpacked(k)
            values[self.zeros[k]:] |= kind(1 << (self.bits - 1 - k))
            above[np.flatnonzero(~ones)] = values[:self.zeros[k]]
            above[np.flatnonzero(ones)] = values[self.zeros[k]:]
            values, above = above, values
        return values.astype(np.uint32)


def to_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    planes, zeros, counts = build(ids, bits)
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [pack(np.asarray([x or 0 for x in doc_ids], "<i8").tobytes()), pack(np.asarray(lengths, "<u4").tobytes())]
    for p, c in zip(planes, counts):
        parts += [pack(p), pack(c)]
    head = json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "parts": [len(p) for p in parts],
                       "null_ids": [k for k, x in enumerate(doc_ids) if x is None]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


def write_files(docs: DataFrame, folder: str, end_id: int = 1, path: str | None = None, bits: int = 16,
                shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(part, seq, file, n_docs, n_tokens) of the shards, in document order."""
    path = path or default_path()
    end = np.asarray([end_id], "<u4").tobytes()
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(path).encode, TaskContext.get().partitionId(), 0
        store, root = open_store(folder)
        held: tuple[list, list, list] = ([], [], [])
        size = 0

        def flush():
            ids = np.frombuffer(b"".join(held[2]), "<u4")
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wm"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(to_bytes(held[0], held[1], ids, bits))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "n_docs": len(held[0]), "n_tokens": len(ids)}], schema)
            for h in held:
                h.clear()
            return row

        for batch in batches:
            keys = batch.column(0)
            for k in range(0, batch.num_rows, 1024):
                coded = encode([t or "" for t in batch.column(1).slice(k, 1024).to_pylist()])
                for key, ids in zip(keys.slice(k, 1024).to_pylist(), coded):
                    held[0].append(key)
                    held[1].append(len(ids) // 4 + 1)
                    held[2].extend((ids, end))
                    size += len(ids) // 4 + 1
                    if size >= shard_tokens:
                        yield flush()
                        seq, size = seq + 1, 0
        if held[0]:
            yield flush()

    open_store(folder)[0].create_dir(open_store(folder)[1])
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return saved(rows.mapInArrow(write, "part int, seq int, file string, n_docs long, n_tokens long"), "wavelet-index")


def read_files(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), from the files alone."""
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("_t"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # one row for each written partition
    parts = parts.select("part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = index.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
    shards = shards.select("file", (F.col("_part_start") + F.col("_inside")).alias("start"))
    # a stated number: the rows are small but stand for whole files
    shards = shards.repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{root}/{row['file']}") as source:
                    shard = WaveletFile(source.read())
                ids = shard.decode().astype("<u4")
                stops = np.cumsum(shard.lengths)
                starts = stops - shard.lengths
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[a * 4:b * 4]) for a, b in zip(starts.tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.doc_ids, pa.int64()), pa.array(starts + row["start"], pa.int64()),
                    pa.array(shard.lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, **options) -> DataFrame:
    folder = shared_path(docs.sparkSession, "wavelet-files")
    return read_files(write_files(docs, folder, **options), folder)
