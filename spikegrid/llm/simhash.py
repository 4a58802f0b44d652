"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is the bitwise majority of its shingles' XXH64. Fingerprints within
``limit`` = 3 differing bits are linked, and linked ones form components.

The 64 bits form a ring of four segments of 16. The ring principle: two fingerprints
within 3 bits have a segment from which every chain of 1, 2, 3, 4 consecutive segments
holds at most 0, 1, 2, 3 differences (its share of the budget, rounded down). So at
some start the first segment is equal, and of the four bytes of the next two segments
(at most 1, then 2 differences) two are equal, one of them in the first of these.
Starts times byte pairs are the 20 tables of 32-bit keys, under which distinct
fingerprints meet; the chain test prunes pairs before the full distance.

A key with more than ``bucket`` fingerprints is split exactly: its pairs agree in five
of the eight half-bytes of the other 32 bits, so each of the 56 choices of five is a
key of its own, and one of them holds at most 2^12 distinct fingerprints. Inside a key
only the edges of a spanning forest leave the task.

Nulls and texts without words have fingerprint zero and are linked like any other.
Rows are fingerprinted one by one, so repeated rows and ties share a component; a null
id takes no part in the choice of the smallest. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikegrid.llm.common import saved
from spikegrid.llm.components import components

LIMIT = 3
BUCKET = 2000
SEED = 42
WORDS = 3
PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))     # of the four bytes after the equal segment
FIVES = tuple(combinations(range(8), 5))              # of the eight half-bytes left


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of every run of ``words`` words; of the whole text if it has fewer."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()     # ASCII rules for case and spaces
    if not found:
        return np.zeros(0, np.uint64)
    n = max(1, len(found) - words + 1)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    stops = np.cumsum(lengths + 1) - 1
    starts = (stops - lengths)[:n].tolist()
    stops = stops[min(words, len(found)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    hashes = shingle_hashes(text, words)
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        ones += np.unpackbits(hashes[k:k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                fps = np.fromiter((fingerprint(t) for t in part.column(1).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _turned(fps: np.ndarray, start: int) -> np.ndarray:
    """The ring turned so that segment ``start`` comes first (lowest 16 bits)."""
    s = np.uint64(16 * start)
    return fps if not start else (fps >> s) | (fps << (np.uint64(64) - s))


def _table_keys(turned: np.ndarray, a: int, b: int) -> np.ndarray:
    """Equal segment and two of the following four bytes: 32 bits."""
    byte = np.uint64(255)
    return ((turned & np.uint64(0xFFFF)) | ((turned >> np.uint64(16 + 8 * a)) & byte) << np.uint64(16)
            | ((turned >> np.uint64(16 + 8 * b)) & byte) << np.uint64(24))


def table_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """20 rows (k, fp) for each fingerprint; k = table and key."""
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for start in range(4):
            turned = _turned(fps, start)
            for n, (a, b) in enumerate(PAIRS):
                keys = _table_keys(turned, a, b) | np.uint64(start * 5 + n) << np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps.view(np.int64))], ["k", "fp"])


def split_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """56 rows (k, part, fp) for each row of a full key: part = choice of five half-bytes
    outside the 32 bits of the key, and their values."""
    for batch in batches:
        k = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        table = (k >> np.uint64(32)).astype(np.int64)
        for t in np.unique(table):
            rows = table == t
            a, b = PAIRS[t % 5]
            turned = _turned(fps[rows], int(t) // 5)
            free = [16 + 8 * c + 4 * h for c in range(4) if c not in (a, b) for h in (0, 1)] + [48, 52, 56, 60]
            for n, five in enumerate(FIVES):
                part = np.full(int(rows.sum()), n, np.uint64)
                for c in five:
                    part = part << np.uint64(4) | (turned >> np.uint64(free[c])) & np.uint64(15)
                yield pa.RecordBatch.from_arrays([pa.array(k[rows].view(np.int64)), pa.array(part.view(np.int64)), pa.array(fps[rows].view(np.int64))], ["k", "part", "fp"])


def within(diff: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """(row, column) of the XORs of at most ``limit`` bits, by growing chains of segments.

    A pair within the limit has a start from which chains of 1, 2, 3 and 4 segments differ in
    at most 0, 1, 2 and 3 bits. A chain that exceeds its budget ends the check of its pair at
    this start; only pairs whose chain of three holds come to the whole distance."""
    good = np.zeros(diff.shape, bool)
    for s in range(4):
        at = np.nonzero((diff >> np.uint64(16 * s)) & np.uint64(0xFFFF) == 0)
        left, total = diff[at], np.zeros(len(at[0]), np.uint8)
        for length in range(1, 4):
            total = total + np.bitwise_count((left >> np.uint64(16 * ((s + length) % 4))) & np.uint64(0xFFFF))
            holds = total <= (limit if length == 3 else length)
            at, left, total = (at[0][holds], at[1][holds]), left[holds], total[holds]
        good[at] = True
    return np.nonzero(good)


def forest(fps: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Edges (as fingerprints) of a spanning forest of the links among distinct fingerprints.

    Rows of the distance matrix are looked at once, in blocks: a row's links join whole
    trees, and one edge is kept for each join."""
    root = np.arange(len(fps))
    left, right = [], []
    for k in range(0, len(fps), 256):
        x, y = within(fps[k:k + 256, None] ^ fps[None, :], limit)
        x = x + k
        cut = np.searchsorted(x, np.arange(k, min(k + 256, len(fps)) + 1))
        for i in range(len(cut) - 1):
            links = y[cut[i]:cut[i + 1]]
            roots, first = np.unique(root[links], return_index=True)
            own = root[k + i]
            other = roots != own
            if other.any():
                left += [k + i] * int(other.sum())
                right += links[first[other]].tolist()
                root[np.isin(root, roots[other])] = own
    return fps[left], fps[right]


def links_in(rows: pd.DataFrame) -> pd.DataFrame:
    """Spanning forest of one key; its distinct fingerprints are bounded."""
    a, b = forest(np.unique(rows["fp"].to_numpy().view(np.uint64)))
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints that span every component."""
    keys = fps.mapInArrow(table_keys, "k long, fp long")
    shared = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = saved(keys.join(shared, "k"), "simhash-keys")
    small = met.where(F.col("n") <= bucket).select("k", "fp")
    large = met.where(F.col("n") > bucket).select("k", "fp").mapInArrow(split_keys, "k long, part long, fp long")
    schema = "a long, b long"
    # a stated number of tasks: few bytes, but a task of its own for each group's pairs
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small, large = small.repartition(tasks, "k"), large.repartition(tasks, "k", "part")
    return small.groupBy("k").applyInPandas(links_in, schema).union(large.groupBy("k", "part").applyInPandas(links_in, schema)).distinct()


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    rows = saved(with_fingerprints(docs), "fingerprints")
    heads = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("head")), "simhash-heads")
    # components of fingerprints: one without an id is a bridge like any other
    joined = components(links(heads.select("fp"), bucket)).withColumnRenamed("node", "fp")
    heads = heads.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = heads.groupBy("component").agg(F.min("head").alias("component_id"))
    heads = heads.join(least, "component").select("fp", "component_id")
    out = rows.join(heads, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
