"""Harmonic packing of documents into sequences of fixed capacity.

A piece of length n belongs to class k = capacity // n, and every sequence of class k
holds exactly k pieces, so classes fill on their own. A document is cut, where it is
tokenized, into full sequences and then at reciprocal lengths (capacity // 2, // 3, ...)
until the rest fits its class with at most ``slack`` of waste. Pieces are numbered within
their class (per hashed part, plus part offsets), which fixes sequence and place. Fewer
than k pieces of each class remain; their number is bounded by the capacity alone, and
first-fit decreasing puts them together.

Nulls: a null text is empty; every document ends with the end id, so each has at least
one piece. Repeated rows are packed each. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spikegrid.llm.common import saved, with_running
from spikegrid.llm.tokens import default_path, encoder

CAPACITY = 4096
SLACK = 0.02
ROWS_PER_PIECE = 100_000


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Piece lengths of a document of n ids, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= capacity // (k + 1)
    return out


def pieces(docs: DataFrame, end_id: int, path: str, capacity: int, with_ids: bool) -> DataFrame:
    end = np.asarray([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = []
                for key, ids in zip(batch.column(0).slice(k, 256).to_pylist(), encode([t or "" for t in batch.column(1).slice(k, 256).to_pylist()])):
                    ids += end
                    start, n = 0, len(ids) // 4
                    for length in cuts(n, capacity):
                        part = ids[start * 4:(start + length) * 4]
                        rows.append((key, start, length, zlib.crc32(part), n) + ((part,) if with_ids else ()))
                        start += length
                columns = [pa.array(c, pa.binary() if name == "ids" else pa.int64()) for name, c in zip(names, zip(*rows))]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def first_fit(capacity: int):
    def fit(left: pd.DataFrame) -> pd.DataFrame:
        """At most capacity - 1 classes of fewer than k pieces come here."""
        left = left.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True]).reset_index(drop=True)
        room, place, offset = np.zeros(0, np.int64), [], []
        for n in left["length"]:
            k = int(np.argmax(room >= n)) if (room >= n).any() else len(room)
            if k == len(room):
                room = np.append(room, capacity)
            place.append(k)
            offset.append(capacity - int(room[k]))
            room[k] -= n
        left["sequence_id"] = left["_bins"] + np.asarray(place, np.int64)
        left["offset"] = np.asarray(offset, np.int64)
        return left.drop(columns=["_bins"])
    return fit


def pack(docs: DataFrame, end_id: int = 2, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False,
         rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of each piece."""
    cut = saved(pieces(docs, end_id, path or default_path(), capacity, with_ids), "pieces")
    cut = cut.withColumn("_k", F.floor(F.lit(capacity) / F.col("length")))
    classes = cut.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))       # at most 2 * sqrt(capacity) rows
    classes = classes.withColumn("_full", F.floor(F.col("_n") / F.col("_k")))
    classes = classes.withColumns({
        "_base": F.coalesce(F.sum("_full").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_bins": F.sum("_full").over(Window.partitionBy()),
        "_parts": F.ceil(F.col("_n") / rows_per_piece)})
    rows = cut.join(F.broadcast(classes), "_k")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("_parts")))
    rows = with_running(rows, ["_k"], "_part", [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "length", "_sum", "_rank")
    full = F.col("_rank") < F.col("_full") * F.col("_k")
    names = [c for c in cut.columns if c != "_k"]
    placed = rows.where(full).withColumn("sequence_id", F.col("_base") + F.floor(F.col("_rank") / F.col("_k")))
    before = Window.partitionBy("sequence_id").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(*names, "sequence_id", "offset")
    left = rows.where(~full).select(*names, "_bins")
    schema = ", ".join(f"{n} {t}" for n, t in cut.select(*names).dtypes) + ", sequence_id long, offset long"
    return placed.unionByName(left.groupBy("_bins").applyInPandas(first_fit(capacity), schema))
