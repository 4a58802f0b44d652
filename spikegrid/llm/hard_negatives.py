"""Hard negatives for anchors, by the threshold algorithm over sorted dimensions.

Vectors are whole numbers (256 times the component, rounded down) and a score is the inner
product with the anchor. For an anchor the nearest rows of its own label are positives; the
hard negatives of a positive are the best rows of other labels whose score lies in a window
given by shares of the positive's score.

Rows are dealt into blocks, anchors into groups, and each (block, group) is one task. In a
block each dimension has a list of the rows sorted by their value. An anchor reads all lists
from the top where its component is positive and from the bottom where it is negative, some
ranks at a time (sorted access); rows met for the first time are scored in full (random
access). No row not yet met can score more than the anchor's product with the values at the
depth reached. Reading stops once this threshold is strictly below the k-th score of each
window, or below the window itself: ties at the k-th score are then all met. The few best of
each block are merged by rank. Blocks are dealt by hash of the row, whatever its label, so a
label with a third of all rows, or thousands of equal vectors, fill no task.

Rows with a null label, a null vector, or a null or non-finite component take no part. A
row without an id is no anchor; it comes last among equal scores. Rows that repeat an id are
rows of their own: each of them is an anchor if the id is one, and the other is one of its
"other rows". A shorter vector counts as zeros beyond its end. Further columns are ignored.
Products must fit a long: components up to 2^20 in 64 dimensions are far below that limit,
and a component of 2^31 or more raises an error. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spikegrid.llm.common import saved

ROWS = 8192             # rows of one block
ANCHORS = 1024          # anchors of one group
DEPTH = 128             # ranks read in all lists between two tests
SCALE = 256
NO_ID = (1 << 63) - 1   # a row without an id comes after all others


def whole_vectors(table: DataFrame, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """(row, vec_id, label, v): rows that take part, components as whole numbers. Rows whose
    id ``shift_every`` divides have the next label. Written once, so that row numbers last."""
    x = F.col("embedding").cast("array<double>")
    rows = table.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", "label", x.alias("_x"))
    rows = rows.where(F.forall("_x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    whole = F.transform("_x", lambda c: F.when(F.abs(c) < float(1 << 23), F.floor(c * float(SCALE)))
                        .otherwise(F.raise_error("a component of 2^31 or more after scaling")))
    moved = F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return saved(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", moved.cast("long").alias("label"), whole.alias("v")), "whole-vectors")


class Block:
    """Rows of one block with one sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        self.ids, self.rows, self.labels, self.v = ids, rows, labels, v
        self.real, self.most = v.astype(np.float64), int(np.abs(v).max(initial=0))
        self.up = np.argsort(v.T, axis=1, kind="stable")                    # a list for each dimension, least value first
        self.values = np.take_along_axis(np.ascontiguousarray(v.T), self.up, axis=1)

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Whole inner products with some rows, by doubles while these are exact."""
        if self.most * int(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < 1 << 53:
            return (self.real[at] @ anchor.astype(np.float64)).astype(np.int64)
        return (self.v[at] * anchor).sum(axis=1)

    def best(self, anchor: np.ndarray, windows: list[tuple[np.ndarray, int | None, int | None]], k: int) -> list[np.ndarray]:
        """For each window (mask of rows, least score, greatest score) its k best rows by score,
        then id, as (row, score)."""
        n = len(self.ids)
        score, met = np.zeros(n, np.int64), np.zeros(n, bool)
        rising, falling = np.nonzero(anchor < 0)[0], np.nonzero(anchor > 0)[0]
        for depth in range(0, n, DEPTH) if len(rising) + len(falling) else ():
            end = min(depth + DEPTH, n)
            fresh = np.zeros(n, bool)
            fresh[self.up[rising, depth:end]] = True                        # sorted access, signed by the anchor
            fresh[self.up[falling, n - end:n - depth]] = True
            at = np.nonzero(fresh & ~met)[0]
            met[at], score[at] = True, self.scores(at, anchor)              # random access
            if met.all():
                break
            threshold = int(anchor[rising] @ self.values[rising, end - 1] + anchor[falling] @ self.values[falling, n - end])
            if all(self._settled(score, met & mask, low, high, k, threshold) for mask, low, high in windows):
                break
        else:
            met[:] = True       # nothing to read: every product with a zero anchor is zero
        out = []
        for mask, low, high in windows:
            mine = np.nonzero(met & mask if low is None else met & mask & (score >= low) & (score <= high))[0]
            if len(mine) > k:
                bound = np.partition(score[mine], len(mine) - k)[len(mine) - k]
                mine = mine[score[mine] >= bound]
            mine = mine[np.lexsort((self.ids[mine], -score[mine]))[:k]]
            out.append(np.column_stack([mine, score[mine]]))
        return out

    @staticmethod
    def _settled(score: np.ndarray, met: np.ndarray, low: int | None, high: int | None, k: int, threshold: int) -> bool:
        """No row that is not met can be among the k best of this window."""
        if low is not None and (threshold < low or low > high):
            return True
        found = score[met if low is None else met & (score >= low) & (score <= high)]
        return len(found) >= k and threshold < np.partition(found, len(found) - k)[len(found) - k]


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _block(right: pa.Table, width: int) -> Block:
    ids = right["vec_id"].fill_null(NO_ID).to_numpy()
    return Block(ids, right["row"].to_numpy(), right["label"].to_numpy(), _matrix(right["v"], width))


def _result(found: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([f[k] for f in found], t.type) for k, t in enumerate(schema)], schema=schema)


def mine(table: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, every: int = 100,
         rows: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    vectors = whole_vectors(table)
    asked = vectors.where(F.col("vec_id") % every == 0).select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"),
                                                              F.col("label").alias("anchor_label"), F.col("v").alias("anchor"))
    n, width, wanted = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks, groups = max(1, -(-n // rows)), max(1, -(-wanted // anchors))
    keys = ["block", "group"]

    def dealt(by: str, count: int) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(count)).cast("int")

    def all_of(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    stored = vectors.withColumns({"block": dealt("row", blocks), "group": all_of(groups)}).groupBy(*keys)

    def met(left: DataFrame) -> object:
        return left.withColumns({"block": all_of(blocks), "group": dealt("anchor_row", groups)}).groupBy(*keys).cogroup(stored)

    same = pa.schema([("anchor_row", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            block = _block(right, width)
            for own, label, a in zip(left["anchor_row"].to_pylist(), left["anchor_label"].to_pylist(), _matrix(left["anchor"], width)):
                mask = (block.labels == label) & (block.rows != own)
                for k, s in block.best(a, [(mask, None, None)], positives)[0]:
                    found.append((own, int(block.rows[k]), int(block.ids[k]), int(s)))
        return _result(found, same)

    first = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "vec_id", "row")
    near = met(asked).applyInArrow(nearest, "anchor_row long, row long, vec_id long, score long")
    near = saved(near.withColumn("no", F.row_number().over(first)).where(F.col("no") <= positives), "positives")
    pairs = near.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("no", "vec_id", "score"))).alias("positives"))      # at most ``positives`` each
    windows = pa.schema([("anchor_row", pa.int64()), ("anchor_id", pa.int64()), ("no", pa.int32()), ("positive_id", pa.int64()),
                         ("positive_score", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            block = _block(right, width)
            columns = (left[c].to_pylist() for c in ("anchor_row", "anchor_id", "anchor_label", "positives"))
            for own, name, label, good, a in zip(*columns, _matrix(left["anchor"], width)):
                other = block.labels != label
                best = block.best(a, [(other, *window_of(p["score"], low, high)) for p in good], negatives)
                for p, found_rows in zip(good, best):
                    found += [(own, name, p["no"], p["vec_id"], p["score"], int(block.ids[k]), int(s)) for k, s in found_rows]
        return _result(found, windows)

    found = met(asked.join(pairs, "anchor_row")).applyInArrow(
        hard, "anchor_row long, anchor_id long, no int, positive_id long, positive_score long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_row", "no").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select("anchor_id", named("positive_id").alias("positive_id"), "rank", named("vec_id").alias("negative_id"),
                        "positive_score", F.col("score").alias("negative_score"))
