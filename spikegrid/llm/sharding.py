"""Sharding by sampled splitters.

Records are range-partitioned by (key, tie-break). A bounded sample, drawn with
probability growing with size, gives quantile boundaries; ranges holding more rows
than ``rows_per_piece`` (a hot key, an unlucky sample) are subdivided by a hash of the
tie-break. Exact sizes of the ranges and pieces then place every record on the byte
axis, which is cut into equal shards: sizes differ by at most one record.

Nulls: a null text counts 0 bytes (plus the fixed overhead) and has crc32 0; null ids
sort first. Repeated rows are separate records. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spikegrid.llm.common import saved, unit_hash, with_running

OVERHEAD = 8            # bytes counted for a record besides its text
SAMPLES = 4096          # rows of the size-weighted sample that the driver sees
RANGES = 192            # ranges between splitters
ROWS_PER_PIECE = 200_000


def splitters(rows: DataFrame, key: str, size: str, ties: list[str], samples: int = SAMPLES, ranges: int = RANGES) -> list[int]:
    """Boundaries between ranges of about equal size: quantiles of a sample in which a
    row's chance grows with its size (the smallest ``samples`` values of -ln(u)/size)."""
    u = unit_hash(key, *ties, seed=11)
    drawn = rows.where(F.col(size) > 0).select(key, (-F.log(u) / F.col(size)).alias("_priority"))
    keys = sorted(r[0] for r in drawn.orderBy("_priority", key).limit(samples).collect())
    step = max(1.0, len(keys) / ranges)
    return sorted({keys[int(k * step)] for k in range(1, ranges) if int(k * step) < len(keys)})


def range_of(key: Column, cuts: list[int], first: int = 0) -> Column:
    """Number of cuts at or below the key, as a balanced tree of comparisons."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(key < F.lit(cuts[mid]), range_of(key, cuts[:mid], first)).otherwise(
        range_of(key, cuts[mid + 1:], first + mid + 1))


def shard_rows(rows: DataFrame, key: str, size: str, tie: str, shards: int,
               samples: int = SAMPLES, ranges: int = RANGES, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Adds ``shard`` and ``slot`` to a narrow table; ``key`` is a non-null long."""
    cuts = splitters(rows, key, size, [tie], samples, ranges)
    placed = rows.withColumn("_range", range_of(F.col(key), cuts))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_b"))
    total = Window.partitionBy()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(                                  # one row for each range: bounded by ``ranges``
        "_range", F.ceil(F.col("_n") / rows_per_piece).alias("_pieces"),
        F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_range_start"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_range_rows"),
        F.sum("_b").over(total).alias("_all"))
    placed = placed.join(F.broadcast(counts), "_range").withColumn(
        "_piece", F.pmod(F.xxhash64(F.lit(5), key, tie), F.col("_pieces")))
    placed = with_running(placed, ["_range"], "_piece", [F.col(key), F.col(tie)], size, "_at", "_row")
    middle = (F.col("_range_start") + F.col("_at")) * 2 + F.col(size)
    placed = placed.withColumns({
        "shard": F.least(F.lit(shards - 1), F.floor(middle * shards / (F.col("_all") * 2))).cast("int"),
        "_row": F.col("_range_rows") + F.col("_row"),
    })
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))   # one row for each shard
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_row") - F.col("_first")).drop(
        "_range", "_piece", "_pieces", "_range_start", "_range_rows", "_all", "_at", "_row", "_first")


def shard_documents(docs: DataFrame, shards: int = 24, **options) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_key"))
    rows = saved(rows, "shard-rows")
    out = shard_rows(rows, "_key", "size", "doc_id", shards, **options)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
