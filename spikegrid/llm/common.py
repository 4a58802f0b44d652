"""What the operators of this subpackage share: the word rule, tables kept in the
shared folder, running totals over groups of any size, tokenizer and block helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spikegrid.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of the cluster."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the shared folder and read back: its lineage ends
    there, and a lost executor costs no more than reading it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(col: str | Column = "text") -> Column:
    return F.encode(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), "UTF-8")


def unit_hash(*cols: str | Column, seed: int = 0) -> Column:
    """Uniform in (0, 1), decided by the row's values alone, so a retried task repeats it."""
    whole = F.lit(1 << 52)
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), whole).cast("double") + 0.5) / F.lit(float(1 << 52))


def with_running(df: DataFrame, keys: list[str], piece: str, order: list[Column], value: str,
                 total: str, index: str | None = None) -> DataFrame:
    """Adds the sum of ``value`` over the earlier rows of the same keys (``total``) and
    the number of those rows (``index``); rows are ordered by ``piece``, then ``order``.

    No group is sorted as a whole: rows are numbered within (keys, piece), and only one
    row for each piece takes part in the sum over pieces. Keys must not be null."""
    cells = df.groupBy(*keys, piece).agg(F.sum(value).alias("_cell_sum"), F.count(F.lit(1)).alias("_cell_rows"))
    before = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, piece,
                         F.coalesce(F.sum("_cell_sum").over(before), F.lit(0)).alias("_sum_before"),
                         F.coalesce(F.sum("_cell_rows").over(before), F.lit(0)).alias("_rows_before"))
    inside = Window.partitionBy(*keys, piece).orderBy(*order)
    rows = df.withColumns({
        "_sum_inside": F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_rows_inside": F.row_number().over(inside) - 1,
    }).join(cells, [*keys, piece])
    out = {total: F.col("_sum_before") + F.col("_sum_inside")}
    if index:
        out[index] = F.col("_rows_before") + F.col("_rows_inside")
    return rows.withColumns(out).drop("_sum_before", "_sum_inside", "_rows_before", "_rows_inside")
