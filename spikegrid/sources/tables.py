"""Report tables in and out: CSV or Parquet, sorted or appended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A report by its ending: .csv (with a header) or Parquet."""
    if path.rstrip("/").endswith(".csv"):
        r = spark.read.option("header", True)
        return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def save_report(report: DataFrame, path: str, order: Sequence[str] = (), append: bool = False) -> None:
    """Write a report, range-partitioned and sorted by ``order``: files in name order are the
    sorted report. ``append`` adds files to those that are there; otherwise the path must be new."""
    out = report.repartitionByRange(*order).sortWithinPartitions(*order) if order else report
    w = out.write.mode("append" if append else "errorifexists")
    w.option("header", True).csv(path) if path.rstrip("/").endswith(".csv") else w.parquet(path)


def join_report(rows: DataFrame, report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Report columns beside the rows that have them (left join); columns of both keep those of ``rows``."""
    return rows.join(report.select(*keys, *[c for c in report.columns if c not in rows.columns]), list(keys), "left")
