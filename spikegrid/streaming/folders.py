"""Folders of recordings as a stream: each new folder is worked on once.

A folder counts as complete when its marker file is there (with at least one byte: Spark
skips empty files). Offsets lie in the checkpoint, so
a restart goes on after the last finished batch; a batch that was cut off is done again and
replaces what it left. A folder that fails goes to the status table with its error and the
others go on. Rows of a folder count only if its status says so (see ``results``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spikegrid.settings import DEFAULT, Settings
from spikegrid.sources import study

FILE = "path string, modificationTime timestamp, length long, content binary"
STATUS = "batch long, folder string, ok boolean, error string"
FOLDERS_PER_BATCH = 64      # what the driver holds of one batch, as names
JOBS = 4                    # folders worked on at the same time
Work = Callable[[SparkSession, str], dict[str, DataFrame]]


def study_tables(spark: SparkSession, folder: str, settings: Settings = DEFAULT) -> dict[str, DataFrame]:
    """Sessions and spikes of one folder."""
    tables = study.build_study(spark, folder, settings=settings)
    return {"sessions": tables["sessions"], "spikes": tables["spikes"]}


def ready_folders(spark: SparkSession, root: str, marker: str = "READY", per_batch: int = FOLDERS_PER_BATCH) -> DataFrame:
    """Stream of the folders below ``root`` whose marker has appeared; contents are not read."""
    files = (spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true")
             .option("pathGlobFilter", marker).option("maxFilesPerTrigger", per_batch).load(root))
    return files.select(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "/[^/]*$", "").alias("folder"))


def _place(out: str, table: str, batch: int, folder: str) -> str:
    return f"{out.rstrip('/')}/{table}/{batch:09d}/{hashlib.md5(folder.encode()).hexdigest()}"


def work_on(spark: SparkSession, folders: list[str], out: str, batch: int, work: Work = study_tables, jobs: int = JOBS) -> None:
    """Write the tables of each folder and one status row for it; a repeated call replaces both."""

    def one(folder: str) -> tuple[int, str, bool, str | None]:
        try:
            for name, rows in work(spark, folder).items():
                rows.withColumns({"folder": F.lit(folder), "batch": F.lit(batch).cast("long")}).write.mode("overwrite").parquet(_place(out, name, batch, folder))
            return batch, folder, True, None
        except Exception as e:      # a damaged folder must not stop the rest; its error is kept
            return batch, folder, False, str(e)

    with ThreadPoolExecutor(jobs) as pool:
        done = list(pool.map(one, sorted(set(folders))))
    spark.createDataFrame(done, STATUS).coalesce(1).write.mode("overwrite").parquet(f"{out.rstrip('/')}/status/{batch:09d}")


def start(spark: SparkSession, root: str, out: str, checkpoint: str, work: Work = study_tables, marker: str = "READY",
          per_batch: int = FOLDERS_PER_BATCH, jobs: int = JOBS, follow: bool = False) -> StreamingQuery:
    """Work on every folder not yet done; ``follow`` waits for more, otherwise the query ends."""

    def batch(rows: DataFrame, number: int) -> None:
        folders = [r["folder"] for r in rows.distinct().collect()]      # at most per_batch names
        if folders:
            work_on(rows.sparkSession, folders, out, number, work, jobs)

    writer = ready_folders(spark, root, marker, per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer if follow else writer.trigger(availableNow=True)).start()


def status(spark: SparkSession, out: str) -> DataFrame:
    """The last status of each folder."""
    rows = spark.read.schema(STATUS).option("recursiveFileLookup", "true").parquet(f"{out.rstrip('/')}/status")
    last = Window.partitionBy("folder").orderBy(F.desc("batch"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def errors(spark: SparkSession, out: str) -> DataFrame:
    """Folders that failed, with the error."""
    return status(spark, out).where("NOT ok").select("folder", "batch", "error")


def results(spark: SparkSession, out: str, table: str) -> DataFrame:
    """Rows of a table from the last batch of each folder, if that batch went well."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{out.rstrip('/')}/{table}")
    return rows.join(status(spark, out).where("ok").select("folder", "batch"), ["folder", "batch"], "left_semi")


def retry(spark: SparkSession, out: str, work: Work = study_tables, jobs: int = JOBS, per_batch: int = FOLDERS_PER_BATCH) -> None:
    """Work once more on the folders that failed, after they were repaired. The stream must not run."""
    failed = errors(spark, out).select("folder", "batch").orderBy("folder").limit(per_batch).collect()
    # numbers of retries lie far above those of the stream and rise with each call
    highest = spark.read.schema(STATUS).option("recursiveFileLookup", "true").parquet(f"{out.rstrip('/')}/status").agg(F.max("batch")).first()[0]
    if failed:
        work_on(spark, [r["folder"] for r in failed], out, max(highest, 500_000_000) + 1, work, jobs)
