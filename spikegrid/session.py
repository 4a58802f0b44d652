"""Session helpers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# SQL options the plans rely on; all can be changed at run time.
SQL_OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a task of a long plan sorts and joins its rows many times over: keep its share small
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "32m",
    # a per-key lookup joined to a hot key is split even if that costs a shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # packed maps and signal blocks are wide rows: keep an Arrow batch small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the SQL options above on a session made by somebody else, except those that
    it was started with."""
    visible_to_workers(spark)
    started = spark.sparkContext.getConf()
    for key, value in SQL_OPTIONS.items():
        if not started.contains(key) and spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


# rows of a given table for each partition that a shuffle starts with
ROWS_PER_PARTITION = 250_000
FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def widen_shuffles(spark: SparkSession, rows: int) -> None:
    """Let shuffles start with partitions in proportion to the largest table in use; adaptive
    execution joins those that turn out small. A count that a session was started with stays."""
    n = -(-rows // ROWS_PER_PARTITION)
    known = int(spark.conf.get(FIRST_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if n > known and not spark.sparkContext.getConf().contains(FIRST_PARTITIONS):
        spark.conf.set(FIRST_PARTITIONS, str(n))


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None, app: str = "spikegrid"):
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in SQL_OPTIONS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.config("spark.ui.enabled", "false").getOrCreate()
    visible_to_workers(spark)
    return spark


def ship(spark: SparkSession) -> str:
    """Send this package to the Python workers of a cluster on which it is not installed.

    Returns the archive's path. Once per session is enough; workers unpack nothing, they
    import from the archive."""
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root).as_posix()}")
    handle, path = tempfile.mkstemp(prefix="spikegrid-", suffix=".zip")       # the driver serves it to the executors
    with os.fdopen(handle, "wb") as out:
        out.write(held.getvalue())
    spark.sparkContext.addPyFile(path)
    return path


def visible_to_workers(spark: SparkSession) -> None:
    """Let workers on machines that see this folder import the package from it, whatever
    folder the driver was started in."""
    root, known = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spikegrid-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def computed_once(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a table that several branches of a plan read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
