"""Session construction and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench: UTC, Arrow, adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("parchmint")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PARCHMINT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset on one machine (tests) a
    temporary folder is made once and set for the session; on a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="parchmint-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found


#: Bytes of a written table's row groups and rows of a held table's batches: what a task buffers in the heap.
ROW_GROUP, HELD_ROWS = 32 << 20, 1_000

_WRITTEN: dict[str, list[str]] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which ``sweep`` deletes."""
    path = f"{shared_dir(spark).rstrip('/')}/parchmint-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, columns stay prunable."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by Spark's own reader only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stamp(df: DataFrame) -> str:
    """What changes when a file that ``df`` reads is added, removed or written anew: a hash over names, sizes and times."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return str(tuple(files.agg(F.count("*"), F.expr("bit_xor(xxhash64(*))")).first()))


#: Bytes of rows that come to a Python worker at once: Spark counts rows by default, which lets a batch grow with its texts.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package, once a Spark context: Python workers need not have it installed. Their batches are bounded by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if not getattr(context, "_parchmint_shipped", False):
        home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="parchmint-code-")
        context.addPyFile(shutil.make_archive(os.path.join(folder, "parchmint"), "zip", home, "parchmint"))
        context._parchmint_shipped = True
    return spark


_HELD: dict[str, list[DataFrame]] = {}


def held(df: DataFrame) -> DataFrame:
    """Keep what ``df`` makes on the executors' disks; parts that are lost are made again.

    For tables that come straight from a scan. What must not change between runs of a task (made
    ids) or would drag shuffles along is written by ``materialize``. ``let_go`` frees what the
    caller has not freed by ``unpersist``.
    """
    df.sparkSession.conf.set("spark.sql.inMemoryColumnarStorage.batchSize", str(HELD_ROWS))
    kept = df.persist(StorageLevel.DISK_ONLY)
    _HELD.setdefault(df.sparkSession.sparkContext.applicationId, []).append(kept)
    return kept


def let_go(spark: SparkSession) -> None:
    """Free all tables that ``held`` keeps: for the end of a job whose result has been written."""
    for df in _HELD.pop(spark.sparkContext.applicationId, []):
        df.unpersist()


#: What else is to be forgotten when the tables of an application are deleted.
ON_SWEEP: list[Callable[[str], None]] = []


def sweep(spark: SparkSession) -> None:
    """Delete all tables that ``materialize`` has written in this session: for the end of a job, when nothing reads them any more."""
    application = spark.sparkContext.applicationId
    for forget in ON_SWEEP:
        forget(application)
    paths, jvm = _WRITTEN.pop(application, []), spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
