"""Session settings and durable intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow import params


def new_session(app: str = "newsflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC clock, AQE with skew handling."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local master may go without one; it then gets a fresh temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative jobs.  The table outlives lost executors, unlike a
    local checkpoint, and is read back column by column.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newsflow/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    for written in getattr(_open, "blocks", []):
        written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def distinct_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys as a stored table, for existence joins.

    Duplicates go before the shuffle.  As the table is read afresh, both inputs of the join are
    plain shuffles, which adaptive execution can broadcast or split when a key is hot; it
    cannot when one input is the output of an aggregate.
    """
    return materialise(rows.select(*keys).distinct(), "keys")


_open = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside the block are deleted when it ends.

    Results must have been written or collected by then.  Each micro-batch runs in such a
    block, so that a long-running stream does not fill the folder.
    """
    _open.blocks = [*getattr(_open, "blocks", []), []]
    try:
        yield
    finally:
        *_open.blocks, written = _open.blocks
        for path in written:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as cores.

    For tables of few row groups whose rows need much work.  A scan that already has enough
    partitions, as any large table does, is returned as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def small(df: DataFrame, limit: int = params.BROADCAST_MAX_ROWS) -> DataFrame:
    """Ask for a broadcast of ``df`` only if it holds at most ``limit`` rows.

    The check reads at most ``limit + 1`` rows.  A larger table comes back ``shuffled``.
    """
    return F.broadcast(df) if is_small(df, limit) else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast.

    Left alone, the planner judges a stored table by its files.  Columns that compress well take a few bytes a row there
    and a hundred in memory, so that millions of rows, or more if they are exploded, would go through the driver.
    """
    return df.hint("merge")


def is_small(df: DataFrame, limit: int = params.BROADCAST_MAX_ROWS) -> bool:
    return df.select(F.lit(1).alias("one")).limit(limit + 1).count() <= limit


def bound_batches(spark: SparkSession, limit: int = params.ARROW_BATCH_BYTES) -> None:
    """Arrow batches of at most about ``limit`` bytes in this session, unless it asks for smaller ones.

    Left alone, a batch holds 10,000 rows up to 64 MB.  Each running task has it several times, in buffers of the JVM outside
    the heap and in the Python worker, so that whole texts take hundreds of megabytes of an executor.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > limit:
        spark.conf.set(name, str(limit))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, and bound the session's Arrow batches.

    Python workers import it to run the few Arrow helpers, wherever the driver was started.
    """
    bound_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_newsflow_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / package.name), "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    context._newsflow_shipped = True
