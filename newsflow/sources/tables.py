"""Stored tables: scans, appends, upserts, versioned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow import schemas
from newsflow.functions.text import derived_id
from newsflow.operators.dedup import latest_version


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Live raw rows; the filter reaches the scan."""
    return read(spark, path, schemas.RAW_NEWS).where(~F.col("is_deleted"))


def read_skill_logs(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON lines; rows that do not parse come back with all fields null."""
    return spark.read.schema(schemas.SKILL_LOG).json(path)


def parse_skill_logs(lines: DataFrame, column: str = "line") -> DataFrame:
    ddl = schemas.SKILL_LOG
    return lines.select(F.from_json(F.col(column), ddl).alias("_log")).select("_log.*")


def source_dimension(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schemas.DATA_SOURCES)


def append(rows: DataFrame, path: str, *partition_by: str) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch.  A replay of the batch replaces its own folder."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """All batch folders, or those of earlier batches only."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(whole).parquet(path)
    return (rows if before is None else rows.where(F.col("batch_id") < before)).drop("batch_id")


def save_bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> None:
    """Catalog table bucketed and sorted on ``key``.

    Two tables bucketed alike on ``raw_id`` join, or anti-join, without a shuffle of the bodies.
    """
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def error_rows(failures: DataFrame, execution_id: Column, created_at: Column) -> DataFrame:
    """Failures in the error-log shape; the attempt count is taken as it comes."""
    return failures.select(
        derived_id(execution_id, F.col("source_url")).alias("error_id"),
        execution_id.alias("execution_id"),
        "source_name", F.col("source_url").alias("url"), "error_type", "error_code",
        F.col("attempt_count").cast("int").alias("attempt_count"), created_at.alias("created_at"),
    )


def metadata_json(metadata: Column) -> Column:
    return F.to_json(metadata)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *version: str) -> DataFrame:
    """One row per key, greatest version wins.  Both sides have the same columns."""
    return latest_version(old.unionByName(new), keys, *version)


def quarantine(rows: DataFrame, error: Column, layer: str, failed_at: Column) -> DataFrame:
    """Dead-letter rows: the failing row as text, its error, deliveries, layer and time."""
    payload = F.to_json(F.struct(*[c for c in rows.columns if c != "delivery_count"]))
    return rows.select(
        payload.alias("message"), error.alias("error_detail"), "delivery_count",
        F.lit(layer).alias("layer"), failed_at.alias("failed_at"),
    )


# --- versioned snapshots -----------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, target, files = _files(spark, path)
    return files.exists(target)


def current_version(spark: SparkSession, root: str) -> int | None:
    """Version the pointer names; null before the first publication."""
    if not exists(spark, f"{root}/current"):
        return None
    return int(spark.read.text(f"{root}/current").first()["value"])


def publish(rows: DataFrame, root: str, version: int) -> int:
    """Write ``version`` beside the current one, then switch the pointer in one rename.

    Readers see the old version until the rename.  Writing a version again replaces it.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{root}/version={version}")
    jvm, temp, files = _files(spark, f"{root}/_current.{version}")
    out = files.create(temp, True)
    out.write(bytearray(str(version), "utf-8"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temp, jvm.org.apache.hadoop.fs.Path(f"{root}/current"), overwrite)
    return version


def published(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    version = current_version(spark, root) if version is None else version
    return None if version is None else spark.read.parquet(f"{root}/version={version}")

