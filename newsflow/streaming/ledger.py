"""Delivery ledger: what has been delivered, and how it ended, by id.

At-least-once delivery hands rows out again after days or in the same batch.  The ledger keeps a line per id under the day of
the row's own time, which a repeated row has too; a batch reads only the days its rows are of, so its cost does not grow with
the age of the stream.  Folders of days from which nothing is delivered any more may be deleted.

Faulty rows wait with their delivery count, are tried again with the next batch and are put aside as dead letters after
``most`` deliveries.  At the end of input ``settle_all`` gives what still waits its remaining deliveries, so nothing is left over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsflow import params, schemas
from newsflow.operators import cleaning
from newsflow.session import materialise, shuffled
from newsflow.sources import tables
from newsflow.streaming import delivery

LEDGER = T.StructType([T.StructField("id", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("deliveries", T.LongType()), T.StructField("batch_id", T.LongType()), T.StructField("day", T.DateType())])
DEAD = "DEAD"


class Ledger:
    """Lines under ``root``, in folders of batch and day."""

    def __init__(self, root: str):
        self.root = root

    def lines(self, spark: SparkSession, before: int | None = None, days: list | None = None) -> DataFrame:
        if not tables.exists(spark, self.root):
            return spark.createDataFrame([], LEDGER)
        rows = spark.read.schema(LEDGER).parquet(self.root)
        rows = rows if before is None else rows.where(F.col("batch_id") < before)
        return rows if days is None else rows.where(F.col("day").isin(days))

    def fresh(self, rows: DataFrame, row_id: str, at: Column, batch_id: int) -> DataFrame:
        """Rows delivered for the first time, one per id, with ``day``; reads the ledger of their days only.

        Repeats within the batch and those told by the ledger go behind one exchange of the rows.
        """
        delivered = materialise(rows.withColumn("day", F.coalesce(F.to_date(at), F.lit("1970-01-01").cast("date"))), "delivered")
        days = [r["day"] for r in delivered.select("day").distinct().collect()]  # days of one batch
        known = self.lines(rows.sparkSession, batch_id, days).select(F.col("id").alias(row_id)).distinct()
        return delivered.dropDuplicates([row_id]).join(shuffled(known), row_id, "left_anti")

    def record(self, lines: DataFrame, batch_id: int) -> None:
        """Lines (id, outcome, deliveries, day) of a batch; a replay replaces them.

        Each core gets a range of days and ids, so that a batch makes no more files than it has days and cores together, not one per day and task.
        """
        lines = lines.select("id", "outcome", F.col("deliveries").cast("bigint").alias("deliveries"), "day")
        cores = lines.sparkSession.sparkContext.defaultParallelism
        lines.repartitionByRange(cores, "day", "id").write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/batch_id={batch_id}")


def _clean(root: str, rows: DataFrame, expected_version: int, most: int, folder: int, body_min_length: int) -> DataFrame:
    """Clean good rows, put dead ones aside, keep the rest waiting; returns the ledger's lines of all that arrived first or ended."""
    arrived = materialise(rows, "arrived")
    good, retry, dead = delivery.settle(arrived, delivery.version_error(F.col("v"), expected_version), most)
    # the raw texts of good rows are not needed any more
    assessed = materialise(cleaning.assess(good, body_min_length).drop("title", "body"), "assessed")
    tables.write_batch(cleaning.accepted(assessed, F.col("created_at")), f"{root}/cleaned", folder)
    tables.write_batch(cleaning.rejections(assessed), f"{root}/rejected", folder)
    tables.write_batch(retry, f"{root}/waiting", folder)
    tables.write_batch(tables.quarantine(dead.drop("day"), F.col("error_detail"), "cleaning", F.col("created_at")), f"{root}/dead", folder)
    line = lambda df, outcome: df.select(F.col("raw_id").alias("id"), outcome.alias("outcome"), F.col("delivery_count").alias("deliveries"), "day")
    return (
        line(assessed, F.coalesce("reject_reason", F.lit("ACCEPTED"))).unionByName(line(dead, F.lit(DEAD)))
        .unionByName(line(retry.withColumn("delivery_count", F.col("delivery_count") - 1), F.lit(None).cast("string")))
    )


def cleaning_step(root: str, expected_version: int = 1, most: int = params.MAX_DELIVERIES, body_min_length: int = params.BODY_MIN_LENGTH):
    """Step for raw rows with a schema version ``v``: each id ends once, as ACCEPTED, a rejection or DEAD, however often it comes."""
    ledger = Ledger(f"{root}/ledger")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = ledger.fresh(cleaning.live(batch), "raw_id", F.col("created_at"), batch_id).withColumn("delivery_count", F.lit(1))
        waiting = f"{root}/waiting/batch_id={batch_id - 1}"
        if tables.exists(spark, waiting):
            arrived = arrived.unionByName(spark.read.schema(arrived.schema).parquet(waiting))
        ledger.record(_clean(root, arrived, expected_version, most, batch_id, body_min_length), batch_id)

    return step


def settle_all(spark: SparkSession, root: str, expected_version: int = 1, most: int = params.MAX_DELIVERIES, body_min_length: int = params.BODY_MIN_LENGTH) -> int:
    """Hand out what waits until it ends; for the end of input, no stream running.  Returns the extra deliveries."""
    ledger, turns = Ledger(f"{root}/ledger"), 0
    # a batch that takes up waiting rows writes a line for each, so what the last one left is what waits
    last = ledger.lines(spark).agg(F.max("batch_id")).first()[0]
    while last is not None and not (rows := spark.read.parquet(f"{root}/waiting/batch_id={last + turns}")).isEmpty():
        turns += 1
        ledger.record(_clean(root, rows, expected_version, most, last + turns, body_min_length), last + turns)
    return turns


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    """(id, outcome, deliveries) as of the last delivery; the outcome of a waiting row is null."""
    latest = F.max_by(F.struct("outcome", "deliveries"), "batch_id")
    return Ledger(f"{root}/ledger").lines(spark).groupBy("id").agg(latest.alias("l")).select("id", "l.*")


def start(raw: DataFrame, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    return delivery.start(raw, cleaning_step(root), checkpoint, every)
