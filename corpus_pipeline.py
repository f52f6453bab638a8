"""Corpus pipeline: documents that pass each stage go on to the next; the last stage packs them.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the columns of
``documents``, but for the last, which returns the places of the pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsflow.llm import decontamination, disclosure, packing, partenum, severity, tokens
from newsflow.session import shared_dir, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject; it is fitted on the labels of all documents that came in."""
    model = severity.train(docs, _table(spark, sf_dir, "labels"))
    return severity.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; documents without words stay."""
    ship_package(spark)
    return partenum.kept(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it masked."""
    ship_package(spark)
    return disclosure.sanitised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences."""
    ship_package(spark)
    return packing.packed_documents(docs, tokens.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", sanitised),
    ("packing", packed),
]

#: Tokenising, the trained model and the latent search have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = _table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{shared_dir(spark)}/newsflow/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{number}-{name}")
    return docs
