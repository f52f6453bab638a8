"""One query per operator, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm import convtrie, decontamination, disclosure, licences, maintext, packing, partenum, quantised, rankedsearch, secretscan, severity, slots, tokenfile, tokens
from newsflow.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register("op1_main_text")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    return maintext.extracted(table(spark, folder, "pages"), maintext.train(spark))


@register("op2_latent_decontamination")
def latent_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register("op4_disclosure")
def disclosed(spark: SparkSession, folder: str) -> DataFrame:
    return disclosure.report(table(spark, folder, "documents"))


@register("op6_sentence_rules", licences.SQL)
def sentence_rules(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scanned(table(spark, folder, "documents"))


@register("op7_ordinal_toxicity")
def ordinal_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = severity.train(docs, table(spark, folder, "labels"))
    return severity.scored(docs, model)


@register("op3_virtual_slots")
def virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    placed = slots.sharded(table(spark, folder, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


@register("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(table(spark, folder, "documents"), tokens.tokenizer_path())


@register("op9_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    target = f"{shared_dir(spark)}/newsflow/{spark.sparkContext.applicationId}/token-files-{uuid.uuid4().hex}"
    tokenfile.write(table(spark, folder, "documents"), target, tokens.tokenizer_path())
    return tokenfile.read(spark, target)


@register("op8_product_quantisation")
def product_quantisation(spark: SparkSession, folder: str) -> DataFrame:
    return quantised.near_vectors(table(spark, folder, "embeddings"))


@register("op10_partenum")
def ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return partenum.near_duplicates(table(spark, folder, "documents"))


@register("op13_token_efficiency")
def token_efficiency(spark: SparkSession, folder: str) -> DataFrame:
    return secretscan.report(table(spark, folder, "documents"), secretscan.vocabulary_path())


@register("op12_truncation_peeling", convtrie.SQL)
def truncation_peeling(spark: SparkSession, folder: str) -> DataFrame:
    return convtrie.trie(table(spark, folder, "conversations"))


@register("op11_nra", rankedsearch.SQL)
def nra(spark: SparkSession, folder: str) -> DataFrame:
    return rankedsearch.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
