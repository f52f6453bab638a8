"""Filings whose document holds no text: kept, with the empty or missing text as their body."""

import compare
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from newsflow.operators import extraction

TEXTS = (None, "", " ", f"\n{chr(0x3000)}\x1c", chr(0xA0), " x\n", chr(0x200B))


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    path = tmp_path_factory.mktemp("textless")
    docs = [(36 * k + i, text) for k, text in enumerate(TEXTS) for i in range(36)]  # every remainder that the texts depend on
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/orders.parquet").where(F.col("o_orderkey") < len(docs)).coalesce(1).write.parquet(f"{path}/orders.parquet")
    spark.read.parquet(f"{sf}/pages.parquet").limit(20).coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", ["u1_union_sources", "e2_text_routing"])
def test_rows_of_the_sql(spark, folder, name):
    con = compare.duckdb.connect()
    for table in ("documents", "orders", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    cursor = con.execute(entry.oracle_sql()[name])
    want = compare.rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert compare.spark_rows(entry.queries()[name](spark, str(folder))) == want


def test_without_the_mark_it_is_a_failure(spark):
    rows = spark.createDataFrame([(" ", "", False, False), (" ", "", False, True), ("", None, False, True), (" ", "", True, True)], "p string, f string, e boolean, t boolean")
    routes = [extraction.route_text(F.col("p"), F.col("f"), F.col("e"), *more) for more in ((), (F.col("t"),))]
    plain, marked = ([tuple(r[0]) for r in rows.select(route).collect()] for route in routes)
    assert plain == [(None, "pdf_unreadable")] * 3 + [(None, "pdf_encrypted")]
    assert marked == [(None, "pdf_unreadable"), ("", None), (None, None), (None, "pdf_encrypted")]
