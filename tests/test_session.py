"""Arrow batches between the JVM and Python are bounded by bytes."""

import pyarrow as pa
import pytest

from newsflow import params
from newsflow.llm import arrow
from newsflow.session import ship_package

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_long_texts_are_small_and_whole(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    ship_package(spark)
    texts = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 10000) AS text")
    found = texts.mapInArrow(sizes, "rows bigint, bytes bigint").collect()
    assert sum(r["rows"] for r in found) == 3000
    assert max(r["bytes"] for r in found) < 2 * params.ARROW_BATCH_BYTES


@pytest.mark.parametrize("asked, kept", [("1m", "1m"), ("64m", str(params.ARROW_BATCH_BYTES))])
def test_smaller_limits_of_the_session_stay(spark, asked, kept):
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, asked)
    ship_package(spark)
    now = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, before)
    assert now == kept


@pytest.mark.parametrize("sizes", [[], [0, 0], [100] * 41, [100] * 14 + [5000] + [100] * 30, [10**6]])
def test_slices_are_even_and_whole(sizes):
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in sizes], pa.string())], ["text"])
    runs = list(arrow.slices(iter([batch]), limit=1000))
    assert [t for run in runs for t in run.column("text").to_pylist()] == batch.column("text").to_pylist()
    totals = [sum(map(len, run.column("text").to_pylist())) for run in runs]
    assert max(totals, default=0) <= max([1600, *(n + 1600 for n in sizes if n > 1000)])
    if set(sizes) == {100}:
        assert max(totals) - min(totals) <= 200
