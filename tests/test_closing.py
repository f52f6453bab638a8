"""Events close by timer; withdrawn ones never do; state holds open events only."""

from pyspark.sql import functions as F

from newsflow.operators.merging import HOUR, Span
from newsflow.sources import tables
from newsflow.streaming import closing, corrections
from test_corrections import BASE, reports


def test_closing_over_batches(spark, tmp_path):
    root, out, span = str(tmp_path), str(tmp_path / "closed"), Span.hours()
    step = corrections.correcting_step(root, span)
    batches = [
        [(1, "a", BASE), (2, "a", BASE + 6 * HOUR), (3, "b", BASE + 3 * HOUR)],
        [(4, "a", BASE + 3 * HOUR), (5, "b", BASE + 7 * HOUR)],  # bridges the two events of a
        [(6 + k, "b", BASE + (10 + 3 * k) * HOUR) for k in range(7)],  # b reaches the cap and opens anew
        [(20, "c", BASE + 40 * HOUR)],
    ]
    for n, rows in enumerate(batches):
        step(reports(spark, rows), n)
        closing.start(spark, root, out, str(tmp_path / "cp"), span).awaitTermination()
        closed = {(r["stock_code"], (r["first"] - BASE) // HOUR, r["reports"], r["reason"]) for r in tables.read_batches(spark, out, closing.CLOSED).collect()}
        want = [set(), set(), {("a", 0, 3, "window")}, {("a", 0, 3, "window"), ("b", 3, 8, "cap"), ("b", 28, 1, "window")}][n]
        assert closed == want
    left = closing.still_open(spark, root, out).collect()
    assert [(r["stock_code"], r["reports"]) for r in left] == [("c", 1)]
    store = spark.read.format("statestore").option("stateVarName", "event").load(str(tmp_path / "cp"))
    assert store.count() == 1  # c alone
    assert spark.read.parquet(f"{root}/withdrawn").where(F.col("batch_id") == 1).count() == 1
