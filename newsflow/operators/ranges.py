"""Ranks and order statistics over groups of any size.

A window over a whole group would put a hot group into one task.  Here the rows are range
partitioned on (group, order) first, so that a large group spreads over many partitions; a
table of per-partition totals then gives every partition its starting value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsflow.session import materialise, small


def running_total(rows: DataFrame, group: list[str], order: list[Column], weight: Column,
                  name: str = "upto") -> DataFrame:
    """Adds the inclusive running sum of ``weight`` within ``group`` along ``order``.

    ``order`` must be total within the group.  The partitioned rows are written out once, so
    that totals and rows see the same partition bounds.
    """
    keys = [F.col(g) for g in group]
    ranged = materialise(
        rows.withColumn("_w", weight)
        .repartitionByRange(*keys, *order)
        .withColumn("_part", F.spark_partition_id()),
        "ranged",
    )
    totals = ranged.groupBy("_part", *group).agg(F.sum("_w").alias("_sum"))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = W.partitionBy("_part", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        ranged.join(starts, ["_part", *group])
        .withColumn(name, F.col("_start") + F.sum("_w").over(inside))
        .drop("_w", "_part", "_start")
    )


_ROW_BITS = 33


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based position in the total order.

    One range shuffle: the sorted rows are written with their partition and their place in it,
    and a table of partition sizes gives every partition its first rank.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = materialise(ranged, "ranged").withColumn("_part", F.shiftright("_id", _ROW_BITS))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per partition.
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    place = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return ranged.join(small(starts), "_part").withColumn(name, F.col("_start") + place + 1).drop("_id", "_part", "_start")


def latency_summary(samples: DataFrame, group: str, value: str) -> DataFrame:
    """n, min, median, p95 and max per group, exactly.

    p95 is the element at ``min(n−1, ⌊0.95·n⌋)`` of the sorted samples.  Equal samples collapse
    to one row with a count before anything is ordered.
    """
    counted = samples.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    counted = materialise(counted, "counted")
    placed = running_total(counted, [group], [F.col(value)], F.col("_n"), "_upto")
    # Stored, so that the join below can be broadcast or split around a hot group.
    sizes = materialise(
        counted.groupBy(group).agg(F.sum("_n").alias("n"), F.min(value).alias("min"), F.max(value).alias("max")), "sizes"
    )
    n = F.col("n")
    holds = lambda index: F.when((F.col("_upto") - F.col("_n") <= index) & (index < F.col("_upto")), F.col(value))
    low, high = F.floor((n - 1) / 2), F.floor(n / 2)
    tail = F.least(n - 1, F.floor(F.lit(0.95) * n))
    return (
        placed.join(sizes, group)
        .groupBy(group, "n", "min", "max")
        .agg(
            ((F.max(holds(low)) + F.max(holds(high))) / 2).alias("median"),
            F.max(holds(tail)).alias("p95"),
        )
        .select(group, "n", "min", "median", "p95", "max")
    )


# --- mergeable counts ----------------------------------------------------------------------

#: Relative error of a value read from counts; the element itself has the exact rank.
VALUE_ERROR = 0.01
_STEP = math.log((1 + VALUE_ERROR) / (1 - VALUE_ERROR))


def value_counts(samples: DataFrame, group: str, value: str) -> DataFrame:
    """(group, sign, cell, n, min, max): samples counted in cells whose ends differ by a fixed ratio.

    Counts of any parts of the samples add up to those of all (``merged_counts``), in any order.  A group has about 115
    cells for each power of ten, however many samples.  Nulls and NaN are no samples; infinities have a cell of their own.
    """
    v = F.col(value).cast("double")
    known = samples.where(v.isNotNull() & ~F.isnan(v))
    infinite = F.abs(v) == F.lit(float("inf"))
    cell = F.when(v == 0, 0).when(infinite, 1 << 30).otherwise(F.floor(F.log(F.abs(v)) / _STEP)).cast("int")
    return known.groupBy(group, F.signum(v).cast("int").alias("sign"), cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def merged_counts(counts: DataFrame, group: str) -> DataFrame:
    return counts.groupBy(group, "sign", "cell").agg(F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"))


def summary_of_counts(counts: DataFrame, group: str) -> DataFrame:
    """n, min, median, p95 and max per group from merged counts: ranks as in ``latency_summary``, values within ``VALUE_ERROR``."""
    whole = counts.groupBy(group).agg(F.sum("n").alias("_all"), F.min("min").alias("_min"), F.max("max").alias("_max"))
    # one row per cell of a group
    order = W.partitionBy(group).orderBy("sign", F.col("sign") * F.col("cell"))
    placed = counts.withColumn("_upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))).join(whole, group)
    middle = F.exp((F.col("cell") + 1) * _STEP) * (1 - VALUE_ERROR)  # no further than the error from either end
    read = F.when(F.col("sign") == 0, 0.0).when(F.col("min") == F.col("max"), F.col("min")).otherwise(F.least("max", F.greatest("min", F.col("sign") * middle)))
    n = F.col("_all")
    at = lambda index: F.max(F.when((F.col("_upto") - F.col("n") <= index) & (index < F.col("_upto")), read))
    low, high, tail = F.floor((n - 1) / 2), F.floor(n / 2), F.least(n - 1, F.floor(F.lit(0.95) * n))
    return placed.groupBy(group, F.col("_all").alias("n"), F.col("_min").alias("min"), F.col("_max").alias("max")).agg(
        ((at(low) + at(high)) / 2).alias("median"), at(tail).alias("p95")
    ).select(group, "n", "min", "median", "p95", "max")


def pooled(samples: DataFrame, group: str, members: list[str], label: str) -> DataFrame:
    """Samples plus a second copy of the listed groups under a common label."""
    pool = samples.where(F.col(group).isin(members)).withColumn(group, F.lit(label))
    return samples.unionByName(pool)
