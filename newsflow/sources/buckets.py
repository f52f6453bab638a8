"""Stored tables in hash buckets of their key, so that a batch touches only buckets its keys can be in.

Rows lie under ``data/gen=<generation>/bucket=<bucket>``.  A manifest, published like any versioned snapshot, tells for every
bucket its generations and a fixed number of bits, a Bloom filter of its keys.  An upsert rewrites the touched buckets as a
new generation and switches the manifest; other files keep their names.  An append adds a generation to
the touched buckets.  A probe tests the bits in the row first and reads only buckets in which a key may be.
A lookup reads the buckets of the asked keys.

Files of a generation that failed before its manifest was published are replaced when it is written again; readers of an
older manifest keep their files.  Choose the number of buckets so that one bucket is a task's work; rows of one key
are dealt over up to ``SPREAD`` files of a generation, so a hot key is no hot task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.operators.dedup import latest_version
from newsflow.session import materialise, small
from newsflow.sources import tables

#: Bits of a bucket's filter, in words of 64; right for some ten thousand keys a bucket.
BITS = 1 << 16
SPREAD = 8
_WORDS = BITS // 64
MANIFEST = "bucket int, gens array<bigint>, bits array<bigint>"


@dataclass(frozen=True)
class Buckets:
    """A table of ``schema`` under ``root``, in ``count`` buckets of ``keys``."""

    root: str
    schema: T.StructType
    keys: tuple[str, ...]
    count: int

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.count)).cast("int")

    def manifest(self, spark: SparkSession) -> DataFrame:
        if tables.current_version(spark, f"{self.root}/manifest") is None:
            return spark.createDataFrame([], MANIFEST)
        return tables.published(spark, f"{self.root}/manifest")

    def _next(self, spark: SparkSession) -> int:
        version = tables.current_version(spark, f"{self.root}/manifest")
        return 0 if version is None else version + 1

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows' keys, at most ``count``."""
        return sorted(r["bucket"] for r in rows.select(self.bucket().alias("bucket")).distinct().collect())

    def paths(self, spark: SparkSession, buckets: list[int] | None = None) -> list[str]:
        """Folders of the buckets, or of all, in the current version."""
        rows = self.manifest(spark).select("bucket", "gens")
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return [f"{self.root}/data/gen={g}/bucket={r['bucket']}" for r in rows.collect() for g in r["gens"]]

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        paths = self.paths(spark, buckets)
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    # --- writing -------------------------------------------------------------------------

    def _write(self, rows: DataFrame, generation: int) -> None:
        place = F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD))
        dealt = rows.withColumn("bucket", self.bucket()).repartition("bucket", place)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/gen={generation}")

    def _filters(self, rows: DataFrame) -> DataFrame:
        """(bucket, bits) of the rows' keys."""
        placed = rows.select(self.bucket().alias("bucket"), F.explode(F.array(*self._places())).alias("p"))
        placed = placed.select("bucket", F.expr("p div 64").cast("int").alias("at"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
        words = placed.groupBy("bucket", "at").agg(F.bit_or("bit").alias("word"))
        by_place = words.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("w"))
        whole = F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), lambda i: F.coalesce(F.element_at("w", i), F.lit(0).cast("bigint")))
        return by_place.select("bucket", whole.alias("bits"))

    def _places(self) -> list[Column]:
        h = F.xxhash64(F.lit(1), *self.keys)
        return [F.pmod(h, F.lit(BITS)), F.pmod(F.shiftright(h, 32), F.lit(BITS))]

    def append(self, rows: DataFrame) -> None:
        """Add rows; keys may be there already."""
        spark = rows.sparkSession
        generation, rows = self._next(spark), materialise(rows.select(*self.schema.names), "append")
        self._write(rows, generation)
        new = self._filters(rows).select("bucket", F.array(F.lit(generation).cast("bigint")).alias("_gens"), F.col("bits").alias("_bits"))
        both = self.manifest(spark).join(new, "bucket", "full_outer")
        bits = F.when(F.col("bits").isNull(), F.col("_bits")).when(F.col("_bits").isNull(), F.col("bits")).otherwise(
            F.zip_with("bits", "_bits", lambda a, b: a.bitwiseOR(b))
        )
        none = F.array().cast("array<bigint>")
        self._publish(both.select("bucket", F.concat(F.coalesce("gens", none), F.coalesce("_gens", none)).alias("gens"), bits.alias("bits")), generation)

    def upsert(self, rows: DataFrame, *version: str) -> list[int]:
        """One row per key, the greatest version wins.  Only touched buckets are read and rewritten; returns them."""
        spark = rows.sparkSession
        rows = materialise(rows.select(*self.schema.names), "upsert")
        touched, generation = self.touched(rows), self._next(spark)
        merged = materialise(latest_version(self.read(spark, touched).unionByName(rows), list(self.keys), *version).select(*self.schema.names), "merged")
        self._write(merged, generation)
        new = self._filters(merged).select("bucket", F.array(F.lit(generation).cast("bigint")).alias("gens"), "bits")
        self._publish(self.manifest(spark).where(~F.col("bucket").isin(touched)).unionByName(new), generation)
        return touched

    def _publish(self, manifest: DataFrame, version: int) -> None:
        tables.publish(materialise(manifest, "manifest"), f"{self.root}/manifest", version)

    # --- reading by key --------------------------------------------------------------------

    def suspected(self, rows: DataFrame) -> DataFrame:
        """The rows with ``_bucket`` and ``_may``: whether the key may be stored, by the bits alone."""
        filters = self.manifest(rows.sparkSession).select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
        joined = rows.withColumn("_bucket", self.bucket()).join(small(filters, 10_000), "_bucket", "left")
        set_ = [F.getbit(F.get("_bits", F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in self._places()]
        return joined.withColumn("_may", F.coalesce(set_[0] & set_[1], F.lit(False))).drop("_bits")

    def absent(self, rows: DataFrame) -> DataFrame:
        """The rows whose key is not stored.  Reads the buckets of suspected keys only."""
        spark = rows.sparkSession
        marked = materialise(self.suspected(rows), "suspected")
        hits = marked.where("_may")
        touched = [r["_bucket"] for r in hits.select("_bucket").distinct().collect()]  # at most the number of buckets
        stored = materialise(self.read(spark, touched).select(*self.keys).distinct(), "stored-keys") if touched else None
        sure = marked.where(~F.col("_may"))
        checked = hits if stored is None else hits.join(stored, list(self.keys), "left_anti")
        return sure.unionByName(checked).drop("_bucket", "_may")

    def lookup(self, asked: DataFrame) -> DataFrame:
        """Stored rows of the asked keys."""
        keys = materialise(asked.select(*self.keys).distinct(), "asked")
        return self.read(asked.sparkSession, self.touched(keys)).join(small(keys), list(self.keys), "left_semi")
