"""Feed snapshots to feed entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow import schemas
from newsflow.functions import dates, text, urls

ITEM_DDL = "title STRING, link STRING, pubDate STRING"


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """Items of stored RSS files, with the file each came from."""
    items = (
        spark.read.format("xml").option("rowTag", "item").schema(schemas.FEED_ITEM).load(path)
    )
    return items.withColumn("feed", F.input_file_name())


def parse_items(items: DataFrame, xml: str = "xml") -> DataFrame:
    """The same for ``<item>`` texts held in a column."""
    parsed = F.from_xml(F.col(xml), ITEM_DDL)
    return items.withColumn("_item", parsed).select(*[c for c in items.columns if c != xml], "_item.*")


def entries(items: DataFrame, *keep: str) -> DataFrame:
    """(title, url, published_at), stripped; entries without a title or link are left out."""
    return items.select(
        *keep,
        text.strip(text.or_empty(F.col("title"))).alias("title"),
        text.strip(text.or_empty(F.col("link"))).alias("url"),
        dates.rfc822(F.col("pubDate")).alias("published_at"),
    ).where((F.col("title") != "") & (F.col("url") != ""))


def failed_feeds(items: DataFrame, polled: DataFrame, feed: str = "feed") -> DataFrame:
    """Polled feeds that returned no item at all: a failure of the source."""
    return polled.join(items.select(feed).distinct(), feed, "left_anti")


def yahoo_entries(feed_entries: DataFrame) -> DataFrame:
    return feed_entries.where(urls.is_yahoo_article(F.col("url")))

