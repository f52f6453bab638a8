"""Filing tables: one stored page to one row per filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow import params
from newsflow.functions import dates, markup, stocks, text, urls


# The classes of the text cells.
CELLS = {"headline": "headline", "release": "release-time", "stock": "stock-short-code"}
# Parts the cells of a row while their character references are decoded together.
SEPARATOR = "\u0001"


def _cell(row: Column, class_name: str) -> Column:
    """Text of the first ``td`` or ``div`` that carries the class; empty when absent."""
    inner = F.regexp_extract(
        row,
        rf"(?is)<(?:td|div)\b[^>]*\bclass\s*=\s*\"(?:[^\"]*\s)?{class_name}(?:\s[^\"]*)?\"[^>]*>(.*?)</(?:td|div)",
        1,
    )
    return F.regexp_replace(inner, markup.TAG, "")


def table_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per ``<tr>`` of the table body, with its four cells as text."""
    body = F.coalesce(markup.element(F.col(html), "tbody"), F.col(html))
    rows = F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr"), F.lit(1))
    link = r"(?is)\bdoc-link\b[^>]*>\s*<a\b[^>]*?\bhref\s*=\s*\"([^\"]*)\""
    row = F.col("_row")
    href = F.regexp_extract(row, link, 1)
    return (
        pages.select(*[c for c in pages.columns if c != html], F.posexplode(rows).alias("row_no", "_row"))
        .withColumn("pdf_href", F.when(row.rlike(link) & (href.endswith(".pdf") | (href == "")), href))
        .withColumn("_cells", F.concat_ws(SEPARATOR, *[_cell(row, c) for c in CELLS.values()]))
        .withColumn("_cells", F.split(markup.unescape(F.col("_cells")), SEPARATOR))
        .withColumns({name: F.get("_cells", F.lit(i)) for i, name in enumerate(CELLS)})
        .drop("_row", "_cells")
    )


def triage(rows: DataFrame) -> DataFrame:
    """Adds ``reason``: ``no_pdf_link``, ``no_href`` or ``ok``."""
    return rows.withColumn(
        "reason",
        F.when(F.col("pdf_href").isNull(), params.NO_PDF_LINK)
        .when(F.col("pdf_href") == "", params.NO_HREF)
        .otherwise(params.ROW_OK),
    )


def announcements(triaged: DataFrame, *keep: str, base: str = params.HKEX_BASE) -> DataFrame:
    """Accepted rows as (pdf_url, title, published_at, stock_codes); a bad time gives null."""
    return triaged.where(F.col("reason") == params.ROW_OK).select(
        *keep,
        urls.absolute(F.col("pdf_href"), base).alias("pdf_url"),
        text.strip(F.col("headline")).alias("title"),
        dates.release_time(F.col("release")).alias("published_at"),
        stocks.split_codes(F.col("stock")).alias("stock_codes"),
    )
