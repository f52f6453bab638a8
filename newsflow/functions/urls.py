"""Addresses and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow import params


def absolute(href: Column, base: str | Column) -> Column:
    base = base if isinstance(base, Column) else F.lit(base)
    return F.when(href.startswith("http"), href).otherwise(F.concat(base, href))


def is_yahoo_article(url: Column) -> Column:
    return F.contains(url, F.lit(params.YAHOO_ARTICLE_MARK))


def is_aastocks_article(href: Column) -> Column:
    return F.contains(href, F.lit(params.AASTOCKS_ARTICLE_MARK))


def hrefs(html: Column) -> Column:
    """Array of the ``href`` values of all ``<a>`` tags, in page order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
