"""Stock codes and pagination labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What parts the codes of a cell, and the form of a pagination label.
CODE_BREAK = r"[\s,]+"
PAGINATION = r"(\d+)\D+(\d+)"


def split_codes(cell: Column) -> Column:
    """Codes of a listing cell, split on blanks and commas."""
    tokens = F.split(F.trim(F.coalesce(cell, F.lit(""))), CODE_BREAK)
    return F.filter(tokens, lambda t: t != "")


def standardise(code: Column) -> Column:
    """``700``, ``00700`` or ``00700.HK`` to ``00700.HK``; null for anything else."""
    digits = F.regexp_extract(F.trim(code), r"(?i)^(\d{1,5})(?:\.HK)?$", 1)
    return F.when(digits != "", F.concat(F.lpad(digits, 5, "0"), F.lit(".HK")))


def looks_like_code(query: Column) -> Column:
    """Digits only, or anything that carries ``.HK``."""
    return query.rlike(r"^\d+$") | F.contains(query, F.lit(".HK"))


def codes_in_text(text: Column) -> Column:
    """Distinct standard codes written as ``12345.HK`` in running text."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![0-9])(\d{4,5}\.HK)\b"), F.lit(1))
    return F.array_distinct(F.transform(found, standardise))


def mentions(extra_metadata: Column, code: Column | str) -> Column:
    return F.coalesce(F.array_contains(extra_metadata["stock_code"], code), F.lit(False))


def pagination(label: Column) -> Column:
    """``Showing 100 of 1471 records`` to (showing, total, complete); null when unreadable."""
    showing = F.regexp_extract(label, PAGINATION, 1).try_cast("int")
    total = F.regexp_extract(label, PAGINATION, 2).try_cast("int")
    return F.when(
        showing.isNotNull() & total.isNotNull(),
        F.struct(showing.alias("showing"), total.alias("total"), (showing >= total).alias("complete")),
    )
