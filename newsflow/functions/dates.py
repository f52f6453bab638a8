"""Publication times of the four sources, as UTC timestamps (null when unreadable)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HONG_KONG = "+08:00"

# The forms of the sources' date cells.
RELEASE_TIME = r"(\d{2}/\d{2}/\d{4} \d{2}:\d{2})"
CHINESE_DATE = r"(?i)(\d{4})年(\d{1,2})月(\d{1,2})日.*?(\d{1,2}):(\d{2})\s*([AP])M"
NEWSTIME = r"(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2})"


def _from_hong_kong(wall_clock: Column) -> Column:
    return F.to_utc_timestamp(wall_clock, HONG_KONG)


def release_time(text: Column) -> Column:
    """``DD/MM/YYYY HH:mm`` anywhere in the cell, Hong Kong time."""
    stamp = F.regexp_extract(text, RELEASE_TIME, 1)
    return _from_hong_kong(F.try_to_timestamp(stamp, F.lit("dd/MM/yyyy HH:mm")))


def chinese_date_cell(text: Column) -> Column:
    """``YYYY年M月D日 … h:mmAM`` on a 12-hour clock, Hong Kong time."""
    part = lambda i: F.regexp_extract(text, CHINESE_DATE, i)
    number = lambda i: F.try_to_number(part(i), F.lit("9999")).cast("int")
    hour = number(4) % 12 + F.when(F.upper(part(6)) == "P", 12).otherwise(0)
    return _from_hong_kong(
        F.try_make_timestamp(number(1), number(2), number(3), hour, number(5), F.lit(0))
    )


def newstime_cell(text: Column) -> Column:
    """``YYYY/MM/DD HH:MM`` inside a script call, Hong Kong time."""
    stamp = F.regexp_replace(
        F.regexp_extract(text, NEWSTIME, 1), r"\s+", " "
    )
    return _from_hong_kong(F.try_to_timestamp(stamp, F.lit("yyyy/MM/dd HH:mm")))


def rfc822(text: Column) -> Column:
    """Feed date.  The weekday is dropped first, since Spark does not parse it."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z")),
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm z")),
    )


def compact_date(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def effective_time(published_at: Column, created_at: Column) -> Column:
    return F.coalesce(published_at, created_at)
