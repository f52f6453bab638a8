"""Text columns: normalisation, hashing, truncation, script detection."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsflow import params

# The code points that Python's ``\s`` treats as white space.  Java's own classes
# differ (no U+001C..U+001F), so the set is spelled out.
WHITE_SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_RARE_SPACE = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITE_SPACE = rf"[\x{{09}}-\x{{0d}}\x{{1c}}-\x{{20}}{_RARE_SPACE}]"
_COMMON_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_NOT_ASCII = r"[^\x{00}-\x{7f}]"

# Characters beyond ASCII that NFKC never changes, alone or side by side: Latin-1 letters,
# curly quotes and dashes, CJK brackets and stops, kana without combining marks, CJK
# ideographs, Hangul syllables.  Text made of these and ASCII needs no Unicode normalisation.
NFKC_SAFE = (
    r"\x{c0}-\x{ff}\x{2013}\x{2014}\x{2018}\x{2019}\x{201c}\x{201d}"
    r"\x{3001}\x{3002}\x{3008}-\x{3011}\x{3042}-\x{3096}\x{30a2}-\x{30fa}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}"
)

# The basic CJK block used for the Chinese share.
CHINESE = r"[\x{4e00}-\x{9fff}]"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


# Declared non-deterministic, so that the optimiser does not copy the call into filters that
# it pushes below the projection: each text then goes to Python once.
_nfkc = _nfkc.asNondeterministic()


def _has_rare(text: Column, rare: str) -> Column:
    """True if a character beyond ASCII satisfies ``rare``, a look-behind.

    ASCII texts are told by their length; in the others only the characters beyond ASCII reach
    the many ranges of the look-behind, which is several times faster than one large class.
    """
    return (F.octet_length(text) != F.length(text)) & text.rlike(_NOT_ASCII + rare)


def nfkc(text: Column) -> Column:
    """NFKC form.  Spark has no such function, so Python sees only the texts that may change;
    for every other row the argument is null and nothing is shipped to the worker."""
    unsafe = _has_rare(text, f"(?<![{NFKC_SAFE}])")
    return F.coalesce(_nfkc(F.when(unsafe, text)), text)


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, ends stripped.

    Rare spaces become blanks first, in texts that have any beyond ASCII, then the common ones.  That leaves two of
    these characters free to frame every blank; frames that touch cancel, and one per run is left.  Plain
    replacements are many times faster here than a regular expression.
    """
    rare = F.regexp_replace(text, f"{_NOT_ASCII}(?<=[{_RARE_SPACE}])", " ")
    plain = F.when(F.octet_length(text) == F.length(text), text).otherwise(rare)
    for char in _COMMON_SPACE:
        plain = F.replace(plain, F.lit(char), F.lit(" "))
    opened, closed = _COMMON_SPACE[-2:]
    for old, new in ((" ", opened + closed), (closed + opened, ""), (opened + closed, " ")):
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return F.trim(plain)


def strip(text: Column) -> Column:
    """White space removed from both ends only."""
    return F.btrim(text, F.lit(WHITE_SPACE_CHARS))


def is_blank(text: Column) -> Column:
    """Missing, empty or white space only; stops at the first other character."""
    return ~F.coalesce(text.rlike(WHITE_SPACE.replace("[", "[^", 1)), F.lit(False))


def normalise(text: Column) -> Column:
    return collapse(nfkc(text))


def digest(text: Column) -> Column:
    """SHA-256, 64 lower-case hex digits."""
    return F.sha2(text, 256)


def title_hash(title: Column) -> Column:
    return digest(normalise(title))


def derived_id(*parts: Column) -> Column:
    """Identifier computed from key columns, so a replay yields the same one."""
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def truncate(text: Column, limit: int) -> Column:
    return F.left(text, F.lit(limit))


def exceeds(text: Column, limit: int) -> Column:
    return F.coalesce(F.length(text) > limit, F.lit(False))


def chinese_ratio(text: Column) -> Column:
    """Share of Chinese characters; 0 for empty or missing text."""
    return F.coalesce(
        F.regexp_count(text, F.lit(CHINESE)) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)
    )


def is_chinese(text: Column, threshold: float = params.CHINESE_RATIO) -> Column:
    return chinese_ratio(text) > threshold
