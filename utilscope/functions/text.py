"""Text cleaning and label normalization."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


# The characters that count as white space around text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# End of fixed values.


def strip_text(c: Column) -> Column:
    """NULL becomes '', surrounding white space of any kind (tabs, NBSP) goes."""
    return F.trim(F.coalesce(c, F.lit("")), F.lit(WHITE_SPACE))


def normalize_text(c: Column) -> Column:
    """Lower case with every run of other characters as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def provider_id(c: Column) -> Column:
    """Ten-digit identifier: a trailing '.0' dropped, short values zero-padded, long ones kept."""
    plain = F.regexp_replace(c, r"\.0$", "")
    return F.when(F.length(plain) < 10, F.lpad(plain, 10, "0")).otherwise(plain)


def masked_id(npi: Column) -> Column:
    return F.concat(F.lit("NPI-******"), F.right(npi, F.lit(4)))


def or_unknown(c: Column) -> Column:
    """Blank or NULL labels fall into the 'Unknown' bucket."""
    return F.when((c.isNull()) | (c == ""), F.lit(UNKNOWN)).otherwise(c)


def contains_any(c: Column, words: list[str]) -> Column:
    """True where `c` contains one of `words` (false for an empty list).

    One search for all words, so that what `c` stands for is computed once a row, not once a word.
    """
    if not words:
        return F.lit(False)
    return c.rlike("|".join(map(re.escape, words)))
