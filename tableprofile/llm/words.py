"""Words of a text, as column expressions.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and
carriage return. A null text has no words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """All words of a text in order."""
    return F.filter(F.split(whole(text), SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, UPPER, UPPER.lower())


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """The rows that no model learns from: one fold by the checksum of the id's text.

    A null id counts as held out.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))
