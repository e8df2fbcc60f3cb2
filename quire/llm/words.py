"""Words of a text, as the text operators count them: runs of anything but the six ASCII blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\x0B\f\r]+"


def words(text: Column | str) -> Column:
    """The words in their order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text)).cast("bigint")
