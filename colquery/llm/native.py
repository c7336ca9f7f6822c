"""SQL expressions on text that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs of other than the six ASCII spaces; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda x: x != "")


def word_count(text: Column) -> Column:
    """``size(words)`` without the filter: splitting leaves an empty string at most at either end."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    ends = (F.element_at(parts, 1) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - ends).cast("long")
