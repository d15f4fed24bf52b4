"""Key and sentinel normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing value.
SENTINELS = ("", "nan", "none", "null", "<na>")


def blank_to_null(c: Column) -> Column:
    """Trimmed text; blanks and word sentinels become NULL."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin(*SENTINELS), t)


def video_key(c: Column) -> Column:
    """Video id as text: trimmed, a trailing ``.0`` dropped, sentinels NULL."""
    return blank_to_null(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""))
