"""Timestamps written by clients in several ISO-8601 notations, as columns that never fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"(?i)^\s*(\d{4}-\d{2}-\d{2})(?:[T ]+(\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)\s*(Z|[+-]\d{2}(?::?\d{2})?)?)?\s*$"

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def iso_timestamp(text: Column) -> Column:
    """The instant an ISO-8601 text names; UTC when it names no zone; null when it names no time.

    Date alone is its midnight.  Impossible dates (``2021-13-45``), words, blanks and null give null.  Digits
    of a second beyond the sixth are cut.
    """
    date, clock, zone = (F.regexp_extract(text, _SHAPE, i) for i in (1, 2, 3))
    zone = F.upper(zone)
    zone = F.when(zone == "", F.lit("Z")).otherwise(F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})$", "$1:$2"))
    zone = F.when(F.length(zone) == 3, F.concat(zone, F.lit(":00"))).otherwise(zone)
    clock = F.when(clock == "", F.lit("00:00:00")).otherwise(F.translate(clock, ",", "."))
    clock = F.when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    return F.when(date != "", F.try_to_timestamp(F.concat(date, F.lit("T"), clock, zone)))


def iso_micros(text: Column) -> Column:
    """``iso_timestamp`` as microseconds since 1970."""
    return F.unix_micros(iso_timestamp(text))


def blank(text: Column) -> Column:
    """True for null and for text that is empty or white space only; never null."""
    return text.isNull() | F.coalesce(text.rlike(r"^\s*$"), F.lit(True))
