"""Times in feeds. All operators use event time; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .numbers import lenient_long


def millis(value: Column) -> Column:
    return F.timestamp_millis(lenient_long(value))


def seconds(value: Column) -> Column:
    return F.timestamp_seconds(lenient_long(value))


def iso8601(text: Column) -> Column:
    """A time with zone, as in RFC 3339; null otherwise."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), text.try_cast("timestamp"))


def by_unit(value: Column, unit: Column) -> Column:
    """``iso8601``, ``s``, and milliseconds for every other unit."""
    return F.when(unit == "iso8601", iso8601(value)).when(unit == "s", seconds(value)).otherwise(millis(value))


def epoch_guess(value: Column) -> Column:
    """Numbers above 9,999,999,999 are milliseconds, others seconds; other texts RFC 3339."""
    guess = lambda n: F.when(n > 9_999_999_999, F.timestamp_millis(n)).when(n.isNotNull(), F.timestamp_seconds(n)).otherwise(iso8601(value))
    return let(lenient_long(value), guess)


def window_minutes(minutes: Column, secs: Column) -> Column:
    """A window parameter: minutes, else seconds rounded up to minutes; 1 at least."""
    return F.greatest(F.coalesce(minutes, F.ceil(secs / 60)), F.lit(1)).cast("bigint")
