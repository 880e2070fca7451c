"""Timestamp columns: 14-digit strings, their prefixes as instants, and widened range ends. UTC throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT = "yyyyMMddHHmmss"
#: What completes a date string of an even length to its first second.
TAIL = "00000101000000"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts14(ts: Column | str) -> Column:
    return F.date_format(_column(ts), FORMAT)


def parse14(text: Column | str) -> Column:
    """Instant of 4, 6, 8, 10, 12 or 14 digits; null for anything else."""
    t = _column(text)
    full = F.concat(t, F.substring(F.lit(TAIL), F.length(t) + 1, F.lit(14)))
    return F.when(t.rlike("^([0-9]{2}){2,7}$"), F.try_to_timestamp(full, F.lit(FORMAT)))


def rfc3339_to14(text: Column | str) -> Column:
    """14 digits of an RFC 3339 date, in UTC; null where it does not parse."""
    t = _column(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), ts14(F.try_to_timestamp(t)))


def range_end(text: Column | str) -> Column:
    """Last second of the year, month, day, hour, minute or second that a date string names, as seconds since 1970."""
    t = _column(text)
    start = parse14(t)
    n = F.length(t)
    zero = F.lit(0)
    span = F.make_interval(
        F.when(n == 4, 1).otherwise(zero),
        F.when(n == 6, 1).otherwise(zero),
        zero,
        F.when(n == 8, 1).otherwise(zero),
        F.when(n == 10, 1).otherwise(zero),
        F.when(n == 12, 1).otherwise(zero),
        F.when(n == 14, 1).otherwise(zero).cast("decimal(18,6)"),
    )
    return F.unix_timestamp(start + span) - 1


def range_start(text: Column | str) -> Column:
    return F.unix_timestamp(parse14(text))
