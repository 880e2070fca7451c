"""Field filters: ``[!][=|~]field:value`` as column predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlstrata.functions.formats import FIELDS, TIMES

#: Names of fields in the replay interface.
REPLAY_NAMES = {"status": "hsc", "mime": "mct", "url": "uri"}


def parse_filter(text: str, remap: dict[str, str] | None = None) -> tuple[str, str, str, bool]:
    """(operator, field, value, inverted); operators are contains, equals and regex."""
    rest, inverted = (text[1:], True) if text[:1] == "!" else (text, False)
    kind = {"=": "equals", "~": "regex"}.get(rest[:1], "contains")
    rest = rest if kind == "contains" else rest[1:]
    field, colon, value = rest.partition(":")
    if not colon or not field:
        raise ValueError(f"a filter must be [!][=|~]field:value, was: {text!r}")
    return kind, (remap or {}).get(field, field), value, inverted


def field_filter(captures: DataFrame, text: str, remap: dict[str, str] | None = None) -> Column:
    """A missing field matches an empty value only. Inversion comes last."""
    kind, field, value, inverted = parse_filter(text, remap)
    if field in TIMES:
        raise ValueError(f"filters on time field {field} are not supported; use a date range")
    missing = F.lit(value == "")
    if field in FIELDS and field in captures.columns:
        c = F.col(field).cast("string")
        hit = {"contains": c.contains(value), "equals": c == value, "regex": c.rlike(value)}[kind]
        found = F.when(c.isNull(), missing).otherwise(hit)
    else:
        found = missing
    return ~found if inverted else found


def all_filters(captures: DataFrame, texts: list[str], remap: dict[str, str] | None = None) -> Column:
    return reduce(lambda a, b: a & b, (field_filter(captures, t, remap) for t in texts), F.lit(True))
