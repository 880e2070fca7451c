"""Output rows and lines of captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a capture, in order.
FIELDS = ("uri", "sha", "dig", "hsc", "mct", "ref", "rid", "cle", "ple", "rle", "rct", "rou", "rod", "roi", "ssu", "sts", "srt")
NUMBERS = ("hsc", "cle", "ple", "rle")
TIMES = ("sts", "rod")
RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _present(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def replay_row(captures: DataFrame) -> DataFrame:
    """Columns urlkey, timestamp, url, mime, status, digest, length; numbers as text; missing ones null."""
    text = lambda c: F.when(F.col(c) != 0, F.col(c).cast("string"))
    return captures.select(
        _present(F.col("ssu")).alias("urlkey"),
        F.col("ts14").alias("timestamp"),
        F.col("uri").alias("url"),
        _present(F.col("mct")).alias("mime"),
        text("hsc").alias("status"),
        F.coalesce(F.col("dig"), F.lit("")).alias("digest"),
        text("rle").alias("length"),
    )


def replay_json(captures: DataFrame, output: str = "") -> DataFrame:
    """Column ``line``: the replay row as JSON, led by key and time unless output is ``json``."""
    row = F.to_json(F.struct("urlkey", "timestamp", "url", "mime", "status", "digest", "length"))
    line = row if output == "json" else F.concat_ws(" ", "urlkey", "timestamp", row)
    return replay_row(captures).select(line.alias("line"))


def _expressions(captures: DataFrame) -> list[Column]:
    out = []
    for c in FIELDS:
        if c not in captures.columns:
            continue
        if c in TIMES:
            value = F.date_format(c, RFC3339)
        elif c in NUMBERS:
            value = F.when(F.col(c) != 0, F.col(c) if c == "hsc" else F.col(c).cast("string"))
        else:
            value = _present(F.col(c))
        out.append(value.alias(c))
    return out


def capture_row(captures: DataFrame) -> DataFrame:
    """All fields of a capture as they go into its JSON: long numbers as text, times in RFC 3339, missing ones null."""
    return captures.select(*_expressions(captures))


def capture_json(captures: DataFrame) -> DataFrame:
    """Column ``line``: a capture as JSON without missing fields."""
    return captures.select(F.to_json(F.struct(*_expressions(captures))).alias("line"))


def cdxj(captures: DataFrame) -> DataFrame:
    """Column ``line``: sortable key, time, record type and JSON of a capture."""
    return captures.select(F.concat_ws(" ", "ssu", "ts14", F.coalesce("srt", F.lit("")), F.to_json(F.struct(*_expressions(captures)))).alias("line"))
