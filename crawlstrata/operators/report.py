"""Crawl reports: counts, distinct counts, breakdowns and byte totals of any search result."""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlstrata.functions.keys import mime_group
from crawlstrata.functions.urls import with_target
from crawlstrata.operators import ranges
from crawlstrata.plans.search import SearchRequest, search
from crawlstrata.scratch import written

SUMS = {"content_length": "cle", "payload_length": "ple", "record_length": "rle"}


def scheme() -> Column:
    return F.regexp_extract("psu", "^[^:]*:([^:@]*)", 1)


#: The breakdowns: name -> column expression; a missing value counts as "0" or as empty.
def breakdowns() -> dict[str, Column]:
    return {
        "by_status": F.coalesce(F.col("hsc"), F.lit(0)).cast("string"),
        "by_type": F.coalesce(F.col("srt"), F.lit("")),
        "by_mime": F.coalesce(mime_group("mct"), F.lit("")),
        "by_scheme": scheme(),
    }


def count_by(captures: DataFrame, what: str) -> DataFrame:
    """Columns value, n of one breakdown."""
    return captures.groupBy(breakdowns()[what].alias("value")).agg(F.count("*").alias("n"))


def totals(captures: DataFrame, suffixes: DataFrame) -> DataFrame:
    """One row: records, domains, targets, target_captures, urls and byte sums. Distinct counts come from one pre-aggregation per (host, path)."""
    pages = captures.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in SUMS.items()])
    hosts = pages.groupBy("host").agg(F.sum("n").alias("n"), F.count("*").alias("urls"), F.sum(F.when(F.col("path") == "/", F.col("n")).otherwise(0)).alias("roots"), *[F.sum(k).alias(k) for k in SUMS])
    targets = with_target(written(hosts), suffixes).groupBy("target").agg(F.sum("n").alias("n"), F.sum("urls").alias("urls"), F.sum("roots").alias("roots"), F.count("*").alias("hosts"), *[F.sum(k).alias(k) for k in SUMS])
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return targets.agg(zero("n").alias("records"), zero("hosts").alias("domains"), F.count("*").alias("targets"), zero("roots").alias("target_captures"), zero("urls").alias("urls"), *[zero(k).alias(k) for k in SUMS])


def collapsed_target_captures(captures: DataFrame, seconds: int = 5) -> DataFrame:
    """One row, ``n``: captures of a host's root page, without those within ``seconds`` of the previous one.

    Root pages are put in order by ranges of (host, key); the first one of a range looks back to the last one of an earlier range.
    """
    scope = ["host"]
    roots = ranges.spread(captures.where("path = '/'").select("host", "key", "unix"), scope, ["key"])
    edge = ranges.carried(roots, scope, {"_last": F.max_by("unix", "key")}, {"_earlier": ("_last", "last")})
    behind = roots.withColumn("_behind", F.lag("unix").over(ranges.within(scope).orderBy("key")))
    gap = F.col("unix") - F.coalesce("_behind", "_earlier")
    return ranges.with_carried(behind, edge, scope).select(gap.alias("gap")).agg(F.count(F.when(F.col("gap").isNull() | (F.col("gap") > seconds), 1)).alias("n"))


def report_data(captures: DataFrame, suffixes: DataFrame) -> DataFrame:
    """One row: totals and the four maps.

    Captures are counted once per (host, path, values), so the distinct counts and maps need no further pass over them.
    """
    fine = written(captures.groupBy("host", "path", *[c.alias(k) for k, c in breakdowns().items()]).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in SUMS.values()]))
    maps = [fine.groupBy(F.lit(k).alias("what"), F.col(k).alias("value")).agg(F.sum("n").alias("n")) for k in breakdowns()]
    counts = maps[0]
    for m in maps[1:]:
        counts = counts.unionByName(m)
    entry = F.struct("value", "n")
    joined = counts.agg(*[F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("what") == k, entry)))).alias(k) for k in breakdowns()])
    pages = fine.groupBy("host", "path").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS.values()])
    hosts = pages.groupBy("host").agg(F.sum("n").alias("n"), F.count("*").alias("urls"), F.sum(F.when(F.col("path") == "/", F.col("n")).otherwise(0)).alias("roots"), *[F.sum(c).alias(c) for c in SUMS.values()])
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    whole = with_target(written(hosts), suffixes).agg(zero("n").alias("records"), F.count("*").alias("domains"), F.count_distinct("target").alias("targets"), zero("roots").alias("target_captures"), zero("urls").alias("urls"), *[zero(c).alias(k) for k, c in SUMS.items()])
    return whole.withColumn("_one", F.lit(1)).join(joined.withColumn("_one", F.lit(1)), "_one").drop("_one")


def report(captures: DataFrame, request: SearchRequest, suffixes: DataFrame, id: str | None = None) -> DataFrame:
    """One row: id, times, duration_ms, query, status, error, data. A failing search gives status FAILED and its error."""
    spark = captures.sparkSession
    started = datetime.now(timezone.utc)
    clock = time.monotonic()
    error, data = "", None
    try:
        data = report_data(search(captures, request), suffixes).first()
    except Exception as e:  # the report row tells
        error = str(e)
    query = {k: ",".join(v) if isinstance(v, tuple) else str(v) for k, v in vars(request).items() if v and k != "remap"}
    head = (id or str(uuid.uuid4()), started, datetime.now(timezone.utc), int((time.monotonic() - clock) * 1000), query, "FAILED" if error else "COMPLETED", error)
    maps = "map<string,bigint>"
    numbers = ", ".join(f"{c}: bigint" for c in ("records", "domains", "targets", "target_captures", "urls", *SUMS))
    schema = f"id string, start_time timestamp, end_time timestamp, duration_ms long, query map<string,string>, status string, error string, data struct<{numbers}, {', '.join(f'{k}: {maps}' for k in breakdowns())}>"
    return spark.createDataFrame([(*head, tuple(data) if data else None)], schema)


def save_report(report_row: DataFrame, path: str) -> None:
    report_row.write.mode("append").parquet(path)


def get_report(spark: SparkSession, path: str, id: str) -> DataFrame:
    from crawlstrata.operators.lists import list_reports

    return list_reports(spark.read.parquet(path)).where(F.col("id") == id)


def delete_report(spark: SparkSession, path: str, id: str, target: str) -> None:
    """Write the reports other than ``id`` to ``target``."""
    spark.read.parquet(path).where(F.col("id") != id).write.mode("overwrite").parquet(target)
