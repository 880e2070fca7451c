"""Lists of ids, files and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlstrata.plans.search import limited


def ids(captures: DataFrame) -> DataFrame:
    """Columns rid, ref of all captures: the id map."""
    return captures.where("rid is not null").select("rid", "ref")


def list_ids(captures: DataFrame, limit: int = 0) -> DataFrame:
    return limited(captures.where("rid is not null").select("rid", "filename", "offset").orderBy("rid"), limit)


def list_files(files: DataFrame, limit: int = 0) -> DataFrame:
    return limited(files.orderBy("name"), limit)


def list_reports(reports: DataFrame, limit: int = 0) -> DataFrame:
    """The latest row of each report, by id."""
    columns = [c for c in reports.columns if c != "id"]
    latest = reports.groupBy("id").agg(F.max_by(F.struct(*columns), F.col("end_time")).alias("last"))
    return limited(latest.select("id", *[F.col(f"last.{c}").alias(c) for c in columns]).orderBy("id"), limit)
