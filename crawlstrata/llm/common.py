"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crawlstrata.scratch import drop, written
from crawlstrata.shipping import ship

__all__ = ["bounded_sample", "drop", "free_names", "id_crc32", "map_arrow", "merged", "stash", "table", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame) -> DataFrame:
    """Write df as Parquet below the shared checkpoint folder and read it again: a cut in the lineage that outlives executors. ``drop`` removes it when nothing reads it any more."""
    return written(df)


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is sorted and merged, and never collected for a broadcast. Spark takes exploded rows, arrays and compressed files for less than they are."""
    return df.hint("merge")


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names with as many leading underscores as none of the columns begins with (whatever its case)."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return [prefix + n for n in names]


def utf8(text: str) -> Column:
    """The bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def id_crc32(id_col: str) -> Column:
    """crc32 of an id written as text, which deals documents into folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow on workers that have this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def bounded_sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    """At most ``size`` rows, those of the least hash of a key: the same at every run, whatever the partitions.

    A filter by hash comes before the sort, so that a task sends little more than its share of the sample.
    """
    total = rows.count()
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    if total > 2 * size:
        rows = rows.where(place < int((1.2 * size + 100) / total * (1 << 30)))
    return rows.orderBy(place, key).limit(size)
