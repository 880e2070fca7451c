"""Tables on disk: which files are new, upserts by key, table of contents, reset."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlstrata.functions.formats import cdxj


def match_files(files: DataFrame, includes: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """Files (name, path) that any include matches (or all, without includes) and no exclude matches, by name or folder."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    keep = F.lit(not includes)
    for x in includes or ():
        keep = keep | F.col("name").rlike(x)
    for x in excludes or ():
        keep = keep & ~F.col("name").rlike(x) & ~folder.rlike(x)
    return files.where(keep)


def new_or_changed(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files whose name, size and time are not in the file table."""
    return files.join(indexed.select("name", "size", "last_modified"), ["name", "size", "last_modified"], "left_anti").select(*files.columns)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: that of the greatest order."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key: that of the greatest order, and among equal ones a new row before an old one."""
    columns = old.columns
    both = old.select("*", F.lit(0).alias("_new")).unionByName(new.select(*columns, F.lit(1).alias("_new")))
    return latest(both, [key], [*order, F.col("_new")]).select(*columns)


def upsert_captures(old: DataFrame, new: DataFrame, max_key_bytes: int | None = None) -> DataFrame:
    """Last write wins by key: the greatest (file time, if there is such a column; file name, offset)."""
    if max_key_bytes:
        new = new.where(F.octet_length("key") <= max_key_bytes)
    order = [F.col(c) for c in ("file_time", "filename", "offset") if c in old.columns]
    return upsert(old, new, "key", order)


def upsert_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, "rid", [F.lit(0)])


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, "name", [F.lit(0)])


def repair_utf8(df: DataFrame, columns: list[str]) -> DataFrame:
    """Binary or string columns as valid UTF-8: bytes that are none are dropped. Only rows that fail the check reach Python."""
    @F.pandas_udf("string")
    def repaired(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    for c in columns:
        raw = F.col(c).cast("binary")
        df = df.withColumn(c, F.when(raw.isNull(), None).otherwise(F.coalesce(F.try_validate_utf8(raw.cast("string")), repaired(raw))))
    return df


def write_captures(captures: DataFrame, path: str, files: int | None = None) -> None:
    """Parquet sorted by key over the whole table, so that readers prune by key. Without ``files``, Spark sizes them by the bytes shuffled."""
    ranged = captures.repartitionByRange(files, "key") if files else captures.repartitionByRange("key")
    ranged.sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def write_cdxj(captures: DataFrame, path: str) -> None:
    cdxj(captures.orderBy("key")).write.mode("overwrite").text(path)


def toc(captures: DataFrame) -> DataFrame:
    """Column host: each host of the captures once."""
    return captures.select(F.concat("host", F.lit("//")).alias("host")).distinct()


def reset(spark: SparkSession, base_path: str, tables: tuple[str, ...] = ("captures", "ids", "files")) -> None:
    """Empty the tables below a path; their schemas stay."""
    for t in tables:
        schema = spark.read.parquet(f"{base_path}/{t}").schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{base_path}/{t}")
