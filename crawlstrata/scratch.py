"""The shared folder for intermediate tables, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset (local tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """A path and its file system, as Spark sees them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet below the shared folder and read it again: a cut in the lineage that outlives executors.

    Zstandard, as texts take the most room. The table goes when the application ends, or before by ``drop``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    p, system = hadoop(spark, path)
    system.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Remove tables that ``written`` wrote and nothing reads any more; others are left alone."""
    for t in tables:
        path = getattr(t, "written_at", None)
        if path:
            p, system = hadoop(t.sparkSession, path)
            system.delete(p, True)
