"""Discovery of files, what is known of given ones, and streams of file paths. Folders and files are looked at in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlstrata.scratch import written
from crawlstrata.shipping import ship

FILES = "name string, path string, size long, last_modified timestamp"
#: What a folder holds: name, whether it is a folder, size, and time in microseconds.
Entry = tuple[str, bool, int, int]


def file_system(path: str):
    """Arrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


def _entry(info) -> Entry:
    # Times in whole milliseconds, as file systems of clusters keep them.
    return info.base_name, not info.is_file, info.size or 0, (info.mtime_ns or 0) // 1_000_000 * 1000


def list_folder(path: str) -> list[Entry]:
    """What a folder holds; OSError if it can't be read."""
    from pyarrow import fs

    system, inner = file_system(path)
    return [_entry(x) for x in system.get_file_info(fs.FileSelector(inner))]


def look_at(path: str) -> Entry | None:
    """A file or folder; None if there is none."""
    from pyarrow import fs

    system, inner = file_system(path)
    info = system.get_file_info(inner)
    return None if info.type == fs.FileType.NotFound else _entry(info)


def _batch(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f"c{k}" for k in range(len(types))])


def file_info(paths: DataFrame, missing: bool = False) -> DataFrame:
    """name, path, size and last_modified of the files of a table (column path) that exist; with ``missing`` a row of its path alone for each other one."""
    ship(paths.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [(p, look_at(p) if p else None) for p in batch.column(0).to_pylist()]
            rows = [(x[0], p, x[2], x[3]) if x and not x[1] else (None, p, None, None) for p, x in seen if missing or x and not x[1]]
            yield _batch(rows, [pa.string(), pa.string(), pa.int64(), pa.int64()])

    found = paths.select("path").mapInArrow(look, "name string, path string, size long, us long")
    return found.select("name", "path", "size", F.timestamp_micros("us").alias("last_modified"))


def discover(spark: SparkSession, roots: list[str], max_depth: int = 4, excludes: list[str] | None = None, lister: Callable[[str], list[Entry]] = list_folder) -> DataFrame:
    """Columns name, path, size, last_modified of the files below roots: down to max_depth folders (0: the root's own files).

    Folders are listed in tasks, level by level; one that an exclude matches or that lies too deep is never listed. A root may be a file. Roots
    that don't exist are left out; a folder that can't be read ends its root: what comes before it in the order of names stays.
    """
    ship(spark)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, below, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not below:
                    at = look_at(path)
                    if at is None or not at[1]:
                        yield _batch([(root, "file", at[0], path, at[2], at[3])] if at else [], KINDS)
                        continue
                inner = lambda name: f"{below}/{name}" if below else name  # noqa: E731, B023
                try:
                    rows = [(root, "folder" if folder else "file", inner(name), f"{path}/{name}", size, us) for name, folder, size, us in lister(path)]
                except OSError as e:
                    rows = [(root, "error", below, str(e), None, None)]
                yield _batch(rows, KINDS)

    def open_to(folders: DataFrame) -> DataFrame:
        for x in excludes or ():
            folders = folders.where(~F.col("path").rlike(x))
        return folders.select("root", "below", "path")

    todo = open_to(spark.createDataFrame([(k, "", r.rstrip("/") or "/") for k, r in enumerate(roots)], "root int, below string, path string"))
    seen = None
    for _ in range(max_depth + 1):
        found = written(todo.repartition("path").mapInArrow(level, "root int, kind string, below string, path string, size long, us long"))
        seen = found if seen is None else seen.unionByName(found)
        todo = open_to(found.where("kind = 'folder'"))
        if todo.isEmpty():
            break
    if seen is None:
        return spark.createDataFrame([], FILES)
    parts = F.split("below", "/")
    ended = seen.where("kind = 'error'").groupBy("root").agg(F.min(parts).alias("_end"))
    files = seen.where("kind = 'file'").join(F.broadcast(ended), "root", "left").where(F.col("_end").isNull() | (parts < F.col("_end")))
    return files.select(F.substring_index("path", "/", -1).alias("name"), "path", "size", F.timestamp_micros("us").alias("last_modified")).distinct()


KINDS = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def path_stream(spark: SparkSession, **options: str) -> DataFrame:
    """Stream of paths (column path) from a Kafka topic: values of messages.

    Options: brokers, topic, group_id, min_bytes, max_bytes, max_wait_ms, max_offsets_per_trigger.
    """
    names = {
        "brokers": "kafka.bootstrap.servers",
        "topic": "subscribe",
        "group_id": "kafka.group.id",
        "min_bytes": "kafka.fetch.min.bytes",
        "max_bytes": "kafka.fetch.max.bytes",
        "max_wait_ms": "kafka.fetch.max.wait.ms",
        "max_offsets_per_trigger": "maxOffsetsPerTrigger",
    }
    unknown = options.keys() - names.keys()
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)}")
    return spark.readStream.format("kafka").options(**{names[k]: v for k, v in options.items()}).load().select(F.col("value").cast("string").alias("path"))


def text_path_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Stream of paths from text files that appear in a folder, one path a line."""
    return spark.readStream.option("maxFilesPerTrigger", str(max_files)).text(folder).select(F.btrim("value").alias("path")).where("path <> ''")
