"""WARC files as a DataFrame: tasks that read files of about equal bytes, and columns from their records.

A file is streamed; offsets are those of the gzip member (or of the plain record), lengths run to the next record or to the
end of the file. A read error ends a file: the records before it stay, and one row tells the error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from crawlstrata.functions.once import once
from crawlstrata.functions.urls import ssurt, url_ok
from crawlstrata.operators import ranges
from crawlstrata.scratch import written
from crawlstrata.shipping import ship
from crawlstrata.sources.files import file_info, file_system

SCHEMA = "path string, filename string, offset long, length long, type string, headers map<string,string>, block binary, error string"
CHUNK = 1 << 20
#: Bytes of files that a task reads, and bytes and rows that it hands over at once.
TASK_BYTES, BATCH_BYTES, BATCH_ROWS = 256 << 20, 16 << 20, 1000
#: So many files, if each has a task of its own, are dealt without ranges.
FEW = 64
#: Bytes that are read at once where single records are looked up.
LOOKUP_CHUNK = 1 << 16


def open_stream(path: str):
    """A readable binary file: a local path or any URI that Arrow's file systems open."""
    system, inner = file_system(path)
    return system.open_input_file(inner)


class _Plain:
    """Bytes of a file with the place of the next one."""

    def __init__(self, f, at: int = 0, chunk: int = CHUNK) -> None:
        self.f, self.buffer, self.at, self.chunk = f, b"", at, chunk

    def fill(self) -> bool:
        more = self.f.read(self.chunk)
        self.buffer += more
        return bool(more)

    def place(self) -> int:
        return self.at

    def take(self, n: int) -> bytes:
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        self.at += len(out)
        return out


class _Gzip(_Plain):
    """The same over gzip members; ``place`` is that of the member in which the next byte lies."""

    def __init__(self, f, at: int = 0, chunk: int = CHUNK) -> None:
        super().__init__(f, chunk=chunk)
        self.raw, self.raw_at = b"", at
        self.member = zlib.decompressobj(31)
        self.starts = [(0, at)]  # (bytes unpacked before, place of the member)
        self.unpacked = 0

    def fill(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.f.read(self.chunk)
                if not self.raw:
                    if self.member.eof or not self.starts or self.starts[-1][0] == self.unpacked:
                        return False
                    raise EOFError("gzip member is cut off")
            if self.member.eof:
                self.member = zlib.decompressobj(31)
                self.starts.append((self.unpacked, self.raw_at))
            before = len(self.raw)
            out = self.member.decompress(self.raw, CHUNK)
            rest = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            self.raw_at += before - len(rest)
            self.raw = rest
            if out:
                self.unpacked += len(out)
                self.buffer += out
                return True

    def place(self) -> int:
        while len(self.starts) > 1 and self.starts[1][0] <= self.at:
            self.starts.pop(0)
        return self.starts[0][1]


@dataclass
class Record:
    offset: int
    type: str
    headers: dict[str, str]
    block: bytes


def _stream(f, offset: int = 0, chunk: int = CHUNK) -> _Plain:
    f.seek(offset)
    magic = f.read(2)
    f.seek(offset)
    return (_Gzip if magic == b"\x1f\x8b" else _Plain)(f, offset, chunk)


def read_records(s: _Plain) -> Iterator[Record]:
    """Records one after the other; ValueError or EOFError where a file is broken."""
    while True:
        while not s.buffer.lstrip(b"\r\n") and s.fill():
            pass
        lead = len(s.buffer) - len(s.buffer.lstrip(b"\r\n"))
        s.take(lead)
        if not s.buffer:
            return
        offset = s.place()
        while (end := s.buffer.find(b"\r\n\r\n")) < 0:
            if not s.fill():
                raise EOFError("record head is cut off")
        head = s.take(end + 4).decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {offset}")
        headers: dict[str, str] = {}
        last = ""
        for line in head[1:]:
            if line[:1] in (" ", "\t") and last:
                headers[last] += " " + line.strip()
            elif ":" in line:
                last, _, value = line.partition(":")
                last = last.strip().lower()
                headers[last] = value.strip()
        size = headers.get("content-length", "0")
        if not size.isdigit():
            yield Record(offset, headers.get("warc-type", ""), headers, b"")
            raise ValueError(f"bad Content-Length at {offset}")
        left, parts = int(size), []
        while left:
            if not s.buffer and not s.fill():
                raise EOFError("record block is cut off")
            piece = s.take(left)
            parts.append(piece)
            left -= len(piece)
        yield Record(offset, headers.get("warc-type", ""), headers, b"".join(parts))


def file_rows(path: str) -> Iterator[tuple]:
    """Rows (SCHEMA) of one file."""
    name = path.rsplit("/", 1)[-1]
    held: Record | None = None
    size, error = 0, None

    def row(r: Record, end: int) -> tuple:
        return (path, name, r.offset, end - r.offset, r.type, r.headers, r.block, None)

    try:
        with open_stream(path) as f:
            size = f.size()
            for record in read_records(_stream(f)):
                if held:
                    yield row(held, record.offset)
                held = record
    except (OSError, ValueError, EOFError, zlib.error) as e:
        error = str(e)
    if held:
        yield row(held, size)
    if error is not None:
        yield (path, name, None, None, None, None, None, error)


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _WarcReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[_Files]:
        return [_Files([p]) for p in self.paths]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from file_rows(path)


class WarcSource(DataSource):
    """Format ``warc`` for a few files, each a partition; the option ``paths`` holds them, one a line."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _WarcReader([p for p in self.options.get("paths", "").split("\n") if p])


def packed(files: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Files (path, size) dealt to tasks of about equal bytes: column ``task``, from 0, and ``tasks``, how many there are.

    Files are put in order by size, the biggest first, and dealt forth and back, so that loads differ by little more than one file.
    A task gets about ``task_bytes``, or less where the cores would not all have work.
    """
    spark = files.sparkSession
    total, n = files.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(n, max(-(-total // task_bytes), spark.sparkContext.defaultParallelism)))
    if n <= min(tasks, FEW):
        return files.select("path", "size", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "path")) - 1).alias("task"), F.lit(tasks).alias("tasks"))
    parts = ranges.spread(files.select("path", (-F.col("size")).alias("_less")), [], ["_less", "path"])
    # One row for each part.
    counts = parts.groupBy(ranges.PART).agg(F.count("*").alias("_n"))
    before = counts.select(ranges.PART, (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(ranges.PART)) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(ranges.PART).orderBy("_less", "path")) - 1
    at = parts.withColumn("_place", place).join(F.broadcast(before), ranges.PART).withColumn("_place", F.col("_place") + F.col("_before"))
    turn, seat = F.floor(F.col("_place") / tasks), F.col("_place") % tasks
    return at.select("path", (-F.col("_less")).alias("size"), F.when(turn % 2 == 0, seat).otherwise(tasks - 1 - seat).cast("int").alias("task"), F.lit(tasks).alias("tasks"))


def read_warc(spark: SparkSession, files: DataFrame | list[str], task_bytes: int = TASK_BYTES) -> DataFrame:
    """All records of the files (paths, or a table with a column path), and a row with ``error`` for each broken or missing file."""
    ship(spark)
    paths = spark.createDataFrame([(p,) for p in files], "path string") if isinstance(files, list) else files.select("path")
    if isinstance(files, list) or "size" not in files.columns:
        known = file_info(paths).select("path", "size").distinct()
        files = paths.join(known, "path", "left").select("path", F.coalesce("size", F.lit(0)).alias("size"))
    dealt = written(packed(files, task_bytes))
    first = dealt.select("tasks").first()
    return read_in_place(dealt.repartitionById(first[0] if first else 1, "task"))


def read_in_place(files: DataFrame) -> DataFrame:
    """All records of the files (column path), as they are dealt: each task reads those of its partition."""
    ship(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in file_rows(path):
                    rows.append(row)
                    size += len(row[6] or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield _rows(rows)
                        rows, size = [], 0
        if rows:
            yield _rows(rows)

    return files.select("path").mapInArrow(read, SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
    columns = list(zip(*rows, strict=True))
    columns[5] = [None if h is None else list(h.items()) for h in columns[5]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f"c{k}" for k in range(len(types))])


def http_records(records: DataFrame) -> DataFrame:
    """Responses and revisits that hold HTTP."""
    kind = F.coalesce(F.col("headers")["content-type"], F.lit(""))
    return records.where(F.col("type").isin("response", "revisit") & kind.startswith("application/http"))


def _http_head(block: Column) -> Column:
    """Head of an HTTP block as text, up to its first blank line, however long; Latin-1, as any byte may stand in it."""
    head = F.substring_index(F.substring_index(block.cast("string"), "\r\n\r\n", 1), "\n\n", 1)
    return F.decode(head.cast("binary"), "ISO-8859-1")


def _http_field(head: Column, name: str) -> Column:
    return F.btrim(F.regexp_extract(head, rf"(?is)(?:^|\n){name}:[ \t]*([^\r\n]*)", 1))


def to_captures(records: DataFrame) -> DataFrame:
    """Capture rows of HTTP records; rows without a valid length, URL or date are dropped, missing fields are null."""
    return records.select(*_capture_columns()).where("cle is not null and ssu is not null and sts is not null")


@once
def _capture_columns() -> list[Column]:
    h = F.col("headers")
    head = _http_head(F.col("block"))
    status = F.regexp_extract(head, r"^HTTP/[0-9.]+[ ]+([0-9]{3})", 1)
    length = _http_field(head, "Content-Length")
    revisit = F.col("type") == "revisit"
    mime = F.nullif(_http_field(head, "Content-Type"), F.lit(""))
    when = lambda name: F.try_to_timestamp(h[name])
    number = lambda c: F.when(c.rlike("^[0-9]{1,18}$"), F.nullif(c.cast("long"), F.lit(0).cast("long")))
    bare = lambda c: F.nullif(F.regexp_replace(c, "^<|>$", ""), F.lit(""))
    uri = bare(h["warc-target-uri"])
    return [
        uri.alias("uri"),
        F.lit(None).cast("string").alias("sha"),
        F.nullif(h["warc-payload-digest"], F.lit("")).alias("dig"),
        F.when(status != "", status.cast("int")).alias("hsc"),
        F.when(revisit, F.coalesce(mime, F.lit("warc/revisit"))).otherwise(mime).alias("mct"),
        F.concat(F.lit("warcfile:"), "filename", F.lit("#"), F.col("offset").cast("string")).alias("ref"),
        bare(h["warc-record-id"]).alias("rid"),
        F.when(h["content-length"].rlike("^[0-9]{1,18}$"), h["content-length"].cast("long")).alias("cle"),
        number(length).alias("ple"),
        F.nullif("length", F.lit(0).cast("long")).alias("rle"),
        F.nullif(h["content-type"], F.lit("")).alias("rct"),
        F.when(revisit, bare(h["warc-refers-to-target-uri"])).alias("rou"),
        F.when(revisit, when("warc-refers-to-date")).alias("rod"),
        F.when(revisit, bare(h["warc-refers-to"])).alias("roi"),
        ssurt(uri).alias("ssu"),
        when("warc-date").alias("sts"),
        F.col("type").alias("srt"),
        F.nullif(_http_field(head, "Location"), F.lit("")).alias("location"),
        url_ok(uri).alias("url_ok"),
    ]


def placed_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns rid, headers, block, error of rows (rid, path, offset), handed over in batches of bounded rows and bytes."""
    types = [pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
    current, f, rows, size = None, None, [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["rid", "headers", "block", "error"])

    try:
        for batch in batches:
            for rid, path, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if path is None or offset is None:
                        raise FileNotFoundError("no file or offset")
                    if path != current:
                        if f:
                            f.close()
                        current, f = path, open_stream(path)
                    record = next(read_records(_stream(f, offset, LOOKUP_CHUNK)))
                    rows.append((rid, list(record.headers.items()), record.block, None))
                    size += len(record.block)
                except StopIteration:
                    rows.append((rid, None, None, "no record at this offset"))
                except (OSError, ValueError, EOFError, zlib.error) as e:
                    rows.append((rid, None, None, str(e)))
                    if isinstance(e, OSError):
                        current = None
                if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield made()
                    rows, size = [], 0
        if rows:
            yield made()
    finally:
        if f:
            f.close()


def extract_records(captures: DataFrame, files: DataFrame) -> DataFrame:
    """Columns rid, headers, block, error of captures (rid, filename, offset), read from their files.

    Captures are brought together by file and sorted by offset, so each file is opened once and read forward.
    """
    ship(captures.sparkSession)
    placed = captures.select("rid", "filename", "offset").join(files.select(F.col("name").alias("filename"), "path"), "filename", "left")
    placed = placed.repartition("path").sortWithinPartitions("path", "offset").select("rid", "path", "offset")
    return placed.mapInArrow(placed_records, "rid string, headers map<string,string>, block binary, error string")
