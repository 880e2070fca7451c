"""Registered queries over WARC files and streams. Spark writes the files from ``pages``, in the shared folder."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlstrata.functions.keys import with_keys
from crawlstrata.operators.resolve import merge_revisits, resolve_revisits
from crawlstrata.queries.fixture import captures, over, parts_sql, read
from crawlstrata.scratch import checkpoint_dir
from crawlstrata.shipping import ship
from crawlstrata.sources.files import discover, text_path_stream
from crawlstrata.sources.warc import extract_records, http_records, read_warc, to_captures
from crawlstrata.streaming.index import clear, compact, index_files, load, start_indexing, state, toc_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
DATE = "%Y-%m-%dT%H:%M:%SZ"
WARC = "WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:page-{id}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {url}\r\nContent-Type: {content}\r\nContent-Length: {size}\r\n\r\n"


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


def _revisit(page: int, url: str, block: bytes) -> tuple[str, bytes]:
    """Further header lines and the block of a page's revisit a day later: of even pages it names the record, of odd ones URL and date; of every third one the block is empty."""
    date = (datetime(2024, 1, 1) + timedelta(seconds=page)).strftime(DATE)
    named = f"WARC-Refers-To: <urn:uuid:page-{page}>\r\n" if page % 2 == 0 else f"WARC-Refers-To-Target-URI: {url}\r\nWARC-Refers-To-Date: {date}\r\n"
    return named, b"" if page % 3 == 0 else block[: block.index(b"\r\n\r\n") + 4]


def warc_files(spark: SparkSession, sf_dir: str, per_file: int = 2000, revisits: bool = False) -> list[str]:
    """WARC files with one response for each page, and a request before it that indexing leaves out; a revisit after it if asked for."""
    ship(spark)
    folder = f"{checkpoint_dir(spark)}/warcs-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}")
        system.create_dir(base, recursive=True)
        name = f"pages-{TaskContext.get().partitionId():05d}.warc.gz"
        with system.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in batches:
                for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    body = html.encode()
                    block = HTTP.format(len(body)).encode() + body
                    date = (datetime(2024, 1, 1) + timedelta(seconds=page)).strftime(DATE)
                    asked = f"GET / HTTP/1.1\r\nHost: {url}\r\n\r\n".encode()
                    for kind, content, data in (("request", "application/http; msgtype=request", asked), ("response", "application/http; msgtype=response", block)):
                        head = WARC.format(kind=kind, id=page, date=date, url=url, content=content, size=len(data))
                        out.write(gzip.compress(head.encode() + data + b"\r\n\r\n", 1, mtime=0))
                    if revisits:
                        named, data = _revisit(page, url, block)
                        later = (datetime(2024, 1, 2) + timedelta(seconds=page)).strftime(DATE)
                        head = WARC.format(kind="revisit", id=f"{page}-again", date=later, url=url, content="application/http; msgtype=response", size=len(data))
                        out.write(gzip.compress(head.encode()[:-2] + named.encode() + b"\r\n" + data + b"\r\n\r\n", 1, mtime=0))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["path"])

    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    pages = pages.repartition(max(4, pages.count() // per_file), "page_id").sortWithinPartitions("page_id")
    return sorted(r["path"] for r in pages.mapInArrow(write, "path string").collect())


N = "octet_length(encode(html))"
BLOCK = f"'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || {N} || chr(13) || chr(10) || chr(13) || chr(10) || html"
PAGES = f"""with p as (select *, {parts_sql('url')}, strftime(timestamp '2024-01-01' + to_seconds(page_id), '%Y%m%d%H%M%S') as ts14, {BLOCK} as block from pages),
c as (select 'urn:uuid:page-' || page_id as rid, url as uri, 200 as hsc, 'text/html; charset=utf-8' as mct, cast({N} as bigint) as ple, cast(octet_length(encode(block)) as bigint) as cle,
 host || '//' || psu || path as ssu, ts14, host || path || ' ' || ts14 || ' ' || psu || ' response' as key, md5(block) as digest, page_id from p)
"""


@query("warc_scan", "select 'response' as type, count(*) as n from pages union all select 'request', count(*) from pages")
def warc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(spark, warc_files(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


@query("warc_captures", PAGES + "select rid, uri, hsc, mct, ple, cle, ssu, ts14, key from c")
def warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_keys(to_captures(http_records(read_warc(spark, warc_files(spark, sf_dir)))))
    return rows.select("rid", "uri", "hsc", "mct", "ple", "cle", "ssu", "ts14", "key")


@query("warc_extract", PAGES + "select rid, digest from c")
def warc_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = warc_files(spark, sf_dir)
    rows = with_keys(to_captures(http_records(read_warc(spark, paths))))
    files = discover(spark, [paths[0].rsplit("/", 1)[0]])
    return extract_records(rows, files).select("rid", F.md5("block").alias("digest"))


@query("index_stream", PAGES + "select rid, key from c")
def index_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files' paths as a stream of two batches, the second of which repeats the first."""
    paths = warc_files(spark, sf_dir)
    work = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    for part in (paths[:2], paths):
        spark.createDataFrame([(p,) for p in part], "path string").coalesce(1).write.mode("append").text(f"{work}/inbox")
    start_indexing(text_path_stream(spark, f"{work}/inbox", max_files=1), f"{work}/tables", f"{work}/checkpoint", max_wait=None).awaitTermination()
    return load(spark, f"{work}/tables", "captures").select("rid", "key")


REVISITS = """select 'urn:uuid:page-' || page_id || '-again' as rid, 'urn:uuid:page-' || page_id as original, case when page_id % 2 = 0 then 'urn:uuid:page-' || page_id end as roi,
 case when page_id % 2 = 1 then url end as rou, case when page_id % 2 = 1 then ts14 end as rod, case when page_id % 3 <> 0 then 200 end as hsc,
 case when page_id % 3 = 0 then 'warc/revisit' else 'text/html; charset=utf-8' end as mct, case when page_id % 3 <> 0 then ple end as ple,
 host || path || ' ' || strftime(timestamp '2024-01-02' + to_seconds(page_id), '%Y%m%d%H%M%S') || ' ' || psu || ' revisit' as key, digest
 from (select p.*, c.ple, c.digest from p join c using (page_id))"""


@query("warc_revisits", PAGES + f"select rid, roi, rou, rod, hsc, mct, ple, key from ({REVISITS})")
def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisit records of WARC files as captures."""
    rows = with_keys(to_captures(http_records(read_warc(spark, warc_files(spark, sf_dir, revisits=True))))).where("srt = 'revisit'")
    return rows.select("rid", "roi", "rou", F.date_format("rod", "yyyyMMddHHmmss").alias("rod"), "hsc", "mct", "ple", "key")


@query("replay_merged_revisits", PAGES + f"select rid, original, 'revisit' as kind, digest from ({REVISITS})")
def replay_merged_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit is resolved, both records are read from their files, and the payload is that of the original."""
    paths = warc_files(spark, sf_dir, revisits=True)
    rows = with_keys(to_captures(http_records(read_warc(spark, paths))))
    files = discover(spark, [paths[0].rsplit("/", 1)[0]])
    merged = merge_revisits(extract_records(rows, files), resolve_revisits(rows))
    return merged.select("rid", "original", F.col("headers")["warc-type"].alias("kind"), F.md5("block").alias("digest"))


FILE_COUNT = "greatest(4, (select count(*) from pages) // 2000)"


@query("discover_files", f"select 'pages-' || lpad(cast(i as varchar), 5, '0') || '.warc.gz' as name from range({FILE_COUNT}) r(i)")
def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that are found in a folder, and that all have bytes."""
    return discover(spark, [warc_files(spark, sf_dir)[0].rsplit("/", 1)[0]]).where("size > 0").select("name")


@query("index_batches", PAGES + f"select {FILE_COUNT} as batches, {FILE_COUNT} as files, (select count(distinct key) from c) as captures")
def index_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path a batch, folded after every two batches: how many batches, files and captures the index has."""
    paths = warc_files(spark, sf_dir)
    work = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    # One task writes them all: where there are more tasks than paths the first one has none, and writes an empty file, which the stream takes for a batch.
    spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1).write.option("maxRecordsPerFile", 1).text(f"{work}/inbox")
    start_indexing(text_path_stream(spark, f"{work}/inbox", max_files=1), f"{work}/tables", f"{work}/checkpoint", max_wait=None, compact_after=2).awaitTermination()
    batches = max(state(spark, f"{work}/tables").streams.values()) + 1
    held = load(spark, f"{work}/tables", "captures").agg(F.count("*").alias("captures"))
    files = load(spark, f"{work}/tables", "files").agg(F.count("*").alias("files"))
    return files.crossJoin(held).select(F.lit(batches).cast("long").alias("batches"), "files", "captures")


@query("index_segments", PAGES + "select rid, key from c")
def index_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the files are indexed and folded into segments, then the others, which stay pending: readers merge both."""
    paths = warc_files(spark, sf_dir)
    base = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    index_files(spark, base, paths[::2])
    compact(spark, base, segment_rows=500)
    index_files(spark, base, paths)
    return load(spark, base, "captures").select("rid", "key")


@query("reset_index", PAGES + f"select 'captures' as \"table\", (select count(distinct key) from c) as before, 0 as after union all select 'ids', (select count(*) from c), 0 union all select 'files', {FILE_COUNT}, 0")
def reset_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of an index before and after it is emptied."""
    base = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    index_files(spark, base, warc_files(spark, sf_dir))
    count = lambda t, name: load(spark, base, t).agg(F.lit(t).alias("table"), F.count("*").alias(name))
    tables = ("captures", "ids", "files")
    before = [count(t, "before") for t in tables]
    clear(spark, base)
    both = [b.join(count(t, "after"), "table") for t, b in zip(tables, before, strict=True)]
    return both[0].unionByName(both[1]).unionByName(both[2])


@query("toc_stream", over("select distinct host || '//' as host from cap"))
def toc_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of contents as a stream of captures finds it."""
    work = f"{checkpoint_dir(spark)}/toc-{uuid.uuid4().hex}"
    captures(spark, sf_dir).select("host", "sts").repartition(4, "sts").write.parquet(f"{work}/captures")
    stream = toc_stream(spark.readStream.schema("host string, sts timestamp").option("maxFilesPerTrigger", "2").parquet(f"{work}/captures"))
    stream.writeStream.format("parquet").option("path", f"{work}/hosts").option("checkpointLocation", f"{work}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("host string").parquet(f"{work}/hosts")


