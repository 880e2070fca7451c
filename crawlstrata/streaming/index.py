"""Continuous indexing: a stream of WARC paths into the tables captures, ids and files, and a streaming table of contents.

An index is a folder with a log. A batch writes its captures and its files below a folder of its own and then an entry of the
log, whose number no other writer can take as well: a writer that comes second takes the next number. So writers need no lock, and
none loses a batch. The entry of a stream's batch names it, and a batch that is delivered again changes nothing.

Of each key and file one row is kept, and the last write of a key wins when the table is read. An entry that replaces files hides
their earlier rows, so that rows of other files that had lost their key to them come back.

``compact`` folds batches into segments: sorted files of one key range each, named in a manifest. Only the segments whose range has
new keys (or rows of replaced files) are written again. Readers merge the rows of pending batches with segments by key, and
only where a pending key or a replaced file touches them; without pending batches they read the segments' winning rows as they are.

A stream folds by ``fold``: pending batches become a run, together with the last runs as long as those hold no more batches, and with the segments once
the rest holds as many batches as they do. So a row is written again once for each doubling of the index, not at every fold. Readers take a run as a pending batch.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import uuid
import zlib
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from crawlstrata.functions.keys import with_keys
from crawlstrata.operators import lists, store
from crawlstrata.scratch import drop, hadoop, written
from crawlstrata.sources.files import file_info
from crawlstrata.sources.warc import http_records, read_in_place, read_warc, to_captures

#: Rows of a segment, about.
SEGMENT_ROWS = 1_000_000
#: So many paths of a batch are looked up in one task and in few jobs.
FEW_PATHS = 64
FILES = "name string, path string, size long, last_modified timestamp"
#: So many files of an entry stand in the log itself: name, path, size, time in microseconds, number of the entry. More are a table.
FEW_FILES = 256
#: Batches of so many bytes on disk together become a run in one task.
ONE_TASK = 32 << 20


@dataclass
class State:
    """The index after entry ``number``: the last fold, and the batches that are not in it. A fold holds segments and, after them, runs."""

    number: int = 0
    fold: dict = field(default_factory=dict)
    pending: list[dict] = field(default_factory=list)
    streams: dict[str, int] = field(default_factory=dict)

    @property
    def parts(self) -> list[dict]:
        """What is not in segments: runs and pending batches, the oldest first."""
        return [*self.fold.get("runs", []), *self.pending]


def _local(system, p) -> str | None:
    return p.toUri().getPath() if system.getUri().getScheme() == "file" else None


def publish(spark: SparkSession, base: str, number: int, entry: dict) -> bool:
    """Make an entry the one of its number, whole and at once; False if that number is taken."""
    p, system = hadoop(spark, f"{base}/log/{number:012d}.json")
    text = json.dumps(entry)
    local = _local(system, p)
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        draft = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            f.write(text)
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    draft, _ = hadoop(spark, f"{base}/log/.{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    # Such file systems refuse to rename onto a file.
    done = system.rename(draft, p)
    if not done:
        system.delete(draft, False)
    return done


def _entry(spark: SparkSession, base: str, number: int) -> dict:
    p, system = hadoop(spark, f"{base}/log/{number:012d}.json")
    local = _local(system, p)
    if local:
        with open(local) as f:
            return json.load(f)
    stream = system.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def state(spark: SparkSession, base: str) -> State:
    """The log, read back to the last fold and to the first batch that it leaves out."""
    p, system = hadoop(spark, f"{base}/log")
    if not system.exists(p):
        return State()
    local = _local(system, p)
    if local:
        names = os.listdir(local)
    else:  # one call, however many entries there are
        jvm = spark._jvm
        paths = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(system.listStatus(p))
        names = [x.rsplit("/", 1)[-1] for x in jvm.org.apache.hadoop.util.StringUtils.join("\n", jvm.java.util.Arrays.asList(paths)).split("\n")]
    numbers = sorted((int(n[:12]) for n in names if re.fullmatch(r"[0-9]{12}\.json", n)), reverse=True)
    out = State(max(numbers, default=0))
    for n in numbers:
        if out.fold and n <= out.fold["upto"]:
            break
        entry = _entry(spark, base, n) | {"number": n}
        if entry["kind"] == "fold":
            out.fold = out.fold or entry
        else:
            out.pending.insert(0, entry)
    out.streams = dict(out.fold.get("streams", {}))
    for e in out.pending:
        if e.get("stream"):
            out.streams[e["stream"]] = max(e["batch"], out.streams.get(e["stream"], -1))
    return out


def current(spark: SparkSession, base: str) -> int:
    """Number of the last entry; 0 if there is none."""
    return state(spark, base).number


def _segments(spark: SparkSession, s: State) -> DataFrame | None:
    """The manifest: low (least key), path and rows of each segment."""
    return spark.read.parquet(s.fold["manifest"]) if s.fold.get("manifest") else None


def _segment_rows(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    return spark.read.parquet(*paths) if paths else None


def _part_rows(spark: SparkSession, part: dict) -> DataFrame:
    """Captures of a pending batch or a run, with the number of their entry."""
    reader = spark.read.schema(StructType.fromJson(part["schema"])) if "schema" in part else spark.read
    if "data" in part:
        return reader.parquet(f"{part['data']}/captures").withColumn("_n", F.lit(part["number"]).cast("long"))
    return reader.parquet(part["captures"])


def _listed(spark: SparkSession, rows: list[list]) -> DataFrame:
    """Files that stand in the log, with the number of their entry."""
    made = spark.createDataFrame([tuple(r) for r in rows], "name string, path string, size long, us long, _n long").coalesce(1)
    return made.select("name", "path", "size", F.timestamp_micros("us").alias("last_modified"), "_n")


def _rows_of(part: dict) -> list[list] | None:
    """Files of a fold, a run or a batch that stand in the log; a batch's get its number."""
    rows = part.get("rows")
    return [[*r, part["number"]] for r in rows] if rows and "data" in part else rows


def _newest(entries: list[dict]) -> list[list] | None:
    """One row for each name in a few entries, that of the greatest number; None if some are in tables or they are too many."""
    found: dict[str, list] = {}
    for e in entries:
        rows = _rows_of(e)
        if rows is None:
            return None
        for r in rows:
            if r[0] not in found or r[4] >= found[r[0]][4]:
                found[r[0]] = r
    return list(found.values()) if len(found) <= FEW_FILES else None


def _part_files(spark: SparkSession, part: dict) -> DataFrame:
    """Files of a pending batch or a run, with the number of their entry."""
    if part.get("rows") is not None:
        return _listed(spark, _rows_of(part))
    if "data" in part:
        return spark.read.schema(FILES).parquet(f"{part['data']}/files").withColumn("_n", F.lit(part["number"]).cast("long"))
    return spark.read.schema(f"{FILES}, _n long").parquet(part["files"])


def _part_gone(spark: SparkSession, part: dict) -> DataFrame | None:
    """Files that a pending batch or a run replaced (filename, _gone: the entry before which their rows go)."""
    if "data" in part:
        return _part_files(spark, part).select(F.col("name").alias("filename"), F.col("_n").alias("_gone")) if part["replace"] else None
    return spark.read.schema("filename string, _gone long").parquet(part["gone"]) if part["gone"] else None


def _union(tables: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, tables) if tables else None


def _pending(spark: SparkSession, parts: list[dict]) -> tuple[DataFrame | None, DataFrame | None]:
    """Captures of pending batches and runs, and the files that they replaced."""
    gone = _union([g for part in parts if (g := _part_gone(spark, part)) is not None])
    return _union([_part_rows(spark, part) for part in parts]), gone and gone.groupBy("filename").agg(F.max("_gone").alias("_gone"))


def _alive(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    if gone is None:
        return rows
    return rows.join(gone, "filename", "left").where(F.col("_gone").isNull() | (F.col("_n") >= F.col("_gone"))).drop("_gone")


#: The order of writes of a key, and the order of rows of a key in one file.
WRITES = ("file_time", "filename", "offset", "_n")
IN_FILE = ("file_time", "offset", "_n")


def _all_files(spark: SparkSession, s: State) -> DataFrame:
    """Files of the fold and after it, with the number of their entry (0: of the fold's own)."""
    return _union(_held_files(spark, s) + [_part_files(spark, part) for part in s.parts])


def _held_files(spark: SparkSession, s: State) -> list[DataFrame]:
    if s.fold.get("rows") is not None:
        return [_listed(spark, s.fold["rows"])]
    return [spark.read.schema(FILES).parquet(s.fold["files"]).withColumn("_n", F.lit(0).cast("long"))] if s.fold.get("files") else []


def _few(asked: DataFrame, includes: list[str] | None, excludes: list[str] | None) -> list[list] | None:
    """Files (name, path, size, time in microseconds) of a few paths that exist and match, one of each name, looked at in one job; None if there are more paths."""
    at = F.unix_micros("last_modified").alias("us")
    seen = file_info(asked.limit(FEW_PATHS + 1), missing=True).select("name", "path", "size", at).collect()
    if len(seen) > FEW_PATHS:
        return None
    seen = [r for r in seen if r["name"] is not None]
    if seen and (includes or excludes):
        seen = store.match_files(asked.sparkSession.createDataFrame(seen, "name string, path string, size long, us long"), includes, excludes).collect()
    last: dict[str, list] = {}
    for r in seen:
        if r["name"] not in last or (r["us"], r["path"]) > (last[r["name"]][3], last[r["name"]][1]):
            last[r["name"]] = list(r)
    return list(last.values())


def _unknown(spark: SparkSession, s: State, few: list[list]) -> list[list]:
    """Those of a few files that are new or changed. Entries whose files are in tables are asked for these names only, in one job."""
    entries = ([s.fold] if s.fold.get("rows") is not None else []) + [part for part in s.parts if part.get("rows") is not None]
    known = [(r[0], r[4], r[2], r[3]) for e in entries for r in _rows_of(e)]
    tables = ([] if s.fold.get("rows") is not None else _held_files(spark, s)) + [_part_files(spark, part) for part in s.parts if part.get("rows") is None]
    if tables and few:
        names = F.col("name").isin([r[0] for r in few])
        known += [tuple(r) for r in _union([t.where(names) for t in tables]).select("name", "_n", "size", F.unix_micros("last_modified")).coalesce(1).collect()]
    last: dict[str, tuple] = {}
    for r in known:
        if r[0] not in last or r[1] >= last[r[0]][1]:
            last[r[0]] = r
    return [r for r in few if r[0] not in last or last[r[0]][2:] != (r[2], r[3])]


def _bytes(spark: SparkSession, path: str) -> int:
    p, system = hadoop(spark, path)
    return system.getContentSummary(p).getLength()


def load(spark: SparkSession, base: str, table: str) -> DataFrame | None:
    """The table captures, ids or files as of now; None before the first batch."""
    s = state(spark, base)
    if not s.number:
        return None
    if table == "files":
        return store.latest(_all_files(spark, s), ["name"], [F.col("_n")]).drop("_n")
    manifest = _segments(spark, s)
    held = _segment_rows(spark, [r["path"] for r in manifest.collect()] if manifest else [])
    new, gone = _pending(spark, s.parts)
    if new is None:
        if held is None:
            return spark.read.parquet(s.fold["empty"]) if table == "captures" else lists.ids(spark.read.parquet(s.fold["empty"]))
        rows = held.where("_wins")
    elif held is None:
        rows = store.latest(_alive(new, gone), ["key"], [F.col(c) for c in WRITES])
    else:
        touched = new.select("key")
        if gone is not None:
            touched = touched.union(held.join(gone, "filename", "left_semi").select("key"))
        touched = touched.distinct()
        calm = held.where("_wins").drop("_wins").join(touched, "key", "left_anti")
        other = held.drop("_wins").join(touched, "key", "left_semi")
        rows = calm.unionByName(store.latest(_alive(other.unionByName(new), gone), ["key"], [F.col(c) for c in WRITES]))
    rows = rows.drop("_n", "_wins")
    return lists.ids(rows) if table == "ids" else rows


def _finder(lows: list[str]):
    """A column function: the segment of a key, by the least keys of all segments."""

    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: max(0, bisect.bisect_right(lows, k) - 1)).astype("int32")

    return find


def compact(spark: SparkSession, base: str, segment_rows: int = SEGMENT_ROWS) -> int:
    """Fold runs and pending batches into the segments that they touch; the number of old segments written again (0 too if there is nothing to do).

    The manifest has one row for each segment, that is one for about ``segment_rows`` captures, and passes through the driver.
    """
    s = state(spark, base)
    if not s.parts:
        return 0
    new, gone = _pending(spark, s.parts)
    known = _segments(spark, s)
    old = sorted((r["low"], r["path"], r["rows"]) for r in known.collect()) if known else []
    of = _finder([low for low, *_ in old])("key")
    columns = new.columns
    touched: list[int] = []
    if old:
        asked = new.select(of.alias("segment"))
        if gone is not None:
            held = _segment_rows(spark, [p for _, p, _ in old])
            asked = asked.union(held.join(gone, "filename", "left_semi").select(of.alias("segment")))
        touched = sorted(r["segment"] for r in asked.distinct().collect())
    held = _segment_rows(spark, [old[k][1] for k in touched])
    both = new if held is None else held.select(*columns).unionByName(new)
    kept = store.latest(_alive(both, gone), ["key", "filename"], [F.col(c) for c in IN_FILE])
    last = Window.partitionBy("key").orderBy(*[F.desc(c) for c in WRITES])
    kept = written(kept.withColumn("_wins", F.row_number().over(last) == 1).withColumn("segment", of))
    data = f"{base}/data/{uuid.uuid4().hex}"
    parts = max(1, -(-kept.count() // segment_rows))
    kept.repartitionByRange(parts, "segment", "key").sortWithinPartitions("segment", "key").write.partitionBy("segment").parquet(f"{data}/segments")
    drop(kept)
    fresh = spark.read.schema("key string").parquet(f"{data}/segments").groupBy(F.input_file_name().alias("path")).agg(F.min("key").alias("low"), F.count("*").alias("rows")).select("low", "path", "rows")
    calm = spark.createDataFrame([x for k, x in enumerate(old) if k not in set(touched)], "low string, path string, rows long")
    calm.unionByName(fresh).coalesce(1).write.parquet(f"{data}/manifest")
    some = spark.read.parquet(f"{data}/manifest").isEmpty()
    new.drop("_n").limit(0).write.parquet(f"{data}/empty")
    files = _newest(([s.fold] if s.fold.get("rows") is not None or s.fold.get("files") else []) + s.parts)
    if files is None:
        store.latest(_all_files(spark, s), ["name"], [F.col("_n")]).drop("_n").write.parquet(f"{data}/files")
    batches = s.fold.get("batches", 0) + sum(part.get("batches", 1) for part in s.parts)
    entry = {"manifest": None if some else f"{data}/manifest", "empty": f"{data}/empty", "files": f"{data}/files" if files is None else None, "rows": files and [[*r[:4], 0] for r in files], "batches": batches}
    return len(touched) if _publish_fold(spark, base, s, entry, data) else 0


def _publish_fold(spark: SparkSession, base: str, s: State, entry: dict, data: str) -> bool:
    """Make a fold of all pending batches of a state the index's; False if another fold was first."""
    entry = entry | {"kind": "fold", "upto": s.pending[-1]["number"] if s.pending else s.fold["upto"], "streams": s.streams}
    number = s.number + 1
    while not publish(spark, base, number, entry):
        now = state(spark, base)
        if now.fold != s.fold:  # this one's tables are of no use
            p, system = hadoop(spark, data)
            system.delete(p, True)
            return False
        number = now.number + 1
    return True


def fold(spark: SparkSession, base: str, segment_rows: int = SEGMENT_ROWS) -> None:
    """Fold pending batches into a run, together with the last runs that hold no more batches than what comes after them; into segments (``compact``) once they hold as many batches as those."""
    s = state(spark, base)
    if not s.pending:
        return
    runs, taken, batches = list(s.fold.get("runs", [])), list(s.pending), len(s.pending)
    while runs and runs[-1]["batches"] <= batches:
        taken.insert(0, runs.pop())
        batches += taken[0]["batches"]
    if not runs and s.fold.get("batches", 0) <= batches:
        compact(spark, base, segment_rows)
        return
    data = f"{base}/data/{uuid.uuid4().hex}"
    new, gone = _pending(spark, taken)
    # Rows of one key and file may go, as all entries that could hide one of them and not the other are in this run.
    small = sum(part.get("bytes", ONE_TASK + 1) for part in taken) <= ONE_TASK
    rows = _alive(new, gone)
    kept = store.latest(rows.coalesce(1) if small else rows, ["key", "filename"], [F.col(c) for c in IN_FILE])
    if small:
        kept.sortWithinPartitions("key").write.parquet(f"{data}/captures")
    else:
        store.write_captures(kept, f"{data}/captures")
    files = _newest(taken)
    if files is None:
        store.latest(_union([_part_files(spark, part) for part in taken]), ["name"], [F.col("_n")]).write.parquet(f"{data}/files")
    if gone is not None:
        gone.write.parquet(f"{data}/gone")
    run = {"captures": f"{data}/captures", "files": f"{data}/files" if files is None else None, "rows": files, "bytes": _bytes(spark, f"{data}/captures"), "gone": f"{data}/gone" if gone is not None else None, "schema": kept.schema.jsonValue(), "batches": batches}
    _publish_fold(spark, base, s, {k: v for k, v in s.fold.items() if k != "number"} | {"runs": [*runs, run]}, data)


def clear(spark: SparkSession, base: str) -> None:
    """Empty the index: captures, ids and files of all entries so far. Their tables stay on disk."""
    s = state(spark, base)
    if not s.number:
        return
    data = f"{base}/data/{uuid.uuid4().hex}"
    for t in ("captures", "files"):
        load(spark, base, t).limit(0).write.parquet(f"{data}/{'empty' if t == 'captures' else t}")
    entry = {"kind": "fold", "upto": s.number, "manifest": None, "empty": f"{data}/empty", "files": f"{data}/files", "streams": s.streams}
    number = s.number + 1
    while not publish(spark, base, number, entry):
        number = current(spark, base) + 1


def index_files(spark: SparkSession, base: str, paths: DataFrame | list[str], includes: list[str] | None = None, excludes: list[str] | None = None, max_key_bytes: int | None = None, replace_file: bool = False, stream: str | None = None, batch: int = 0) -> int:
    """Index the files (paths, or a table with a column path) that are new or changed; the number of them.

    With ``replace_file`` what a changed file held before goes. ``stream`` and ``batch`` name a batch that may be delivered again.
    """
    s = state(spark, base)
    if stream and s.streams.get(stream, -1) >= batch:
        return 0
    data = f"{base}/data/{uuid.uuid4().hex}"
    asked = spark.createDataFrame([(p,) for p in paths], "path string") if isinstance(paths, list) else paths.select("path")
    few = _few(asked, includes, excludes)
    if few is not None:
        few = _unknown(spark, s, few) if s.number else few
        n = len(few)
        if not n:
            return 0
        fresh = _listed(spark, [[*r, 0] for r in few]).drop("_n")
    else:
        files = store.match_files(file_info(asked.distinct()), includes, excludes)
        files = store.latest(files, ["name"], [F.col("last_modified"), F.col("path")])
        if s.number:
            files = store.new_or_changed(files, store.latest(_all_files(spark, s), ["name"], [F.col("_n")]))
        files.write.parquet(f"{data}/files")
        fresh = spark.read.schema(FILES).parquet(f"{data}/files")
        n = fresh.count()
        if not n:
            p, system = hadoop(spark, data)
            system.delete(p, True)
            return 0
    # One file is read by one task, which may as well put its captures in order.
    records = read_in_place(fresh.coalesce(1)) if n == 1 else read_warc(spark, fresh)
    rows = with_keys(to_captures(http_records(records)))
    if few is not None:
        # A map is looked up without a join, which would have Spark plan anew for each batch, and without other code for other times.
        times = F.create_map(*[F.lit(x).cast(kind) for r in few for x, kind in ((r[0], "string"), (r[3], "long"))])
        rows = rows.withColumn("file_time", F.timestamp_micros(F.element_at(times, F.col("filename"))))
    else:
        rows = rows.join(fresh.select(F.col("name").alias("filename"), F.col("last_modified").alias("file_time")), "filename")
    if max_key_bytes:
        rows = rows.where(F.octet_length("key") <= max_key_bytes)
    rows = store.latest(rows, ["key", "filename"], [F.col("offset")])
    if n == 1:
        rows.sortWithinPartitions("key").write.parquet(f"{data}/captures")
    else:
        store.write_captures(rows, f"{data}/captures")
    entry = {"kind": "batch", "data": data, "replace": replace_file, "stream": stream, "batch": batch, "schema": rows.schema.jsonValue(), "bytes": _bytes(spark, f"{data}/captures")}
    if few is not None:
        entry["rows"] = few
    number = s.number + 1
    while not publish(spark, base, number, entry):
        s = state(spark, base)
        if stream and s.streams.get(stream, -1) >= batch:
            return 0
        number = s.number + 1
    return n


def start_indexing(paths: DataFrame, base: str, checkpoint: str, max_wait: str | None = "5 seconds", compact_after: int = 16, **options) -> StreamingQuery:
    """Index a stream of paths batch by batch; without max_wait what is available, and then stop. ``compact_after`` pending batches are folded.

    The size of a batch is set where the stream is read (maxFilesPerTrigger, maxOffsetsPerTrigger). Its batches are known by the checkpoint's path.
    """
    stream = f"{zlib.crc32(checkpoint.encode()):08x}-{checkpoint}"

    def index(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        index_files(spark, base, df, stream=stream, batch=batch, **options)
        if len(state(spark, base).pending) >= compact_after:
            fold(spark, base)

    writer = paths.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=max_wait) if max_wait else writer.trigger(availableNow=True)
    return writer.start()


def toc_stream(captures: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each host when it is first seen. With an event time column, state older than ``delay`` is forgotten."""
    hosts = captures.select(F.concat("host", F.lit("//")).alias("host"), *([event_time] if event_time else []))
    if event_time:
        return hosts.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["host"]).select("host")
    return hosts.dropDuplicates(["host"])
