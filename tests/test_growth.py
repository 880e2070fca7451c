"""What must not grow with the tables: rows handed over at once, tables sent through the driver, work done again."""

import gzip

import pyarrow as pa

from crawlstrata.functions.keys import with_keys
from crawlstrata.operators import ranges, report, resolve
from crawlstrata.queries import tables
from crawlstrata.sources import warc

WARC = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {}\r\n\r\n"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_not_broadcast(spark):
    few = spark.createDataFrame([("p",)], "path string")
    records = few.mapInArrow(lambda batches: iter(()), "rid string, headers map<string,string>, block binary, error string")
    resolved = few.mapInArrow(lambda batches: iter(()), "rid string, original string, outcome string")
    assert "Broadcast" not in plan(resolve.merge_revisits(records, resolved))


def test_extracted_records_are_handed_over_in_small_batches(tmp_path, monkeypatch):
    path, offsets = str(tmp_path / "a.warc.gz"), []
    with open(path, "wb") as f:
        for k in range(2500):
            offsets.append(f.tell())
            block = b"x" * (3 << 20) if k == 7 else b"%d" % k
            f.write(gzip.compress(WARC.format(len(block)).encode() + block + b"\r\n\r\n", 1))
    monkeypatch.setattr(warc, "BATCH_BYTES", 1 << 20)
    asked = pa.RecordBatch.from_arrays([pa.array([f"r{k}" for k in range(2500)]), pa.array([path] * 2500), pa.array(offsets)], ["rid", "path", "offset"])
    got = list(warc.placed_records(iter([asked])))
    assert [b.num_rows for b in got] == [8, 1000, 1000, 492]
    blocks = [x for b in got for x in b.column(2).to_pylist()]
    assert blocks == [b"x" * (3 << 20) if k == 7 else b"%d" % k for k in range(2500)]


def counted(spark, rows, schema):
    """The rows, and a counter of how many of them were computed."""
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, schema)
    return df.mapInArrow(pass_on, df.schema), seen


def captures(spark, n=40):
    rows = [(f"r{k}", f"http://h{k % 5}.com/p{k % 7}", 1000 + k, 302 if k % 4 == 0 else 200, "revisit" if k % 4 == 1 else "response", f"http://h{k % 3}.com/p1", None) for k in range(n)]
    df, seen = counted(spark, rows, "rid string, uri string, at long, hsc int, srt string, location string, mct string")
    df = df.selectExpr("*", "timestamp_seconds(at) as sts", "concat('warcfile:f#', at) as ref", "cast(null as string) as roi", "uri as rou", "timestamp_seconds(at) as rod", "1L as cle", "1L as ple", "1L as rle")
    return with_keys(df), seen


def test_reports_compute_captures_once(spark):
    suffixes = spark.createDataFrame([("com",)], "rule string")
    for made in (report.totals, report.report_data):
        held, seen = captures(spark)
        row = made(held, suffixes).first()
        assert (row["records"], row["domains"], row["targets"], row["content_length"]) == (40, 5, 5, 40)
        assert seen.value == 40


def test_targets_compute_captures_once(spark, monkeypatch):
    for query in (tables.targets, tables.targets_by_list):
        held, seen = captures(spark)
        monkeypatch.setattr(tables, "captures", lambda *_, held=held: held)
        assert query(spark, "").count() == 5
        assert seen.value == 40


def test_replay_plan_and_closest_compute_captures_once(spark):
    asked = spark.createDataFrame([(k, f"http://h{k}.com/p1", 1020) for k in range(4)], "request int, url string, at long")
    for made in (resolve.replay_plan, lambda a, c: resolve.closest(resolve.scoped(a), c), lambda a, c: resolve.closest_k(resolve.scoped(a), c, 2)):
        held, seen = captures(spark)
        assert made(asked, held).count() >= 4
        assert seen.value == 40


def test_ranges_do_not_grow_with_the_table(spark):
    parts = ranges.spread_large(spark.range(3000).selectExpr("'hot' as s", "id as t"), ["s"], ["t"], part_rows=100)
    sizes = [r["count"] for r in parts.groupBy(ranges.PART).count().collect()]
    assert len(sizes) >= 25 and max(sizes) <= 250
    assert ranges.dealt(parts, ["s"]).rdd.getNumPartitions() == 30
