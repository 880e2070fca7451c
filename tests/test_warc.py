import gzip

import pytest

from crawlstrata.operators import resolve
from crawlstrata.operators.store import reset
from crawlstrata.sources.files import discover, path_stream, text_path_stream
from crawlstrata.sources.warc import extract_records, http_records, read_warc, to_captures
from crawlstrata.streaming.index import compact, index_files, load, start_indexing, toc_stream


def record(kind, block, rid, uri="http://example.com/", date="2020-04-01T22:22:00Z", content="application/http; msgtype=response", extra=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{rid}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {uri}\r\nContent-Type: {content}\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 5\r\n\r\nhello"
RECORDS = [
    record("warcinfo", b"software: x\r\n", "info", content="application/warc-fields"),
    record("response", HTTP, "r1", extra="WARC-Payload-Digest: sha1:ABC\r\n"),
    record("response", b"HTTP/1.1 302 Found\r\nLocation: /next\r\n\r\n", "r2", uri="http://example.com/old"),
    record("request", b"GET / HTTP/1.1\r\n\r\n", "q", content="application/http; msgtype=request"),
    record("response", b"1.2.3.4", "dns", uri="dns:example.com", content="text/dns"),
    record("revisit", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n", "v1", extra="WARC-Refers-To: <urn:uuid:r1>\r\n", date="2020-04-02T00:00:00Z"),
    record("revisit", b"", "v2", extra="WARC-Refers-To-Target-URI: http://example.com/\r\nWARC-Refers-To-Date: 2020-04-01T22:22:00Z\r\n", date="2020-04-03T00:00:00Z"),
    record("response", HTTP, "bad", date="yesterday"),
]


@pytest.fixture(scope="module")
def warcs(tmp_path_factory):
    d = tmp_path_factory.mktemp("warcs")
    (d / "plain.warc").write_bytes(b"".join(RECORDS))
    (d / "packed.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in RECORDS))
    (d / "cut.warc").write_bytes(b"".join(RECORDS[:3]) + RECORDS[5][:-30])
    (d / "cut.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in RECORDS[:2]) + gzip.compress(RECORDS[2])[:60])
    (d / "empty.warc").write_bytes(b"")
    return d


@pytest.mark.parametrize("name,pack", [("plain.warc", lambda b: b), ("packed.warc.gz", gzip.compress)])
def test_read(spark, warcs, name, pack):
    rows = read_warc(spark, [str(warcs / name)]).orderBy("offset").collect()
    sizes = [len(pack(r)) for r in RECORDS]
    assert [r["offset"] for r in rows] == [sum(sizes[:k]) for k in range(len(sizes))]
    assert [r["length"] for r in rows] == sizes
    assert rows[1]["block"] == HTTP and rows[1]["headers"]["warc-record-id"] == "<urn:uuid:r1>"
    assert all(r["error"] is None for r in rows)


def test_broken(spark, warcs):
    rows = read_warc(spark, [str(warcs / n) for n in ("cut.warc", "cut.warc.gz", "empty.warc")]).collect()
    assert sorted((r["filename"], r["error"] is not None) for r in rows) == [("cut.warc", False)] * 3 + [("cut.warc", True)] + [("cut.warc.gz", False)] * 2 + [("cut.warc.gz", True)]


def test_captures(spark, warcs):
    records = http_records(read_warc(spark, [str(warcs / "packed.warc.gz")]))
    rows = {r["rid"].split(":")[-1]: r for r in to_captures(records).collect()}
    assert set(rows) == {"r1", "r2", "v1", "v2"}
    a = rows["r1"]
    assert (a["hsc"], a["mct"], a["ple"], a["dig"], a["srt"], a["ssu"]) == (200, "text/html; charset=utf-8", 5, "sha1:ABC", "response", "com,example,//:http:/")
    assert (rows["r2"]["hsc"], rows["r2"]["location"], rows["r2"]["ple"]) == (302, "/next", None)
    assert (rows["v1"]["roi"], rows["v1"]["mct"]) == ("urn:uuid:r1", "text/html")
    assert (rows["v2"]["rou"], rows["v2"]["mct"], rows["v2"]["hsc"]) == ("http://example.com/", "warc/revisit", None)


def test_extract_and_merge(spark, warcs):
    files = discover(spark, [str(warcs)])
    for name in ("plain.warc", "packed.warc.gz"):
        cap = to_captures(http_records(read_warc(spark, [str(warcs / name)]))).selectExpr("rid", "regexp_extract(ref, ':(.*)#', 1) as filename", "cast(regexp_extract(ref, '#(.*)', 1) as long) as offset")
        got = {r["rid"].split(":")[-1]: r for r in extract_records(cap, files).collect()}
        assert got["r1"]["block"] == HTTP and len(got) == 4 and all(r["error"] is None for r in got.values())
    lost = spark.createDataFrame([("x", "none.warc", 0), ("y", "plain.warc", 3)], "rid string, filename string, offset long")
    assert all(r["error"] for r in extract_records(lost, files).collect())
    records = spark.createDataFrame([("v", {"a": "revisit"}, b""), ("o", {"a": "original"}, b"payload")], "rid string, headers map<string,string>, block binary")
    pairs = spark.createDataFrame([("v", "o", "ok")], "rid string, original string, outcome string")
    merged = resolve.merge_revisits(records, pairs).first()
    assert merged["headers"] == {"a": "revisit"} and merged["block"] == b"payload"


def test_discover(spark, tmp_path):
    for p in ("a.warc", "x/b.warc", "x/y/c.warc", "skip/d.warc"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"1")
    names = lambda **k: sorted(r["name"] for r in discover(spark, [str(tmp_path), str(tmp_path / "missing")], **k).collect())
    assert names() == ["a.warc", "b.warc", "c.warc", "d.warc"]
    assert names(max_depth=1, excludes=["skip"]) == ["a.warc", "b.warc"]


def test_kafka_options(spark):
    with pytest.raises(ValueError):
        path_stream(spark, nonsense="1")


def test_index_stream(spark, warcs, tmp_path):
    base, inbox = str(tmp_path / "base"), tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "1.txt").write_text(f"{warcs / 'plain.warc'}\n{warcs / 'missing.warc'}\n")

    def run():
        start_indexing(text_path_stream(spark, str(inbox)), base, str(tmp_path / "cp"), max_wait=None).awaitTermination()

    run()
    assert load(spark, base, "captures").count() == 4 and load(spark, base, "ids").count() == 4
    (inbox / "2.txt").write_text(f"{warcs / 'plain.warc'}\n")
    run()
    assert load(spark, base, "files").count() == 1
    (inbox / "3.txt").write_text(f"{warcs / 'packed.warc.gz'}\n")
    run()
    # The same captures again: keys are replaced by those of the later file.
    assert load(spark, base, "captures").count() == 4
    assert load(spark, base, "files").count() == 2
    assert index_files(spark, base, [str(warcs / "packed.warc.gz")]) == 0
    before = sorted((r["key"], r["ref"]) for r in load(spark, base, "captures").collect())
    compact(spark, base)
    compact(spark, base)
    assert sorted((r["key"], r["ref"]) for r in load(spark, base, "captures").collect()) == before
    (tmp_path / "plain.warc").write_bytes(RECORDS[1])
    assert index_files(spark, base, [str(tmp_path / "plain.warc")], replace_file=True) == 1
    assert load(spark, base, "captures").count() == 4 and load(spark, base, "files").count() == 2
    path = str(tmp_path / "toc")
    load(spark, base, "captures").select("host", "sts").write.parquet(path)
    out = toc_stream(spark.readStream.schema("host string, sts timestamp").parquet(path)).writeStream.format("memory").queryName("toc_out").trigger(availableNow=True).start()
    out.awaitTermination()
    assert [r["host"] for r in spark.sql("select * from toc_out").collect()] == ["com,example,//"]


def test_reset(spark, tmp_path):
    for t in ("captures", "ids", "files"):
        spark.range(3).write.parquet(f"{tmp_path}/{t}")
    reset(spark, str(tmp_path))
    assert all(spark.read.parquet(f"{tmp_path}/{t}").count() == 0 for t in ("captures", "ids", "files"))


def test_long_http_head(spark):
    """A head of 100 KB is read whole; a head without an end is the whole block; bytes that are no text do no harm."""
    from crawlstrata.sources.warc import to_captures

    long = b"HTTP/1.1 302 Found\r\nX-Pad: " + b"\xff" * 100_000 + b"\r\nContent-Type: text/plain\r\nContent-Length: 12\r\nLocation: /there\r\n\r\nContent-Type: no\r\n\r\n"
    head = {"warc-target-uri": "http://pear.net/", "warc-date": "2023-05-16T00:00:00Z", "content-length": "5", "content-type": "application/http", "warc-record-id": "<urn:x>"}
    rows = [("response", head, long, "f", 0, 9), ("response", head, b"HTTP/1.0 200 OK\nContent-Type: a/b", "f", 9, 9), ("response", head, b"HTTP/1.0 200 OK\nContent-Type: a/b\n\nContent-Length: 3\r\n\r\n", "f", 18, 9)]
    df = spark.createDataFrame(rows, "type string, headers map<string,string>, block binary, filename string, offset long, length long")
    got = {r["ref"]: (r["hsc"], r["mct"], r["ple"], r["location"]) for r in to_captures(df).collect()}
    assert got == {"warcfile:f#0": (302, "text/plain", 12, "/there"), "warcfile:f#9": (200, "a/b", None, None), "warcfile:f#18": (200, "a/b", None, None)}
