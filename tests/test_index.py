import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from crawlstrata.streaming import index
from crawlstrata.streaming.index import clear, compact, current, fold, index_files, load, publish, start_indexing, state

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: 2\r\n\r\nok"


def warc(path, captures, when=1_600_000_000):
    """A WARC file of captures (record id, path of the URL, day of January 2024), with a fixed time."""
    out = b""
    for rid, at, day in captures:
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{rid}>\r\nWARC-Date: 2024-01-{day:02}T00:00:00Z\r\nWARC-Target-URI: http://pear.net/{at}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(HTTP)}\r\n\r\n"
        out += head.encode() + HTTP + b"\r\n\r\n"
    path.write_bytes(out)
    os.utime(path, (when, when))
    return str(path)


def held(spark, base, table="captures"):
    rows = load(spark, str(base), table)
    if table == "captures":
        return sorted((r["path"], r["rid"].removeprefix("urn:"), r["filename"]) for r in rows.collect())
    return sorted(r[0] for r in rows.collect())


@pytest.mark.parametrize("fold", [False, True])
def test_rows_of_other_files_come_back(spark, tmp_path, fold):
    """Two files of equal time hold the same keys; when the one that had won is replaced by less, the other's rows stand again."""
    base, both = str(tmp_path / "base"), [("1", "a", 1), ("2", "b", 1), ("3", "c", 1)]
    first = warc(tmp_path / "a.warc", [(f"a{i}", p, d) for i, p, d in both])
    second = warc(tmp_path / "b.warc", [(f"b{i}", p, d) for i, p, d in both])
    assert index_files(spark, base, [first, second]) == 2
    assert held(spark, base) == [("/a", "b1", "b.warc"), ("/b", "b2", "b.warc"), ("/c", "b3", "b.warc")]
    if fold:
        compact(spark, base, segment_rows=2)
    warc(tmp_path / "b.warc", [("b2", "b", 1)])
    assert index_files(spark, base, [second], replace_file=True) == 1
    want = [("/a", "a1", "a.warc"), ("/b", "b2", "b.warc"), ("/c", "a3", "a.warc")]
    assert held(spark, base) == want
    compact(spark, base, segment_rows=2)
    assert held(spark, base) == want and state(spark, base).pending == []
    assert held(spark, base, "ids") == ["urn:a1", "urn:a3", "urn:b2"] and held(spark, base, "files") == ["a.warc", "b.warc"]


def test_changed_file_without_replacing_keeps_what_it_had(spark, tmp_path):
    base, path = str(tmp_path / "base"), tmp_path / "a.warc"
    index_files(spark, base, [warc(path, [("1", "a", 1), ("2", "b", 1)])])
    index_files(spark, base, [warc(path, [("9", "a", 1)], when=1_700_000_000)])
    assert held(spark, base) == [("/a", "9", "a.warc"), ("/b", "2", "a.warc")]
    # The write of an older file comes too late for keys of a newer one.
    index_files(spark, base, [warc(tmp_path / "old.warc", [("0", "a", 1), ("4", "d", 1)], when=1_000_000_000)])
    assert held(spark, base) == [("/a", "9", "a.warc"), ("/b", "2", "a.warc"), ("/d", "4", "old.warc")]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """Both read the same log and ask for the same number; the second takes the next one."""
    base = str(tmp_path / "base")
    paths = [warc(tmp_path / f"{k}.warc", [(f"r{k}", f"p{k}", 1)]) for k in range(2)]
    wait, real = threading.Barrier(2), index.publish
    first_try = set()

    def together(spark, base, number, entry):
        if threading.get_ident() not in first_try:
            first_try.add(threading.get_ident())
            wait.wait(timeout=120)
        return real(spark, base, number, entry)

    monkeypatch.setattr(index, "publish", together)
    threads = [threading.Thread(target=index_files, args=(spark, base, [p])) for p in paths]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert current(spark, base) == 2
    assert held(spark, base) == [("/p0", "r0", "0.warc"), ("/p1", "r1", "1.warc")] and held(spark, base, "files") == ["0.warc", "1.warc"]


def test_a_number_is_taken_once(spark, tmp_path):
    base, won = str(tmp_path), []
    threads = [threading.Thread(target=lambda k=k: won.append(publish(spark, base, 1, {"k": k}))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 7 + [True]
    assert [n for n in os.listdir(tmp_path / "log") if not n.startswith(".")] == ["000000000001.json"]
    assert json.loads((tmp_path / "log" / "000000000001.json").read_text())["k"] in range(8)


def test_batch_delivered_again_after_its_entry(spark, tmp_path):
    """A stream that stops between the entry and its own checkpoint delivers the batch again, even if the file has changed since."""
    base = str(tmp_path / "base")
    path = warc(tmp_path / "a.warc", [("1", "a", 1)])
    assert index_files(spark, base, [path], stream="s", batch=4) == 1
    warc(tmp_path / "a.warc", [("2", "b", 1)], when=1_700_000_000)
    assert index_files(spark, base, [path], stream="s", batch=4) == 0
    compact(spark, base)
    assert index_files(spark, base, [path], stream="s", batch=3) == 0 and held(spark, base) == [("/a", "1", "a.warc")]
    assert index_files(spark, base, [path], stream="s", batch=5) == 1 and index_files(spark, base, [path], stream="other", batch=0) == 0


def test_only_touched_segments_are_written_again(spark, tmp_path):
    base = str(tmp_path / "base")
    index_files(spark, base, [warc(tmp_path / "a.warc", [(f"a{k}", f"{k:03}", 1) for k in range(60)])])
    assert compact(spark, base, segment_rows=10) == 0
    before = {r["path"]: r for r in spark.read.parquet(state(spark, base).fold["manifest"]).collect()}
    assert len(before) >= 5 and sum(r["rows"] for r in before.values()) == 60
    index_files(spark, base, [warc(tmp_path / "b.warc", [("b", "007", 2), ("c", "008x", 2)])])
    assert compact(spark, base, segment_rows=10) in (1, 2)
    after = {r["path"]: r for r in spark.read.parquet(state(spark, base).fold["manifest"]).collect()}
    rewritten = sum(r["rows"] for p, r in after.items() if p not in before)
    assert 2 < rewritten <= 2 * 14 and sum(r["rows"] for r in after.values()) == 62
    want = sorted([(f"/{k:03}", f"a{k}", "a.warc") for k in range(60)] + [("/007", "b", "b.warc"), ("/008x", "c", "b.warc")])
    assert held(spark, base) == want
    lows = sorted(r["low"] for r in after.values())
    for r in after.values():
        span = spark.read.parquet(r["path"]).agg(F.min("key"), F.max("key")).first()
        following = [x for x in lows if x > r["low"]]
        assert span[0] == r["low"] and (not following or span[1] < following[0])
    assert compact(spark, base) == 0


def test_batch_that_comes_during_a_fold_stays_pending(spark, tmp_path, monkeypatch):
    base, real = str(tmp_path / "base"), index.publish
    index_files(spark, base, [warc(tmp_path / "a.warc", [("a", "a", 1)])])
    late = warc(tmp_path / "b.warc", [("b", "b", 1)])

    def after_another(spark, base, number, entry):
        if entry["kind"] == "fold" and current(spark, base) == 1:
            index_files(spark, base, [late])
        return real(spark, base, number, entry)

    monkeypatch.setattr(index, "publish", after_another)
    compact(spark, base)
    assert [e["number"] for e in state(spark, base).pending] == [2] and current(spark, base) == 3
    assert held(spark, base) == [("/a", "a", "a.warc"), ("/b", "b", "b.warc")]
    compact(spark, base)
    assert held(spark, base) == [("/a", "a", "a.warc"), ("/b", "b", "b.warc")] and state(spark, base).pending == []


def test_many_batches_of_a_stream(spark, tmp_path):
    """Three batches by a recurring trigger, one file of paths each; folding after two of them."""
    import time

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for k in range(3):
        paths = [warc(tmp_path / f"{k}{j}.warc", [(f"{k}{j}", f"{k}{j}", 1)]) for j in range(2)]
        (inbox / f"{k}.txt").write_text("\n".join(paths) + "\n")
        os.utime(inbox / f"{k}.txt", (1_600_000_000 + k, 1_600_000_000 + k))
    from crawlstrata.sources.files import text_path_stream

    base = str(tmp_path / "base")
    query = start_indexing(text_path_stream(spark, str(inbox), max_files=1), base, str(tmp_path / "cp"), max_wait="1 second", compact_after=2)
    try:
        end = time.monotonic() + 180
        while time.monotonic() < end and len(state(spark, base).streams) == 0 or max(state(spark, base).streams.values(), default=0) < 2:
            assert query.exception() is None
            time.sleep(0.5)
    finally:
        query.stop()
    s = state(spark, base)
    assert s.fold["upto"] == 2 and list(s.streams.values()) == [2]
    assert [p for p, *_ in held(spark, base)] == [f"/{k}{j}" for k in range(3) for j in range(2)]


def test_clear(spark, tmp_path):
    base = str(tmp_path / "base")
    assert load(spark, base, "captures") is None
    path = warc(tmp_path / "a.warc", [("1", "a", 1)])
    index_files(spark, base, [path])
    clear(spark, base)
    assert [held(spark, base, t) for t in ("captures", "ids", "files")] == [[], [], []]
    assert index_files(spark, base, [path]) == 1 and held(spark, base) == [("/a", "1", "a.warc")]


def test_folds_of_a_stream_leave_larger_segments_alone(spark, tmp_path):
    """Segments of four batches: a fold of two more becomes a run, and the next one brings all together. A file that a batch of the run replaces loses its rows all along."""
    base = str(tmp_path / "base")
    paths = [warc(tmp_path / f"{k}.warc", [(f"r{k}", f"p{k}", 1), (f"s{k}", "same", 1)]) for k in range(7)]
    index_files(spark, base, paths[:1])
    index_files(spark, base, paths[1:2])
    index_files(spark, base, paths[2:3])
    index_files(spark, base, paths[3:4])
    fold(spark, base)
    first = state(spark, base).fold
    assert first["batches"] == 4 and not first.get("runs")
    index_files(spark, base, paths[4:5])
    warc(tmp_path / "0.warc", [("again", "p0", 1)], when=1_600_000_001)
    index_files(spark, base, paths[:1], replace_file=True)
    want = [("/p0", "again", "0.warc"), *[(f"/p{k}", f"r{k}", f"{k}.warc") for k in range(1, 5)], ("/same", "s4", "4.warc")]
    assert held(spark, base) == want
    fold(spark, base)
    s = state(spark, base)
    assert s.fold["manifest"] == first["manifest"] and [r["batches"] for r in s.fold["runs"]] == [2] and s.pending == []
    assert held(spark, base) == want and held(spark, base, "files") == [f"{k}.warc" for k in range(5)]
    # The file that had won its key is replaced by less: the next one's row, in the segments, comes back.
    warc(tmp_path / "4.warc", [("r4", "p4", 1)], when=1_600_000_001)
    index_files(spark, base, paths[4:5], replace_file=True)
    index_files(spark, base, paths[5:6])
    want[-1:] = [("/p5", "r5", "5.warc"), ("/same", "s5", "5.warc")]
    assert held(spark, base) == want
    fold(spark, base)
    s = state(spark, base)
    assert s.fold["manifest"] != first["manifest"] and s.fold["batches"] == 8 and not s.fold.get("runs") and s.pending == []
    assert held(spark, base) == want and held(spark, base, "files") == [f"{k}.warc" for k in range(6)]


def test_index_batches_with_fewer_files_than_cores(spark, monkeypatch):
    """A batch is a file's path, whatever the number of cores: there is no batch without a path."""
    from crawlstrata.queries import archive

    made = archive.warc_files
    monkeypatch.setattr(archive, "warc_files", lambda spark, sf_dir: made(spark, sf_dir)[: spark.sparkContext.defaultParallelism - 1])
    found = archive.index_batches(spark, "/root/testdata/sf0.001").first()
    assert found["batches"] == found["files"] == spark.sparkContext.defaultParallelism - 1


def test_a_batch_of_a_stream_takes_few_jobs(spark, tmp_path):
    """A job that looks at the file and one that writes its captures; a fold of two such batches is one job. Starts of jobs are most of what a batch of one file takes."""
    base = str(tmp_path / "base")
    paths = [warc(tmp_path / f"{k}.warc", [(f"r{k}", f"p{k}", 1), (f"s{k}", "same", 1)]) for k in range(4)]
    index_files(spark, base, paths[:1])
    compact(spark, base)

    def jobs(name, run):
        spark.sparkContext.setJobGroup(name, name)
        run()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    assert jobs("first", lambda: index_files(spark, base, paths[1:2])) <= 3
    index_files(spark, base, paths[2:3])
    compact(spark, base)
    index_files(spark, base, paths[3:])
    assert jobs("fold", lambda: fold(spark, base)) <= 2
    assert state(spark, base).fold["runs"] and held(spark, base) == [*[(f"/p{k}", f"r{k}", f"{k}.warc") for k in range(4)], ("/same", "s3", "3.warc")]


def test_files_beyond_the_log_are_a_table(spark, tmp_path, monkeypatch):
    """Of many files the log holds none; those of a later batch are looked up in the table."""
    monkeypatch.setattr(index, "FEW_FILES", 2)
    base = str(tmp_path / "base")
    paths = [warc(tmp_path / f"{k}.warc", [(f"r{k}", f"p{k}", 1)]) for k in range(4)]
    index_files(spark, base, paths[:3])
    compact(spark, base)
    assert state(spark, base).fold["rows"] is None and index_files(spark, base, paths) == 1
    warc(tmp_path / "0.warc", [("again", "p0", 1)], when=1_700_000_000)
    assert index_files(spark, base, [*paths, str(tmp_path / "none.warc")], excludes=["1"]) == 1
    assert [r for _, r, _ in held(spark, base)] == ["again", "r1", "r2", "r3"] and held(spark, base, "files") == [f"{k}.warc" for k in range(4)]
