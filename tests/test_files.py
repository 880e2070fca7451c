import random

import pytest

from crawlstrata.sources.files import discover, list_folder, path_stream
from crawlstrata.sources.warc import packed, read_warc


@pytest.fixture
def tree(tmp_path):
    for p in ("a.warc", "b/1.warc", "b/c/2.warc", "b/c/d/3.warc", "bad/4.warc", "bad/deep/5.warc", "bad.warc", "skip/6.warc", "skip/x/7.warc", "z/8.warc"):
        (tmp_path / "root" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / p).write_bytes(b"12")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "9.warc").write_bytes(b"1")
    return tmp_path


def listing(diary, unreadable=()):
    """A lister that notes each folder it is asked for, and can't read some."""

    def list_it(path):
        with open(diary, "a") as f:
            f.write(path + "\n")
        if path.endswith(tuple(unreadable)) and unreadable:
            raise PermissionError(path)
        return list_folder(path)

    return list_it


def names(spark, tree, **options):
    rows = discover(spark, [str(tree / "root"), str(tree / "other"), str(tree / "missing"), str(tree / "root" / "a.warc")], **options).collect()
    assert all(r["path"].startswith(str(tree)) and r["size"] in (1, 2) and r["last_modified"].year > 2000 for r in rows)
    return sorted(r["name"] for r in rows)


def test_depth_and_excluded_folders_are_never_listed(spark, tree):
    diary = str(tree / "diary")
    assert names(spark, tree, max_depth=2, excludes=["/skip"], lister=listing(diary)) == ["1.warc", "2.warc", "4.warc", "5.warc", "8.warc", "9.warc", "a.warc", "bad.warc"]
    listed = [p.removeprefix(str(tree)) for p in open(diary).read().split()]
    assert sorted(listed) == ["/other", "/root", "/root/b", "/root/b/c", "/root/bad", "/root/bad/deep", "/root/z"]
    assert names(spark, tree, max_depth=0) == ["9.warc", "a.warc", "bad.warc"]
    assert len(names(spark, tree)) == 11
    assert names(spark, tree, excludes=["/root$"]) == ["9.warc", "a.warc"]


def test_unreadable_folder_ends_its_root(spark, tree):
    """What comes before it by name stays, also deeper down; what comes after goes; other roots are whole."""
    diary = str(tree / "diary")
    assert names(spark, tree, lister=listing(diary, ["/bad"])) == ["1.warc", "2.warc", "3.warc", "9.warc", "a.warc"]
    assert names(spark, tree, lister=listing(diary, ["/b/c"])) == ["1.warc", "9.warc", "a.warc"]


def test_nothing_to_discover(spark, tmp_path):
    assert discover(spark, []).collect() == [] and discover(spark, [str(tmp_path / "none")]).collect() == []


def test_packing_balances_many_files(spark):
    """100,000 paths: tasks of about equal bytes, and a plan that does not name the paths."""
    draw = random.Random(1)
    sizes = [int(draw.paretovariate(1.3) * 1e6) for _ in range(100_000)]
    files = spark.createDataFrame([(f"/warcs/{k}.warc.gz", s) for k, s in enumerate(sizes)], "path string, size long")
    dealt = packed(files, task_bytes=-(-sum(sizes) // 40))
    loads = {r["task"]: r for r in dealt.groupBy("task").agg({"size": "sum", "path": "count"}).collect()}
    assert set(loads) == set(range(40)) and sum(r["count(path)"] for r in loads.values()) == 100_000
    big = [r["sum(size)"] for r in loads.values()]
    assert max(big) - min(big) <= max(sizes)
    assert dealt.select("path").distinct().count() == 100_000


def test_plan_of_reading_is_small(spark, tmp_path):
    paths = [str(tmp_path / f"{k}.warc") for k in range(300)]
    for p in paths:
        open(p, "wb").close()
    df = read_warc(spark, spark.createDataFrame([(p,) for p in paths], "path string"))
    assert df.count() == 0 and len(df._jdf.queryExecution().optimizedPlan().toString()) < 3000
    (row,) = read_warc(spark, [str(tmp_path / "none.warc")]).collect()
    assert row["filename"] == "none.warc" and row["error"]


class Recorder:
    """Stands for a session: notes format and options of a stream, and gives messages as Kafka would."""

    def __init__(self, spark):
        self.spark, self.noted = spark, {}
        self.readStream = self

    def format(self, name):
        self.noted["format"] = name
        return self

    def options(self, **options):
        self.noted |= options
        return self

    def load(self):
        return self.spark.createDataFrame([(bytearray(b"/warcs/a.warc.gz"), "t"), (None, "t")], "value binary, topic string")


def test_every_option_of_a_path_stream(spark):
    session = Recorder(spark)
    rows = path_stream(session, brokers="k:9092", topic="warcs", group_id="g", min_bytes="1", max_bytes="10000", max_wait_ms="500", max_offsets_per_trigger="1000").collect()
    assert session.noted == {
        "format": "kafka",
        "kafka.bootstrap.servers": "k:9092",
        "subscribe": "warcs",
        "kafka.group.id": "g",
        "kafka.fetch.min.bytes": "1",
        "kafka.fetch.max.bytes": "10000",
        "kafka.fetch.max.wait.ms": "500",
        "maxOffsetsPerTrigger": "1000",
    }
    assert [r["path"] for r in rows] == ["/warcs/a.warc.gz", None]
    with pytest.raises(ValueError, match="nonsense"):
        path_stream(session, nonsense="1")
