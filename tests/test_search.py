import pytest

from crawlstrata.functions.keys import with_keys
from crawlstrata.operators import report, resolve, store
from crawlstrata.plans.filters import parse_filter
from crawlstrata.plans.search import SearchRequest, search

#: Captures: id, scheme, user, host, its sortable form, port, path, minute of the day, status.
ROWS = [
    ("p1", "http", "", "pear.net", "net,pear,", "", "/", 605, 200),
    ("p2", "http", "", "pear.net", "net,pear,", "", "/", 640, 200),
    ("p3", "https", "", "pear.net", "net,pear,", "", "/", 611, 200),
    ("p4", "http", "ann:xyz", "pear.net", "net,pear,", "8081", "/", 690, 301),
    ("p5", "http", "", "pear.net", "net,pear,", "", "/pick/early", 610, 200),
    ("p6", "http", "", "pear.net", "net,pear,", "", "/pick", 540, 404),
    ("p7", "http", "", "old.pear.net", "net,pear,old,", "", "/", 600, 200),
    ("p8", "https", "", "old.pear.net", "net,pear,old,", "", "/pick?y=1#z", 720, 200),
    ("p9", "http", "", "pearl.net", "net,pearl,", "", "/", 620, 200),
    ("p10", "http", "", "pear.net", "net,pear,", "", "/pick/late?kind=a", 780, 200),
    ("p11", "http", "", "www.old.pear.net", "net,pear,old,www,", "", "/x", 480, 200),
]
ROOT = "http://pear.net/"


def url(row):
    _, scheme, user, host, _, port, path, *_ = row
    return f"{scheme}://{user}{'@' * bool(user)}{host}{':' * bool(port)}{port}{path}"


def stamp(minute):
    return f"20230516{minute // 60:02}{minute % 60:02}00"


def key(row):
    """Host and path, time, then port and scheme and user: the order of the table."""
    _, scheme, user, _, turned, port, path, minute, _ = row
    return f"{turned}{path} {stamp(minute)} {port}:{scheme}{'@' * bool(user)}{user}:"


def wanted(test, reverse=False, near=None):
    """Ids of the captures that pass the test, in key order or by distance from a minute."""
    rows = sorted(filter(test, ROWS), key=key, reverse=reverse)
    return [r[0] for r in (rows if near is None else sorted(rows, key=lambda r: abs(r[7] - near)))]


@pytest.fixture(scope="module")
def cap(spark):
    rows = [(r[0], url(r), stamp(r[7]), r[8]) for r in ROWS]
    df = spark.createDataFrame(rows, "rid string, uri string, t string, hsc int").selectExpr("*", "to_timestamp(t, 'yyyyMMddHHmmss') as sts", "cast(null as string) as srt", "cast(null as string) as ref", "cast(null as string) as mct", "cast(null as bigint) as cle", "cast(null as bigint) as ple", "cast(null as bigint) as rle").drop("t")
    return with_keys(df).cache()


def at(turned, path=None):
    return lambda r: r[4] == turned and path in (None, r[6])


TOP = at("net,pear,", "/")
CASES = [
    (dict(url=ROOT), wanted(TOP)),
    (dict(url="pear.net"), wanted(TOP)),
    (dict(url=ROOT, sort="reverse"), wanted(TOP, reverse=True)),
    (dict(url=ROOT, limit=3), wanted(TOP)[:3]),
    (dict(url=ROOT, limit=-1), wanted(TOP)),
    (dict(url=ROOT, filters=("!hsc:200",)), wanted(lambda r: TOP(r) and r[8] != 200)),
    (dict(url=ROOT, match_type="verbatim"), wanted(lambda r: TOP(r) and (r[1], r[2], r[5]) == ("http", "", ""))),
    (dict(url="https://pear.net/", match_type="verbatim"), ["p3"]),
    (dict(url=ROOT, closest=stamp(612), sort="closest"), wanted(TOP, near=612)),
    (dict(url=ROOT, match_type="verbatim", closest=stamp(639), sort="closest"), ["p2", "p1"]),
    (dict(url=ROOT + "pick", match_type="prefix"), wanted(lambda r: r[4] == "net,pear," and r[6].startswith("/pick"))),
    (dict(url=ROOT + "pick"), ["p6"]),
    (dict(url=ROOT + "pick/late?kind=a"), ["p10"]),
    (dict(url="https://old.pear.net/pick?y=1#z"), ["p8"]),
    (dict(url=ROOT, match_type="host"), wanted(at("net,pear,"))),
    (dict(url=ROOT, match_type="domain"), wanted(lambda r: r[4].startswith("net,pear,"))),
    (dict(url="http://old.pear.net/", match_type="domain", sort="reverse"), wanted(lambda r: r[4].startswith("net,pear,old,"), reverse=True)),
    (dict(url=ROOT, match_type="host", from_=stamp(606)[:12], to=stamp(640)[:12]), wanted(lambda r: r[4] == "net,pear," and 606 <= r[7] <= 640)),
]


@pytest.mark.parametrize("request_,want", CASES)
def test_searches(cap, request_, want):
    assert want and [r["rid"] for r in search(cap, SearchRequest(**request_)).collect()] == want


def test_missing_fields(cap):
    count = lambda *f: search(cap, SearchRequest(filters=f)).count()
    n = len(ROWS)
    assert count("=mct:") == n and count("!=mct:") == 0 and count("mct:") == n and count("nosuch:") == n and count("~hsc:^2") == len(wanted(lambda r: r[8] == 200))


@pytest.mark.parametrize("values", [{"url": ["http://a"], "matchType": ["x"]}, {"url": ["http://a"], "sort": ["x"]}, {"limit": ["x"]}, {"output": ["x"]}, {"from": ["199"]}, {"sort": ["closest"], "closest": ["2020"]}])
def test_bad_requests(values):
    with pytest.raises(ValueError):
        SearchRequest.parse(values)


def test_bad_searches(cap):
    for bad in (dict(url="gopher:\\\\pear"), dict(match_type="verbatim"), dict(from_="2002", to="2001"), dict(filters=("sts:2020",)), dict(filters=("mct",))):
        with pytest.raises(ValueError):
            search(cap, SearchRequest(**bad))


def test_requests():
    assert SearchRequest.parse({"url": ["http://a"], "limit": ["100"]}).limit == 100
    assert SearchRequest.parse({"url": ["http://a"], "sort": ["closest"]}).sort == "asc"
    r = SearchRequest.parse({"url": ["http://a"], "sort": ["closest"], "closest": ["2020"]}).for_replay()
    assert r.match_type == "verbatim"
    assert SearchRequest(url="http://a", match_type="prefix").for_replay().limit == 1000
    assert parse_filter("!=status:200", {"status": "hsc"}) == ("equals", "hsc", "200", True)


def test_closest_ties(spark, cap):
    """Minute 608 lies between p1 and p3: earlier wins. Minute 640 is p2's own."""
    day = 1684195200
    asked = spark.createDataFrame([(1, ROOT, day + 608 * 60), (2, ROOT, day + 640 * 60), (3, "http://nowhere.org/", 0), (4, ROOT, 0)], "request int, url string, at long")
    got = {r["request"]: r["nearest"]["rid"] if r["nearest"] else None for r in resolve.closest(resolve.scoped(asked), cap).collect()}
    assert got == {1: "p1", 2: "p2", 3: None, 4: "p1"}
    ranks = resolve.closest_k(resolve.scoped(asked), cap, 2).where("request = 1").orderBy("rank").collect()
    assert [r["rid"] for r in ranks] == ["p1", "p3"]


def test_revisits(spark):
    rows = [("o", "http://a.com/", 100, "response", None, None), ("r1", "http://a.com/", 200, "revisit", "o", None), ("r2", "http://b.com/", 90, "revisit", None, "http://a.com/"), ("r3", "http://a.com/", 200, "revisit", "gone", None), ("r4", "http://c.com/", 200, "revisit", None, None), ("r5", "http://c.com/", 200, "revisit", None, "http://d.com/")]
    df = spark.createDataFrame(rows, "rid string, uri string, t long, srt string, roi string, rou string").selectExpr("*", "timestamp_seconds(t) as sts", "cast(null as timestamp) as rod", "concat('warcfile:x#', t) as ref").drop("t")
    got = {r["rid"]: (r["original"], r["outcome"]) for r in resolve.resolve_revisits(with_keys(df)).collect()}
    assert got == {"r1": ("o", "ok"), "r2": ("o", "ok"), "r3": (None, "not_found"), "r4": (None, "no_reference"), "r5": (None, "not_found")}


def test_upsert_and_report(spark, cap, tmp_path):
    old = spark.createDataFrame([("k1", "f1", 1, "old"), ("k2", "f9", 1, "old")], "key string, filename string, offset long, rid string")
    new = spark.createDataFrame([("k1", "f1", 1, "new"), ("k2", "f1", 1, "new"), ("k" * 99, "f", 1, "long")], old.schema)
    got = {r["key"]: r["rid"] for r in store.upsert_captures(old, new, max_key_bytes=50).collect()}
    assert got == {"k1": "new", "k2": "old"}
    rules = spark.createDataFrame([("net",)], "rule string")
    row = report.report(cap, SearchRequest(url=ROOT, match_type="domain"), rules, id="x")
    data = row.first()["data"]
    mine = [r for r in ROWS if r[4].startswith("net,pear,")]
    unlike = {(r[4], r[6]) for r in mine}
    assert (data["records"], data["domains"], data["targets"], data["urls"]) == (len(mine), len({r[4] for r in mine}), 1, len(unlike))
    assert data["by_status"] == {"200": 8, "301": 1, "404": 1} and data["by_scheme"] == {"http": 8, "https": 2} and data["by_mime"] == {"": 10}
    path = str(tmp_path / "reports")
    report.save_report(row, path)
    report.save_report(report.report(cap, SearchRequest(url="gopher:\\\\pear"), rules, id="y"), path)
    assert report.get_report(spark, path, "x").count() == 1
    assert report.get_report(spark, path, "y").first()["status"] == "FAILED"
    report.delete_report(spark, path, "x", path + "2")
    assert [r["id"] for r in spark.read.parquet(path + "2").collect()] == ["y"]


def test_empty_report(spark, cap):
    rules = spark.createDataFrame([("com",)], "rule string")
    assert report.report_data(cap.limit(0), rules).first()["records"] == 0


def test_repair(spark):
    df = spark.createDataFrame([(b"ok",), (b"a\xffb",), (None,)], "uri binary")
    assert [r[0] for r in store.repair_utf8(df, ["uri"]).collect()] == ["ok", "ab", None]


def test_pushdown(cap, tmp_path, spark):
    path = str(tmp_path / "captures")
    store.write_captures(cap, path, 2)
    plan = search(spark.read.parquet(path), SearchRequest(url=ROOT))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key" in plan
