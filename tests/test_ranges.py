import random

import pytest
from pyspark.sql import functions as F

from crawlstrata.operators import ranges, report, resolve

CAPTURES = "host string, path string, psu string, unix long, key string, rid string, ref string, other int"


@pytest.fixture
def many_parts(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


def world(seed, urls=6, captures=400, requests=80):
    """Captures and requests, a half of both at one URL; times with ties."""
    draw = random.Random(seed)
    place = lambda: ("h,", "/hot", draw.choice(["a", "b"])) if draw.random() < 0.5 else (f"h{draw.randrange(urls)},", f"/{draw.randrange(2)}", "a")
    held = []
    for k in range(captures):
        host, path, psu = place()
        unix = draw.randrange(200)
        held.append((host, path, psu, unix, f"{host}{path} {unix:04} {psu} {k % 3}", f"r{k}", f"f{k}", 1))
    held = list({c[4]: c for c in held}.values())
    asked = [(k, *place(), draw.randrange(-20, 230)) for k in range(requests)] + [(900, "none,", "/", "a", 5), (901, None, None, None, 5)]
    return held, asked


def nearest(held, request, verbatim):
    _, host, path, psu, at = request
    fit = [c for c in held if c[0] == host and c[1] == path and (not verbatim or c[2] == psu)]
    order = lambda c: (abs(c[3] - at), c[3] >= at, c[4] if c[3] >= at else "")
    later = sorted((c for c in fit if c[3] >= at), key=order)
    earlier = sorted((c for c in fit if c[3] < at), key=lambda c: c[4], reverse=True)
    return sorted(earlier + later, key=lambda c: (abs(c[3] - at), c[3] >= at))


@pytest.mark.parametrize("seed,verbatim", [(1, False), (2, True), (3, False)])
def test_nearest_over_many_parts(many_parts, seed, verbatim):
    held, asked = world(seed)
    captures, requests = many_parts.createDataFrame(held, CAPTURES), many_parts.createDataFrame(asked, "request int, host string, path string, psu string, at long")
    united = resolve._united(requests, captures, ["host", "path"], F.lit(1), F.lit(1))
    parts = {r[0] for r in united.where("path = '/hot'").select(ranges.PART).distinct().collect()}
    assert len(parts) >= 3
    got = {r["request"]: r["nearest"] and r["nearest"]["rid"] for r in resolve.closest(requests, captures, verbatim).collect()}
    wanted = {a[0]: [c[5] for c in nearest(held, a, verbatim)] for a in asked}
    assert got == {k: (w[0] if w else None) for k, w in wanted.items()}
    found = {}
    for r in resolve.closest_k(requests, captures, 3, verbatim).collect():
        found.setdefault(r["request"], {})[r["rank"]] = r["rid"]
    assert found == {k: dict(enumerate(w[:3], 1)) for k, w in wanted.items() if w}


def test_captures_of_other_urls_are_not_shuffled(many_parts):
    held, asked = world(4, urls=40, captures=2000, requests=0)
    captures, requests = many_parts.createDataFrame(held, CAPTURES), many_parts.createDataFrame([(1, "h3,", "/1", "a", 7)], "request int, host string, path string, psu string, at long")
    wanted = [c for c in held if c[0] == "h3," and c[1] == "/1"]
    assert ranges.asked_only(captures, requests, ["host", "path"]).count() == len(wanted) < 60
    assert ranges.asked_only(captures, requests.limit(0), ["host", "path"]).count() == 0
    # A map that is full lets rows pass, and loses none.
    crowded = ranges.asked_only(captures, requests, ["host", "path"], bits=ranges.ROW_BITS >> 12)
    assert {r["rid"] for r in crowded.collect()} >= {c[5] for c in wanted}


def test_map_of_asked_values(many_parts):
    rows = many_parts.range(5000).select(F.col("id").alias("x"), F.lit("k").alias("_other"))
    asked = rows.where("x % 3 = 0").withColumnRenamed("x", "y")
    got = {r["x"] for r in ranges.asked_only(rows, asked, ["x"], ["y"], bits=1 << 30).collect()}
    assert got == set(range(0, 5000, 3))


def test_collapsed_captures_over_many_parts(many_parts):
    draw = random.Random(6)
    rows = [("h,", "/", t, f"h,/ {t:06}") for t in sorted(draw.sample(range(4000), 900))] + [(f"x{k},", "/", 3, "k") for k in range(5)] + [("h,", "/a", 1, "z")]
    times = sorted(r[2] for r in rows if r[0] == "h," and r[1] == "/")
    want = 1 + sum(b - a > 5 for a, b in zip(times, times[1:], strict=False)) + 5
    df = many_parts.createDataFrame(rows, "host string, path string, unix long, key string")
    assert len({r[0] for r in ranges.spread(df.where("path = '/'"), ["host"], ["key"]).select(ranges.PART).distinct().collect()}) >= 5
    assert report.collapsed_target_captures(df).first()["n"] == want
    assert report.collapsed_target_captures(df.limit(0)).first()["n"] == 0


def test_get_captures_of_one_status_where_keys_collide(spark, monkeypatch):
    from crawlstrata.queries import tables

    held = spark.createDataFrame([("a", "r1", 404), ("a", "r2", 200), ("a", "r3", 404), ("b", "r4", 200)], "key string, rid string, hsc int")
    monkeypatch.setattr(tables, "captures", lambda *_: held)
    assert sorted(map(tuple, tables.get_captures(spark, "").collect())) == [("a", "r1"), ("a", "r3")]
