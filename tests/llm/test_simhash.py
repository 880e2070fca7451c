import random
import re

import xxhash
from pyspark.sql import functions as F

from crawlstrata.llm import simhash
from tests_llm_data import SF


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=2):
    """fps: list of (id, fingerprint). Smallest id of each row's component."""
    nodes = sorted({f for _, f in fps})
    root = {f: f for f in nodes}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for i, f in fps:
        least[find(f)] = min(i, least.get(find(f), i))
    return [least[find(f)] for _, f in fps]


def test_query(spark):
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op10_multi_index_simhash(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", c) for (i, f), c in zip(rows, brute_components(rows), strict=True)}
    assert len({c for _, c in got.values()}) < len(rows)


def test_links_and_chains(spark):
    base = 0x0F0F_1234_8765_4321
    masks = [0, 1, 3, 7, 15, 31, 1 << 40, 1 << 40 | 1 << 41 | 1 << 42, 0xFF << 50]
    fps = [(k, base ^ m) for k, m in enumerate(masks)]
    df = spark.createDataFrame([(f,) for _, f in fps], "fp long")
    for radius, segments in ((2, 2), (2, 3), (3, 2), (1, 4)):
        want = {(a, b) for _, a in fps for _, b in fps if a < b and (a ^ b).bit_count() <= radius}
        for crowded in (4000, 1):
            assert {(r["a"], r["b"]) for r in simhash.links(df, radius=radius, segments=segments, crowded=crowded).collect()} == want
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components([(f, f) for _, f in fps])
    assert {f: roots.get(f, f) for _, f in fps} == dict(zip([f for _, f in fps], want, strict=True))


def test_nearest(spark):
    """Each fingerprint with the nearest smaller one; crowds dealt into parts leave out links but give none that brute force does not give, and one row a fingerprint at most."""
    r = random.Random(3)
    base = [r.getrandbits(64) - (1 << 63) for _ in range(6)]
    fps = {b ^ sum(1 << k for k in r.sample(range(63), r.randrange(7))) for b in base for _ in range(60)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for radius, segments in ((2, 2), (5, 3)):
        near = {(a, b): (a ^ b).bit_count() for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius}
        want = {b: min((d, a) for (a, c), d in near.items() if c == b)[1] for _, b in near}
        assert {x["b"]: x["a"] for x in simhash.nearest(df, radius=radius, segments=segments).collect()} == want
        parts = [(x["a"], x["b"]) for x in simhash.nearest(df, radius=radius, segments=segments, crowd=20).collect()]
        assert set(parts) <= near.keys() and len({b for _, b in parts}) == len(parts) > len(want) / 3


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert roots == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_odd(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {0}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == [-1, 0, 2, 5, 7]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.deduplicate(odd.limit(0)).count() == 0


def test_search_collects_nothing_that_grows(spark):
    """Spark takes the exploded balls for as large as their fingerprints, however many there are of each; the joins are merged all the same."""
    nodes = spark.range(64).select(F.xxhash64("id").alias("fp"))
    for found in (simhash.links(nodes), simhash.links(nodes, crowded=0), simhash.nearest(nodes, radius=5, segments=3)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "Inner" in line]
