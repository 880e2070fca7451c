import zlib
from collections import Counter

from pyspark.sql import functions as F

from crawlstrata.llm import sharding
from tests_llm_data import SF


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 10863919174838991, *range(2, 300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 100):
        got = {r["k"]: (r["j"]["shard"], r["j"]["grown_shard"]) for r in df.select("k", sharding.jump_hash(F.col("k"), n).alias("j")).collect()}
        assert got == {k: (jump(k, n), jump(k, n + 1)) for k in keys}


def test_query(spark):
    rows = sharding.op1_jump_sharding(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["shard"] == jump(r["doc_id"], 24) and r["grown_shard"] in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd(spark, odd):
    placed = sharding.assign_shards(odd, F.col("doc_id"), 3, [F.col("doc_id"), F.octet_length("text").alias("size")])
    out = sharding.number_slots(placed, "shard", ["doc_id", "size"]).collect()
    assert len(out) == 10
    for s, n in Counter(r["shard"] for r in out).items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    assert sharding.number_slots(placed.limit(0), "shard", ["doc_id"]).count() == 0


def test_write(spark, odd, tmp_path):
    sharding.write_shards(odd.drop("shard"), F.col("doc_id"), 3, str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
