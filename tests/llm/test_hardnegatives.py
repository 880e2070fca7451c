import math
import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from crawlstrata.llm import hardnegatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, row long, anchor boolean, score long, list int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def rows_of(values):
    return [(i, v, label, 7, True, 8, 9) for i, v, label in values]


def plain(values, positives=5, negatives=5):
    """The contract by sorting all scores of each anchor."""
    kept = []
    for i, v, label in values:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for k, (i, label, v) in enumerate(kept):
        if i % 100:
            continue
        scored = sorted(((sum(x * y for x, y in zip(v, w)), j, other) for n, (j, other, w) in enumerate(kept) if n != k), key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p][:negatives]
            out += [(i, j, n, s[1], p, s[0]) for n, s in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, values, partitions=3, **options):
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = spark.createDataFrame(rows_of(values), SCHEMA).repartition(partitions)
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % 100 == 0, relabel=relabel, **options).select(*COLUMNS).collect())


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.execute(H.SQL)
    names = [d[0] for d in want.description]
    got = H.op13_four_russians_negatives(spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_against_plain_with_ties_and_odd_rows(spark):
    draw = random.Random(4)
    vector = lambda n=20: [draw.choice([-0.25, 0.0, 0.125, 0.5]) for _ in range(n)]
    values = [(draw.randrange(1200), vector(), draw.randrange(3)) for _ in range(400)]
    values += [(100 * k, vector(), draw.randrange(3)) for k in range(12)]
    values += [(i, list(v), label) for i, v, label in values[:60]]  # repeated rows
    values += [(300, vector(9), 1), (1, vector(3), 2), (2, [], 1), (400, [], 2)]  # other lengths
    values += [(5, None, 1), (6, vector(), None), (None, vector(), 1), (8, [0.5, None], 1), (9, [float("nan")], 1), (500, [float("inf")], 1)]
    want = plain(values)
    assert want and mined(spark, values) == want
    assert mined(spark, values, partitions=1, block=4, chunk=7) == want


def test_large_components(spark):
    values = [(k, [float(k % 5) * 1000, -3000.0 * (k % 3), 0.001], k % 2) for k in range(0, 220, 4)]
    assert mined(spark, values) == plain(values) != []


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1), (101, [1.0], 2)]) == []
    assert mined(spark, [(100, [1.0], 1), (3, [1.0], 1), (5, [0.9], 2)]) == [(100, 3, 1, 5, 65536, 58880)]


def test_four_russians_scores():
    draw = np.random.default_rng(2)
    for width, reach in ((1, 1), (8, 200), (13, 5), (64, 300), (20, 1 << 24)):
        a, c = draw.integers(-reach, reach + 1, (9, width)), draw.integers(-reach, reach + 1, (40, width))
        assert (H.Block(np.arange(9), np.zeros(9), a).score(c) == c @ a.T).all()
    a = np.full((1, 4), -(1 << 24))
    assert H.Block(np.arange(1), np.zeros(1), a).score(a)[0, 0] == 4 << 48


def test_components_are_held():
    held, _ = H.scaled(pa.array([[1e30, -1e30, 0.5]], pa.list_(pa.float32())), 256)
    assert held.tolist() == [[1 << 24, -(1 << 24), 128]]
