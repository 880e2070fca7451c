import random

import corpus_pipeline
import numpy as np
from crawlstrata.llm import nearcopies
from pyspark.sql import functions as F
from tests_llm_data import SF


def sets(texts):
    words = [(t or "").lower().split() for t in texts]
    return [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in words]


def near_pairs(ids, texts):
    """Of all pairs of other texts, those of a five-word Jaccard similarity of 0.8 or more."""
    s = sets(texts)
    return [(ids[a], ids[b]) for b in range(len(s)) for a in range(b) if 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])]


def test_stage_against_brute_force(spark):
    """Of the documents that near pairs tie together, the one of the smallest id stays."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = docs.collect()
    pairs = near_pairs([r["doc_id"] for r in rows], [r["text"] for r in rows])
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()}
    assert not [p for p in pairs if kept >= set(p)]
    root = {r["doc_id"]: r["doc_id"] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert kept == {find(x) for x in root}


def test_crowd_of_near_copies(spark):
    """Copies with one changed word each, and texts that share half of their words with them and stay."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    texts = [" ".join(base)]
    for _ in range(60):
        w = list(base)
        w[r.randrange(150)] = word()
        texts.append(" ".join(w))
    texts += [" ".join(base[:75] + [word() for _ in range(75)]) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"] for x in nearcopies.deduplicate(df).collect()} == {0, *range(61, 71)}


def test_odd(spark, odd):
    kept = nearcopies.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == [-1, 0, 2, 5, 7]
    assert nearcopies.deduplicate(odd.limit(0)).count() == 0


def test_bitmaps_never_rule_out_a_similar_pair(spark):
    draw = np.random.default_rng(5)
    rows = []
    for size in (1, 3, 40, 300, 5000):
        for share in (0.5, 0.78, 0.8, 0.82, 1.0):
            a = np.unique(draw.integers(0, 1 << 64, size, np.uint64))
            b = np.unique(np.concatenate([a[: max(1, round(size * share))], draw.integers(0, 1 << 64, round(size * (1 - share) / 4), np.uint64)]))
            bits = [nearcopies.bitmap(x).tolist() for x in (a, b)]
            rows.append((len(a), bits[0], len(b), bits[1], nearcopies.similar(a, b, 0.8)))
    df = spark.createDataFrame(rows, "n_a long, bits_a array<long>, n_b long, bits_b array<long>, near boolean")
    found = df.select("near", nearcopies.may_be_similar(0.8, "n_a", "bits_a", "n_b", "bits_b").alias("maybe")).collect()
    assert all(x.maybe for x in found if x.near)
    assert {x.near for x in found} == {True, False} and not all(x.maybe for x in found)


def test_extra_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, "x"), (2, "a b c d e f", 8, "y"), (3, "other words", 9, "z")], "doc_id long, text string, __ROW__ long, _n string")
    assert {tuple(x) for x in nearcopies.deduplicate(df).collect()} == {(1, "a b c d e f", 7, "x"), (3, "other words", 9, "z")}


def closure(ids, pairs):
    """The ids that stay: the smallest of each component."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {find(x) for x in root}


def test_chains_keep_one_document_each(spark):
    """Forty chains of thirty texts: neighbours are near, others are not, and ids are shuffled, so that no text leads a whole chain."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    texts = []
    for _ in range(40):
        words = [word() for _ in range(104)]
        for k in range(30):
            texts.append(" ".join(words[9 * k : 9 * k + 104]))
            words += [word() for _ in range(9)]
    r.shuffle(texts)
    pairs = near_pairs(range(len(texts)), texts)
    want = closure(range(len(texts)), pairs)
    assert len(want) == 40 and len(pairs) == 40 * 29
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"] for x in nearcopies.deduplicate(df).collect()} == want


def family(n, own, common=150, seed=4):
    """Texts that share a passage, each with words of its own after it."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    passage = [word() for _ in range(common)]
    return [" ".join(passage + [word() for _ in range(own)]) for _ in range(n)]


def test_crowd_that_shares_a_passage_is_not_compared_by_pairs(spark, monkeypatch):
    """300 texts of similarity 0.6 and 60 near copies of one of them, in one crowd: few pairs leave the joins and blocks, and the result is that of all pairs."""
    texts = family(300, own=50)
    r = random.Random(2)
    for k in range(60):
        words = texts[0].split()
        words[r.randrange(len(words))] = f"other{k}"
        texts.append(" ".join(words))
    want = closure(range(len(texts)), near_pairs(range(len(texts)), texts))
    seen = []
    for name in ("grouped", "across", "across_blocks"):

        def counted(*args, real=getattr(nearcopies, name)):
            out = real(*args)
            seen.append(out.count())
            return out

        monkeypatch.setattr(nearcopies, name, counted)
    # All in one band value, so that every pair is a candidate.
    monkeypatch.setattr(nearcopies, "bands", lambda found: np.arange(nearcopies.BANDS, dtype=np.int64))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    nodes = [(k, nearcopies.shingles(t.encode())) for k, t in enumerate(texts)]
    rows = spark.createDataFrame([(k, len(s), nearcopies.bitmap(s).tolist(), [7]) for k, s in nodes], "node long, n long, bits array<long>, bands array<long>")
    edges = nearcopies.links(rows, df.selectExpr("doc_id as node", "cast(text as binary) as text"), 0.8, 5)
    assert closure(range(len(texts)), [(e["a"], e["b"]) for e in edges.collect()]) == want and len(want) == 300
    assert len(seen) == 3 and sum(seen) < 25 * len(texts)


def test_blocks_lose_no_similar_pair(spark):
    """Mutated copies of one text under one key, in blocks much smaller than the key: every near pair of a node outside the largest component is among the candidates."""
    draw = np.random.default_rng(9)
    base = np.unique(draw.integers(0, 1 << 64, 150, np.uint64))
    sets = []
    for k in range(90):
        lost = draw.permutation(len(base))[: draw.integers(0, 40)]
        sets.append(np.unique(np.concatenate([np.delete(base, lost), draw.integers(0, 1 << 64, len(lost), np.uint64)])))
    root = [0 if k % 3 else k for k in range(90)]
    outside = sum(r != 0 for r in root)
    rows = spark.createDataFrame([(7, k, root[k], 0, 90, outside) for k in range(90)], "key long, node int, root int, top int, nodes long, outside long")
    facts = spark.createDataFrame([(k, len(s), nearcopies.bitmap(s).tolist()) for k, s in enumerate(sets)], "node int, n long, bits array<long>")
    every = {(a, b) for b in range(90) for a in range(b) if root[a] != root[b]}
    near = {(a, b) for a, b in every if nearcopies.similar(sets[a], sets[b], 0.8)}
    assert len(near) > 100
    for block in (16, 1024):
        found = {(x["a"], x["b"]) for x in nearcopies.across_blocks(rows, facts, 0.8, block).collect()}
        assert near <= found <= every and len(found) < len(every) / 2
    assert {(x["a"], x["b"]) for x in nearcopies.across(rows).collect()} == every


def test_rarest_shingles_meet_for_every_similar_pair(spark):
    draw = np.random.default_rng(6)
    base = np.unique(draw.integers(0, 1 << 64, 400, np.uint64))
    sets = []
    for k in range(60):
        keep = base[draw.random(len(base)) > draw.choice([0.0, 0.05, 0.1, 0.3])]
        sets.append(np.unique(np.concatenate([keep, draw.integers(0, 1 << 64, draw.integers(0, 60), np.uint64)])))
    df = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "node int, set binary")
    rare = {}
    for x in nearcopies.rare_shingles(df, 0.8).collect():
        rare.setdefault(x["node"], set()).add(x["key"])
    near = [(a, b) for b in range(60) for a in range(b) if nearcopies.similar(sets[a], sets[b], 0.8)]
    assert len(near) > 100 and all(rare[a] & rare[b] for a, b in near)


def test_blocks_give_links_that_span_and_no_more(spark):
    """A family of sets of similarity about 0.73, which are no links, with near ones among them, under many keys: blocks of sets give the components of brute force, and fewer rows than they have nodes."""
    draw = np.random.default_rng(12)
    base = np.unique(draw.integers(0, 1 << 64, 400, np.uint64))
    changed = lambda s, k: np.unique(np.concatenate([np.delete(s, draw.permutation(len(s))[:k]), draw.integers(0, 1 << 64, k, np.uint64)]))
    sets = [changed(base, 32) for _ in range(70)]
    sets += [changed(sets[k % 7], 20) for k in range(30)]
    n = len(sets)
    pairs = [(a, b) for b in range(n) for a in range(b) if nearcopies.similar(sets[a], sets[b], 0.8)]
    want = closure(range(n), pairs)
    assert len(want) == 70 and len(pairs) > 60
    keys = 5
    rows = spark.createDataFrame([(key, k, k, 0, n, n - 1) for k in range(n) for key in range(keys)], "key long, node int, root int, top int, nodes long, outside long")
    facts = spark.createDataFrame([(k, len(s), nearcopies.bitmap(s).tolist(), bytearray(s.tobytes())) for k, s in enumerate(sets)], "node int, n long, bits array<long>, set binary")
    maybe = nearcopies.across_blocks(rows, facts.drop("set"), 0.8).count()
    for limits in ((1024, 1 << 20), (16, 1 << 20), (1024, 8000)):
        found = [(x["a"], x["b"]) for x in nearcopies.across_blocks(rows, facts, 0.8, *limits).collect()]
        assert set(found) <= set(pairs) and closure(range(n), found) == want
        assert len(found) < n and maybe > 5 * len(found)


def test_search_of_fingerprints_ties_near_copies_without_bands(spark, monkeypatch):
    """Where no two texts share a band value, op10's search still links near copies, and texts of near fingerprints that are not similar stay."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(300)]
    texts = [" ".join(base)] + [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in range(20, 300, 40)]
    phrase = [word() for _ in range(11)] * 30
    apart = [" ".join(phrase + [word() for _ in range(20)]) for _ in range(2)]
    n, fps = len(texts), [nearcopies.fingerprint(t.encode()) for t in texts + apart]
    differ = lambda a, b: (fps[a] ^ fps[b]).bit_count()
    assert all(0 < differ(0, k) <= nearcopies.RADIUS for k in range(1, n)) and differ(n, n + 1) <= nearcopies.RADIUS
    assert closure(range(n + 2), near_pairs(range(n + 2), texts + apart)) == {0, n, n + 1}
    monkeypatch.setattr(nearcopies, "bands", lambda found: found[:30].view(np.int64) ^ found.sum().view(np.int64))
    df = spark.createDataFrame(list(enumerate(texts + apart)), "doc_id long, text string")
    assert {x["doc_id"] for x in nearcopies.deduplicate(df).collect()} == {0, n, n + 1}


def test_no_join_of_nodes_is_broadcast(spark):
    """Bands, bitmaps and sets are larger than Spark takes them for: sides with a row a node or more are merged, not collected."""
    rows = spark.range(50).select(F.col("id").alias("node"), F.xxhash64(F.lit(1), F.col("id") % 5).alias("key"))
    sizes = rows.select("node", F.lit(3).alias("n"), F.array(F.lit(1).cast("long")).alias("bits"))
    apart = nearcopies.undecided(rows, rows.select("node", F.col("node").alias("root")))
    for made in (apart, nearcopies.grouped(apart), nearcopies.across(apart), nearcopies.across_blocks(apart, sizes, 0.8)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
