import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from crawlstrata.llm import contextmix
from tests_llm_data import SF


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts, ends = Counter(), 0
    for i, t in docs.items():
        if not held[i]:
            counts.update(split(t))
            ends += 1
    n, v = counts.total() + ends, len(counts) + 1
    space = math.log10(n + v + 1)
    rows = contextmix.op7_context_mixing(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = split(docs[r["doc_id"]])
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(words) + 1 and r["train_tokens"] == n
        assert r["n_known"] == sum(w in counts for w in words) + 1
        base = sum(math.log10(counts[w] + 1) - space for w in words) + math.log10(ends + 1) - space
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0
    # Texts of the corpus are likelier than their words' letters at random, held out or not.
    assert np.mean([r["bits_per_byte"] for r in rows if r["held_out"]]) < 3.5


def trained(model, *texts):
    counts = contextmix.Tally(2 * model.n_slots)
    model.tally(counts, *texts)
    model.mixer.seen = contextmix.evidence(counts.total().reshape(-1, 2))
    cells = contextmix.Tally(model.mixer.n_cells)
    model.observe(cells, *texts)
    model.mixer.learn(cells.total().astype(np.int64))
    return model


def words_mixer(texts, slot_bits=10):
    counts = Counter(w for t in texts for w in t)
    code = contextmix.Code([counts[k] + 1 for k in range(max(counts) + 1)])
    home = np.arange(max(counts) + 1) % 3
    return trained(contextmix.WordMixer(code, home, 2, slot_bits), texts, [np.full(len(t), -1) for t in texts])


def test_code_is_prefix_free_and_short():
    counts = [50, 30, 12, 5, 2, 1]
    code = contextmix.Code(counts)
    paths = [tuple(s & 1 for s in code.steps[o : o + n].tolist()) for o, n in zip(code.offset, code.length, strict=True)]
    assert len(set(paths)) == 6 and sum(2.0 ** -len(p) for p in paths) == 1
    assert not any(a != b and b[: len(a)] == a for a in paths for b in paths)
    assert [len(p) for p in paths] == [1, 2, 3, 4, 5, 5]
    assert all(int(x) == int("".join(map(str, p)).ljust(64, "0"), 2) for x, p in zip(code.left, paths, strict=True))


def test_next_words_sum_to_one():
    """After any words, with or without a match, the probabilities of all next words make up one."""
    r = np.random.default_rng(2)
    texts = [np.append(r.integers(1, 9, 30), 0) for _ in range(40)]
    mixer = words_mixer(texts)
    for begin, guess in (([], -1), ([3, 4], -1), ([1, 2, 5], 7)):
        total = 0.0
        before = mixer.score([np.array(begin)], [np.full(len(begin), -1)], False)[0] if begin else 0.0
        for w in range(9):
            ids = np.array([*begin, w])
            total += 10 ** (mixer.score([ids], [np.array([-1] * len(begin) + [guess])], False)[0] - before)
        assert math.isclose(total, 1.0, rel_tol=1e-4)


def test_spelled_bytes_sum_to_one():
    model = trained(contextmix.Speller(), [b"then", b"them", b"tha", b"ab"])
    total = 0.0
    for byte in range(256):
        number, bit, slots, row = next(model.stretches([b"the" + bytes([byte])]))
        p = model.mixer.tables[0][model.mixer.cells(slots, bit, row, 0)].reshape(-1, 8)
        total += 10 ** p[3].sum()
    assert math.isclose(total, 1.0, rel_tol=1e-4)
    seen, new = model.score([b"then", b"qzqx"], False)
    assert seen > new


def test_order_and_borders_count():
    """Context reaches across words: a text in its usual order is likelier than its words shuffled."""
    texts = [np.array([1, 2, 3, 4, 5, 6, 0])] * 30 + [np.array([6, 4, 2, 0])] * 5
    mixer = words_mixer(texts)
    usual, other = mixer.score([np.array([1, 2, 3, 4, 5, 6, 0]), np.array([3, 6, 2, 5, 1, 4, 0])], [np.full(7, -1)] * 2, False)
    assert usual > other + 1


def test_scores_do_not_depend_on_stretches(monkeypatch):
    r = np.random.default_rng(2)
    texts = [np.append(r.integers(1, 9, n), 0) for n in (0, 1, 30, 7, 200)]
    mixer = words_mixer(texts)
    none = [np.full(len(t), -1) for t in texts]
    whole = mixer.score(texts, none, True)
    alone = [mixer.score([t], [g], True)[0] for t, g in zip(texts, none, strict=True)]
    monkeypatch.setattr(contextmix, "CHUNK", 3)
    assert np.allclose(whole, mixer.score(texts, none, True)) and np.allclose(whole, alone)


def test_match_predicts_until_it_fails():
    ids = np.arange(10)
    got = contextmix.matches(ids, [(2, np.array([3, 4, 9, 6])), (7, np.array([8, 9, 10]))])
    assert got.tolist() == [-1, -1, -1, 3, 4, 9, -1, -1, 8, 9]


def test_numbers_round_trip():
    ids = np.array([0, 1, 127, 128, 0xD800, 0xDFFF, 65536, 1114111])
    assert contextmix.unpack(contextmix.pack(ids)).tolist() == ids.tolist() and len(contextmix.unpack(contextmix.pack(ids[:0]))) == 0


def test_copies_of_training_texts_are_likelier(spark):
    """A held-out copy of one training text, by a match; and a training text that occurs twice, though its own counts are taken out."""
    r = np.random.default_rng(5)
    make = lambda: " ".join(f"w{k}" for k in r.integers(0, 300, 150))
    texts = [make() for _ in range(120)]
    rows = [(k, t, True) for k, t in enumerate(texts)] + [(200, texts[7], False), (201, make(), False), (202, texts[9], True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {x["doc_id"]: x for x in contextmix.score(df, F.col("train")).collect()}
    # An anchor comes once in 16 words, so a good part of a copy is foretold.
    assert got[200]["score"] > 0.6 * got[201]["score"] and got[9]["score"] > 0.6 * got[10]["score"] and got[202]["score"] > 0.6 * got[10]["score"]


def test_better_than_base_on_held_out(spark):
    """Base gives a new word the share of one word though it must be spelled, so known words decide."""
    rows = contextmix.op7_context_mixing(spark, SF.replace("0.001", "0.01")).collect()
    held = [r for r in rows if r["held_out"] and r["n_known"] > 0.9 * r["n_tokens"]]
    assert len(held) > 20 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_odd(spark, odd):
    for training in (F.lit(True), F.lit(False), F.col("doc_id") == 2):
        rows = contextmix.score(odd, F.coalesce(training, F.lit(False)), frequent=2).collect()
        assert len(rows) == 10 and all(r["n_tokens"] >= 1 and math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert contextmix.score(odd.limit(0), F.lit(True)).count() == 0


def test_small_vocabulary(spark, documents):
    """Counts and base don't depend on the size of the vocabulary."""
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(False))
    a, b = ({r["doc_id"]: r for r in contextmix.score(documents, training, class_col="lang", frequent=f).collect()} for f in (1 << 16, 10))
    assert all(math.isclose(a[i]["base_score"], b[i]["base_score"], rel_tol=1e-9) and a[i]["n_known"] == b[i]["n_known"] for i in a)
    assert all(math.isfinite(b[i]["score"]) and b[i]["score"] < 0 for i in a)


def test_same_scores_whatever_the_partitions(spark, documents):
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(False))
    a, b = ({r["doc_id"]: r["score"] for r in contextmix.score(documents.repartition(n, "doc_id"), training, class_col="lang").collect()} for n in (1, 5))
    # Which of two earlier texts a match comes from may differ.
    assert np.mean([abs(a[i] - b[i]) < 1e-3 * abs(a[i]) for i in a]) > 0.9


def test_anchors_of_many_texts_at_once():
    draw = np.random.default_rng(3)
    texts = [draw.integers(0, 50, n) for n in (0, 1, 5, 6, 400, 7, 0, 3000, 20)]
    for together in (1, 500, 1 << 14):
        found = contextmix.anchors_of(texts, together)
        assert len(found) == len(texts) and all(np.array_equal(a, contextmix.anchors(t)) for a, t in zip(found, texts, strict=True))


def test_code_takes_little_memory():
    """The paths of all words are not held as a matrix of words by greatest depth."""
    import tracemalloc

    counts = [2**k for k in range(60)] + [1] * 60_000
    tracemalloc.start()
    code = contextmix.Code(counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    for symbol in (0, 30, 59, 60, 60_059):
        steps = code.steps[code.offset[symbol] :][: code.length[symbol]]
        assert (steps >> 1 & 127).tolist() == list(range(len(steps)))
        assert sum(int(b) << (63 - k) for k, b in enumerate(steps & 1) if k < 64) == int(code.left[symbol])


def test_equal_words_in_equal_contexts_are_decided_once(monkeypatch):
    code = contextmix.Code([3, 2, *range(40, 0, -1)])
    mixer = contextmix.WordMixer(code, np.array([1, 1] + [0] * 40), 1, 10)
    text = np.append(np.tile(np.arange(2, 42), 50), contextmix.END)
    texts, predicted, decided = [text] * 20, [np.full(len(text), -1)] * 20, []
    decide = contextmix.WordMixer._decide
    monkeypatch.setattr(contextmix.WordMixer, "_decide", lambda self, *a: (out := decide(self, *a), decided.append(len(out[1])))[0])
    slots = contextmix.Tally(2 * mixer.n_slots)
    mixer.tally(slots, texts, predicted)
    total = 20 * int(code.length[text].sum())
    assert slots.total().sum() == 2 * total and sum(decided) * 10 < total
    mixer.mixer.seen = contextmix.evidence(slots.total().reshape(-1, 2))
    cells = contextmix.Tally(mixer.mixer.n_cells)
    mixer.observe(cells, texts, predicted)
    assert cells.total().sum() == total
    mixer.mixer.learn(cells.total())
    assert np.allclose(mixer.score(texts, predicted, True), mixer.score(texts[:1], predicted[:1], True)[0])
