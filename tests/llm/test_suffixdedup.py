import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from crawlstrata.llm import suffixdedup as S
from tests_llm_data import SF

L = 400


def brute(texts, length=L):
    """For each text, which bytes go."""
    seen = Counter(hashlib.md5(t[k : k + length]).digest() for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if seen[hashlib.md5(t[k : k + length]).digest()] > 1:
                m[k] += 1
                m[k + length] -= 1
        out.append(np.cumsum(m)[:-1] > 0)
    return out


def expected(texts):
    rows = []
    for t, gone in zip(texts, brute(texts), strict=True):
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if t else b""
        rows.append((len(t), int(gone.sum()), len(S.runs_of(gone)), hashlib.sha256(kept).hexdigest()))
    return rows


def made(seed):
    r = random.Random(seed)
    alphabet = ["ab", "abcdefgh", "".join(map(chr, range(32, 127)))][seed % 3]
    rnd = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    passages = [rnd(r.randint(300, 1300)) for _ in range(4)]
    texts = ["", "x" * 399, "y" * 400, "z" * 401, "xyz " * 400, None]
    for _ in range(25):
        texts.append("".join(r.choice(passages)[(q := r.randint(0, 300)) : q + r.randint(0, 1200)] if r.random() < 0.5 else rnd(r.randint(0, 700)) for _ in range(r.randint(0, 4))))
    return texts + texts[6:9]


@pytest.mark.parametrize("seed,hot", [(1, 20000), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, hot):
    texts = made(seed)
    monkeypatch.setattr(S.repeated_spans, "__defaults__", ("text", 400, 64, hot))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.dedup(df, text=False).collect()}
    assert got == dict(enumerate(expected([(t or "").encode() for t in texts])))


def test_sorted_suffixes_of_any_residue():
    r = random.Random(5)
    rnd = lambda n, a: bytes(r.choice(a) for _ in range(n))
    for size in (40, 900, 1 << 18):
        p = rnd(900, b"abcd")
        t = rnd(r.randint(500, 900), b"ab") + p + rnd(r.randint(0, 100), b"ab") + p[50:800] + rnd(300, b"ab") + p[10:500]
        starts = np.arange(len(t) - L + 1)
        seen = Counter(t[k : k + L] for k in starts)
        want = np.array([seen[t[k : k + L]] > 1 for k in starts])
        assert (S.repeated_starts(np.frombuffer(t, np.uint8), starts, L, size) == want).all() and want.any()


def test_cover():
    assert len({(a - b) % S.PERIOD for a in S.COVER for b in S.COVER}) == S.PERIOD


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = dict(zip([r["doc_id"] for r in rows], expected([(r["text"] or "").encode() for r in rows]), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.op6_difference_cover_dedup(spark, SF).collect()}
    assert got == want


def test_odd(spark, odd):
    rows = S.dedup(odd).collect()
    assert len(rows) == 10
    assert {r["n_removed"] for r in rows if r["doc_id"] in (5, 8)} == {150003}
    kept = S.strip_repeats(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 0, 1, 2, 2, 6, 7]
    assert S.dedup(odd.limit(0)).count() == 0 and S.strip_repeats(odd.limit(0)).count() == 0


def test_characters_stay_whole(spark):
    p = "ä" * 10 + "".join(chr(0x4E00 + k) for k in range(300))
    df = spark.createDataFrame([(1, "é1" + p + "2é", 0), (2, "è3" + p + "4ë", 0)], "doc_id int, text string, n_chars int")
    rows = {r["doc_id"]: r for r in S.strip_repeats(df).collect()}
    assert rows[1]["text"] == "é12é" and rows[2]["text"] == "è34ë" and rows[1]["n_chars"] == 4


def test_split_bound_does_not_grow(spark, monkeypatch):
    """A bucket just below a 500th of all suffixes is split like any other above the bound, with the same results."""
    r = random.Random(9)
    rnd = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = rnd(450)
    texts = [rnd(40_000) for _ in range(30)] + [rnd(60) + passage + rnd(500) for _ in range(10)]
    sent = []
    places = S._places

    def noted(*a):
        out = places(*a)
        sent.append(out.collect())  # the tables it reads go later
        return out

    monkeypatch.setattr(S, "_places", noted)
    monkeypatch.setattr(S.repeated_spans, "__defaults__", ("text", 400, 64, 5))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in S.dedup(df, text=False).collect()}
    assert got == dict(enumerate(expected([t.encode() for t in texts])))
    total = sum(len(S.buckets(t.encode(), 400, 64)) for t in texts)
    sizes = Counter((x["name"], x["hot"]) for x in sent[0])
    assert 5 < max(sizes.values()) < total // 500
    assert all(hot == (n > 5) for (_, hot), n in sizes.items())
