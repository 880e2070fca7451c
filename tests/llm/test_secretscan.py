import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from crawlstrata.llm import secretscan as S
from crawlstrata.llm.common import stash

KEY = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain(text):
    """Base findings by the patterns as they are written."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(KEY, text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


@pytest.fixture(scope="module")
def documents_10k(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


@pytest.fixture(scope="module")
def scanned(documents_10k):
    return stash(S.scan(documents_10k))


@pytest.fixture(scope="module")
def model(scanned):
    return S.train(scanned)


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k + ":") for x in want) for k in S.KINDS]
        assert [x for x in r.spans.split(",") if x and not x.startswith(S.LEARNED)] == want


def test_base_against_patterns(spark, scanned, model, documents_10k):
    check(S.digests(S.findings(scanned, model)).collect(), {r.doc_id: r.text for r in documents_10k.select("doc_id", "text").collect()})


def test_base_of_odd_texts(spark, model):
    draw = random.Random(3)
    bits = ["token", "Secret", "PASSWD", "api_key", "apikey", " ", "=", ":", '"', "'", "AKIA", "0123abcd" * 3, "ABCDEFGH1234", "é", "\n", "x", "Kſ", "日", "passWord:  '", "deadbeef"]
    texts = {k: "".join(draw.choices(bits, k=draw.randrange(1, 30))) for k in range(800)} | {800: None, 801: "", 802: "token: token: abcdef", 803: "ſecret=abcdefgh", 804: "api_Key=abcdefgh", 805: "a1" * 5000, 806: "AKIAAKIA" + "Z" * 15}
    docs = spark.createDataFrame([(k, t, "r", 1, "b") for k, t in texts.items()], "doc_id long, text string, row string, spans int, base string")
    check(S.digests(S.findings(S.scan(docs), model)).collect(), texts)


def test_odd_rows(odd):
    rows = S.digests(S.findings(S.scan(odd), None)).collect()
    assert len(rows) == 10 and all(r.spans == "" and r.n_hex == 0 for r in rows)
    assert S.scan(odd.limit(0)).collect() == [] and S.train(S.scan(odd)) is None


def test_network_finds_other_forms_and_leaves_plain_ones(spark, model):
    draw = random.Random(9)
    secret = ["".join(draw.choices(S._LETTERS, k=40)) for _ in range(40)]
    clean = ["internationalization", "user.name@mail7.example.com", "4948898070326032", "https://example.com/some/path/page.html", "some_snake_case_variable_name", "ThisIsACamelCaseName", "2024-01-01T00:00:00", "====================", "/usr/local/lib/python3/site-packages"]
    rows = spark.createDataFrame(list(enumerate([f"and here {s} ends" for s in secret] + [f"and here {c} ends" for c in clean])), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in S.findings(S.scan(rows), model).collect()}
    caught = [k for k in range(40) if [(s.kind, s.start, s.end) for s in found[k]] == [(S.LEARNED, 9, 49)]]
    assert len(caught) >= 32
    assert not any(found[k] for k in range(40, 40 + len(clean)))


def test_recall_and_few_additions_on_the_corpus(scanned, model):
    """The network alone finds what the rules found, by its own thresholds, and adds little beside it."""
    rows = scanned.select("candidates").collect()
    seen = [c for r in rows for c in r.candidates]
    codes = np.frombuffer(b"".join(c["windows"][: S.WINDOW] for c in seen), np.uint8).reshape(-1, S.WINDOW)
    over = model.probability(codes) >= np.array(model.thresholds)[[c["class"] for c in seen]]
    found = np.array([c.found for c in seen])
    assert over[found].mean() >= 0.95 and over[~found].mean() <= 0.002


def test_candidates_longer_than_a_piece_are_seen_whole(spark, model):
    """The secret stands in the last piece of a long run."""
    secret = "".join(random.Random(1).choices(S._LETTERS, k=64))
    text = "-" * 640 + secret
    (row,) = S.findings(S.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")), model).collect()
    assert [(s.kind, s.start, s.end) for s in row.spans] == [(S.LEARNED, 0, len(text))]


def test_gradient():
    net = S.Network(1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    codes = np.random.default_rng(0).integers(0, 2 * S.CODES, (3, S.WINDOW))
    slope = np.array([0.3, -0.7, 0.2])
    grad = net.gradient(slope, net.forward(codes)[1])
    for name, at in (("embed", (codes[0, 5], 2)), ("conv3", (4, 1)), ("conv7", (9, 3)), ("bias7", (2,)), ("hidden", (5, 2)), ("hidden0", (1,)), ("out", (3,)), ("out0", (0,))):
        kept, sums = net.weights[name][at], []
        for step in (1e-6, -1e-6):
            net.weights[name][at] = kept + step
            sums.append(float(slope @ net.forward(codes)[0]))
        net.weights[name][at] = kept
        assert abs((sums[0] - sums[1]) / 2e-6 - grad[name][at]) < 1e-4


def test_all_candidates_are_learned_from(scanned, monkeypatch):
    """Every distinct window is in a group that learns, or in the tally that calibrates, whatever their number; groups are bounded and none lacks findings."""
    from pyspark.sql import functions as F

    learned, counted = [], []
    round_, tally = S._round, S._tally
    monkeypatch.setattr(S, "_round", lambda dealt, *a: (learned.append(dealt.groupBy("group").agg(F.count("*").alias("n"), F.count_if("found").alias("found"), F.count_distinct("window").alias("d")).collect()), round_(dealt, *a))[1])
    monkeypatch.setattr(S, "_tally", lambda *a: (counted.append(tally(*a)), counted[-1])[1])
    few = scanned.where("row % 4 = 0")
    model = S.train(few, group=2000, steps=20)
    assert model and len(model.thresholds) == S.CLASSES
    seen = {(bytes(c["windows"][: S.WINDOW]), c["found"]) for r in few.select("candidates").collect() for c in r.candidates}
    rest = sum(1 for w, found in seen if not found and zlib.crc32(w) % 4 != 3)
    groups = [r for rows in learned for r in rows]
    assert len(groups) == len({r.group for r in groups}) > 3 and sum(r.n - r.found for r in groups) == rest
    assert all(r.found > 0 and r.n < 3000 for r in groups)
    assert sum(counted[0]["n"].to_pylist()) == 4 * sum(zlib.crc32(w) % 4 == 3 for w, _ in seen)


def test_curve_and_threshold_by_counts():
    x, y, n = np.array([-2.0, -1, 0, 1, 2]), np.array([0.0, 0, 1, 0, 1]), np.array([5, 3, 2, 1, 7])
    assert np.allclose(S.fit_curve(x, y, 1e-2, n), S.fit_curve(np.repeat(x, n), np.repeat(y, n), 1e-2))
    assert S.threshold(x, 0.6, n) == S.threshold(np.repeat(x, n), 0.6)
