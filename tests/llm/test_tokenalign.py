import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from tokenizers import Tokenizer

from crawlstrata.llm import tokenalign as T
from crawlstrata.llm.bpe import byte_alphabet
from crawlstrata.llm.common import stash

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tokens():
    """Plain tokenization by the libraries: (id, bytes) of both sides."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    value = {c: k for k, c in enumerate(byte_alphabet())}

    def of(text):
        left = [(t, bytes(value[c] for c in a.id_to_token(t))) for t in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(t, bytes([int(b.id_to_piece(t)[1:-1], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode()) for t in b.encode(text)]
        return left, right

    return of


def plain(rows, tokens):
    """The contract, text by text."""
    out, links = [], []
    for i, text in rows:
        left, right = tokens(text) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
            left, right = [], []
        ends, at = {}, 0
        for k, (_, x) in enumerate(left):
            at += len(x)
            ends[at] = k
        here, groups, at, a0, b0 = [], [], 0, 0, 0
        for k, (t, x) in enumerate(right):
            at += len(x)
            if at in ends:
                here.append((left[ends[at]][0], t))
                groups.append(",".join(str(u) for u, _ in left[a0 : ends[at] + 1]) + "|" + ",".join(str(u) for u, _ in right[b0 : k + 1]))
                a0, b0 = ends[at] + 1, k + 1
        links.append(here)
        out.append((i, len(left), len(right), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    count = Counter(p for x in links for p in x)
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    return [(i, a, b, len(x), len(x), sum(count[p] == highest[p[1]] for p in x), sum(count[p] for p in x), s) for (i, a, b, s), x in zip(out, links, strict=True)]


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("block_bytes", [1, 20_000, T.BLOCK_BYTES])
def test_links_against_plain(spark, tokens, block_bytes):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = T.link_counts(docs, T.Tokenizers.default(), block_bytes=block_bytes).select(*COLUMNS)
    assert order(tuple(r) for r in got.collect()) == order(plain([(r.doc_id, r.text) for r in docs.collect()], tokens))


def test_odd_rows(spark, odd, tokens):
    more = [(20, "a ▁ b"), (21, "<|endoftext|> <s></s> <0x41>"), (22, "x\0y\r\n\t  z"), (23, "\U0001f9d1‍\U0001f680 naïve Ωμέγα"), (24, " " * 50), (25, "é́" * 9)]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = T.link_counts(docs, T.Tokenizers.default()).select(*COLUMNS).collect()
    assert order(tuple(r) for r in got) == order(plain([(r.doc_id, r.text) for r in docs.collect()], tokens))
    zero = {r.doc_id: r for r in got}[20]
    assert (zero.n_a, zero.n_links, zero.groups_sha256) == (0, 0, "")
    assert T.link_counts(docs.limit(0), T.Tokenizers.default()).collect() == []


def test_bytes_that_are_no_utf8(spark):
    docs = spark.createDataFrame([(1, bytearray(b"ab \xff cd"))], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    (r,) = T.link_counts(docs, T.Tokenizers.default()).collect()
    assert (r.n_a, r.n_b, r.n_groups) == (0, 0, 0)


def test_groups_and_overlaps(spark, tokens):
    texts = [(1, "Tokenization of über-long words, 12345!"), (2, None), (3, "x")]
    got = {r.doc_id: r for r in T.align(spark.createDataFrame(texts, "doc_id long, text string"), T.Tokenizers.default(), block_bytes=1).collect()}
    assert got[2].a_ids == [] and got[2].b_first == []
    for i, text in ((1, texts[0][1]), (3, "x")):
        left, right = tokens(text)
        r = got[i]
        assert (r.a_ids, r.b_ids) == ([t for t, _ in left], [t for t, _ in right])
        assert r.a_ends[-1] == len(left) and r.b_ends[-1] == len(right)
        ends_a, ends_b = np.cumsum([len(x) for _, x in left]), np.cumsum([len(x) for _, x in right])
        assert [ends_a[k - 1] for k in r.a_ends] == [ends_b[k - 1] for k in r.b_ends] == sorted(set(ends_a) & set(ends_b))
        for k in range(len(left)):
            a, b = ends_a[k] - len(left[k][1]), ends_a[k]
            over = [j for j in range(len(right)) if ends_b[j] > a and ends_b[j] - len(right[j][1]) < b]
            assert (r.b_first[k], r.b_last[k]) == (over[0], over[-1])


def test_gallop():
    draw = np.random.default_rng(1)
    for size in (1, 2, 3, 50, 1000):
        longer = np.unique(draw.integers(0, 5 * size, size))
        keys = draw.integers(0, longer[-1] + 1, 300)
        for guess in (draw.integers(0, len(longer), 300), np.zeros(300, int), np.full(300, len(longer) - 1)):
            assert (T.gallop(keys, guess, longer) == np.searchsorted(longer, keys)).all()


def test_hot_pairs_by_broadcast_and_others_agree(spark, monkeypatch, tokens):
    rows = [(k, f"the word {k} and the rest of it") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = order(plain(rows, tokens))
    for share in (1, 3, 100000):
        monkeypatch.setattr(T, "HOT_SHARE", share)
        assert order(tuple(r) for r in T.link_counts(docs, T.Tokenizers.default(), block_bytes=40).select(*COLUMNS).collect()) == want


def test_no_row_holds_a_whole_block(spark, monkeypatch):
    """Rows between the steps are those of a text or a pair, and none is gathered from a block's pairs: a task's memory does not grow with the blocks that it has."""
    kept = []
    monkeypatch.setattr(T, "stash", lambda df: kept.append(stash(df)) or kept[-1])
    found = T.link_counts(spark.createDataFrame([(k, f"some words {k} and more of them") for k in range(300)], "doc_id long, text string"), T.Tokenizers.default())
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    assert kept and not [f for df in kept for f in df.schema if isinstance(f.dataType, ArrayType)]
    assert kept[0].agg(F.max(F.octet_length("places"))).first()[0] <= 4 * 20 and found.count() == 300
