import random
import re
from collections import Counter

import corpus_pipeline
from crawlstrata.llm import suffixdedup as S
from tests_llm_data import SF

WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")


def brute(texts, n=51):
    """What is left of each text without the words that repeated runs of n words cover."""
    words = [t.split() for t in texts]
    seen = Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1))
    out = []
    for t, w in zip(texts, words, strict=True):
        gone = set()
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone |= set(range(k, k + n))
        places = [m.span() for m in WORD.finditer(t)]
        cut = bytearray(t)
        for k in sorted(gone, reverse=True):
            end = places[k + 1][0] if k + 1 in gone else places[k][1]
            del cut[places[k][0] : end]
        out.append(bytes(cut))
    return out


def test_passages_of_short_words(spark):
    """51 words go, of about 200 bytes; 50 words stay; so do 60 words of which no run of 51 is repeated as a whole."""
    r = random.Random(4)
    some = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 4))) for _ in range(n)]
    p51, p50, p60 = some(51), some(50), some(60)
    parts = [(p51, 0, 51), (p51, 0, 51), (p50, 0, 50), (p50, 0, 50), (p60, 0, 60), (p60, 0, 35), (p60, 25, 60)]
    texts = [" ".join(some(40)) + "\n" + "  ".join(p[a:b]) + " " + " ".join(some(33)) for p, a, b in parts] + ["", " \t", None, " ".join(p51)]
    df = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(texts)], "doc_id int, text string, n_chars int")
    got = {x["doc_id"]: x for x in corpus_pipeline.repeated_passage_stage(spark, df, SF).collect()}
    want = brute([(t or "").encode() for t in texts])
    assert set(got) == set(range(10))
    for k, x in got.items():
        assert (x["text"] or "").encode() == want[k] and x["n_chars"] == len(want[k])
    assert [len(texts[k]) > got[k]["n_chars"] for k in range(7)] == [True] * 2 + [False] * 5


def test_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r["doc_id"]: t.decode() for r, t in zip(rows, brute([(r["text"] or "").encode() for r in rows]), strict=True)}
    got = {x["doc_id"]: x["text"] or "" for x in S.strip_repeated_words(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == {r["doc_id"]: want[r["doc_id"]] for r in rows if want[r["doc_id"]] == (r["text"] or "") or want[r["doc_id"]].strip()}
    assert any(want[r["doc_id"]] != (r["text"] or "") for r in rows)


def test_columns_of_any_name_stay(spark):
    """Input columns with the names of helpers, also with underscores before them, are kept as they are."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    rows = [(k, f"{word()} {passage} {word()}", "a", True, [k], b"b", 7) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __key__ string, __whole__ boolean, __SPANS__ array<int>, _key binary, n_chars int")
    got = S.strip_repeated_words(df)
    assert got.columns == df.columns
    assert sorted((x["doc_id"], x["__key__"], x["__whole__"], x["__SPANS__"], x["_key"], len(x["text"].split())) for x in got.collect()) == [(k, "a", True, [k], b"b", 2) for k in range(2)]
    long = df.selectExpr("doc_id", "repeat(text, 20) as text", "__key__", "__whole__")
    assert S.strip_repeats(long).columns == long.columns and S.strip_repeats(long).count() >= 0
