import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from crawlstrata.llm import bpe
from tests_llm_data import SF


def library():
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_words_against_library():
    own, lib, r = bpe.loaded(bpe.default_vocabulary()), library(), random.Random(1)
    texts = ["", " ", "Hello's WORLD <|endoftext|> x<|startoftext|>y", "ΑΣ ΟΔΟΣ Σ", "İstanbul ﬁ", "日本語", "é  x y\x1cz", "a" * 500, "ha" * 300, "123 4½", "!!!???...---", "👩‍👩‍👧‍👦 🇩🇪", "\x00\x7f"]
    texts += ["".join(r.choice("abcdeinthorst'sé") for _ in range(r.randint(1, 30))) for _ in range(3000)]
    texts += ["".join(r.choice("ab") for _ in range(r.randint(1, 80))) for _ in range(500)]
    for text in texts:
        want = lib.encode(text, add_special_tokens=False).ids
        code = own.encode(text)
        assert np.frombuffer(code, "<u4").tolist() == want, text
        assert own.decode(code).decode() == lib.decode(want, skip_special_tokens=False)


def test_query(spark):
    lib, want = library(), {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op9_backtracking_bpe(spark, SF).collect()}
    assert got == want


def test_odd(spark, odd):
    coded = bpe.encode(odd, bpe.default_vocabulary())
    rows = coded.collect()
    assert len(rows) == 10 and sum(r["n_tokens"] == 0 for r in rows) == 4
    assert bpe.encode(odd.limit(0), bpe.default_vocabulary()).count() == 0
    back = bpe.decode(coded, bpe.default_vocabulary()).collect()
    assert [r["decoded"] for r in back if r["doc_id"] == 1] == [""]
