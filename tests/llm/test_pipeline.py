import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from crawlstrata.llm import bpe
from crawlstrata.llm.common import stash, table
from test_decontaminate import brute as contaminated
from test_nearcopies import near_pairs
from test_repeatedwords import brute as repeated
from tests_llm_data import SF


def test_pipeline(spark):
    """Each stage against a plain version on its own input."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    lib.no_truncation()
    lib.no_padding()
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stash(stage(spark, docs, SF))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.count() == len(after) and after.keys() <= before.keys()
        if name != "tokenize":
            assert docs.columns == columns
        if name == "toxicity":
            assert len(after) > 0.8 * len(before)
        elif name == "near_duplicates":
            # The stage's rule is five words and a similarity of 0.8.
            pairs = near_pairs(list(before), [r["text"] for r in before.values()])
            root = {i: i for i in before}
            for _ in before:
                for a, b in pairs:
                    root[a] = root[b] = min(root[a], root[b])
            assert after.keys() == {i for i in before if root[i] == i}
        elif name == "repeated_passages":
            # The stage's rule is more than 50 words.
            texts = [(r["text"] or "").encode() for r in before.values()]
            for i, t, left in zip(before, texts, repeated(texts), strict=True):
                assert (i in after) == (left == t or left.strip() != b"")
                if i in after:
                    assert (after[i]["text"] or "").encode() == left and (left == t or after[i]["n_chars"] == len(left.decode()))
        elif name == "decontamination":
            assert after.keys() == {i for i, r in before.items() if not contaminated(r["text"], items)[4]}
        else:
            for i, r in before.items():
                ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
                assert after[i]["n_tokens"] == len(ids) and bytes(after[i]["ids"]) == np.array(ids, "<u4").tobytes()
                assert after[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_odd_run(spark, odd, tmp_path):
    """Nulls, empty and very long texts, repeated rows, ties, and columns whose names could clash, through all stages; and empty tables."""
    for name, n in (("odd", 100), ("none", 0)):
        odd.limit(n).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(2, 1, 0), (7, 0, 1), (None, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int").limit(n).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([("i1", "x y z"), ("i2", None), (None, "")], "item_id string, text string").limit(n).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    docs = table(spark, f"{tmp_path}/odd", "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, f"{tmp_path}/odd"))
        assert docs.columns == odd.columns, name
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    # One of each group of equal texts; the very long text repeats itself and goes; "x y z" is a benchmark item.
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in rows) == sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in docs.collect())
    assert {2, 0} <= {r["doc_id"] for r in rows} and 8 not in {r["doc_id"] for r in rows}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
