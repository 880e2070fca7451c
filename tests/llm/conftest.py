import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, ties, and columns whose names could clash."""
    long = "word " * 30000 + "end"
    rows = [(0, None), (1, ""), (2, "a b c d e f g"), (2, "a b c d e f g"), (None, "x y z"), (None, None), (5, long), (6, " \n\t "), (7, "ünï côdé 日本 #1 |"), (8, long)]
    schema = "doc_id long, text string, slot int, shard int, row int, key string, word string, fp long, name string, _text string, value int, lang string"
    return spark.createDataFrame([(i, t, 1, 2, 3, "k", "w", 4, "n", "t", 5, "en") for i, t in rows], schema)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()
