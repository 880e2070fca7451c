"""Quality by compression: two zstandard dictionaries, built from good and from bad labelled text.

A text is cut into blocks; each is compressed once with either dictionary. The difference of the two total sizes over
their greater is near zero where neither dictionary knows more of the text; a logistic curve fitted on other labelled
rows turns it into the probability of label 1.

Training reads a bounded sample of labelled rows (``per_class`` rows of each label for the dictionaries and as many for
the curve, the least by a hash of the id). Scoring reads whole texts and nothing else.

Defined results: a null or empty text has difference 0; equal texts score equal; repeated labels of one document count
once (the least); texts of any length are compressed whole, block by block; an empty table gives none; without labels of both kinds every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlstrata.llm.common import bounded_sample, id_crc32, map_arrow, table, utf8


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    block: int = 1024
    level: int = 3

    def differ(self):
        """A function of a text's bytes: (size with bad - size with good) / greater size."""
        make = lambda d: zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress
        if not self.good or not self.bad:
            return lambda text: 0.0
        good, bad, block = make(self.good), make(self.bad), self.block

        def difference(text: bytes) -> float:
            a = b = 0
            for k in range(0, len(text), block):
                piece = text[k : k + block]
                a += len(good(piece))
                b += len(bad(piece))
            return (b - a) / max(a, b, 1)

        return difference

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.offset, -40, 40)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, counts: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method. counts: how often each (x, y) occurs."""
    features = np.column_stack((x, np.ones(len(x))))
    n = np.ones(len(x)) if counts is None else counts
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -40, 40)))
        slope = features.T @ (n * (y - p)) - ridge * w
        curve = (features * (n * p * (1 - p))[:, None]).T @ features + ridge * np.eye(2)
        move = np.linalg.solve(curve, slope)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1500, dictionary_bytes: int = 32 << 10, sample_bytes: int = 2048, most_bytes: int = 16 << 10) -> CompressionModel:
    """Fit on at most 4 * ``per_class`` labelled rows among those that ``learn`` (a condition on the id) admits.

    Of these rows only texts of at most ``most_bytes`` are learned from, so the driver holds 4 * per_class * most_bytes (94 MB) at most.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy(id_col).agg(F.min(label_col).cast("int").alias("_good"))
    of = lambda y: bounded_sample(known.where(F.col("_good") == y), id_col, 2 * per_class)
    chosen = of(0).unionByName(of(1))
    rows = docs.select(id_col, utf8(text_col).alias("_text")).where(F.octet_length("_text") <= most_bytes).join(F.broadcast(chosen), id_col).select("_good", F.xxhash64(id_col).alias("_order"), "_text").toArrow()
    order = np.lexsort((rows["_order"].to_numpy(),))
    texts = [rows["_text"][int(k)].as_py() for k in order]
    labels_ = rows["_good"].to_numpy()[order]
    groups = {y: [t for t, z in zip(texts, labels_, strict=True) if z == y] for y in (0, 1)}
    if not groups[0] or not groups[1]:
        share = len(groups[1]) / max(1, len(texts)) if texts else 0.5
        return CompressionModel(b"", b"", 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    dictionaries = {y: _dictionary(g[::2], dictionary_bytes, sample_bytes) for y, g in groups.items()}
    model = CompressionModel(dictionaries[1], dictionaries[0], 0.0, 0.0)
    rest = {y: g[1::2] or g for y, g in groups.items()}
    differ = model.differ()
    x = np.array([differ(t) for y in (0, 1) for t in rest[y]])
    y = np.repeat([0, 1], [len(rest[0]), len(rest[1])])
    model.slope, model.offset = fit_curve(x, y.astype(float))
    return model


def _dictionary(texts: list[bytes], size: int, sample_bytes: int) -> bytes:
    """A trained dictionary of the pieces of all texts; the texts themselves if they are too few to train on."""
    pieces = [t[k : k + sample_bytes] for t in texts for k in range(0, len(t), sample_bytes)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:] or b"\0" * 8


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: id, difference, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differ = model.differ()
        for batch in batches:
            x = np.array([differ(t.as_py()) for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(model.probability(x))], ["id", "x", "p"])

    return map_arrow(docs.select(id_col, utf8(text_col).alias("_text")), run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, difference double, score double")


def op5_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels come from two thirds of the rows only."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc32("doc_id") % 3 == 1
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_zstd_quality": op5_zstd_quality}
