"""Toxicity by cumulative-link (proportional-odds) ordinal regression over sparse word features.

P(grade > k) = sigmoid(w.x - threshold_k): all thresholds share the weights. x marks which selected words and
word beginnings a text holds. The expected severity is the sum over k of P(grade > k).

Training reads a bounded sample of labelled rows (``sample`` rows, the least by a hash of the id, so the same at every
run); scoring reads whole texts. The labels say only toxic or not, so the query grades toxic rows by evidence: grade 1
with one distinct marker word, 2 with more. A marker is a word far more frequent among the toxic rows of the sample.

Defined results: a null or empty text has no features and gets the base rate; repeated labels of one document count
once (the greatest); with no labels, or labels of one kind only, no text is toxic and severity is that kind's. Rows
are scored one by one, whole at any length, so ties and repeated rows get equal scores; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlstrata.llm.common import bounded_sample, map_arrow, table, utf8

FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 or c == 39 else 32 for c in range(256))


#: Lengths of the word beginnings that are features, in bytes: they meet inflected forms of a stem.
STEMS = (4, 5, 6)


def features(text: bytes) -> set[bytes]:
    """The distinct words of a text, and their beginnings, marked by an asterisk."""
    words = set(text.translate(FOLD).split())
    return words.union(*({w[:n] + b"*" for w in words if len(w) > n} for n in STEMS))


@dataclass
class OrdinalModel:
    weights: dict[bytes, float]
    thresholds: list[float]

    def above(self, text: bytes) -> list[float]:
        """P(grade > k) for each threshold."""
        eta = sum(map(self.weights.__getitem__, features(text) & self.weights.keys()))
        return [1 / (1 + np.exp(t - eta)) if t - eta < 700 else 0.0 for t in self.thresholds]


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, l1: float = 1e-5, steps: int = 600, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds: Adam on the mean log-likelihood with an L1 penalty, at a falling rate.

    Thresholds are the first one and the logarithms of the gaps above it, so they stay in order.
    """
    k_most, n = int(grades.max()), len(rows)
    where = np.repeat(np.arange(n), [len(r) for r in rows])
    cols = np.concatenate(rows) if len(where) else np.zeros(0, np.int64)
    share = np.array([np.clip((grades > k).mean(), 1e-6, 1 - 1e-6) for k in range(k_most)])
    first = -np.log(share / (1 - share))
    x = np.concatenate((np.zeros(n_features), first[:1], np.log(np.maximum(np.diff(first), 1e-2))))
    m, v = np.zeros_like(x), np.zeros_like(x)
    every = np.arange(n)
    thresholds = lambda x: x[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(x[n_features + 1 :]))))
    for step in range(1, steps + 1):
        w, theta = x[:n_features], thresholds(x)
        eta = np.bincount(where, w[cols], n)
        p = 1 / (1 + np.exp(np.clip(theta[:, None] - eta[None, :], -40, 40)))
        e = np.vstack((np.ones(n), p, np.zeros(n)))
        up, down = e[grades, every], e[grades + 1, every]
        bend = p * (1 - p) / np.maximum(up - down, 1e-9)
        of_theta = np.array([(bend[k] * ((grades == k) * 1.0 - (grades == k + 1))).mean() for k in range(k_most)])
        of_gaps = np.cumsum(of_theta[::-1])[::-1][1:] * np.exp(x[n_features + 1 :])
        g = np.concatenate((np.bincount(cols, (1 - up - down)[where], n_features) / n - l1 * np.sign(w), [of_theta.sum()], of_gaps))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * 0.5 * (1 + np.cos(np.pi * step / steps)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    w = x[:n_features]
    return np.where(np.abs(w) < 0.05, 0.0, w), thresholds(x)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 12000, n_features: int = 2048, least_evidence: float = 5.4) -> OrdinalModel:
    """Fit on at most ``sample`` labelled rows; these ids (16 bytes each) are broadcast, and at most ``n_features`` words, those whose log-likelihood ratio exceeds ``least_evidence``, reach the driver."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_toxic"))
    chosen = bounded_sample(chosen, id_col, sample)
    rows = docs.select(id_col, utf8(text_col).alias("_text")).join(F.broadcast(chosen), id_col).select("_toxic", "_text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(found, pa.list_(pa.binary()))], ["toxic", "words"])

    held = map_arrow(rows, split, "toxic int, words array<binary>").persist()
    try:
        sizes = {bool(r["toxic"]): r["n"] for r in held.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        bad, good = sizes.get(True, 0), sizes.get(False, 0)
        if not bad or not good:
            return OrdinalModel({}, [-50.0 if bad else 50.0])
        counts = held.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("b"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("g"))
        n = bad + good
        term = lambda seen, of: F.when(seen > 0, seen * F.log(seen * F.lit(float(n)) / ((F.col("b") + F.col("g")) * F.lit(float(of))))).otherwise(0.0)
        score = term(F.col("b"), bad) + term(F.col("g"), good)
        best = counts.where("b + g > 1").withColumn("score", score).where(F.col("score") > least_evidence).orderBy(F.desc("score"), "word").limit(n_features).collect()
        place = {bytes(r["word"]): k for k, r in enumerate(best)}
        marker = np.array([r["word"][-1:] != b"*" and r["b"] >= 2 and r["b"] / bad > 10 * (r["g"] + 0.5) / good for r in best], bool)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [[place[w.as_py()] for w in x.values if w.as_py() in place] for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["toxic", "at"])

        coded = map_arrow(held, encode, "toxic int, at array<int>").toArrow()
    finally:
        held.unpersist()
    at = [np.array(x, np.int64) for x in coded["at"].to_pylist()]
    toxic = np.array(coded["toxic"].to_pylist()) > 0
    grades = np.array([int(t) * (1 + (marker[x].sum() > 1)) for t, x in zip(toxic, at, strict=True)])
    if grades.max() == 2 and not (grades == 1).any():
        grades = np.minimum(grades, 1)
    w, theta = fit_ordinal(at, grades, len(place))
    return OrdinalModel({word: float(w[k]) for word, k in place.items() if w[k]}, theta.tolist())


def severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Columns: id, p_toxic (P(grade > 0)), severity (expected grade), grade (the likeliest); with ``keep``, the columns of docs instead and rows of p_toxic < 0.5 only."""

    def score(texts: pa.Array) -> np.ndarray:
        return np.array([model.above(x.as_py()) for x in texts], float).reshape(len(texts), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = score(batch.column(1))
            edges = np.hstack((np.ones((len(p), 1)), p, np.zeros((len(p), 1))))
            grade = (edges[:, :-1] - edges[:, 1:]).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array(grade, pa.int32())], ["id", "p", "s", "g"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())]
            yield batch.filter(pa.array([model.above(x)[0] < 0.5 for x in texts], pa.bool_()))

    if keep:
        return map_arrow(docs, clean, docs.schema)
    return map_arrow(docs.select(id_col, utf8(text_col).alias("_text")), run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, p_toxic double, severity double, grade int")


def op3_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document; toxic if grade 1 or more is likelier than not."""
    docs = table(spark, sf_dir, "documents")
    scored = severity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "p_toxic", "severity", "grade", (F.col("p_toxic") >= 0.5).alias("toxic"))


QUERIES = {"op3_ordinal_toxicity": op3_ordinal_toxicity}
