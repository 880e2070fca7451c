"""Quality rules by line sequence labelling.

A linear-chain conditional random field marks each line of a text as content or boilerplate. Its line features are
shares of byte classes, word statistics, repetitions within the text, and whether the line is common, that is, stands in
one of ``SHARE`` distinct texts of the corpus (and in ``LEAST`` at least). Viterbi decoding gives the best sequence. A
text is kept if the share of its words that stand in content lines reaches a threshold, unless simple base rules have failed it.

Labels are of documents, so line labels are weak. Common lines are boilerplate wherever they stand, and other lines of
documents of quality 1 content. The other lines of documents of quality 0 start as boilerplate; after a first fit, those
that by their own features look like content are content, and the field is fitted again. Training reads a bounded
sample (``per_class`` documents of each label, the least by a hash of the id; of a document of more than ``chunk``
lines, consecutive chunks are separate sequences). Common lines are counted over all texts, equal texts once; as each
stands in a fixed share of the texts, there are at most ``SHARE`` times the mean number of lines of them, which bounds
the broadcast. Decoding reads whole texts.

Words are maximal runs of bytes other than space and \\t to \\r. Defined results: a null or empty text has no words and
fails the base rules; lines without a word take no part in decoding; texts of any length are decoded whole; ties go to content;
without labels of both kinds all lines are content; repeated rows get equal results; an empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlstrata.llm.common import bounded_sample, drop, map_arrow, stash, table, utf8

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
#: Byte classes whose share of a line is a feature: symbols, digits, upper case, sentence marks, other ASCII marks, bytes from 0x80 on.
CLASSES = (
    SYMBOLS,
    b"0123456789",
    bytes(range(65, 91)),
    b".,;:!?",
    bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in SYMBOLS + b".,;:!?"),
)
NO_STARTS = bytes(c for c in range(256) if not 128 <= c < 192)
DELETE = [bytes(c for c in range(256) if c not in kept) for kept in CLASSES]
#: Upper ends of the bins that turn a feature value into an indicator.
SHARE_BINS = (0.0, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5)
SIZE_BINS = (1, 2, 4, 8, 16, 32, 64, 128)
N_SHARES, N_SIZES = len(CLASSES) + 2, 2
WIDTH = N_SHARES * (len(SHARE_BINS) + 1) + N_SIZES * (len(SIZE_BINS) + 1) + 3
COMMON = WIDTH - 1
#: A line is common that stands in one of so many distinct texts, and in so many at least.
SHARE, LEAST = 10_000, 3


def line_features(line: bytes, words: list[bytes], seen: bool) -> list[int]:
    """Indices of the indicators that hold for a line: one bin of each feature, and repeated or ends in a sentence mark."""
    size = len(line)
    shares = [len(line.translate(None, d)) / size for d in DELETE]
    shares.append(1 - len(set(words)) / len(words))
    shares.append(list(map(len, words)).count(1) / len(words))
    sizes = (len(words), size / len(words))
    out, at = [], 0
    for x in shares:
        out.append(at + bisect_left(SHARE_BINS, x))
        at += len(SHARE_BINS) + 1
    for x in sizes:
        out.append(at + bisect_left(SIZE_BINS, x))
        at += len(SIZE_BINS) + 1
    if seen:
        out.append(at)
    if line.rstrip()[-1:] in b".!?":
        out.append(at + 1)
    return out


def line_hash(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line.strip())


def lines_of(text: bytes, common: frozenset[int] = frozenset()) -> tuple[list[int], list[list[int]], int]:
    """Words and features of each line with a word, and the number of lines equal to an earlier one."""
    sizes, found, repeated, earlier = [], [], 0, set()
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            seen = line in earlier
            repeated += seen
            earlier.add(line)
            sizes.append(len(words))
            features = line_features(line, words, seen)
            if line_hash(line) in common:
                features.append(COMMON)
            found.append(features)
    return sizes, found, repeated


def common_lines(docs: DataFrame, text_col: str = "text", share: int = SHARE, least: int = LEAST, most_covered: float = 0.5) -> frozenset[int]:
    """Hashes of the lines that stand in one of ``share`` distinct texts, and in ``least`` at least.

    A text of whose words more than ``most_covered`` stand in lines that others have too is a near copy of them, and does not count: else the prose
    that near copies share would be boilerplate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lines, sizes = [], [], []
            for x in batch.column(0):
                words: dict[int, int] = {}
                for line in x.as_py().split(b"\n"):
                    if n := len(line.split()):
                        h = line_hash(line)
                        words[h] = words.get(h, 0) + n
                names.append(xxhash.xxh64_intdigest(x.as_py()))
                lines.append(np.array(list(words), np.uint64).view(np.int64))
                sizes.append(list(words.values()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.uint64()).view(pa.int64()), pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64()))], ["text", "lines", "sizes"])

    texts = stash(map_arrow(docs.select(utf8(text_col).alias("_text")), run, "text long, lines array<long>, sizes array<long>").dropDuplicates(["text"]))
    most = max(least, texts.count() // share)

    def often(lines: DataFrame) -> np.ndarray:
        found = lines.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("line").toArrow()
        return np.sort(found["line"].to_numpy())

    shared = docs.sparkSession.sparkContext.broadcast(often(texts.select(F.explode("lines").alias("line"))))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shared lines of texts that mostly have lines of their own."""
        for batch in batches:
            out = [np.zeros(0, np.int64)]
            for lines, sizes in zip(batch.column(0), batch.column(1), strict=True):
                found, n = lines.values.to_numpy(), sizes.values.to_numpy()
                known = np.isin(found, shared.value, assume_unique=True)
                if n[known].sum() <= most_covered * n.sum():
                    out.append(found[known])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], ["line"])

    found = often(map_arrow(texts.select("lines", "sizes"), own, "line long"))
    drop(texts)
    return frozenset(found.view(np.uint64).tolist())


@dataclass
class LineCrf:
    """emission[state, feature], transition[from, to] and start[state]; state 0 is content, 1 boilerplate."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def viterbi(self, found: list[list[int]]) -> list[int]:
        """The likeliest states of a sequence."""
        content, junk = self.emission.tolist()
        (cc, cj), (jc, jj) = self.transition.tolist()
        of_content, of_junk = content.__getitem__, junk.__getitem__
        a, b = self.start.tolist()
        back: list[tuple[int, int]] = []
        for k, line in enumerate(found):
            here_a, here_b = sum(map(of_content, line)), sum(map(of_junk, line))
            if k:
                from_a, from_b = a + cc >= b + jc, a + cj >= b + jj
                a, b = (a + cc if from_a else b + jc), (a + cj if from_b else b + jj)
                back.append((0 if from_a else 1, 0 if from_b else 1))
            a += here_a
            b += here_b
        state = 0 if a >= b else 1
        states = [state]
        for step in reversed(back):
            state = step[state]
            states.append(state)
        return states[::-1]


def fit(sequences: list[list[list[int]]], labels: list[list[int]], steps: int = 100, rate: float = 0.2, l2: float = 1e-3) -> LineCrf:
    """Maximise the conditional likelihood of the lines' labels with forward-backward and Adam."""
    lengths = np.array([len(s) for s in sequences])
    n, t_most = len(sequences), int(lengths.max())
    y = np.array([k for row in labels for k in row])
    pairs = np.array([2 * a + b for row in labels for a, b in zip(row, row[1:], strict=False)], np.int64)
    firsts = np.array([row[0] for row in labels])
    where_line = np.repeat(np.arange(len(y)), [len(x) for s in sequences for x in s])
    where_n = np.repeat(np.arange(n), [sum(map(len, s)) for s in sequences])
    where_t = np.concatenate([np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in sequences])
    cols = np.array([f for s in sequences for x in s for f in x])
    flat = where_n * t_most + where_t
    real = np.arange(t_most)[None, :] < lengths[:, None]
    size = 2 * WIDTH + 4 + 2
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    truth = np.zeros(size)
    for s in (0, 1):
        truth[s * WIDTH : (s + 1) * WIDTH] = np.bincount(cols[y[where_line] == s], minlength=WIDTH)
        truth[2 * WIDTH + 4 + s] = (firsts == s).sum()
    truth[2 * WIDTH : 2 * WIDTH + 4] = np.bincount(pairs, minlength=4)
    total = lengths.sum()
    for step in range(1, steps + 1):
        emission, transition, start = w[: 2 * WIDTH].reshape(2, WIDTH), w[2 * WIDTH : 2 * WIDTH + 4].reshape(2, 2), w[-2:]
        score = np.stack([np.bincount(flat, emission[s][cols], n * t_most).reshape(n, t_most) for s in (0, 1)], axis=2)
        forward = np.empty_like(score)
        forward[:, 0] = start + score[:, 0]
        for t in range(1, t_most):
            forward[:, t] = np.logaddexp(forward[:, t - 1, :1] + transition[0], forward[:, t - 1, 1:] + transition[1]) + score[:, t]
        backward = np.zeros_like(score)
        for t in range(t_most - 2, -1, -1):
            after = backward[:, t + 1] + score[:, t + 1]
            step_back = np.logaddexp(after[:, :1] + transition[:, 0], after[:, 1:] + transition[:, 1])
            backward[:, t] = np.where(real[:, t + 1, None], step_back, 0)
        whole = np.logaddexp(*(forward[np.arange(n), lengths - 1].T))
        p = np.exp(np.minimum(forward + backward - whole[:, None, None], 0)) * real[:, :, None]
        g = truth.copy()
        for s in (0, 1):
            g[s * WIDTH : (s + 1) * WIDTH] -= np.bincount(cols, p[:, :, s].reshape(-1)[flat], WIDTH)
            g[2 * WIDTH + 4 + s] -= p[:, 0, s].sum()
            for r in (0, 1):
                pair = forward[:, :-1, s] + transition[s, r] + score[:, 1:, r] + backward[:, 1:, r] - whole[:, None]
                g[2 * WIDTH + 2 * s + r] -= (np.exp(np.minimum(pair, 0)) * real[:, 1:]).sum()
        g = g / total - l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LineCrf(w[: 2 * WIDTH].reshape(2, WIDTH).copy(), w[2 * WIDTH : 2 * WIDTH + 4].reshape(2, 2).copy(), w[-2:].copy())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", common: frozenset[int] = frozenset(), per_class: int = 800, chunk: int = 64, learn: Column | None = None) -> LineCrf:
    """Fit on at most 2 * ``per_class`` documents, among those that ``learn`` (a condition on the id) admits; features of their lines, not texts, reach the driver."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy(id_col).agg(F.min(label_col).cast("int").alias("_good"))
    of = lambda y: bounded_sample(known.where(F.col("_good") == y), id_col, per_class)
    rows = docs.select(id_col, utf8(text_col).alias("_text")).join(F.broadcast(of(0).unionByName(of(1))), id_col).select("_good", F.xxhash64(id_col).alias("_order"), "_text")

    known_lines = docs.sparkSession.sparkContext.broadcast(common)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines_of(x.as_py(), known_lines.value)[1] for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.list_(pa.int32())))], ["good", "order", "lines"])

    got = map_arrow(rows, extract, "good int, order long, lines array<array<int>>").toArrow()
    order = np.lexsort((got["order"].to_numpy(),))
    good = got["good"].to_numpy()
    sequences, marks, bad = [], [], []
    for k in order:
        lines = got["lines"][int(k)].as_py()
        for a in range(0, len(lines), chunk):
            sequences.append(lines[a : a + chunk])
            bad.append(not good[k])
            marks.append([int(bad[-1] or COMMON in x) for x in sequences[-1]])
    if len(set(bad)) < 2:
        return LineCrf(np.zeros((2, WIDTH)), np.zeros((2, 2)), np.array([1.0, 0.0]))
    # Every second sequence does not say which lines are common, so that the field learns how such lines look.
    blind = [[[f for f in x if f != COMMON] for x in s] if k % 2 else s for k, s in enumerate(sequences)]
    first = fit(blind, marks)
    lean = first.emission[0] - first.emission[1]
    lean[COMMON] = 0
    for k in np.flatnonzero(bad):
        marks[k] = [int(COMMON in x or lean[x].sum() < 0) for x in sequences[k]]
    return fit(blind, marks)


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words covered by windows that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    for w in words:
        if w not in ids:
            ids[w] = len(ids)
    name = np.array(list(map(ids.__getitem__, words)), np.int64)
    # Names of runs of 2, 4 and 8 words: equal names, equal runs.
    size = 1
    while size < window:
        grow = min(size, window - size)
        pair = name[: len(name) - grow] * (int(name.max()) + 1) + name[grow:]
        name = np.unique(pair, return_inverse=True)[1]
        size += grow
        if len(name) == int(name.max()) + 1:
            return 0
    twice = np.bincount(name)[name] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def base_counts(text: bytes) -> tuple[list[bytes], int, int]:
    """Words, code points in words, symbols."""
    words = text.split()
    packed = b"".join(words)
    points = len(packed) - len(packed.translate(None, NO_STARTS))
    symbols = len(text.translate(None, DELETE[0]))
    return words, points, symbols


def judge(docs: DataFrame, model: LineCrf, id_col: str = "doc_id", text_col: str = "text", common: frozenset[int] = frozenset(), least_content: float = 0.5) -> DataFrame:
    """Columns: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_share, base_failed, kept."""
    known_lines = docs.sparkSession.sparkContext.broadcast(common)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shares = [], []
            for x in batch.column(1):
                text = x.as_py()
                words, points, symbols = base_counts(text)
                sizes, found, dup = lines_of(text, known_lines.value)
                states = model.viterbi(found) if found else []
                content = sum(n for n, s in zip(sizes, states, strict=True) if not s)
                counts.append((len(words), points, symbols, dup, repeated_words(words)))
                shares.append(content / len(words) if words else 0.0)
            columns = np.array(counts, np.int64).reshape(-1, 5)
            failed = (columns[:, 0] < 20) | (100 * columns[:, 4] > 30 * columns[:, 0])
            share = np.array(shares, float)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[:, k]) for k in range(5)), pa.array(share), pa.array(failed), pa.array(~failed & (share >= least_content))], ["id", *names, "content_share", "base_failed", "kept"])

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {', '.join(f'{x} long' for x in names)}, content_share double, base_failed boolean, kept boolean"
    return map_arrow(docs.select(id_col, utf8(text_col).alias("_text")), run, schema)


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    common = common_lines(docs)
    model = train(docs, table(spark, sf_dir, "labels"), common=common)
    return judge(docs, model, common=common).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept")


QUERIES = {"op2_line_crf": op2_line_crf}
