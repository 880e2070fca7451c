"""Alignment of two tokenizers over the same bytes: a byte-level BPE (A) and a sentence-piece BPE with byte fallback (B).

Both token lists of a text are lists of end offsets. The shorter list drives: each of its ends gallops through the longer
one, in doubling steps from where its share of the list would put it and then by halving, all ends of a block of texts in
lockstep. Common ends cut both lists into groups; for each A token the ranks of its start and end among B's ends give
the range of B tokens that it overlaps. A link is a pair of an A and a B occurrence that end together.

Corpus counts of linked id pairs: each block of texts names its distinct pairs once, a row each, Spark sums them, and each block asks
back for its own pairs only: they meet its texts in a Python worker, one block after the other. The few pairs that stand in more than a thousandth of all places are joined by broadcast (there
are at most a thousand of them), all others by a shuffle, so no key brings many rows to one task.

Defined results: a null or empty text, and one whose tokens spell other bytes than space + text (bytes that are not UTF-8,
characters that B rewrites), has no tokens; equal texts give equal results, repeated rows count each time; an empty table
gives none; extra columns are left out. Texts are encoded whole; a long one takes memory in proportion to its length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from crawlstrata.llm.bpe import byte_alphabet
from crawlstrata.llm.common import map_arrow, merged, stash, table, utf8
from crawlstrata.shipping import ship

#: Bytes of text that are aligned together (more, if one text has more).
BLOCK_BYTES = 1 << 20
#: Rows that a worker hands over at once.
BATCH = 1 << 14
#: Pairs in more than one of this many places are joined by broadcast; there are at most this many of them.
HOT_SHARE = 1000


class Vocabulary:
    """Byte strings of token ids, as one buffer with offsets."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.buffer = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """All bytes of the tokens, one after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.buffer[np.arange(total) + np.repeat(self.starts[ids] - (ends - sizes), sizes)]


def gallop(keys: np.ndarray, guess: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For each key the first index of a sorted list whose value is not less; every key is at most the last value.

    From its guess each key steps 1, 2, 4, ... to the side where its place is, until it has passed it, and halves the last step.
    """
    last = len(longer) - 1
    ahead = longer[guess] < keys
    # longer[low] < key <= longer[high], where low may be -1
    low, high = np.where(ahead, guess, -1), np.where(ahead, last, guess)
    open_, step = np.arange(len(keys)), 1
    while len(open_):
        at = guess[open_] + np.where(ahead[open_], step, -step)
        inside = (at >= 0) & (at <= last)
        open_, at = open_[inside], at[inside]
        less = longer[at] < keys[open_]
        low[open_] = np.where(less, at, low[open_])
        high[open_] = np.where(less, high[open_], at)
        open_ = open_[less == ahead[open_]]
        step *= 2
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        less = longer[middle] < keys[open_]
        low[open_] = np.where(less, middle, low[open_])
        high[open_] = np.where(less, high[open_], middle)
        open_ = open_[high[open_] - low[open_] > 1]
    return high


def common_ends(ends_a: np.ndarray, n_a: np.ndarray, ends_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into both lists of ends (offsets of a whole block of texts, n tokens a text) of the ends they share, in order."""
    partner = np.full(len(ends_a), -1)
    a_drives = n_a <= n_b
    for drives, own, n_own, other, n_other, swap in ((a_drives, ends_a, n_a, ends_b, n_b, False), (~a_drives, ends_b, n_b, ends_a, n_a, True)):
        at = np.flatnonzero(np.repeat(drives, n_own))
        if not len(at):
            continue
        text = np.repeat(np.arange(len(n_own)), n_own)[at]
        first_own, first_other = np.cumsum(n_own) - n_own, np.cumsum(n_other) - n_other
        guess = first_other[text] + (at - first_own[text]) * n_other[text] // n_own[text]
        rank = gallop(own[at], guess, other)
        hit = other[rank] == own[at]
        at, rank = at[hit], rank[hit]
        partner[rank if swap else at] = at if swap else rank
    a = np.flatnonzero(partner >= 0)
    return a, partner[a]


@dataclass
class Aligned:
    """A block of texts: ids of both sides, tokens a text, and the indices of tokens that end together."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray

    def groups(self) -> np.ndarray:
        """Groups of each text."""
        before = np.concatenate(([0], np.cumsum(self.n_a)))
        return np.diff(np.searchsorted(self.last_a, before))

    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """For each A token the first and last B token (index in the block) that it shares bytes with."""
        starts = np.concatenate(([0], self.ends_a[:-1]))
        return np.searchsorted(self.ends_b, starts, "right"), np.searchsorted(self.ends_b, self.ends_a, "left")


class Aligner:
    """Both tokenizers, from the bytes of their files."""

    def __init__(self, a_json: bytes, b_model: bytes, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        value = {c: b for b, c in enumerate(byte_alphabet())}
        spec = json.loads(a_json)
        special = {x["id"] for x in spec["added_tokens"]}
        vocab = {t: bytes(value[c] for c in s) for s, t in spec["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={s: t for t, s in vocab.items()}, special_tokens={})
        self.a = Vocabulary([vocab.get(t, b"") for t in range(max(vocab) + 1)])
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        piece = lambda t: bytes([int(self.pieces.id_to_piece(t)[1:-1], 16)]) if self.pieces.is_byte(t) else self.pieces.id_to_piece(t).replace("▁", " ").encode()
        self.b = Vocabulary([piece(t) for t in range(self.pieces.get_piece_size())])
        ids = np.arange(max(len(self.a.sizes), len(self.b.sizes)))
        #: Decimal digits of ids, room for what closes them, and the number of digits.
        self.digits = np.array([list(str(t).encode().ljust(7, b"\0")) for t in ids], np.uint8)
        self.n_digits = np.array([len(str(t)) for t in ids])

    def align(self, texts: list[bytes]) -> Aligned:
        """Texts whose tokens do not spell space + text have no tokens."""
        strings = [t.decode("utf-8", "replace") for t in texts]
        a = [np.array(self.encoding.encode_ordinary(" " + s) if s else [], np.int32) for s in strings]
        b = [np.array(x if s else [], np.int32) for s, x in zip(strings, self.pieces.encode(strings, num_threads=1), strict=True)]
        for k, t in enumerate(texts):
            raw = b" " + t
            if len(a[k]) and not (self.a.spell(a[k]).tobytes() == raw and self.b.spell(b[k]).tobytes() == raw):
                a[k] = b[k] = np.zeros(0, np.int32)
        n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        all_a, all_b = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (a, b))
        ends_a, ends_b = np.cumsum(self.a.sizes[all_a]), np.cumsum(self.b.sizes[all_b])
        last_a, last_b = common_ends(ends_a, n_a, ends_b, n_b)
        return Aligned(all_a, all_b, n_a, n_b, ends_a, ends_b, last_a, last_b)

    def group_digests(self, x: Aligned) -> list[str]:
        """sha256 of the groups of each text, written as ``a1,a2|b1;a3|b2,b3``; '' for a text without tokens."""
        # A token of A stands after the B tokens of all groups before its own, one of B after the A tokens of groups up to its own.
        group_a, group_b = np.searchsorted(x.last_a, np.arange(len(x.a))), np.searchsorted(x.last_b, np.arange(len(x.b)))
        b_before, a_until = np.concatenate(([0], x.last_b[:-1] + 1)) if len(x.last_b) else x.last_b, x.last_a + 1
        at_a, at_b = np.arange(len(x.a)) + b_before[group_a], np.arange(len(x.b)) + a_until[group_b]
        order = np.empty(len(x.a) + len(x.b), np.int64)
        order[at_a], order[at_b] = x.a, x.b
        close = np.full(len(order), ord(","), np.uint8)
        close[at_a[x.last_a]], close[at_b[x.last_b]] = ord("|"), ord(";")
        rows, sizes = self.digits[order], self.n_digits[order]
        rows[np.arange(len(order)), sizes] = close
        written = rows[np.arange(rows.shape[1]) <= sizes[:, None]].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes + 1)))[np.concatenate(([0], np.cumsum(x.n_a + x.n_b)))]
        return [hashlib.sha256(written[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_LOADED: dict[str, Aligner] = {}


@dataclass(frozen=True)
class Tokenizers:
    """The tokenizers' files as the driver has read them (a few megabytes, whatever the corpus); workers build each once."""

    a_json: bytes
    b_model: bytes
    pattern: str

    @classmethod
    def read(cls, path_a: str, path_b: str, pattern: str) -> Tokenizers:
        with open(path_a, "rb") as a, open(path_b, "rb") as b:
            return cls(a.read(), b.read(), pattern)

    @classmethod
    def default(cls) -> Tokenizers:
        import public_tokenizers

        return cls.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)

    def loaded(self) -> Aligner:
        name = hashlib.blake2b(self.a_json + self.b_model + self.pattern.encode()).hexdigest()
        if name not in _LOADED:
            _LOADED[name] = Aligner(self.a_json, self.b_model, self.pattern)
        return _LOADED[name]


def blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of consecutive rows (id, text) of about ``block_bytes`` of text."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(i.as_py())
            texts.append(t.as_py())
            size += len(texts[-1])
            if size >= block_bytes:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _cut(values: np.ndarray, n: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of n values for each text."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(values, kind))


def align(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns: id, a_ids, b_ids, a_ends and b_ends (indices after the last token of each group), b_first and b_last (range of B tokens that each A token overlaps)."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared.value.loaded()
        for ids, texts in blocks(batches, block_bytes):
            x = aligner.align(texts)
            before_a, before_b = np.cumsum(x.n_a) - x.n_a, np.cumsum(x.n_b) - x.n_b
            groups, (first, last) = x.groups(), x.overlaps()
            columns = [
                pa.array(ids),
                _cut(x.a, x.n_a, pa.int32()),
                _cut(x.b, x.n_b, pa.int32()),
                _cut(x.last_a + 1 - np.repeat(before_a, groups), groups, pa.int32()),
                _cut(x.last_b + 1 - np.repeat(before_b, groups), groups, pa.int32()),
                _cut(first - np.repeat(before_b, x.n_a), x.n_a, pa.int32()),
                _cut(last - np.repeat(before_b, x.n_a), x.n_a, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "a", "b", "c", "d", "e", "f"])

    lists = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_ends", "b_ends", "b_first", "b_last"))
    return map_arrow(docs.select(id_col, utf8(text_col).alias("_text")), run, f"{id_col} {kind}, {lists}")


def link_counts(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see the module).

    Blocks are rows of texts and rows of pairs in every table, which stream: only a Python worker holds one block at a time, whatever a task has of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = shared.value.loaded(), TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(blocks(batches, block_bytes)):
            x = aligner.align(texts)
            linked = x.a[x.last_a].astype(np.int64) << 32 | x.b[x.last_b]
            pairs, places, counts = np.unique(linked, return_inverse=True, return_counts=True)
            groups = x.groups()
            ends = np.cumsum(groups)
            of_texts = [pa.array([places[b - n : b].astype("<i4").tobytes() for b, n in zip(ends.tolist(), groups.tolist(), strict=True)], pa.binary())]
            of_texts = [pa.array(ids, keys), *[pa.array(v, pa.int64()) for v in (x.n_a, x.n_b, groups)], pa.array(aligner.group_digests(x), pa.string()), *of_texts]
            of_pairs = [pa.array(np.arange(len(pairs)), pa.int32()), pa.array(pairs, pa.int64()), pa.array(counts, pa.int64())]
            none = lambda columns, n: [pa.nulls(n, c.type) for c in columns]
            for n, columns in ((len(ids), [*none(of_pairs, len(ids)), *of_texts]), (len(pairs), [*of_pairs, *none(of_texts, len(pairs))])):
                made = pa.RecordBatch.from_arrays([pa.array(np.full(n, task << 32 | k), pa.int64()), *columns], names)
                yield from (made.slice(at, BATCH) for at in range(0, n, BATCH))

    of_block = f"{id_col} {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, places binary"
    names, keys = [f"c{k}" for k in range(10)], to_arrow_type(docs.schema[id_col].dataType)
    aligned = stash(map_arrow(docs.select(id_col, utf8(text_col).alias("_text")), run, f"_block long, _at int, _pair long, _n long, {of_block}"))
    asked = aligned.where("_pair is not null").select(F.col("_block").alias("block"), F.col("_at").alias("at"), F.col("_pair").alias("pair"), F.col("_n").alias("n"))
    b_id = F.col("pair").bitwiseAND((1 << 32) - 1)
    totals = stash(asked.groupBy("pair").agg(F.sum("n").alias("total"), F.count("*").alias("places")))
    highest = totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("highest"))
    # One row for each id of B's vocabulary at most.
    known = totals.join(F.broadcast(highest), b_id == F.col("b")).select("pair", "total", "places", (F.col("total") == F.col("highest")).alias("best"))
    bound = (totals.agg(F.sum("places")).first()[0] or 0) / HOT_SHARE
    hot = known.where(F.col("places") > bound).select("pair", "total", "best")
    cold = known.where(F.col("places") <= bound).select("pair", "total", "best")
    answers = asked.join(F.broadcast(hot), "pair").unionByName(asked.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(merged(cold), "pair"))
    texts = aligned.where("_pair is null").drop("_at", "_pair", "_n")

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        at, total, best = right["at"].to_numpy(), np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        total[at], best[at] = right["total"].to_numpy(), right["best"].to_numpy()
        _, ids, n_a, n_b, groups, digests, places = left.columns
        places = np.frombuffer(b"".join(places.to_pylist()), "<i4")
        ends = np.concatenate(([0], np.cumsum(groups.to_numpy())))
        of = lambda values: pa.array(np.diff(np.concatenate(([0], np.cumsum(values[places])))[ends]), pa.int64())
        return pa.Table.from_arrays([ids, n_a, n_b, groups, groups, of(best), of(total), digests], [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    ship(docs.sparkSession)
    told = answers.select(F.col("block").alias("_block"), "at", "total", F.col("best").cast("long").alias("best"))
    return texts.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(sums, f"{id_col} {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_galloping_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of all documents under the two public vocabularies."""
    return link_counts(table(spark, sf_dir, "documents"), Tokenizers.default())


QUERIES = {"op12_galloping_alignment": op12_galloping_alignment}
