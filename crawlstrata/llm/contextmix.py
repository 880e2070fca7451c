"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text is coded in order, word after word. Each word of the vocabulary has a binary code (Huffman's, of the training
counts), so a word is a short path of bit decisions; ``coded`` holds the words of each text as numbers. Each decision
is predicted by several contexts, all of which reach across words:

* the class (language, say) that most of the last words are at home in,
* the last word, hashed,
* a match: the word that followed the last six words elsewhere in the training corpus.

The first two look up how often the bit was 0 and 1 in that context in all training texts. A match is found through
anchors, places that the content of the six words chooses (one in ``EVERY``): an anchor that occurs in another training
text brings the words that follow there, up to its next anchor. The anchors are a Spark table that grows with the corpus.
The predictions are added in the logistic domain with weights that a gate selects (evidence behind the hashed context,
length of the match, depth in the code); an adaptive map refines the result. Weights and map learn online from the
decisions of all training texts; a decision's own count is taken out wherever a training text is learned from or
scored. The score is the sum of the log probabilities of all decisions.

Words outside the (bounded) vocabulary are coded as the escape, then by what is joined from the table of all counts: the class of
their count and equally likely members of it, or, for a word that no other text has, the word spelled by a second mixer of the
same kind, whose contexts are the last two and the last four bytes.

Defined results: a null or empty text has one token, its end; repeated rows count each in training and get equal scores
if none of them is learned from; texts of any length are coded whole, in stretches of words; without training documents all counts are 0
and words are spelled with bits of probability 1/2; an empty table gives none.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlstrata.llm.common import drop, id_crc32, map_arrow, stash, table, utf8

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
N1, N2, N3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
#: Numbers of the end of a text and of the escape; words follow, the most frequent first.
END, RARE = 0, 1
#: Words handled at once in decisions and in contexts, words that vote for a class, and bits of a word's number.
CHUNK, TOGETHER, VOTERS, ID_BITS = 1 << 11, 1 << 18, 16, 21
#: Words of an anchor, and the share of places that are anchors.
GRAM, EVERY = 6, 16
#: An anchor of more places than this is hot, or than its share of all places that leaves at most ``MOST_HOT`` of them; tasks over which a hot anchor is dealt.
LEAST_HOT, MOST_HOT, SALTS = 10_000, 100_000, 16
#: Range of stretched predictions, and steps of the adaptive map over it.
LIMIT, STEPS = 10, 41
BLOCK = 1 << 13
#: Codes of evidence; up to ``EXACT`` observations have codes of their own.
PRIOR, EXACT, CODES = 0.1, 9, 128
N_EXACT = (EXACT + 1) * (EXACT + 2) // 2
_deep = np.minimum(np.arange(256) // 4, 2)


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


class Places(dict):
    """Numbers of words; a word outside the vocabulary has the escape's."""

    def __missing__(self, word: bytes) -> int:
        return RARE


def pack(ids: np.ndarray) -> bytes:
    """Numbers below 1,114,112 in one to four bytes each."""
    return ids.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class Code:
    """Huffman's code of symbols 0 to n - 1: each is a path of (node, bit) decisions."""

    def __init__(self, counts: list[int]) -> None:
        n = len(counts)
        heap = [(c, k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, side = np.full(2 * n - 1, -1, np.int32), np.zeros(2 * n - 1, np.uint8)
        for node in range(n, 2 * n - 1):
            for bit in (0, 1):
                c, k = heapq.heappop(heap)
                parent[k], side[k] = node, bit
                total = c if bit == 0 else total + c
            heapq.heappush(heap, (total, node))
        self.n_nodes = n - 1
        self.length = np.zeros(n, np.int64)
        for symbol, _ in self._climb(parent):
            self.length[symbol] += 1
        self.offset = np.cumsum(self.length) - self.length
        #: For each decision of each symbol: node << 8 | depth << 1 | bit. And each symbol's bits, from the highest of 64 on.
        self.steps = np.zeros(self.length.sum(), np.int32)
        self.left = np.zeros(n, np.uint64)
        for up, (symbol, at) in enumerate(self._climb(parent)):
            depth, bit = self.length[symbol] - 1 - up, side[at].astype(np.int64)
            self.steps[self.offset[symbol] + depth] = (parent[at] - n).astype(np.int64) << 8 | depth << 1 | bit
            self.left[symbol] |= bit.astype(np.uint64) << (63 - depth).astype(np.uint64)

    @staticmethod
    def _climb(parent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Symbols that are not at the root yet, and where they are, from the leaves up."""
        symbol = at = np.arange(len(parent) // 2 + 1)
        while len(symbol := symbol[below := parent[at] >= 0]):
            at = at[below]
            yield symbol, at
            at = parent[at]


def evidence(counts: np.ndarray) -> np.ndarray:
    """A code for each (zeros, ones): up to ``EXACT`` observations as they are, more as a rounded stretched prediction."""
    out = np.empty(len(counts), np.uint8)
    for k in range(0, len(counts), 1 << 16):
        zero, one = counts[k : k + (1 << 16)].T
        n = zero + one
        some = np.log((one + PRIOR) / (zero + PRIOR))
        many = N_EXACT + np.clip(np.rint((some + LIMIT) / (2 * LIMIT) * (CODES - 1 - N_EXACT)), 0, CODES - 1 - N_EXACT)
        out[k : k + (1 << 16)] = np.where(n <= EXACT, n * (n + 1) // 2 + one, many)
    return out


def _meanings() -> tuple[np.ndarray, np.ndarray]:
    """For each code of evidence with a 0 or a 1 taken out, or nothing: stretched prediction, level of evidence."""
    x = np.tile(np.linspace(-LIMIT, LIMIT, CODES - N_EXACT), (3, 1))
    pairs = np.array([(n - k, k) for n in range(EXACT + 1) for k in range(n + 1)])
    less = [np.maximum(pairs - own, 0) for own in ([1, 0], [0, 1], [0, 0])]
    x = np.hstack([np.log((np.array([q[:, 1] for q in less]) + PRIOR) / (np.array([q[:, 0] for q in less]) + PRIOR)), x])
    n = np.hstack([np.array([q.sum(axis=1) for q in less]), np.full((3, CODES - N_EXACT), EXACT + 1)])
    return x, np.searchsorted([0, 3, EXACT], n)


STRETCHED, LEVEL = _meanings()


class Mixer:
    """Two counted contexts and a match, mixed by gated weights[input, gate] and refined by map[row, step].

    ``seen`` has a code of evidence for each slot of the contexts. What a decision brings to learning, and what its
    probability depends on, is its cell: both codes of evidence, the row (what else the gate looks at), the bit that the
    match expects, and the bit itself. So all decisions of all training texts are counted by cell, in Spark, and weights
    and map learn online from the cells; no text is left out.
    """

    def __init__(self, n_rows: int, match: bool = True) -> None:
        self.n_rows, self.n_expected = n_rows, 3 if match else 1
        self.n_cells = n_rows * self.n_expected * 2 * CODES * CODES
        self.seen = np.zeros(0, np.uint8)
        self.weights = np.full((4, 4 * n_rows), 0.4)
        self.weights[3] = 0
        self.map = np.tile(squash(np.linspace(-LIMIT, LIMIT, STEPS)), (n_rows, 1))
        self.tables: np.ndarray | None = None

    def cells(self, slots: list[np.ndarray], bit: np.ndarray, row: np.ndarray, expected: np.ndarray | int) -> np.ndarray:
        cell = self.seen[slots[0]].astype(np.int64) * CODES
        cell += self.seen[slots[1]]
        cell *= self.n_rows
        cell += row
        cell *= self.n_expected
        cell += expected + self.n_expected // 2
        cell <<= 1
        cell |= bit
        return cell

    def _mixed(self, cell: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, gate, row, bit and stretched mixture of cells; ``own``: the decision's own bit is taken out of the evidence."""
        bit, rest = cell & 1, cell >> 1
        expected, rest = rest % self.n_expected - self.n_expected // 2, rest // self.n_expected
        row, rest = rest % self.n_rows, rest // self.n_rows
        taken = bit if own else np.full(len(cell), 2)
        x = np.stack([STRETCHED[taken, rest // CODES], STRETCHED[taken, rest % CODES], 4.0 * expected, np.ones(len(cell))])
        gate = LEVEL[taken, rest % CODES] * self.n_rows + row
        return x, gate, row, bit, (x * self.weights[:, gate]).sum(axis=0)

    def learn(self, counts: np.ndarray, passes: int = 30, batch: int = 1 << 13) -> None:
        """Online steps over the cells that occur, batch by batch in a mixed order; then the map, from where the mixtures lie."""
        occur = np.flatnonzero(counts)
        if not len(occur):
            passes = 0
        order = np.random.default_rng(5)
        squares = np.full(self.weights.shape, 1e-6)
        for k in range(passes):
            for some in np.array_split(order.permutation(occur), max(1, len(occur) // batch)):
                x, gate, _, bit, dot = self._mixed(some, True)
                error = (bit - squash(dot)) * counts[some] / max(1.0, counts.sum() / len(occur))
                for i, g in enumerate(np.stack([np.bincount(gate, error * x[i], self.weights.shape[1]) for i in range(4)])):
                    squares[i] += g * g
                    self.weights[i] += 0.2 * g / np.sqrt(squares[i])
        _, _, row, bit, dot = self._mixed(occur, True)
        step = row * STEPS + np.rint((np.clip(dot, -LIMIT, LIMIT) + LIMIT) / (2 * LIMIT) * (STEPS - 1)).astype(np.int64)
        n = np.bincount(step, counts[occur], self.map.size).reshape(self.map.shape)
        ones = np.bincount(step, counts[occur] * bit, self.map.size).reshape(self.map.shape)
        self.map += (ones - n * self.map) / (n + 60)
        self.tables = np.stack([self._table(own) for own in (False, True)])

    def _table(self, own: bool) -> np.ndarray:
        """log10 of the probability of each cell's bit: the mean of the mixture and its refinement."""
        out = np.empty(self.n_cells, np.float32)
        for a in range(0, self.n_cells, 1 << 18):
            _, _, row, bit, dot = self._mixed(np.arange(a, min(a + (1 << 18), self.n_cells)), own)
            step = (np.clip(dot, -LIMIT, LIMIT - 1e-3) + LIMIT) / (2 * LIMIT) * (STEPS - 1)
            low = step.astype(np.int64)
            one = (squash(dot) + self.map[row, low] * (low + 1 - step) + self.map[row, low + 1] * (step - low)) / 2
            out[a : a + len(one)] = np.log10(np.clip(np.where(bit == 1, one, 1 - one), 1e-7, 1))
        return out


class Tally:
    """Counts of numbers."""

    def __init__(self, size: int) -> None:
        self.counts = np.zeros(size, np.int32)

    def add(self, numbers: np.ndarray, times: np.ndarray | None = None) -> None:
        np.add.at(self.counts, numbers, np.ones(len(numbers), np.int32) if times is None else times)

    def total(self) -> np.ndarray:
        return self.counts


class WordMixer:
    """Bit predictors of words in sequence."""

    def __init__(self, code: Code, home: np.ndarray, n_classes: int, slot_bits: int) -> None:
        self.code, self.home, self.n_classes, self.slot_bits = code, home, n_classes, slot_bits
        self.near = (n_classes + 1) * code.n_nodes
        self.n_slots = self.near + (1 << slot_bits)
        self.mixer = Mixer(4 * 3)

    def groups(self, texts: list[np.ndarray], predicted: list[np.ndarray] | None) -> Iterator[np.ndarray]:
        """Keys (see ``_keys``) of the words of all texts in order. Short texts are taken together, so that many words have equal keys and arrays stay small."""
        a = 0
        while a < len(texts):
            size, b = 0, a
            while b < len(texts) and (b == a or size + len(texts[b]) <= TOGETHER):
                size += len(texts[b])
                b += 1
            yield self._keys(texts[a:b], predicted and predicted[a:b])
            a = b

    def _keys(self, texts: list[np.ndarray], predicted: list[np.ndarray] | None) -> np.ndarray:
        """All that a word's decisions depend on, in one number: class, match and bits that it shares with the predicted word, last word, word."""
        ids = np.concatenate(texts)
        lengths = np.array([len(t) for t in texts])
        at = np.arange(len(ids))
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        low, most, kind = np.maximum(at - VOTERS, first), np.zeros(len(ids), np.int64), np.full(len(ids), self.n_classes)
        home = self.home[ids]
        for c in np.unique(home[home < self.n_classes]).tolist():
            sums = np.concatenate(([0], np.cumsum(home == c)))
            votes = sums[at] - sums[low]
            kind[votes > most] = c
            most = np.maximum(most, votes)
        key = kind << 9
        if predicted is not None and ((guess := np.concatenate(predicted)) >= 0).any():
            missed = np.concatenate(([-1], np.maximum.accumulate(np.where(guess == ids, -1, at))[:-1]))
            run = at - 1 - np.maximum(missed, first - 1)
            match = 1 + (run >= 4) + (run >= 16)
            # Of a predicted word, the bits expected are those of its code, up to where it leaves the path.
            common = 64 - np.frexp((self.code.left[ids] ^ self.code.left[np.maximum(guess, 0)]).astype(np.float64))[1]
            key |= np.where(guess < 0, 0, match << 7 | common + 1)
        key <<= ID_BITS
        key |= np.where(at > first, ids[at - 1], 0)
        key <<= ID_BITS
        key |= ids
        return key

    def stretches(self, keys: np.ndarray) -> Iterator[tuple]:
        for a in range(0, len(keys), CHUNK):
            yield slice(a, a + CHUNK), *self._decide(keys[a : a + CHUNK])

    def _decide(self, keys: np.ndarray) -> tuple:
        """Decisions in each word, and over decisions: bit, slots of both contexts, row (match and depth), bit that the match expects (1, -1 or 0)."""
        code, mask = self.code, (1 << ID_BITS) - 1
        ids, last, rest = keys & mask, (keys >> ID_BITS & mask).astype(np.uint32) * N1 + N3, keys >> 2 * ID_BITS
        kind, match, common = (rest >> 9) * code.n_nodes, rest >> 7 & 3, (rest & 127) - 1
        n = code.length[ids]
        flat = np.arange(n.sum()) + np.repeat(code.offset[ids] - (np.cumsum(n) - n), n)
        step = code.steps[flat]
        node, depth, bit = step >> 8, step >> 1 & 127, step & 1
        h = np.repeat(last, n) + node.astype(np.uint32) * N2
        h *= N3
        h ^= h >> np.uint32(15)
        h *= N1
        h >>= np.uint32(32 - self.slot_bits)
        slots = [np.repeat(kind, n) + node, h.astype(np.int64) + self.near]
        row = _deep[depth]
        if not match.any():
            return n, bit, slots, row, 0
        common = np.repeat(common, n)
        return n, bit, slots, row + 3 * np.repeat(match, n), ((depth < common) * 1 - (depth == common)) * (2 * bit - 1)

    def tally(self, slots_seen: Tally, texts: list[np.ndarray], predicted: list[np.ndarray]) -> None:
        for keys in self.groups(texts, None):
            keys, times = np.unique(keys, return_counts=True)
            for at, n, bit, slots, _, _ in self.stretches(keys):
                each = np.repeat(times[at].astype(np.int32), n)
                for s in slots:
                    slots_seen.add(2 * s + bit, each)

    def observe(self, cells_seen: Tally, texts: list[np.ndarray], predicted: list[np.ndarray]) -> None:
        for keys in self.groups(texts, predicted):
            keys, times = np.unique(keys, return_counts=True)
            for at, n, bit, slots, row, expected in self.stretches(keys):
                cells_seen.add(self.mixer.cells(slots, bit, row, expected), np.repeat(times[at].astype(np.int32), n))

    def score(self, texts: list[np.ndarray], predicted: list[np.ndarray], own: bool) -> np.ndarray:
        """log10 probability of each text."""
        lengths = np.array([len(t) for t in texts])
        logs, sums = self.mixer.tables[int(own)], [np.zeros(1)]
        for keys in self.groups(texts, predicted):
            keys, which = np.unique(keys, return_inverse=True)
            each = [np.add.reduceat(logs[self.mixer.cells(slots, bit, row, expected)], np.cumsum(n) - n, dtype=np.float64) for _, n, bit, slots, row, expected in self.stretches(keys)]
            sums.append(np.concatenate(each)[which])
        sums = np.cumsum(np.concatenate(sums))
        ends = np.cumsum(lengths)
        return sums[ends] - sums[ends - lengths]


class Speller:
    """Bit predictors of a new word's bytes and of the space that closes it, from the last two and the last four bytes."""

    SLOT_BITS = 19

    def __init__(self) -> None:
        self.n_slots = 2 << self.SLOT_BITS
        self.mixer = Mixer(8 * 2, match=False)

    def stretches(self, words: list[bytes]) -> Iterator[tuple]:
        """For words in parts: number of the word, bit, slots, row (place in the byte and in the word)."""
        at = 0
        while at < len(words):
            size, to = 0, at
            while to < len(words) and (size == 0 or size + len(words[to]) < 1 << 13):
                size += len(words[to]) + 1
                to += 1
            part = words[at:to]
            buffer = np.frombuffer(b"".join([b"\1\1\1\1" + w + b" " for w in part]), np.uint8).astype(np.uint32)
            lengths = np.array([len(w) + 1 for w in part])
            place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            index = np.repeat(np.cumsum(lengths + 4) - lengths, lengths) + place
            byte, packed, slots = buffer[index], np.zeros(len(index), np.uint32), []
            j = np.arange(8, dtype=np.uint32)
            node = (np.uint32(1) << j)[None, :] | byte[:, None] >> (np.uint32(8) - j)[None, :]
            bit = (byte[:, None] >> (np.uint32(7) - j)[None, :] & np.uint32(1)).astype(np.int64).reshape(-1)
            for k in range(4):
                packed = packed << np.uint32(8) | buffer[index - 1 - k]
                if k % 2:
                    h = ((packed + np.uint32(k)) * N1)[:, None] + node * N2
                    h ^= h >> np.uint32(15)
                    h *= N3
                    h ^= h >> np.uint32(13)
                    slots.append((h * N1 >> np.uint32(32 - self.SLOT_BITS)).astype(np.int64).reshape(-1) + (k // 2 << self.SLOT_BITS))
            row = (np.arange(8)[None, :] + 8 * np.minimum(place, 1)[:, None]).reshape(-1)
            yield np.repeat(np.arange(at, to), lengths * 8), bit, slots, row
            at = to

    def tally(self, slots_seen: Tally, words: list[bytes]) -> None:
        for _, bit, slots, _ in self.stretches(words):
            for s in slots:
                slots_seen.add(2 * s + bit)

    def observe(self, cells_seen: Tally, words: list[bytes]) -> None:
        for _, bit, slots, row in self.stretches(words):
            cells_seen.add(self.mixer.cells(slots, bit, row, 0))

    def score(self, words: list[bytes], own: bool) -> np.ndarray:
        out, logs = np.zeros(len(words)), self.mixer.tables[int(own)]
        for number, bit, slots, row in self.stretches(words):
            out += np.bincount(number, logs[self.mixer.cells(slots, bit, row, 0)], len(words))
        return out


def vocabulary(docs: DataFrame, kind: Column, classes: int, text_col: str, flush: int = 300_000) -> DataFrame:
    """Columns: word (binary), c0, c1, ... (counts in training rows by class), c (in all): every word of the rows with a class."""
    names = [f"c{k}" for k in range(classes)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(classes)]

        def out() -> Iterator[pa.RecordBatch]:
            for k, c in enumerate(seen):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(np.full(len(c), k), pa.int32()), pa.array(list(c.values()), pa.int64())], ["word", "kind", "n"])
                c.clear()

        for batch in batches:
            for text, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[k].update(tokens(text.as_py()))
                if sum(map(len, seen)) > flush:
                    yield from out()
        yield from out()

    rows = docs.select(utf8(text_col).alias("_text"), kind.cast("int").alias("_kind")).where("_kind is not null")
    parts = map_arrow(rows, count, "word binary, kind int, n long")
    return stash(parts.groupBy("word").agg(F.sum("n").alias("c"), *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(names)]))


def _classes(docs: DataFrame, training: Column, class_col: str | None, most: int) -> tuple[Column, int]:
    """The class of a training row (null for others), and the number of classes: the most frequent values and one for the rest."""
    if class_col is None:
        return F.when(training, 0), 1
    top = docs.where(training & F.col(class_col).isNotNull()).groupBy(class_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), class_col).limit(most - 1).collect()
    kind = F.lit(len(top))
    for k, r in enumerate(top):
        kind = F.when(F.col(class_col) == r[class_col], k).otherwise(kind)
    return F.when(training, kind), len(top) + 1


def _threshold(vocab: DataFrame, most: int) -> float:
    """A count that at most ``most`` words reach. Counts are tallied on a logarithmic scale, so the tally is small."""
    scale = vocab.groupBy(F.floor(F.log2("c") * 16).alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    above, least = 0, math.inf
    for row in scale:
        above += row["n"]
        if above > most:
            break
        least = 2 ** (row["step"] / 16)
    return max(2.0, least) - 1e-6


def _blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(counts), BLOCK):
        if counts[k : k + BLOCK].any():
            yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int64()), pa.array([counts[k : k + BLOCK].tobytes()], pa.binary())], ["block", "n"])


def _sum_arrays(parts: DataFrame, size: int, result: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray:
    """``result`` of the sums of the counts that tasks send in blocks, added up in Spark; of a block without counts it is 0."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for batch in batches for x in batch.column(1))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([result(total).astype(kind).tobytes()], pa.binary())], ["block", "n"])

    out, each = np.zeros(size, kind), len(result(np.zeros(BLOCK, np.int64)))
    for batch in parts.groupBy("block").applyInArrow(add, "block long, n binary").toArrow().to_batches():
        for block, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            piece = np.frombuffer(n.as_buffer(), kind)
            out[block * each : block * each + len(piece)] = piece
    return out


def _train(model: WordMixer | Speller, rows: DataFrame, texts: Callable[[pa.RecordBatch], tuple]) -> None:
    """Counts of all rows by context, then of all their decisions by cell, then weights and map."""
    sc = rows.sparkSession.sparkContext
    # Each task sends an array of counts whatever its rows, so a task takes more rows here.
    rows = rows.coalesce(max(2 * sc.defaultParallelism, rows.rdd.getNumPartitions() // 8))

    def counted(counts: int, add: str, size: int, result: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray:
        shared = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tally = Tally(counts)
            for part in _parts(batches):
                getattr(shared.value, add)(tally, *texts(part))
            yield from _blocks(tally.total())

        out = _sum_arrays(map_arrow(rows, run, "block long, n binary"), size, result, kind)
        shared.destroy()
        return out

    # Only a byte for each slot comes to the driver; evidence of no observation is 0.
    model.mixer.seen = counted(2 * model.n_slots, "tally", model.n_slots, lambda n: evidence(n.reshape(-1, 2)), np.uint8)
    model.mixer.learn(counted(model.mixer.n_cells, "observe", model.mixer.n_cells, lambda n: n, np.int64))


def anchors(ids: np.ndarray) -> np.ndarray:
    """Places at which an anchor ends, and their names."""
    n = len(ids) - GRAM + 1
    if n < 1:
        return np.zeros((2, 0), np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h + ids[k : k + n].astype(np.uint64) + np.uint64(1)) * M1
        h ^= h >> np.uint64(29)
    h *= M2
    at = np.flatnonzero(h >> np.uint64(40) & np.uint64(EVERY - 1) == 0)
    return np.stack((at + GRAM - 1, h[at].view(np.int64)))


def anchors_of(texts: list[np.ndarray], together: int = 1 << 14) -> list[np.ndarray]:
    """``anchors`` of each text, found in many short texts at once."""
    out, a = [], 0
    while a < len(texts):
        size, b = 0, a
        while b < len(texts) and (b == a or size + len(texts[b]) <= together):
            size += len(texts[b])
            b += 1
        found = anchors(np.concatenate(texts[a:b]))
        ends = np.cumsum([len(t) for t in texts[a:b]])
        starts = np.concatenate(([0], ends[:-1]))
        of = np.searchsorted(ends, found[0], side="right")
        # An anchor's words are of one text.
        whole = found[0] - GRAM + 1 >= starts[of]
        found, of = found[:, whole], of[whole]
        found[0] -= starts[of]
        out += np.split(found, np.searchsorted(of, np.arange(1, b - a)), axis=1)
        a = b
    return out


def _matches(coded: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Columns text, row, n_train, found (array of (place, words)): what follows a text's anchors in another training text.

    Equal texts are one: ``row`` is one of them and ``n_train`` says how many are training texts. Anchors that very many
    texts share (at most ``MOST_HOT``, so they fit a broadcast) are not shuffled by their name. Also the tables that it reads.
    """
    texts = stash(coded.groupBy("text").agg(F.min("row").alias("row"), F.sum(F.col("train").cast("long")).alias("n_train")))
    whole = coded.select("row", "anchors", "ids").join(texts, "row")
    places = stash(whole.select("text", (F.col("n_train") > 0).alias("train"), F.posexplode("anchors").alias("k", "anchor")))
    source = F.when(F.col("train"), F.col("text"))
    ends = places.groupBy("anchor").agg(F.min(source).alias("t1"), F.max(source).alias("t2"), (F.min("text") < F.max("text")).alias("several"), F.count("*").alias("n"))
    ends = stash(ends.where("several and t1 is not null").drop("several"))
    total = ends.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > max(LEAST_HOT, total // MOST_HOT)
    met = places.join(ends.where(~hot), "anchor").withColumn("hot", F.lit(False)).unionByName(places.join(F.broadcast(ends.where(hot)), "anchor").withColumn("hot", F.lit(True)))
    met = met.withColumn("source", F.when(F.col("t1") != F.col("text"), F.col("t1")).when(F.col("t2") != F.col("text"), F.col("t2")))
    met = stash(met.where("source is not null").select("text", "k", "anchor", "source", "hot"))
    wanted = met.select("anchor", "source", "hot").distinct()
    at = wanted.join(places.select("anchor", F.col("text").alias("source"), "k"), ["anchor", "source"]).groupBy("source", "anchor", "hot").agg(F.min("k").alias("k"))
    asked = at.groupBy("source").agg(F.collect_list(F.struct("k", "anchor", "hot")).alias("asked"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            out = []
            texts = [unpack(x) for x in batch.column(1).to_pylist()]
            for source, ids, (places, _), which in zip(batch.column(0).to_pylist(), texts, anchors_of(texts), batch.column(2).to_pylist(), strict=True):
                ends = [*places.tolist(), len(ids)]
                for w in which:
                    a, b = ends[w["k"]] + 1, ends[w["k"] + 1] + 1
                    out.append((w["anchor"], source, w["hot"], pack(ids[a:b])))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["anchor", "source", "hot", "words"])

    given = whole.select(F.col("text").alias("source"), "ids").join(asked, "source").select("source", "ids", "asked")
    words = stash(map_arrow(given, follow, "anchor long, source long, hot boolean, words binary"))
    drop(places, ends)
    salt = F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))
    cold = met.where("not hot").join(words.where("not hot"), ["anchor", "source"]).select("text", "k", "words")
    split = met.where("hot").withColumn("salt", F.pmod("text", F.lit(SALTS)).cast("int")).join(words.where("hot").withColumn("salt", salt), ["anchor", "source", "salt"])
    found = cold.unionByName(split.select("text", "k", "words")).groupBy("text").agg(F.collect_list(F.struct("k", "words")).alias("found"))
    return texts.join(found, "text", "left"), (texts, met, words)


def matches(ids: np.ndarray, found: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The predicted word at each place, or -1. found: (place, words that follow it elsewhere)."""
    out = np.full(len(ids), -1)
    for at, words in found:
        here = ids[at + 1 : at + 1 + len(words)]
        differ = np.flatnonzero(here != words[: len(here)])
        n = differ[0] + 1 if len(differ) else len(here)
        out[at + 1 : at + 1 + n] = words[:n]
    return out


def _predict(coded: DataFrame) -> DataFrame:
    """Written columns row, train, ids, guess: predicted words, plus one (null: none). A text with another training copy is foretold by that, from its first anchor on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            out = []
            for data, copies, found in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if copies <= 0 and not found.is_valid:
                    out.append(None)
                    continue
                ids = unpack(data.as_py())
                places = anchors(ids)[0].tolist()
                if copies > 0:
                    pieces = [(places[0], ids[places[0] + 1 :])] if places else []
                else:
                    pieces = [(places[k], unpack(w)) for k, w in sorted((f["k"], f["words"]) for f in found.as_py())]
                out.append(pack(matches(ids, pieces) + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["row", "train", "ids", "guess"])

    met, read = _matches(coded)
    both = coded.select("text", "row", "train", "ids").join(met.drop("row"), "text")
    both = both.select("row", "train", "ids", (F.col("n_train") - F.col("train").cast("long")).alias("copies"), "found")
    full = stash(map_arrow(both, run, "row long, train boolean, ids binary, guess binary"))
    drop(*read)
    return full


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what is unpacked at once stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _texts(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Words and predicted words of the texts of a batch."""
    ids = [unpack(x.as_py()) for x in batch.column("ids")]
    return ids, [unpack(g.as_py()) - 1 if g.is_valid else np.full(len(x), -1) for g, x in zip(batch.column("guess"), ids, strict=True)]


def _bucket(count: Column) -> Column:
    """The class of a count: four to each doubling; -1 for none."""
    return F.when(count > 0, F.floor(F.log2(count.cast("double")) * 4 + 1e-9)).otherwise(F.lit(-1)).cast("int")


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None, most_classes: int = 8, frequent: int = 1 << 17, slot_bits: int = 20) -> DataFrame:
    """Columns: id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The vocabulary (at most ``frequent`` words), the evidence of the contexts (a byte for each of 1 << ``slot_bits`` slots, and of each class and node) and the weights are broadcast; all else is joined.
    """
    sc = docs.sparkSession.sparkContext
    kind, n_classes = _classes(docs, training, class_col, most_classes)
    vocab = vocabulary(docs, kind, n_classes, text_col)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    facts = vocab.agg(zero("c").alias("n"), F.count("*").alias("v"), *[zero(f"c{k}").alias(f"c{k}") for k in range(n_classes)]).first()
    ends = docs.where(training).count()
    n_all = facts["n"] + ends
    space = math.log10(n_all + facts["v"] + (ends > 0) + 1)

    least = _threshold(vocab, frequent)
    top = vocab.where(F.col("c") >= least).orderBy(F.desc("c"), "word").toArrow()
    words, counts = top["word"].to_pylist(), top["c"].to_numpy()
    place = Places((w, k + 2) for k, w in enumerate(words))
    code = Code([ends + 1, int(facts["n"] - counts.sum()) + 1, *counts.tolist()])
    share = np.column_stack([top[f"c{k}"].to_numpy() / max(1, facts[f"c{k}"]) for k in range(n_classes)]) if len(words) else np.zeros((0, n_classes))
    home = np.concatenate(([n_classes] * 2, np.where(2 * share.max(axis=1) > share.sum(axis=1), share.argmax(axis=1), n_classes) if len(words) else [])).astype(np.int64)
    mixer = WordMixer(code, home, n_classes, slot_bits)
    lookup = sc.broadcast((place, np.concatenate(([math.log10(ends + 1), 0.0], np.log10(counts + 1.0)))))
    end_known = int(ends > 0)
    del top, words, place, share

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, logs = lookup.value
        get = place.__getitem__
        for batch in _parts(batches, 1024):
            facts, texts, rares, times, sizes = [], [], [], [], []
            for x in batch.column(3):
                text = x.as_py()
                found = tokens(text)
                ids = np.fromiter(map(get, found), np.int64, len(found))
                at = np.flatnonzero(ids == RARE).tolist()
                rare = Counter([found[k] for k in at])
                ids = np.append(ids, END)
                rares += rare.keys()
                times += rare.values()
                texts.append(ids)
                sizes.append(len(rare))
                facts.append((len(ids), len(text), len(found) - len(at) + end_known, logs[ids].sum() - space * (len(ids) - len(at))))
            counts, names = np.array(facts, float).reshape(-1, 4), [name for _, name in anchors_of(texts)]
            ends = [np.concatenate(([0], np.cumsum(n))).astype(np.int32) for n in ([len(x) for x in names], sizes)]
            lists = [pa.ListArray.from_arrays(ends[k], v) for k, v in ((0, pa.array(np.concatenate([np.zeros(0, np.int64), *names]))), (1, pa.array(rares, pa.binary())), (1, pa.array(times, pa.int64())))]
            whole = [pa.array(counts[:, k].astype(np.int64)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *whole, pa.array(counts[:, 3]), pa.array([pack(x) for x in texts], pa.binary()), *lists], ["_id", "row", "train", "n_tokens", "n_bytes", "known", "base", "ids", "anchors", "words", "times"])

    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, row long, train boolean, n_tokens long, n_bytes long, known long, base double, ids binary, anchors array<long>, words array<binary>, times array<long>"
    rows = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(training, F.lit(False)).alias("train"), utf8(text_col).alias("_text"))
    coded = stash(map_arrow(rows, encode, schema).withColumn("text", F.xxhash64("ids")))
    lookup.destroy()
    full = _predict(coded)
    _train(mixer, full.where("train").select("ids", "guess"), _texts)
    speller = Speller()
    _train(speller, vocab.where("c = 1").select("word"), lambda batch: (batch.column(0).to_pylist(),))
    model, spell = sc.broadcast(mixer), sc.broadcast(speller)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            ids, guesses = _texts(batch)
            train, sums = batch.column("train").to_numpy(zero_copy_only=False), np.zeros(len(ids))
            for own in (False, True):
                which = np.flatnonzero(train == own)
                if len(which):
                    sums[which] = model.value.score([ids[k] for k in which], [guesses[k] for k in which], own)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sums)], ["row", "score"])

    rated = map_arrow(full, rate, "row long, score double")

    # Words outside the vocabulary: of their class of counts, one of equally likely members; or new, and spelled.
    members = {r["b"]: r["n"] for r in vocab.where(F.col("c") < least).groupBy(_bucket(F.col("c")).alias("b")).agg(F.count("*").alias("n")).collect()}
    mass = {r["b"]: r["n"] for r in vocab.where(F.col("c") < least).groupBy(_bucket(F.col("c") - 1).alias("b")).agg(F.sum("c").alias("n")).collect()}
    whole = sum(mass.values()) + 0.5 * (len(members) + 1)
    of_bucket = {b: math.log10((mass.get(b, 0) + 0.5) / whole / n) for b, n in members.items()}
    new = math.log10((mass.get(-1, 0) + 0.5) / whole)

    logs = np.full(max(members, default=-1) + 2, new)
    for b, p in of_bucket.items():
        logs[b] = p

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, train = batch.column("b").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
            out = logs[np.clip(bucket, -1, len(logs) - 1)]
            for own in (False, True):  # the word's own letters are counted only where it is a training word
                which = np.flatnonzero((bucket < 0) & (train == own))
                if len(which):
                    out[which] += spell.value.score(batch.column("word").take(pa.array(which)).to_pylist(), own)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("tf"), batch.column("c"), pa.array(out)], ["row", "tf", "c", "p"])

    rare = coded.select("row", "train", F.explode(F.arrays_zip("words", "times")).alias("r")).select("row", "train", F.col("r.words").alias("word"), F.col("r.times").alias("tf"))
    rare = rare.join(vocab.select("word", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = rare.withColumn("b", _bucket(F.col("c") - F.col("train").cast("int")))
    completed = map_arrow(rare.select("row", "train", "word", "tf", "c", "b"), complete, "row long, tf long, c long, p double")
    log_base = F.log10(F.col("c") + 1) - F.lit(space)
    more = completed.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known2"), F.sum(F.col("tf") * log_base).alias("base2"), F.sum(F.col("tf") * F.col("p")).alias("score2"))
    both = coded.select("_id", "row", "n_tokens", "n_bytes", "known", "base").join(rated, "row").join(more, "row", "left")
    total = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    out = both.select(
        F.col("_id").alias(id_col),
        "n_tokens",
        total("known", "known2").cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        total("base", "base2").alias("base_score"),
        total("score", "score2").alias("score"),
        "n_bytes",
    )
    return out.withColumn("bits_per_byte", -F.col("score") / F.lit(math.log10(2)) / F.greatest(F.col("n_bytes"), F.lit(1))).drop("n_bytes")


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under a model of six sevenths of them."""
    held_out = id_crc32("doc_id") % 7 == 2
    scored = score(table(spark, sf_dir, "documents"), ~held_out, class_col="lang")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


QUERIES = {"op7_context_mixing": op7_context_mixing}
