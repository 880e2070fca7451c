"""Removal of repeated passages: suffix sorting in blocks with difference-cover ranks.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the corpus. Sorting all suffixes
of 100 TB at once is out of reach, so the suffixes are dealt into buckets that share content, and one block of buckets is
sorted at a time:

1. Each window of ``length`` bytes picks the least hash among its ``gram``-byte substrings (leftmost of equals). Equal
   windows pick the same substring at the same place, so it names the bucket of the suffix that starts there. Buckets
   whose substring occurs only once cannot hold a repeated window and are left out.
2. The stretches of text of the remaining suffixes are shuffled to their bucket. Stretches equal as a whole are counted
   once, in the mapper already, and need no sorting among each other.
3. A block of buckets is sorted by the first bytes of its suffixes. Long ties are resolved by ranks that were computed
   beforehand for a difference-cover sample of the block (Kärkkäinen, 2007): for any two suffixes some shift below the
   period leads both to sample positions, whose ranks compare the rest.

A bucket with more suffixes than a task should sort (``LEAST_HOT``, whatever the size of the corpus) is split window by
window: the digests of its windows are counted in Spark, with partial sums before the shuffle, which is exact and has no hot
task.

Texts that are equal as a whole are analysed once; where they are long enough, every copy is repeated elsewhere and goes
completely.

Defined results: a null text is empty; texts shorter than ``length`` stay; repeated rows are copies of each other; a text of any
length is analysed whole, in memory in proportion to its length; an empty table gives none; extra columns are kept or left out, whatever their names. Removal is judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from crawlstrata.llm.common import drop, free_names, map_arrow, merged, stash, table, utf8

#: A difference cover of the numbers modulo 32: every difference occurs between two of these.
PERIOD, COVER = 32, (0, 1, 2, 3, 7, 11, 19)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xD1B54A32D192ED03)
#: Windows handled at once in a text, and bytes of a block of buckets.
STRETCH = 1 << 18
BLOCK = 1 << 20
#: Most suffixes of a bucket that a task sorts.
LEAST_HOT = 20_000
#: Bytes of stretches that a mapper holds at most to find equal ones.
HELD = 16 << 20
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, x)))) for x in (BASE, INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def buckets(text: bytes, length: int, gram: int) -> list[tuple[int, int, int, int]]:
    """(bucket, first, last, place): the windows first to last pick the substring at this place, which names the bucket."""
    found: list[tuple[int, int, int, int]] = []
    last_window = len(text) - length
    span = length - gram + 1
    for begin in range(0, last_window + 1, STRETCH):
        windows = min(STRETCH, last_window + 1 - begin)
        piece = np.frombuffer(text, np.uint8, windows + length - 1, begin).astype(np.uint64)
        up, down = powers(len(piece) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum((piece + np.uint64(1)) * up[:-1])))
        h = (sums[gram:] - sums[:-gram]) * down[: len(piece) - gram + 1]
        h ^= h >> np.uint64(31)
        h *= MIX
        h ^= h >> np.uint64(29)
        # Order by hash, then place: the low 20 bits hold the place within this piece.
        low = np.uint64((1 << 20) - 1)
        key = h & ~low | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(key) // span)
        padded = np.full(rows * span, ~np.uint64(0))
        padded[: len(key)] = key
        grid = padded.reshape(rows, span)
        left = np.minimum.accumulate(grid, axis=1).reshape(-1)
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        at = (np.minimum(right[:windows], left[span - 1 : span - 1 + windows]) & low).astype(np.int64)
        turns = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate(([0], turns))
        last = np.concatenate((turns, [windows])) - 1
        names = h[at[first]].view(np.int64)
        found += zip(names.tolist(), (first + begin).tolist(), (last + begin).tolist(), (at[first] + begin).tolist(), strict=True)
    return found


def _names(*keys: np.ndarray) -> np.ndarray:
    """Ranks of tuples: equal ranks, equal tuples; the order is that of the tuples."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int, bucket_size: int = 1 << 18) -> np.ndarray:
    """Which of the suffixes at ``starts`` share their first ``length`` bytes with another of them. All fit into the text."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(length + 2 * PERIOD + 8, np.uint8)))
    eight = np.empty(n + length + PERIOD, np.uint64)  # the eight bytes from each place on, as a number in byte order
    for j in range(8):
        part = np.frombuffer(padded, ">u8", (len(padded) - j) // 8, j)
        count = len(eight[j::8])
        eight[j::8] = part[:count]
    # Ranks of the sample, precomputed over ``reach`` bytes: doubled from one period on.
    reach = (length - PERIOD + 1) // PERIOD * PERIOD
    place = np.full(PERIOD, -1)
    place[list(COVER)] = np.arange(len(COVER))
    sample = (np.arange(0, n + PERIOD, PERIOD)[:, None] + np.array(COVER)[None, :]).reshape(-1)
    doubled = [_names(*(eight[sample + 8 * k] for k in range(PERIOD // 8)))]
    ahead = lambda names, periods: np.concatenate((names[periods * len(COVER) :], np.zeros(min(len(names), periods * len(COVER)), np.int64)))
    pair = lambda a, b: np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]
    while 1 << len(doubled) <= reach // PERIOD:
        doubled.append(pair(doubled[-1], ahead(doubled[-1], 1 << len(doubled) - 1)))
    rank, done = None, 0
    for k in reversed(range(len(doubled))):
        if reach // PERIOD >> k & 1:
            rank = doubled[k] if rank is None else pair(rank, ahead(doubled[k], done))
            done += 1 << k
    out = np.zeros(len(starts), bool)
    order = np.argsort(eight[starts], kind="stable")
    lead = eight[starts[order]]
    edges = np.concatenate(([0], np.flatnonzero(lead[1:] != lead[:-1]) + 1, [len(order)]))
    at = 0
    while at < len(edges) - 1:  # one suffix bucket at a time: suffixes with equal first bytes stay together
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + bucket_size, "right")) - 1)
        bucket = order[edges[at] : edges[to]]
        out[bucket] = _repeated_in(starts[bucket], eight, rank, place, length, reach)
        at = to
    return out


def _repeated_in(starts: np.ndarray, eight: np.ndarray, rank: np.ndarray, place: np.ndarray, length: int, reach: int) -> np.ndarray:
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    tie = _names(*(eight[starts + 8 * k] for k in range(PERIOD // 8)))
    some = np.flatnonzero(np.bincount(tie)[tie] > 1)
    if not len(some):
        return out
    # The bytes that the sample ranks do not reach for every shift.
    tails = [*range(reach, length - 8, 8), length - 8]
    tie = _names(tie[some], *(eight[starts[some] + k] for k in tails))
    held = np.bincount(tie)[tie] > 1
    some, tie = some[held], tie[held]
    index = lambda p: p // PERIOD * len(COVER) + place[p % PERIOD]
    # Suffixes of equal residue take their first sample place; then each shift compares those that it leads to the sample.
    residue = starts[some] % PERIOD
    shift = np.array([next(s for s in range(PERIOD) if place[(r + s) % PERIOD] >= 0) for r in range(PERIOD)])
    same = _names(tie, residue, rank[index(starts[some] + shift[residue])])
    out[some[np.bincount(same)[same] > 1]] = True
    for s in range(PERIOD):
        open_ = ~out[some]
        if not open_.any():
            break
        # An open suffix may equal one that is settled already, so all of its tie take part.
        alive = np.zeros(int(tie.max()) + 1, bool)
        alive[tie[open_]] = True
        several = np.zeros(len(alive), bool)
        several[tie[residue != _first_of(tie, residue)[tie]]] = True
        here = np.flatnonzero(alive[tie] & several[tie] & (place[(starts[some] + s) % PERIOD] >= 0))
        if len(here):
            same = _names(tie[here], rank[index(starts[some[here]] + s)])
            out[some[here[np.bincount(same)[same] > 1]]] = True
    return out


def _first_of(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A value of each group."""
    out = np.zeros(int(group.max()) + 1, value.dtype)
    out[group] = value
    return out


def repeated_windows(bodies: list[tuple[bytes, int]], length: int) -> list[np.ndarray]:
    """For each stretch (its bytes, where its bucket's substring starts), which of its windows occur in another one or elsewhere in it.

    Stretches are laid out so that the substring starts at a multiple of the period: suffixes that agree then mostly have equal residues.
    """
    pieces, offsets, at = [], [], 0
    for body, anchor in bodies:
        gap = (-at - anchor) % PERIOD
        pieces += [bytes(gap), body]
        offsets.append(at + gap)
        at += gap + len(body)
    sizes = [len(b) - length + 1 for b, _ in bodies]
    starts = np.concatenate([np.arange(o, o + s) for o, s in zip(offsets, sizes, strict=True)])
    found = repeated_starts(np.frombuffer(b"".join(pieces), np.uint8), starts, length)
    return np.split(found, np.cumsum(sizes)[:-1])


def runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [first, end) of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


RUNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _settle(rows: list[tuple], length: int) -> Iterator[tuple[bytes, list[dict]]]:
    """Repeated bytes of each text in a block of whole buckets. Rows: bucket, copies, text key, first window, anchor, body."""
    groups: dict[tuple[int, bytes], list[tuple]] = {}
    for row in rows:
        groups.setdefault((row[0], row[5]), []).append(row)
    per_bucket: dict[int, int] = {}
    for bucket, _ in groups:
        per_bucket[bucket] = per_bucket.get(bucket, 0) + 1
    keys = [k for k in groups if per_bucket[k[0]] > 1]
    masks = dict(zip(keys, repeated_windows([(k[1], groups[k][0][4]) for k in keys], length), strict=True)) if keys else {}
    for k, members in groups.items():
        if len(members) > 1 or members[0][1] > 1:
            runs = [(0, len(k[1]) - length + 1)]
        elif k in masks:
            runs = runs_of(masks[k])
        else:
            continue
        for m in members if runs else ():
            yield m[2], [{"a": m[3] + a, "b": m[3] + b - 1 + length} for a, b in runs]


def _pieces(rows: dict[tuple[int, bytes], list], rest: list[tuple], length: int) -> pa.RecordBatch:
    """Stretches of ordinary buckets with their bytes, those of hot buckets as digests of their windows, and settled ones with their size."""
    out = list(rest)
    for name, copies, key, first, anchor, stretch, hot in rows.values():
        if hot:
            digests = [hashlib.blake2b(stretch[k : k + length], digest_size=16).digest() for k in range(len(stretch) - length + 1)]
            out.append((name, copies, key, first, anchor, None, len(stretch), digests))
        else:
            out.append((name, copies, key, first, anchor, stretch, len(stretch), None))
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.binary()))
    columns = list(zip(*out, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", "copies", "key", "first", "anchor", "body", "size", "digests"])


def _counts(named: DataFrame) -> DataFrame:
    """Columns name, m: buckets of several suffixes and how many they have. named: key, copies, names."""
    return stash(named.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("m")).where("m > 1"))


def _places(named: DataFrame, counts: DataFrame, least_hot: int) -> DataFrame:
    """Columns: key, copies, k (place in names), name, hot (its bucket is to be split), for buckets of several suffixes."""
    hot = counts.where(F.col("m") > least_hot).select("name")
    places = named.select("key", "copies", F.posexplode("names").alias("k", "name"))
    cold = places.join(merged(counts.where(F.col("m") <= least_hot).select("name")), "name").withColumn("hot", F.lit(False))
    # Hot buckets are few: each has over ``least_hot`` suffixes.
    return cold.unionByName(places.join(F.broadcast(hot), "name").withColumn("hot", F.lit(True)))


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 400, gram: int = 64, least_hot: int = LEAST_HOT) -> DataFrame:
    """Columns: key (sha256 of the text), whole (all of it is repeated), spans (array of [a, b) in bytes, unordered): texts with repeated bytes only."""
    texts = docs.select(utf8(text_col).alias("text")).select(F.unhex(F.sha2("text", 256)).alias("key"), "text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [buckets(x.as_py(), length, gram) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in batch.column(1).to_pylist()], pa.int64()), pa.array([[b[0] for b in f] for f in found], pa.list_(pa.int64()))], ["key", "n", "names"])

    marks = stash(map_arrow(texts, mark, "key binary, n long, names array<long>"))
    distinct = stash(marks.groupBy("key").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("names").alias("names")))
    drop(marks)
    named = distinct.where(F.size("names") > 0)
    counts = _counts(named)
    wanted = stash(_places(named, counts, least_hot).groupBy("key").agg(F.first("copies").alias("copies"), F.collect_list(F.struct("k", "hot")).alias("wanted")))
    drop(counts)
    # One row for each distinct text: copies go before the shuffle already.
    found = texts.dropDuplicates(["key"]).join(merged(wanted), "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretches of all wanted buckets. Those that are equal and held at the same time are sent once, and the others are settled."""
        for batch in batches:
            rows: dict[tuple[int, bytes], list] = {}
            rest: list[tuple] = []
            size = 0
            for key, text, copies, which in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("copies").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                body = text.as_py()
                whole = buckets(body, length, gram)
                for w in which:
                    name, first, last, place = whole[w["k"]]
                    stretch = body[first : last + length]
                    known = rows.get((name, stretch))
                    if known is None:
                        rows[name, stretch] = [name, copies, key, first, place - first, stretch, w["hot"]]
                        size += len(stretch)
                    else:
                        known[1] += copies
                        rest.append((name, 0, key, first, 0, None, len(stretch), None))
                if size > HELD:
                    yield _pieces(rows, rest, length)
                    rows, rest, size = {}, [], 0
            yield _pieces(rows, rest, length)

    pieces = stash(map_arrow(found.select("key", "text", "copies", "wanted"), cut, "name long, copies long, key binary, first long, anchor long, body binary, size long, digests array<binary>"))
    drop(wanted)
    run = lambda a, n: F.struct(F.col(a).alias("a"), (F.col(a) + n).alias("b"))
    settled = pieces.where("body is null and digests is null").select("key", F.array(run("first", F.col("size"))).alias("spans"))
    windows = pieces.where("digests is not null").select("key", "first", "copies", F.posexplode("digests").alias("k", "digest"))
    often = windows.groupBy("digest").agg(F.sum("copies").alias("m")).where("m > 1").select("digest")
    split = windows.join(merged(often), "digest").withColumn("at", F.col("first") + F.col("k")).groupBy("key").agg(F.collect_list(run("at", length)).alias("spans"))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            done = list(_settle(rows, length))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], RUNS)], ["key", "spans"])

        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BLOCK and row[0] != rows[-1][0]:
                    yield out(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield out(rows)

    blocks = pieces.where("body is not null").repartition("name").sortWithinPartitions("name")
    sorted_ = map_arrow(blocks.select("name", "copies", "key", "first", "anchor", "body"), sort, "key binary, spans array<struct<a:long,b:long>>")
    spans = sorted_.unionByName(settled).unionByName(split).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    whole = distinct.where((F.col("copies") > 1) & (F.col("n") >= length)).select("key", F.lit(True).alias("whole"))
    found = stash(spans.join(whole, "key", "full").select("key", F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("spans")))
    drop(pieces, distinct)
    return found


def cut_spans(text: bytes, whole: bool, spans: list[dict]) -> tuple[bytes, int, int]:
    """What is left, bytes removed, and maximal runs removed."""
    if whole:
        return b"", len(text), 1
    left, at, removed, n = [], 0, 0, 0
    end = -1
    for s in sorted(spans, key=lambda s: s["a"]):
        a, b = s["a"], s["b"]
        if a > end:
            left.append(text[at:a])
            n += 1
            removed += b - a
        elif b > end:
            removed += b - end
        end = max(end, b)
        at = end
    left.append(text[at:])
    return b"".join(left), removed, n


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 64, text: bool = True) -> DataFrame:
    """Columns: id, n_bytes, n_removed, n_spans, kept_sha256; with ``text`` also kept (binary)."""
    spans = repeated_spans(docs, text_col, length, gram)
    rows = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_text")).select("_id", "_text", F.unhex(F.sha2("_text", 256)).alias("key"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for x, whole, spans in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                body = x.as_py()
                kept, removed, n = cut_spans(body, bool(whole), spans or [])
                out.append((len(body), removed, n, hashlib.sha256(kept).hexdigest(), *([kept] if text else [])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * text
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", *(f"c{k}" for k in range(len(kinds)))])

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * text
    return map_arrow(rows.join(merged(spans), "key", "left").select("_id", "_text", "whole", "spans"), apply, schema)


def strip_repeats(docs: DataFrame, text_col: str = "text", length: int = 400, gram: int = 64) -> DataFrame:
    """The rows of docs, with all columns, without repeated passages in the text; rows whose whole text went are dropped.

    A character of which a part was removed goes as a whole. A column n_chars, where there is one, is counted anew for changed texts.
    """
    key, whole_col, spans_col = free_names(docs.columns, "key", "whole", "spans")
    spans = repeated_spans(docs, text_col, length, gram).select(F.col("key").alias(key), F.col("whole").alias(whole_col), F.col("spans").alias(spans_col))
    at = docs.columns.index(text_col)
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-2]
            texts, stay = columns[at].to_pylist(), []
            sizes = columns[counted].to_pylist() if counted is not None else []
            for k, (whole, found) in enumerate(zip(batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist(), strict=True)):
                if whole or found:
                    kept = cut_spans(texts[k].encode(), bool(whole), found or [])[0]
                    texts[k] = kept.decode("utf-8", "ignore")
                    if sizes:
                        sizes[k] = len(texts[k])
                stay.append(not (whole or found) or texts[k] != "")
            columns[at] = pa.array(texts, columns[at].type)
            if counted is not None:
                columns[counted] = pa.array(sizes, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-2]).filter(pa.array(stay, pa.bool_()))

    keyed = docs.withColumn(key, F.unhex(F.sha2(utf8(text_col), 256))).join(merged(spans), key, "left").select(*docs.columns, whole_col, spans_col)
    return map_arrow(keyed, apply, docs.schema)


def word_codes(text: bytes) -> bytes:
    """Four bytes for each word (of ASCII whitespace), so that runs of words are strings of a fixed length."""
    return np.array([xxhash.xxh32_intdigest(w) for w in text.split()], "<u4").tobytes()


def word_spans(whole: bool, spans: list[dict], n_bytes: int, length: int) -> list[tuple[int, int]]:
    """Disjoint runs [a, b) of words that whole windows of codes cover. Windows that begin within a code do not count."""
    if whole:
        return [(0, n_bytes // 4)]
    runs: list[tuple[int, int]] = []
    for s in sorted(spans, key=lambda s: s["a"]):
        first, last = -(-s["a"] // 4), (s["b"] - length) // 4
        if first > last:
            continue
        if runs and first <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], last + length // 4))
        else:
            runs.append((first, last + length // 4))
    return runs


def cut_words(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """Text without these runs of words; whitespace around them stays."""
    places = [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", text)]
    left, at = [], 0
    for a, b in runs:
        left.append(text[at : places[a][0]])
        at = places[b - 1][1]
    left.append(text[at:])
    return b"".join(left)


def strip_repeated_words(docs: DataFrame, text_col: str = "text", words: int = 51) -> DataFrame:
    """The rows of docs, with all columns, without runs of ``words`` or more words that occur more than once; rows of which only whitespace is left are dropped.

    The search of ``repeated_spans`` runs over word codes. A column n_chars, where there is one, is counted anew for changed texts.
    """
    length, (key, whole_col, spans_col) = 4 * words, free_names(docs.columns, "key", "whole", "spans")
    at = docs.columns.index(text_col)
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_codes(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f for f in found if len(f) >= length], pa.binary())], ["code"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            yield batch.append_column(key, pa.array([hashlib.sha256(word_codes(x.as_py() or b"")).digest() for x in texts], pa.binary()))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-2]
            texts, stay = columns[at].to_pylist(), []
            sizes = columns[counted].to_pylist() if counted is not None else []
            for k, (whole, found) in enumerate(zip(batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist(), strict=True)):
                runs = []
                if whole or found:
                    body = texts[k].encode()
                    runs = word_spans(bool(whole), found or [], 4 * len(body.split()), length)
                if runs:
                    texts[k] = cut_words(body, runs).decode()
                    if sizes:
                        sizes[k] = len(texts[k])
                stay.append(not runs or texts[k].strip() != "")
            columns[at] = pa.array(texts, columns[at].type)
            if counted is not None:
                columns[counted] = pa.array(sizes, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-2]).filter(pa.array(stay, pa.bool_()))

    codes = stash(map_arrow(docs.select(utf8(text_col).alias("_text")), code, "code binary"))
    spans = repeated_spans(codes, "code", length, 32).select(F.col("key").alias(key), F.col("whole").alias(whole_col), F.col("spans").alias(spans_col))
    drop(codes)
    keyed = map_arrow(docs, sign, StructType([*docs.schema.fields, StructField(key, BinaryType())]))
    return map_arrow(keyed.join(merged(spans), key, "left").select(*docs.columns, whole_col, spans_col), apply, docs.schema)


def op6_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings of all documents, removed."""
    return dedup(table(spark, sf_dir, "documents"), text=False)


QUERIES = {"op6_difference_cover_dedup": op6_difference_cover_dedup}
